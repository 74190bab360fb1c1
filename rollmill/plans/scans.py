"""Queries of the readers and writers. Each writes given tables to the scratch folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.functions.grading import grade_exact
from rollmill.operators import evaluation as E
from rollmill.operators import prep as P
from rollmill.operators.runlog import wide_to_long
from rollmill.plans.catalog import query
from rollmill.plans.preparation import TRUTH
from rollmill.session import scratch_dir
from rollmill.sources import files as S
from rollmill.sources import sinks as K
from rollmill.views import docs, ev, hist, pref, qa, table


def _prompts(spark, sf):
    return P.build_prompt_rows(qa(spark, sf), "question", "answer", "item_id", data_source="openai/gsm8k", split="train")


@query("scan_prompts_parquet", views="qa", oracle=f"""
SELECT part, item_id AS index, {TRUTH} AS ground_truth, question FROM qa, (SELECT unnest(['train', 'test']) AS part)""")
def _(spark, sf):
    paths = []
    for part in ("train", "test"):
        rows = _prompts(spark, sf).withColumn("extra_info", F.col("extra_info").withField("split", F.lit(part)))
        paths.append(K.sink_parquet(rows, scratch_dir(spark, "prompts")))
    return S.read_prompts(spark, paths).select(
        F.col("extra_info.split").alias("part"), F.col("extra_info.index").alias("index"),
        F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.question").alias("question"),
    )


@query("scan_sft_parquet", "SELECT doc_id, source AS prompt, text AS response FROM documents")
def _(spark, sf):
    nested = table(spark, sf, "documents").select(
        "doc_id", F.array(F.struct(F.struct("source").alias("extra"))).alias("ask"), F.struct(F.array("text").alias("answer")).alias("said")
    )
    path = K.sink_parquet(nested, scratch_dir(spark, "sft"))
    return S.read_sft(
        spark, [path], prompt="ask", prompt_keys=["extra", "source"], response="said", response_keys=["answer"], keep=["doc_id"]
    )


@query("scan_messages_parquet", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    m = P.build_conversation_messages(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    path = K.sink_parquet(m.select("conv_id", F.array("messages").alias("messages")), scratch_dir(spark, "messages"))
    return S.read_messages(spark, [path], keep=["conv_id"]).select("conv_id", F.inline("messages"))


@query("scan_preference_parquet", views="pref", oracle="SELECT doc_id, prompt, chosen, rejected FROM pref")
def _(spark, sf):
    path = K.sink_parquet(pref(spark, sf), scratch_dir(spark, "pref"))
    return S.read_preferences(spark, [path], keep=["doc_id"])


def rollout_records(spark, sf):
    e = ev(spark, sf)
    return e.select(
        F.concat_ws(" ", "data_source", F.col("question_idx").cast("string")).alias("input"), "output",
        grade_exact(F.col("output"), F.col("ground_truth")).alias("score"),
        E.difficulty_bucket((F.col("k") % 17) / 16.0).alias("ref_score"), F.col("sample_id").alias("index"),
        F.lit("test").alias("split"), F.col("data_source").alias("source"), "track", "step",
    )


ROLLOUTS = r"""
SELECT sample_id AS index, track, step, data_source AS source, length(output)::INTEGER AS response_length, contains(output, '####') AS has_marker,
  CASE WHEN replace(nullif(regexp_extract(output, '#### (-?[0-9.,]+)', 1), ''), ',', '') = ground_truth::VARCHAR THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM ev"""


def _tidy(df):
    return df.select(
        "index", "track", "step", "source", F.length("output").alias("response_length"),
        F.col("output").contains("####").alias("has_marker"), "score",
    )


@query("scan_rollouts_json", views="ev", oracle=ROLLOUTS)
def _(spark, sf):
    path = K.sink_rollout_arrays(rollout_records(spark, sf), scratch_dir(spark, "rollouts"))
    return _tidy(S.read_rollout_arrays(spark, path, partitions="track string, step int"))


@query("sink_rollouts_json", views="ev", oracle=ROLLOUTS)
def _(spark, sf):
    path = K.sink_rollouts(rollout_records(spark, sf), scratch_dir(spark, "rollouts"))
    return _tidy(S.read_rollouts(spark, path))


METRICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("scan_history_csv", views="hist", oracle="""
SELECT 'run-' || run_id AS id, 'name ' || run_id AS name, row_id, step AS _step, metric, round(value, 6) AS value FROM hist WHERE run_id <> 'P'""")
def _(spark, sf):
    path = scratch_dir(spark, "history")
    h = hist(spark, sf)
    wide = h.select(
        F.col("run_id").alias("dir"), F.col("step").alias("_step"), "row_id",
        *[F.when(F.col("metric") == m, F.col("value")).alias(f"m/{m}") for m in METRICS],
    )
    wide.write.partitionBy("dir").option("header", "true").csv(path)
    # The run P has no metadata and must drop out.
    runs = h.where("run_id <> 'P'").groupBy("run_id").agg(F.min("created_at").cast("string").alias("created_at"))
    runs.select(
        F.col("run_id").alias("dir"), F.concat(F.lit("run-"), "run_id").alias("id"), F.concat(F.lit("name "), "run_id").alias("name"), "created_at"
    ).write.mode("append").partitionBy("dir").json(path)
    columns = [f"m/{m}" for m in METRICS]
    schema = "_step int, row_id bigint, " + ", ".join(f"`{c}` double" for c in columns)
    long = wide_to_long(S.read_histories(spark, path, schema), ["id", "name", "row_id", "_step"], columns)
    return long.withColumn("metric", F.regexp_replace("metric", "^m/", "")).withColumn("value", F.round("value", 6))


def _per_problem(spark, sf):
    p = E.per_problem(rollout_records(spark, sf).join(ev(spark, sf).select(F.col("sample_id").alias("index"), "question_idx"), "index"), ["track", "question_idx"], "score")
    return p.select(F.col("question_idx").alias("problem_idx"), F.lit("-").alias("ground_truth"), "n_samples", "n_correct", "accuracy", "track")


PER_PROBLEM_SQL = r"""
, g AS (SELECT *, CASE WHEN replace(nullif(regexp_extract(output, '#### (-?[0-9.,]+)', 1), ''), ',', '') = ground_truth::VARCHAR THEN 1 ELSE 0 END AS score FROM ev)
SELECT track, question_idx AS problem_idx, count(*) AS n_samples, count(*) FILTER (score = 1) AS n_correct, round(avg(score), 6) AS accuracy FROM g GROUP BY ALL"""


@query("scan_per_problem_csv", views="ev", oracle=PER_PROBLEM_SQL)
def _(spark, sf):
    path = K.sink_csv_summary(_per_problem(spark, sf), scratch_dir(spark, "per-problem"), ["track"])
    got = S.read_per_problem(spark, path, partitions="track string")
    return got.select("track", "problem_idx", "n_samples", "n_correct", F.round("accuracy", 6).alias("accuracy"))


@query("sink_csv_summary", views="ev", oracle=PER_PROBLEM_SQL)
def _(spark, sf):
    path = K.sink_csv_summary(_per_problem(spark, sf), scratch_dir(spark, "csv"))
    got = S.read_per_problem(spark, path, "problem_idx bigint, ground_truth string, n_samples bigint, n_correct bigint, accuracy double, track string")
    return got.select("track", "problem_idx", "n_samples", "n_correct", F.round("accuracy", 6).alias("accuracy"))


@query("sink_json_summary", views="ev", oracle=PER_PROBLEM_SQL)
def _(spark, sf):
    path = K.sink_json_summary(_per_problem(spark, sf), scratch_dir(spark, "json"))
    got = spark.read.schema("problem_idx bigint, n_samples bigint, n_correct bigint, accuracy double, track string").json(path)
    return got.select("track", "problem_idx", "n_samples", "n_correct", F.round("accuracy", 6).alias("accuracy"))


@query("sink_parquet", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, sf):
    path = K.sink_parquet(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), scratch_dir(spark, "parquet"))
    return spark.read.schema("doc_id bigint, lang string, n_chars bigint").parquet(path)


@query("sink_split_parquet", views="docs", oracle="SELECT doc_id, CASE WHEN quality IS NULL THEN 'test' ELSE 'train' END AS split FROM docs")
def _(spark, sf):
    d = docs(spark, sf).withColumn("split", F.when(F.col("quality").isNull(), "test").otherwise("train"))
    path = K.sink_split_parquet(d.select("doc_id", "split"), scratch_dir(spark, "split"))
    return spark.read.schema("doc_id bigint, split string").parquet(path)


@query("sink_generation_append", views="ev", oracle="""
, r AS (SELECT question_idx, sample_id, output, row_number() OVER (PARTITION BY question_idx ORDER BY sample_id) - 1 AS i FROM ev),
a AS (SELECT question_idx, i // 8 AS pass, count(*) AS n, string_agg(output, '|' ORDER BY sample_id) AS responses FROM r GROUP BY ALL)
SELECT doc_id AS question_idx, lang, pass, n, responses FROM documents JOIN a ON doc_id = question_idx""")
def _(spark, sf):
    prompts = table(spark, sf, "documents").select(F.col("doc_id").alias("question_idx"), "lang")
    out = K.attach_responses(prompts, ev(spark, sf), ["question_idx"], "sample_id", "output", 8)
    path = K.sink_parquet(out, scratch_dir(spark, "generation"))
    back = spark.read.schema("question_idx bigint, lang string, pass bigint, responses array<string>").parquet(path)
    return back.select("question_idx", "lang", "pass", F.size("responses").cast("bigint").alias("n"), F.array_join("responses", "|").alias("responses"))


@query("sink_metrics", views="hist", oracle="""
SELECT b.backend, run_id, metric, count(*) AS n, round(sum(value), 2) AS total FROM hist, (SELECT unnest(['json', 'parquet']) AS backend) b GROUP BY ALL""")
def _(spark, sf):
    a, b = scratch_dir(spark, "metrics-parquet"), scratch_dir(spark, "metrics-json")
    K.sink_metrics(hist(spark, sf).drop("created_at"), [lambda m: K.sink_parquet(m, a, ["run_id"], "append"), lambda m: K.sink_json_summary(m, b)])
    schema = "row_id bigint, run_id string, step int, metric string, value double"
    both = spark.read.schema(schema).parquet(a).withColumn("backend", F.lit("parquet")).unionByName(
        spark.read.schema(schema).json(b).withColumn("backend", F.lit("json"))
    )
    return both.groupBy("backend", "run_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("remote_copy_in", "SELECT event_id, value FROM events")
def _(spark, sf):
    # Spark reads file, hdfs and object-store addresses alike, so no copy is made and the address stays as given.
    return spark.read.schema("event_id bigint, value double").parquet(f"{sf}/events.parquet")


@query("latest_snapshot", views="hist", oracle="SELECT step // 50 AS global_step, row_id, value FROM hist WHERE step // 50 = (SELECT max(step // 50) FROM hist)")
def _(spark, sf):
    h = hist(spark, sf).select("row_id", "value", F.expr("cast(step div 50 as int)").alias("global_step"))
    path = K.sink_parquet(h, scratch_dir(spark, "snapshots"), ["global_step"])
    return S.read_latest_snapshot(spark, path)


@query("table_fingerprint_compare", """
SELECT 'same' AS pair, 'IDENTICAL' AS status, 0::BIGINT AS left_only, 0::BIGINT AS right_only
UNION ALL SELECT 'changed', 'DIFFERENT', count(*), count(*) FROM events WHERE event_type = 'click'
UNION ALL SELECT 'absent', 'MISSING', count(*), 0 FROM events
UNION ALL SELECT 'broken', 'ERROR', NULL, NULL""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    changed = e.withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1).otherwise(F.col("value")))
    pairs = {"same": (e, e.orderBy("value")), "changed": (e, changed), "absent": (e, None)}
    out = [S.compare_tables(a, b).withColumn("pair", F.lit(n)) for n, (a, b) in pairs.items()]
    broken = S.compare_reads(spark, lambda: e, lambda: spark.read.parquet(f"{sf}/no-such-table.parquet")).withColumn("pair", F.lit("broken"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(broken)


@query("table_fingerprint")
def _(spark, sf):
    return S.table_fingerprint(table(spark, sf, "events").drop("ts"))
