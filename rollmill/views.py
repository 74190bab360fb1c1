"""Derived views that bring the driver's tables into rollout, token, message and metric-log shape.

Each view exists twice: as a lazy DataFrame, and as the SQL text the oracle prepends as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.schemas import TABLES
from rollmill.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy rollouts: one sampled response per row."""
    k = F.get_json_object("props", "$.k").cast("int")
    marker = F.when(F.col("event_id") % 7 == 0, "").otherwise("#### ")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"),
        F.expr("user_id div 2").alias("question_idx"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("track"),
        F.dayofmonth("ts").alias("step"),
        F.col("event_type").alias("data_source"),
        k.alias("k"),
        (F.col("event_id") % 10).cast("int").alias("ground_truth"),
        "value",
        F.floor("value").cast("int").alias("response_length"),
        F.concat(
            F.lit("<think>step "),
            F.col("event_id").cast("string"),
            F.lit("\nwait</think> so the result is "),
            marker,
            (k % 10).cast("string"),
        ).alias("output"),
    )


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token arrays: values (or log-probabilities), one to three whole vectors long, and a terminal reward on every third row."""
    vals = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 1 + F.col("label") % 3))
    n = F.size(vals).cast("bigint")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"),
        "label",
        n.alias("n"),
        vals.alias("vals"),
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.when((i == n) & (F.col("vec_id") % 3 == 0), 1.0).otherwise(0.0),
        ).alias("rewards"),
    )


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric log in long form; the same (run, metric, step) occurs more than once."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("run_id"),
        (F.col("o_custkey") % 400).cast("int").alias("step"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("metric"),
        F.col("o_totalprice").alias("value"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.col("text").alias("question"),
        F.concat(
            F.lit("work "), F.col("text"), F.lit(" #### "),
            F.when(item % 5 == 0, "1,").otherwise(""), (100 + item).cast("string"),
        ).alias("answer"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs: every labelled good text against a rejected one of the same language."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    worst = (
        labelled.where("quality = 0").groupBy("lang")
        .agg(F.min_by(F.col("text"), F.col("doc_id")).alias("rejected"))
    )
    return (
        labelled.where("quality = 1").join(worst, "lang")
        .select("doc_id", F.col("source").alias("prompt"), F.col("text").alias("chosen"), "rejected")
    )


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts whose answers are written in the LaTeX forms the graders must tell apart."""
    e = spread(ev(spark, sf_dir), "sample_id")
    answer = F.col("k") % 10
    forms = [
        F.concat(F.lit("\\boxed{"), answer, F.lit("}")),
        F.concat(F.lit("first \\boxed{7} then \\boxed{\\frac{"), answer, F.lit("}{3}}.")),
        F.concat(F.lit("\\boxed{x="), answer, F.lit("\\%}")),
        F.concat(F.lit("value \\fbox{"), answer, F.lit("}")),
        F.concat(F.lit("\\boxed{\\dfrac"), answer, F.lit("3} cm")),
        F.concat(F.lit("nothing here, answer: "), answer),
        F.concat(F.lit("Answer: $"), answer, F.lit("$\nmore\nAnswer: "), answer, F.lit(" units")),
        F.concat(F.lit("open \\boxed{"), answer),
    ]
    truths = [
        F.col("ground_truth").cast("string"),
        F.concat(F.lit("\\frac"), F.col("ground_truth"), F.lit("3")),
    ]
    form = F.col("sample_id") % 8
    text = F.lit(None).cast("string")
    for i, f in reversed(list(enumerate(forms))):
        text = F.when(form == i, f).otherwise(text)
    return e.select(
        "sample_id", "question_idx", "track", "k", "step",
        F.concat(F.lit("<think>t</think> "), text).alias("response"),
        F.when(form.isin(1, 4), truths[1]).otherwise(truths[0]).alias("truth"),
    )


SQL = {
    "ev": """
SELECT event_id AS sample_id, user_id // 2 AS question_idx,
       CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS track,
       CAST(day(ts) AS INTEGER) AS step, event_type AS data_source,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(event_id % 10 AS INTEGER) AS ground_truth, value,
       CAST(floor(value) AS INTEGER) AS response_length,
       '<think>step ' || event_id || chr(10) || 'wait</think> so the result is '
         || CASE WHEN event_id % 7 = 0 THEN '' ELSE '#### ' END
         || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS output
FROM events""",
    "tok": """
SELECT vec_id AS uid, label, len(vals) AS n, vals,
       list_transform(range(1, len(vals) + 1),
         lambda i: CASE WHEN i = len(vals) AND vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rewards
FROM (SELECT *, flatten(list_transform(range(1 + label % 3), lambda _: embedding::DOUBLE[])) AS vals FROM embeddings)""",
    "hist": """
SELECT o_orderkey AS row_id, o_orderstatus AS run_id, CAST(o_custkey % 400 AS INTEGER) AS step,
       o_orderdate AS created_at, o_orderpriority AS metric, o_totalprice AS value
FROM orders""",
    "qa": """
SELECT item_id, text AS question,
       'work ' || text || ' #### ' || CASE WHEN item_id % 5 = 0 THEN '1,' ELSE '' END || (100 + item_id) AS answer
FROM benchmark""",
    "docs": """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "pref": """
SELECT d.doc_id, d.source AS prompt, d.text AS chosen, w.rejected
FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1
JOIN (SELECT d0.lang, arg_min(d0.text, d0.doc_id) AS rejected
      FROM documents d0 JOIN labels l0 ON d0.doc_id = l0.doc_id AND l0.quality = 0 GROUP BY d0.lang) w
  ON w.lang = d.lang""",
    "boxed": r"""
SELECT sample_id, question_idx, track, k, step,
       '<think>t</think> ' || CASE sample_id % 8
         WHEN 0 THEN '\boxed{' || (k % 10) || '}'
         WHEN 1 THEN 'first \boxed{7} then \boxed{\frac{' || (k % 10) || '}{3}}.'
         WHEN 2 THEN '\boxed{x=' || (k % 10) || '\%}'
         WHEN 3 THEN 'value \fbox{' || (k % 10) || '}'
         WHEN 4 THEN '\boxed{\dfrac' || (k % 10) || '3} cm'
         WHEN 5 THEN 'nothing here, answer: ' || (k % 10)
         WHEN 6 THEN 'Answer: $' || (k % 10) || '$' || chr(10) || 'more' || chr(10) || 'Answer: ' || (k % 10) || ' units'
         ELSE 'open \boxed{' || (k % 10) END AS response,
       CASE WHEN sample_id % 8 IN (1, 4) THEN '\frac' || ground_truth || '3' ELSE CAST(ground_truth AS VARCHAR) END AS truth
FROM ev""",
}

_NEEDS = {"boxed": ("ev",)}


def with_views(names: str, body: str) -> str:
    """Prepend the named views, and those they need, as CTEs; ``body`` may continue the list."""
    order: list[str] = []
    for name in names.split():
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in order:
                order.append(needed)
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in order)
    body = body.strip()
    return f"WITH {ctes}{body}" if body.startswith(",") else f"WITH {ctes}\n{body}"
