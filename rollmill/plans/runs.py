"""Queries of the run-log operators and the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.functions.answers import extract_hash_answer
from rollmill.functions.grading import grade_exact
from rollmill.operators import prep as P
from rollmill.operators import quality as Q
from rollmill.operators import runlog as R
from rollmill.plans.catalog import query
from rollmill.views import docs, ev, hist, qa, table, tok

KEYS = ["run_id", "metric", "step"]


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def last_values(spark, sf):
    return R.keep_last(hist(spark, sf), KEYS, ["created_at", "row_id"])


def _metric(df, name):
    return df.where(F.col("metric") == name).select("run_id", "step", "value")


DEDUP = """
, d AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY run_id, metric, step ORDER BY created_at DESC, row_id DESC) = 1)
"""


@query("replay_dedup_keep_last", views="hist", oracle=DEDUP + "SELECT row_id, run_id, metric, step, value FROM d")
def _(spark, sf):
    return last_values(spark, sf).select("row_id", *KEYS, "value")


@query("history_summary", views="hist", oracle="""
SELECT run_id, metric, count(*) AS rows, min(step) AS step_min, max(step) AS step_max, count(step) - count(DISTINCT step) AS duplicate_steps,
  (SELECT value FROM hist i WHERE i.run_id = h.run_id AND i.metric = h.metric ORDER BY step, created_at, row_id LIMIT 1) AS first, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(value) AS nonnull,
  (SELECT value FROM hist i WHERE i.run_id = h.run_id AND i.metric = h.metric ORDER BY step DESC, created_at DESC, row_id DESC LIMIT 1) AS last
FROM hist h GROUP BY run_id, metric""")
def _(spark, sf):
    return _round(R.history_summary(hist(spark, sf)), "mean")


@query("run_step_ranges", views="hist", oracle=DEDUP + "SELECT run_id, min(step) AS min, max(step) AS max, count(step) AS count FROM d WHERE metric = '5-LOW' GROUP BY run_id")
def _(spark, sf):
    return R.step_ranges(_metric(last_values(spark, sf), "5-LOW"))


@query("final_and_peak", views="hist", oracle=DEDUP + "SELECT run_id, metric, arg_max(value, step) AS final, max(value) AS peak FROM d GROUP BY ALL")
def _(spark, sf):
    return R.final_and_peak(last_values(spark, sf), ["run_id", "metric"])


@query("pass1_standard_error", views="ev", oracle=r"""
, g AS (SELECT track, avg(CASE WHEN replace(nullif(regexp_extract(output, '#### (-?[0-9.,]+)', 1), ''), ',', '') = ground_truth::VARCHAR THEN 1.0::DOUBLE ELSE 0 END) AS p, count(*) AS n FROM ev GROUP BY track)
SELECT track, round(p, 6) AS p, round(sqrt(p * (1 - p) / n), 9) AS se FROM g""")
def _(spark, sf):
    g = ev(spark, sf).groupBy("track").agg(
        F.avg(grade_exact(F.col("output"), F.col("ground_truth"))).alias("p"), F.count(F.lit(1)).alias("n")
    )
    return g.select("track", F.round("p", 6).alias("p"), F.round(R.standard_error(F.col("p"), F.col("n")), 9).alias("se"))


TOKENS = DEDUP + """
, t AS (SELECT run_id, step, value, sum(value * 512 / 1e6) OVER (PARTITION BY run_id ORDER BY step) AS tokens_m FROM d WHERE metric = '5-LOW')
"""


def _tokens(spark, sf):
    return R.cumulative_tokens(_metric(last_values(spark, sf), "5-LOW"), ["run_id"], 512)


@query("cumulative_tokens", views="hist", oracle=TOKENS + "SELECT run_id, step, value, round(tokens_m, 6) AS tokens_m FROM t")
def _(spark, sf):
    return _round(_tokens(spark, sf), "tokens_m")


@query("rolling_mean_centered", views="hist", oracle=DEDUP + """
SELECT run_id, step, round(avg(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS rolling FROM d WHERE metric = '1-URGENT'""")
def _(spark, sf):
    return _round(R.rolling_mean(_metric(last_values(spark, sf), "1-URGENT"), ["run_id"], "step", "value"), "rolling")


INTERP = TOKENS + """
, a AS (SELECT run_id, step, value AS acc FROM d WHERE metric = '1-URGENT'),
lo AS (SELECT a.run_id, a.step, a.acc, t.step AS s0, t.tokens_m AS y0 FROM a ASOF LEFT JOIN t ON a.run_id = t.run_id AND a.step >= t.step),
hi AS (SELECT lo.*, t.step AS s1, t.tokens_m AS y1 FROM lo ASOF LEFT JOIN t ON lo.run_id = t.run_id AND lo.step <= t.step),
x AS (SELECT run_id, step, acc, CASE WHEN s0 IS NULL THEN y1 WHEN s1 IS NULL OR s1 = s0 THEN y0 ELSE y0 + (step - s0)::DOUBLE / (s1 - s0) * (y1 - y0) END AS tokens_m FROM hi)
"""


@query("join_token_interp", views="hist", oracle=INTERP + "SELECT run_id, step::DOUBLE AS step, acc, round(tokens_m, 6) AS tokens_m FROM x")
def _(spark, sf):
    acc = _metric(last_values(spark, sf), "1-URGENT").withColumnRenamed("value", "acc")
    return _round(R.interpolate(_tokens(spark, sf), acc, ["run_id"], "step", "tokens_m", "tokens_m", steps=True), "tokens_m")


@query("tokens_to_threshold", views="hist", oracle=INTERP + """
, p AS (SELECT run_id, max(acc) AS peak, arg_max(acc, step) AS final FROM x GROUP BY run_id),
r AS (SELECT x.run_id, min(x.step) AS step, any_value(peak) AS peak, any_value(final) AS final FROM x JOIN p USING (run_id) WHERE acc >= 0.9::DOUBLE * peak GROUP BY x.run_id),
q AS (SELECT r.*, x.tokens_m AS ttt FROM r JOIN x ON r.run_id = x.run_id AND r.step = x.step),
b AS (SELECT p.run_id, 5000.0::DOUBLE AS bud FROM p),
bl AS (SELECT run_id, max(tokens_m) AS x0 FROM x WHERE tokens_m <= 5000 GROUP BY run_id),
bh AS (SELECT run_id, min(tokens_m) AS x1 FROM x WHERE tokens_m >= 5000 GROUP BY run_id),
bb AS (SELECT b.run_id, x0, x1, l.acc AS y0, h.acc AS y1 FROM b LEFT JOIN bl USING (run_id) LEFT JOIN bh USING (run_id) LEFT JOIN x l ON l.run_id = b.run_id AND l.tokens_m = x0 LEFT JOIN x h ON h.run_id = b.run_id AND h.tokens_m = x1),
ab AS (SELECT run_id, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (5000 - x0) / (x1 - x0) * (y1 - y0) END AS acc FROM bb)
SELECT run_id, step::DOUBLE AS step, peak, final, round(ttt, 6) AS tokens_to_threshold, round(100 * (1 - ttt / (SELECT ttt FROM q WHERE run_id = 'F')), 6) AS saving_percent,
  round(ab.acc, 4) AS accuracy_at_budget, round(100 * ab.acc / peak, 4) AS percent_of_peak FROM q JOIN ab USING (run_id)""")
def _(spark, sf):
    acc = _metric(last_values(spark, sf), "1-URGENT")
    out = R.tokens_to_threshold(acc, _tokens(spark, sf), "run_id", share=0.9, baseline="F", budget=5000.0)
    out = _round(out, "tokens_to_threshold", "saving_percent")
    return _round(out, "accuracy_at_budget", "percent_of_peak", digits=4)


GAPS = DEDUP + """
, g AS (SELECT a.metric, a.step, a.value AS value_a, b.value AS value_b, b.value - a.value AS gap FROM d a JOIN d b ON a.metric = b.metric AND a.step = b.step WHERE a.run_id = 'F' AND b.run_id = 'O')
"""


@query("join_common_steps", views="hist", oracle=GAPS + "SELECT metric, step, value_a, value_b, round(gap, 6) AS gap FROM g")
def _(spark, sf):
    return _round(R.common_steps(last_values(spark, sf), "run_id", "F", "O"), "gap")


@query("join_run_overlap", views="hist", oracle=GAPS + """
SELECT metric, count(*) AS shared_steps, round(avg(abs(gap)), 4) AS mean_abs_diff, round(max(abs(gap)), 4) AS max_abs_diff FROM g GROUP BY metric""")
def _(spark, sf):
    return _round(R.run_overlap(last_values(spark, sf), "run_id", "F", "O"), "mean_abs_diff", "max_abs_diff", digits=4)


@query("accuracy_gap_summary", views="hist", oracle=GAPS + """
SELECT metric, round(avg(gap), 4) AS mean_gap, round(max(gap), 4) AS max_gap, arg_max(step, gap) AS max_step, round(min(gap), 4) AS min_gap, arg_min(step, gap) AS min_step FROM g GROUP BY metric""")
def _(spark, sf):
    gaps = R.common_steps(last_values(spark, sf), "run_id", "F", "O")
    return _round(R.gap_summary(gaps, ["metric"]), "mean_gap", "max_gap", "min_gap", digits=4)


@query("timing_compare_ratio", views="hist", oracle="""
, m AS (SELECT metric, avg(value) FILTER (run_id = 'F') AS a, avg(value) FILTER (run_id = 'O') AS b FROM hist GROUP BY metric)
SELECT metric, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(CASE WHEN b > 0 THEN a / b END, 6) AS ratio FROM m""")
def _(spark, sf):
    out = _round(R.timing_ratio(hist(spark, sf), "run_id", "F", "O"), "mean_a", "mean_b", digits=4)
    return _round(out, "ratio")


@query("run_summary_table", views="hist", oracle=DEDUP + """
SELECT run_id, max(step) AS total_steps, arg_max(value, step) FILTER (metric = '1-URGENT') AS final_accuracy, max(value) FILTER (metric = '1-URGENT') AS best_accuracy,
  arg_max(value, step) FILTER (metric = '5-LOW') AS final_length, max(value) FILTER (metric = '5-LOW') AS max_length, arg_max(value, step) FILTER (metric = '2-HIGH') AS final_clip_ratio,
  round(avg(value) FILTER (metric = '3-MEDIUM'), 6) AS mean_step_time, max(value) FILTER (metric = '4-NOT SPECIFIED') AS peak_memory FROM d GROUP BY run_id""")
def _(spark, sf):
    roles = {"accuracy": "1-URGENT", "length": "5-LOW", "clip": "2-HIGH", "time": "3-MEDIUM", "memory": "4-NOT SPECIFIED"}
    return _round(R.run_summary_table(last_values(spark, sf), "run_id", roles), "mean_step_time")


@query("select_run_most_steps", views="hist", oracle="""
, s AS (SELECT metric AS name, run_id, count(DISTINCT step) AS steps FROM hist GROUP BY ALL)
SELECT name, run_id, steps FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY steps DESC, run_id) = 1""")
def _(spark, sf):
    return R.select_run_most_steps(hist(spark, sf).withColumnRenamed("metric", "name"), "name", "run_id")


@query("metric_key_resolve", views="hist", oracle="""
, c AS (SELECT run_id, metric, count(value) AS n FROM hist WHERE contains(metric, '-') AND NOT contains(metric, 'HIGH') AND value IS NOT NULL GROUP BY ALL)
SELECT run_id, metric, n FROM c QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY len(metric), metric) = 1""")
def _(spark, sf):
    return R.resolve_metric(hist(spark, sf), "run_id", contains="-", exclude=("HIGH",))


@query("reduce_metrics", views="hist", oracle="SELECT run_id, metric, round(avg(value), 4) AS mean FROM hist GROUP BY ALL")
def _(spark, sf):
    return hist(spark, sf).groupBy("run_id", "metric").agg(F.round(F.avg("value"), 4).alias("mean"))


@query("best_metric_gate", views="hist", oracle="SELECT max(value) AS best FROM hist WHERE metric = '1-URGENT'")
def _(spark, sf):
    return Q.best_metric_gate(hist(spark, sf), F.when(F.col("metric") == "1-URGENT", F.col("value")), 0.2)


# Data-quality checks.


@query("check_batch_consistency", views="tok", oracle="SELECT count(*) AS rows, count(*) FILTER (len(vals) <> len(rewards)) AS violations FROM tok")
def _(spark, sf):
    return Q.check_batch_consistency(tok(spark, sf), ["vals", "rewards"])


@query("check_alignment_1to1", """
SELECT (SELECT count(*) FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)) AS aligned, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_only,
 (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS right_only, 0::BIGINT AS repeated""")
def _(spark, sf):
    return Q.check_alignment(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("check_answer_present", views="ev qa", oracle="""
SELECT 'ev' AS source, count(*) AS rows, count(*) FILTER (NOT regexp_matches(output, '#### -?[0-9.,]')) AS violations FROM ev
UNION ALL SELECT 'qa', count(*), count(*) FILTER (NOT regexp_matches(answer, '#### -?[0-9.,]')) FROM qa""")
def _(spark, sf):
    missing = lambda df, c: Q.check_condition(df, extract_hash_answer(F.col(c)).isNull())
    a = missing(ev(spark, sf), "output").select(F.lit("ev").alias("source"), "rows", "violations")
    return a.unionByName(missing(qa(spark, sf), "answer").select(F.lit("qa").alias("source"), "rows", "violations"))


@query("check_reward_binary", views="ev", oracle="""
SELECT count(*) AS rows, count(*) FILTER (v NOT IN (0, 1)) AS violations FROM (SELECT CASE WHEN k % 9 = 0 THEN 0.5 WHEN k % 10 = ground_truth THEN 1 ELSE 0 END AS v FROM ev)""")
def _(spark, sf):
    v = F.when(F.col("k") % 9 == 0, 0.5).when(F.col("k") % 10 == F.col("ground_truth"), 1.0).otherwise(0.0)
    return Q.check_condition(ev(spark, sf), ~v.isin(0.0, 1.0))


@query("check_expected_samples", views="ev", oracle="SELECT track, question_idx, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) <> 64")
def _(spark, sf):
    return Q.check_expected_samples(ev(spark, sf), ["track", "question_idx"], 64)


@query("check_pad_pool_no_digits", """
SELECT count(*) AS rows, 0::BIGINT AS violations FROM documents""")
def _(spark, sf):
    pads = table(spark, sf, "documents").select(P.pick_pad(F.col("doc_id"), P.TRIVIA + P.GIBBERISH, 42).alias("pad"))
    return Q.check_condition(pads, F.col("pad").rlike("[0-9]"))


@query("check_extra_info_lengths", views="docs", oracle="""
SELECT u.column, CASE u.column WHEN 'quality' THEN q WHEN 'toxic' THEN t ELSE c END AS present, n AS rows, (CASE u.column WHEN 'quality' THEN q WHEN 'toxic' THEN t ELSE c END) IN (0, n) AS consistent
FROM (SELECT count(quality) AS q, count(toxic) AS t, count(source) AS c, count(*) AS n FROM docs), (SELECT unnest(['quality', 'toxic', 'source']) AS "column") u""")
def _(spark, sf):
    return Q.check_null_counts(docs(spark, sf), ["quality", "toxic", "source"])
