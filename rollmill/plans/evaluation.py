"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.functions import answers as A
from rollmill.functions import text as X
from rollmill.functions.grading import grade_exact
from rollmill.functions.tokens import ones_like
from rollmill.operators import diversity as D
from rollmill.operators import evaluation as E
from rollmill.operators import quality as Q
from rollmill.operators import resample as RS
from rollmill.operators.batch import sample_first_n
from rollmill.operators.keyed import positions
from rollmill.plans.catalog import query
from rollmill.session import spread
from rollmill.views import docs, ev, table, tok

GROUP = ["track", "question_idx"]

GRADED = r"""
, s AS (SELECT *, strpos(output, '####') AS mark, nullif(regexp_extract(output, '#### (-?[0-9.,]+)', 1), '') AS ans FROM ev),
g AS (SELECT *, CASE WHEN replace(ans, ',', '') = CAST(ground_truth AS VARCHAR) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s)
"""


def graded(spark, sf):
    e = ev(spark, sf)
    return e.withColumn("score", grade_exact(F.col("output"), F.col("ground_truth")))


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _problems(spark, sf, *extra):
    parseable = A.extract_hash_answer(F.col("output")).isNotNull()
    return E.per_problem(graded(spark, sf), [*extra, *GROUP], "score", parseable)


PROBLEMS = GRADED + """
, p AS (SELECT track, question_idx, count(*) AS n, count(*) FILTER (score = 1) AS c,
               count(*) FILTER (score = 0 AND ans IS NULL) AS f FROM g GROUP BY ALL)
"""


@query("agg_per_problem", views="ev", oracle=PROBLEMS + """
SELECT track, question_idx, n AS n_samples, c AS n_correct, round(c / n, 6) AS accuracy FROM p""")
def _(spark, sf):
    return _round(_problems(spark, sf).drop("n_extract_failures"), "accuracy")


@query("agg_extract_failures", views="ev", oracle=PROBLEMS + """
SELECT track, CAST(sum(f) AS BIGINT) AS n_extract_failures, CAST(sum(n) AS BIGINT) AS n_samples FROM p GROUP BY track""")
def _(spark, sf):
    return _problems(spark, sf).groupBy("track").agg(
        F.sum("n_extract_failures").alias("n_extract_failures"), F.sum("n_samples").alias("n_samples")
    )


PASSK = PROBLEMS + """
, x AS (SELECT track, CAST(unnest([1, 2, 4, 8, 16, 32]) AS INTEGER) AS k, n, c FROM p),
v AS (SELECT track, k, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
        ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k::DOUBLE / i)) END AS v FROM x WHERE k <= n)
"""


@query("pass_at_k", views="ev", oracle=PASSK + """
SELECT track, k, round(avg(v), 6) AS pass_at_k, count(*) AS n_problems FROM v GROUP BY ALL""")
def _(spark, sf):
    return _round(E.pass_at_k(_problems(spark, sf), ["track"]), "pass_at_k")


@query("pass_at_k_pivot", views="ev", oracle=PASSK + """
, t AS (SELECT track, k, round(avg(v) * 100, 2) AS p FROM v GROUP BY ALL)
SELECT track, max(p) FILTER (k = 1) AS "1", max(p) FILTER (k = 2) AS "2", max(p) FILTER (k = 4) AS "4",
       max(p) FILTER (k = 8) AS "8", max(p) FILTER (k = 16) AS "16", max(p) FILTER (k = 32) AS "32" FROM t GROUP BY track""")
def _(spark, sf):
    table_ = E.pass_at_k(_problems(spark, sf), ["track"]).withColumn("p", F.round(F.col("pass_at_k") * 100, 2))
    return table_.groupBy("track").pivot("k", list(E.KS)).agg(F.max("p"))


@query("pass_at_k_gap", views="ev", oracle=PASSK + """
, t AS (SELECT track, avg(v) * 100 AS p FROM v WHERE k = 32 GROUP BY ALL)
SELECT round(max(p) FILTER (track = 'B') - max(p) FILTER (track = 'A'), 4) AS gap_b_minus_a FROM t""")
def _(spark, sf):
    t = E.pass_at_k(_problems(spark, sf), ["track"], [32])
    side = lambda x: F.max(F.when(F.col("track") == x, F.col("pass_at_k") * 100))
    return t.agg(F.round(side("B") - side("A"), 4).alias("gap_b_minus_a"))


@query("pass_at_k_monotone_check", views="ev", oracle=PASSK + """
, t AS (SELECT track, k, avg(v) AS p FROM v GROUP BY ALL),
d AS (SELECT track, p - lag(p) OVER (PARTITION BY track ORDER BY k) AS d FROM t)
SELECT track, bool_and(coalesce(d >= -1e-9, true)) AS monotone FROM d GROUP BY track""")
def _(spark, sf):
    return Q.check_pass_at_k_monotone(E.pass_at_k(_problems(spark, sf), ["track"]), ["track"])


QUESTION = GRADED + """
, q AS (SELECT track, step, question_idx, max(score) AS correct, avg(response_length) AS mean_length,
          max(CAST(mark > 0 AS INTEGER)) AS has_marker, count(*) AS n FROM g GROUP BY track, step, question_idx)
"""


def question_level(spark, sf):
    g = graded(spark, sf)
    return g.groupBy("track", "step", "question_idx").agg(
        F.max("score").alias("correct"), F.avg("response_length").alias("mean_length"),
        F.max(F.col("output").contains("####").cast("int")).alias("has_marker"), F.count(F.lit(1)).alias("n"),
    )


@query("agg_question_level", views="ev", oracle=QUESTION + "SELECT track, step, question_idx, correct, round(mean_length, 6) AS mean_length, has_marker, n FROM q")
def _(spark, sf):
    return _round(question_level(spark, sf), "mean_length")


@query("agg_accuracy_by_track_step", views="ev", oracle=QUESTION + """
SELECT step, round(avg(correct) FILTER (track = 'A'), 6) AS A, round(avg(correct) FILTER (track = 'B'), 6) AS B FROM q GROUP BY step""")
def _(spark, sf):
    return question_level(spark, sf).groupBy("step").pivot("track", ["A", "B"]).agg(F.round(F.avg("correct"), 6))


@query("agg_adoption", views="ev", oracle=QUESTION + "SELECT track, step, round(avg(has_marker), 6) AS adoption FROM q GROUP BY ALL")
def _(spark, sf):
    return question_level(spark, sf).groupBy("track", "step").agg(F.round(F.avg("has_marker"), 6).alias("adoption"))


@query("agg_efficiency", views="ev", oracle=QUESTION + """
SELECT track, step, round(avg(correct), 6) AS accuracy, round(avg(mean_length), 6) AS mean_length FROM q GROUP BY ALL""")
def _(spark, sf):
    return question_level(spark, sf).groupBy("track", "step").agg(
        F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("mean_length"), 6).alias("mean_length")
    )


@query("agg_answer_position", views="ev", oracle=GRADED + """
SELECT track, step, round(avg(mark - 1), 6) AS mean_offset, count(*) AS n FROM g WHERE score = 1 AND mark > 0 GROUP BY ALL""")
def _(spark, sf):
    g = graded(spark, sf).withColumn("offset", X.marker_offset(F.col("output")))
    return g.where("score = 1 and offset is not null").groupBy("track", "step").agg(
        F.round(F.avg("offset"), 6).alias("mean_offset"), F.count(F.lit(1)).alias("n")
    )


META = """
, m AS (SELECT doc_id AS question_idx, 'Level ' || (doc_id % 5 + 1) AS level, lang AS subject FROM documents),
j AS (SELECT g.*, m.level, m.subject FROM g JOIN m USING (question_idx))
"""


def with_metadata(spark, sf):
    """Attach level and subject by question key; Spark broadcasts the side whose size allows it."""
    meta = table(spark, sf, "documents").select(
        F.col("doc_id").alias("question_idx"),
        F.concat(F.lit("Level "), (F.col("doc_id") % 5 + 1).cast("string")).alias("level"), F.col("lang").alias("subject"),
    )
    return graded(spark, sf).join(meta, "question_idx")


@query("join_metadata", views="ev", oracle=GRADED + META + "SELECT sample_id, question_idx, level, subject FROM j")
def _(spark, sf):
    return with_metadata(spark, sf).select("sample_id", "question_idx", "level", "subject")


def _by(spark, sf, key):
    side = lambda t: F.avg(F.when(F.col("track") == t, F.col("score")))
    return with_metadata(spark, sf).groupBy(key).agg(
        F.round(side("A"), 6).alias("acc_a"), F.round(side("B"), 6).alias("acc_b"),
        F.round(side("B") - side("A"), 6).alias("delta"), F.count_distinct("question_idx").alias("n"),
    ).orderBy(key)


BY = """
SELECT {k}, round(avg(score) FILTER (track = 'A'), 6) AS acc_a, round(avg(score) FILTER (track = 'B'), 6) AS acc_b,
       round(avg(score) FILTER (track = 'B') - avg(score) FILTER (track = 'A'), 6) AS delta, count(DISTINCT question_idx) AS n
FROM j GROUP BY {k}"""


@query("agg_by_level", views="ev", oracle=GRADED + META + BY.format(k="level"))
def _(spark, sf):
    return _by(spark, sf, "level")


@query("agg_by_subject", views="ev", oracle=GRADED + META + BY.format(k="subject"))
def _(spark, sf):
    return _by(spark, sf, "subject")


PAIR = GRADED + """
, f AS (SELECT question_idx, track, arg_min(score, sample_id) AS first, arg_min(mark, sample_id) AS mark FROM g GROUP BY ALL),
w AS (SELECT a.question_idx, a.first AS fa, b.first AS fb, a.mark AS ma, b.mark AS mb FROM f a JOIN f b USING (question_idx) WHERE a.track = 'A' AND b.track = 'B')
"""


def first_samples(spark, sf):
    """First-sample result of both tracks per question."""
    g = graded(spark, sf).withColumn("marked", F.col("output").contains("####"))
    f = g.groupBy("question_idx", "track").agg(
        F.min_by("score", "sample_id").alias("first"), F.min_by("marked", "sample_id").alias("marked")
    )
    a = f.where("track = 'A'").select("question_idx", (F.col("first") == 1).alias("a"), F.col("marked").alias("ma"))
    b = f.where("track = 'B'").select("question_idx", (F.col("first") == 1).alias("b"), F.col("marked").alias("mb"))
    return a.join(b, "question_idx")


@query("agg_confusion_2x2", views="ev", oracle=PAIR + """
SELECT count(*) FILTER (fa = 1 AND fb = 1) AS both_right, count(*) FILTER (fa = 0 AND fb = 0) AS both_wrong,
       count(*) FILTER (fa = 1 AND fb = 0) AS a_only, count(*) FILTER (fa = 0 AND fb = 1) AS b_only FROM w""")
def _(spark, sf):
    a, b = F.col("a"), F.col("b")
    return first_samples(spark, sf).agg(
        F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"),
        F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"),
    )


@query("agg_extract_fail_overlap", views="ev", oracle=PAIR + """
, m AS (SELECT doc_id AS question_idx, 'Level ' || (doc_id % 5 + 1) AS level FROM documents)
SELECT level, count(*) FILTER (ma = 0 AND mb = 0) AS both_fail, count(*) FILTER (ma = 0 AND mb > 0) AS a_fails,
       count(*) FILTER (ma > 0 AND mb = 0) AS b_fails, count(*) FILTER (ma > 0 AND mb > 0) AS neither_fails,
       round(count(*) FILTER (ma = 0) / count(*), 6) AS rate_a, round(count(*) FILTER (mb = 0) / count(*), 6) AS rate_b
FROM w JOIN m USING (question_idx) GROUP BY level""")
def _(spark, sf):
    level = F.concat(F.lit("Level "), (F.col("doc_id") % 5 + 1).cast("string")).alias("level")
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("question_idx"), level)
    a, b = ~F.col("ma"), ~F.col("mb")
    return first_samples(spark, sf).join(meta, "question_idx").groupBy("level").agg(
        F.count_if(a & b).alias("both_fail"), F.count_if(a & ~b).alias("a_fails"),
        F.count_if(~a & b).alias("b_fails"), F.count_if(~a & ~b).alias("neither_fails"),
        F.round(F.avg(a.cast("double")), 6).alias("rate_a"), F.round(F.avg(b.cast("double")), 6).alias("rate_b"),
    )


@query("agg_flip_examples", views="ev", oracle=PAIR + """
SELECT CASE WHEN fa = 0 AND fb = 1 THEN 'gained' WHEN fa = 1 AND fb = 0 THEN 'lost' WHEN fa = 0 THEN 'both wrong' ELSE 'both right' END AS flip,
       count(*) AS n, min(question_idx) AS example FROM w GROUP BY 1""")
def _(spark, sf):
    a, b = F.col("a"), F.col("b")
    flip = F.when(~a & b, "gained").when(a & ~b, "lost").when(~a, "both wrong").otherwise("both right")
    return first_samples(spark, sf).groupBy(flip.alias("flip")).agg(
        F.count(F.lit(1)).alias("n"), F.min("question_idx").alias("example")
    )


@query("pairwise_overlap_distinct", views="ev", oracle=GRADED + """
, q AS (SELECT question_idx, bool_or(score = 1 AND track = 'A') AS a, bool_or(score = 1 AND track = 'B') AS b FROM g GROUP BY question_idx)
SELECT count(*) FILTER (a) AS solved_a, count(*) FILTER (b) AS solved_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either FROM q""")
def _(spark, sf):
    hit = lambda t: F.bool_or((F.col("score") == 1) & (F.col("track") == t))
    q = graded(spark, sf).groupBy("question_idx").agg(hit("A").alias("a"), hit("B").alias("b"))
    a, b = F.col("a"), F.col("b")
    return q.agg(F.count_if(a).alias("solved_a"), F.count_if(b).alias("solved_b"), F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"))


HEAD = GRADED + """
, q AS (SELECT track, question_idx AS problem_idx, avg(score) AS accuracy, avg(response_length) AS mean_length FROM g GROUP BY ALL),
h AS (SELECT a.problem_idx, a.accuracy AS accuracy_a, b.accuracy AS accuracy_b, b.accuracy - a.accuracy AS delta,
        a.mean_length AS length_a, b.mean_length AS length_b
      FROM q a JOIN q b USING (problem_idx) WHERE a.track = 'A' AND b.track = 'B')
"""


def head_to_head(spark, sf):
    q = graded(spark, sf).groupBy("track", F.col("question_idx").alias("problem_idx")).agg(
        F.avg("score").alias("accuracy"), F.avg("response_length").alias("mean_length")
    )
    side = lambda t, s: q.where(F.col("track") == t).select(
        "problem_idx", F.col("accuracy").alias(f"accuracy_{s}"), F.col("mean_length").alias(f"length_{s}")
    )
    return side("A", "a").join(side("B", "b"), "problem_idx").withColumn("delta", F.col("accuracy_b") - F.col("accuracy_a"))


@query("join_head_to_head", views="ev", oracle=HEAD + """
SELECT problem_idx, round(accuracy_a, 6) AS accuracy_a, round(accuracy_b, 6) AS accuracy_b, round(delta, 6) AS delta FROM h""")
def _(spark, sf):
    return _round(head_to_head(spark, sf).drop("length_a", "length_b"), "accuracy_a", "accuracy_b", "delta")


@query("topk_smallest_largest_delta", views="ev", oracle=HEAD + """
(SELECT 'smallest' AS side, problem_idx, round(delta, 6) AS delta FROM h ORDER BY round(delta, 9), problem_idx LIMIT 3)
UNION ALL (SELECT 'largest', problem_idx, round(delta, 6) FROM h ORDER BY round(delta, 9) DESC, problem_idx LIMIT 3)""")
def _(spark, sf):
    h = head_to_head(spark, sf)
    d = F.round("delta", 9)
    small = h.orderBy(d, "problem_idx").limit(3).select(F.lit("smallest").alias("side"), "problem_idx", F.round("delta", 6).alias("delta"))
    large = h.orderBy(d.desc(), "problem_idx").limit(3).select(F.lit("largest").alias("side"), "problem_idx", F.round("delta", 6).alias("delta"))
    return small.unionByName(large)


@query("topk_shorter_when_both_right", views="ev", oracle=HEAD + """
SELECT problem_idx, round(length_a - length_b, 6) AS saving FROM h WHERE accuracy_a > 0 AND accuracy_b > 0
ORDER BY round(length_a - length_b, 9) DESC, problem_idx LIMIT 10""")
def _(spark, sf):
    h = head_to_head(spark, sf).where("accuracy_a > 0 and accuracy_b > 0").withColumn("saving", F.col("length_a") - F.col("length_b"))
    return h.orderBy(F.round("saving", 9).desc(), "problem_idx").limit(10).select("problem_idx", F.round("saving", 6).alias("saving"))


@query("eval_mean_by_source", views="ev", oracle=GRADED + """
, r AS (SELECT data_source, question_idx, avg(score) AS s FROM g GROUP BY ALL)
SELECT data_source, round(avg(s), 6) AS mean_score, count(*) AS n_prompts FROM r GROUP BY data_source""")
def _(spark, sf):
    rows = graded(spark, sf).groupBy("data_source", "question_idx").agg(F.avg("score").alias("s"))
    return rows.groupBy("data_source").agg(F.round(F.avg("s"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n_prompts"))


DIFF = GRADED + """
, d AS (SELECT *, CASE WHEN (k % 17) / 16.0 > 10 / 16.0 THEN 'easy' WHEN k % 17 = 0 THEN 'hard' ELSE 'medium' END AS difficulty FROM g)
"""


def with_difficulty(spark, sf):
    return graded(spark, sf).withColumn("difficulty", E.difficulty_bucket((F.col("k") % 17) / 16.0))


@query("difficulty_bucket", views="ev", oracle=DIFF + "SELECT sample_id, difficulty FROM d")
def _(spark, sf):
    return with_difficulty(spark, sf).select("sample_id", "difficulty")


@query("val_metrics_by_source_difficulty", views="ev", oracle=DIFF + """
SELECT data_source, difficulty, CAST(grouping(difficulty) AS INTEGER) AS overall, round(avg(score), 6) AS reward, round(avg(response_length), 6) AS length,
  round(coalesce(avg(response_length) FILTER (score = 0), -1), 6) AS length_wrong,
  round(coalesce(avg(response_length) FILTER (score = 1), -1), 6) AS length_right, count(*) AS n
FROM d GROUP BY GROUPING SETS ((data_source), (data_source, difficulty))""")
def _(spark, sf):
    out = E.by_source_and_difficulty(with_difficulty(spark, sf), "data_source", "difficulty", "score", "response_length")
    return _round(out, "reward", "length", "length_wrong", "length_right")


@query("difficulty_metrics", views="ev", oracle=DIFF + """
, v AS (SELECT *, len(list_filter(string_split(output, chr(10)), lambda l: contains(lower(l), 'wait') OR contains(lower(l), 'approximation')
          OR starts_with(l, 'Alternatively') OR starts_with(l, 'Is there another way') OR starts_with(l, 'But let me double') OR starts_with(l, 'But hold on'))) AS steps,
        CASE WHEN k % 5 = 0 THEN 0 ELSE value END AS adv FROM d)
SELECT difficulty, round(avg(score), 6) AS reward, round(coalesce(avg(response_length) FILTER (score = 0), -1), 6) AS length_wrong,
  round(coalesce(avg(response_length) FILTER (score = 1), -1), 6) AS length_right, round(avg(response_length), 6) AS length,
  round(coalesce(avg(steps) FILTER (score = 0), -1), 6) AS verification_wrong, round(coalesce(avg(steps) FILTER (score = 1), -1), 6) AS verification_right,
  round(avg(steps), 6) AS verification, round(avg(CASE WHEN adv = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_advantage_ratio
FROM v GROUP BY difficulty""")
def _(spark, sf):
    d = with_difficulty(spark, sf).withColumn("steps", X.count_verification_steps(F.col("output")))
    d = d.withColumn("adv", F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("value")))
    out = E.difficulty_metrics(d, "difficulty", "score", "response_length", "steps", "adv")
    return _round(out, *[c for c in out.columns if c != "difficulty"])


@query("val_metrics_best_worst_maj", views="ev", oracle=GRADED + """
, l AS (SELECT data_source, question_idx, 'score' AS var, score AS x FROM g UNION ALL SELECT data_source, question_idx, 'value', value FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY data_source, question_idx, var ORDER BY x) AS i, count(*) OVER (PARTITION BY data_source, question_idx, var) AS m FROM l),
ns AS (SELECT *, unnest(list_concat(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536]::BIGINT[], lambda p: p < m), [m])) AS n FROM o),
w AS (SELECT *, pow(i / m, n) - pow((i - 1) / m, n) AS b, pow(1 - (i - 1) / m, n) - pow(1 - i / m, n) AS c FROM ns),
p AS (SELECT data_source, question_idx, var, n, sum(x * b) AS best_mean, sqrt(greatest(sum(x * x * b) - sum(x * b) ** 2, 0)) AS best_std,
        sum(x * c) AS worst_mean, sqrt(greatest(sum(x * x * c) - sum(x * c) ** 2, 0)) AS worst_std FROM w GROUP BY ALL)
SELECT data_source, var, n, round(avg(best_mean), 5) AS best_mean, round(avg(best_std), 5) AS best_std,
       round(avg(worst_mean), 5) AS worst_mean, round(avg(worst_std), 5) AS worst_std, count(*) AS prompts FROM p GROUP BY ALL""")
def _(spark, sf):
    keys = ["data_source", "question_idx"]
    long = graded(spark, sf).select(*keys, "score", "value").unpivot(keys, ["score", "value"], "var", "x")
    out = E.best_worst_of_n(long, [*keys, "var"], "x")
    names = ["best_mean", "best_std", "worst_mean", "worst_std"]
    return out.groupBy("data_source", "var", "n").agg(
        *[F.round(F.avg(c), 5).alias(c) for c in names], F.count(F.lit(1)).alias("prompts")
    )


@query("val_metrics_mean_std", views="ev", oracle=GRADED + """
, p AS (SELECT data_source, question_idx, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM g GROUP BY ALL)
SELECT data_source, n, round(avg(m), 6) AS mean, round(avg(s), 6) AS std FROM p GROUP BY ALL""")
def _(spark, sf):
    p = graded(spark, sf).groupBy("data_source", "question_idx").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return p.groupBy("data_source", "n").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("s"), 6).alias("std"))


@query("majority_vote", views="ev", oracle=GRADED + """
, v AS (SELECT track, question_idx, ans, count(*) AS n, min(sample_id) AS f, arg_min(score, sample_id) AS val FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY track, question_idx ORDER BY n DESC, f) AS rn FROM v)
SELECT track, question_idx, ans AS maj_vote, val AS maj_value, n AS n_votes FROM r WHERE rn = 1""")
def _(spark, sf):
    g = graded(spark, sf).withColumn("pred", A.extract_hash_answer(F.col("output")))
    return E.majority_vote(g, GROUP, "pred", "score", "sample_id")


DRAWS = GRADED + """
, o AS (SELECT track, question_idx, score, value, ans, row_number() OVER (PARTITION BY track, question_idx ORDER BY sample_id) - 1 AS pos FROM g),
c AS (SELECT track, question_idx, count(*) AS m FROM g GROUP BY ALL),
d AS (SELECT track, question_idx, round, draw,
   (('0x' || substr(md5('42:' || track || ':' || question_idx || ':' || round || ':' || draw), 1, 8))::BIGINT % 2147483647) % m AS pos
   FROM c, range(200) r(round), range(4) s(draw)),
b AS (SELECT * FROM d JOIN o USING (track, question_idx, pos))
"""


def _draws(spark, sf):
    g = graded(spark, sf).withColumn("pred", A.extract_hash_answer(F.col("output")))
    return E.bootstrap_draws(g, GROUP, "sample_id", ["score", "value", "pred"], size=4, rounds=200, seed=42)


@query("bootstrap_metric", views="ev", oracle=DRAWS + """
, r AS (SELECT track, question_idx, round, max(value) AS v FROM b GROUP BY ALL)
SELECT track, question_idx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM r GROUP BY ALL""")
def _(spark, sf):
    return _round(E.bootstrap_metric(_draws(spark, sf), GROUP, F.max("value")), "mean", "std")


@query("bootstrap_majority", views="ev", oracle=DRAWS + """
, v AS (SELECT track, question_idx, round, ans, count(*) AS n, min(draw) AS f, arg_min(score, draw) AS val FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY track, question_idx, round ORDER BY n DESC, f) AS rn FROM v)
SELECT track, question_idx, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std FROM r WHERE rn = 1 GROUP BY ALL""")
def _(spark, sf):
    return _round(E.bootstrap_majority(_draws(spark, sf), GROUP, "pred", "score"), "mean", "std")


@query("val_metrics_majority", views="")
def _(spark, sf):
    """Best, worst and majority of N by 1,000 resamples for every N, with the plain mean and deviation, by source."""
    g = graded(spark, sf).withColumn("pred", A.extract_hash_answer(F.col("output")))
    keys = ["data_source", "question_idx"]
    each = RS.bootstrap_by_weights(g, keys, "score", vote="pred", names=("best", "worst", "mean", "maj"))
    names = [c for c in each.columns if c not in (*keys, "n", "rounds")]
    return each.groupBy("data_source", "n").agg(*[F.round(F.avg(c), 6).alias(c) for c in names], F.max("rounds").alias("rounds"), F.count(F.lit(1)).alias("prompts"))


@query("bootstrap_every_n", views="")
def _(spark, sf):
    """Best and worst of N of a continuous score, for every N, by 1,000 resamples."""
    return _round(RS.bootstrap_by_weights(ev(spark, sf), GROUP, "value"), "best_mean", "best_std", "worst_mean", "worst_std")


@query("data_metrics", views="tok", oracle="""
, t AS (SELECT uid, n, rewards[i] AS r, vals[i] AS v, vals[n - i + 1] AS a, vals[i] / 2 + rewards[i] AS ret FROM tok, unnest(range(1, n + 1)) u(i)),
k AS (SELECT avg(a) AS advantages_mean, max(a) AS advantages_max, min(a) AS advantages_min, avg(ret) AS returns_mean, max(ret) AS returns_max, min(ret) AS returns_min,
   avg(v) AS values_mean, max(v) AS values_max, min(v) AS values_min, 1 - var_samp(ret - v) / (var_samp(ret) + 1e-5) AS explained_var FROM t),
s AS (SELECT uid, n, list_sum(rewards) AS score, list_sum(rewards) - list_sum(vals) / 10 AS reward, 5 + uid % 7 AS p FROM tok)
SELECT round(avg(score), 6) AS score_mean, max(score) AS score_max, min(score) AS score_min,
  round(avg(reward), 6) AS reward_mean, round(max(reward), 6) AS reward_max, round(min(reward), 6) AS reward_min,
  round(avg(p), 6) AS prompt_length_mean, max(p) AS prompt_length_max, min(p) AS prompt_length_min, round(avg(CASE WHEN p = 11 THEN 1.0::DOUBLE ELSE 0 END), 6) AS prompt_clip_ratio, round(avg(n), 6) AS length_mean, max(n) AS length_max, min(n) AS length_min,
  round(avg(CASE WHEN n = 192 THEN 1.0::DOUBLE ELSE 0 END), 6) AS clip_ratio, round(avg(score) FILTER (n <= 64), 6) AS score_upto_64, round(avg(score) FILTER (n <= 128), 6) AS score_upto_128,
  round(any_value(advantages_mean), 6) AS advantages_mean, round(any_value(advantages_max), 6) AS advantages_max, round(any_value(advantages_min), 6) AS advantages_min,
  round(any_value(returns_mean), 6) AS returns_mean, round(any_value(returns_max), 6) AS returns_max, round(any_value(returns_min), 6) AS returns_min,
  round(any_value(values_mean), 6) AS values_mean, round(any_value(values_max), 6) AS values_max, round(any_value(values_min), 6) AS values_min,
  round(any_value(explained_var), 6) AS explained_var FROM s, k""")
def _(spark, sf):
    t = tok(spark, sf).select(
        "uid", "n", "rewards", F.reverse("vals").alias("advantages"), F.col("vals").alias("values"),
        F.zip_with("rewards", "vals", lambda r, v: r - v / 10).alias("token_rewards"), (5 + F.col("uid") % 7).alias("prompt_length"),
        F.zip_with("vals", "rewards", lambda v, r: v / 2 + r).alias("returns"), ones_like(F.col("vals")).alias("mask"),
    )
    out = E.data_metrics(
        t, scores="rewards", rewards="token_rewards", advantages="advantages", returns="returns", values="values", mask="mask",
        length="n", max_length=192, prompt_length="prompt_length", max_prompt_length=11, length_limits=(64, 128),
    )
    whole = [f"{c}_{s}" for c in ("score", "length", "prompt_length") for s in ("max", "min")]
    return _round(out, *[c for c in out.columns if c not in whole])


@query("length_by_reward_level", views="ev", oracle="""
, l AS (SELECT CAST(unnest(range(17)) AS INTEGER) AS level)
SELECT level, round(avg(response_length), 6) AS mean_length FROM l LEFT JOIN ev ON ev.k % 17 = level GROUP BY level""")
def _(spark, sf):
    e = ev(spark, sf).select(((F.col("k") % 17) / 16.0).alias("reward"), "response_length")
    return _round(E.length_by_reward_level(e, "reward", "response_length"), "mean_length")


@query("timing_metrics", views="ev", oracle="""
, s AS (SELECT step, CASE WHEN data_source = 'click' THEN 'gen' ELSE data_source END AS section, sum(value) AS seconds FROM ev GROUP BY ALL),
t AS (SELECT step, sum(k) AS p, sum(response_length) AS r FROM ev GROUP BY step)
SELECT step, section, round(seconds, 6) AS seconds, round(seconds * 1000 / CASE WHEN section = 'gen' THEN r ELSE p + r END, 6) AS ms_per_token FROM s JOIN t USING (step)""")
def _(spark, sf):
    e = ev(spark, sf)
    section = F.when(F.col("data_source") == "click", "gen").otherwise(F.col("data_source")).alias("section")
    sections = e.groupBy("step", section).agg(F.sum("value").alias("seconds"))
    tokens = e.select("step", F.col("k").alias("prompt_tokens"), F.col("response_length").alias("response_tokens"))
    return _round(E.timing_metrics(sections, tokens, "step"), "seconds", "ms_per_token")


@query("throughput_metrics", views="ev", oracle="""
SELECT step, CAST(sum(k + response_length) AS BIGINT) AS total_tokens, round(sum(value), 6) AS seconds, round(sum(k + response_length) / (sum(value) * 8), 6) AS throughput FROM ev GROUP BY step""")
def _(spark, sf):
    e = ev(spark, sf)
    tokens = e.select("step", F.col("k").alias("prompt_tokens"), F.col("response_length").alias("response_tokens"))
    seconds = e.groupBy("step").agg(F.sum("value").alias("seconds"))
    return _round(E.throughput_metrics(tokens, seconds, "step", 8), "seconds", "throughput")


MODEL = {"hidden": 1024, "heads": 16, "kv_heads": 8, "layers": 28, "intermediate": 3072, "vocab": 151936}


@query("seqlen_flops_sums", views="ev", oracle="""
, s AS (SELECT step, sum(response_length) AS t, sum(response_length::BIGINT * response_length) AS q FROM ev GROUP BY step)
SELECT step, CAST(t AS BIGINT) AS tokens, CAST(q AS BIGINT) AS tokens_sq,
  round((6.0::DOUBLE * (28 * (1024 * 3072 * 3 + 1024 * (16 * 64 + 8 * 64 + 8 * 64 + 16 * 64)) + 151936 * 1024 * 2) * t + 12.0::DOUBLE * q * 64 * 16 * 28) / 1e12, 6) AS tera_flops FROM s""")
def _(spark, sf):
    return _round(E.flops_sums(ev(spark, sf), ["step"], "response_length", MODEL), "tera_flops")


@query("question_stats", views="docs", oracle=r"""
, d AS (SELECT source, n_chars AS chars, len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS words FROM docs)
SELECT source, count(*) AS rows, round(avg(chars), 1) AS chars_mean, round(min(chars)::DOUBLE, 1) AS chars_min, round(max(chars)::DOUBLE, 1) AS chars_max,
  round(quantile_cont(chars, 0.5), 1) AS chars_median, round(avg(words), 1) AS words_mean, round(min(words)::DOUBLE, 1) AS words_min, round(max(words)::DOUBLE, 1) AS words_max,
  round(quantile_cont(words, 0.5), 1) AS words_median FROM d GROUP BY source""")
def _(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text"), "doc_id")
    d = d.select("source", F.col("n_chars").alias("chars"), X.token_length(F.col("text")).alias("words"))
    return E.text_stats(d, ["source"], "chars", "words")


@query("rollout_summary", views="ev", oracle=GRADED + """
, p AS (SELECT DISTINCT step, substr(data_source || ' ' || track || ' ' || question_idx, 1, 100) AS prefix FROM g),
t AS (SELECT step, string_agg(prefix, '|' ORDER BY prefix) AS examples FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY step ORDER BY prefix) <= 3) GROUP BY step)
SELECT step, count(*) AS samples, count(DISTINCT question_idx) AS unique_indices, round(avg(length(output)), 6) AS length_mean, round(quantile_cont(length(output), 0.5), 6) AS length_p50,
  round(quantile_cont(length(output), 0.9), 6) AS length_p90, max(length(output)) AS length_max, round(avg(score), 6) AS score_mean,
  round(avg(CASE WHEN mark > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS marker_rate, any_value(examples) AS examples
FROM g JOIN t USING (step) GROUP BY step""")
def _(spark, sf):
    g = graded(spark, sf).withColumn("len", F.length("output")).withColumn(
        "input", F.concat_ws(" ", "data_source", "track", F.col("question_idx").cast("string"))
    )
    return _rollout_summary(g)


def _rollout_summary(g):
    base = g.groupBy("step").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("question_idx").alias("unique_indices"),
        F.round(F.avg("len"), 6).alias("length_mean"), F.max("len").cast("bigint").alias("length_max"),
        F.round(F.avg("score"), 6).alias("score_mean"),
        F.round(F.avg(F.col("output").contains("####").cast("double")), 6).alias("marker_rate"),
    )
    prefixes = g.select("step", F.substring("input", 1, 100).alias("prefix")).distinct()
    examples = sample_first_n(prefixes, ["step"], "prefix", 3).groupBy("step").agg(
        F.array_join(F.array_sort(F.collect_list("prefix")), "|").alias("examples")
    )
    quantiles = E.exact_percentiles(g, ["step"], "len", {"length_p50": 0.5, "length_p90": 0.9})
    return _round(base.join(quantiles, "step").join(examples, "step"), "length_p50", "length_p90")


@query("prompt_length_distribution", views="docs", oracle=r"""
, d AS (SELECT len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS w FROM docs)
SELECT CASE WHEN w >= 512 THEN 33 ELSE w // 16 + 1 END AS bin, count(*) AS n FROM d GROUP BY 1""")
def _(spark, sf):
    words = X.token_length(F.col("text")).cast("double")
    return docs(spark, sf).groupBy(F.width_bucket(words, F.lit(0.0), F.lit(512.0), F.lit(32)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


OFFSETS = GRADED + """
, f AS (SELECT question_idx, track, count(*) FILTER (score = 1) AS c, arg_min(length(output), sample_id) AS len, arg_min(mark, sample_id) AS mark FROM g GROUP BY ALL),
o AS (SELECT track || ':' || question_idx AS uid, c >= 6 AS correct, CASE WHEN mark > 0 THEN mark - 1 ELSE len END AS off FROM f)
"""


def _offsets(spark, sf):
    g = graded(spark, sf).withColumn("off", F.coalesce(X.marker_offset(F.col("output")), F.length("output")))
    f = g.groupBy("question_idx", "track").agg(F.count_if(F.col("score") == 1).alias("c"), F.min_by("off", "sample_id").alias("off"))
    return f.select(F.concat_ws(":", "track", F.col("question_idx").cast("string")).alias("uid"), (F.col("c") >= 6).alias("correct"), "off")


@query("answer_position_split", views="ev", oracle=OFFSETS + """
, t AS (SELECT CAST(floor(quantile_cont(off, 0.75)) AS BIGINT) AS threshold FROM o WHERE correct)
SELECT uid, correct, off, threshold, CASE WHEN correct AND off <= threshold THEN 'easy' ELSE 'hard' END AS split FROM o, t""")
def _(spark, sf):
    return E.position_split(_offsets(spark, sf), F.col("correct"), "off").withColumn("off", F.col("off").cast("bigint"))


@query("nearest_to_quantile", views="ev", oracle=OFFSETS + """
, q AS (SELECT 'p' || CAST(round(p * 100) AS INTEGER) AS quantile, CAST(floor(t) AS BIGINT) AS target
  FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS p, unnest((SELECT quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) FROM ev)) AS t))
SELECT quantile, target, arg_min(sample_id, abs(value - target) * 1e6 + sample_id / 1e6) AS sample_id FROM q, ev GROUP BY ALL""")
def _(spark, sf):
    return E.nearest_to_quantile(ev(spark, sf), "sample_id", "value", [0.1, 0.25, 0.5, 0.75, 0.9])


@query("welch_t_test", views="ev", oracle="""
, a AS (SELECT count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM ev WHERE track = 'A'),
b AS (SELECT count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM ev WHERE track = 'B'),
t AS (SELECT (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
   (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) AS df FROM a, b),
h AS (SELECT t, df, atan(abs(t) / sqrt(df)) / 2000 AS h1, pi() / 4000 AS h2 FROM t)
SELECT round(t, 6) AS t, round(df, 4) AS df,
  round(1 - list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i * h1), df - 1))) * h1
    / (list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(i * h2), 0), df - 1))) * h2), 5) AS p FROM h""")
def _(spark, sf):
    out = E.welch_t_test(ev(spark, sf), "track", "A", "B", "value")
    return out.select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("p", 5).alias("p"))


MEANS = """
, q AS (SELECT track, question_idx, avg(value) AS v FROM ev GROUP BY ALL), r AS (SELECT min(v) AS lo, max(v) AS hi FROM q)
"""


def _means(spark, sf):
    return ev(spark, sf).groupBy("track", "question_idx").agg(F.avg("value").alias("v"))


@query("density_curve", views="ev", oracle=MEANS + """
, s AS (SELECT track, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS w FROM q GROUP BY track),
p AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 199 AS x FROM r, range(200) u(i))
SELECT track, point, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - v) / w) ** 2)) / (any_value(w) * sqrt(2 * pi()) * any_value(n)), 6) AS density
FROM p, q JOIN s USING (track) GROUP BY ALL""")
def _(spark, sf):
    return _round(E.density_curve(_means(spark, sf), "track", "v"), "x", "density")


@query("density_histogram", views="ev", oracle=MEANS + """
, b AS (SELECT track, CAST(least(floor((v - lo) / ((hi - lo) / 29)), 28) AS INTEGER) AS bin, count(*) AS n, any_value((hi - lo) / 29) AS w FROM q, r GROUP BY ALL)
SELECT track, bin, n, round(n / sum(n) OVER (PARTITION BY track) / w, 6) AS density FROM b""")
def _(spark, sf):
    return _round(E.histogram(_means(spark, sf), "track", "v"), "density")


@query("testcase_score", """
WITH t AS (SELECT user_id AS response_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS test_id, event_type <> 'error' AND value > 5 AS passed FROM events)
SELECT response_id, CASE WHEN bool_and(passed) THEN 1.0::DOUBLE ELSE round(count(*) FILTER (test_id < 10 AND passed) / greatest(count(*) FILTER (test_id < 10), 1), 6) END AS score, count(*) AS n_tests
FROM t GROUP BY response_id""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("response_id"), "event_id", ((F.col("event_type") != "error") & (F.col("value") > 5)).alias("passed"))
    return _round(E.testcase_score(positions(e, "event_id", "test_id", ["response_id"]), ["response_id"], "test_id", "passed"), "score")


# Diversity of responses.


@query("cosine_similarity", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    other = e.select(F.col("vec_id").alias("anchor"), F.col("v").alias("w"))
    near = e.withColumn("anchor", F.col("vec_id") - F.col("vec_id") % 10).join(other, "anchor")
    return near.select("vec_id", F.round(D.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


PAIRS = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT a.label, list_dot_product(a.v, b.v) AS s FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id)
"""


@query("diversity_group_similarity", PAIRS + """
SELECT label, round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS std_similarity, count(*) AS n_pairs FROM p GROUP BY label""")
def _(spark, sf):
    return _round(D.group_similarity(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding"), "mean_similarity", "std_similarity")


TRACKED = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS track, label AS question_idx, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.track, a.question_idx, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s
      FROM e a JOIN e b ON a.track = b.track AND a.question_idx = b.question_idx AND a.vec_id < b.vec_id),
g AS (SELECT track, question_idx, avg(s) AS mean_similarity FROM p GROUP BY ALL)
"""


def _tracked(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("track"), F.col("label").alias("question_idx"), "embedding"
    )
    return D.group_similarity(e, ["track", "question_idx"], "vec_id", "embedding")


@query("diversity_track_summary", TRACKED + """
SELECT track, round(avg(mean_similarity), 6) AS mean, round(stddev_samp(mean_similarity), 6) AS std, round(min(mean_similarity), 6) AS min, round(max(mean_similarity), 6) AS max FROM g GROUP BY track""")
def _(spark, sf):
    return _round(D.track_summary(_tracked(spark, sf), "track", "mean_similarity"), "mean", "std", "min", "max")


@query("join_diversity_tracks", TRACKED + """
SELECT question_idx, round(a.mean_similarity, 6) AS similarity_a, round(b.mean_similarity, 6) AS similarity_b, round(b.mean_similarity - a.mean_similarity, 6) AS delta
FROM (SELECT * FROM g WHERE track = 'A') a JOIN (SELECT * FROM g WHERE track = 'B') b USING (question_idx)""")
def _(spark, sf):
    return _round(D.compare_tracks(_tracked(spark, sf), "track", "question_idx", "A", "B"), "similarity_a", "similarity_b", "delta")


@query("mean_pool_normalize", """
WITH t AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL),
s AS (SELECT label, sqrt(sum(m * m)) AS norm FROM t GROUP BY label)
SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(m / greatest(norm, 1e-12), 6) AS x FROM t JOIN s USING (label)""")
def _(spark, sf):
    return _round(D.mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding"), "x")
