"""Queries of the answer extractors, graders and text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rollmill.functions import answers as A
from rollmill.functions import grading as G
from rollmill.functions import normalize as N
from rollmill.functions import registry as R
from rollmill.functions import text as X
from rollmill.operators import evaluation as E
from rollmill.operators.keyed import positions
from rollmill.operators.prep import HASH_INSTRUCTION
from rollmill.plans.catalog import query
from rollmill.views import boxed, docs, ev, qa, table

STRICT = r"""
, s AS (SELECT *, nullif(regexp_extract(output, '#### (-?[0-9.,]+)', 1), '') AS ans FROM ev)
"""


@query("extract_hash_answer", views="qa ev", oracle=r"""
SELECT 'qa' AS source, item_id AS id, replace(nullif(regexp_extract(answer, '#### (-?[0-9.,]+)', 1), ''), ',', '') AS answer FROM qa
UNION ALL SELECT 'ev', sample_id, replace(nullif(regexp_extract(output, '#### (-?[0-9.,]+)', 1), ''), ',', '') FROM ev""")
def _(spark, sf):
    a = qa(spark, sf).select(F.lit("qa").alias("source"), F.col("item_id").alias("id"), A.extract_hash_answer(F.col("answer")).alias("answer"))
    b = ev(spark, sf).select(F.lit("ev").alias("source"), F.col("sample_id").alias("id"), A.extract_hash_answer(F.col("output")).alias("answer"))
    return a.unionByName(b)


@query("extract_last_number", views="docs ev", oracle=r"""
, t AS (SELECT 'docs' AS source, doc_id AS id, regexp_extract_all(text, '(-?[0-9.,]+)', 1) AS l FROM docs
  UNION ALL SELECT 'ev', sample_id, regexp_extract_all(output, '(-?[0-9.,]+)', 1) FROM ev)
SELECT source, id, coalesce(list_filter(l, lambda x: x NOT IN ('', '.'))[-1], l[1]) AS answer FROM t""")
def _(spark, sf):
    a = docs(spark, sf).select(F.lit("docs").alias("source"), F.col("doc_id").alias("id"), A.extract_last_number(F.col("text")).alias("answer"))
    b = ev(spark, sf).select(F.lit("ev").alias("source"), F.col("sample_id").alias("id"), A.extract_last_number(F.col("output")).alias("answer"))
    return a.unionByName(b)


@query("grade_exact", views="ev", oracle=STRICT + r"""
, t AS (SELECT *, regexp_extract_all(output, '(-?[0-9.,]+)', 1) AS l FROM s)
SELECT sample_id, CASE WHEN ans IS NULL THEN 0.0::DOUBLE WHEN replace(ans, ',', '') = ground_truth::VARCHAR THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS strict_score,
  CASE WHEN len(l) = 0 THEN 0.0::DOUBLE WHEN coalesce(list_filter(l, lambda x: x NOT IN ('', '.'))[-1], l[1]) = ground_truth::VARCHAR THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS flexible_score FROM t""")
def _(spark, sf):
    out, truth = F.col("output"), F.col("ground_truth")
    return ev(spark, sf).select(
        "sample_id", G.grade_exact(out, truth, format_score=0.1).alias("strict_score"),
        G.grade_exact(out, truth, method="flexible", format_score=0.1).alias("flexible_score"),
    )


# The fixture nests braces at most once, which a regular expression can follow; the fold has no such limit.
BOX = r"""
, x AS (SELECT *, CASE WHEN contains(response, '\boxed')
     THEN list_filter(regexp_extract_all(response, '\\boxed\{(?:[^{}]|\{[^{}]*\})*\}', 0), lambda y: true)[-1]
     ELSE regexp_extract_all(response, '\\fbox\{(?:[^{}]|\{[^{}]*\})*\}', 0)[-1] END AS box FROM boxed),
b AS (SELECT *, CASE WHEN starts_with(box, '\boxed{') THEN substr(box, 8, length(box) - 8) END AS ans FROM x)
"""


@query("extract_boxed", views="boxed", oracle=BOX + "SELECT sample_id, box, ans FROM b")
def _(spark, sf):
    r = F.col("response")
    return boxed(spark, sf).select("sample_id", A.last_boxed(r).alias("box"), A.extract_boxed(r).alias("ans"))


NORM = r"""
, n AS (SELECT *, {pred} AS p0, truth AS t0 FROM b),
u AS (SELECT sample_id, side, raw, replace(replace(replace(replace(raw, '\!', ''), 'tfrac', 'frac'), 'dfrac', 'frac'), '\%', '') AS v
      FROM (SELECT sample_id, 'pred' AS side, p0 AS raw FROM n UNION ALL SELECT sample_id, 'truth', t0 FROM n)),
w AS (SELECT *, CASE WHEN len(string_split(v, '=')) = 2 AND length(string_split(v, '=')[1]) <= 2 THEN string_split(v, '=')[2] ELSE v END AS v2 FROM u),
z AS (SELECT *, regexp_replace(replace(v2, ' ', ''), '\\frac([^{{])([^{{])', '\\frac{{\1}}{{\2}}', 'g') AS norm FROM w)
"""


@query("normalize_math_string", views="boxed", oracle=BOX + NORM.format(pred="ans") + "SELECT sample_id, side, norm FROM z WHERE raw IS NOT NULL")
def _(spark, sf):
    b = boxed(spark, sf).select("sample_id", A.extract_boxed(F.col("response")).alias("pred"), "truth")
    long = b.unpivot(["sample_id"], ["pred", "truth"], "side", "raw").where("raw is not null")
    return long.select("sample_id", "side", N.normalize_math_string(F.col("raw")).alias("norm"))


EQUIV = NORM.format(pred="ans") + """
, e AS (SELECT sample_id, max(norm) FILTER (side = 'pred') AS p, max(norm) FILTER (side = 'truth') AS t FROM z GROUP BY sample_id)
"""


@query("grade_boxed_equiv", views="boxed", oracle=BOX + EQUIV + "SELECT sample_id, CASE WHEN p = t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM e")
def _(spark, sf):
    return boxed(spark, sf).select("sample_id", G.grade_boxed_equiv(F.col("response"), F.col("truth")).alias("score"))


@query("grade_minerva", views="boxed", oracle=r"""
, l AS (SELECT sample_id, truth, coalesce(regexp_extract_all(right(response, 300), '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]') AS a FROM boxed),
p AS (SELECT sample_id, replace(replace(replace(replace(truth, 'an ', ''), 'a ', ''), '.$', '$'), ' ', '') AS t,
   replace(replace(replace(string_split(a, '=')[-1], ' ', ''), 'units', ''), '$', '') AS p FROM l),
q AS (SELECT sample_id, p, regexp_replace(t, 'frac([^{])(.)', 'frac{\1}{\2}', 'g') AS t FROM p)
SELECT sample_id, CASE WHEN p = t THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, p = t AS acc, p AS pred FROM q""")
def _(spark, sf):
    g = boxed(spark, sf).select("sample_id", G.grade_minerva(F.col("response"), F.col("truth")).alias("g"))
    return g.select("sample_id", "g.score", "g.acc", "g.pred")


@query("grade_minerva_options", views="boxed", oracle=BOX + r"""
, l AS (SELECT sample_id, ans, truth, coalesce(regexp_extract_all(right(response, 300), '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]') AS a FROM b),
p AS (SELECT sample_id, ans, truth, replace(replace(replace(string_split(a, '=')[-1], ' ', ''), 'units', ''), '$', '') AS p,
   regexp_replace(truth, 'frac([^{])(.)', 'frac{\1}{\2}', 'g') AS t FROM l)
SELECT sample_id, sample_id % 3 <> 0 AND p = t AS boxed_acc, CASE WHEN sample_id % 3 <> 0 AND p = t THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS boxed_score,
  coalesce(ans = truth, false) AS strict_acc, CASE WHEN ans = truth THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS strict_score, ans AS strict_pred FROM p""")
def _(spark, sf):
    wrapped = F.when(F.col("sample_id") % 3 == 0, F.col("truth")).otherwise(F.concat(F.lit("so \\boxed{0} or \\boxed{"), "truth", F.lit("}, done")))
    g = boxed(spark, sf).select(
        "sample_id", G.grade_minerva(F.col("response"), wrapped, boxed_truth=True).alias("b"),
        G.grade_minerva(F.col("response"), F.col("truth"), strict_box=True).alias("s"),
    )
    return g.select(
        "sample_id", F.col("b.acc").alias("boxed_acc"), F.col("b.score").alias("boxed_score"),
        F.col("s.acc").alias("strict_acc"), F.col("s.score").alias("strict_score"), F.col("s.pred").alias("strict_pred"),
    )


@query("grade_strict_box", views="boxed", oracle=BOX + "SELECT sample_id, CASE WHEN ans = truth THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, ans AS pred FROM b")
def _(spark, sf):
    g = boxed(spark, sf).select("sample_id", G.grade_strict_box(F.col("response"), F.col("truth")).alias("g"))
    return g.select("sample_id", "g.score", "g.pred")


@query("grade_curriculum", views="boxed", oracle=BOX + EQUIV + r"""
, c AS (SELECT sample_id, b.ans, e.p, e.t FROM b JOIN e USING (sample_id))
SELECT sample_id, CASE WHEN ans IS NOT NULL AND (p = t OR p = '3' OR regexp_replace(regexp_replace(ans, '\\?%', ''), '[{} ]', '', 'g') = '3') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM c""")
def _(spark, sf):
    truths = F.array(F.col("truth"), F.lit("\\boxed{3}"))
    return boxed(spark, sf).select("sample_id", G.grade_curriculum(F.col("response"), truths).alias("score"))


SYM = r"""
, i AS (SELECT sample_id, CASE sample_id % 5 WHEN 0 THEN k || ' degrees' WHEN 1 THEN '\text{' || k || ' apples}' WHEN 2 THEN k || '.0' WHEN 3 THEN '$' || k || ' 1/2$' ELSE '(' || k || ', 1,234)' END AS raw FROM ev)
"""


def _symbolic(spark, sf):
    k = F.col("k").cast("string")
    form = F.col("sample_id") % 5
    raw = (
        F.when(form == 0, F.concat(k, F.lit(" degrees"))).when(form == 1, F.concat(F.lit("\\text{"), k, F.lit(" apples}")))
        .when(form == 2, F.concat(k, F.lit(".0"))).when(form == 3, F.concat(F.lit("$"), k, F.lit(" 1/2$")))
        .otherwise(F.concat(F.lit("("), k, F.lit(", 1,234)")))
    )
    return ev(spark, sf).select("sample_id", "k", "ground_truth", raw.alias("raw"))


@query("normalize_symbolic_lite", views="ev", oracle=SYM + r"""
SELECT sample_id, CASE sample_id % 5 WHEN 0 THEN regexp_extract(raw, '[0-9]+') WHEN 1 THEN regexp_extract(raw, '[0-9]+') || 'apples'
  WHEN 2 THEN regexp_extract(raw, '[0-9]+') WHEN 3 THEN regexp_extract(raw, '[0-9]+') || '+1/2' ELSE replace(raw, ' ', '') END AS norm FROM i""")
def _(spark, sf):
    return _symbolic(spark, sf).select("sample_id", N.normalize_symbolic(F.col("raw")).alias("norm"))


@query("grade_tuple", views="ev", oracle="""
SELECT sample_id, k % 5 = ground_truth % 5 AND sample_id % 3 <> 2 AS equal FROM ev""")
def _(spark, sf):
    e = ev(spark, sf)
    a, b = (F.col("k") % 5).cast("string"), (F.col("ground_truth") % 5).cast("string")
    given = F.concat(F.lit("("), a, F.lit(", 1,000 )"))
    truth = F.when(F.col("sample_id") % 3 == 2, F.concat(F.lit("["), b, F.lit(",1000)"))).otherwise(F.concat(F.lit("("), b, F.lit(",1,000)")))
    return e.select("sample_id", G.grade_tuple(given, truth).alias("equal"))


@query("grade_numeric_tolerance", views="ev", oracle="""
, v AS (SELECT sample_id, round(value, 2) AS p, round(value, 2) * CASE sample_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1.00005 WHEN 2 THEN 1.001 ELSE 100 END AS t FROM ev)
SELECT sample_id, abs(p - t) <= 1e-4 * greatest(p, t) OR abs(p - t / 100) <= 1e-4 * greatest(p, t / 100) OR abs(p - t * 100) <= 1e-4 * greatest(p, t * 100) AS equal FROM v""")
def _(spark, sf):
    form = F.col("sample_id") % 4
    factor = F.when(form == 0, 1.0).when(form == 1, 1.00005).when(form == 2, 1.001).otherwise(100.0)
    pred = F.col("value").cast("string")
    truth = F.format_string("%.10f", F.col("value") * factor)
    return ev(spark, sf).select("sample_id", G.grade_numeric_tolerance(pred, truth).alias("equal"))


@query("match_answer_phrase", views="ev", oracle="""
SELECT sample_id, sample_id % 4 <> 3 AS matched, CASE sample_id % 4 WHEN 3 THEN 'no digits at all' ELSE CAST(k AS VARCHAR) END AS answer FROM ev""")
def _(spark, sf):
    k = F.col("k").cast("string")
    form = F.col("sample_id") % 4
    said = (
        F.when(form == 0, F.concat(F.lit("We add. The Answer is x = "), k))
        .when(form == 1, F.concat(F.lit("so we get "), k, F.lit(" is the answer")))
        .when(form == 2, F.concat(F.lit("Answer: first 7, then the total are "), k, F.lit(". Done")))
        .otherwise("no digits at all")
    )
    g = ev(spark, sf).select("sample_id", A.match_answer_phrase(said).alias("m"))
    return g.select("sample_id", "m.matched", "m.answer")


@query("grade_format_think_boxed", views="boxed", oracle=BOX + EQUIV + r"""
SELECT sample_id, round(0.9 * CASE WHEN p = t THEN 1.0::DOUBLE ELSE 0 END + 0.1 * CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\boxed\{.*\}.*') THEN 1.0::DOUBLE ELSE 0 END, 6) AS score
FROM e JOIN b USING (sample_id)""")
def _(spark, sf):
    return boxed(spark, sf).select("sample_id", F.round(G.grade_format_think_boxed(F.col("response"), F.col("truth")), 6).alias("score"))


DISPATCH = BOX + EQUIV + r"""
, m AS (SELECT sample_id, CASE sample_id % 3 WHEN 0 THEN 'openai/gsm8k' WHEN 1 THEN 'lighteval/MATH' ELSE 'aime2024' END AS data_source FROM boxed),
a AS (SELECT sample_id, replace(replace(replace(coalesce(regexp_extract_all(response, '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]'), ' ', ''), 'units', ''), '$', '') AS said,
        regexp_replace(replace(truth, ' ', ''), 'frac([^{])(.)', 'frac{\1}{\2}', 'g') AS want FROM boxed)
SELECT sample_id, data_source, CASE WHEN data_source = 'openai/gsm8k' THEN 0.0::DOUBLE WHEN data_source = 'lighteval/MATH' THEN CASE WHEN p = t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  ELSE CASE WHEN said = want THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END END AS score FROM m JOIN e USING (sample_id) JOIN a USING (sample_id)"""


def _sourced(spark, sf):
    form = F.col("sample_id") % 3
    source = F.when(form == 0, "openai/gsm8k").when(form == 1, "lighteval/MATH").otherwise("aime2024")
    return boxed(spark, sf).withColumn("data_source", source)


@query("grade_dispatch", views="boxed", oracle=DISPATCH)
def _(spark, sf):
    return _sourced(spark, sf).select(
        "sample_id", "data_source", G.grade_dispatch(F.col("data_source"), F.col("response"), F.col("truth")).alias("score")
    )


# Every rule, code by given test results: the events of a user are the test cases of that user's question.
ALL_RULES = ["openai/gsm8k", "lighteval/MATH", "aime2024", "numina_olympiads", "hiyouga/geometry3k", "codecontests"]
EVERY_RULE = BOX + EQUIV + r"""
, m AS (SELECT *, (k % 10)::DOUBLE AS v, try_cast(truth AS DOUBLE) AS g FROM b JOIN e USING (sample_id)),
a AS (SELECT sample_id, replace(replace(replace(coalesce(regexp_extract_all(response, '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]'), ' ', ''), 'units', ''), '$', '') AS said,
        regexp_replace(replace(truth, ' ', ''), 'frac([^{])(.)', 'frac{\1}{\2}', 'g') AS want FROM boxed),
r AS (SELECT user_id // 2 AS question_idx, row_number() OVER (PARTITION BY user_id // 2 ORDER BY event_id) - 1 AS test_id, event_type <> 'error' AND value > 5 AS passed FROM events WHERE user_id % 10 > 1),
c AS (SELECT question_idx, CASE WHEN bool_and(passed) THEN 1.0::DOUBLE ELSE count(*) FILTER (test_id < 10 AND passed) / greatest(count(*) FILTER (test_id < 10), 1) END AS share FROM r GROUP BY question_idx)
SELECT sample_id, round(CASE sample_id % 6 WHEN 0 THEN CASE WHEN truth = (k % 10)::VARCHAR THEN 1.0::DOUBLE ELSE 0 END
  WHEN 1 THEN CASE WHEN p = t THEN 1.0::DOUBLE ELSE 0 END
  WHEN 2 THEN CASE WHEN said = want THEN 1.0::DOUBLE ELSE -1 END
  WHEN 3 THEN CASE WHEN v = g OR abs(v - g / 100) <= 1e-4 * greatest(v, g / 100) OR abs(v - g * 100) <= 1e-4 * greatest(v, g * 100) THEN 1.0::DOUBLE ELSE 0 END
  WHEN 4 THEN 0.9 * CASE WHEN p = t THEN 1.0::DOUBLE ELSE 0 END + 0.1 * CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\boxed\{.*\}.*') THEN 1.0::DOUBLE ELSE 0 END
  ELSE coalesce(share, 0) END, 6) AS score FROM m JOIN a USING (sample_id) LEFT JOIN c USING (question_idx)"""


@query("grade_dispatch_every_rule", views="boxed", oracle=EVERY_RULE)
def _(spark, sf):
    form, said = F.col("sample_id") % 6, (F.col("k") % 10).cast("string")
    rows = boxed(spark, sf).withColumns({
        "data_source": F.get(F.array(*map(F.lit, ALL_RULES)), form.cast("int")),
        "response": F.when(form == 0, F.concat("response", F.lit("\n#### "), said))
        .when(form == 3, F.concat(F.lit("We add. The Answer is x = "), said)).otherwise(F.col("response")),
    })
    e = table(spark, sf, "events").where("user_id % 10 > 1").select(
        F.expr("user_id div 2").alias("question_idx"), "event_id", ((F.col("event_type") != "error") & (F.col("value") > 5)).alias("passed")
    )
    tests = positions(e, "event_id", "test_id", ["question_idx"])
    graded = E.grade_with_tests(
        rows, tests, ["question_idx"], source="data_source", response="response", truth="truth", test="test_id", passed="passed"
    )
    return graded.select("sample_id", F.round("score", 6).alias("score"))


def _marker_score(data_source, solution, truth, extra):
    return pd.Series([float(s.split("#### ")[-1] == str(t)) if "#### " in s else 0.0 for s, t in zip(solution, truth)])


def _length_info(data_source, solution, truth, extra):
    return pd.DataFrame({"score": solution.str.contains("####").astype("float64"), "chars": solution.str.len().astype("int64")})


def _fragile(data_source, solution, truth, extra):
    return [1.0 if int(s.split("#### ")[1]) == int(t) else 0.0 for s, t in zip(solution, truth)]


STRICT_SCORE = STRICT + "SELECT sample_id, CASE WHEN replace(ans, ',', '') = ground_truth::VARCHAR THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s"


@query("grade_batched", views="ev", oracle=STRICT_SCORE)
def _(spark, sf):
    return R.grade_batched(ev(spark, sf), _marker_score, "output", "ground_truth", source="data_source").select("sample_id", "score")


@query("grade_fail_to_zero", views="ev", oracle=STRICT_SCORE)
def _(spark, sf):
    return R.grade_batched(ev(spark, sf), _fragile, "output", "ground_truth", source="data_source", seconds=60.0).select("sample_id", "score")


@query("register_reward_fn", views="ev", oracle=STRICT_SCORE)
def _(spark, sf):
    rules = R.RewardRegistry()
    rules.register("strict", lambda row: G.grade_exact(row["solution"], row["truth"]))
    return ev(spark, sf).select("sample_id", rules.column("strict", solution=F.col("output"), truth=F.col("ground_truth")).alias("score"))


@query("reward_extra_columns", views="ev", oracle="""
SELECT data_source, round(avg(CASE WHEN contains(output, '####') THEN 1.0::DOUBLE ELSE 0 END), 6) AS score, round(avg(length(output)), 6) AS chars FROM ev GROUP BY data_source""")
def _(spark, sf):
    g = R.grade_batched(ev(spark, sf), _length_info, "output", "ground_truth", source="data_source", returns="score double, chars bigint")
    return g.groupBy("data_source").agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("chars"), 6).alias("chars"))


@query("reward_manager_choice", views="ev", oracle=STRICT + """
, g AS (SELECT sample_id, response_length, CASE WHEN replace(ans, ',', '') = ground_truth::VARCHAR THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM s),
p AS (SELECT *, least(-(response_length - 300) / 100.0 * 1.0, 0)::DOUBLE AS pen FROM g)
SELECT sample_id, 'naive' AS manager, s AS score, NULL::BOOLEAN AS overlong FROM p UNION ALL SELECT sample_id, 'dapo', round(s + pen, 6), pen < 0 FROM p
UNION ALL SELECT sample_id, m, s, NULL FROM p, (SELECT unnest(['prime', 'batch']) AS m)""")
def _(spark, sf):
    e = ev(spark, sf).select("sample_id", "data_source", "response_length", "output", "ground_truth")
    names = {"solution": "output", "truth": "ground_truth"}
    score = G.grade_exact(F.col("output"), F.col("ground_truth"))
    plain = R.reward_manager(e, "naive", score)
    dapo = R.reward_manager(e, "dapo", score, length="response_length", max_length=400, buffer=100, factor=1.0)
    pick = lambda d, name, flag: d.select("sample_id", F.lit(name).alias("manager"), F.round("score", 6).alias("score"), flag.alias("overlong"))
    none = F.lit(None).cast("boolean")
    both = pick(plain, "naive", none).unionByName(pick(dapo, "dapo", F.col("overlong")))
    for name, rule in (("prime", _fragile), ("batch", _marker_score)):
        both = both.unionByName(pick(R.reward_manager(e, name, rule, seconds=60.0, **names), name, none))
    return both


@query("reducers", views="ev", oracle="SELECT track, question_idx, round(max(value) - min(value), 6) AS spread FROM ev GROUP BY ALL")
def _(spark, sf):
    rules = R.ReducerRegistry()
    rules.register("spread", lambda c: F.max(c) - F.min(c))
    return ev(spark, sf).groupBy("track", "question_idx").agg(F.round(rules.column("spread", F.col("value")), 6).alias("spread"))


@query("overlong_penalty", views="ev", oracle="""
SELECT sample_id, round(least(-(response_length - 300) / 100.0 * 0.5, 0)::DOUBLE, 6) AS penalty, least(-(response_length - 300) / 100.0 * 0.5, 0) < 0 AS overlong FROM ev""")
def _(spark, sf):
    p = G.overlong_penalty(F.col("response_length"), 400, 100, 0.5)
    return ev(spark, sf).select("sample_id", F.round(p, 6).alias("penalty"), (p < 0).alias("overlong"))


@query("count_verification_steps", views="ev docs", oracle="""
, t AS (SELECT 'ev' AS source, sample_id AS id, output AS text FROM ev UNION ALL SELECT 'docs', doc_id, text FROM docs)
SELECT source, id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), 'wait') OR contains(lower(l), 'approximation') OR starts_with(l, 'Alternatively')
  OR starts_with(l, 'Is there another way') OR starts_with(l, 'But let me double') OR starts_with(l, 'But hold on'))) AS INTEGER) AS steps FROM t""")
def _(spark, sf):
    e = ev(spark, sf).select(F.lit("ev").alias("source"), F.col("sample_id").alias("id"), F.col("output").alias("text"))
    d = docs(spark, sf).select(F.lit("docs").alias("source"), F.col("doc_id").alias("id"), "text")
    return e.unionByName(d).select("source", "id", X.count_verification_steps(F.col("text")).alias("steps"))


@query("repeat_count", views="docs ev", oracle="""
, t AS (SELECT 'docs' AS source, doc_id AS id, text, right(text, 100) AS tail FROM docs UNION ALL SELECT 'ev', sample_id, repeat(output, 3), right(repeat(output, 3), 100) FROM ev),
f AS (SELECT source, id, text, tail, strpos(text, tail) AS first FROM t)
SELECT source, id, CASE WHEN length(text) < 50 THEN 0 ELSE CAST(len(list_filter(range(first, length(text) - length(tail) + 2), lambda i: substr(text, i, length(tail)) = tail)) AS INTEGER) END AS repeats FROM f""")
def _(spark, sf):
    d = docs(spark, sf).select(F.lit("docs").alias("source"), F.col("doc_id").alias("id"), "text")
    e = ev(spark, sf).select(F.lit("ev").alias("source"), F.col("sample_id").alias("id"), F.repeat("output", F.lit(3)).alias("text"))
    return d.unionByName(e).select("source", "id", X.repeat_count(F.col("text")).alias("repeats"))


@query("is_terminated", views="boxed", oracle=r"""
SELECT sample_id, contains(response, '</answer>') OR contains(response, '\boxed{') AS terminated FROM boxed""")
def _(spark, sf):
    return boxed(spark, sf).select("sample_id", X.is_terminated(F.col("response")).alias("terminated"))


@query("error_profile", views="boxed", oracle=r"""
, g AS (SELECT step, contains(response, '\boxed{') AS term, length(response) AS len, k % 10 = sample_id % 10 AS ok, length(response) > 40 AS rep FROM boxed)
SELECT step, round(avg(CASE WHEN rep THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT ok), 6) AS repeats_rate, round(avg(CASE WHEN term THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT ok), 6) AS terminated_rate,
  round(avg(len) FILTER (term), 6) AS terminated_length FROM g GROUP BY step""")
def _(spark, sf):
    g = boxed(spark, sf).withColumn("score", (F.col("k") % 10 == F.col("sample_id") % 10).cast("double"))
    # A looping response repeats its closing line; the longer ones of the fixture stand for those.
    text = F.when(F.length("response") > 40, F.repeat(F.concat("response", F.lit(" " * 100)), F.lit(7))).otherwise(F.col("response"))
    g = g.withColumn("repeats", X.repeat_count(text)).withColumn("terminated", X.is_terminated(F.col("response")))
    wrong = F.col("score") == 0
    rate = lambda c: F.avg(F.when(wrong, c.cast("double")))
    return g.groupBy("step").agg(
        F.round(rate(F.col("repeats") > 5), 6).alias("repeats_rate"), F.round(rate(F.col("terminated")), 6).alias("terminated_rate"),
        F.round(F.avg(F.when(F.col("terminated"), F.length("response"))), 6).alias("terminated_length"),
    )


@query("strip_think_tags", views="ev", oracle=r"""
SELECT sample_id, trim(regexp_replace(regexp_replace(output, '(?s)<think>.*?</think>', '', 'g'), '</?think>', '', 'g')) AS text FROM ev""")
def _(spark, sf):
    return ev(spark, sf).select("sample_id", X.strip_think_tags(F.col("output")).alias("text"))


@query("clean_wikihow_text", views="docs", oracle=r"""
SELECT doc_id, replace(regexp_replace(replace(regexp_replace('How to [title] ' || text || ' [step] end', '^\s+|\s+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS text FROM docs""")
def _(spark, sf):
    t = F.concat(F.lit("How to [title] "), F.col("text"), F.lit(" [step] end"))
    return docs(spark, sf).select("doc_id", X.clean_wikihow_text(t).alias("text"))


@query("strip_instruction", views="qa", oracle="SELECT item_id, trim(question) AS question FROM qa")
def _(spark, sf):
    return qa(spark, sf).select(
        "item_id", X.strip_instruction(F.concat_ws(" ", "question", F.lit(HASH_INSTRUCTION)), HASH_INSTRUCTION).alias("question")
    )


@query("render_prompt_template", views="qa", oracle=r"""
SELECT item_id, question AS plain, '<|im_start|>system' || chr(10) || 'Please reason step by step, and put your final answer within \boxed{}.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS qwen,
 chr(10) || 'User: ' || question || chr(10) || 'Assistant: ' AS r1_tail FROM qa""")
def _(spark, sf):
    q = F.col("question")
    r1 = X.render_prompt_template(q, "r1")
    return qa(spark, sf).select(
        "item_id", X.render_prompt_template(q, None).alias("plain"), X.render_prompt_template(q, "qwen").alias("qwen"),
        F.concat(F.lit("\nUser:"), F.substring_index(r1, "\nUser:", -1)).alias("r1_tail"),
    )


@query("token_length", views="docs", oracle=r"""
SELECT doc_id, CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS INTEGER) AS tokens FROM docs""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.token_length(F.col("text")).alias("tokens"))


@query("parse_log_line_metrics", views="ev", oracle="SELECT sample_id, step, round(value, 6) AS score FROM ev")
def _(spark, sf):
    line = F.format_string("step:%d - critic/score/mean:%s - k:%d", "step", F.col("value").cast("string"), "k")
    m = ev(spark, sf).select("sample_id", X.parse_log_line(line).alias("m"))
    return m.select("sample_id", F.col("m")["step"].cast("int").alias("step"), F.round(F.col("m")["critic/score/mean"].cast("double"), 6).alias("score"))


@query("register_dataset_cls", "SELECT doc_id, upper(lang) AS prompt, text AS response FROM documents")
def _(spark, sf):
    datasets = R.DatasetRegistry()
    datasets.register(
        "documents",
        lambda spark, folder: table(spark, folder, "documents").select("doc_id", F.upper("lang").alias("prompt"), F.col("text").alias("response")),
    )
    return datasets.load("documents", spark, folder=sf)
