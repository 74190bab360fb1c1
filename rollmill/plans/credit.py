"""Queries of the credit-assignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.functions import tokens as T
from rollmill.functions.grading import grade_exact
from rollmill.operators import credit as C
from rollmill.operators.keyed import attach_group_stats
from rollmill.plans.catalog import query
from rollmill.session import spread, staged
from rollmill.views import ev, tok

GROUP = ["track", "question_idx"]


def _r(name, out=None, digits=6):
    return F.round(F.col(name), digits).alias(out or name)


GROUP_MEAN = """
, g AS (SELECT track, question_idx, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM ev GROUP BY ALL)
"""


@query("adv_grpo", views="ev", oracle=GROUP_MEAN + """
SELECT sample_id, round((value - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6), 6) AS advantage
FROM ev JOIN g USING (track, question_idx)""")
def _(spark, sf):
    return C.adv_grpo(ev(spark, sf).select("sample_id", *GROUP, "value"), GROUP, "value").select("sample_id", _r("advantage"))


@query("adv_rloo", views="ev", oracle=GROUP_MEAN + """
SELECT sample_id, round(CASE WHEN n = 1 THEN value ELSE value * n / (n - 1) - m * n / (n - 1) END, 9) AS advantage
FROM ev JOIN g USING (track, question_idx)""")
def _(spark, sf):
    out = C.adv_rloo(ev(spark, sf).select("sample_id", *GROUP, "value"), GROUP, "value")
    return out.select("sample_id", _r("advantage", digits=9))


@query("adv_rfpp_baseline", views="ev", oracle=GROUP_MEAN + """
, x AS (SELECT sample_id, response_length AS len, value - CASE WHEN n = 1 THEN 0 ELSE m END AS v FROM ev JOIN g USING (track, question_idx)),
t AS (SELECT v FROM x, unnest(range(x.len)) u),
m AS (SELECT count(*) AS n, sum(v) / (count(*) + 1e-8) AS mean FROM t),
s AS (SELECT sum((v - mean) * (v - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM t, m)
SELECT sample_id, round((v - mean) / sqrt(var + 1e-8), 6) AS advantage FROM x, m, s""")
def _(spark, sf):
    df = ev(spark, sf).select("sample_id", *GROUP, "value", "response_length")
    return C.adv_rfpp_baseline(df, GROUP, "value", "response_length").select("sample_id", _r("advantage"))


@query("adv_longest_correct", views="ev", oracle="""
, s AS (SELECT *, CASE WHEN k % 10 = ground_truth THEN 1.0 ELSE 0.0 END AS score FROM ev),
m AS (SELECT track, question_idx, max(response_length) FILTER (score > 1e-6) AS longest FROM s GROUP BY ALL)
SELECT sample_id, CASE WHEN score > 1e-6 AND response_length = longest THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS advantage
FROM s JOIN m USING (track, question_idx)""")
def _(spark, sf):
    df = ev(spark, sf).withColumn("score", F.when(F.col("k") % 10 == F.col("ground_truth"), 1.0).otherwise(0.0))
    return C.adv_longest_correct(df, GROUP, "score", "response_length").select("sample_id", "advantage")


def _tokens(spark, sf):
    return tok(spark, sf).withColumn("mask", T.ones_like(F.col("vals")))


def _long(df, *cols):
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    return df.select("uid", F.posexplode(zipped).alias("pos", "t")).select(
        "uid", F.col("pos").cast("bigint").alias("pos"), *[F.round(F.col(f"t.{c}"), 6).alias(c) for c in cols]
    )


GAE = """
, d AS (SELECT uid, n, vals, list_transform(range(1, n + 1), lambda t: rewards[t] + 0.9 * coalesce(vals[t + 1], 0) - vals[t]) AS delta FROM tok),
a AS (SELECT uid, t - 1 AS pos, vals[t] AS v,
        list_sum(list_transform(range(t, n + 1), lambda s: pow(0.9 * 0.95, s - t) * delta[s])) AS raw
      FROM d, unnest(range(1, n + 1)) u(t)),
"""
WHITE = """
m AS (SELECT count(*) AS n, sum(raw) / (count(*) + 1e-8) AS mean FROM a),
w AS (SELECT sum((raw - mean) * (raw - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM a, m)
"""


@query("adv_gae", views="tok", oracle=GAE + WHITE + """
SELECT uid, pos, round((raw - mean) / sqrt(var + 1e-8), 6) AS advantage, round(raw + v, 6) AS returns FROM a, m, w""")
def _(spark, sf):
    return _long(C.adv_gae(_tokens(spark, sf), "rewards", "vals", "mask", gamma=0.9, lam=0.95), "advantage", "returns")


@query("adv_rfpp", views="tok", oracle="""
, a AS (SELECT uid, t - 1 AS pos, list_sum(list_transform(range(t, n + 1), lambda s: pow(0.97, s - t) * rewards[s])) AS raw
        FROM tok, unnest(range(1, n + 1)) u(t)),
""" + WHITE + """
SELECT uid, pos, round((raw - mean) / sqrt(var + 1e-8), 6) AS advantage, round(raw, 6) AS returns FROM a, m, w""")
def _(spark, sf):
    return _long(C.adv_rfpp(_tokens(spark, sf), "rewards", "mask", gamma=0.97), "advantage", "returns")


@query("adv_remax", views="tok", oracle="""
SELECT uid, t - 1 AS pos, round(list_sum(rewards[t:n]) - vals[1], 6) AS advantage, round(list_sum(rewards[t:n]), 6) AS returns
FROM tok, unnest(range(1, n + 1)) u(t)""")
def _(spark, sf):
    df = _tokens(spark, sf).withColumn("baseline", F.get("vals", F.lit(0)))
    return _long(C.adv_remax(df, "rewards", "baseline", "mask"), "advantage", "returns")


@query("advantage_dispatch", views="ev", oracle=GROUP_MEAN + """
SELECT sample_id, 'grpo' AS estimator, round((value - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6), 9) AS advantage
FROM ev JOIN g USING (track, question_idx)
UNION ALL
SELECT sample_id, 'rloo', round(CASE WHEN n = 1 THEN value ELSE (value - m) * n / (n - 1) END, 9)
FROM ev JOIN g USING (track, question_idx)""")
def _(spark, sf):
    df = ev(spark, sf).select("sample_id", *GROUP, "value")
    parts = [
        C.advantage_dispatch(df, name, keys=GROUP, score="value")
        .select("sample_id", F.lit(name).alias("estimator"), _r("advantage", digits=9))
        for name in ("grpo", "rloo")
    ]
    return parts[0].unionByName(parts[1])


@query("masked_whiten", views="tok", oracle="""
, a AS (SELECT uid, t - 1 AS pos, vals[t] AS raw, CASE WHEN t % 3 = 0 THEN 0 ELSE 1 END AS k FROM tok, unnest(range(1, n + 1)) u(t)),
m AS (SELECT sum(k) AS n, sum(raw * k) / (sum(k) + 1e-8) AS mean FROM a),
w AS (SELECT sum((raw - mean) * (raw - mean) * k) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM a, m)
SELECT uid, pos, round((raw - mean) / sqrt(var + 1e-8), 6) AS whitened, round((raw - mean) / sqrt(var + 1e-8) + mean, 6) AS kept_mean FROM a, m, w""")
def _(spark, sf):
    df = tok(spark, sf).withColumn("mask", F.transform("vals", lambda _, i: F.when(i % 3 == 2, 0.0).otherwise(1.0)))
    white = C.masked_whiten(df, "vals", "mask")
    both = C.masked_whiten(white, "vals", "mask", shift_mean=False, out="kept_mean")
    return _long(both, "whitened", "kept_mean")


@query("kl_penalty", views="tok", oracle="""
, p AS (SELECT uid, t - 1 AS pos, vals[t] AS a, vals[n - t + 1] AS b FROM tok, unnest(range(1, n + 1)) u(t))
SELECT uid, pos, round(a - b, 6) AS kl, round(abs(a - b), 6) AS abs, round(0.5 * (a - b) * (a - b), 6) AS mse,
       round(least(greatest(exp(b - a) - (b - a) - 1, -10), 10), 6) AS low_var_kl FROM p""")
def _(spark, sf):
    df = tok(spark, sf).withColumn("ref", F.reverse("vals"))
    kinds = ["kl", "abs", "mse", "low_var_kl"]
    return _long(df.select("uid", *[T.kl_penalty(F.col("vals"), F.col("ref"), k).alias(k) for k in kinds]), *kinds)


@query("reward_with_kl", views="tok", oracle="""
SELECT uid, t - 1 AS pos, round(rewards[t] - 0.01 * (vals[t] - vals[n - t + 1]), 6) AS reward,
       round(list_avg(list_transform(range(1, n + 1), lambda i: abs(vals[i] - vals[n - i + 1]))), 6) AS seq_abs_kl
FROM tok, unnest(range(1, n + 1)) u(t)""")
def _(spark, sf):
    df = _tokens(spark, sf).withColumn("ref", F.reverse("vals"))
    kl = T.kl_penalty(F.col("vals"), F.col("ref"), "kl")
    mean = T.array_sum(T.kl_penalty(F.col("vals"), F.col("ref"), "abs")) / F.col("n")
    out = df.select("uid", "n", T.reward_with_kl(F.col("rewards"), kl, 0.01, F.col("mask")).alias("reward"), mean.alias("m"))
    out = out.withColumn("seq_abs_kl", F.transform("reward", lambda _: F.col("m")))
    return _long(out, "reward", "seq_abs_kl")


@query("loss_aggregate", views="tok", oracle="""
, r AS (SELECT list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN i % 3 = 0 THEN 0 ELSE vals[i] END)) AS s,
               len(list_filter(range(1, n + 1), lambda i: i % 3 <> 0)) AS n FROM tok)
SELECT round(sum(s) / sum(n), 6) AS token_mean, round(avg(s), 6) AS seq_mean_token_sum, round(avg(s / n), 6) AS seq_mean_token_mean FROM r""")
def _(spark, sf):
    df = tok(spark, sf).withColumn("mask", F.transform("vals", lambda _, i: F.when(i % 3 == 2, 0.0).otherwise(1.0)))
    out = C.loss_aggregate(df, "vals", "mask")
    return out.select(*[_r(c) for c in out.columns])


@query("policy_clip_stats", views="tok", oracle="""
, p AS (SELECT vals[t] AS o, vals[n - t + 1] AS q, CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END * (0.5 + rewards[t]) AS a
        FROM tok, unnest(range(1, n + 1)) u(t)),
l AS (SELECT a, o - q AS kl, -a * exp(q - o) AS l1, -a * least(greatest(exp(q - o), 0.8), 1.2) AS l2, -a * 3.0 AS l3 FROM p),
c AS (SELECT *, greatest(l1, l2) AS c1 FROM l)
SELECT round(avg(CASE WHEN a < 0 THEN least(l3, c1) ELSE c1 END), 6) AS pg_loss,
       round(avg(CASE WHEN l2 > l1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pg_clipfrac, round(avg(kl), 6) AS ppo_kl,
       round(avg(CASE WHEN c1 > l3 AND a < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pg_clipfrac_lower FROM c""")
def _(spark, sf):
    sign = F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0)
    df = _tokens(spark, sf).select(
        "vals", F.reverse("vals").alias("new"), "mask", F.transform("rewards", lambda r: sign * (0.5 + r)).alias("adv")
    )
    out = C.policy_clip_stats(df, "vals", "new", "adv", "mask")
    return out.select(*[_r(c) for c in out.columns])


@query("value_clip_stats", views="tok", oracle="""
, p AS (SELECT vals[n - t + 1] AS p, rewards[t] AS r, vals[t] AS v FROM tok, unnest(range(1, n + 1)) u(t)),
l AS (SELECT (p - r) * (p - r) AS a, (least(greatest(p, v - 0.1), v + 0.1) - r) * (least(greatest(p, v - 0.1), v + 0.1) - r) AS b FROM p)
SELECT round(0.5 * avg(greatest(a, b)), 6) AS vf_loss, round(avg(CASE WHEN b > a THEN 1.0::DOUBLE ELSE 0 END), 6) AS vf_clipfrac FROM l""")
def _(spark, sf):
    df = _tokens(spark, sf).withColumn("pred", F.reverse("vals"))
    out = C.value_clip_stats(df, "pred", "rewards", "vals", "mask", clip=0.1)
    return out.select(*[_r(c) for c in out.columns])


@query("entropy_from_logits", views="tok", oracle="""
, s AS (SELECT uid, vals, list_sum(list_transform(vals, lambda x: exp(x))) AS z FROM tok)
SELECT uid, round(ln(z) - list_sum(list_transform(vals, lambda x: exp(x) / z * x)), 6) AS entropy FROM s""")
def _(spark, sf):
    return tok(spark, sf).select("uid", F.round(T.entropy_from_logits(F.col("vals")), 6).alias("entropy"))


@query("logprob_of_label", views="tok", oracle="""
SELECT uid, round(vals[label % n + 1] - ln(list_sum(list_transform(vals, lambda x: exp(x)))), 6) AS logprob FROM tok""")
def _(spark, sf):
    return tok(spark, sf).select("uid", F.round(T.logprob_of_label(F.col("vals"), F.col("label")), 6).alias("logprob"))


@query("eos_response_mask", views="tok", oracle="""
, i AS (SELECT uid, list_transform(range(1, n + 1), lambda t: CAST((uid + t * 7) % 13 AS BIGINT)) AS ids FROM tok),
e AS (SELECT uid, ids, list_position(ids, 1) AS p1, list_position(ids, 2) AS p2 FROM i)
SELECT uid, t - 1 AS pos, CAST(t <= coalesce(p1, len(ids)) AS INTEGER) AS one_end,
       CAST(t <= coalesce(least(p1, p2), len(ids)) AS INTEGER) AS two_ends
FROM e, unnest(range(1, len(ids) + 1)) u(t)""")
def _(spark, sf):
    df = tok(spark, sf).select("uid", F.transform(F.sequence(F.lit(1), F.col("n")), lambda t: (F.col("uid") + t * 7) % 13).alias("ids"))
    df = df.select("uid", T.eos_response_mask(F.col("ids"), 1).alias("one_end"), T.eos_response_mask(F.col("ids"), [1, 2]).alias("two_ends"))
    return df.select("uid", F.posexplode(F.arrays_zip("one_end", "two_ends")).alias("pos", "t")).select(
        "uid", F.col("pos").cast("bigint").alias("pos"), "t.one_end", "t.two_ends"
    )


@query("position_ids", views="tok", oracle="""
, m AS (SELECT uid, list_transform(range(1, n + 1), lambda t: CAST(t > uid % 5 AND t % 4 <> 3 AS INTEGER)) AS mask FROM tok)
SELECT uid, t - 1 AS pos, CAST(greatest(list_sum(mask[1:t]) - 1, 0) AS BIGINT) AS position_id FROM m, unnest(range(1, len(mask) + 1)) u(t)""")
def _(spark, sf):
    mask = F.transform(F.sequence(F.lit(1), F.col("n")), lambda t: ((t > F.col("uid") % 5) & (t % 4 != 3)).cast("int"))
    df = tok(spark, sf).select("uid", T.position_ids(mask).alias("p"))
    return df.select("uid", F.posexplode("p").alias("pos", "position_id")).withColumn("pos", F.col("pos").cast("bigint"))


@query("place_terminal_reward", views="ev", oracle="""
SELECT sample_id, t - 1 AS pos, CASE WHEN t = step THEN round(coalesce(CASE WHEN k % 4 = 0 THEN k / 100.0::DOUBLE END, value), 6) ELSE 0.0::DOUBLE END AS reward
FROM ev, unnest(range(1, step + 1)) u(t)""")
def _(spark, sf):
    model_score = F.when(F.col("k") % 4 == 0, F.col("k") / 100.0)
    score = F.coalesce(model_score, F.col("value"))
    df = ev(spark, sf).select("sample_id", F.posexplode(T.place_terminal_reward(F.col("step"), score)).alias("pos", "reward"))
    return df.select("sample_id", F.col("pos").cast("bigint").alias("pos"), _r("reward"))


@query("adaptive_kl", views="ev", oracle="""
SELECT track, step, round(0.2 * exp(sum(ln(1 + least(greatest(value / 250.0 - 1, -0.2), 0.2) * 8 / 10000.0))), 6) AS kl_coef, count(*) AS updates
FROM ev GROUP BY track, step""")
def _(spark, sf):
    out = C.kl_controller(ev(spark, sf), ["track", "step"], "value", F.lit(8), init=0.2, target=250.0, horizon=10000.0)
    return out.select("track", "step", _r("kl_coef"), "updates")


def _logprobs(a, b):
    return F.transform(
        F.sequence(F.lit(1), F.col("response_length")),
        lambda i: -F.pmod(F.col("sample_id") * a + i * b, F.lit(100)) / 100.0,
    )


@query("score_kl_advantage", views="ev", oracle=r"""
, s AS (SELECT sample_id, track, question_idx, response_length AS n,
    CASE WHEN replace(nullif(regexp_extract(output, '#### (-?[0-9.,]+)', 1), ''), ',', '') = ground_truth::VARCHAR THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM ev),
k AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: (sample_id * 17 + i * 5) % 100 / 100.0::DOUBLE - (sample_id * 31 + i * 7) % 100 / 100.0::DOUBLE)) AS kl FROM s),
r AS (SELECT *, score - 0.001 * coalesce(kl, 0) AS reward, kl / n AS mean_kl FROM k WHERE n > 0),
g AS (SELECT track, question_idx, count(*) AS n, avg(reward) AS m, stddev_samp(reward) AS sd FROM r GROUP BY ALL)
SELECT sample_id, round(reward, 6) AS reward, round(mean_kl, 6) AS mean_kl,
  round((reward - CASE WHEN g.n = 1 THEN 0 ELSE m END) / (CASE WHEN g.n = 1 THEN 1 ELSE sd END + 1e-6), 5) AS advantage FROM r JOIN g USING (track, question_idx)""")
def _(spark, sf):
    """The timed stage in one job: grade, token rewards with divergence, group advantage."""
    e = spread(ev(spark, sf), "sample_id").where("response_length > 0").select(
        "sample_id", *GROUP, "response_length", grade_exact(F.col("output"), F.col("ground_truth")).alias("score")
    )
    kl = T.kl_penalty(_logprobs(31, 7), _logprobs(17, 5))
    tokens = e.select("sample_id", *GROUP, T.place_terminal_reward(F.col("response_length"), F.col("score")).alias("scores"), kl.alias("kl"))
    rewards = tokens.select(
        "sample_id", *GROUP, T.array_sum(T.reward_with_kl(F.col("scores"), F.col("kl"), 0.001)).alias("reward"),
        (T.array_sum(F.col("kl")) / F.size("kl")).alias("mean_kl"),
    )
    out = C.adv_grpo(staged(rewards, "rewards"), GROUP, "reward")
    return out.select("sample_id", _r("reward"), _r("mean_kl"), _r("advantage", digits=5))


@query("join_group_stats", views="ev", oracle=GROUP_MEAN + """
SELECT sample_id, round(m, 6) AS group_mean, round(s, 6) AS group_std, n AS group_size FROM ev JOIN g USING (track, question_idx)""")
def _(spark, sf):
    df = ev(spark, sf).select("sample_id", *GROUP, "value")
    out = attach_group_stats(
        df, GROUP, F.avg("value").alias("group_mean"), F.stddev_samp("value").alias("group_std"), F.count("value").alias("group_size")
    )
    return out.select("sample_id", _r("group_mean"), _r("group_std"), "group_size")


@query("adaptive_kl_trajectory", views="ev", oracle="""
SELECT track, sample_id, round(0.2 * exp(sum(ln(1 + least(greatest(value / 250.0 - 1, -0.2), 0.2) * 8 / 10000.0)) OVER (PARTITION BY track ORDER BY sample_id)), 6) AS kl_coef FROM ev""")
def _(spark, sf):
    e = ev(spark, sf).select("track", "sample_id", "value")
    out = C.kl_trajectory(e, ["track"], "sample_id", "value", F.lit(8), init=0.2, target=250.0, horizon=10000.0)
    return out.select("track", "sample_id", _r("kl_coef"))
