"""Credit assignment: group-relative and token-level advantages, whitening, losses and their diagnostics.

Score-level estimators take one row per response, with a group key; token-level ones take arrays per response.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.tokens import (
    array_sum,
    discounted_returns,
    gae_with_moments,
    masked_sum,
    returns_with_moments,
    squares,
)
from rollmill.operators.keyed import HOT_ROWS, attach_group_stats, running_sum


def adv_grpo(
    df: DataFrame, keys: list[str], score: str, *, epsilon: float = 1e-6, out: str = "advantage", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Score minus group mean over sample deviation; a lone response keeps its score (mean 0, deviation 1)."""
    g = attach_group_stats(
        df, keys, F.count(score).alias("_n"), F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_std"),
        hot_rows=hot_rows,
    )
    alone = F.col("_n") == 1
    mean = F.when(alone, 0.0).otherwise(F.col("_mean"))
    std = F.when(alone, 1.0).otherwise(F.col("_std"))
    return g.select(*df.columns, ((F.col(score) - mean) / (std + epsilon)).alias(out))


def adv_rloo(
    df: DataFrame, keys: list[str], score: str, *, out: str = "advantage", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Score against the mean of the other responses of its group; a lone response keeps its score."""
    g = attach_group_stats(df, keys, F.count(score).alias("_n"), F.avg(score).alias("_mean"), hot_rows=hot_rows)
    scale = F.try_divide(F.col("_n"), F.col("_n") - 1)
    value = F.when(F.col("_n") == 1, F.col(score)).otherwise((F.col(score) - F.col("_mean")) * scale)
    return g.select(*df.columns, value.alias(out))


def adv_rfpp_baseline(
    df: DataFrame, keys: list[str], score: str, length: str, *, out: str = "advantage", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Score minus group mean, then whitened over all tokens of the table.

    Every token of a response carries the same value, so the token moments follow from the lengths.
    """
    g = attach_group_stats(df, keys, F.count(score).alias("_n"), F.avg(score).alias("_mean"), hot_rows=hot_rows)
    centred = g.withColumn(
        "_centred", F.col(score) - F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_mean"))
    )
    x, n = F.col("_centred"), F.col(length).cast("double")
    each = F.struct(n.alias("n"), x.alias("mean"), F.lit(0.0).alias("m2"))
    return centred.withColumn("_m", _moments(centred, each)).select(*df.columns, _whiten(x, F.col("_m")).alias(out))


def adv_longest_correct(
    df: DataFrame, keys: list[str], score: str, length: str, *, epsilon: float = 1e-6, out: str = "advantage",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1 for the longest correct response of a group, ties included; else 0."""
    right = F.col(score) > epsilon
    g = attach_group_stats(df, keys, F.max(F.when(right, F.col(length))).alias("_longest"), hot_rows=hot_rows)
    return g.select(
        *df.columns, F.when(right & (F.col(length) == F.col("_longest")), 1.0).otherwise(0.0).alias(out)
    )


def _merged(rows: DataFrame) -> Column:
    """Number, mean and M2 (squares around the mean) of a table, as a scalar, from sums n, d and q of each row around its ``_pivot``."""
    sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.sum("d").alias("d"), F.sum("q").alias("q"), F.max("_pivot").alias("p"))
    shift = F.try_divide("d", "n")
    return sums.select(F.struct("n", (F.col("p") + shift).alias("mean"), (F.col("q") - F.col("d") * shift).alias("m2"))).scalar()


def _pivot(df: DataFrame, near: Column) -> Column:
    """A value of the table's size, as a scalar: sums around it keep the variance of large values with a small spread."""
    return F.coalesce(df.limit(16).select(near.alias("_near")).agg(F.max("_near")).scalar(), F.lit(0.0))


def _moments(df: DataFrame, each: Column) -> Column:
    """The table's moments in one pass, from those of each row (a struct n, mean, m2)."""
    rows = df.withColumn("_pivot", _pivot(df, each["mean"])).select("_pivot", each.alias("_e")).where("_e.n > 0")
    away = F.col("_e.mean") - F.col("_pivot")
    return _merged(rows.select("_pivot", F.col("_e.n").alias("n"), (F.col("_e.n") * away).alias("d"), (F.col("_e.m2") + F.col("_e.n") * away * away).alias("q")))


def array_moments(df: DataFrame, values: str, mask: str) -> Column:
    """Moments of all unmasked entries of a column of arrays, in one pass."""
    m = F.col(mask)
    away = F.transform(F.col(values), lambda x: x - F.col("_pivot"))
    rows = df.withColumn("_pivot", _pivot(df, F.get(values, F.lit(0)).cast("double")))
    return _merged(rows.select("_pivot", array_sum(m).alias("n"), masked_sum(away, m).alias("d"), masked_sum(squares(away), m).alias("q")))


def _whiten(x: Column, m: Column, shift_mean: bool = True) -> Column:
    """Whitened value from the table's moments; the variance is unbiased and needs two tokens."""
    mean = m["mean"] * m["n"] / (m["n"] + 1e-8)
    # Squares around that mean, which is a little nearer to 0 than the true one.
    spread = (m["m2"] + m["n"] * (m["mean"] - mean) * (m["mean"] - mean)) / (m["n"] + 1e-8)
    unbiased = spread * F.try_divide(m["n"], m["n"] - 1)
    var = F.when(m["n"] <= 1, F.raise_error(F.lit("whitening needs at least two tokens")).cast("double")).otherwise(unbiased)
    white = (x - mean) / F.sqrt(var + 1e-8)
    return white if shift_mean else white + mean


def masked_whiten(
    df: DataFrame, values: str, mask: str, *, shift_mean: bool = True, out: str = "whitened", moments: Column | None = None
) -> DataFrame:
    """Whiten token arrays with the mean and variance of all unmasked tokens of the table.

    Sums around a value of the table give them in one pass, as scalars, which every task then reads. ``moments``, where given, has them
    already.
    """
    m = array_moments(df, values, mask) if moments is None else moments
    return df.withColumn("_m", m).withColumn(out, F.transform(values, lambda x: _whiten(x, F.col("_m"), shift_mean))).drop("_m")


def adv_gae(
    df: DataFrame, rewards: str, values: str, mask: str, *, gamma: float, lam: float
) -> DataFrame:
    """Columns ``advantage`` (whitened) and ``returns`` (raw advantage plus value).

    One Python step gives a row's array together with its moments; it runs once for the table's moments and once for the rows.
    """
    each = gae_with_moments(F.col(rewards), F.col(values), F.col(mask), gamma, lam)
    raw = df.withColumn("_raw", each["values"])
    white = masked_whiten(raw, "_raw", mask, out="advantage", moments=_moments(df, each))
    returns = F.zip_with(F.col("_raw"), F.col(values), lambda a, v: a + v)
    return white.withColumn("returns", returns).drop("_raw")


def adv_rfpp(df: DataFrame, rewards: str, mask: str, *, gamma: float) -> DataFrame:
    """Columns ``advantage`` (whitened, masked discounted return) and ``returns``; Python as in adv_gae."""
    each = returns_with_moments(F.col(rewards), F.col(mask), gamma)
    raw = df.withColumn("returns", each["values"])
    white = masked_whiten(raw, "returns", mask, out="advantage", moments=_moments(df, each))
    return white.withColumn("advantage", F.zip_with("advantage", mask, lambda a, m: a * m))


def adv_remax(df: DataFrame, rewards: str, baseline: str, mask: str) -> DataFrame:
    """Columns ``advantage`` and ``returns``: reward still to come, less the greedy baseline on masked tokens."""
    masked = F.zip_with(F.col(rewards), F.col(mask), lambda r, m: r * m)
    every = F.transform(F.col(mask), lambda _: F.lit(1.0))
    out = df.withColumn("returns", discounted_returns(masked, every, 1.0))
    return out.withColumn("advantage", F.zip_with("returns", mask, lambda r, m: r - F.col(baseline) * m))


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "gae": adv_gae,
    "grpo": adv_grpo,
    "reinforce_plus_plus": adv_rfpp,
    "reinforce_plus_plus_baseline": adv_rfpp_baseline,
    "remax": adv_remax,
    "rloo": adv_rloo,
    "rft": adv_longest_correct,
}


def advantage_dispatch(df: DataFrame, estimator: str, **options) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; choose from {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, **options)


def loss_aggregate(df: DataFrame, loss: str, mask: str) -> DataFrame:
    """One row with the three ways of averaging a token loss."""
    per_row = df.select(
        masked_sum(F.col(loss), F.col(mask)).alias("s"), array_sum(F.col(mask)).alias("n")
    )
    return per_row.agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("token_mean"),
        F.avg("s").alias("seq_mean_token_sum"),
        F.avg(F.try_divide("s", "n")).alias("seq_mean_token_mean"),
    )


def _token_means(df: DataFrame, mask: str, **columns: Column) -> DataFrame:
    """Masked mean over all tokens of several token arrays, in one pass."""
    sums = df.select(
        array_sum(F.col(mask)).alias("_n"), *[masked_sum(c, F.col(mask)).alias(n) for n, c in columns.items()]
    )
    return sums.agg(*[F.try_divide(F.sum(n), F.sum("_n")).alias(n) for n in columns])


def policy_clip_stats(
    df: DataFrame, old: str, new: str, advantage: str, mask: str, *, low: float = 0.2, high: float = 0.2, dual: float = 3.0
) -> DataFrame:
    """Clipped policy loss, clip fractions and mean divergence over logged log-probabilities."""
    if dual <= 1.0:
        raise ValueError("the dual clip bound must exceed 1")
    zipped = F.arrays_zip(F.col(old).alias("o"), F.col(new).alias("p"), F.col(advantage).alias("a"))

    def terms(t):
        ratio = F.exp(t["p"] - t["o"])
        plain, clipped = -t["a"] * ratio, -t["a"] * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
        return F.struct(
            t["a"].alias("a"), plain.alias("plain"), clipped.alias("clipped"),
            F.greatest(plain, clipped).alias("worse"), (-t["a"] * dual).alias("bound"),
            (t["o"] - t["p"]).alias("kl"),
        )

    rows = df.withColumn("_t", F.transform(zipped, terms))

    def each(fn):
        return F.transform(F.col("_t"), fn)

    return _token_means(
        rows, mask,
        pg_loss=each(lambda t: F.when(t["a"] < 0, F.least(t["bound"], t["worse"])).otherwise(t["worse"])),
        pg_clipfrac=each(lambda t: (t["clipped"] > t["plain"]).cast("double")),
        ppo_kl=each(lambda t: t["kl"]),
        pg_clipfrac_lower=each(lambda t: ((t["worse"] > t["bound"]) & (t["a"] < 0)).cast("double")),
    )


def value_clip_stats(
    df: DataFrame, predicted: str, returns: str, values: str, mask: str, *, clip: float
) -> DataFrame:
    """Clipped value loss and the share of clipped tokens."""
    zipped = F.arrays_zip(F.col(predicted).alias("p"), F.col(returns).alias("r"), F.col(values).alias("v"))

    def terms(t):
        bounded = F.greatest(F.least(t["p"], t["v"] + clip), t["v"] - clip)
        return F.struct(
            ((t["p"] - t["r"]) * (t["p"] - t["r"])).alias("plain"),
            ((bounded - t["r"]) * (bounded - t["r"])).alias("clipped"),
        )

    rows = df.withColumn("_t", F.transform(zipped, terms))
    out = _token_means(
        rows, mask,
        vf_loss=F.transform("_t", lambda t: F.greatest(t["plain"], t["clipped"])),
        vf_clipfrac=F.transform("_t", lambda t: (t["clipped"] > t["plain"]).cast("double")),
    )
    return out.select((0.5 * F.col("vf_loss")).alias("vf_loss"), "vf_clipfrac")


def kl_controller(
    df: DataFrame, keys: list[str], kl: str, n_steps: Column, *, init: float, target: float, horizon: float
) -> DataFrame:
    """Value of the adaptive coefficient per key after all updates.

    The controller multiplies its value by one factor per update, so the order of updates does not matter and
    a product gives the result with map-side combine, factors of zero or below included.
    """
    return df.groupBy(*keys).agg(*kl_updates(kl, n_steps, init=init, target=target, horizon=horizon))


def kl_updates(kl: str, n_steps: Column, *, init: float, target: float, horizon: float) -> list[Column]:
    """The controller as aggregates: ``kl_coef`` after all updates of a group, and their number."""
    error = F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2))
    return [(F.lit(init) * F.product(1 + error * n_steps / horizon)).alias("kl_coef"), F.count(F.lit(1)).alias("updates")]


def kl_trajectory(
    df: DataFrame, keys: list[str], order: str, kl: str, n_steps: Column, *, init: float, target: float, horizon: float
) -> DataFrame:
    """Value of the adaptive coefficient after each update: a running sum of the logarithms of its factors."""
    error = F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2))
    logs = running_sum(df, keys, [order], F.ln(1 + error * n_steps / horizon), "_log")
    return logs.withColumn("kl_coef", F.lit(init) * F.exp("_log")).drop("_log")
