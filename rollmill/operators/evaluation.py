"""Evaluation of graded rollouts: per-problem accuracy, pass@k, best, worst and majority of N, breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.grading import grade_dispatch
from rollmill.functions.tokens import array_sum, masked_sum, squares
from rollmill.operators.keyed import (
    attach_group_stats,
    exact_percentiles,
    hash_pick,
    positions,
    running_sum,
    scalars,
)

KS = (1, 2, 4, 8, 16, 32)


def difficulty_bucket(ref_reward: Column) -> Column:
    """Easy above 10/16, hard at exactly 0, else medium."""
    return F.when(ref_reward > 10 / 16, "easy").when(ref_reward == 0, "hard").otherwise("medium")


def per_problem(df: DataFrame, keys: Sequence[str], score: str, parseable: Column | None = None) -> DataFrame:
    """Samples, exactly right samples, accuracy and wrong samples without a parseable answer, per problem."""
    right = F.col(score) == 1.0
    failed = F.count_if((F.col(score) == 0) & ~(parseable if parseable is not None else F.lit(True)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(right).alias("n_correct"),
        F.avg(right.cast("double")).alias("accuracy"), failed.alias("n_extract_failures"),
    )


def pass_at_k_value(n: Column, c: Column, k: Column) -> Column:
    """Unbiased chance that one of k drawn samples is right; 1 when fewer than k samples are wrong.

    No right sample gives 0 before the product is formed: a descending sequence would otherwise be built.
    """
    steps = F.sequence(n - c + 1, n)
    product = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (1 - k / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - product)


def pass_at_k(problems: DataFrame, keys: Sequence[str], ks: Sequence[int] = KS) -> DataFrame:
    """Mean pass@k over problems, one row per group and k, for every k not above the samples of a problem."""
    each = problems.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("k <= n_samples")
    value = pass_at_k_value(F.col("n_samples"), F.col("n_correct"), F.col("k"))
    return each.groupBy(*keys, "k").agg(F.avg(value).alias("pass_at_k"), F.count(F.lit(1)).alias("n_problems"))


def best_worst_of_n(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and deviation of the best and the worst of N draws with replacement, in closed form.

    For N = 2, 4, 8, ... below the group's size and for the size itself. The chance that the best of N is at
    most the i-th distinct value is (share of rows up to it) ** N, so equal values are collapsed first and
    the only ordered pass is over distinct values.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    sized = running_sum(attach_group_stats(counts, keys, F.sum("_c").alias("_m"), salt=[value]), keys, [value], F.col("_c"), "_upto")
    # Powers of two from 2 up to below the size: one fewer than the binary digits of size - 1.
    n_powers = F.length(F.bin(F.col("_m") - 1)) - 1
    powers = F.when(
        n_powers > 0, F.transform(F.sequence(F.lit(1), n_powers), lambda j: F.pow(F.lit(2), j).cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    drawn = sized.withColumn("n", F.explode(F.concat(powers, F.array("_m"))))
    upto, before = F.col("_upto") / F.col("_m"), (F.col("_upto") - F.col("_c")) / F.col("_m")
    x, n = F.col(value), F.col("n")
    best = F.pow(upto, n) - F.pow(before, n)
    worst = F.pow(1 - before, n) - F.pow(1 - upto, n)
    moments = drawn.groupBy(*keys, "n").agg(
        F.sum(x * best).alias("best_mean"), F.sum(x * x * best).alias("_best_sq"),
        F.sum(x * worst).alias("worst_mean"), F.sum(x * x * worst).alias("_worst_sq"),
    )

    def deviation(sq, mean):
        return F.sqrt(F.greatest(F.col(sq) - F.col(mean) * F.col(mean), F.lit(0.0)))

    return moments.select(
        *keys, "n", "best_mean", deviation("_best_sq", "best_mean").alias("best_std"),
        "worst_mean", deviation("_worst_sq", "worst_mean").alias("worst_std"),
    )


def majority_vote(df: DataFrame, keys: Sequence[str], vote: str, value: str, order: str) -> DataFrame:
    """Most frequent vote, first seen on ties, and the value its first voter had."""
    votes = df.groupBy(*keys, vote).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.min_by(value, order).alias("_value")
    )
    rank = F.struct(F.col("_n"), -F.col("_first"))
    return votes.groupBy(*keys).agg(
        F.max_by(vote, rank).alias("maj_vote"), F.max_by("_value", rank).alias("maj_value"),
        F.max("_n").alias("n_votes"),
    )


def bootstrap_draws(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], *, size: int, rounds: int, seed: int
) -> DataFrame:
    """``rounds`` resamples of ``size`` rows with replacement per group, drawn by seeded hash.

    Draws are generated from the list of groups and joined to rows on (group, position), a key that is spread
    evenly however large a group is.
    """
    keys = list(keys)
    numbered = positions(df.select(*keys, order, *columns), order, "_at", keys)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    draws = groups.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    )
    label = F.concat_ws(":", *[F.col(k).cast("string") for k in (*keys, "round", "draw")])
    draws = draws.withColumn("_at", hash_pick(label, str(seed), 2**31 - 1) % F.col("_m")).drop("_m")
    return draws.join(numbered.drop(order), [*keys, "_at"]).drop("_at")


def bootstrap_metric(draws: DataFrame, keys: Sequence[str], reduced: Column) -> DataFrame:
    """Mean and population deviation, over rounds, of any aggregate of the drawn rows."""
    rounds = draws.groupBy(*keys, "round").agg(reduced.alias("_r"))
    return rounds.groupBy(*keys).agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"))


def bootstrap_majority(draws: DataFrame, keys: Sequence[str], vote: str, value: str) -> DataFrame:
    """Mean and population deviation, over rounds, of the majority vote's value."""
    rounds = majority_vote(draws, [*keys, "round"], vote, value, "draw")
    return rounds.groupBy(*keys).agg(F.avg("maj_value").alias("mean"), F.stddev_pop("maj_value").alias("std"))


def check_binary(score: str) -> Column:
    """The score, or a failing job when it is neither 0 nor 1."""
    wrong = F.raise_error(F.concat(F.lit("score must be 0 or 1, found "), F.col(score).cast("string")))
    return F.when(F.col(score).isin(0.0, 1.0), F.col(score)).otherwise(wrong.cast("double"))


def by_source_and_difficulty(df: DataFrame, source: str, difficulty: str, score: str, length: str) -> DataFrame:
    """Reward, length, and length of wrong and right samples, by source and by source and difficulty.

    Both levels come from one pass; ``overall`` is 1 on the rows of a whole source, so a null difficulty in the data stays
    apart. -1 stands for an empty class.
    """
    checked = df.select(source, difficulty, check_binary(score).alias("_s"), F.col(length).alias("_l"))

    def of(s):
        return F.coalesce(F.avg(F.when(F.col("_s") == s, F.col("_l"))), F.lit(-1.0))

    return checked.groupingSets([[source], [source, difficulty]], source, difficulty).agg(
        F.grouping(difficulty).cast("int").alias("overall"),
        F.avg("_s").alias("reward"), F.avg("_l").alias("length"), of(0).alias("length_wrong"), of(1).alias("length_right"),
        F.count(F.lit(1)).alias("n"),
    )


def difficulty_metrics(
    df: DataFrame, difficulty: str, score: str, length: str, steps: str, first_advantage: str
) -> DataFrame:
    """Binary reward, lengths and verification counts of wrong, right and all samples; -1 for an empty class."""
    right = F.col(score) > 0.9

    def of(column, cond):
        return F.coalesce(F.avg(F.when(cond, F.col(column))), F.lit(-1.0))

    return df.groupBy(difficulty).agg(
        F.avg(right.cast("double")).alias("reward"),
        of(length, ~right).alias("length_wrong"), of(length, right).alias("length_right"), F.avg(length).alias("length"),
        of(steps, ~right).alias("verification_wrong"), of(steps, right).alias("verification_right"),
        F.avg(steps).alias("verification"),
        F.avg((F.col(first_advantage) == 0).cast("double")).alias("zero_advantage_ratio"),
    )


def data_metrics(
    df: DataFrame, *, scores: str, rewards: str, advantages: str, returns: str, values: str, mask: str, length: str, max_length: int,
    prompt_length: str, max_prompt_length: int, length_limits: Sequence[int] = (2048, 4096, 8192, 16384),
) -> DataFrame:
    """One row of batch statistics: scores and rewards per sequence, masked token statistics, explained variance, lengths.

    Means come first and the squares around them second, so large values of small spread keep their variance.
    """
    m = F.col(mask)
    kept = lambda c: F.filter(F.zip_with(F.col(c), m, lambda v, k: F.when(k > 0, v)), lambda v: v.isNotNull())
    error = F.zip_with(F.col(returns), F.col(values), lambda r, v: r - v)
    n = F.sum(array_sum(m))
    means = scalars(df, (F.sum(masked_sum(error, m)) / n).alias("err"), (F.sum(masked_sum(F.col(returns), m)) / n).alias("ret"))
    away = lambda c, mean: masked_sum(squares(F.transform(c, lambda x: x - mean)), m)
    rows = df.withColumn("_mean", means).select(
        array_sum(F.col(scores)).alias("score"), array_sum(F.col(rewards)).alias("reward"),
        F.col(length).alias("length"), F.col(prompt_length).alias("prompt_length"), array_sum(m).alias("n"),
        *[f(kept(c)).alias(f"{c}_{s}") for c in (advantages, returns, values)
          for s, f in (("sum", array_sum), ("max", F.array_max), ("min", F.array_min))],
        away(error, F.col("_mean.err")).alias("err_sq"), away(F.col(returns), F.col("_mean.ret")).alias("ret_sq"),
    )
    n = F.sum("n")
    per_row = ("score", "reward", "length", "prompt_length")
    full = {"clip_ratio": ("length", max_length), "prompt_clip_ratio": ("prompt_length", max_prompt_length)}
    return rows.agg(
        *[f(c).alias(f"{c}_{s}") for c in per_row for s, f in (("mean", F.avg), ("max", F.max), ("min", F.min))],
        *[g.alias(f"{c}_{s}") for c in (advantages, returns, values) for s, g in (
            ("mean", F.sum(f"{c}_sum") / n), ("max", F.max(f"{c}_max")), ("min", F.min(f"{c}_min")))],
        (1 - F.sum("err_sq") / (n - 1) / (F.sum("ret_sq") / (n - 1) + 1e-5)).alias("explained_var"),
        *[F.avg((F.col(c) == limit).cast("double")).alias(name) for name, (c, limit) in full.items()],
        *[F.avg(F.when(F.col("length") <= limit, F.col("score"))).alias(f"score_upto_{limit}") for limit in length_limits],
    )


def length_by_reward_level(df: DataFrame, reward: str, length: str, levels: int = 16) -> DataFrame:
    """Mean length at each reward level i/levels; null where no row has the level."""
    level = F.rint(F.col(reward) * levels).cast("int")
    exact = F.abs(F.col(reward) * levels - level) < 1e-9
    found = df.where(exact).groupBy(level.alias("level")).agg(F.avg(length).alias("mean_length"))
    every = df.sparkSession.range(levels + 1).select(F.col("id").cast("int").alias("level"))
    return every.join(found, "level", "left")


def text_stats(df: DataFrame, keys: Sequence[str], chars: str, words: str) -> DataFrame:
    """Rows, and mean, median, minimum and maximum of two length columns, rounded to one digit; null keys are a group."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).cast("double").alias(f"{c}_{s}") for c in (chars, words)
          for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
    )
    median = exact_percentiles(df, keys, [chars, words], {"median": 0.5}).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    base = base.join(median, same).select(base["*"], f"{chars}_median", f"{words}_median")
    return base.select(*keys, "rows", *[F.round(c, 1).alias(c) for c in base.columns if c not in (*keys, "rows")])


def position_split(df: DataFrame, correct: Column, offset: str) -> DataFrame:
    """Easy: right, with the answer no later than the whole-number 75th percentile of right answers; else hard."""
    threshold = exact_percentiles(df.where(correct), [], offset, {"p75": 0.75}).select(F.floor("p75")).scalar()
    return df.withColumn("threshold", threshold).withColumn(
        "split", F.when(correct & (F.col(offset) <= F.col("threshold")), "easy").otherwise("hard")
    )


def nearest_to_quantile(df: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """For each percentile, cut to a whole number, the key whose value lies nearest; the smallest key on ties."""
    names = {f"p{round(p * 100)}": p for p in probs}
    targets = exact_percentiles(df, [], value, names)
    packed = targets.select(
        F.array(*[F.struct(F.lit(n).alias("name"), F.floor(n).alias("target")) for n in names]).alias("t")
    ).scalar()
    each = df.select(key, value, F.explode(packed).alias("_t"))
    gap = F.struct(F.abs(F.col(value) - F.col("_t.target")), F.col(key))
    return each.groupBy(F.col("_t.name").alias("quantile")).agg(
        F.min_by(key, gap).alias(key), F.min("_t.target").alias("target")
    )


def student_t_two_sided(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided p-value of Student's t as a ratio of integrals of cos(x) ** (df - 1), by Simpson's rule."""

    def integral(upper):
        h = upper / steps
        weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0),
            lambda acc, i: acc + weight(i) * F.pow(F.greatest(F.cos(i * h), F.lit(0.0)), df - 1),
        ) * h / 3

    return 1 - integral(F.atan(F.abs(t) / F.sqrt(df))) / integral(F.lit(1.5707963267948966))


def welch_t_test(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Welch's t, degrees of freedom and two-sided p between two groups."""

    def of(name, fn):
        return fn(F.when(F.col(group) == name, F.col(value)))

    row = df.agg(
        *[of(g, f).alias(f"{s}_{i}") for i, g in enumerate((a, b))
          for s, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    ea, eb = F.col("var_0") / F.col("n_0"), F.col("var_1") / F.col("n_1")
    t = (F.col("mean_0") - F.col("mean_1")) / F.sqrt(ea + eb)
    dof = (ea + eb) * (ea + eb) / (ea * ea / (F.col("n_0") - 1) + eb * eb / (F.col("n_1") - 1))
    return row.select(t.alias("t"), dof.alias("df")).select("t", "df", student_t_two_sided(F.col("t"), F.col("df")).alias("p"))


def density_curve(df: DataFrame, group: str, value: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density per group on a shared grid from the overall minimum to the maximum.

    Bandwidth by Scott's rule. Equal values are counted first; each distinct one contributes to the fixed grid, and
    map-side combine leaves at most groups x points rows per task to shuffle.
    """
    span = scalars(df, F.min(value).alias("lo"), F.max(value).alias("hi"))
    moments = df.groupBy(F.col(group).alias("_group")).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_s"))
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    stats = counts.join(moments, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_span", span)
    width = F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("_span.lo") + (F.col("_span.hi") - F.col("_span.lo")) * F.col("point") / (points - 1)
    )
    z = (F.col("x") - F.col(value)) / width
    kernel = F.col("_c") * F.exp(-0.5 * z * z) / (width * 2.5066282746310002 * F.col("_n"))
    return grid.groupBy(group, "point").agg(F.max("x").alias("x"), F.sum(kernel).alias("density"))


def histogram(df: DataFrame, group: str, value: str, edges: int = 30) -> DataFrame:
    """Density histogram per group between ``edges`` shared, equally spaced edges; the last bin is closed."""
    span = scalars(df, F.min(value).alias("lo"), F.max(value).alias("hi"))
    bins = edges - 1
    placed = df.select(group, value).withColumn("_span", span)
    width = (F.col("_span.hi") - F.col("_span.lo")) / bins
    placed = placed.withColumn("_width", width).withColumn(
        "bin", F.least(F.floor((F.col(value) - F.col("_span.lo")) / F.col("_width")), F.lit(bins - 1)).cast("int")
    )
    counts = placed.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("_width").alias("_width"))
    sized = attach_group_stats(counts, [group], F.sum("n").alias("_total"))
    return sized.select(group, "bin", "n", (F.col("n") / F.col("_total") / F.col("_width")).alias("density"))


def testcase_score(df: DataFrame, keys: Sequence[str], test: str, passed: str, first: int = 10) -> DataFrame:
    """1 when every test passed, else the share passed among the ``first`` tests; no results count as one failure."""
    early = F.col(test) < first
    ran = F.col(passed).isNotNull()
    share = F.count_if(early & F.col(passed)) / F.greatest(F.count_if(early & ran), F.lit(1))
    every = F.bool_and(F.coalesce(F.col(passed), F.lit(False)))
    return df.groupBy(*keys).agg(F.when(every, 1.0).otherwise(share).alias("score"), F.count(F.lit(1)).alias("n_tests"))


def grade_with_tests(
    df: DataFrame, results: DataFrame, keys: Sequence[str], *, source: str, response: str, truth: str, test: str, passed: str, first: int = 10
) -> DataFrame:
    """``df`` with ``score`` by the rule of each row's data source; programs are scored by their test results.

    ``results`` holds one row per key and test case. They are counted per key before they meet ``df`` (``testcase_score``), so a
    program with many cases costs one row in the join. A program without results scores 0; a row with a null key has none.
    """
    tested = testcase_score(results, keys, test, passed, first).select(*keys, F.col("score").alias("_tests"))
    joined = df.join(tested, list(keys), "left")
    return joined.withColumn("score", grade_dispatch(F.col(source), F.col(response), F.col(truth), F.col("_tests"))).drop("_tests")


def timing_metrics(sections: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Seconds and milliseconds per token by section; ``gen`` counts response tokens, the rest all tokens."""
    totals = tokens.groupBy(key).agg(F.sum("prompt_tokens").alias("_p"), F.sum("response_tokens").alias("_r"))
    counted = F.when(F.col("section") == "gen", F.col("_r")).otherwise(F.col("_p") + F.col("_r"))
    return sections.join(totals, key).select(
        key, "section", "seconds", F.try_divide(F.col("seconds") * 1000, counted).alias("ms_per_token")
    )


def throughput_metrics(tokens: DataFrame, seconds: DataFrame, key: str, gpus: int) -> DataFrame:
    """Tokens, seconds and tokens per second and device, per key."""
    totals = tokens.groupBy(key).agg(F.sum(F.col("prompt_tokens") + F.col("response_tokens")).alias("total_tokens"))
    return totals.join(seconds, key).withColumn("throughput", F.try_divide("total_tokens", F.col("seconds") * gpus))


def flops_sums(df: DataFrame, keys: Sequence[str], length: str, model: dict[str, int]) -> DataFrame:
    """Training work per key of a dense decoder: linear in the tokens plus quadratic in each length."""
    head = model["hidden"] // model["heads"]
    attention = model["hidden"] * head * 2 * (model["heads"] + model["kv_heads"])
    weights = model["layers"] * (3 * model["hidden"] * model["intermediate"] + attention) + 2 * model["vocab"] * model["hidden"]
    n = F.col(length).cast("bigint")
    return df.groupBy(*keys).agg(F.sum(n).alias("tokens"), F.sum(n * n).alias("tokens_sq")).withColumn(
        "tera_flops",
        (6.0 * weights * F.col("tokens") + 12.0 * head * model["heads"] * model["layers"] * F.col("tokens_sq")) / 1e12,
    )
