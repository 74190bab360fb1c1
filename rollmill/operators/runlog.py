"""Operators over training metric logs in long form (run, metric, step, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.operators.keyed import neighbours, positions, running_sum

#: Steps of a run that one task puts in order.
STRETCH = 4096


def flatten_columns(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested struct fields as top-level columns with joined names."""

    def walk(path: list[str], dtype: T.DataType) -> list[Column]:
        if isinstance(dtype, T.StructType):
            return [c for f in dtype.fields for c in walk([*path, f.name], f.dataType)]
        return [F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path))]

    return df.select(*[c for f in df.schema.fields for c in walk([f.name], f.dataType)])


def wide_to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Sparse wide metric rows to (metric, value), without the nulls."""
    return df.unpivot(list(ids), list(metrics), "metric", "value").where("value is not null")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``; a maximum, so replayed rows are combined before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).select(*df.columns)


def history_summary(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run and metric: rows, step range, repeated steps, and first, last, mean, min, max and non-null count."""
    order = F.struct("step", "created_at", "row_id")
    some = F.col("value").isNotNull()
    return df.groupBy(run, "metric").agg(
        F.count(F.lit(1)).alias("rows"), F.min("step").alias("step_min"), F.max("step").alias("step_max"),
        (F.count("step") - F.count_distinct("step")).alias("duplicate_steps"),
        F.min_by("value", F.when(some, order)).alias("first"), F.max_by("value", F.when(some, order)).alias("last"),
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("nonnull"),
    )


def step_ranges(df: DataFrame, run: str = "run_id") -> DataFrame:
    return df.groupBy(run).agg(F.min("step").alias("min"), F.max("step").alias("max"), F.count("step").alias("count"))


def final_and_peak(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by("value", "step").alias("final"), F.max("value").alias("peak"))


def _stretch(step: str) -> Column:
    """A stretch of ``STRETCH`` steps. A log has one row a step, so a stretch of a run is a bounded piece of work."""
    return F.floor(F.col(step) / STRETCH)


def cumulative_tokens(lengths: DataFrame, keys: Sequence[str], samples_per_step: int) -> DataFrame:
    """Running total, in millions, of samples per step times mean length."""
    return running_sum(lengths, keys, ["step"], F.col("value") * samples_per_step / 1e6, "tokens_m", bucket=_stretch("step"))


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 7, bucket_rows: int = 4096
) -> DataFrame:
    """Centred mean over ``window`` rows, fewer at the ends.

    Windows run inside buckets of ``bucket_rows`` positions. Only rows beside a bucket's edge are copied, to the neighbour
    that needs them, so no run has to be read in order by one task.
    """
    half = window // 2
    placed = positions(df.select(*keys, order, value), order, "_pos", keys)
    pos = F.col("_pos")
    of = lambda at: F.floor(at / bucket_rows)
    spread = placed.withColumn("_bucket", F.explode(F.array_distinct(F.array(of(pos - half), of(pos), of(pos + half)))))
    around = Window.partitionBy(*keys, "_bucket").orderBy("_pos").rowsBetween(-half, half)
    means = spread.withColumn("rolling", F.avg(value).over(around))
    return means.where(F.col("_bucket") == of(pos)).select(*keys, order, "rolling")


def interpolate(
    series: DataFrame, targets: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "interpolated", steps: bool = False
) -> DataFrame:
    """``y`` of a series at the ``x`` of each target row, linear between neighbours and constant beyond the ends.

    ``steps`` says that x counts steps, of which there is one row each, so that stretches of steps divide the work evenly.
    """
    keys = list(keys)
    rest = [c for c in targets.columns if c not in (*keys, x)]
    known = series.select(*keys, F.col(x).cast("double").alias(x), F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")).alias("_p"))
    asked = targets.select(*keys, F.col(x).cast("double").alias(x), F.struct(F.lit(True).alias("_asked"), *rest).alias("_t"))
    both = known.unionByName(asked, allowMissingColumns=True)
    placed = neighbours(both, keys, x, F.col("_p"), _stretch(x) if steps else None).where("_t is not null")
    value = _between(F.col("_before"), F.col("_after"), F.col(x))
    return placed.select(*keys, x, *[F.col("_t")[c].alias(c) for c in rest], value.alias(out))


def _between(a: Column, b: Column, x: Column) -> Column:
    share = F.try_divide(x - a["x"], b["x"] - a["x"])
    return F.coalesce(a["y"] + share * (b["y"] - a["y"]), a["y"], b["y"])


def interpolate_once(series: DataFrame, targets: DataFrame, run: str, x: str, y: str, out: str) -> DataFrame:
    """As ``interpolate``, for one target row per run: its two neighbours are a maximum and a minimum over the run, without an order."""
    rest = [c for c in targets.columns if c not in (run, x)]
    asked = targets.select(F.col(run).alias("_run"), F.col(x).cast("double").alias("_x"), F.struct(*rest).alias("_rest"))
    here = F.col(x).cast("double")
    point = F.struct(here.alias("x"), F.col(y).alias("y"))
    near = series.join(asked, F.col(run) == F.col("_run")).groupBy(run).agg(
        F.max_by(point, F.when(here <= F.col("_x"), here)).alias("_before"), F.min_by(point, F.when(here >= F.col("_x"), here)).alias("_after"),
        F.any_value("_x").alias(x), F.any_value("_rest").alias("_rest"),
    )
    return near.select(run, x, *[F.col("_rest")[c].alias(c) for c in rest], _between(F.col("_before"), F.col("_after"), F.col(x)).alias(out))


def tokens_to_threshold(
    accuracy: DataFrame, tokens: DataFrame, run: str, *, share: float, baseline: str, budget: float
) -> DataFrame:
    """Per run: tokens when accuracy first reaches ``share`` of its own peak, percent saved against a baseline
    run, and accuracy at a token budget. ``accuracy`` and ``tokens`` have one row a step."""
    peaks = accuracy.groupBy(run).agg(F.max("value").alias("peak"), F.max_by("value", "step").alias("final"))
    reached = accuracy.join(peaks, run).where(F.col("value") >= share * F.col("peak")).groupBy(run).agg(
        F.min("step").alias("step"), F.first("peak").alias("peak"), F.first("final").alias("final")
    )
    at = interpolate_once(tokens, reached, run, "step", "tokens_m", "tokens_to_threshold")
    base = at.where(F.col(run) == baseline).agg(F.max("tokens_to_threshold")).scalar()
    curve = interpolate(tokens, accuracy.select(run, "step", "value"), [run], "step", "tokens_m", "tokens_m", steps=True)
    ask = peaks.select(run, F.lit(float(budget)).alias("tokens_m"))
    budgeted = interpolate_once(curve, ask, run, "tokens_m", "value", "accuracy_at_budget").select(run, "accuracy_at_budget")
    return at.join(budgeted, run).withColumn("_base", base).select(
        run, "step", "peak", "final", "tokens_to_threshold",
        (100 * (1 - F.col("tokens_to_threshold") / F.col("_base"))).alias("saving_percent"), "accuracy_at_budget",
        (100 * F.col("accuracy_at_budget") / F.col("peak")).alias("percent_of_peak"),
    )


def common_steps(df: DataFrame, run: str, a: str, b: str, keys: Sequence[str] = ("metric", "step")) -> DataFrame:
    """Rows both runs have, with gap b - a."""

    def side(name, suffix):
        return df.where(F.col(run) == name).select(*keys, F.col("value").alias(f"value_{suffix}"))

    return side(a, "a").join(side(b, "b"), list(keys)).withColumn("gap", F.col("value_b") - F.col("value_a"))


def run_overlap(df: DataFrame, run: str, a: str, b: str) -> DataFrame:
    """Per metric: shared steps of two runs with the mean and largest absolute difference."""
    gap = F.abs("gap")
    return common_steps(df, run, a, b).groupBy("metric").agg(
        F.count(F.lit(1)).alias("shared_steps"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff")
    )


def gap_summary(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, largest and smallest gap, with the first step where each extreme occurs."""
    return gaps.groupBy(*keys).agg(
        F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"),
        F.max_by("step", F.struct("gap", -F.col("step"))).alias("max_step"),
        F.min("gap").alias("min_gap"), F.min_by("step", F.struct("gap", "step")).alias("min_step"),
    )


def timing_ratio(df: DataFrame, run: str, a: str, b: str) -> DataFrame:
    """Mean of each metric in two runs and their ratio; null unless the second mean is positive."""

    def mean(name):
        return F.avg(F.when(F.col(run) == name, F.col("value")))

    means = df.groupBy("metric").agg(mean(a).alias("mean_a"), mean(b).alias("mean_b"))
    return means.withColumn("ratio", F.when(F.col("mean_b") > 0, F.col("mean_a") / F.col("mean_b")))


def run_summary_table(df: DataFrame, run: str, roles: dict[str, str]) -> DataFrame:
    """One row per run; ``roles`` names the metrics that hold accuracy, length, clip ratio, step time and memory."""

    def of(role):
        return F.when(F.col("metric") == roles[role], F.col("value"))

    def last(role):
        return F.max_by(of(role), F.when(of(role).isNotNull(), F.col("step")))

    return df.groupBy(run).agg(
        F.max("step").alias("total_steps"), last("accuracy").alias("final_accuracy"), F.max(of("accuracy")).alias("best_accuracy"),
        last("length").alias("final_length"), F.max(of("length")).alias("max_length"), last("clip").alias("final_clip_ratio"),
        F.avg(of("time")).alias("mean_step_time"), F.max(of("memory")).alias("peak_memory"),
    )


def select_run_most_steps(df: DataFrame, name: str, run: str) -> DataFrame:
    """Of the runs that share a name, the one with most logged steps; the smallest id on ties."""
    sizes = df.groupBy(name, run).agg(F.count_distinct("step").alias("steps"))
    return sizes.groupBy(name).agg(
        F.min_by(run, F.struct(-F.col("steps"), F.col(run))).alias(run), F.max("steps").alias("steps")
    )


def resolve_metric(df: DataFrame, run: str, *, contains: str, ends: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    """Per run the shortest metric name that fits the pattern (then the first by name), with its number of values."""
    ok = F.col("metric").contains(contains) & F.col("metric").endswith(ends)
    for x in exclude:
        ok = ok & ~F.col("metric").contains(x)
    found = df.where(ok & F.col("value").isNotNull()).groupBy(run, "metric").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.length("metric"), "metric")
    return found.groupBy(run).agg(F.min_by("metric", order).alias("metric"), F.min_by("n", order).alias("n"))


def standard_error(p: Column, n: Column | int) -> Column:
    """Standard error of a proportion."""
    return F.sqrt(p * (1 - p) / n)
