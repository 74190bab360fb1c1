"""Checks that report violations as rows or counts, and gates that fail the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_batch_consistency(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Rows whose token arrays differ in length."""
    first = F.size(arrays[0])
    differs = F.lit(False)
    for a in arrays[1:]:
        differs = differs | (F.size(a) != first)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(differs).alias("violations"))


def check_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present once on each side, and keys that are missing or repeated on either."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    both = a.join(b, key, "full_outer").na.fill(0, ["_l", "_r"])
    return both.agg(
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("aligned"),
        F.count_if(F.col("_r") == 0).alias("left_only"), F.count_if(F.col("_l") == 0).alias("right_only"),
        F.count_if((F.col("_l") > 1) | (F.col("_r") > 1)).alias("repeated"),
    )


def check_condition(df: DataFrame, bad: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("violations"))


def check_expected_samples(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Groups whose number of responses is not the expected one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)


def check_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values present, rows, and whether the column is empty or full."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["rows"], list(columns), "column", "present").withColumn(
        "consistent", (F.col("present") == 0) | (F.col("present") == F.col("rows"))
    )


def check_pass_at_k_monotone(df: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """pass@k must not fall as k grows; the window spans the few k values of a group."""
    step = F.col("pass_at_k") - F.lag("pass_at_k").over(Window.partitionBy(*keys).orderBy("k"))
    return df.withColumn("_d", step).groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col("_d") >= -tolerance, F.lit(True))).alias("monotone")
    )


def best_metric_gate(df: DataFrame, value: Column, target: float) -> DataFrame:
    """The best value of a metric; the job fails unless it exceeds the target."""
    best = df.agg(F.max(value).alias("best"))
    low = F.raise_error(F.concat(F.lit("best value "), F.col("best").cast("string"), F.lit(f" does not exceed {target}")))
    return best.select(F.when(F.col("best") > target, F.col("best")).otherwise(low.cast("double")).alias("best"))
