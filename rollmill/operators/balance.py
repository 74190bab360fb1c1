"""Balancing sequence lengths over partitions inside batches of bounded size.

Batches come from ``epoch_batches``, so a group never exceeds the batch size and batches run in parallel.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.operators.keyed import attach_group_stats, running_sum


def _difference_partition(lengths: list[int], k: int, equal_size: bool) -> list[int]:
    """Part number per item by repeated differencing of the two most uneven partial solutions."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size:
        if len(order) % k:
            raise ValueError(f"{len(order)} items do not divide into {k} equal parts")
        starts = [order[i : i + k] for i in range(0, len(order), k)]
    else:
        starts = [[i] for i in order]

    def solution(parts):
        parts = sorted(parts, key=lambda p: (-p[0], -len(p[1]), p[1]))
        return (parts[-1][0] - parts[0][0], len(parts[0][1]), min(i for _, items in parts for i in items), parts)

    heap = []
    for items in starts:
        parts = [(lengths[i], [i]) for i in items] + [(0, [])] * (k - len(items))
        heap.append(solution(parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[-1], heapq.heappop(heap)[-1]
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        heapq.heappush(heap, solution(merged))
    out = [0] * len(lengths)
    for part, (_, items) in enumerate(heap[0][-1]):
        for i in items:
            out[i] = part
    return out


def _lightest_partition(lengths: list[int], k: int, equal_size: bool, sort: bool) -> list[int]:
    """Part number per item, each given to the part with the smallest sum so far."""
    bias = sum(lengths) + 1 if equal_size else 0
    heap = [(0, j) for j in range(k)]
    out = [0] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i]) if sort else range(len(lengths))
    for i in order:
        total, j = heapq.heappop(heap)
        out[i] = j
        heapq.heappush(heap, (total + lengths[i] + bias, j))
    return out


def _per_batch(df: DataFrame, keys: list[str], order: str, length: str, assign) -> DataFrame:
    names = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(part=assign([int(x) for x in pdf[length]]))[[*names, "part"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", part int"
    return df.groupBy(*keys).applyInPandas(run, schema)


def seqlen_balance_kk(
    df: DataFrame, keys: list[str], order: str, length: str, k: int, *, equal_size: bool = False
) -> DataFrame:
    """Column ``part``: Karmarkar-Karp partition of each batch into ``k`` parts."""
    return _per_batch(df, keys, order, length, lambda xs: _difference_partition(xs, k, equal_size))


def seqlen_balance_greedy(
    df: DataFrame, keys: list[str], order: str, length: str, k: int, *, equal_size: bool = False, sort: bool = False
) -> DataFrame:
    """Column ``part``: each item, in input order or longest first, goes to the lightest part."""
    return _per_batch(df, keys, order, length, lambda xs: _lightest_partition(xs, k, equal_size, sort))


def snake(df: DataFrame, keys: list[str], order: str, length: str, k: Column) -> DataFrame:
    """Column ``part``: deal items to ``k`` parts by falling length, turning round at each end.

    An item's place follows from counts of even ranges of the lengths, so a batch of any size is spread over tasks.
    """
    falling = df.withColumn("_k", k).withColumn("_short", -F.col(length))
    dealt = running_sum(falling, keys, ["_short", order], F.lit(1).cast("bigint"), "_place").withColumn("_place", F.col("_place") - 1)
    lap, at = F.expr("_place div _k"), F.pmod("_place", "_k")
    part = F.when(F.pmod(lap, F.lit(2)) == 0, at).otherwise(F.col("_k") - 1 - at)
    return dealt.withColumn("part", part.cast("int")).drop("_k", "_place", "_short")


def micro_batch_by_tokens(df: DataFrame, keys: list[str], order: str, length: str, max_tokens: int) -> DataFrame:
    """Split each batch into ceil(tokens / max_tokens) micro-batches of similar size.

    A sequence longer than the budget fails the job. Parts are balanced, so a part may pass the budget
    slightly, as with any balanced split into the smallest number of parts.
    """
    too_long = F.raise_error(F.lit(f"a sequence is longer than {max_tokens} tokens")).cast("bigint")
    total = F.when(F.max(length) <= max_tokens, F.sum(length)).otherwise(too_long)
    sized = attach_group_stats(df, keys, F.ceil(total / max_tokens).cast("int").alias("_parts"), salt=[order])
    return snake(sized, keys, order, length, F.col("_parts")).drop("_parts")


def seqlen_balance_report(df: DataFrame, keys: list[str], place: str, length: str, k: int) -> DataFrame:
    """Per batch: lightest and heaviest share before (contiguous slices) and after balancing, and the mean.

    ``place`` is the position in the batch; slices hold ``rows div k`` items, so a remainder forms one more.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    sliced = df.join(sizes, keys).withColumn("_slice", F.expr(f"{place} div (_rows div {k})"))
    before = sliced.groupBy(*keys, "_slice").agg(F.sum(length).alias("s")).groupBy(*keys).agg(
        F.min("s").alias("min"), F.max("s").alias("max"), F.sum("s").alias("_total")
    )
    after = df.groupBy(*keys, "part").agg(F.sum(length).alias("s")).groupBy(*keys).agg(
        F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max")
    )
    return before.join(after, keys).select(
        *keys, "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), "balanced_min", "balanced_max",
        (F.col("_total") / k).alias("mean"),
    )
