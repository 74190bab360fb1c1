"""Building blocks that keep group and order logic safe when one key holds a large share of the rows.

Nothing here gathers a group into one task: groups are pre-aggregated before they are shuffled, joins back to
rows are salted for hot keys, and ordered work is cut into even ranges with carried offsets. Nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.session import shuffle_width

HOT_ROWS = 1_000_000
#: Keys in the sample that cuts a table into ordered ranges, for each range.
SAMPLED = 16


def scalars(df: DataFrame, *aggs: Column) -> Column:
    """Whole-table aggregates as one struct column, usable in any other DataFrame (scalar subquery)."""
    return df.agg(F.struct(*aggs).alias("_scalars")).scalar()


def attach_group_stats(
    df: DataFrame, keys: Sequence[str], *aggs: Column, hot_rows: int = HOT_ROWS, salt: Sequence[str] = ()
) -> DataFrame:
    """Give each row the aggregates of its group.

    The aggregates are computed with map-side combine and joined back. A group larger than ``hot_rows`` is
    split into slices of about that size and its single statistics row is copied once per slice. The list of
    hot groups has at most ``rows / hot_rows`` entries; whether it is small enough to broadcast is left to Spark.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    named = [c for c in stats.columns if c not in (*keys, "_rows")]
    slices = F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int")

    hot = stats.where(F.col("_rows") > hot_rows).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], slices.alias("_slices")
    )
    same_hot = _all([F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    spread = F.xxhash64(*(salt or df.columns))
    sliced = df.join(hot, same_hot, "left").withColumn(
        "_slice", F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(spread, F.col("_slices")).cast("int"))
    )

    copies = stats.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], *named,
        F.explode(F.sequence(F.lit(0), slices - 1)).alias("_of_slice"),
    )
    same = _all([F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) & (F.col("_slice") == F.col("_of_slice"))
    return sliced.join(copies, same).select(*df.columns, *named)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """The order columns, then a hash of the whole row, which puts rows of one order value in a fixed order. Nulls come first."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], tie.alias("tie"))


def order_cuts(df: DataFrame, key: Column, buckets: int) -> Column:
    """Fewer than ``buckets`` keys that cut the table into even ranges, as an array in a scalar subquery.

    They are evenly spaced among the distinct keys of a sample, about ``SAMPLED`` for each range, that a hash of the key picks: the same
    rows whenever the table is read, so every reader of the cuts sees the same ones. Nothing runs before an action does.
    """
    keys = df.select(key.alias("_k"))
    share = F.lit(float(SAMPLED * buckets)) / F.greatest(keys.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    picked = (F.pmod(F.xxhash64(F.lit("cut"), F.col("_k")), F.lit(1 << 30)) / float(1 << 30)) < F.col("_share")
    sample = keys.withColumn("_share", share).where(picked).agg(F.array_sort(F.collect_set("_k")).alias("_s"))
    n = F.size("_s")
    every = F.transform(F.sequence(F.lit(1), F.lit(max(buckets - 1, 1))), lambda i: F.get("_s", F.floor(i * n / buckets).cast("int")))
    return sample.select(F.when(n > 0, F.array_distinct(F.filter(every, lambda c: c.isNotNull()))).otherwise(F.slice("_s", 1, 0))).scalar()


def order_bucket(df: DataFrame, order: Sequence[str], buckets: int | None = None, key: Column | None = None) -> DataFrame:
    """Label rows with the even range of the order that they lie in (``_bucket``), found by bisection among the cuts.

    Rows that share an order value are told apart by a hash of the row, so one value on a third of all rows is spread over ranges. A
    different ``key`` keeps, for instance, equal values together.
    """
    buckets = buckets or shuffle_width(df.sparkSession)
    key = order_key(df, order) if key is None else key
    marked = df.withColumn("_key", key).withColumn("_cuts", order_cuts(df, key, buckets))
    start = F.struct(F.lit(0).alias("lo"), F.size("_cuts").alias("hi"))

    def halved(at: Column, _: Column) -> Column:
        mid = ((at["lo"] + at["hi"]) / 2).cast("int")
        up = F.get("_cuts", mid) <= F.col("_key")
        open_ = at["lo"] < at["hi"]
        return F.struct(F.when(open_ & up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(at["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(buckets.bit_length()))
    return marked.withColumn("_bucket", F.aggregate(steps, start, halved)["lo"]).drop("_key", "_cuts")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], measure: Column, out: str, buckets: int | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Inclusive running sum of ``measure`` within ``keys``, in the order of the ``order`` columns, then of a hash of the row.

    ``bucket``, where the order itself tells even ranges (steps of a log do), saves the pass that finds them. Each task sums one (group, range) of the order; totals of ranges, at most one row per group and range, give the offsets. One way
    for tables and groups of any size, planned lazily as a whole.
    """
    keys = list(keys)
    bucketed = order_bucket(df, order, buckets) if bucket is None else df.withColumn("_bucket", bucket)
    bucketed = bucketed.withColumn("_measure", measure).withColumn("_tie", order_key(df, order)["tie"])
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_measure").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _join_buckets(bucketed, offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, (F.col("_offset") + F.sum("_measure").over(local)).alias(out))


def _join_buckets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, _all([F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]))


def positions(df: DataFrame, key: str, out: str = "pos", keys: Sequence[str] = ()) -> DataFrame:
    """Zero-based position of each row in ``key`` order, over the whole table or within ``keys``."""
    return running_sum(df, keys, [key], F.lit(1).cast("bigint"), out).withColumn(out, F.col(out) - 1)


def hash_order(key: Column, seed: str | Column) -> Column:
    """A reproducible random order: the md5 of seed and key, as hexadecimal text."""
    seed = F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")
    return F.md5(F.concat(seed, F.lit(":"), key.cast("string")))


def hash_pick(key: Column, seed: str | Column, n: int) -> Column:
    """A reproducible uniform choice from 0..n-1."""
    return F.pmod(F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def hash_positions(df: DataFrame, key: str, seed: str | Column, out: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Zero-based position in seeded random order.

    The leading hexadecimal digits of the hash cut the table, or each group, into even buckets, several per
    shuffle partition, so the sort is spread over tasks even when there is a single group.
    """
    keys = list(keys)
    width = shuffle_width(df.sparkSession)
    digits = next(d for d in range(2, 9) if 16**d >= 8 * width)
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed)).withColumn("_bucket", F.substring("_hash", 1, digits))
    totals = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_bucket").orderBy("_hash", key)
    joined = _join_buckets(hashed, offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, (F.col("_offset") + F.row_number().over(local) - 1).cast("bigint").alias(out))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str | Sequence[str], probs: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """Linearly interpolated percentiles per group, exact, by selection; null for a group without values.

    Equal values are counted together. A histogram over even ranges of the values says which range holds each order statistic; only the
    values of those ranges are ordered, range by range. No group is held in one task, nothing is written, and several columns go through the same passes
    (``value`` a list: names then are ``<column>_<name>``).
    """
    keys, several = list(keys), not isinstance(value, str)
    columns = list(value) if several else [value]
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_x"))
    long = long.select(*keys, "_x._c", "_x._v")
    group = [*keys, "_c"]
    # Equal values stay in one range: the key is the value, told apart by its column alone.
    placed = order_bucket(long, ["_v"], buckets, key=F.struct("_c", "_v"))
    counts = placed.groupBy(*group, "_bucket", "_v").agg(F.count("_v").alias("_k"))
    ranges = counts.groupBy(*group, "_bucket").agg(F.sum("_k").alias("_n"))
    within = Window.partitionBy(*group)
    before = F.sum("_n").over(within.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_all", F.sum("_n").over(within))
    at = {name: (F.col("_all") - 1) * F.lit(p) for name, p in probs.items()}
    sides = [(name, side, f(at[name])) for name in probs for side, f in (("lo", F.floor), ("hi", F.ceil))]
    asked = F.filter(
        F.array(*[F.struct(F.lit(i).alias("i"), rank.cast("long").alias("rank")) for i, (_, _, rank) in enumerate(sides)]),
        lambda s: (s["rank"] >= F.col("_before")) & (s["rank"] < F.col("_before") + F.col("_n")))
    wanted = ranges.withColumn("_asked", asked).where(F.size("_asked") > 0).select(*group, "_bucket", "_before", "_asked")
    counts = _join_buckets(counts.where("_v is not null"), wanted, [*group, "_bucket"])
    inside = Window.partitionBy(*group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("_upto", F.col("_before") + F.sum("_k").over(inside))
    met = upto.withColumn("_met", F.explode("_asked")).where((F.col("_met.rank") < F.col("_upto")) & (F.col("_met.rank") >= F.col("_upto") - F.col("_k")))
    # Every group has ranges, also one whose values are all null.
    sizes = ranges.groupBy(*group).agg(F.max("_all").alias("_all"), F.lit(None).cast("struct<i:int,rank:bigint>").alias("_met"), F.lit(None).cast("double").alias("_v"))
    parts = met.select(*group, F.lit(None).cast("long").alias("_all"), "_met", "_v").unionByName(sizes.select(*group, "_all", "_met", "_v"))

    def of(c: int, i: int) -> Column:
        return F.max(F.when((F.col("_c") == c) & (F.col("_met.i") == i), F.col("_v")))

    picks = [of(c, i).alias(f"_{c}_{i}") for c in range(len(columns)) for i in range(len(sides))]
    found = parts.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, F.col("_all"))).alias(f"_all_{c}") for c in range(len(columns))], *picks)
    out = []
    for c, column in enumerate(columns):
        for i, (name, p) in enumerate(probs.items()):
            rank = (F.col(f"_all_{c}") - 1) * F.lit(p)
            lo, hi = F.col(f"_{c}_{2 * i}"), F.col(f"_{c}_{2 * i + 1}")
            out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(f"{column}_{name}" if several else name))
    return found.select(*keys, *out)


def neighbours(df: DataFrame, keys: Sequence[str], order: str, point: Column, bucket: Column | None = None) -> DataFrame:
    """For each row the nearest non-null ``point`` at or before it, and at or after it, in ``order``.

    Columns ``_before`` and ``_after``. Windows run inside even ranges of the order, equal values in one of them; the last and first
    points of each range are carried over the ranges in between. ``bucket`` as in running_sum.
    """
    keys = list(keys)
    b = order_bucket(df, [order], key=F.struct(order)) if bucket is None else df.withColumn("_bucket", bucket)
    b = b.withColumn("_point", point)
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    b = b.withColumn(
        "_l", F.last("_point", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn(
        "_f", F.first("_point", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    )
    known = F.when(F.col("_point").isNotNull(), F.col(order))
    ends = b.groupBy(*keys, "_bucket").agg(
        F.max_by("_point", known).alias("_last"), F.min_by("_point", known).alias("_first")
    )
    over = Window.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(
        *keys, "_bucket",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_cl"),
        F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_cf"),
    )
    return _join_buckets(b, carried, [*keys, "_bucket"]).select(
        *df.columns, F.coalesce("_l", "_cl").alias("_before"), F.coalesce("_f", "_cf").alias("_after")
    )
