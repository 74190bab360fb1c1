"""Row and column algebra on batches. A batch is a DataFrame with an explicit key; position is always derived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollmill.operators.keyed import hash_order, hash_positions, positions, scalars


def batch_from_dict(spark: SparkSession, data: dict[str, Sequence], schema: str) -> DataFrame:
    """A batch from equally long columns."""
    lengths = {k: len(v) for k, v in data.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"columns differ in length: {lengths}")
    return spark.createDataFrame(list(zip(*data.values())), schema)


def batch_select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def batch_pop(df: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The popped columns and the rest; both keep the key, so they can be joined again."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.select(key, *columns), df.drop(*columns)


def batch_rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def batch_select_idxs(df: DataFrame, key: str, chosen: DataFrame, order: str) -> DataFrame:
    """Rows whose key is listed in ``chosen`` (columns ``key`` and ``order``), with their place in the list."""
    return df.join(chosen.select(key, order), key)


def batch_mask(df: DataFrame, keep: Column) -> DataFrame:
    return df.where(keep)


def batch_slice(df: DataFrame, key: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python slice by position in key order, bounds counted from the end when negative."""
    if step <= 0:
        raise ValueError("step must be positive")
    numbered = positions(df, key)
    if start < 0 or (stop is not None and stop < 0):
        numbered = numbered.withColumn("_n", scalars(df, F.count(F.lit(1)).alias("n"))["n"])
    else:
        numbered = numbered.withColumn("_n", F.lit(0))
    lo = F.greatest(F.lit(start) + (F.col("_n") if start < 0 else 0), F.lit(0))
    keep = (F.col("pos") >= lo) & (F.pmod(F.col("pos") - lo, F.lit(step)) == 0)
    if stop is not None:
        keep = keep & (F.col("pos") < F.lit(stop) + (F.col("_n") if stop < 0 else 0))
    return numbered.where(keep).drop("_n")


def batch_union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Merge the columns of two batches row by row; a shared column must hold equal values or the job fails."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in shared})
    out = left.join(other, key)
    for c in shared:
        clash = F.raise_error(F.concat(F.lit(f"column {c} differs at key "), F.col(key).cast("string")))
        same = F.col(c).eqNullSafe(F.col(f"_other_{c}"))
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(clash.cast(left.schema[c].dataType)))
    return out.drop(*[f"_other_{c}" for c in shared])


def batch_concat(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def batch_reorder(df: DataFrame, permutation: DataFrame, key: str, new_pos: str = "new_pos") -> DataFrame:
    """Give each row its place in a permutation table (columns ``key`` and ``new_pos``)."""
    return df.join(permutation.select(key, new_pos), key)


def inverse_permutation(permutation: DataFrame, key: str, new_pos: str) -> DataFrame:
    return permutation.select(F.col(new_pos).alias(key), F.col(key).alias(new_pos))


def batch_repeat(df: DataFrame, times: int, key: str, *, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times, with its new position: aabbcc when interleaved, abcabc when tiled."""
    numbered = positions(df, key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        place = F.col("pos") * times + F.col("rep")
    else:
        place = F.col("rep") * scalars(df, F.count(F.lit(1)).alias("n"))["n"] + F.col("pos")
    return numbered.withColumn("new_pos", place).drop("pos")


def batch_chunk(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """Equal contiguous chunks in key order; the job fails when the rows do not divide evenly."""
    n = scalars(df, F.count(F.lit(1)).alias("n"))["n"]
    numbered = positions(df, key).withColumn("_n", n)
    uneven = F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(f" rows do not divide into {chunks} chunks")))
    size = F.when(F.col("_n") % chunks == 0, F.expr(f"_n div {chunks}")).otherwise(uneven.cast("bigint"))
    return numbered.withColumn("_size", size).withColumn("chunk", F.expr("pos div _size")).drop("_n", "_size")


def pad_to_divisor(df: DataFrame, key: str, divisor: int) -> DataFrame:
    """Append copies of the leading rows, cycling, until the row count divides; copies carry ``is_pad``."""
    numbered = positions(df, key).withColumn("_n", scalars(df, F.count(F.lit(1)).alias("n"))["n"])
    pads = F.pmod(-F.col("_n"), F.lit(divisor))
    copies = F.when(F.col("pos") < pads, F.floor((pads - 1 - F.col("pos")) / F.col("_n")) + 1).otherwise(0)
    out = numbered.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies.cast("bigint"))))
    return (
        out.withColumn("pos", F.col("pos") + F.col("_copy") * F.col("_n"))
        .withColumn("is_pad", F.col("_copy") > 0).drop("_n", "_copy")
    )


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def fold(df: DataFrame, key: str, value: Sequence[str], size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Arrays of ``size`` consecutive rows (the last may be shorter), in key order, within ``keys``."""
    numbered = positions(df, key, "_pos", keys).withColumn("chunk", F.floor(F.col("_pos") / size))
    packed = F.array_sort(F.collect_list(F.struct("_pos", key, *value)))
    grouped = numbered.groupBy(*keys, "chunk").agg(packed.alias("_rows"))
    return grouped.select(*keys, "chunk", *[F.col("_rows")[c].alias(c) for c in (key, *value)])


def unfold(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("pos", "_row"))
    return zipped.select(*keys, "pos", *[F.col(f"_row.{c}").alias(c) for c in columns])


def epoch_batches(
    df: DataFrame, key: str, size: int, epochs: int, seed: int, *, shuffle: bool = True
) -> DataFrame:
    """Batches of ``size`` per epoch, in seeded or key order; an incomplete last batch is dropped."""
    n = scalars(df, F.count(F.lit(1)).alias("n"))["n"]
    if shuffle:
        each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        ranked = hash_positions(
            each, key, F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string")), "rank", ["epoch"]
        )
    else:
        ranked = positions(df, key, "rank").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ranked = ranked.withColumn("batch", F.expr(f"rank div {size}")).withColumn("_n", n)
    return ranked.where(F.col("batch") < F.expr(f"_n div {size}")).drop("_n")


def resume_from_snapshot(ranked: DataFrame, yielded: int) -> DataFrame:
    """What is left of an ordering after ``yielded`` samples."""
    return ranked.where(F.col("rank") >= yielded)


def shard_round_robin(df: DataFrame, key: str, world: int, seed: int) -> DataFrame:
    """Equal disjoint shares of a seeded order; a remainder that cannot be shared is dropped."""
    ranked = hash_positions(df, key, str(seed)).withColumn("_n", scalars(df, F.count(F.lit(1)).alias("n"))["n"])
    kept = ranked.where(F.col("rank") < F.expr(f"_n div {world}") * world)
    return kept.withColumn("shard", F.pmod("rank", F.lit(world)).cast("int")).drop("_n")


def split_fixed_count(df: DataFrame, key: str, n_train: int, seed: int) -> DataFrame:
    """Seeded shuffle; the first ``n_train`` rows are the training split."""
    ranked = hash_positions(df, key, str(seed))
    return ranked.withColumn("split", F.when(F.col("rank") < n_train, "train").otherwise("test"))


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of a seeded order, as a top-k that every task pre-trims."""
    return df.orderBy(hash_order(F.col(key), str(seed)), key).limit(n)


def sample_first_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows per key. Spark trims each task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
