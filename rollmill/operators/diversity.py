"""Similarity of the responses to one prompt, from their embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.tokens import array_sum
from rollmill.operators.keyed import attach_group_stats

CHUNK_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def group_similarity(
    df: DataFrame, keys: Sequence[str], key: str, embedding: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Mean and population deviation of the cosine over all unordered pairs of a group, and their number.

    No pair is formed. For unit vectors the pair sum follows from the sum vector, and the sum of squared pair
    similarities from the matrix sum(v v'): both are sums over rows. Tasks reduce a bounded chunk of a group at
    a time; a group larger than ``chunk_rows`` is cut by hash and its partial sums are added up entry by entry. A
    group of one chunk needs no sum over chunks and leaves its task as five numbers, so that many small groups
    shuffle no matrices.
    """
    keys = list(keys)
    rows = df.select(*keys, key, F.col(embedding).alias("_v"))
    sized = attach_group_stats(rows, keys, F.count(F.lit(1)).alias("_n"), salt=[key])
    cut = sized.withColumn("_chunks", F.ceil(F.col("_n") / chunk_rows).cast("int")).withColumn(
        "_chunk", F.pmod(F.xxhash64(key), F.col("_chunks")).cast("int")
    )

    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["_v"].to_numpy()).astype("float64")
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        own = (v * v).sum(axis=1)
        sums = [len(v), own.sum(), (own * own).sum()]
        total = v.sum(axis=0)
        if int(pdf["_chunks"].iloc[0]) == 1:
            # v'v and vv' have the same squared norm; the smaller one is formed.
            gram = v @ v.T if len(v) < v.shape[1] else v.T @ v
            entries = np.array([*sums, total @ total, (gram * gram).sum()])
        else:
            entries = np.concatenate([[*sums, 0.0, 0.0], total, (v.T @ v).ravel()])
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"_e": [entries]})

    parts = cut.groupBy(*keys, "_chunk").applyInPandas(reduce_chunk, f"{key_types}, _e array<double>")
    # Entries: rows, own norms, their squares, two finished squares, then d sums and d * d products.
    d = F.round((F.sqrt(4.0 * (F.size("_e") - 5) + 1) - 1) / 2).cast("int").alias("_d")
    summed = parts.select(*keys, d, F.posexplode("_e").alias("_i", "_x")).groupBy(*keys, "_i").agg(
        F.sum("_x").alias("_x"), F.max("_d").alias("_d")
    )
    i, x, at = F.col("_i"), F.col("_x"), F.col("_i") - 5
    first = [F.max(F.when(i == k, x)).alias(name) for k, name in enumerate(("n", "own", "own_sq", "_t", "_g"))]
    joined = summed.groupBy(*keys).agg(
        *first,
        F.coalesce(F.sum(F.when((at >= 0) & (at < F.col("_d")), x * x)), F.lit(0.0)).alias("_ts"),
        F.coalesce(F.sum(F.when((at >= 0) & (at >= F.col("_d")), x * x)), F.lit(0.0)).alias("_gs"),
    ).withColumns({"total_sq": F.col("_t") + F.col("_ts"), "gram_sq": F.col("_g") + F.col("_gs")})
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (F.col("total_sq") - F.col("own")) / 2 / pairs
    mean_sq = (F.col("gram_sq") - F.col("own_sq")) / 2 / pairs
    return joined.where("n > 1").select(
        *keys, mean.alias("mean_similarity"),
        F.sqrt(F.greatest(mean_sq - mean * mean, F.lit(0.0))).alias("std_similarity"), pairs.cast("bigint").alias("n_pairs"),
    )


def track_summary(df: DataFrame, track: str, value: str) -> DataFrame:
    return df.groupBy(track).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def compare_tracks(df: DataFrame, track: str, key: str, a: str, b: str) -> DataFrame:
    def side(name, suffix):
        return df.where(F.col(track) == name).select(key, F.col("mean_similarity").alias(f"similarity_{suffix}"))

    return side(a, "a").join(side(b, "b"), key).withColumn("delta", F.col("similarity_b") - F.col("similarity_a"))


def mean_pool(df: DataFrame, keys: Sequence[str], vectors: str, mask: str | None = None) -> DataFrame:
    """Unit-length mean of the (unmasked) token vectors of a group, in long form (dim, x).

    Vectors are summed entry by entry with map-side combine, so a group never meets in one task.
    """
    keys = list(keys)
    rows = df if mask is None else df.where(F.col(mask) > 0)
    entries = rows.select(*keys, F.posexplode(vectors).alias("dim", "_x"))
    means = entries.groupBy(*keys, "dim").agg((F.sum(F.col("_x").cast("double")) / F.count(F.lit(1))).alias("_m"))
    norms = means.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_norm"))
    return means.join(norms, keys).select(*keys, "dim", (F.col("_m") / F.greatest("_norm", F.lit(1e-12))).alias("x"))
