"""Resampling by weights: how often each distinct row is drawn, round by round, without ever drawing rows one by one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: Counts held at a time: rounds x distinct rows of one group.
CELLS = 1 << 20

Statistic = Callable[[np.ndarray, np.ndarray, np.ndarray, np.random.Generator], np.ndarray]


def best(counts: np.ndarray, value: np.ndarray, vote: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.where(counts > 0, value, -np.inf).max(axis=1)


def worst(counts: np.ndarray, value: np.ndarray, vote: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.where(counts > 0, value, np.inf).min(axis=1)


def mean(counts: np.ndarray, value: np.ndarray, vote: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return counts @ value / counts.sum(axis=1)


def majority(counts: np.ndarray, value: np.ndarray, vote: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Value of the most frequent vote; of equal ones the vote drawn first, and of its rows the one drawn first.

    Given how often each row was drawn, every order of the draws is as likely as any other. So among equal votes each is first with
    the same chance, and among a vote's rows each in proportion to its count.
    """
    order = np.argsort(vote, kind="stable")
    counts, value, vote = counts[:, order], value[order], vote[order]
    begins = np.flatnonzero(np.concatenate([[True], vote[1:] != vote[:-1]]))
    votes = np.add.reduceat(counts, begins, axis=1)
    tied = votes == votes.max(axis=1, keepdims=True)
    won = np.where(tied, rng.random(tied.shape), -1.0).argmax(axis=1)
    ends = np.append(begins[1:], len(vote))
    # The first drawn row of the winning vote: a place among its draws.
    upto = np.cumsum(counts, axis=1)
    rounds = np.arange(len(counts))
    before = np.where(begins[won] > 0, upto[rounds, begins[won] - 1], 0)
    place = before + (rng.random(len(counts)) * votes[rounds, won]).astype(np.int64)
    row = (upto <= place[:, None]).sum(axis=1)
    return value[np.minimum(row, ends[won] - 1)]


STATISTICS: dict[str, Statistic] = {"best": best, "worst": worst, "mean": mean, "maj": majority}


def sizes_of(m: int) -> list[int]:
    """2, 4, 8, ... below the number of rows, and that number."""
    return [n for k in range(1, 64) if (n := 1 << k) < m] + [m]


def _generator(seed: int, label: str) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.md5(f"{seed}:{label}".encode()).digest(), "little")))


def extremes(value: np.ndarray, weight: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest of n draws in every round, without the draws between them.

    A draw is the quantile of a uniform number, so the largest draw is that of the largest of n of them, which is the n-th root of
    one; the others lie evenly below it, and the smallest of these follows likewise. Both have the joint chances that drawn rows have.
    """
    order = np.argsort(value, kind="stable")
    upto = np.cumsum(weight[order])
    high = np.exp(np.log1p(-rng.random(rounds)) / n)
    low = high * -np.expm1(np.log1p(-rng.random(rounds)) / (n - 1)) if n > 1 else high
    top, bottom = (np.minimum(np.searchsorted(upto, u * upto[-1], "right"), len(value) - 1) for u in (high, low))
    return value[order[top]], value[order[bottom]]


def drawn(share: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """How often each distinct row is drawn, by round. Few draws are made one by one; many by numpy's multinomial counts, a chain of
    conditional binomials, one for each distinct row, whatever n is."""
    if n > len(share):
        return rng.multinomial(n, share, size=rounds)
    picked = np.minimum(np.searchsorted(np.cumsum(share), rng.random((rounds, n)), "right"), len(share) - 1)
    picked += len(share) * np.arange(rounds)[:, None]
    return np.bincount(picked.ravel(), minlength=rounds * len(share)).reshape(rounds, -1)


def resampled(
    value: np.ndarray, vote: np.ndarray, weight: np.ndarray, n: int, rounds: int, rng: np.random.Generator, statistics: Mapping[str, Statistic]
) -> dict[str, tuple[float, float]]:
    """Mean and deviation over rounds of each statistic of n draws with replacement. Where only the extremes are asked for, only
    they are drawn."""
    if all(fn in (best, worst) for fn in statistics.values()):
        top, bottom = extremes(value, weight, n, rounds, rng)
        return {name: (float(x.mean()), float(x.std())) for name, fn in statistics.items() for x in [top if fn is best else bottom]}
    share = weight / weight.sum()
    got: dict[str, list[np.ndarray]] = {name: [] for name in statistics}
    step = max(1, CELLS // len(value))
    for at in range(0, rounds, step):
        counts = drawn(share, n, min(step, rounds - at), rng)
        for name, fn in statistics.items():
            got[name].append(fn(counts, value, vote, rng))
    return {name: (float(x.mean()), float(x.std())) for name, parts in got.items() for x in [np.concatenate(parts)]}


def bootstrap_by_weights(
    df: DataFrame, keys: Sequence[str], value: str, *, vote: str | None = None, names: Sequence[str] = ("best", "worst"),
    sizes: Callable[[int], Sequence[int]] = sizes_of, rounds: int = 1000, seed: int = 42, extra: Mapping[str, Statistic] | None = None,
) -> DataFrame:
    """Mean and deviation, over ``rounds`` resamples of every size n, of statistics of a group's rows: one row per group and n.

    ``names`` picks from best, worst, mean and maj (the value of the most frequent ``vote``), or from ``extra``, functions of (counts by
    round and distinct row, values, votes, generator). Rows with a null value are left out; a null vote is a vote like any other.

    Rows that agree in value and vote are counted before anything moves. Then a group is one row of distinct pairs with their counts,
    and cost and memory follow these, not the rows and not n. Random numbers are drawn from the seed, the group and n, so results do
    not depend on partitions. A group's distinct pairs come together in one task: votes and scores of one prompt.
    """
    keys = list(keys)
    statistics = {name: (extra or {}).get(name) or STATISTICS[name] for name in names}
    vote_of: Column = F.col(vote).cast("string") if vote else F.lit(None).cast("string")
    pairs = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value"), vote_of.alias("_vote")).agg(F.count(F.lit(1)).alias("_weight"))
    label = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    groups = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_value", "_vote", "_weight"))).alias("_pairs")).withColumn("_label", label)
    key_fields = [df.schema[k] for k in keys]
    schema = StructType([*key_fields, StructField("n", LongType()), StructField("rounds", IntegerType()),
                         *[StructField(f"{name}_{s}", DoubleType()) for name in names for s in ("mean", "std")]])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for g in range(batch.num_rows):
                held = batch.column(len(keys)).slice(g, 1).flatten()
                label_ = batch.column(len(keys) + 1)[g].as_py()
                x = np.asarray(held.field("_value"), np.float64)
                votes = held.field("_vote").dictionary_encode("encode")
                v, w = np.asarray(votes.indices), np.asarray(held.field("_weight"), np.int64)
                for n in sizes(int(w.sum())):
                    found = resampled(x, v, w, n, rounds, _generator(seed, f"{label_}:{n}"), statistics)
                    at.append(g)
                    rows.append((n, rounds, *[s for name in names for s in found[name]]))
            columns = list(zip(*rows)) or [()] * (2 + 2 * len(names))
            picked = batch.take(pa.array(at, pa.int64()))
            arrays = [picked.column(i) for i in range(len(keys))]
            arrays += [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, schema_names)

    schema_names = schema.names
    return groups.select(*keys, "_pairs", "_label").mapInArrow(draw, schema)
