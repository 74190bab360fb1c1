"""Streaming forms of the incremental behaviours. Each transformation also runs on a static DataFrame.

State is kept as aggregates, never as buffered rows, so it stays small per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from rollmill.operators.credit import kl_updates
from rollmill.session import scratch_dir


def stream_parquet(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_rollout_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rollout records as their files land, from JSON lines; the checkpoint remembers which files are done. For files that hold one
    array each see ``read_rollout_arrays(stream=True)``."""
    return spark.readStream.schema(schema).json(folder)


def step_metrics(df: DataFrame, time: str, value: str, keys: Sequence[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and mean per event-time window; rows later than ``late`` behind the newest are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return df.withWatermark(time, late).groupBy(window, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )


class Ending(NamedTuple):
    """When a key is over: it had no row for longer than ``silence`` of its event time, and the watermark has passed that.

    A key then gives its row, once (append mode), and its state goes. Should it speak again later, that is a new stretch with a row
    of its own, told apart by ``since``. Rows later than ``late`` are dropped; rows without a time belong to no stretch.
    """

    time: str
    silence: str
    late: str = "1 hour"

    def watermarked(self, df: DataFrame) -> DataFrame:
        return df.withWatermark(self.time, self.late)

    def stretch(self) -> Column:
        return F.session_window(self.time, self.silence).alias("stretch")


def _per_key(df: DataFrame, keys: Sequence[str], ends: Ending | None, *aggregates: Column) -> DataFrame:
    """Aggregates per key: of each stretch of activity once it is over, or, without ends, running ones kept for the life of the stream."""
    if ends is None:
        return df.groupBy(*keys).agg(*aggregates)
    return ends.watermarked(df).groupBy(ends.stretch(), *keys).agg(*aggregates).withColumn("since", F.col("stretch.start")).drop("stretch")


def _since(ends: Ending | None) -> list[str]:
    return ["since"] if ends else []


def replay_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], *, ends: Ending | None) -> DataFrame:
    """The newest values per key over replayed steps, as a running maximum."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return _per_key(df, keys, ends, last).select(*keys, *_since(ends), *[F.col("_last")[v].alias(v) for v in values])


def replay_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], *, ends: Ending | None) -> DataFrame:
    """The earliest values per key in ``order``, as a running minimum; the order in which rows arrive does not matter."""
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_first")
    return _per_key(df, keys, ends, first).select(*keys, *_since(ends), *[F.col("_first")[v].alias(v) for v in values])


def replay_drop_repeats(df: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark, whichever comes first; a key's state goes once the watermark has passed it."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def complete_groups(df: DataFrame, keys: Sequence[str], score: str, expected: int, *, ends: Ending | None) -> DataFrame:
    """Mean and deviation of each prompt group that got all expected responses: when it is over, or, without ends, as soon as they are there."""
    return _per_key(
        df, keys, ends, F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std")
    ).where(F.col("n") >= expected)


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A key as text: pandas turns whole numbers into floating ones where nulls stand among them."""
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    return (F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string"))


def _from_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c.cast("long"))
    return F.unbase64(c) if isinstance(kind, T.BinaryType) else c.cast(kind)


def _packed(pdf: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


def _advance(
    open_: pd.DataFrame, rows: pd.DataFrame, keys: list[str], expected: int, patience_us: int, watermark: int
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows to give and the groups that stay open, after rows that the watermark has passed. All groups advance together.

    A stretch is a group's rows without a silence of more than the patience. The open groups are stretches begun earlier.
    """
    m = len(open_)
    every = pd.concat([open_[keys], rows[keys]], ignore_index=True)
    group = every.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if len(every) else np.zeros(0, np.int64)
    own = np.full(len(every), -1)  # the open stretch of a group
    own[group[:m]] = np.arange(m)
    rows = rows.assign(_group=group[m:], _at=m + np.arange(len(rows))).sort_values(["_group", "_us", "_tie"], kind="stable")
    g, us, value = (rows[c].to_numpy() for c in ("_group", "_us", "_score"))
    newest = open_["newest"].to_numpy(np.int64)
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    follows = ~first | (own[g] >= 0)
    before = np.concatenate([[0], us[:-1]]) if len(us) else us
    before = np.where(first & follows, newest[own[g]] if m else 0, before)
    new = ~follows | (us - before > patience_us)
    count = np.cumsum(new)
    begin = np.flatnonzero(first)
    earlier = np.repeat(count[begin] - new[begin], np.diff(np.append(begin, len(g))))
    stretch = np.where(count > earlier, m + count - 1, own[g])
    n_all = m + int(new.sum())
    opened = np.concatenate([open_["opened"].to_numpy(np.int64), us[new]])
    n0 = np.concatenate([open_["n"].to_numpy(np.int64), np.zeros(n_all - m, np.int64)])
    total = np.concatenate([open_["total"].to_numpy(np.float64), np.zeros(n_all - m)])
    newest = np.concatenate([newest, us[new]])
    np.maximum.at(newest, stretch, us)
    starts = np.ones(len(g), bool)
    starts[1:] = stretch[1:] != stretch[:-1]
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(starts, np.arange(len(g)), 0))
    taken = n0[stretch] + place < expected
    n = n0 + np.bincount(stretch[taken], minlength=n_all)
    np.add.at(total, stretch[taken], value[taken])  # one after the other, so that the cut into micro-batches tells nothing
    closed = (newest + patience_us) // 1000 < watermark
    over = np.flatnonzero(new & follows)
    closed[np.where(first[over], own[g[over]], stretch[over - 1])] = True
    complete = (n0 < expected) & (n == expected)
    named = every.iloc[np.concatenate([np.arange(m), rows["_at"].to_numpy()[new]]).astype(np.int64)].reset_index(drop=True)
    give = complete | (closed & (n < expected))
    given = named[give].assign(opened=opened[give], n=n[give], mean=total[give] / n[give], complete=complete[give])
    return given, named[~closed].assign(opened=opened[~closed], newest=newest[~closed], n=n[~closed], total=total[~closed])


def complete_groups_with_timer(
    df: DataFrame, keys: Sequence[str], time: str, tie: str, score: str, expected: int, *, patience_ms: int, late: str, slots: int = 1 << 12
) -> DataFrame:
    """One row per prompt group: its first ``expected`` responses, or, flagged, fewer once it was silent for too long.

    Responses count in the order of ``time`` and ``tie``, and only once the watermark has passed them, so how the input is
    cut into micro-batches does not change the result. Further responses of a complete group are ignored until it has
    been silent for ``patience_ms``; a group that speaks again after such a silence is a new one (column ``opened``).

    State per group is a count, a sum and two times, and the responses newer than the watermark. It is dropped after the silence.
    Groups whose keys hash to one of ``slots`` share a state, and advance together as arrays: a Python call costs far more than a group.
    A batch rewrites the slots it touches, so raise their number with that of groups open at a time. It is part of a checkpoint.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    kinds = [df.schema[k].dataType for k in keys]
    out = T.StructType([
        *[T.StructField(c, T.StringType()) for c in names], T.StructField("opened", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()), T.StructField("complete", T.BooleanType()),
    ])
    patience_us = patience_ms * 1000
    columns = [*names, "_us", "_tie", "_score"]
    nothing = pd.DataFrame({**{c: pd.Series(dtype=object) for c in names}, **{c: pd.Series(dtype="int64") for c in ("opened", "newest", "n")}, "total": pd.Series(dtype="float64")})

    def update(key, frames, state):
        open_, waiting = map(_unpacked, state.get) if state.exists else (nothing, None)
        new = [f for f in (waiting, *[pdf[columns] for pdf in frames]) if f is not None and len(f)]
        watermark = max(state.getCurrentWatermarkMs(), 0)
        rows = pd.concat(new, ignore_index=True) if new else pd.DataFrame({c: nothing["opened"] for c in columns})
        ready = (rows["_us"] // 1000 < watermark).to_numpy(bool)
        given, open_ = _advance(open_, rows[ready], names, expected, patience_us, watermark)
        waiting = rows[~ready]
        if len(open_) or len(waiting):
            state.update((_packed(open_), _packed(waiting)))
            due = [int(x.min()) for x in (waiting["_us"] // 1000, (open_["newest"] + patience_us) // 1000) if len(x)]
            state.setTimeoutTimestamp(max(min(due), watermark + 1))
        elif state.exists:
            state.remove()
        if len(given):
            yield given

    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("_slot")
    narrow = df.withWatermark(time, late).select(
        slot, *[_as_text(F.col(k), t).alias(c) for k, t, c in zip(keys, kinds, names)], time, F.col(tie).alias("_tie"),
        F.col(score).cast("double").alias("_score"), F.unix_micros(time).alias("_us"),
    )
    grouped = narrow.groupBy("_slot").applyInPandasWithState(update, out, "open binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    return grouped.select(*[_from_text(F.col(c), t).alias(k) for k, t, c in zip(keys, kinds, names)], F.timestamp_micros("opened").alias("opened"), "n", "mean", "complete")


def adaptive_kl(
    df: DataFrame, keys: Sequence[str], kl: str, n_steps: Column, *, init: float, target: float, horizon: float, ends: Ending | None
) -> DataFrame:
    """The coefficient of each run after its updates: when the run is over, or, without ends, after each update."""
    return _per_key(df, keys, ends, *kl_updates(kl, n_steps, init=init, target=target, horizon=horizon))


def session_activity(df: DataFrame, time: str, keys: Sequence[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Segments of activity per key, separated by ``gap`` without rows; in append mode each is given once, when it is over."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Process everything available now and return the final state of each key.

    Micro-batches are written below the shared scratch folder under their number, so a repeated batch replaces
    itself. In update mode the newest version of each key is kept, in complete mode the newest batch, in append
    mode every row.
    """
    spark = stream.sparkSession
    out = scratch_dir(spark, "stream")
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/_batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if mode == "append":
        return rows.drop("_batch")
    if mode == "complete":
        return rows.where(F.col("_batch") == rows.agg(F.max("_batch")).scalar()).drop("_batch")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_newest"))
    return newest.select(*keys, *[F.col("_newest")[c].alias(c) for c in rest])
