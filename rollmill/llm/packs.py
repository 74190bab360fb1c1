"""Packs of documents and the exchange of 64-bit or 128-bit keys between them, shared by the operators that look for repeated passages.

A pack is one row that holds some documents (a bounded number of bytes, or one document), so that tasks work on flat arrays. Packs
are written once, bucketed by their number: later passes join what they learnt about a pack without moving its texts. Texts stay
compressed until a task comes to their pack: Spark reads, joins and hands over many packs at a time, Python opens one after the other.

An exchange asks which keys of a pack also occur in another one. A pack sends each of its distinct keys once, to the partition
that the key names, and gets back one bit for each. So a key with a third of all rows costs one entry per pack that holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from rollmill.llm.arrays import distinct, slices, text_bytes
from rollmill.llm.staging import quoted, shared_path, shuffle_parts

PACK_BYTES = 2 << 20
#: Bytes of text that a task puts into one bucket before it goes on to the next.
BUCKET_BYTES = 48 << 20
#: Bytes of packs in one row group, about: a reader holds a row group, a writer too.
GROUP_BYTES = 8 << 20
#: Keys in one partition of an exchange, about.
PART_KEYS = 1 << 20


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    """The bucket that Spark gives to longs (Murmur3, seed 42, of the low and the high half)."""
    rotated = lambda v, by: v << np.uint32(by) | v >> np.uint32(32 - by)
    h = np.full(len(x), 42, np.uint32)
    for half in (x & 0xFFFFFFFF, x >> 32):
        h = rotated(h ^ rotated(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(times)
    return h.astype(np.int32).astype(np.int64) % n


class _Numbers:
    """Numbers of a task's packs, all of one bucket until the next turn."""

    def __init__(self, task: int, n_buckets: int) -> None:
        self.at, self.bucket, self.n, self.ready = task << 32, task % n_buckets, n_buckets, []

    def turn(self) -> None:
        self.bucket, self.ready = (self.bucket + 1) % self.n, []

    def take(self) -> int:
        while not self.ready:
            some = np.arange(self.at, self.at + 16 * self.n)
            self.at += 16 * self.n
            self.ready = some[_bucket(some, self.n) == self.bucket].tolist()
        return self.ready.pop(0)


def pack(docs: DataFrame, id_col: str, text_col: str, purpose: str) -> tuple[DataFrame, int]:
    """Packs (pack, size, ids, texts compressed) in a bucketed table below the shared folder, and the bytes of all texts.

    A task's packs get numbers of one bucket, so that it writes one file; a task of more than BUCKET_BYTES goes on to the next bucket,
    so that no later task gets all it has read. The catalogue forgets the table at once; its files stay.
    """
    spark = docs.sparkSession
    n_buckets = shuffle_parts(spark)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = _Numbers(TaskContext.get().partitionId(), n_buckets), 0
        for part in slices(batches, "_text", PACK_BYTES):
            offsets, data = text_bytes(part.column(1))
            if held + len(data) > BUCKET_BYTES:
                numbers.turn()
                held = 0
            held += len(data)
            whole = pa.array([0, part.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([numbers.take()], pa.int64()), pa.array([len(data)], pa.int64()), pa.ListArray.from_arrays(whole, part.column(0)),
                 pa.array([_closed(offsets, data)], pa.binary())],
                ["pack", "size", "ids", "texts"],
            )

    d = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"))
    schema = StructType.fromDDL("pack long, size long, texts binary").fields
    rows = d.mapInArrow(packed, StructType([*schema[:2], StructField("ids", ArrayType(docs.schema[id_col].dataType)), schema[2]]))
    name = f"{purpose}_{uuid.uuid4().hex}"
    # By itself Parquet looks at the size of a row group after every hundred rows only.
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
    rows.write.bucketBy(n_buckets, "pack").options(compression="zstd", path=shared_path(spark, purpose), **groups).saveAsTable(name)
    packs = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return packs, packs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def _closed(offsets: np.ndarray, data: np.ndarray) -> bytes:
    """The ends of a pack's texts and their bytes, compressed."""
    return pa.Codec("zstd", 3).compress(np.concatenate([offsets[1:].astype("<i8").view(np.uint8), data]), asbytes=True)


def _opened(texts: pa.Buffer, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a pack's n texts."""
    raw = pa.Codec("zstd").decompress(texts, 8 * n + size)
    return np.concatenate([[0], np.frombuffer(raw, "<i8", n)]), np.frombuffer(raw, np.uint8, size, 8 * n)


def each_pack(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, dict]]:
    """Number, ids, offsets, bytes and the other columns of every pack in a batch."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        ids = row.column(names.index("ids")).flatten()
        offsets, data = _opened(row.column(names.index("texts"))[0].as_buffer(), len(ids), row.column(names.index("size"))[0].as_py())
        rest = {n: row.column(k).to_pylist()[0] for k, n in enumerate(names) if n not in ("pack", "size", "ids", "texts")}
        yield row.column(names.index("pack"))[0].as_py(), ids, offsets, data, rest


def parts_for(keys: int, floor: int) -> int:
    return max(floor, -(-keys // PART_KEYS))


def _dealt(keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct sorted keys by part, and where each part begins."""
    part = ((keys >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n_parts + 1))


def sent(pack_no: int, keys: np.ndarray, n_parts: int, width: int, more: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Rows (pack, part, keys) for a pack's distinct sorted keys, of which the low ``width`` bytes travel.

    With ``more``, the second halves of keys of 128 bits, all 16 bytes do; keys are sorted by their first halves then.
    """
    order, bounds = _dealt(keys, n_parts)
    used = np.flatnonzero(np.diff(bounds))
    if not len(used):
        return None
    low = keys[order].astype(f"<u{width}") if more is None else np.stack([keys[order], more[order]], axis=1).astype("<u8")
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(used), pack_no)), pa.array(used, pa.int32()), pa.array([low[bounds[p] : bounds[p + 1]].tobytes() for p in used], pa.binary())],
        ["pack", "part", "keys"],
    )


SENT = "pack long, part int, keys binary"


def answered(keys: np.ndarray, n_parts: int, answers: list[dict] | None) -> np.ndarray:
    """The bits that came back, in the order of the pack's distinct sorted keys."""
    out = np.zeros(len(keys), bool)
    if answers:
        order, bounds = _dealt(keys, n_parts)
        for a in answers:
            here = order[bounds[a["part"]] : bounds[a["part"] + 1]]
            out[here] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=len(here)).astype(bool)
    return out


def pair_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order in which equal keys of two halves stand together. First halves decide unless some clash."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    clash = (a[1:] == a[:-1]) & (b[1:] != b[:-1])
    return np.lexsort((second, first)) if clash.any() else order


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys of two halves: one place of each distinct key, which of them each key is, and how often each occurs."""
    order = pair_order(first, second)
    a, b = first[order], second[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.cumsum(fresh) - 1
    back = np.empty(len(order), np.int64)
    back[order] = number
    return order[fresh], back, np.bincount(number, minlength=int(fresh.sum()))


def _shared_pairs(got: list[np.ndarray]) -> list[np.ndarray]:
    """For the keys of several packs (n x 2, distinct within a pack): which of each another pack holds."""
    everything = np.concatenate(got)
    _, back, count = distinct_pairs(everything[:, 0], everything[:, 1])
    return np.split(count[back] > 1, np.cumsum([len(k) for k in got])[:-1])


def _shared(got: list[np.ndarray]) -> Iterator[np.ndarray]:
    everything = np.concatenate(got)
    everything.sort()
    twice = distinct(everything[1:][everything[1:] == everything[:-1]])
    for keys in got:
        at = np.searchsorted(twice, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(twice)
        hit[inside] = twice[at[inside]] == keys[inside]
        yield hit


def shared_keys(rows: DataFrame, n_parts: int, width: int) -> DataFrame:
    """For rows (pack, part, keys): per pack, the answers (part, bits) which of its keys another pack has sent too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            for pack_no, part, keys in zip(*(c.to_pylist() for c in batch.columns)):
                flat = np.frombuffer(keys, f"<u{min(width, 8)}")
                held.setdefault(part, []).append((pack_no, flat.reshape(-1, 2) if width == 16 else flat))
        while held:
            part, got = held.popitem()
            packs, bits = [], []
            for (pack_no, _), hit in zip(got, (_shared_pairs if width == 16 else _shared)([k for _, k in got])):
                if hit.any():
                    packs.append(pack_no)
                    bits.append(np.packbits(hit).tobytes())
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([part] * len(packs), pa.int32()), pa.array(bits, pa.binary())], ["pack", "part", "bits"])

    return rows.repartitionById(n_parts, F.col("part")).mapInArrow(compare, "pack long, part int, bits binary")


def per_pack(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("pack").agg(F.collect_list(F.struct("part", "bits")).alias(name))


def with_answers(packs: DataFrame, *answers: DataFrame, how: str = "left") -> DataFrame:
    """The packs with what came back for them; the answers move, the packs don't."""
    for a in answers:
        packs = packs.join(a.hint("shuffle_hash"), "pack", how)
    return packs
