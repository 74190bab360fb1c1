"""Document fingerprints by a homomorphic multiset hash: paragraphs are hashed to wide vectors, and vectors are added."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from rollmill.llm.arrays import NOT_SPACE, Spans, mix, slices, text_bytes, word_hashes, words_of
from rollmill.llm.staging import shuffle_parts

#: A vector: 4 sums modulo 2**64 of paragraph digests, then 128 sums modulo 2**32 of signs of word shingles.
EXACT, SIGNS = 4, 128
SHINGLE = 5
#: Shingles whose signs are expanded at a time.
_PIECE = 1 << 16
_SEED = np.uint64(0x5851F42D4C957F2D)
_VECTOR = np.dtype([("exact", "<u8", EXACT), ("signs", "<u4", SIGNS)])


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every shingle and its text; starts and ends of the paragraphs (lines with a word), and their texts."""
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks, breaks + 1]))
    edges = edges[edges <= len(data)]
    starts, ends, first = words_of(edges, data, NOT_SPACE)
    n_words = np.diff(first)
    held = np.flatnonzero(n_words)
    codes = word_hashes(data, starts, ends)
    # One shingle at every word that has enough words behind it in its line, or one for a whole shorter line.
    count = np.maximum(n_words[held] - SHINGLE + 1, 1)
    at = np.repeat(first[held] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.repeat(np.minimum(n_words[held], SHINGLE), count)
    hashes = Spans(codes).hashes(at, at + size)
    text = np.searchsorted(offsets, edges[held], "right") - 1
    return hashes, np.repeat(text, count), np.stack([edges[held], edges[held + 1]], axis=1), text


def vectors(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The vector of each text, given as offsets and UTF-8 bytes: the sum of the vectors of its paragraphs.

    A paragraph is a line with a word in it. The exact part takes its SHA-256; the signs are +1 or -1 in each of 128 places for each
    of its five-word shingles (a shorter line is one shingle), so that squared distances of two vectors count unshared shingles.
    """
    n = len(offsets) - 1
    out = np.zeros(n, _VECTOR)
    hashes, of, lines, line_of = _shingles(data, offsets)
    raw = data.tobytes()
    if len(lines):
        digests = b"".join(hashlib.sha256(raw[a:b]).digest() for a, b in lines.tolist())
        owner, begins = np.unique(line_of, return_index=True)
        out["exact"][owner] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, EXACT), begins, axis=0, dtype=np.uint64)
    for a in range(0, len(hashes), _PIECE):
        h, o = hashes[a : a + _PIECE], of[a : a + _PIECE]
        wide = np.stack([mix(h ^ _SEED), mix(h + _SEED)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(h), SIGNS // 8), axis=1, bitorder="little")
        owner, begins, count = np.unique(o, return_index=True, return_counts=True)
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.uint32)
        out["signs"][owner] += 2 * ones - count[:, None].astype(np.uint32)
    return out


def added(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Vectors of the texts of a with the paragraphs of b inserted, or, with sign -1, deleted."""
    out = a.copy()
    for part in ("exact", "signs"):
        out[part] = a[part] + b[part] if sign > 0 else a[part] - b[part]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the estimated share of shingles that only one of two texts has; 0 to 1, and 1 for equal vectors."""
    x, y = a["signs"].view(np.int32).astype(float), b["signs"].view(np.int32).astype(float)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = 1 - ((x - y) ** 2).sum(axis=1) / np.where(both > 0, both, 1)
    equal = a.view(np.uint8).reshape(len(a), -1) == b.view(np.uint8).reshape(len(b), -1)
    return np.where(equal.all(axis=1), 1.0, np.clip(near, 0, 1))


def encoded(a: np.ndarray) -> list[str]:
    raw, size = a.tobytes(), _VECTOR.itemsize
    return [base64.b64encode(raw[i : i + size]).decode() for i in range(0, len(raw), size)]


def decoded(prints: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(base64.b64decode(p) for p in prints), _VECTOR)


def fingerprint_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the fingerprint of every row; no shuffle. Null and empty texts, and texts of blank lines, have the zero vector."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoded(vectors(*text_bytes(part.column(1)))), pa.string())], ["_id", "_print"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return d.mapInArrow(prints, f"_id {kind}, _print string").select(F.col("_id").alias(id_col), F.col("_print").alias("fingerprint"))


def _joined(data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts, each put together from one span (start, end) of every pair of arrays."""
    ends = np.concatenate([[0], np.cumsum(sum(b - a for a, b in spans))]).astype(np.int64)
    pieces = [data[a[i] : b[i]] for i in range(len(ends) - 1) for a, b in spans]
    return ends, np.concatenate(pieces or [data[:0]])


def edited_prints(offsets: np.ndarray, data: np.ndarray) -> dict[str, list | np.ndarray]:
    """For every text but the first, whose next is the text before it: its own and its edited vector, and what they are like.

    Only the lines from the cut on are taken out of the vector, and the new ones put in.
    """
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(begins[:-1], offsets)
    n, ends = np.diff(first), offsets[2:]
    cut = n[1:] // 2
    keep = begins[first[1:-1] + n[1:] - cut]
    taken = offsets[:-2], begins[first[:-2] + np.minimum(cut, n[:-1])]
    breaks = np.concatenate([[-1], np.flatnonzero(data == 10)])
    line = np.maximum(breaks[np.searchsorted(breaks, keep) - 1] + 1, offsets[1:-1])

    vector = vectors(offsets, data)
    mine = vector[1:]
    old = vectors(*_joined(data, (line, ends)))
    after = added(added(mine, old, -1), vectors(*_joined(data, (line, keep), taken)))
    sha = [hashlib.sha256(data[a:b].tobytes() + data[c:d].tobytes()).hexdigest() for a, b, c, d in zip(offsets[1:-1], keep, *taken)]
    return {"n_chars": n[1:], "edited_sha256": sha, "fingerprint": encoded(mine), "edited_fingerprint": encoded(after),
            "near_edited": likeness(mine, after), "near_next": likeness(mine, vector[:-1])}


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, and that of its text after an edit: the last floor(n_chars / 2) code points give way to the first as
    many (or all) of the next row, in descending order of ids; the next of the last row is the first.

    Columns: the id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (base64 of 4 sums modulo 2**64 and 128
    modulo 2**32, little-endian), near_edited and near_next: the likeness of the fingerprint to the edited text's and the next row's.

    Null texts are empty. Rows of one id follow each other by the hash of their text, descending; so repeated rows are each other's
    next. Null ids come last. A single row is its own next. Other columns are dropped whatever their names; an empty table gives an
    empty result. Ids may be integers or strings. A very long text is held by one task, with some ten times its size.

    A first job reads ids and hashes of texts only and finds the greatest key of each of ``spark.sql.shuffle.partitions`` ranges: so
    many keys, whatever the table holds, are all that reaches the driver. Then whole texts move once, into their range; the greatest
    row of a range goes into the range above as well, whose least row is followed by it. A task streams its range in ascending order.
    Rows repeated as they are share a range.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    d = d.withColumn("_hash", F.xxhash64("_text"))
    keys = d.select("_id", "_hash").repartitionByRange(shuffle_parts(spark), F.col("_id").asc_nulls_first(), "_hash")
    greatest = keys.groupBy(F.spark_partition_id()).agg(F.max(F.struct("_id", "_hash")).alias("key")).select("key.*").distinct().collect()
    key_of = lambda i, h: (i is not None, i if i is not None else 0, h)
    cuts = sorted(key_of(*r) for r in greatest)
    n_ranges = max(len(cuts), 1)

    @F.arrow_udf(ArrayType(IntegerType()))
    def ranges(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The range of a row, and the one above too if the row is the greatest of its range."""
        out = []
        for key in map(key_of, ids.to_pylist(), hashes.to_pylist()):
            at = bisect_left(cuts, key)
            out.append([at, (at + 1) % n_ranges] if cuts[at] == key else [at])
        return pa.array(out, pa.list_(pa.int32()))

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before = -1, None
        for part in slices(batches, "_text"):
            numbers, lent = np.asarray(part.column(2)), np.asarray(part.column(3))
            bounds = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), part.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if numbers[a] != number:
                    number, before = numbers[a], None
                own = a + int(lent[a:b].sum())
                if own > a:
                    before = part.slice(own - 1, 1)
                if own < b:
                    rows = pa.concat_batches([before, part.slice(own, b - own)])
                    got = edited_prints(*text_bytes(rows.column(1)))
                    before = part.slice(b - 1, 1)
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(1), *[pa.array(v) for v in got.values()]], ["_id", *got])

    dealt = d.select("_id", "_hash", "_text", F.posexplode(ranges("_id", "_hash")).alias("_lent", "_range"))
    moved = dealt.repartitionById(n_ranges, F.col("_range"))
    in_order = moved.sortWithinPartitions("_range", F.col("_lent").desc(), F.col("_id").asc_nulls_first(), "_hash", "_text")
    schema = (f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double")
    return in_order.select("_id", "_text", "_range", "_lent").mapInArrow(edits, schema).withColumnRenamed("_id", id_col)
