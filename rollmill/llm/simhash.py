"""SimHash near-duplicates: fingerprints by whole texts, links by covering locality-sensitive hashing, components by stars."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.arrays import LOWER
from rollmill.llm.packs import each_pack, pack, with_answers
from rollmill.llm.staging import quoted, schema_of, written

#: Buckets of up to so many fingerprints are compared pairwise.
SMALL = 24
_PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: each is 1 if it is set in over half of the XXH64 of the word shingles (repeats included); 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashed = map(partial(xxhash.xxh64_intdigest, seed=seed), shingles)
    total, n = np.zeros(64, np.int64), 0
    while len(part := np.fromiter(itertools.islice(hashed, _PIECE), np.uint64)):
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
        n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """The id and the fingerprint (long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["_id", "fp"])

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(hashed, schema_of("_id", docs.schema[id_col].dataType, "fp long"))


def covering_masks(radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks of 64 bits: any set of at most ``radius`` bits is clear in one of them.

    Bit i gets a non-zero code c(i) of radius + 1 bits; mask v keeps the bits for which c(i) and v share an odd number of ones. The
    codes of radius bits leave a v orthogonal to all of them.
    """
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs differing in at most ``radius`` bits.

    Every mask gives a table of buckets. Fingerprints of a small bucket are compared with each other. In a larger one, each
    fingerprint is linked to the least fingerprint of every ball it lies in: two that differ in up to radius bits (an even number)
    share the centre of a ball of half that radius, and all in such a ball differ in at most radius bits. So every link is
    right, none is lost to a component, and no bucket is expanded into its pairs.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    keyed = prints.select("fp", tables.alias("k")).select("fp", "k.t", "k.key")
    counted = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(counted, ["t", "key"]), "buckets")
    a, b = shared.where(F.col("n") <= SMALL).alias("a"), shared.where(F.col("n") <= SMALL).alias("b")
    near = a.join(b, ["t", "key"]).where((F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
    pairs = near.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    flips = [_signed(sum(1 << i for i in bits)) for k in range(radius // 2 + 1) for bits in itertools.combinations(range(64), k)]
    crowded = shared.where(F.col("n") > SMALL).select("fp").distinct()
    balls = crowded.select("fp", F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("centre", "b")
    stars = balls.join(least, "centre").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """Node and root (the least node of its component) of every node in links (a, b), by alternating large and small stars.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen(after) == seen(edges):
            roots = after.select(F.col("v").alias("u")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
        edges = after


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
) -> DataFrame:
    """Fingerprint (long), component and root of every row; the root, the component's least fingerprint, is its own even where two
    components hold rows of the same least id.

    Fingerprints link at ``radius`` or fewer differing bits (an even number); component_id is the least id reachable over links,
    the row's own included. Texts are lower-cased (A-Z), split at ASCII white space into words, and their word shingles hashed;
    shorter texts are one shingle; null and empty ones have fingerprint 0, which links like any other. Rows with equal
    fingerprints, repeated rows included, form one class and are compared once. Null ids stay and never name a component unless no
    other id is in it. Other columns are dropped; an empty table gives an empty result.

    Only (id, fingerprint) pairs are shuffled. They are written once to the shared folder.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("_id").alias("least"))
    member = components(fingerprint_links(classes.select("fp"), radius))
    rooted = classes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(by_print, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One whole row of docs per component of near duplicates (see near_duplicates): that of the least id; rows without an id stay.

    Rows of one id may be in several components; of those in one, the least hash of the text decides, and one of rows repeated as they
    are stays. Null and empty texts are near duplicates of each other. All columns come back, whatever their names; a null text stays
    null; an empty table gives an empty result. A very long text is a pack by itself.

    Texts stay where they are: they are written once in packs, from which (pack, place, id, fingerprint) go out, and a list of the
    places that stay comes back for each pack. A fingerprint's rows are reduced to its least before anything is joined, so that a third
    of all rows with one fingerprint is one row of the join.
    """
    names = docs.columns
    rest = [c for c in names if c != text_col]
    number = rest.index(id_col)
    row = F.struct(F.struct(*[F.col(quoted(c)) for c in rest]).alias("rest"), F.col(quoted(text_col)).isNull().alias("none"))
    packs, _ = pack(docs.select(row.alias("row"), F.col(quoted(text_col)).alias("text")), "row", "text", "documents")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack_no, rows, offsets, data, _ in each_pack(batch):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets, offsets[1:])]
                prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                hashes = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.field("rest").field(number), pa.array(prints), pa.array(hashes), pa.array(np.full(len(texts), pack_no)), pa.array(np.arange(len(texts), dtype=np.int32))],
                    ["_id", "fp", "hash", "pack", "place"])

    prints = written(packs.mapInArrow(hashed, schema_of("_id", docs.schema[id_col].dataType, "fp long, hash long, pack long, place int")), "fingerprints")
    lead = F.struct("_id", "hash", "pack", "place")
    classes = prints.groupBy("fp").agg(F.min(F.when(F.col("_id").isNotNull(), lead)).alias("lead"))
    member = components(fingerprint_links(classes.select("fp"), radius))
    rooted = classes.join(member, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("lead").alias("lead"))
    stay = rooted.where("lead is not null").select("lead.pack", "lead.place").unionByName(prints.where("_id is null").select("pack", "place"))
    places = stay.groupBy("pack").agg(F.array_sort(F.collect_list("place")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, offsets, data, got in each_pack(batch):
                at = pa.array(got["places"], pa.int32())
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).take(at).cast(pa.large_string())
                rows = rows.take(at)
                texts = pc.if_else(rows.field("none"), pa.scalar(None, texts.type), texts)
                columns = {c: rows.field("rest").field(k) for k, c in enumerate(rest)} | {text_col: texts}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return with_answers(packs, written(places, "places"), how="inner").mapInArrow(cut, docs.schema)


__all__ = ["components", "covering_masks", "fingerprint", "fingerprint_links", "fingerprints", "keep_one", "near_duplicates"]
