"""Phrase collocations: suffix pointers sorted by multikey three-way quicksort, whose equal partitions are the phrase counts."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.llm.arrays import LOWER, mix, slices, text_bytes, word_hashes, words_of
from rollmill.llm.staging import shuffle_parts, written

#: Bytes of text whose phrases are counted together before they are sent, and suffix pointers sorted at a time.
SLICE_BYTES, POINTERS = 8 << 20, 2 << 20
#: Bytes of phrases in one part of the exchange, about.
PART_BYTES = 16 << 20
#: Bins in which the phrases of a part are weighed before they are sorted.
BINS = 1 << 22

_LOWER = np.frombuffer(LOWER, np.uint8)
_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~(_BREAK | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8)))


def multikey_counts(keys: np.ndarray, weights: np.ndarray | None = None, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth, in the order of the keys, a row with every distinct prefix that weighs at least ``least``, and its weight.

    ``keys`` (n, depth) holds codes from 0; a row ends at its first -1. Rows are partitioned around a pivot of their segment into less,
    equal and greater. The equal part is one prefix: its weight is the count, and it goes on with the next key. The other parts go on
    with the same one. A part lighter than ``least`` is abandoned, as no prefix in it can be heavier. All segments advance together; one
    row alone needs no partitioning.
    """
    n, depth = keys.shape
    flat = np.ascontiguousarray(keys.T).ravel()
    w = np.ones(n, np.int64) if weights is None else weights
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(depth)]
    rows = np.flatnonzero(flat[:n] >= 0).astype(np.int32) if depth else np.zeros(0, np.int32)
    # Of each segment: size, next key, and where it will stand in the order.
    sizes, level, place = np.array([len(rows)]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    if not len(rows) or w[rows].sum() < least:
        rows = rows[:0]
    while len(rows):
        if (alone := sizes == 1).any():
            mine = np.repeat(alone, sizes)
            single, at, spot = rows[mine], level[alone], place[alone]
            rows, sizes, level, place = rows[~mine], sizes[~alone], level[~alone], place[~alone]
            for d in range(depth):
                here = at <= d
                here[here] = flat[single[here].astype(np.int64) + d * n] >= 0
                if d:
                    # A row goes on as long as its keys do.
                    at = np.where((at <= d) & ~here, depth, at)
                heavy = w[single[here]]
                found[d].append((single[here][heavy >= least], heavy[heavy >= least], spot[here][heavy >= least]))
            if not len(rows):
                break
        starts = np.cumsum(sizes) - sizes
        segment = np.repeat(np.arange(len(sizes)), sizes)
        key = flat[rows + (level * n)[segment]]
        a, b, c = key[starts], key[starts + sizes // 2], key[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        side = (key >= pivot).view(np.int8) + (key > pivot).view(np.int8)
        segment *= 3
        segment += side
        parts = np.bincount(segment, minlength=3 * len(sizes))
        begin = np.cumsum(parts) - parts
        # A stable move: within a part, rows keep their order.
        moved = np.empty_like(rows)
        for s in range(3):
            at = np.flatnonzero(side == s)
            mine = parts[s::3]
            moved[np.repeat(begin[s::3] - (np.cumsum(mine) - mine), mine) + np.arange(len(at))] = rows[at]
        if weights is None:
            heavy = parts
        else:
            total = np.concatenate([[0], np.cumsum(w[moved])])
            heavy = total[begin + parts] - total[begin]
        place = np.repeat(place - starts, 3) + begin
        level = np.repeat(level, 3)
        equal = np.arange(len(parts)) % 3 == 1
        counted = equal & (heavy >= least)
        for d in np.unique(level[counted]):
            of = np.flatnonzero(counted & (level == d))
            found[d].append((moved[begin[of]], heavy[of], place[of]))
        # Parts that go on: heavy ones, the equal ones with their next key, less the rows that end here.
        level = level + equal
        on = (parts > 0) & (heavy >= least) & (level < depth)
        held = np.repeat(on, parts)
        rows, label = moved[held], np.repeat(np.arange(len(parts), dtype=np.int32), parts)[held]
        ends = flat[rows + (level * n)[label]] < 0
        if ends.any():
            rows, label = rows[~ends], label[~ends]
        sizes = np.bincount(label, minlength=len(parts))
        if least > 1:
            light = np.bincount(label, w[rows], len(parts)) < least
            rows, sizes = rows[~light[label]], np.where(light, 0, sizes)
        level, place, sizes = level[sizes > 0], place[sizes > 0], sizes[sizes > 0]
    out = []
    for some in found:
        pointers, counts, spots = (np.concatenate([f[k] for f in some] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.argsort(spots, kind="stable")
        out.append((pointers[order], counts[order]))
    return out


def _coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for every word, and the words by code, in order."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    held = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    code = np.empty(len(order), np.int32)
    code[np.asarray(order)] = np.arange(len(order), dtype=np.int32)
    return code[np.asarray(coded.indices)], coded.dictionary.take(order)


def _lines(keys: np.ndarray, pointers: np.ndarray, depth: int, words: pa.Array, end: bytes = b"") -> pa.Array:
    columns = [words.take(pa.array(keys[pointers, k])) for k in range(depth)]
    lines = columns[0] if depth == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", words.type))
    return pc.binary_join_element_wise(lines, pa.scalar(end, words.type), pa.scalar(b"", words.type)) if end else lines


def local_phrases(texts: pa.Array, langs: list[str | None], longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Lines, hashes and counts of every distinct phrase of up to ``longest`` words in these texts. A line begins with the name of the
    language and ends with a line break; the name alone counts all words. Of many words, some are counted at a time."""
    offsets, data = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, first = words_of(offsets, data, _WORD)
    if not len(starts):
        return
    codes, words = _coded(data, starts, ends)
    named = ["und" if x is None else x for x in langs]
    base = {x: len(words) + k for k, x in enumerate(sorted(set(named)))}
    words = pa.concat_arrays([words, pa.array([b"=" + quote(x).encode() for x in base], words.type)])
    hashed = np.array([xxhash.xxh64_intdigest(x) for x in words.to_pylist()], np.uint64)
    lang = np.repeat(np.array([base[x] for x in named], np.int32), np.diff(first))
    # The piece of a word: how many breaks, and texts, lie before it.
    piece = np.cumsum(_BREAK[data])[starts] + np.searchsorted(offsets, starts, "right")
    for at in range(0, len(codes), POINTERS):
        n = min(POINTERS, len(codes) - at)
        keys = np.full((n, longest + 1), -1, np.int32)
        keys[:, 0] = lang[at : at + n]
        for k in range(longest):
            here = np.arange(at, min(at + n, len(codes) - k))
            here = here[piece[here] == piece[here + k]]
            keys[here - at, k + 1] = codes[here + k]
        for d, (pointers, counts) in enumerate(multikey_counts(keys)):
            name = np.zeros(len(pointers), np.uint64)
            for k in range(d + 1):
                name = mix(name ^ hashed[keys[pointers, k]]) + np.uint64(1)
            yield _lines(keys, pointers, d + 1, words, b"\n"), name, counts


def _sent(phrases: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, lines, counts), compressed: a phrase goes to the part that its words name."""
    for lines, name, counts in phrases:
        part = (name % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        used, bounds = np.unique(part[order], return_index=True)
        bounds = np.append(bounds, len(order))
        lines = lines.take(pa.array(order))
        at = np.frombuffer(lines.buffers()[1], np.int64)[bounds].tolist()
        text, weights, packer = memoryview(lines.buffers()[2]), counts[order].astype("<i4"), zstandard.ZstdCompressor(3)
        blobs = [packer.compress(text[a:b]) for a, b in zip(at, at[1:])]
        numbers = [packer.compress(weights[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary()), pa.array(numbers, pa.binary())], ["part", "lines", "counts"])


def _merged(lines: list[bytes], counts: list[bytes], longest: int, least: int) -> pa.RecordBatch:
    """The phrases of one part that come to at least ``least``, by sorting their words."""
    unpack = zstandard.ZstdDecompressor().decompress
    data = np.frombuffer(b"".join(map(unpack, lines)), np.uint8)
    weight = np.frombuffer(b"".join(map(unpack, counts)), "<i4").astype(np.int64)
    breaks = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    # Lines whose hashes meet in one bin weigh together at least what a phrase does: a line in a light bin is no use.
    bins = (word_hashes(data, breaks[:-1], breaks[1:]) % np.uint64(BINS)).astype(np.int64)
    heavy = np.bincount(bins, weight, BINS)[bins] >= least
    data, weight = data[np.repeat(heavy, np.diff(breaks))], weight[heavy]
    breaks = np.concatenate([[0], np.cumsum(np.diff(breaks)[heavy])])
    starts, ends, first = words_of(breaks, data, ~np.isin(np.arange(256), [10, 32]))
    codes, words = _coded(data, starts, ends)
    # Phrases of other lengths are other phrases, though one may begin another: the length is the first key.
    n_words = np.diff(first).astype(np.int32)
    keys = np.full((len(weight), longest + 2), -1, np.int32)
    keys[:, 0] = n_words
    for k in range(longest + 1):
        has = n_words > k
        keys[has, k + 1] = codes[first[:-1][has] + k]
    out, size, total = [], [], []
    for n, (pointers, f) in enumerate(multikey_counts(keys, weight, least)):
        whole = n_words[pointers] == n
        if n and whole.any():
            out += _lines(keys[:, 1:], pointers[whole], n, words).to_pylist()
            size += [n - 1] * int(whole.sum())
            total += f[whole].tolist()
    cut = [line.partition(b" ") for line in out]
    return pa.RecordBatch.from_arrays(
        [pa.array([unquote(c[0][1:].decode()) for c in cut], pa.string()), pa.array([c[2].decode() for c in cut], pa.string()),
         pa.array(size, pa.int32()), pa.array(total, pa.int64())],
        ["lang", "phrase", "size", "f"],
    )


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10) -> DataFrame:
    """Phrases (lang, phrase, size in words, f) of up to ``longest`` words that occur at least ``least`` times in their language, and
    one row of size 0 with the number of all words of a language, if at least as many.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\n\\v\\f\\r]``, those into words at blanks and tabs; phrases lie within a
    piece. A null language is ``und``, a null text empty.

    A task sorts the suffix pointers of some MB of text and sends each distinct phrase once, with its count, to the part that all its
    words name: so a phrase costs at most one entry for each slice, however many rows hold it. A part is sorted again, abandoning what
    stays under ``least``. Parts follow the bytes of the texts, so that a part's size is bounded.
    """
    d = docs.select(F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text")).where("_text <> ''")
    size = d.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n_parts = max(shuffle_parts(d.sparkSession), -(-5 * size // PART_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE_BYTES):
            yield from _sent(local_phrases(part.column(1), part.column(0).to_pylist(), longest), n_parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, lines, counts = None, [], []
        for batch in batches:
            for part, text, f in zip(*(c.to_pylist() for c in batch.columns)):
                if part != number and lines:
                    yield _merged(lines, counts, longest, least)
                    lines, counts = [], []
                number = part
                lines.append(text)
                counts.append(f)
        if lines:
            yield _merged(lines, counts, longest, least)

    sent = d.mapInArrow(count, "part int, lines binary, counts binary").repartition(F.col("part")).sortWithinPartitions("part")
    return sent.mapInArrow(merge, "lang string, phrase string, size int, f long")


def score(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals of 38 digits."""
    return F.expr(f"cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(31,0)) * 1000000BD "
                  f"div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def _part(phrase: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(phrase, start, n), " ")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, absorbed: int = 50,
) -> DataFrame:
    """The ``top`` phrases of two and three words of every language (lang, rank from 1, phrase, a, l, r, n, score).

    a is the count of the phrase, at least ``least``. Cut after its first k words, with counts l and r of the two parts, it scores
    floor(1000000 * a * a / (l * r)); the cut of the lowest score counts, the first of equal ones. A phrase goes if a longer one that
    comes to ``least`` holds it and occurs at least ``absorbed`` hundredths as often. Order: score and a descending, then the phrase by
    its UTF-8 bytes. n counts all words of the language. Arithmetic is in decimals of 38 digits, exact for counts under 10^16.

    Null languages are ``und`` and one language with it; null and empty texts hold nothing; repeated rows count as often as they
    stand; columns with other names, also clashing ones, are ignored; an empty table gives an empty result.

    Counts are written to the shared folder. Joins go by phrases, each of which is in the counts once; the ranks are found among the
    first ``top`` of 64 sections of each language.
    """
    counts = written(phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least), "phrase-counts")
    of = lambda name, f: counts.where(F.col("size") > 0).select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(f))
    words = F.split("phrase", " ")
    cand = counts.where(F.col("size") >= 2).select("lang", "phrase", F.col("f").alias("a"), "size", words.alias("w"))
    two, three = cand.where("size = 2"), cand.where("size = 3")

    inside = three.select("lang", "a", F.explode(F.array(_part(F.col("w"), 1, 2), _part(F.col("w"), 2, 2))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = two.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer")

    cut = lambda df, k, size: (
        df.withColumn(f"left{k}", _part(F.col("w"), 1, k)).withColumn(f"right{k}", _part(F.col("w"), k + 1, size - k))
        .join(of(f"left{k}", f"l{k}"), ["lang", f"left{k}"]).join(of(f"right{k}", f"r{k}"), ["lang", f"right{k}"])
    )
    best = lambda k: F.struct(score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    two = cut(two, 1, 2).select("lang", "phrase", "a", best(1).alias("best"))
    three = cut(cut(three, 1, 3), 2, 3).select("lang", "phrase", "a", F.least(best(1), best(2)).alias("best"))
    scored = two.unionByName(three).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = scored.withColumn("section", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", rank("lang", "section")).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", rank("lang").cast("long")).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
