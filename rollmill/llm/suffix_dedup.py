"""Removal of byte strings that a document with a smaller id holds too: difference-cover suffix sorting in shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.arrays import PIECE, Spans, covered, distinct, mix, ragged, within
from rollmill.llm.packs import SENT, _dealt, answered, each_pack, pack, parts_for, per_pack, sent, shared_keys, with_answers
from rollmill.llm.staging import shuffle_parts, written
from rollmill.llm.substring import difference_cover

_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
NO_ID = np.iinfo(np.int64).max
BLOCK_BITS = 7  # a content-defined cut every 128 bytes, on average
CUT_RULE = np.uint64(0x9E3779B97F4A7C15)
#: Suffixes that are sorted together, about.
SORT_SIZE = 1 << 17
#: Contexts of one gram beyond which their strings are sorted one shift after the other.
CROWD = 1 << 15
#: Contexts whose strings or bits are spread out at once.
CHUNK = 1 << 14


def suffix_array(s: np.ndarray) -> np.ndarray:
    """All suffixes of a sequence of non-negative integers in order, by the difference cover {1, 2} modulo 3.

    Suffixes at cover positions are named by their triples; where names repeat, the sequence of names is sorted by the same
    method. The others are sorted by their first value and the rank behind it, and merged: against either residue of the
    cover, one or two values and a rank decide.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int32)  # places and names fit 32 bits; only keys that are being compared take 64
    t[:n] = s
    t[:n] += 1
    one, two, zero = (np.arange(k, n, 3, dtype=np.int32) for k in (1, 2, 0))
    if n % 3 == 1:  # a closing triple keeps the names of the residue 1 from running into those of 2
        one = np.append(one, np.int32(n))
    cover = np.concatenate([one, two])
    name = _names(t, cover)
    order = np.argsort(name, kind="stable") if name.max() + 1 == len(name) else suffix_array(name)
    rank = np.zeros(n + 3, np.int32)
    rank[cover[order]] = np.arange(1, len(cover) + 1, dtype=np.int32)
    order = cover[order]
    order = order[order < n]
    key = lambda at: (t[at].astype(np.int64) << 32) | rank[at + 1]
    zero = zero[np.argsort(key(zero))]
    second = order[order % 3 == 2]
    place = np.searchsorted(key(order[order % 3 == 1]), key(zero)) + np.arange(len(zero))
    both = np.concatenate([second, zero])
    pair = np.unique(_two(t, both), return_inverse=True)[1]
    key2 = (pair << 32) | rank[both + 2]
    place += np.searchsorted(key2[: len(second)], key2[len(second) :])
    out = np.empty(n, np.int32)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = order
    return out


def _two(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (t[at].astype(np.int64) << 32) | t[at + 1]


def _names(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks (equal for equal triples) of the triples at some positions."""
    top = int(t.max()).bit_length()
    if 3 * top <= 63:
        key = (t[at].astype(np.int64) << (2 * top)) | (t[at + 1].astype(np.int64) << top) | t[at + 2]
    else:
        key = (np.unique(_two(t, at), return_inverse=True)[1] << 32) | t[at + 2]
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


class Texts:
    """A pack's documents as bytes, cut into content-defined blocks."""

    def __init__(self, ids: pa.Array, offsets: np.ndarray, data: np.ndarray, length: int) -> None:
        self.data, self.offsets, self.length = data, offsets, length
        self.ids = np.array([NO_ID if x is None else x for x in ids.to_pylist()], np.int64)
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n >= 8:
            for at in range(0, n - 7, PIECE):
                words = np.lib.stride_tricks.sliding_window_view(data[at : at + PIECE + 7], 8).copy().view(np.uint64).ravel()
                cut[at : at + len(words)] = (words * CUT_RULE) >> np.uint64(64 - BLOCK_BITS) == 0
        cut[offsets] = True
        self.blocks = np.flatnonzero(cut[:n])
        self.doc = np.searchsorted(offsets, self.blocks, "right") - 1
        ends = np.append(self.blocks[1:], n)
        stop = offsets[self.doc + 1]
        #: The strings that start in a block lie in it and the length - 1 bytes behind it.
        self.stops = np.minimum(ends + length - 1, stop)
        self.ends = np.minimum(ends, stop - length + 1)  # behind the last string that starts in the block
        self.spans = Spans(data, table=_CODE)
        self.keys = self.spans.hashes(self.blocks, self.stops)

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct block keys, the least id that holds each, and which of them each block is."""
        keys, back = np.unique(self.keys, return_inverse=True)
        least = np.full(len(keys), NO_ID)
        np.minimum.at(least, back, self.ids[self.doc])
        return keys, least, back

    def gone(self, answers: list[dict] | None, n_parts: int) -> np.ndarray:
        """Blocks that a smaller id holds in just the same way."""
        keys, least, back = self.least()
        return answered(keys, n_parts, answers)[back] | (self.ids[self.doc] > least[back])

    def starts(self, blocks: np.ndarray) -> np.ndarray:
        """Where strings start in the given blocks."""
        use = blocks & (self.ends > self.blocks)
        return within(self.blocks[use], self.ends[use], len(self.data))

    def anchors(self, gone: np.ndarray, period: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, documents and keys of the cover positions in blocks that are not gone; counted from the text's first byte."""
        size = self.length - period + 1
        live = ~gone & (self.ends > self.blocks)
        inside = within(self.blocks[live], self.stops[live] - size + 1, len(self.data))
        sizes = np.diff(self.offsets)
        longest = int(sizes.max(initial=0))
        pattern = np.resize(cover, longest)
        covering = np.concatenate([pattern[:n] for n in sizes.tolist()]) if longest else pattern
        at = np.flatnonzero(inside & covering)
        doc = (np.searchsorted(self.offsets, at, "right") - 1).astype(np.int32)
        return at, doc, self.spans.hashes(at, at + size)

    def minimizers(self, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For strings that start at the given places: each one's least gram, so that equal strings share it at the same shift.

        Of every such gram, the place, and how far the strings that chose it reach to either side.
        """
        size = self.length - span + 1
        found = [self._chosen(starts[k : k + PIECE], span) for k in range(0, len(starts), PIECE)]
        # Strings on both sides of a seam may have chosen one gram.
        at, lows, highs = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        place, back = np.unique(at, return_inverse=True)
        low, high = np.full(len(place), NO_ID), np.zeros(len(place), np.int64)
        np.minimum.at(low, back, lows)
        np.maximum.at(high, back, highs)
        return place, place - low, high + self.length - place - size

    def _chosen(self, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The grams of some strings, and the first and last string that chose each."""
        size = self.length - span + 1
        first = int(starts[0])
        grams = first + np.flatnonzero(covered(starts - first, span, int(starts[-1]) - first + span))
        hashed = self.spans.hashes(grams, grams + size)
        # Grams of a run of starts are consecutive, so a string's grams stand together in this list.
        best = np.arange(len(grams))
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            ahead = np.minimum(np.arange(len(grams)) + step, len(grams) - 1)
            other = best[ahead]
            best = np.where(hashed[other] < hashed[best], other, best)
            reach += step
        at = grams[best[np.searchsorted(grams, starts)]]
        place, back = np.unique(at, return_inverse=True)
        low, high = np.full(len(place), NO_ID), np.zeros(len(place), np.int64)
        np.minimum.at(low, back, starts)
        np.maximum.at(high, back, starts)
        return place, low, high


def _with_ids(pack_no: int, keys: np.ndarray, ids: np.ndarray, n_parts: int) -> pa.RecordBatch | None:
    rows = sent(pack_no, keys, n_parts, 8)
    if rows is None:
        return None
    order, bounds = _dealt(keys, n_parts)
    held = ids[order].astype("<i8")
    column = pa.array([held[bounds[p] : bounds[p + 1]].tobytes() for p in rows.column(1).to_pylist()], pa.binary())
    return pa.RecordBatch.from_arrays([*rows.columns, column], ["pack", "part", "keys", "ids"])


def smaller_elsewhere(rows: DataFrame, n_parts: int) -> DataFrame:
    """For rows (pack, part, keys, ids): per pack, the answers (part, bits) for which keys another pack has a smaller id."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for pack_no, part, keys, ids in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append((pack_no, np.frombuffer(keys, "<u8"), np.frombuffer(ids, "<i8")))
        while held:
            part, got = held.popitem()
            known, back = np.unique(np.concatenate([k for _, k, _ in got]), return_inverse=True)
            ids = np.concatenate([i for _, _, i in got])
            least = np.full(len(known), NO_ID)
            np.minimum.at(least, back, ids)
            hit = np.split(ids > least[back], np.cumsum([len(k) for _, k, _ in got])[:-1])
            packs = [p for (p, _, _), h in zip(got, hit) if h.any()]
            if packs:
                bits = [np.packbits(h).tobytes() for h in hit if h.any()]
                yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([part] * len(packs), pa.int32()), pa.array(bits, pa.binary())], ["pack", "part", "bits"])

    return rows.repartitionById(n_parts, F.col("part")).mapInArrow(compare, "pack long, part int, bits binary")


def _contexts(texts: Texts, at: np.ndarray, left: np.ndarray, right: np.ndarray, span: int) -> np.ndarray:
    """Around each gram the bytes of the strings that chose it, preceded by how many of them stand before and behind it."""
    reach, size = span - 1, texts.length - span + 1
    padded = np.concatenate([np.zeros(reach, np.uint8), texts.data, np.zeros(reach, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + size)[at].copy()
    column = np.arange(2 * reach + size)
    wide[(column < (reach - left)[:, None]) | (column >= (reach + size + right)[:, None])] = 0
    return np.concatenate([left[:, None].astype(np.uint8), right[:, None].astype(np.uint8), wide], axis=1)


def _least_ids(contexts: np.ndarray, ids: np.ndarray, length: int, span: int) -> np.ndarray:
    """For every string (context, start) the least id that holds it: suffix array, then adjacent prefixes."""
    reach = span - 1
    n, width = len(contexts), contexts.shape[1] - 2
    left, right, body = contexts[:, 0].astype(int), contexts[:, 1].astype(int), contexts[:, 2:]
    flat = np.zeros((n, width + 1), np.int16)
    np.add(body, 1, out=flat[:, :width], dtype=np.int16)  # 0 closes a context
    column = np.arange(width + 1)
    used = (column >= (reach - left)[:, None]) & (column < (width - reach + right)[:, None])
    used[:, width] = True
    flat = flat[used]
    sizes = used.sum(axis=1)
    shift = (np.cumsum(sizes) - sizes - (reach - left)).astype(np.int32)  # from a context's starts to places in flat
    del used
    begin = suffix_array(flat)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[begin]
    start = begin - shift[row]
    string = (start <= reach) & (start <= right[row])
    begin, row, start = begin[string], row[string], start[string]
    raw = np.append(flat.astype(np.uint16).astype(np.uint8) - np.uint8(1), np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(np.uint64).ravel()
    same = np.ones(max(len(begin) - 1, 0), bool)
    for k in sorted({*range(0, length - 7, 8), length - 8}):
        same &= words[begin[1:] + k] == words[begin[:-1] + k]
    out = np.repeat(ids[:, None], span, axis=1)
    if len(begin):
        firsts = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(ids[row], firsts)
        out[row, start] = np.repeat(least, np.diff(np.append(firsts, len(row))))
    return out


def _strings(contexts: np.ndarray, rows: np.ndarray, column: int, length: int) -> np.ndarray:
    """Strings of some contexts from a column on, as words of 8 bytes."""
    padded = np.zeros((len(rows), -(-length // 8) * 8), np.uint8)
    padded[:, :length] = contexts[rows, column : column + length]
    return padded.view(np.uint64)


def _string_hashes(words: np.ndarray) -> np.ndarray:
    return mix((mix(words) * _CODE[: words.shape[1]]).sum(axis=1, dtype=np.uint64))


def _least_alike(contexts: np.ndarray, rows: np.ndarray, column: int, length: int, ids: np.ndarray) -> np.ndarray:
    """For the string of every row the least id that holds it. A hash brings equal strings together, and neighbours of one hash are
    compared byte for byte; strings of a hash that clashes are sorted. Strings are taken from their contexts some at a time."""
    n = len(rows)
    hashed = np.empty(n, np.uint64)
    for k in range(0, n, CHUNK):
        hashed[k : k + CHUNK] = _string_hashes(_strings(contexts, rows[k : k + CHUNK], column, length))
    order = np.argsort(hashed, kind="stable")
    hashed = hashed[order]
    fresh = np.ones(n, bool)
    fresh[1:] = hashed[1:] != hashed[:-1]
    clash = set()
    alike = np.flatnonzero(~fresh)
    for k in range(0, len(alike), CHUNK):
        at = alike[k : k + CHUNK]
        other = (_strings(contexts, rows[order[at]], column, length) != _strings(contexts, rows[order[at - 1]], column, length)).any(axis=1)
        clash.update(hashed[at[other]].tolist())
    for h in clash:
        low, high = (int(np.searchsorted(hashed, np.uint64(h), side)) for side in ("left", "right"))
        words = _strings(contexts, rows[order[low:high]], column, length)
        by_bytes = np.lexsort(words.T)
        words = words[by_bytes]
        order[low:high] = order[low:high][by_bytes]
        fresh[low + 1 : high] = (words[1:] != words[:-1]).any(axis=1)
    firsts = np.flatnonzero(fresh)
    out = np.empty(n, np.int64)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], firsts), np.diff(np.append(firsts, n)))
    return out


def _least_by_shift(contexts: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for a crowded gram and its contexts ``at``: per start, which of them have a string there, and the least id that holds it.

    Equal strings share the gram at the same shift, so the strings of one shift are brought together at a time. Memory is some
    numbers a context, neither all of its suffixes nor its strings.
    """
    reach = span - 1
    left, right = contexts[at, 0], contexts[at, 1]
    for start in range(span):
        rows = np.flatnonzero((left >= reach - start) & (right >= start))
        if len(rows) > 1:
            yield start, rows, _least_alike(contexts, at[rows], 2 + start, length, ids[rows])


def sorted_lots(batches: Iterator[pa.RecordBatch], length: int, span: int) -> Iterator[pa.RecordBatch]:
    """A task of ``sorted_shards``. Found bits are packed, and a context's temporaries are made for some contexts at a time."""
    reach, size = span - 1, length - span + 1
    width = 2 * reach + size + 2
    weights = mix(np.arange(7, 7 + width, dtype=np.uint64))
    held: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for pack_no, part, contexts, ids, places in zip(*(c.to_pylist() for c in batch.columns)):
            one = np.frombuffer(contexts, np.uint8).reshape(-1, width), np.frombuffer(ids, "<i8"), np.frombuffer(places, "<i8")
            held.setdefault(part, []).append((pack_no, *one))
        del batch, contexts, ids, places, one
    while held:
        _, got = held.popitem()
        numbers, *columns = zip(*got)
        del got
        bounds = np.cumsum([0, *(len(c) for c in columns[1])])
        contexts, ids, places = (np.concatenate(columns.pop(0)) for _ in range(3))
        gram, rest = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        for k in range(width):
            if 2 + reach <= k < 2 + reach + size:
                gram += contexts[:, k] * weights[k]
            else:
                rest += contexts[:, k] * weights[k]
        # Like contexts are sorted once, for the least id; the others compare theirs with what it finds.
        rest += mix(gram)
        _, lead, back = np.unique(rest, return_index=True, return_inverse=True)
        del rest
        gram = gram[lead]
        first = np.full(len(lead), NO_ID)
        np.minimum.at(first, back, ids)
        _, which, holders = np.unique(gram, return_inverse=True, return_counts=True)
        calm = np.flatnonzero((holders[which] > 1) & (holders[which] <= CROWD))
        crowded = np.flatnonzero(holders[which] > CROWD)
        crowded = crowded[np.argsort(which[crowded], kind="stable")]
        crowds = np.split(crowded, np.flatnonzero(np.diff(which[crowded])) + 1)
        lot = mix(gram[calm]) % np.uint64(len(calm) * width // SORT_SIZE + 1)
        by_lot = np.argsort(lot, kind="stable")
        calm = calm[by_lot]
        lots = np.split(calm, np.flatnonzero(np.diff(lot[by_lot])) + 1)
        del gram, which, holders, lot, by_lot
        # The rows of each distinct context stand together in this order.
        back_order, spot = np.argsort(back, kind="stable"), np.zeros(len(lead), np.int64)
        back_count = np.bincount(back, minlength=len(lead))
        back_first = np.cumsum(back_count) - back_count
        hit = np.zeros((len(ids), -(-span // 8)), np.uint8)
        hit[first[back] < ids] = 255
        for rows in lots:
            if len(rows):
                least = _least_ids(contexts[lead[rows]], first[rows], length, span)
                spot[rows] = np.arange(len(rows))
                of = back_order[ragged(back_first[rows], back_count[rows])]
                for k in range(0, len(of), CHUNK):
                    some = of[k : k + CHUNK]
                    hit[some] |= np.packbits(least[spot[back[some]]] < ids[some, None], axis=1)
        for rows in crowds:
            for start, at, least in _least_by_shift(contexts, lead[rows], first[rows], length, span) if len(rows) else ():
                of = back_order[ragged(back_first[rows[at]], back_count[rows[at]])]
                of = of[np.repeat(least, back_count[rows[at]]) < ids[of]]
                hit[of, start >> 3] |= np.uint8(128 >> (start & 7))
        start = np.arange(span)
        for pack_no, a, b in zip(numbers, bounds[:-1], bounds[1:]):
            left, right = contexts[a:b, :1].astype(int), contexts[a:b, 1:2]
            bits = np.unpackbits(hit[a:b], axis=1, count=span).astype(bool) & (start >= reach - left) & (start <= right)
            own = np.flatnonzero(bits.any(axis=1))
            if len(own):
                found = [places[a + own].tobytes()], [np.packbits(bits[own]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([pack_no], pa.int64()), *(pa.array(c, pa.binary()) for c in found)], ["pack", "places", "bits"])


def sorted_shards(rows: DataFrame, n_parts: int, length: int, span: int) -> DataFrame:
    """For rows (pack, part, keys (contexts), ids, places): per pack, the answers (places, bits): for each place, ``span`` bits.

    Contexts of one gram are sorted together; a task sorts one lot of grams after the other, each of about SORT_SIZE suffixes.
    A gram that stands in one context only has none to be compared with; the strings around one that stands in more than CROWD
    are compared shift by shift. Places at which nothing was found are not answered.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_lots(batches, length, span)

    found = rows.repartitionById(n_parts, F.col("part")).mapInArrow(sort, "pack long, places binary, bits binary")
    return found.groupBy("pack").agg(F.collect_list(F.struct("places", "bits")).alias("shards"))


def remove_held_before(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, period: int = 21, span: int = 31, with_text: bool = False,
) -> DataFrame:
    """Remove every byte inside a string of ``length`` bytes that also starts in a document with a smaller id.

    Texts are UTF-8; strings lie in one document, overlap freely and are judged on the input. In four exchanges between packs:

    1. Texts are cut at content-defined places. A block that, with the bytes its strings reach into, stands in a document of
       a smaller id is removed as a whole; only the first holder of every block goes on.
    2. Of the rest, hashes at difference-cover positions (length - period + 1 bytes) tell which anchors recur: equal strings
       share one at the same shift.
    3. Every string with a recurring anchor goes, in its context, to the shard that its least gram (of length - span + 1 bytes)
       names, so equal strings meet. A shard sorts all suffixes of its contexts by the difference-cover algorithm and compares
       adjacent prefixes: byte for byte, the least id of every string is found.
    4. What the shards found goes back to the packs.

    Columns: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and on request kept (the bytes left, which
    may split a character). The id must be an integer; a null id counts as larger than all others. Rows of equal id never remove
    from each other, so a repeated row stays as its first. Null and empty texts have no bytes; texts shorter than ``length`` stay
    whole; other columns are dropped; an empty table gives no rows. Blocks and anchors are compared by 64-bit and, before the exact
    sort, 32-bit hashes. Packs of texts are written once to the shared folder.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    spark = docs.sparkSession
    floor = shuffle_parts(spark)
    cover = np.isin(np.arange(period), difference_cover(period))
    packs, size = pack(docs, id_col, text_col, "strings")
    block_parts, anchor_parts = parts_for(size >> BLOCK_BITS, floor), parts_for(size // 5, floor)
    shard_parts = parts_for(size // 8, floor)

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, offsets, data, _ in each_pack(batch):
                keys, least, _ = Texts(ids, offsets, data, length).least()
                rows = _with_ids(number, keys, least, block_parts)
                if rows is not None:
                    yield rows

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, offsets, data, got in each_pack(batch):
                texts = Texts(ids, offsets, data, length)
                rows = sent(number, distinct(texts.anchors(texts.gone(got["blocks"], block_parts), period, cover)[2]), anchor_parts, 4)
                if rows is not None:
                    yield rows

    def candidates(texts: Texts, got: dict) -> tuple[np.ndarray, ...]:
        """Grams to sort by, ordered by shard, with their reaches, and where each shard's begin."""
        gone = texts.gone(got["blocks"], block_parts)
        at, doc, keys = texts.anchors(gone, period, cover)
        order = np.argsort(keys)
        keys, at, doc = keys[order], at[order], doc[order]
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        shared = answered(keys[firsts], anchor_parts, got["anchors"])
        if len(firsts):
            shared |= np.maximum.reduceat(doc, firsts) > np.minimum.reduceat(doc, firsts)
        hit = at[np.repeat(shared, np.diff(np.append(firsts, len(keys))))]
        near = covered(np.maximum(hit - period + 1, 0), period, len(texts.data) + 1)[:-1]
        starts = np.flatnonzero(near & texts.starts(~gone))
        place, left, right = texts.minimizers(starts, span)
        order, bounds = _dealt(texts.spans.hashes(place, place + length - span + 1), shard_parts)
        return place[order], left[order], right[order], bounds

    def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, offsets, data, got in each_pack(batch):
                texts = Texts(ids, offsets, data, length)
                at, left, right, bounds = candidates(texts, got)
                holder = texts.ids[np.searchsorted(texts.offsets, at, "right") - 1].astype("<i8")
                used = np.flatnonzero(np.diff(bounds))
                if len(used):
                    runs = [slice(bounds[p], bounds[p + 1]) for p in used]
                    contexts = _contexts(texts, at, left, right, span)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used), number)), pa.array(used, pa.int32()),
                         *(pa.array([c[r].tobytes() for r in runs], pa.binary()) for c in (contexts, holder, at.astype("<i8")))],
                        ["pack", "part", "keys", "ids", "places"],
                    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, offsets, data, got in each_pack(batch):
                texts = Texts(ids, offsets, data, length)
                starts = texts.starts(texts.gone(got["blocks"], block_parts))
                for a in got["shards"] or []:
                    own = np.frombuffer(a["places"], "<i8")
                    bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=len(own) * span).reshape(-1, span)
                    row, shift = np.nonzero(bits)
                    starts[own[row] - (span - 1) + shift] = True
                yield _left(ids, offsets, data, covered(np.flatnonzero(starts), length, len(data)), id_col, with_text)

    rows = SENT + ", ids binary"
    blocks = written(per_pack(smaller_elsewhere(packs.mapInArrow(block_rows, rows), block_parts), "blocks"), "blocks")
    anchors = with_answers(packs, blocks).mapInArrow(anchor_rows, SENT)
    anchors = written(per_pack(shared_keys(anchors, anchor_parts, 4), "anchors"), "anchors")
    shards = with_answers(packs, blocks, anchors).mapInArrow(shard_rows, rows + ", places binary")
    shards = sorted_shards(shards, shard_parts, length, span)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return with_answers(packs, blocks, shards).mapInArrow(cut, schema)


def _left(ids: pa.Array, offsets: np.ndarray, data: np.ndarray, gone: np.ndarray, id_col: str, with_text: bool) -> pa.RecordBatch:
    rows = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        own = gone[a:b]
        kept = data[a:b][~own].tobytes()
        rows.append((int(b - a), int(own.sum()), int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest(), kept))
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_text else 4]
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds) + 1]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names)
