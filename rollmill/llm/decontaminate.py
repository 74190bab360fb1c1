"""Benchmark decontamination: suffix arrays over shards of training texts, searched for every suffix of every test item."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from rollmill.llm.arrays import ALNUM, LOWER, distinct, ragged, slices, text_bytes, word_hashes, words_of
from rollmill.llm.staging import quoted, schema_of

MEETINGS = 1 << 20  # places and suffixes that match and are looked at together, about
_LOWER = np.frombuffer(LOWER, np.uint8)
_WORD = ALNUM


def lowered_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, maximal runs of a-z, 0-9 and non-ASCII) and the index of each text's first word."""
    data = _LOWER[data]
    starts, ends, first = words_of(offsets, data, _WORD)
    return word_hashes(data, starts, ends), first


def suffix_order(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All places in the order of the words from there to the end of their text. Equal suffixes, of different texts, stand together.

    codes: the texts one after the other, words as positive numbers, each text closed by a 0; first: where each begins. Places are
    ordered by as many words as fit a key; those that tie are ordered by the rank of what follows, over twice as many words each
    time, until no two differ that are still together. Only tied places are sorted again.
    """
    n = len(codes)
    left = np.repeat(first[1:], np.diff(first)) - 1 - np.arange(n)  # words up to the end of the text
    bits = int(codes.max(initial=1)).bit_length()
    known = max(1, 62 // bits)
    key = codes.copy()
    for j in range(1, known):
        key <<= bits
        behind = max(n - j, 0)
        key[:behind] |= np.where(left[:behind] >= j, codes[j:], 0)
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    del key
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # of each slot: where its tied places begin
    rank = np.empty(n, np.int64)
    rank[order] = head
    slots = np.arange(n)
    while True:
        alone = fresh & np.append(fresh[1:], True)
        tied = ~alone & (left[order[slots]] >= known)  # places that share their end are equal
        slots = slots[tied]
        if not len(slots):
            return order
        places = order[slots]
        key = rank[places] * n + rank[places + known]
        sort = np.argsort(key)
        key, places = key[sort], places[sort]
        order[slots] = places
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[places] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        known *= 2


class Shard(NamedTuple):
    """The words of some texts as codes, and their suffix array."""

    vocabulary: np.ndarray  # hashes of the distinct words, in order; a word's code is its number here, from 1
    codes: np.ndarray  # all texts, each closed by a 0
    first: np.ndarray  # where each text begins, and the end
    order: np.ndarray
    opens: np.ndarray  # of each code: the first slot in the order whose place begins with it

    @classmethod
    def of(cls, offsets: np.ndarray, data: np.ndarray) -> Shard:
        hashes, start = lowered_words(offsets, data)
        vocabulary = distinct(hashes)
        first = start + np.arange(len(start))
        codes = np.zeros(int(first[-1]), np.int64)
        inside = np.ones(len(codes), bool)
        inside[first[1:] - 1] = False
        codes[inside] = np.searchsorted(vocabulary, hashes) + 1
        counts = np.bincount(codes, minlength=len(vocabulary) + 1)
        return cls(vocabulary, codes, first, suffix_order(codes, first), np.concatenate([[0], np.cumsum(counts)]))

    def codes_of(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words that may not stand in the texts (-1)."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, code: np.ndarray) -> np.ndarray:
        """By bisection: the first slot in [lo, hi), whose suffixes share ``depth`` words, with at least that code behind them."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.codes[self.order[mid] + depth] < code[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


class Items(NamedTuple):
    """Test items as one array of word hashes with the suffixes that can hold a window."""

    hashes: np.ndarray
    starts: np.ndarray  # positions of the suffixes to search
    item: np.ndarray  # of each suffix: the item's number in names
    window: np.ndarray  # of each suffix: words that must match
    left: np.ndarray  # of each suffix: its words up to the item's end
    opening: np.ndarray  # of each suffix: whether it is the whole item
    names: list[str]

    @classmethod
    def of(cls, ids: list[str], texts: list[str], window: int) -> Items:
        hashes, first = lowered_words(*text_bytes(pa.array(texts, pa.string())))
        n = np.diff(first)
        size = np.minimum(n, window)
        opened = np.where(n > 0, n - size + 1, 0)
        starts = ragged(first[:-1], opened)
        item = np.repeat(np.arange(len(n)), opened)
        names = sorted(set(ids))
        number = {name: i for i, name in enumerate(names)}
        return cls(hashes, starts, np.array([number[i] for i in ids], np.int64)[item] if len(ids) else item, size[item],
                   first[1:][item] - starts, starts == first[:-1][item], names)


def each_block(blocks: list[Broadcast]) -> Iterator[Items]:
    """The items of every block, in order. Of several, each is read from the task's local copy and let go before the next."""
    for block in blocks:
        yield Items(*block.value)
        if len(blocks) > 1 and getattr(block, "_path", None):  # a worker keeps a value it has read for as long as it runs
            vars(block).pop("_value", None)


class Met(NamedTuple):
    """Places where windows of items begin: place, suffix, and the words matched from there.

    ``length`` is the longest match where it can't be extended to the left. Elsewhere it is 0: the match that begins one word before
    is longer, so following each of them to its end would only cost the square of a long match.
    """

    place: np.ndarray
    suffix: np.ndarray
    length: np.ndarray


def search(shard: Shard, items: Items) -> Iterator[Met]:
    """All places where a window of an item begins. Every suffix of every item is looked up in the suffix array by bisection, one word
    further each time, until its window is matched or the range is empty. (The last suffixes of an item, too short for a window, are left out.)

    Places come in pieces, so items that open with the same words as each other and as many places in the shard need no more memory.
    """
    codes = shard.codes_of(items.hashes)
    some = np.flatnonzero(codes[items.starts] > 0)
    lo, hi = (shard.opens[codes[items.starts[some]] + k] for k in (0, 1))
    depth = 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(some):
        done = items.window[some] <= depth
        found.append((some[done], lo[done], hi[done]))
        some, lo, hi = some[~done], lo[~done], hi[~done]
        code = codes[items.starts[some] + depth]
        going = code > 0
        some, lo, hi, code = some[going], lo[going], hi[going], code[going]
        lo, hi = shard.bound(lo, hi, depth, code), shard.bound(lo, hi, depth, code + 1)
        going = lo < hi
        some, lo, hi = some[going], lo[going], hi[going]
        depth += 1
    if not found:
        return
    some, lo, hi = (np.concatenate(x) for x in zip(*found))
    met = np.cumsum(hi - lo) // MEETINGS
    for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(met)) + 1):
        if len(part):
            yield _followed(shard, items, codes, some[part], lo[part], hi[part])


def _followed(shard: Shard, items: Items, codes: np.ndarray, suffixes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Met:
    suffix = np.repeat(suffixes, hi - lo)
    place = shard.order[ragged(lo, hi - lo)]
    start = items.starts[suffix]
    leading = items.opening[suffix] | (place == 0) | (shard.codes[place - 1] != codes[start - 1])
    length = np.where(leading, items.window[suffix], 0)
    active = np.flatnonzero(leading & (items.left[suffix] > length))
    while len(active):
        depth = length[active]
        active = active[shard.codes[place[active] + depth] == codes[start[active] + depth]]
        length[active] += 1
        active = active[items.left[suffix[active]] > length[active]]
    return Met(place, suffix, length)


SCHEMA = ("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, "
          "longest_match long, longest_at long, longest_item string")


def find_contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, share: float = 0.05, shard_bytes: int = 4 << 20, block_words: int = 1 << 20,
) -> DataFrame:
    """Which words of every document stand inside a window of a test item, with the longest verbatim match and its place.

    Words are lower-cased (A-Z) runs of a-z, 0-9 and non-ASCII characters. A window is ``window`` consecutive words of an item; an
    item of fewer words, but not none, is one window. Documents are cut into shards of about shard_bytes of text (whole texts); a
    shard's suffix array, of whole suffixes, is searched by bisection for every suffix of every item that can hold a window.

    Columns: id, n_words, n_hit (words inside any occurrence), n_items, items (distinct ids as strings, sorted), items_sha256 (of
    the comma-joined ids), contaminated (n_hit > 0 and n_hit >= share * n_words), longest_match (words; 0 without a hit),
    longest_at (its first word, from 0; the first such place) and longest_item (of several there the least id, as a string).

    The items pass through the driver in blocks of about block_words words. Each is sent to the executors by itself, kept there on
    disk where memory is short, and read and searched in turn for every shard, so neither the driver nor a Python worker holds more
    than a block of a large benchmark; the executors' local disks hold all of it, as hashes. Nothing of the documents is shuffled or gathered. Null and empty texts
    have no words: no hits, and such items never occur. A null item id reads as an empty string; repeated items count once.
    Repeated documents each give a row, a null id stays null, other columns are dropped, either table may be empty.
    """
    context = docs.sparkSession.sparkContext
    blocks, ids, texts, held = [], [], [], 0

    def close() -> None:
        nonlocal ids, texts, held
        if ids:
            blocks.append(context.broadcast(tuple(Items.of(ids, texts, window))))
        ids, texts, held = [], [], 0

    for row in items.select(item_id_col, item_text_col).toLocalIterator():
        ids.append("" if row[0] is None else str(row[0]))
        texts.append(row[1] or "")
        held += len(texts[-1]) // 5 + 1
        if held >= block_words:
            close()
    close()
    per_words = round(1 / share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, shard_bytes):
            shard = Shard.of(*text_bytes(part.column(1)))
            n, total = part.num_rows, len(shard.codes)
            depth = np.zeros(total + 1, np.int64)
            met: list[set[str]] = [set() for _ in range(n)]
            best = [(0, 0, "")] * n  # minus the length, place, item: the least is wanted
            for known in each_block(blocks):
                for place, suffix, length in search(shard, known):
                    width = known.window[suffix]
                    depth += np.bincount(place, minlength=total + 1) - np.bincount(place + width, minlength=total + 1)
                    doc = np.searchsorted(shard.first, place, "right") - 1
                    item = known.item[suffix]
                    for k in distinct(doc * len(known.names) + item).tolist():
                        met[k // len(known.names)].add(known.names[k % len(known.names)])
                    whole = np.flatnonzero(length)
                    order = whole[np.lexsort((item[whole], place[whole], -length[whole], doc[whole]))]
                    for k in order[np.unique(doc[order], return_index=True)[1]].tolist():
                        d = int(doc[k])
                        best[d] = min(best[d], (-int(length[k]), int(place[k] - shard.first[d]), known.names[item[k]]))
            hit = np.concatenate([[0], np.cumsum(np.cumsum(depth[:total]) > 0)])
            n_hit = hit[shard.first[1:]] - hit[shard.first[:-1]]
            n_words = np.diff(shard.first) - 1
            listed = [sorted(m) for m in met]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(m) for m in met], pa.int64()),
                 pa.array(listed, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(m).encode()).hexdigest() for m in listed], pa.string()),
                 pa.array((n_hit > 0) & (per_words * n_hit >= n_words)), pa.array([-b[0] for b in best], pa.int64()),
                 pa.array([b[1] if b[0] else None for b in best], pa.int64()), pa.array([b[2] if b[0] else None for b in best], pa.string())],
                [id_col, *(x.split()[0] for x in SCHEMA.split(", "))],
            )

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(judge, schema_of(id_col, docs.schema[id_col].dataType, SCHEMA))
