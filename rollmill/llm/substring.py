"""Removal of word passages that occur more than once, by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollmill.llm.arrays import NOT_SPACE, covered, distinct, other_span_hashes, ragged, span_hashes, within, word_hashes, words_of
from rollmill.llm.packs import SENT, answered, distinct_pairs, each_pack, pack, parts_for, per_pack, sent, shared_keys, with_answers
from rollmill.llm.staging import schema_of, shuffle_parts, written


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo the period is one of two of them: greedily, the residue that adds most."""
    cover, open_ = [0], set(range(1, period))
    while open_:
        gain = {r: {d for c in cover for d in ((r - c) % period, (c - r) % period)} & open_ for r in range(period) if r not in cover}
        best = max(gain, key=lambda r: (len(gain[r]), -r))
        cover.append(best)
        open_ -= gain[best]
    return sorted(cover)


class Passages:
    """Words, anchors and windows of a pack's documents."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, window: int, period: int, cover: np.ndarray) -> None:
        self.window, self.reach = window, period - 1
        self.starts, self.ends, self.first = words_of(offsets, data, NOT_SPACE)
        self.codes = word_hashes(data, self.starts, self.ends)
        n = np.diff(self.first)
        size = window - self.reach  # words in an anchor
        # Anchors of texts that hold a window: at cover residues, counted from the text's first word.
        room = np.where(n >= window, n - size + 1, 0)
        at = ragged(np.zeros_like(room), room)
        keep = cover[at % period]
        self.anchors = (np.repeat(self.first[:-1], room) + at)[keep]
        self.anchor_keys = span_hashes(self.codes, self.anchors, self.anchors + size)
        self.last = self.first[1:] - window  # the last window of each text

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hit anchor."""
        at = self.anchors[hit]
        near = np.flatnonzero(within(np.maximum(at - self.reach, 0), at + 1, len(self.codes)))
        # The reach may run over into the text before, whose own windows end earlier.
        return near[near <= self.last[np.searchsorted(self.first, near, "right") - 1]]

    def window_keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the windows' keys."""
        return span_hashes(self.codes, starts, starts + self.window), other_span_hashes(self.codes, starts, starts + self.window)


def _here(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, which of them each key is, and whether it occurs twice in the pack itself."""
    known, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return known, back, count > 1


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, period: int = 21, with_text: bool = False,
) -> DataFrame:
    """Remove every word inside a window of ``window`` words whose word sequence also starts anywhere else.

    Words are runs without ASCII white space, unchanged; windows lie in one document, may recur in the same document, and are
    judged on the input. Any two equal windows share an anchor (window - period + 1 words) at one shift below the period at which
    both places fall on residues of a difference cover, so only those positions are hashed and exchanged. A recurring anchor then
    extends: all windows that hold one are hashed in full and exchanged, and the recurring ones mark their words. Windows are
    compared by 128 bits; anchors, which only find candidates, by 32 bits and their part.

    Columns: id, n_words, n_removed, kept_sha256 (kept words joined by one space), removed (runs of words: start, end) and on
    request kept_text: the text as it was between the removed runs, the parts joined by one space.

    Null and empty texts have no words and keep nothing; texts shorter than a window stay whole; repeated rows remove
    each other; a null id stays null; other columns are dropped; an empty table gives no rows. Packs of texts are written once to
    the shared folder; keys and answers are all that is shuffled.
    """
    spark = docs.sparkSession
    floor = shuffle_parts(spark)
    cover = np.isin(np.arange(period), difference_cover(period))
    packs, size = pack(docs, id_col, text_col, "passages")
    anchor_parts = parts_for(size // 20, floor)
    window_parts = parts_for(size // 10, floor)

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, _, offsets, data, _ in each_pack(batch):
                rows = sent(number, distinct(Passages(offsets, data, window, period, cover).anchor_keys), anchor_parts, 4)
                if rows is not None:
                    yield rows

    def windows(p: Passages, anchors: list[dict] | None) -> np.ndarray:
        known, back, twice = _here(p.anchor_keys)
        return p.candidates((twice | answered(known, anchor_parts, anchors))[back])

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, _, offsets, data, got in each_pack(batch):
                p = Passages(offsets, data, window, period, cover)
                first, second = p.window_keys(windows(p, got["anchors"]))
                known = distinct_pairs(first, second)[0]
                rows = sent(number, first[known], window_parts, 16, second[known])
                if rows is not None:
                    yield rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, offsets, data, got in each_pack(batch):
                p = Passages(offsets, data, window, period, cover)
                starts = windows(p, got["anchors"])
                first, second = p.window_keys(starts)
                known, back, count = distinct_pairs(first, second)
                hit = starts[((count > 1) | answered(first[known], window_parts, got["windows"]))[back]]
                yield _outcome(ids, offsets, data, p, covered(hit, window, len(p.codes)), id_col, with_text)

    anchors = written(per_pack(shared_keys(packs.mapInArrow(anchor_rows, SENT), anchor_parts, 4), "anchors"), "anchors")
    rows = with_answers(packs, anchors).mapInArrow(window_rows, SENT)
    found = per_pack(shared_keys(rows, window_parts, 16), "windows")
    schema = "n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long, end:long>>" + (", kept_text string" if with_text else "")
    return with_answers(packs, anchors, found).mapInArrow(cut, schema_of(id_col, docs.schema[id_col].dataType, schema))


def _outcome(ids: pa.Array, offsets: np.ndarray, data: np.ndarray, p: Passages, gone: np.ndarray, id_col: str, with_text: bool) -> pa.RecordBatch:
    n_words, n_removed, digests, spans, texts = [], [], [], [], []
    total = np.concatenate([[0], np.cumsum(gone)])
    raw = data.tobytes()
    for d in range(len(ids)):
        a, b = int(p.first[d]), int(p.first[d + 1])
        text = raw[offsets[d] : offsets[d + 1]]
        words = text.split()
        removed = int(total[b] - total[a])
        n_words.append(b - a)
        n_removed.append(removed)
        edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)) if removed else np.zeros(0, np.int64)
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
        digests.append(hashlib.sha256(b" ".join(compress(words, ~gone[a:b]) if removed else words)).hexdigest())
        if with_text:
            if removed:
                bounds = [0, *edges.tolist(), b - a]
                runs = [(s, e) for s, e in zip(bounds[::2], bounds[1::2]) if e > s]
                text = b" ".join(raw[p.starts[a + s] : p.ends[a + e - 1]] for s, e in runs)
            texts.append(text.decode())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrays = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, span)]
    names = [id_col, "n_words", "n_removed", "kept_sha256", "removed"]
    if with_text:
        arrays.append(pa.array(texts, pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(arrays, names)
