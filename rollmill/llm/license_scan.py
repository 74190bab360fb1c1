"""Fuzzy search for short notices: exact seeds by the pigeonhole rule, then bounded-error matching."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rollmill.llm.arrays import ALNUM, LOWER

SPAN = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                  ("edits", pa.int32()), ("matched", pa.string())])
SCHEMA = ("{id} {kind}, n_words long, spans array<struct<label:string, phrase:string, first_word:long, n_words:long, edits:int, "
          "matched:string>>")

_TABLE = bytes(LOWER[c] if ALNUM[LOWER[c]] else 32 for c in range(256))


class Notice:
    """A phrase (lower case, words joined by spaces) with its seeds: k + 1 pieces, of which k edits leave one intact."""

    def __init__(self, phrase: str, label: str, chars_per_edit: int) -> None:
        self.phrase, self.label, self.text = phrase, label, phrase.encode()
        self.edits = len(phrase) // chars_per_edit
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.figures = sorted(w for w in phrase.split() if any(c.isdigit() for c in w))
        # Whole words from end to end: a blank at an end would be an edit that the words do not have.
        self.pattern = regex.compile(rf"(?b)(?<![^ ])(?=[^ ])(?:{regex.escape(phrase)}){{e<={self.edits}}}(?<=[^ ])(?![^ ])")

    def places(self, text: bytes) -> Iterator[tuple[int, int, int, str]]:
        """(start, end, edits, matched text) in a text of single-spaced words with a space at each end."""
        size, found, scanned = len(self.text), set(), set()
        for offset, seed in self.seeds:
            at = text.find(seed)
            while at >= 0:
                start = at - offset
                if start > 0 and text[start - 1 : start + size + 1] == b" " + self.text + b" ":
                    if start not in found:
                        found.add(start)
                        yield start, start + size, 0, self.phrase
                elif self.edits:
                    # Every character may take four bytes; the margin holds any match around the seed.
                    low, high = max(0, start - 5 * self.edits - 2), min(len(text), start + size + 5 * self.edits + 2)
                    if (low, high) not in scanned:
                        scanned.add((low, high))
                        yield from self.near(text, low, high, found)
                at = text.find(seed, at + 1)

    def near(self, text: bytes, low: int, high: int, found: set[int]) -> Iterator[tuple[int, int, int, str]]:
        while low and text[low] & 0xC0 == 0x80:
            low -= 1
        while high < len(text) and text[high] & 0xC0 == 0x80:
            high += 1
        window = text[low:high].decode()
        for m in self.pattern.finditer(window):
            start = low + len(window[: m.start()].encode())
            end = start + len(m[0].encode())
            cut_off = (start == low and low and text[low - 1] != 32) or (end == high and high < len(text) and text[high] != 32)
            same_figures = sorted(w for w in m[0].split() if any(c.isdigit() for c in w)) == self.figures
            if sum(m.fuzzy_counts) and not cut_off and same_figures and start not in found:
                found.add(start)
                yield start, end, sum(m.fuzzy_counts), m[0]


def spans_of(text: bytes, notices: list[Notice]) -> tuple[int, list[dict]]:
    words = text.translate(_TABLE).split()
    joined = b" " + b" ".join(words) + b" "
    spans, gaps = [], None
    for notice in notices:
        for start, end, edits, matched in notice.places(joined):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            first, last = np.searchsorted(gaps, [start, end]) - 1
            spans.append({"label": notice.label, "phrase": notice.phrase, "first_word": int(first), "n_words": int(last - first + 1),
                          "edits": edits, "matched": matched})
    # A fuzzy reading that overlaps an exact one of the same phrase is the same notice.
    exact = {}
    for s in spans:
        if not s["edits"]:
            exact.setdefault(s["phrase"], []).append(s["first_word"])
    kept = []
    for s in spans:
        if s["edits"] and (at := exact.get(s["phrase"])):
            size, at = len(s["phrase"].split()), np.asarray(at)
            if ((at < s["first_word"] + s["n_words"]) & (at + size > s["first_word"])).any():
                continue
        kept.append(s)
    return len(words), sorted(kept, key=lambda s: (s["first_word"], s["label"], s["edits"]))


def scan_notices(
    docs: DataFrame, notices: Mapping[str, str], *, id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = 10,
) -> DataFrame:
    """Every place of every notice in every whole text, exact or with a bounded number of edits.

    ``notices`` maps a phrase (lower case, words of a-z, 0-9 and non-ASCII characters, single spaces) to its label. A phrase of n
    characters allows n // chars_per_edit edits (characters inserted, deleted or replaced), so short phrases match exactly only.
    Figures in a phrase must be met as they are: a version number one digit off is another notice.

    Texts are lower-cased (A-Z only) and read as words; other ASCII characters separate. Each phrase is cut into one piece more
    than it allows edits: any match keeps a piece whole, so exact search for pieces misses nothing, and the bounded-error
    matcher looks only at a window around a piece. One row per input row: the id, n_words, and spans (label, phrase, first_word
    from 0, n_words, edits, matched text), ordered by place. Null and empty texts: no words, no spans. Repeated rows each
    give a row; a null id stays null; other columns are dropped, whatever their names.

    No shuffle; a task holds one batch of texts.
    """
    for phrase in notices:
        if phrase.encode().translate(_TABLE).split() != phrase.encode().split(b" "):
            raise ValueError(f"not a lower-case phrase of single-spaced words: {phrase!r}")
    compiled = [(p, label, chars_per_edit) for p, label in notices.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Notice(*n) for n in compiled]
        for batch in batches:
            rows = [spans_of(t or b"", known) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(SPAN))],
                [id_col, "n_words", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scan, SCHEMA.format(id=f"`{id_col}`", kind=kind))
