"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
GROUP_CHARS = 1 << 20


class PieceCounter:
    """Counts the pieces of a byte-pair model, of huge texts by overlap resynchronisation.

    A cut in front of a space that follows another character is proven stable if no piece of the vocabulary holds the space mark
    behind another character: no merge can then cross the cut, so both sides are encoded as they would be alone. A mark that stands in
    the text itself is read as a space, which the model normalises to the same mark; where it does not, such texts are encoded whole.
    """

    def __init__(self, model: bytes, chunk_chars: int, overlap_chars: int) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.size = np.array([1 if self.sp.is_byte(i) else len(p.encode()) - 2 * p.count(MARK) for i, p in enumerate(pieces)], np.int64)
        probe = " a  b\tcﬁ　 d "
        plain = self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.proven = plain and not any(MARK in p.lstrip(MARK) for p in pieces)
        marked = f"{MARK} a{MARK}b {MARK * 2}c{MARK} "
        self.alike = self.sp.normalize(marked) == self.sp.normalize(marked.replace(MARK, " "))
        self.widened = 0

    def counts(self, texts: list[str]) -> list[int]:
        whole = [len(t) <= self.chunk + self.overlap or not self.proven or (MARK in t and not self.alike) for t in texts]
        encoded = iter(self._short([t for t, w in zip(texts, whole) if w]))
        return [next(encoded) if w else self.spliced(t.replace(MARK, " ")) for t, w in zip(texts, whole)]

    def _short(self, texts: list[str]) -> Iterator[int]:
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= GROUP_CHARS):
                chars += len(texts[upto])
                upto += 1
            yield from map(len, self.sp.encode(texts[at:upto], num_threads=1))
            at = upto

    def starts(self, text: str) -> np.ndarray:
        """Byte offsets in the text at which a token of its own encoding begins; the mark put in front counts as byte -1."""
        ids = np.asarray(self.sp.encode(text), np.int64)
        ends = np.cumsum(self.size[ids]) - 1
        if len(ends) and ends[-1] != len(text.encode()):
            raise ValueError("the pieces do not add up to the text")
        return np.concatenate([[-1], ends[:-1]]) if len(ends) else ends

    def spliced(self, text: str) -> int:
        """Tokens of a text longer than a chunk, with no mark of its own."""
        total, begin, clean = 0, 0, 0  # the chunk starts at begin; its tokens count from clean on
        while True:
            overlap = self.overlap
            while True:
                end = min(len(text), begin + self.chunk + overlap)
                piece = text[begin:end]
                starts = self.starts(piece)
                low = 0 if clean == begin else int(np.searchsorted(starts, len(text[begin:clean].encode())))
                if end == len(text):
                    return total + len(starts) - low
                cut = self.common(text, starts, begin, end, overlap)
                if cut:
                    break
                overlap *= 2
                self.widened += 1
            total += int(np.searchsorted(starts, len(text[begin:cut].encode()))) - low
            begin, clean = max(cut - self.overlap, cut - self.chunk // 2, clean), cut

    def common(self, text: str, starts: np.ndarray, begin: int, end: int, overlap: int) -> int:
        """The last proven cut within the overlap at which both this chunk's encoding and the following one's have a boundary."""
        low = max(begin + 1, end - overlap)
        at = text.rfind(" ", low, end)
        while at > low:
            if text[at - 1] != " ":
                here = len(text[begin:at].encode())
                k = int(np.searchsorted(starts, here))
                if k < len(starts) and starts[k] == here:
                    lead = max(at - self.overlap, at - self.chunk // 2, begin)
                    after = self.starts(text[lead:end])
                    there = len(text[lead:at].encode())
                    k = int(np.searchsorted(after, there))
                    if lead == at or (k < len(after) and after[k] == there):
                        return at
            at = text.rfind(" ", low, at)
        return 0


def count_tokens(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16384,
    overlap_chars: int = 256, limit: int = 4096,
) -> DataFrame:
    """Tokens of every whole text under a sentencepiece model, as the library counts them for the whole text at once.

    Texts of more than chunk_chars + overlap_chars characters are encoded in chunks that overlap; two neighbours are joined at a
    proven cut (see PieceCounter) inside the overlap at which both encodings have a boundary. Where an overlap holds none, it is
    doubled, up to the rest of the text. A U+2581 in a text counts as the space that the model takes it for. A model that folds
    characters, or has pieces across spaces, allows no proof, and its texts are encoded whole.

    One row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit. Null and empty texts: 0 tokens. Repeated rows each
    give a row, a null id stays null, other columns are dropped. The model is read on the driver (a fixed file of under 1 MB)
    and goes with the task. No shuffle; a task holds one batch of texts and one chunk's tokens.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model, chunk_chars, overlap_chars)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.array(counter.counts(texts), np.int64)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
