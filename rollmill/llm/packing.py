"""Token ids of whole texts and hierarchical multi-length packing."""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from rollmill.llm.arrays import mix, ragged, slices, span_hashes

LETTER, NUMBER, SPACE, OTHER = range(4)
#: What the byte-level pre-tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE_WORDS = 2_000_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    kinds = np.full(0x10000, OTHER, np.uint8)
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(name, plane):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind  # a run cannot span the surrogates: neither neighbour is in these classes
    return kinds


class ByteBpe:
    """Ids of texts under a byte-level BPE vocabulary file, the same as the tokenizers library gives without added tokens.

    Words (pre-tokens) are cut by array operations and looked up in a cache of ids; only unseen words are merged. Texts with the
    vocabulary's special strings or with characters beyond the basic plane go to the library whole.
    """

    def __init__(self, vocabulary: str) -> None:
        self.library = Tokenizer.from_str(vocabulary)
        spec = json.loads(vocabulary)
        self.special = [t["content"] for t in spec["added_tokens"]]
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.merges = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kinds = _classes()
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each text."""
        plain = [t if t.isascii() or max(t) < "\U00010000" else None for t in texts]
        plain = [None if t is not None and any(s in t for s in self.special) else t for t in plain]
        ids, counts = self._plain([t or "" for t in plain])
        if None not in plain:
            return ids, counts
        parts, ends = [], np.cumsum(counts)
        for i, t in enumerate(plain):
            parts.append(ids[ends[i] - counts[i] : ends[i]] if t is not None else np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32))
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.cumsum([0, *map(len, texts)])
        starts = self.cut(chars, first)
        ends = np.append(starts[1:], len(chars))
        words, back, where = self._looked_up(whole, chars, starts, ends)
        size = self.size[words][back]
        ids = self.pool[ragged(self.at[words][back], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = total[np.searchsorted(starts, first)]
        return ids, np.diff(bounds)

    def cut(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the words: runs of one class, a single space joining what follows it."""
        n = len(chars)
        kind = self.kinds[chars]
        fresh = np.zeros(n + 1, bool)
        fresh[first] = True
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        after_space = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:n]) + 1
        start[after_space - 1] = True
        start[after_space] = chars[after_space - 1] != 32
        start |= fresh[:n]
        quotes = np.flatnonzero(start & (chars == 39))
        if len(quotes):
            end = first[np.searchsorted(first, quotes, "right")]
            padded = np.concatenate([chars, np.zeros(2, np.uint32)])
            done = np.zeros(len(quotes), bool)
            for ending in ENDINGS:
                hit = ~done & (quotes + 1 + len(ending) <= end)
                for k, c in enumerate(ending):
                    hit &= padded[quotes + 1 + k] == ord(c)
                done |= hit
                start[quotes[hit] + 1] = False
                behind = quotes[hit] + 1 + len(ending)
                start[behind[behind < n]] = True
        return np.flatnonzero(start)

    def _looked_up(self, whole: str, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = mix(chars.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        keys, where, back = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            merge = self.merges._encode_single_piece
            got = [merge(whole[a:b]) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            size = np.array(list(map(len, got)), np.int64)
            place = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, np.array([i for g in got for i in g], np.uint32)])
            self.at, self.size = np.insert(self.at, at[new], place), np.insert(self.size, at[new], size)
            self.keys = np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return at, back, where


def pack_lengths(lengths: Sequence[int], tiers: Sequence[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (capacity, pieces (document, start, length)) for documents of these lengths.

    A document at least as long as the longest tier is cut into whole windows of it. What is left is routed to the shortest tier
    that holds it. Windows are opened for the longest documents first; the gap of a window is filled with the longest document of
    its own or a shorter tier that fits, and when none fits with the head of the next longer one, whose rest is routed anew. So
    every window but the last is full.
    """
    top, windows = tiers[-1], []
    waiting: list[tuple[int, int, int]] = []  # (length, document, start), sorted
    for doc, n in enumerate(lengths):
        whole = n // top
        windows += [(top, [(doc, i * top, top)]) for i in range(whole)]
        if n % top:
            waiting.append((n % top, doc, whole * top))
    waiting.sort()
    while waiting:
        n, doc, start = waiting.pop()
        capacity = tiers[bisect_left(tiers, n)]
        pieces, gap = [(doc, start, n)], capacity - n
        while gap and waiting:
            at = bisect_right(waiting, (gap, len(lengths), 0)) - 1
            if at >= 0:
                n, doc, start = waiting.pop(at)
                pieces.append((doc, start, n))
                gap -= n
            else:
                n, doc, start = waiting.pop(0)
                pieces.append((doc, start, gap))
                insort(waiting, (n - gap, doc, start + gap))
                gap = 0
        windows.append((capacity, pieces))
    return windows


def step_groups(sizes: Sequence[int], tokens_per_step: int) -> list[int]:
    """Deals windows to steps of about equal tokens: the longest first, each to the lightest step."""
    steps = max(1, round(sum(sizes) / tokens_per_step))
    load = [(0, s) for s in range(steps)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, step = load[0]
        heapq.heapreplace(load, (held + sizes[i], step))
        out[i] = step
    return out


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
          ("offset", pa.int64()), ("tier", pa.int64()), ("padded_length", pa.int64()), ("step_group", pa.int64())]


def pack_documents(
    docs: DataFrame, vocabulary_path: str, *, end_id: int = 1, tiers: Sequence[int] = (256, 512, 1024, 2048), id_col: str = "doc_id",
    text_col: str = "text", group_bytes: int = 4 << 20, tokens_per_step: int = 1 << 16, with_ids: bool = False,
) -> DataFrame:
    """Pack every document's ids (and the end id) into windows of several lengths, one row per piece.

    Documents are taken as the input is partitioned, in groups of at most group_bytes of text (or one document); each
    group is packed by pack_lengths and its windows dealt to steps by step_groups. So nothing is shuffled, no group grows with the
    input, and each group wastes less than one window. A window whose tokens are not a power of two is padded to the longest tier
    (padded_length); that is at most the last window of a group.

    Columns: id, start, length, ids_crc32 (of the ids as little-endian 32-bit), doc_tokens, sequence_id (unique; partition and
    number within it), offset in the window, tier, padded_length, step_group (unique in the same way) and, on request, the ids.
    Null and empty texts hold the end id alone. Repeated rows are packed each for itself, a null id stays null, other
    columns are dropped, an empty table gives no rows. The vocabulary (a fixed file of under 2 MB) goes with the task.
    """
    tiers = sorted(tiers)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared_bpe(vocabulary)
        sequence = step = TaskContext.get().partitionId() << 32
        for part in slices(batches, text_col, group_bytes):
            ids, counts = bpe.encode([t or "" for t in part.column(1).to_pylist()])
            begin = np.cumsum(counts) - counts
            lengths = (counts + 1).tolist()
            windows = pack_lengths(lengths, tiers)
            sizes = [sum(p[2] for p in pieces) for _, pieces in windows]
            padded = [n if n & (n - 1) == 0 else tiers[-1] for n in sizes]
            steps = step_groups(padded, tokens_per_step)
            rows, held = [], []
            for w, (capacity, pieces) in enumerate(windows):
                offset = 0
                for doc, start, n in pieces:
                    a = begin[doc] + start
                    piece = ids[a : a + min(n, counts[doc] - start)]
                    if len(piece) < n:
                        piece = np.append(piece, np.uint32(end_id))
                    raw = piece.astype("<u4").tobytes()
                    rows.append((doc, start, n, zlib.crc32(raw), lengths[doc], sequence + w, offset, capacity, padded[w], step + steps[w]))
                    if with_ids:
                        held.append(piece.astype(np.int64))
                    offset += n
            sequence += len(windows)
            step += max(steps, default=-1) + 1
            columns = list(zip(*rows))
            arrays = [part.column(0).take(pa.array(columns[0], pa.int64()))]
            arrays += [pa.array(c, t) for c, (_, t) in zip(columns[1:], FIELDS)]
            names = [id_col, *(n for n, _ in FIELDS)]
            if with_ids:
                arrays.append(pa.array(held, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n, _ in FIELDS) + (", ids array<long>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(pack, schema)


_BPE: dict[int, ByteBpe] = {}


def _shared_bpe(vocabulary: str) -> ByteBpe:
    """One per worker process: its cache of words serves all tasks."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _BPE:
        _BPE.clear()
        _BPE[key] = ByteBpe(vocabulary)
    return _BPE[key]
