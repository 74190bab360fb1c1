"""A convolutional text classifier in numpy: hashed embeddings of words and their stems, filters of several widths, max pooling."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.llm.arrays import ALNUM, LOWER, slices, text_bytes, word_hashes, words_of
from rollmill.llm.staging import quoted, schema_of, written
from rollmill.llm.url_filter import possibly_listed

BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
GAP = max(WIDTHS) - 1
STEM = 4
EPOCHS = 8
#: Rows that learn together, about, and bytes of their words (4 a word) at most.
SHARD_ROWS, UNIT_BYTES = 4000, 16 << 20
#: What a row is there for, in bits.
FIT, KEPT = 1, 2
#: Numbers are summed as whole multiples of its inverse.
ONE = float(1 << 24)
GRID = np.linspace(0.2, 0.8, 61)
#: A language with fewer rows for calibration takes the common threshold.
LEAST_ROWS = 60
_LOWER = np.frombuffer(LOWER, np.uint8)


def held_out(id_col: str) -> Column:
    """Rows that labels are never learnt from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_buckets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets (1 .. BUCKETS - 1) of every lower-cased word, of the word and of its first STEM characters, as rows of an
    (n, 2) array; and the index of each text's first word."""
    data = _LOWER[data]
    starts, ends, first = words_of(offsets, data, ALNUM)
    lead = (data & 0xC0) != 0x80
    places = np.append(np.flatnonzero(lead), np.full(STEM + 1, len(data)))
    stem_ends = np.minimum(places[np.cumsum(lead)[starts] - 1 + STEM], ends) if len(starts) else ends
    hashed = [word_hashes(data, starts, ends), word_hashes(data, starts, stem_ends) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)]
    return np.stack([(h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for h in hashed], axis=1), first


def padded(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with GAP zeros behind each, and where each begins; a window then never meets two texts."""
    n = np.diff(first)
    begin = first[:-1] + GAP * np.arange(len(n))
    out = np.zeros((len(words) + GAP * len(n), 2), np.int32)
    out[np.arange(len(words)) + GAP * np.repeat(np.arange(len(n)), n)] = words
    return out, begin


@dataclass
class TextCnn:
    """score(text) = sigmoid(scale * (v . relu(max over places of the filters) + bias) + shift)."""

    dim: int = 12
    filters: int = 12
    seed: int = 7
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, self.dim)).astype(np.float32)
        self.embed[0] = 0
        self.conv = [rng.normal(0, 0.3, (w, self.dim, self.filters)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * self.filters).astype(np.float32)
        self.bias = np.float32(0)
        self.constant: float | None = None
        self.known = np.ones(BUCKETS, bool)

    def fit(self, texts: list[np.ndarray], y: np.ndarray, *, epochs: int = EPOCHS) -> None:
        """Minimise the logistic loss by Adagrad; only the windows that win the pooling carry gradients."""
        self.forget(sum((met_in([t]) for t in texts), np.zeros(BUCKETS, np.int64)))
        rng, squares = np.random.default_rng(self.seed), self.fresh_squares()
        for _ in range(epochs):
            self.learn(texts, y, squares, rng)

    def forget(self, met: np.ndarray, least_texts: int = 3) -> None:
        """Buckets met in fewer than least_texts texts tell nothing: they are zero, here and in all that is scored later."""
        self.known = met >= least_texts
        self.known[0] = False
        self.embed[~self.known] = 0

    def fresh_squares(self) -> list[np.ndarray]:
        return [np.full_like(p, 1e-2) for p in (self.embed, *self.conv, self.out)] + [np.full(1, 1e-2)]

    def _winners(self, ids: np.ndarray, begin: np.ndarray, stop: np.ndarray, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter the largest sum and where its window begins (-1: no words); long texts go through in pieces."""
        pooled, won = np.zeros((len(begin), len(self.out)), np.float32), np.full((len(begin), len(self.out)), -1)
        for low in range(0, len(ids), step):
            part = ids[low : low + step + GAP]
            x = self.embed[part[:, 0]] + self.embed[part[:, 1]]
            for k, w in enumerate(WIDTHS):
                u = np.ascontiguousarray(sum(x[j : len(x) - w + 1 + j] @ self.conv[k][j] for j in range(w)).T)
                here = slice(k * self.filters, (k + 1) * self.filters)
                for i, (a, b) in enumerate(zip(np.maximum(begin - low, 0), np.minimum(stop - low, step))):
                    if b > a:
                        top = u[:, a:b].argmax(axis=1)
                        value = u[np.arange(self.filters), a + top]
                        better = (won[i, here] < 0) | (value > pooled[i, here])
                        pooled[i, here] = np.where(better, value, pooled[i, here])
                        won[i, here] = np.where(better, low + a + top, won[i, here])
        return pooled, won

    def learn(self, texts: list[np.ndarray], y: np.ndarray, squares: list[np.ndarray], rng: np.random.Generator, *, batch: int = 32,
              rate: float = 0.25, decay: float = 1e-4) -> None:
        """One pass over the texts, in an order of the generator's."""
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            first = np.cumsum([0, *(len(texts[i]) for i in pick)])
            ids, begin = padded(np.concatenate([texts[i] for i in pick]), first)
            ids = np.where(self.known[ids], ids, 0)
            pooled, won = self._winners(ids, begin, np.append(begin[1:], len(ids)) - GAP)
            active = pooled > 0
            pooled *= active
            miss = _sigmoid(pooled @ self.out + self.bias) - y[pick]
            grad = (miss[:, None] * self.out * active).astype(np.float32) / len(pick)
            g_out = pooled.T @ miss / len(pick) + decay * self.out
            g_conv = [decay * c for c in self.conv]
            touched, deltas = [], []
            for k, w in enumerate(WIDTHS):
                for f in range(self.filters):
                    column = k * self.filters + f
                    use = np.flatnonzero(active[:, column])
                    g = grad[use, column]
                    for j in range(w):
                        words = ids[won[use, column] + j]
                        g_conv[k][j, :, f] += (self.embed[words[:, 0]] + self.embed[words[:, 1]]).T @ g
                        touched += [words[:, 0], words[:, 1]]
                        deltas += [g[:, None] * self.conv[k][j, :, f]] * 2
            if touched:
                words, where = np.unique(np.concatenate(touched), return_inverse=True)
                g_embed = np.zeros((len(words), self.dim), np.float32)
                np.add.at(g_embed, where, np.concatenate(deltas))
                g_embed[words == 0] = 0
                squares[0][words] += g_embed**2
                self.embed[words] -= rate * g_embed / np.sqrt(squares[0][words])
            for p, g, s in zip((*self.conv, self.out), (*g_conv, g_out), squares[1:]):
                s += g**2
                p -= rate * g / np.sqrt(s)
            squares[-1] += float(miss.mean()) ** 2
            self.bias -= np.float32(rate * miss.mean() / np.sqrt(squares[-1][0]))

    def as_rows(self, squares: list[np.ndarray]) -> np.ndarray:
        """All that is learnt, as rows of 2 * dim numbers: parameters, then their squares. A row for each bucket, then the rest."""
        rest = [np.concatenate([np.ravel(x) for x in some]) for some in ((*self.conv, self.out, [self.bias]), squares[1:])]
        rest = [np.pad(x, (0, -len(x) % self.dim)).reshape(-1, self.dim) for x in rest]
        return np.concatenate([np.concatenate([self.embed, squares[0]], axis=1), np.concatenate(rest, axis=1)], dtype=np.float32)

    def from_rows(self, rows: np.ndarray) -> list[np.ndarray]:
        """Takes the parameters over and returns the squares."""
        self.embed, squares = rows[:BUCKETS, : self.dim].astype(np.float32), [rows[:BUCKETS, self.dim :].astype(np.float32)]
        values, sums = (rows[BUCKETS:, half].ravel() for half in (slice(None, self.dim), slice(self.dim, None)))
        at = 0
        for p in (*self.conv, self.out):
            p[:] = values[at : at + p.size].reshape(p.shape)
            squares.append(sums[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        self.bias = np.float32(values[at])
        return [*squares, sums[at : at + 1].copy()]

    def tables(self) -> list[np.ndarray]:
        """Of every offset in a window: what a bucket adds to all filters that reach so far. Scoring is look-up and addition."""
        return [np.concatenate([self.embed @ c[j] for c in self.conv if len(c) > j], axis=1) for j in range(max(WIDTHS))]

    def logits(self, words: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Of each text, before calibration; texts of any length go through in pieces."""
        n = np.diff(first)
        pooled = np.zeros((len(n), len(self.out)), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            ids, begin = padded(words, first)
            stop = np.append(begin[1:], len(ids)) - GAP
            step = 1 << 17
            for low in range(0, len(ids), step):
                high = min(low + step, len(ids))
                inside = some[(begin[some] < high) & (stop[some] > low)]
                if not len(inside):
                    continue
                part = np.concatenate([ids[low : min(high + GAP, len(ids))], np.zeros((max(0, high + GAP - len(ids)), 2), np.int32)])
                # The gap behind a text belongs to it here. Windows that begin there reach into the next text, so they are set to 0, as relu would.
                starts = np.maximum(begin[inside], low) - low
                u = np.zeros((high - low, len(self.out)), np.float32)
                for j, table in enumerate(tables):
                    at = part[j : high - low + j]
                    u[:, -table.shape[1] :] += table[at[:, 0]] + table[at[:, 1]]
                u[part[: high - low, 0] == 0] = 0
                pooled[inside] = np.maximum(pooled[inside], np.maximum.reduceat(u, starts, axis=0))
        return pooled @ self.out + self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return _sigmoid(self.scale * logits.astype(np.float64) + self.shift)

    def calibrate(self, logits: np.ndarray, y: np.ndarray, weight: np.ndarray, lang: np.ndarray) -> None:
        """Platt's scale and shift, and per language the threshold of the best F1; languages with few rows take the common one."""
        def sums(a: float, b: float, goals: tuple[float, float]) -> list[float]:
            p = _sigmoid(a * logits + b)
            h, g = weight * p * (1 - p) + 1e-9, weight * (p - np.where(y > 0, goals[1], goals[0]))
            return [np.sum(x) for x in (h * logits**2, h * logits, h, g * logits, g)]

        self.platt(sums, float((1 - y).sum()), float(y.sum()))
        s = self.score(logits)
        counted = lambda own: [np.array([np.sum((weight * c)[own] * (s[own] >= t)) for t in GRID]) for c in (y, 1 - y)]
        every = np.ones(len(y), bool)
        if 0 < y.sum() < len(y):
            self.threshold = _best_f1(*counted(every), float(np.sum(weight * y)), 0.5)
        for name in sorted({x for x in lang if x is not None}):
            own = lang == name
            if own.sum() >= LEAST_ROWS and 0 < y[own].sum() < own.sum():
                self.thresholds[name] = _best_f1(*counted(own), float(np.sum((weight * y)[own])), self.threshold)

    def platt(self, sums: Callable[[float, float, tuple[float, float]], list[float]], clean: float, toxic: float) -> None:
        """Scale and shift by Newton's method, from the sums of h x^2, h x, h, g x and g over all rows of logit x."""
        a, b, goals = 1.0, 0.0, (1 / (2 + clean), 1 - 1 / (2 + toxic))
        for _ in range(50):
            hxx, hx, h, gx, g = sums(a, b, goals)
            da, db = np.linalg.solve(np.array([[hxx + 1e-3, hx], [hx, h + 1e-3]]), [gx + 1e-3 * (a - 1), g])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
            if max(abs(da), abs(db)) < 1e-6:
                break
        self.scale, self.shift = float(max(a, 1e-3)), float(b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _best_f1(hit: np.ndarray, wrong: np.ndarray, toxic: float, otherwise: float) -> float:
    """The middle of the thresholds of best F1, given what each flags; ``otherwise`` where most of what it flags is clean."""
    f1 = 2 * hit / np.maximum(hit + wrong + toxic, 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    best = best[len(best) // 2]
    return float(GRID[best]) if hit[best] >= 4 * wrong[best] and hit[best] else otherwise


def met_in(texts: list[np.ndarray]) -> np.ndarray:
    """In how many of the texts each bucket is met."""
    met = np.zeros(BUCKETS, np.int64)
    for t in texts:
        met[np.unique(t)] += 1
    return met


UNIT = "shard int, n int, toxic int, size long, words binary, lengths binary, y binary, role binary, langs array<string>"
UNIT_ARROW = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("toxic", pa.int32()), ("size", pa.int64()), *[(c, pa.binary()) for c in ("words", "lengths", "y", "role")],
                        ("langs", pa.list_(pa.string()))])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of UNIT: texts of one shard that are learnt from together, of about UNIT_BYTES at most. Rows come in the order of shards."""
    held: list[tuple] = []
    size = 0

    def unit() -> pa.RecordBatch:
        shard, words, y, role, langs = zip(*held)
        columns = [[shard[0]], [len(y)], [sum(y)], [size], [b"".join(words)], [np.array([len(w) // 4 for w in words], "<i8").tobytes()],
                   [bytes(y)], [bytes(role)], [list(langs)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, UNIT_ARROW)], schema=UNIT_ARROW)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "_y", "role", "_lang"))):
            if held and (row[0] != held[0][0] or size + len(row[1]) > UNIT_BYTES):
                yield unit()
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield unit()


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[str | None]]]:
    """Of each unit the texts as arrays of buckets, their labels, roles and languages."""
    for k in range(batch.num_rows):
        blob = {c: batch.column(c)[k].as_buffer() for c in ("words", "lengths", "y", "role")}
        ends = np.cumsum(np.frombuffer(blob["lengths"], "<i8"))
        words = np.frombuffer(blob["words"], "<u2").reshape(-1, 2)
        texts = [words[a:b] for a, b in zip([0, *ends], ends)]
        yield texts, np.frombuffer(blob["y"], np.int8).astype(np.float32), np.frombuffer(blob["role"], np.int8), batch.column("langs")[k].as_py()


def _learn_apart(model: TextCnn, units: DataFrame) -> None:
    """Passes over all units: each learns from a copy of the model, and the steps of all are averaged by their texts after every pass.

    A row of parameters is averaged over the units that moved it. Sums are of whole numbers, so their order tells nothing.
    What moves is a row of parameters for each that a unit touched; the driver holds the model alone.
    """
    context, n = units.sparkSession.sparkContext, 2 * model.dim

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts, _, role, _ in _opened(batch):
                met += met_in([t for t, r in zip(texts, role) if r & FIT])
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(met[at])], ["key", "met"])

    got = units.mapInArrow(meet, "key int, met long").groupBy("key").agg(F.sum("met").alias("met")).toArrow()
    met = np.zeros(BUCKETS, np.int64)
    met[got["key"].to_numpy()] = got["met"].to_numpy()
    model.forget(met)
    squares = model.fresh_squares()
    names = [f"s{i}" for i in range(n)]
    for epoch in range(EPOCHS):
        shared = context.broadcast((model, squares))

        def step(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            base = None
            for batch in batches:
                for k, (texts, y, role, _) in enumerate(_opened(batch)):
                    own, sums = copy.deepcopy(shared.value)
                    base = own.as_rows(sums) if base is None else base
                    fit = np.flatnonzero(role & FIT)
                    if not len(fit):
                        continue
                    order = np.random.default_rng([own.seed, epoch, batch.column("shard")[k].as_py()])
                    own.learn([texts[i] for i in fit], y[fit], sums, order)
                    moved = own.as_rows(sums).astype(np.float64) - base
                    at = np.flatnonzero(moved.any(axis=1))
                    whole = np.rint(moved[at] * len(fit) * ONE).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), len(fit))), *[pa.array(c) for c in np.ascontiguousarray(whole.T)]],
                        ["key", "n", *names])

        moved = units.mapInArrow(step, ", ".join(["key int", "n long", *[f"{c} long" for c in names]]))
        mean = [(F.sum(c) / (F.sum("n") * ONE)).cast("float").alias(c) for c in names]
        got = moved.groupBy("key").agg(*mean).toArrow()
        shared.destroy()
        rows, at = model.as_rows(squares), got["key"].to_numpy()
        for i, c in enumerate(names):
            rows[at, i] += got[c].to_numpy()
        squares = model.from_rows(rows)


def _calibrate_apart(model: TextCnn, units: DataFrame) -> None:
    """As calibrate, from sums over all rows that are there for it. They are of whole numbers, so their order tells nothing."""
    shared = units.sparkSession.sparkContext.broadcast((model, model.tables()))

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = shared.value
        for batch in batches:
            for texts, y, role, langs in _opened(batch):
                own = np.flatnonzero(role & KEPT)
                if len(own):
                    first = np.cumsum([0, *(len(texts[i]) for i in own)])
                    x = known.logits(np.concatenate([texts[i] for i in own]), first, tables).astype(np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x), pa.array(y[own].astype(np.int32)), pa.array([langs[i] for i in own], pa.string())], ["x", "y", "lang"])

    rows = written(units.mapInArrow(logits, "x double, y int, lang string"), "toxicity-logits")
    share = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    x, y = F.col("x"), F.col("y")
    chance = lambda a, b: 1 / (1 + F.exp(-F.greatest(F.least(a * x + b, F.lit(30.0)), F.lit(-30.0))))

    def sums(a: float, b: float, goals: tuple[float, float]) -> list[float]:
        p = chance(a, b)
        h, g = p * (1 - p) + 1e-9, p - F.when(y > 0, goals[1]).otherwise(goals[0])
        return [v / ONE for v in rows.agg(*[F.sum(F.round(c * ONE).cast("long")) for c in (h * x * x, h * x, h, g * x, g)]).first()]

    model.platt(sums, float(share.get(0, 0)), float(share.get(1, 0)))
    level = F.size(F.filter(F.array(*[F.lit(float(t)) for t in GRID]), lambda t: t <= chance(model.scale, model.shift)))
    large = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"))
    large = large.where((F.col("n") >= LEAST_ROWS) & (F.col("toxic") > 0) & (F.col("toxic") < F.col("n"))).select("lang")
    flagged: dict[str | None, np.ndarray] = {}
    for some, name in ((rows, F.lit(None)), (rows.join(large, "lang", "left_semi"), F.col("lang"))):
        for r in some.groupBy(name.cast("string").alias("lang"), "y", level.alias("level")).count().collect():
            flagged.setdefault(r["lang"], np.zeros((2, len(GRID) + 1)))[r["y"], r["level"]] = r["count"]
    for name in sorted(flagged, key=lambda name: (name is not None, name)):
        # Reaching the t-th threshold: all levels beyond t.
        wrong, hit = np.cumsum(flagged[name][:, ::-1], axis=1)[:, ::-1]
        if hit[0] and wrong[0]:
            best = _best_f1(hit[1:], wrong[1:], hit[0], 0.5 if name is None else model.threshold)
            if name is None:
                model.threshold = best
            else:
                model.thresholds[name] = best


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang",
    shard_rows: int = SHARD_ROWS, **options,
) -> TextCnn:
    """A classifier from every labelled row that is not held out, with its whole text.

    Up to shard_rows rows (and UNIT_BYTES of their words) are learnt from in the driver. More are dealt by a hash of the id into
    shards of about that many, which learn side by side and are averaged after every pass (see _learn_apart). A fifth of the rows of each label
    serves calibration and is not fitted; where a label has fewer than 50 rows beyond one shard, they do both. The language serves the
    thresholds only. Several labels of an id: the highest counts; several rows of an id: the one of the least text hash. Without rows
    of both labels the score is the smoothed share of label 1.

    Texts are reduced to buckets before they move, and a Bloom filter of the labelled ids leaves out most others before that.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = written(known.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_y").alias("_y")).where(F.col("_y").isin(0, 1)), "toxicity-labels")
    share = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    n_shards = max(1, -(-sum(share.values()) // shard_rows))
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.cast("string").alias("_lang"))
    rows = possibly_listed(rows, known, "_id", sum(share.values())).select("_id", "_text", "_lang", F.xxhash64("_text").alias("_hash"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            words, first = word_buckets(*text_bytes(part.column("_text")))
            raw = words.astype("<u2").tobytes()  # a bucket takes 16 bits
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((4 * first).astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_hash"), packed.cast(pa.binary()), part.column("_lang")], ["_id", "_hash", "words", "_lang"])

    rows = rows.mapInArrow(listed, schema_of("_id", docs.schema[id_col].dataType, "_hash long, words binary, _lang string"))
    # Nothing but the filter is broadcast, however few the labels.
    rows = rows.join(known.hint("shuffle_hash"), "_id").groupBy("_id", "_y").agg(F.min(F.struct("_hash", "words", "_lang")).alias("_one"))
    small = [y for y in (0, 1) if share.get(y, 0) < 50]
    part = F.pmod(F.xxhash64(F.lit("kept"), "_id"), F.lit(5))
    role = F.when(F.col("_y").isin(small), FIT | KEPT).when(part == 0, KEPT).otherwise(FIT) if small else F.when(part == 0, KEPT).otherwise(FIT)
    rows = rows.select(
        F.pmod(F.xxhash64("_id"), F.lit(n_shards)).cast("int").alias("shard"), F.col("_id").cast("string").alias("_name"), "_y",
        "_one.words", "_one._lang", role.cast("int").alias("role"),
    )
    units = rows.repartition(F.col("shard")).sortWithinPartitions("shard", "_name").select("shard", "words", "_y", "role", "_lang").mapInArrow(_units, UNIT)
    # Not compressed, so that files tell Spark how much a task will hold.
    units = written(units, "toxicity-units", "uncompressed")
    n, toxic, size = units.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "toxic", "size")]).first()
    model = TextCnn(**options)
    if not 0 < toxic < n:
        model.constant = (share.get(1, 0) + 1) / (share.get(0, 0) + share.get(1, 0) + 2)
        return model
    if n > shard_rows or size > UNIT_BYTES:
        _learn_apart(model, units)
        _calibrate_apart(model, units)
        return model
    opened = [unit for batch in units.toArrow().to_batches() for unit in _opened(batch)]
    texts, langs = [t for unit in opened for t in unit[0]], [x for unit in opened for x in unit[3]]
    y = np.concatenate([unit[1] for unit in opened])
    kept = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        kept[np.random.default_rng(model.seed).permutation(own)[: max(1, len(own) // 5)]] = True
    model.fit([t for t, k in zip(texts, kept) if not k], y[~kept])
    first = np.cumsum([0, *(len(t) for t, k in zip(texts, kept) if k)])
    logits = model.logits(np.concatenate([t for t, k in zip(texts, kept) if k]), first, model.tables())
    weight = np.where(y[kept] > 0, share[1] / y[kept].sum(), share[0] / (1 - y[kept]).sum())
    model.calibrate(logits, y[kept], weight / weight.mean(), np.array(langs, object)[kept])
    return model


def score_toxicity(
    docs: DataFrame, model: TextCnn, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Score (0 to 1) of every whole text and flagged: the score reaches the threshold of the row's language.

    A language that calibration did not see, a null one, or a table without the column takes the common threshold; the language
    is no input of the score. Null and empty texts score by the bias alone. Repeated rows each give a row, a null id stays null,
    other columns are dropped. The model (tables of fixed size, 8 MB) is broadcast. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.tables()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = shared.value
        for part in slices(batches, "_text"):
            words, first = word_buckets(*text_bytes(part.column("_text")))
            s = known.score(known.logits(words, first, tables))
            limit = np.array([known.thresholds.get(x, known.threshold) for x in part.column("_lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(s, pa.float64()), pa.array(s >= limit)], [id_col, "score", "flagged"])

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"), lang.alias("_lang"))
    return d.mapInArrow(score, schema_of(id_col, docs.schema[id_col].dataType, "score double, flagged boolean"))
