"""Shards of op10: what a crowded gram takes of a worker's memory, and that its strings are told apart byte for byte."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rollmill.llm import suffix_dedup
from rollmill.llm.suffix_dedup import _least_alike, _least_ids, sorted_shards, suffix_array

LENGTH, SPAN = 50, 31
REACH, SIZE = SPAN - 1, LENGTH - SPAN + 1
WIDTH = 2 * REACH + SIZE


def around_one_gram(n, seed, free=30):
    """Contexts of one gram in ever other surroundings, from a column on and up to one."""
    rng = np.random.default_rng(seed)
    left = rng.integers(0, SPAN, n)
    right = np.maximum(rng.integers(0, SPAN, n), REACH - left)
    line = rng.integers(97, 123, WIDTH)
    edge = rng.integers(0, free, (n, 1))
    column = np.arange(WIDTH)
    common = (column >= edge) & (column < edge + 60) | (column >= REACH) & (column < REACH + SIZE)
    body = np.where(common, line, rng.integers(97, 123, (n, WIDTH)))
    body[(column < (REACH - left)[:, None]) | (column >= (REACH + SIZE + right)[:, None])] = 0
    return np.concatenate([left[:, None], right[:, None], body], axis=1).astype(np.uint8), rng.integers(0, n, n)


def sent(contexts, ids, n_packs):
    rows = [
        (k, 0, contexts[at].tobytes(), ids[at].astype("<i8").tobytes(), at.astype("<i8").tobytes())
        for k, at in enumerate(np.array_split(np.arange(len(ids)), n_packs))
    ]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["pack", "part", "keys", "ids", "places"])


class Caught:
    """Stands for the rows: keeps the function that a task would run."""

    def repartitionById(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        raise StopIteration


def task(batch):
    rows = Caught()  # a mapInArrow of its own ends the plan there
    with pytest.raises(StopIteration):
        sorted_shards(rows, 1, LENGTH, SPAN)
    return [r for found in rows.run(iter([batch])) for r in found.to_pylist()]


def traced(f):
    tracemalloc.start()
    try:
        base = tracemalloc.get_traced_memory()[0]
        out = f()
        return out, tracemalloc.get_traced_memory()[1] - base
    finally:
        tracemalloc.stop()


def strings(contexts):
    for row, c in enumerate(contexts):
        for start in range(REACH - int(c[0]), int(c[1]) + 1):
            yield row, start, c[2 + start : 2 + start + LENGTH].tobytes()


def smaller_holder(contexts, ids):
    least = {}
    for row, _, s in strings(contexts):
        least[s] = min(ids[row], least.get(s, ids[row]))
    return {(row, start) for row, start, s in strings(contexts) if least[s] < ids[row]}


def found(rows):
    out = set()
    for r in rows:
        at = np.frombuffer(r["places"], "<i8")
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(at) * SPAN).reshape(-1, SPAN)
        out |= {(int(at[a]), int(b)) for a, b in zip(*np.nonzero(bits))}
    return out


@pytest.fixture
def spark_functions(spark):
    """Columns of Spark need a session."""
    return spark


@pytest.mark.parametrize("crowd", [10, 1 << 15])
@pytest.mark.parametrize("free", [1, 30])
def test_bits_of_a_crowded_gram(spark_functions, monkeypatch, crowd, free):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 7)
    contexts, ids = around_one_gram(300, 1, free)
    contexts, ids = np.concatenate([contexts, contexts[:40]]), np.concatenate([ids, ids[:40] + 1])
    want = smaller_holder(contexts, ids)
    assert found(task(sent(contexts, ids, 9))) == want and len(want) > 400


def test_a_crowded_gram_takes_little_more_than_its_contexts(spark_functions):
    contexts, ids = around_one_gram(150_000, 2)
    got, peak = traced(lambda: task(sent(contexts, ids, 100)))
    assert len(got) == 100 and peak < 3.2 * (contexts.nbytes + 16 * len(ids))


def test_a_large_lot_is_sorted_in_little_memory():
    contexts, ids = around_one_gram(8000, 3)
    _, peak = traced(lambda: _least_ids(contexts, ids, LENGTH, SPAN))
    assert peak < 60 * contexts.size
    s = np.random.default_rng(0).integers(0, 256, 200_000)
    _, peak = traced(lambda: suffix_array(s))
    assert peak < 75 * len(s)


@pytest.mark.parametrize("hashes", [None, lambda words: np.zeros(len(words), np.uint64), lambda words: words[:, 0] % np.uint64(3)])
def test_strings_of_one_hash_are_compared_byte_for_byte(monkeypatch, hashes):
    if hashes:
        monkeypatch.setattr(suffix_dedup, "_string_hashes", hashes)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 16)
    rng = np.random.default_rng(4)
    for length in (1, 8, 13):
        contexts = rng.integers(0, 2, (200, 20)).astype(np.uint8)
        contexts[:, 3 : 3 + length - min(length, 3)] = 1
        rows, ids = rng.permutation(200)[:150], rng.integers(0, 99, 150)
        least = {}
        for r, i in zip(rows, ids):
            key = contexts[r, 3 : 3 + length].tobytes()
            least[key] = min(i, least.get(key, i))
        assert _least_alike(contexts, rows, 3, length, ids).tolist() == [least[contexts[r, 3 : 3 + length].tobytes()] for r in rows]
