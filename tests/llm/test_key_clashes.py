"""Windows whose first 64 bits clash are told apart by the other 64."""

import numpy as np
import pytest

from rollmill.llm.packs import SENT, answered, distinct_pairs, pair_order, per_pack, sent, shared_keys
from rollmill.llm.substring import Passages


@pytest.mark.parametrize("spread", [1, 3, 1 << 60])
def test_distinct_pairs(spread):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, spread, 500).astype(np.uint64), rng.integers(0, 40, 500).astype(np.uint64)
    a, b = np.append(a, a[:50]), np.append(b, b[:50])
    want = sorted(set(zip(a.tolist(), b.tolist())))
    order = pair_order(a, b)
    assert len({(x, y) for x, y in zip(a[order], b[order])}) == 1 + int(((np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)).sum())
    known, back, count = distinct_pairs(a, b)
    assert sorted(zip(a[known].tolist(), b[known].tolist())) == want and count.sum() == len(a)
    assert (a[known][back] == a).all() and (b[known][back] == b).all()
    none = np.zeros(0, np.uint64)
    assert [len(x) for x in distinct_pairs(none, none)] == [0, 0, 0]


def test_clashing_keys_get_no_answer(spark):
    """Three packs in one part: all first halves are alike, only one second half is held by two packs."""
    packs = {1: [10, 11, 12], 2: [20, 11, 22, 23], 3: [30]}
    rows = [(n, 0, bytearray(np.array([[7, b] for b in seconds], "<u8").tobytes())) for n, seconds in packs.items()]
    got = shared_keys(spark.createDataFrame(rows, SENT), 1, 16).collect()
    assert {r.pack: np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(packs[r.pack])).tolist() for r in got} == {1: [0, 1, 0], 2: [0, 1, 0, 0]}


def test_keys_go_out_and_answers_come_back_in_one_order(spark):
    rng = np.random.default_rng(8)
    held = {n: (rng.integers(0, 1 << 63, 300, dtype=np.uint64) & ~np.uint64(0xFFFF), rng.integers(0, 2, 300).astype(np.uint64)) for n in range(4)}
    held = {n: (np.append(a, held[0][0][:100]), np.append(b, held[0][1][:100] ^ np.uint64(n % 2))) for n, (a, b) in held.items()}
    keys, rows = {}, []
    for n, (a, b) in held.items():
        known = distinct_pairs(a, b)[0]
        keys[n] = (a[known], b[known])
        rows += sent(n, *keys[n][:1], 5, 16, keys[n][1]).to_pylist()
    frame = spark.createDataFrame([(r["pack"], r["part"], bytearray(r["keys"])) for r in rows], SENT)
    answers = {r.pack: [x.asDict() for x in r.found] for r in per_pack(shared_keys(frame, 5, 16), "found").collect()}
    for n, (a, b) in keys.items():
        others = {k for m, (x, y) in keys.items() if m != n for k in zip(x.tolist(), y.tolist())}
        assert answered(a, 5, answers.get(n)).tolist() == [k in others for k in zip(a.tolist(), b.tolist())]


def test_halves_of_a_key_are_independent():
    p = Passages(np.array([0, 400]), np.frombuffer(b"word " * 80, np.uint8), 35, 21, np.ones(21, bool))
    first, second = p.window_keys(np.arange(40))
    assert len(set(first.tolist())) == len(set(second.tolist())) == 1 and first[0] != second[0]
