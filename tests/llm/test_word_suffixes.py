"""Suffix arrays over words, and the longest matches found in them, against brute force."""

import random
import re

import numpy as np
import pytest

from rollmill.llm.decontaminate import Shard, find_contamination, suffix_order


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_are_in_whole_order(seed):
    rng = random.Random(seed)
    texts = [[rng.randint(1, 1 + seed) for _ in range(rng.choice([0, 1, 3, 40, 300]))] for _ in range(12)]
    texts += [texts[-1]] * 3 + [[1] * 500, [1] * 499, []]
    codes = np.array([c for t in texts for c in (*t, 0)], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    order = suffix_order(codes, first).tolist()
    rest = {int(first[d]) + i: t[i:] for d, t in enumerate(texts) for i in range(len(t) + 1)}
    assert sorted(order) == list(range(len(codes)))
    assert [rest[p] for p in order] == sorted(rest.values())


def test_shards_of_nothing():
    for offsets in ([0], [0, 0], [0, 0, 0]):
        shard = Shard.of(np.array(offsets), np.zeros(0, np.uint8))
        assert len(shard.order) == len(offsets) - 1 and (shard.codes_of(np.arange(3, dtype=np.uint64)) == -1).all()


@pytest.mark.parametrize("shard_bytes,block_words", [(1 << 20, 1 << 20), (900, 20)])
def test_longest_match_its_place_and_its_item(spark, shard_bytes, block_words):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(f"i{k}", say(rng.choice([2, 6, 30, 60]))) for k in range(14)] + [("i99", None), ("i98", " "), ("b", "c b a"), ("a", "c b a")]
    docs = [(d, say(rng.choice([0, 1, 50, 200]))) for d in range(40)] + [(50 + k, f"x {t} {t} y") for k, (_, t) in enumerate(items) if t]
    got = find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"),
        window=5, shard_bytes=shard_bytes, block_words=block_words,
    ).collect()
    known = {i: re.findall(r"[a-z0-9]+", t or "") for i, t in items}
    texts = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        w = texts[r["doc_id"]].split()
        best = (0, 0, "")
        for i, v in known.items():
            for s in range(len(v)):
                for p in range(len(w)):
                    n = 0
                    while p + n < len(w) and s + n < len(v) and w[p + n] == v[s + n]:
                        n += 1
                    if n >= min(5, len(v)):
                        best = min(best, (-n, p, i))
        assert (r["longest_match"], r["longest_at"], r["longest_item"]) == ((-best[0], best[1], best[2]) if best[0] else (0, None, None))


def test_a_long_item_in_a_long_text(spark):
    text = " ".join(f"w{i * i % 997}" for i in range(40_000))
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, text[: len(text) // 2])], "doc_id long, text string")
    got = find_contamination(docs, spark.createDataFrame([("i", text)], "item_id string, text string")).orderBy("doc_id").collect()
    assert (got[0]["longest_match"], got[0]["longest_at"], got[0]["n_hit"]) == (40_000, 1, 40_000)
    assert got[1]["longest_at"] == 0 and got[1]["longest_match"] >= 19_000
