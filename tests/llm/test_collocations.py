"""Phrase counts and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from check import compare, connect
from rollmill.llm import collocations as C
from rollmill.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute_counts(rows, longest=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und" if lang != "" else ""] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang if lang is not None else "und", tuple(w[i : i + k])] += 1
    return f, n


def brute(rows, least=10, top=2000, absorbed=50):
    f, n = brute_counts(rows)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        longer = [b for (other, q), b in cand.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= absorbed * a for b in longer):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top]))


def test_multikey_sort_counts_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, depth, least = rng.integers(0, 200), rng.integers(1, 5), int(rng.integers(1, 8))
        keys, weights = rng.integers(-1, 4, (n, depth)).astype(np.int32), rng.integers(0, 4, n)
        for w in (weights, None):
            want = Counter()
            for row, x in zip(keys.tolist(), (np.ones(n, int) if w is None else w).tolist()):
                for d in range(depth):
                    if row[d] < 0:
                        break
                    want[tuple(row[: d + 1])] += x
            got = [(tuple(keys[p, : d + 1].tolist()), int(c)) for d, (ps, cs) in enumerate(C.multikey_counts(keys, w, least)) for p, c in zip(ps, cs)]
            assert sorted(got) == sorted((k, c) for k, c in want.items() if c >= least)


def made_up(seed, n, langs):
    rnd = random.Random(seed)
    words = ["a", "B", "of", "the", "été", "日本", "x y", "A\x00", "san", "francisco", "bay", "=q", "n m"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        rows.append((text + "san francisco bay" * rnd.randint(0, 1), rnd.choice(langs)))
    return rows


def test_collocations_by_brute_force(spark, monkeypatch):
    rows = made_up(1, 300, ["en", "d e/%", None, "und", "", "=\n"]) + [(None, "en"), ("", None), (" ,. ", "xx"), ("one two three", "rare"), ("z " * 5000, "rep")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("phrase", "a", "n", "f", "size", "part", "k v")})
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == brute(rows)
    assert sorted(tuple(r) for r in C.collocations(df, least=3, top=7, absorbed=80).collect()) == brute(rows, 3, 7, 80)
    counts = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in C.phrase_counts(df, longest=4, least=2).where("size > 0").collect()}
    assert counts == {k: c for k, c in brute_counts(rows, 4)[0].items() if c >= 2}
    assert C.collocations(df.limit(0)).count() == 0
    # Few words counted at a time, and many small parts: phrases across the seams are not lost.
    pairs = lambda: sorted((line, int(c)) for lines, _, counts in C.local_phrases(df.select("text").toArrow().column(0).combine_chunks(), [r[1] for r in rows], 3)
                           for line, c in zip(lines.to_pylist(), counts))
    whole = Counter(dict(pairs()))
    monkeypatch.setattr(C, "POINTERS", 37)
    pieces = Counter()
    for line, c in pairs():
        pieces[line] += c
    assert pieces == whole


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**15, 10**15, 3 * 10**15), (10**15 - 1, 10**15, 10**15 + 7), (12, 3 * 10**17, 10**18), (10**14 + 1, 10**14 + 3, 10**14 + 9)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = {tuple(r)[:3]: r["s"] for r in df.withColumn("s", C.score("l", "r")).collect()}
    assert got == {(a, l, r): 1000000 * a * a // (l * r) for a, l, r in rows}


def test_query_equals_sql(spark):
    _, rows, problems = compare(spark, connect(SF), "op12_collocations", Q.op12_collocations, Q.OP12_SQL, SF)
    assert rows and not problems


def test_rare_phrases_are_not_sorted(monkeypatch):
    """Of a part's lines only those that may be frequent reach the sort; bins that many lines share change nothing."""
    import zstandard

    lines = [b"=en rare%d" % i for i in range(5000)] + [b"=en often", b"=en often here"] * 4 + [b"=en"]
    weight = np.array([1] * 5000 + [3, 2] * 4 + [99], "<i4")
    pack = zstandard.ZstdCompressor().compress
    sent = [pack(b"".join(x + b"\n" for x in lines))], [pack(weight.tobytes())]
    sorted_rows, plain = [], C.multikey_counts
    monkeypatch.setattr(C, "multikey_counts", lambda keys, *a: (sorted_rows.append(len(keys)), plain(keys, *a))[1])
    want = [("en", "", 0, 99), ("en", "often", 1, 12)]
    for bins in (1 << 22, 1):
        monkeypatch.setattr(C, "BINS", bins)
        assert sorted(tuple(r.values()) for r in C._merged(*sent, 3, 10).to_pylist()) == want
    assert sorted_rows[0] < 50 and sorted_rows[1] == len(lines)
