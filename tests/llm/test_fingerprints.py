"""Fingerprints against plain sums, and edits against slicing of whole texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmill.llm import queries as Q
from rollmill.llm.arrays import text_bytes
from rollmill.llm.fingerprints import EXACT, added, decoded, encoded, fingerprint_edits, fingerprint_texts, likeness, vectors

SF = "/root/testdata/sf0.001"


def vector(*texts):
    import pyarrow as pa

    return vectors(*text_bytes(pa.array(texts, pa.string())))


def exact_sum(text):
    total = [0] * EXACT
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            digest = hashlib.sha256(line.encode()).digest()
            total = [(t + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % 2**64 for k, t in enumerate(total)]
    return total


def test_sums_of_paragraphs():
    lines = ["one two three four five six seven", "a b", "", " \t", "über 日本 😀 x y z", "a b", "\r", "w " * 300]
    rnd = random.Random(2)
    texts = ["\n".join(rnd.sample(lines, rnd.randint(0, len(lines)))) for _ in range(60)]
    for text, v in zip(texts, vector(*texts)):
        assert v["exact"].tolist() == exact_sum(text)
    a, b = vector("\n".join(lines)), vector("\n".join(reversed(lines)))
    assert encoded(a) == encoded(b) and likeness(a, b)[0] == 1
    assert decoded(encoded(a)).tobytes() == a.tobytes()
    # Inserting and deleting paragraphs is adding and subtracting their vectors; a repeated one counts twice.
    assert encoded(added(vector(*["x y\nz"]), vector("new line"))) == encoded(vector("z\nnew line\nx y"))
    assert encoded(added(a, vector("a b"), -1)) == encoded(vector("\n".join(x for i, x in enumerate(lines) if i != 1)))
    assert encoded(vector("a b")) != encoded(vector("a b\na b"))
    assert not vector("", None, "\n \n").view(np.uint8).any()


def test_likeness_estimates_shared_shingles():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    for shared in (0, 200, 500, 800, 1000):
        common = " ".join(word() for _ in range(shared))
        x, y = (common + "\n" + " ".join(word() for _ in range(1000 - shared)) for _ in range(2))
        assert likeness(vector(x), vector(y))[0] == pytest.approx(shared / 1000, abs=0.25)
    assert likeness(vector("w " * 300_000), vector("w " * 150_000))[0] == pytest.approx(1 - 0.25 / 1.25, abs=0.01)
    assert likeness(vector("", "a"), vector("", ""))[1] == 0


def brute(rows):
    out = []
    for k, (i, text) in enumerate(rows):
        n = len(text)
        following = rows[(k + 1) % len(rows)][1]
        edited = text[: n - n // 2] + following[: n // 2]
        mine, after, other = vector(text, edited, following)[:, None]
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), encoded(mine)[0], encoded(after)[0], likeness(mine, after)[0], likeness(mine, other)[0]))
    return out


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_edits_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = Q.op13_fingerprints(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", *COLUMNS).collect()) == sorted(brute(rows))
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint_texts(docs).collect()}
    assert prints == {r["doc_id"]: r["fingerprint"] for r in got.collect()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_edits_of_edge_rows(spark, kind):
    big = 2**53
    rows = [(None, "no id"), (None, None), (big, "é日本😀"), (big + 1, "x\ny"), (big + 2, ""), (5, " "), (5, "word" * 3), (7, "same"), (7, "same"),
            (3, "a\n" * 50_000), (2, None), (1, "\n\n")]
    df = spark.createDataFrame([(i if i is None or kind == "long" else f"k{i:020}", t) for i, t in rows], f"doc_id {kind}, text string")
    df = df.withColumns({c: F.lit("x") for c in ("_id", "_text", "_hash", "key", "a b", "n_chars")})
    hashes = dict(df.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    order = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0 if kind == "long" else "", hashes[r[1]])
    ordered = sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=order, reverse=True)
    want = brute([(i, t or "") for i, t in ordered])
    for parts in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [tuple(r) for r in fingerprint_edits(df).select("doc_id", *COLUMNS).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprint_edits(df.limit(0)).count() == 0
    assert fingerprint_edits(df.where("text = 'x\ny'")).first()["near_next"] == 1
