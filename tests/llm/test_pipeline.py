"""The whole pipeline against a brute-force version, on odd columns and edge rows; packs and what stays of near copies."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from rollmill.llm import packs
from rollmill.llm.simhash import fingerprint, keep_one
from rollmill.llm.toxicity import score_toxicity, train

BPE = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed=7, n=150):
    """Clean, toxic, copied and contaminated texts, texts that share a passage, and empty ones."""
    rnd = random.Random(seed)
    word = lambda k=1: " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 3000)) for _ in range(k))
    passage, item = word(50), word(20)
    rows = []
    for i in range(n):
        text = word(rnd.randint(5, 90))
        if i % 5 == 0:
            text += " vile scumbag filth " * 3
        elif i % 7 == 0:
            text = f"{text}\n{passage} {word(9)}"
        elif i % 11 == 0:
            text = f"{item} {word(10)}"
        elif i % 13 == 0 and rows:
            text = rnd.choice(rows)[1]
        rows.append((i, "" if i == 33 else text, rnd.choice(["en", "de"]), f"s{i % 3}", len(text)))
    return rows, [(1, item), (2, word(30))]


def toxic_ids(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in score_toxicity(docs, train(docs, labels)).where("flagged").collect()}


def one_of_each(rows, radius=2):
    prints = {r[0]: fingerprint(r[1].encode()) for r in rows}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius:
                    root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if root[r[0]] == r[0]]


def without_repeats(rows, window=35):
    seen = defaultdict(int)
    split = {r[0]: r[1].split() for r in rows}
    for w in split.values():
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] += 1
    out = []
    for r in rows:
        w = split[r[0]]
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        if len(gone) == len(w) and w:
            continue
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r[1]
        out.append((r[0], text, *r[2:]))
    return out


def clean(rows, items, window=13):
    wanted = {tuple(t.split()[k : k + window]) for _, t in items for k in range(len(t.split()) - window + 1)}
    out = []
    for r in rows:
        w = r[1].split()
        hit = {j for k in range(len(w) - window + 1) if tuple(w[k : k + window]) in wanted for j in range(k, k + window)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_the_whole_pipeline_by_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    toxic = toxic_ids(spark, rows, labels)
    assert toxic and len(toxic) < 60
    left = clean(without_repeats(one_of_each([r for r in rows if r[0] not in toxic])), items)
    assert 40 < len(left) < 150 - len(toxic) - 10
    pieces = defaultdict(list)
    for r in P.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {r[0] for r in left}
    tokens = Tokenizer.from_file(BPE)
    for i, text, *_ in left:
        ids = np.array([*tokens.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at += p["length"]
        assert at == len(ids)


def test_stages_take_odd_columns_and_rows(spark, tmp_path):
    rows, items = corpus(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").drop("lang")
    extra = spark.createDataFrame([(None, "no id", "s", 5), (-1, None, "s", 0), (901, None, "s", 0), (902, "x " * 40_000, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    for c in ("a b", "meta.src", "row", "pack", "place", "fp", "score", "flagged", "Größe", "kept_text", "contaminated"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id")))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for at in (docs, docs.limit(0)):
        now = at
        for name, stage in P.STAGES[:-1]:
            after = P.written(stage(spark, now, str(tmp_path)), name)
            assert after.schema.names == docs.columns and after.exceptAll(after.dropDuplicates()).count() == 0
            # Nothing but the text and its length is changed.
            same = [f"`{c}`" for c in docs.columns if c not in ("text", "n_chars")]
            assert after.select(*same).exceptAll(now.select(*same)).count() == 0
            if name == "near_dedup":
                assert [r["doc_id"] for r in after.where("text is null").collect()] == ([-1] if at is docs else [])
                assert after.where("doc_id is null").count() == (1 if at is docs else 0)
            now = after
        P.packing(spark, now, str(tmp_path)).count()


def test_one_stays_whatever_the_partitions(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 60), rnd.choice(["a b c d", "A b c d", "e f g h", "", None, f"t{rnd.randint(0, 9)} x y"])) for _ in range(200)] + [(None, "a b c d")] * 2
    first = set()
    for parts in (1, 4, 9):
        got = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        first.add(tuple(sorted(map(tuple, got), key=str)))
    assert len(first) == 1
    got = first.pop()
    prints = [fingerprint((t or "").encode()) for i, t in got if i is not None]
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])
    assert sum(i is None for i, _ in got) == 2
    by_print = {fingerprint((t or "").encode()): i for i, t in got if i is not None}
    for i, t in rows:
        if i is not None:
            assert min(v for k, v in by_print.items() if (k ^ fingerprint((t or "").encode())).bit_count() <= 2) <= i


@pytest.mark.parametrize("buckets", [1, 8, 51])
def test_packs_of_a_task_share_a_file(spark, monkeypatch, buckets):
    numbers = np.array([0, 1, -1, 5 << 32, 12345678901234, 2**63 - 1, -(2**63)])
    df = spark.createDataFrame([(int(x),) for x in numbers], "x long")
    assert packs._bucket(numbers, buckets).tolist() == [r[0] for r in df.select(F.expr(f"pmod(hash(x), {buckets})")).collect()]
    monkeypatch.setattr(packs, "PACK_BYTES", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text")).repartition(4)
        made, size = packs.pack(docs, "doc_id", "text", "trial")
        files = made.inputFiles()
        assert size == 2000 * 100 and made.count() >= 190 and made.select("pack").distinct().count() == made.count()
        assert len(files) <= 4 and all(os.path.exists(f.removeprefix("file://")) for f in files)
        asked = made.select("pack").withColumn("x", F.lit(1))
        joined = packs.with_answers(made, asked)
        assert joined.where("x = 1").count() == made.count()
        joined.collect()
        # The answers move, the packs don't.
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_fingerprints_by_definition():
    text = "One  two\tthree four"
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in (b"one two three", b"two three four")]
    assert fingerprint(text.encode()) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 2)
