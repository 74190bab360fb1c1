"""What a pack takes of an executor's memory: in the JVM, where many stand side by side, and in a worker, which works on one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rollmill.llm import packs
from rollmill.llm.arrays import covered
from rollmill.llm.substring import Passages, difference_cover, remove_repeats


def prose(seed, n_words):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeinorst", k=rnd.randint(1, 9))) for _ in range(3000)]
    return " ".join(rnd.choices(words, k=n_words))


def peak(f):
    tracemalloc.start()
    try:
        base = tracemalloc.get_traced_memory()[0]
        f()
        return tracemalloc.get_traced_memory()[1] - base
    finally:
        tracemalloc.stop()


@pytest.fixture
def docs(spark):
    texts = [prose(k, 400) for k in range(300)] + [None, "", "é\x00 é"]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).cache()


def test_texts_stay_compressed_until_their_pack_is_opened(spark, docs):
    made, size = packs.pack(docs, "doc_id", "text", "trial")
    rows = made.toArrow()
    assert rows.nbytes < 0.7 * size
    got = {}
    for batch in rows.to_batches():
        for _, ids, offsets, data, rest in packs.each_pack(batch):
            assert rest == {}
            got |= {i: data[a:b].tobytes() for i, a, b in zip(ids.to_pylist(), offsets, offsets[1:])}
    assert got == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


def test_a_large_task_fills_several_buckets_in_small_row_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(packs, "PACK_BYTES", 4000)
    monkeypatch.setattr(packs, "BUCKET_BYTES", 200_000)
    monkeypatch.setattr(packs, "GROUP_BYTES", 20_000)
    made, size = packs.pack(docs, "doc_id", "text", "trial")
    assert size > 600_000 and made.select("pack").distinct().count() == made.count()
    by_bucket = made.groupBy(F.expr("pmod(hash(pack), 8)")).agg(F.sum("size").alias("n")).collect()
    assert len(by_bucket) == -(-size // 200_000) and max(r.n for r in by_bucket) <= 200_000
    for file in made.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file:").replace("///", "/")).metadata
        assert max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 60_000


def test_rows_are_the_same_however_packs_are_dealt(spark, docs, monkeypatch):
    again = docs.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("other words "), F.substring("text", 1, 900)).alias("text")))
    want = sorted(map(tuple, remove_repeats(again.coalesce(1), with_text=True).collect()))
    monkeypatch.setattr(packs, "PACK_BYTES", 5000)
    monkeypatch.setattr(packs, "BUCKET_BYTES", 20_000)
    assert sorted(map(tuple, remove_repeats(again.coalesce(1), with_text=True).collect())) == want
    assert sum(r[2] > 0 for r in want) > 500


def test_a_worker_needs_few_arrays_of_a_pack(spark):
    data = np.frombuffer(prose(1, 350_000).encode()[: packs.PACK_BYTES], np.uint8)
    offsets = np.array([0, len(data)])
    cover = np.isin(np.arange(21), difference_cover(21))
    Passages(offsets, data, 35, 21, cover)  # powers are made once
    assert peak(lambda: Passages(offsets, data, 35, 21, cover)) < 20 * len(data)
    starts = np.arange(0, len(data) - 50, 3)
    assert peak(lambda: covered(starts, 50, len(data))) < 16 * len(data)


def test_covered_by_definition():
    rng = np.random.default_rng(2)
    for n, length in ((1, 1), (40, 3), (40, 60), (500, 200)):
        starts = rng.integers(0, n, rng.integers(0, 8))
        want = np.zeros(n, bool)
        for s in starts:
            want[s : s + length] = True
        assert (covered(starts, length, n) == want).all()
