"""The classifier against a plain forward pass, and the sample it learns from against the texts themselves."""

import math
import random
import zlib

import numpy as np
import pytest

from rollmill.llm.arrays import text_bytes
from rollmill.llm.toxicity import BUCKETS, WIDTHS, TextCnn, score_toxicity, train, word_buckets


def learnable(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def buckets_of(text):
    import pyarrow as pa

    return word_buckets(*text_bytes(pa.array([text], pa.string())))[0]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    texts = [" ".join([f"w{rnd.randint(0, 90000)}" for _ in range(rnd.randint(1, 300))] + ["vile"] * (i % 3 == 0)) for i in range(240)]
    texts[1], texts[4], texts[5], texts[7] = None, "", "ünïcödé 漢字 ... a", "one two"
    return texts


def tables(spark, texts):
    docs = spark.createDataFrame([(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(len(texts))], "doc_id long, toxic int")


def test_what_reaches_the_driver_are_the_words_of_the_texts(spark, monkeypatch, corpus):
    seen, fit, calibrate = [], TextCnn.fit, TextCnn.logits
    monkeypatch.setattr(TextCnn, "fit", lambda self, texts, y: (seen.extend(t.tolist() for t in texts), fit(self, texts, y))[1])
    monkeypatch.setattr(TextCnn, "logits", lambda self, words, first, tabs: (
        seen.extend(words[a:b].tolist() for a, b in zip(first, first[1:])), calibrate(self, words, first, tabs))[1])
    docs, labels = tables(spark, corpus)
    train(docs.repartition(5), labels)
    wanted = [buckets_of(t).tolist() for i, t in enumerate(corpus) if learnable(i)]
    assert sorted(seen) == sorted(wanted)
    assert max(b for t in wanted for pair in t for b in pair) > BUCKETS // 2


def test_scores_equal_a_plain_forward_pass(spark, corpus):
    docs, labels = tables(spark, corpus)
    model = train(docs, labels)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(corpus)
    for i, text in enumerate(corpus):
        ids = buckets_of(text)
        x = [model.embed[a].astype(float) + model.embed[b].astype(float) for a, b in ids.tolist()]
        x += [np.zeros(model.dim)] * (max(WIDTHS) - 1)  # behind the last word stand zeros
        logit = float(model.bias)
        for k, width in enumerate(WIDTHS):
            for f in range(model.filters):
                # A window begins at every word; no filter falls below 0, so an empty text has the bias alone.
                best = max([0.0] + [sum(float(x[at + j] @ model.conv[k][j, :, f]) for j in range(width)) for at in range(len(ids))])
                logit += best * float(model.out[k * model.filters + f])
        score = 1 / (1 + math.exp(-(model.scale * logit + model.shift)))
        assert got[i]["score"] == pytest.approx(score, abs=1e-4)
        limit = model.thresholds.get(["en", "de", None][i % 3], model.threshold)
        assert got[i]["flagged"] == (got[i]["score"] >= limit)


def test_long_texts_are_learnt_from(spark):
    rnd = random.Random(3)
    texts = [" ".join([f"n{rnd.randint(0, 300)}" for _ in range(6000 if i % 3 == 0 else 60)] + ["vile", "scumbag"] * (i % 3 == 0)) for i in range(240)]
    assert min(len(t) for t in texts[::3]) > 1 << 14
    docs, labels = tables(spark, texts)
    model = train(docs, labels)
    assert model.constant is None
    got = score_toxicity(docs, model).collect()
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got) > 0.95 * len(got)


def test_shards_learn_from_every_row_together(spark, monkeypatch):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    texts = [" ".join([f"n{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 80))] + [f"vile{i // 4 % 20}", "scumbag"] * (i % 4 == 0)) for i in range(1200)]
    texts[0] = " ".join(["long"] * 5000 + ["scumbag"])
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(len(texts))], "doc_id long, toxic int")
    monkeypatch.setattr(TextCnn, "fit", lambda *_: pytest.fail("gathered"))
    models = [train(d, labels, shard_rows=200) for d in (docs, docs.repartition(7))]
    assert all((models[0].embed == m.embed).all() and m.scale == models[0].scale and m.thresholds == models[0].thresholds for m in models)
    held = F.pmod(F.xxhash64(F.lit("kept"), "doc_id"), F.lit(5)) == 0
    fitted = [r["doc_id"] for r in docs.where(~held).collect() if learnable(r["doc_id"])]
    met = np.zeros(BUCKETS, int)
    for i in fitted:
        met[np.unique(buckets_of(texts[i]))] += 1
    assert (models[0].known[1:] == (met[1:] >= 3)).all()
    got = score_toxicity(docs, models[0]).collect()
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in got) > 0.98 * len(got)
    assert sum(r["flagged"] == (r["doc_id"] % 4 == 0) for r in got) > 0.98 * len(got)
