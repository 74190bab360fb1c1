"""The method parts of license scan and quality rules: every error at every place, and expectation-maximisation in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmill.llm import queries as Q
from rollmill.llm.license_scan import Notice, scan_notices, spans_of
from rollmill.llm.quality import RULES, fit_label_model, judge_quality

ALL = Q.NOTICES | Q.MORE_NOTICES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def errors(phrase):
    """Every text one edit away (one letter, digit-free) that still is single-spaced words."""
    out = set()
    for i in range(len(phrase) + 1):
        out.add(phrase[:i] + phrase[i + 1 :])
        for c in "xé ":
            out |= {phrase[:i] + c + phrase[i:], phrase[:i] + c + phrase[i + 1 :]}
    return {t for t in out if t == " ".join(t.split()) and t != phrase}


@pytest.mark.parametrize("phrase", [p for p in ALL if len(p) >= 10])
def test_no_error_at_any_place_is_lost(phrase):
    notice = Notice(phrase, "x", 10)
    assert notice.edits >= 1
    figures = sorted(w for w in phrase.split() if any(c.isdigit() for c in w))
    for text in errors(phrase):
        if sorted(w for w in text.split() if any(c.isdigit() for c in w)) != figures:
            continue
        for around in ("{}", "{} y", "released {}", "a b {} c d"):
            _, spans = spans_of(around.format(text).encode(), [notice])
            assert spans, (around, text)
            assert all(0 < s["edits"] <= notice.edits or s["matched"] == phrase for s in spans)


def test_near_notices_in_random_texts_by_edit_distance():
    rnd = random.Random(8)
    phrase = "under the mit license"
    notice = Notice(phrase, "mit", 10)
    for _ in range(400):
        text = list(phrase)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(text))
            text[i : i + rnd.randint(0, 1)] = rnd.choice(["", "q", " ", "ü", "the "])
        words = (" ".join(rnd.choices(["the", "a", "mit", "under"], k=rnd.randint(0, 3))) + " " + "".join(text) + " " + rnd.choice(["", "x", "license"])).split()
        near = any(distance(phrase, " ".join(words[i:j])) <= notice.edits for i in range(len(words)) for j in range(i + 1, len(words) + 1))
        _, spans = spans_of(" ".join(words).encode(), [notice])
        assert bool(spans) == near, words
        for s in spans:
            assert distance(phrase, " ".join(words[s["first_word"] : s["first_word"] + s["n_words"]])) <= notice.edits


def test_labels_of_the_method_join_the_base_ones(spark):
    rows = spark.createDataFrame([(1, "This work is licensed under the GNU General Publik License, version 3."), (2, "Under the MIT License. All rights reserved"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: sorted({s["label"] for s in r["spans"]}) for r in scan_notices(rows, ALL).collect()}
    assert got == {1: ["gpl"], 2: ["mit", "reserved"], 3: []}
    result = Q.op1_license_scan(spark, "/root/testdata/sf0.01")
    assert result.where("labels <> base_labels").count() > 0
    assert result.where("base_labels <> '' and not contains(labels, base_labels)").count() == 0


def plain_em(votes, rounds=25, prior=0.8, start=0.8, smoothing=1.0):
    up = np.tile([1 - start, start], (votes.shape[1], 1))
    for _ in range(rounds):
        odds = np.full(len(votes), np.log(prior / (1 - prior)))
        for j, v in enumerate(votes.T):
            odds += np.where(v > 0, np.log(up[j, 1] / up[j, 0]), np.where(v < 0, np.log((1 - up[j, 1]) / (1 - up[j, 0])), 0))
        p = 1 / (1 + np.exp(-odds))
        prior = (p.sum() + smoothing) / (len(votes) + 2 * smoothing)
        for j, v in enumerate(votes.T):
            for c, w in ((0, 1 - p), (1, p)):
                share = start if c else 1 - start
                up[j, c] = (w[v > 0].sum() + 2 * smoothing * share) / (w[v != 0].sum() + 2 * smoothing)
    odds = np.full(len(votes), np.log(prior / (1 - prior)))
    for j, v in enumerate(votes.T):
        odds += np.where(v > 0, np.log(up[j, 1] / up[j, 0]), np.where(v < 0, np.log((1 - up[j, 1]) / (1 - up[j, 0])), 0))
    return 1 / (1 + np.exp(-odds))


def test_posterior_by_plain_expectation_maximisation(spark):
    judged = judge_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    votes = judged[[f"vote_{r.name}" for r in RULES]].to_numpy()
    # The operator stops once nothing moves any more.
    assert np.allclose(judged["posterior"], plain_em(votes), atol=1e-4)
    assert 0 < (~judged["good"]).sum() < len(judged) / 3


def test_verdict_tells_more_than_the_base_rule(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Q.op5_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    poor = got["quality"] == 0
    base, kept = ~got["base_failed"], got["kept"]
    assert (kept & poor).sum() < 0.5 * (base & poor).sum()
    assert (~kept & ~poor).sum() <= (~base & ~poor).sum() + 0.01 * (~poor).sum()


def test_no_rows_leave_the_start_values(spark):
    none = spark.createDataFrame([], ", ".join(f"vote_{r.name} int" for r in RULES) + ", n long")
    model = fit_label_model(none)
    assert model.prior == 0.8 and model.probability((0,) * len(RULES)) == pytest.approx(0.8)
    assert none.select(model.posterior()).count() == 0 and F is not None


def test_url_list_tells_what_urls_do_not(spark):
    from check import compare, connect
    from rollmill.llm.url_filter import is_junk

    sf = "/root/testdata/sf0.01"
    _, rows, problems = compare(spark, connect(sf), "op2_url_filter", Q.op2_url_filter, Q.ORACLES["op2_url_filter"], sf)
    assert rows == 250 and not problems
    got = Q.op2_url_filter(spark, sf).toPandas()
    free = got[got["rule"].isna()]
    assert 0 < free["listed"].sum() < len(free) / 2
    # Hosts with listed pages hold others too, so no word of the host decides.
    by_host = got.groupby("host")["listed"].agg(["sum", "size"])
    assert ((by_host["sum"] > 0) & (by_host["sum"] < by_host["size"])).any()
    pages = spark.createDataFrame([(None,), ("",), ("<p>a b</p>",), ("<p a='#####'>a b</p>",), ("<p>a# b*",)], "html string")
    assert [r[0] for r in pages.select(is_junk(F.col("html"))).collect()] == [False, False, False, False, True]
