"""Resampling by weights against exact chances and drawn rows; rules under a deadline; rollout files as JSON arrays."""

import itertools
import json
import math
import os
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollmill.functions import registry as R
from rollmill.operators import resample as RS
from rollmill.sources import files as S
from rollmill.sources import sinks as K
from rollmill.streaming import rollouts as ST


def exact_majority(rows, n):
    """Mean and deviation of the majority's value over all orders of n draws from rows (value, vote)."""
    total, square, every = 0.0, 0.0, 0
    for drawn in itertools.product(rows, repeat=n):
        votes = Counter(v for _, v in drawn)
        won = max(votes, key=lambda v: (votes[v], -next(i for i, d in enumerate(drawn) if d[1] == v)))
        x = next(x for x, v in drawn if v == won)
        total, square, every = total + x, square + x * x, every + 1
    return total / every, math.sqrt(max(square / every - (total / every) ** 2, 0))


def test_majority_of_every_n_equals_all_orders(spark):
    groups = {"a": [(1.0, "x"), (0.0, "y"), (0.0, None), (1.0, "x")], "b": [(2.0, "x"), (5.0, "x"), (0.0, "z")], "c": [(3.0, None)]}
    df = spark.createDataFrame([(g, x, v) for g, rows in groups.items() for x, v in rows], "g string, x double, v string")
    got = {(r["g"], r["n"]): r for r in RS.bootstrap_by_weights(df, ["g"], "x", vote="v", names=("maj", "best", "mean"), rounds=40_000).collect()}
    assert set(got) == {("a", 2), ("a", 4), ("b", 2), ("b", 3), ("c", 1)}
    for (g, n), r in got.items():
        mean, std = exact_majority(groups[g], n)
        assert r["maj_mean"] == pytest.approx(mean, abs=0.04) and r["maj_std"] == pytest.approx(std, abs=0.04)
        every = [max(x for x, _ in d) for d in itertools.product(groups[g], repeat=n)]
        assert r["best_mean"] == pytest.approx(np.mean(every), abs=0.04) and r["best_std"] == pytest.approx(np.std(every), abs=0.04)
        xs = [x for x, _ in groups[g]]
        assert r["mean_mean"] == pytest.approx(np.mean(xs), abs=0.04) and r["mean_std"] == pytest.approx(np.std(xs) / n**0.5, abs=0.04)


def test_extremes_have_the_chances_of_drawn_rows():
    value, weight = np.array([3.0, -1.0, 7.0, 2.0]), np.array([4, 1, 2, 3])
    for n in (1, 2, 3, 8, 100_000):
        top, bottom = RS.extremes(value, weight, n, 200_000, np.random.default_rng(n))
        for x in value:
            assert np.mean(top <= x) == pytest.approx((weight[value <= x].sum() / 10) ** n, abs=0.005)
            assert np.mean(bottom >= x) == pytest.approx((weight[value >= x].sum() / 10) ** n, abs=0.005)
        assert np.mean((top <= 3) & (bottom >= 2)) == pytest.approx(0.7**n, abs=0.005)
        counts = RS.drawn(weight / 10, n, 50_000, np.random.default_rng(n))
        assert (counts.sum(axis=1) == n).all() and counts.mean(axis=0) == pytest.approx(n * weight / 10, rel=0.03)


def test_extremes_of_many_distinct_values_are_not_drawn_row_by_row():
    value, one = np.arange(200_000.0), np.ones(200_000, np.int64)
    begin = time.time()
    got = RS.resampled(value, one, one, 200_000, 1000, np.random.default_rng(1), {"best": RS.best, "worst": RS.worst})
    assert time.time() - begin < 2  # a count for each row and round takes many times that
    assert got["best"][0] > 199_990 and got["worst"][0] < 10


def test_cost_follows_distinct_votes_and_partitions_change_nothing(spark):
    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 5).cast("string").alias("v"))
    runs = [sorted(map(tuple, RS.bootstrap_by_weights(d, ["g"], "x", vote="v", names=("maj", "worst")).collect())) for d in (df, df.repartition(11))]
    assert runs[0] == runs[1] and {r[1] for r in runs[0]} == {2**k for k in range(1, 17)} | {100_000}
    plan = RS.bootstrap_by_weights(df, ["g"], "x")._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert RS.bootstrap_by_weights(df.limit(0), ["g"], "x").count() == 0
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("k", None)], "g string, x double")
    assert [(r["g"], r["n"]) for r in RS.bootstrap_by_weights(nulls, ["g"], "x").collect()] == [(None, 2)]


def test_a_rule_that_never_returns_scores_zero_and_the_job_ends(spark):
    def _odd(data_source, solution, truth, extra):
        text = solution.iloc[0]
        if text == "hang":
            while True:
                time.sleep(1)
        if text == "die":
            os._exit(3)
        if text == "raise":
            raise ValueError(text)
        return [1.0]

    texts = ["ok", "hang", "ok", "raise", "die", "ok", "hang", "ok"]
    df = spark.createDataFrame([(i, "s", t, "") for i, t in enumerate(texts)], "id int, data_source string, solution string, truth string").coalesce(2)
    begin = time.time()
    got = {r["id"]: r["score"] for r in R.reward_manager(df, "prime", _odd, seconds=1.5).collect()}
    assert time.time() - begin < 40
    assert got == {i: float(t == "ok") for i, t in enumerate(texts)}
    assert R.scores_in_time(_odd, tuple(pd.Series([], dtype=str) for _ in range(4)), 1.0) == []
    with pytest.raises(TypeError):
        R.reward_manager(df, "batch", F.lit(1.0))


RECORD = "input string, output string, score double, extra array<struct<a:int>>"


def test_arrays_of_records_are_split_at_their_seams(spark, tmp_path):
    tricky = ['}, {"input": "x"', "a\nb", '\\"}, {\\"input\\": ', "", "é😀", "}]", "[{", " "]
    records = [{"input": tricky[i % 8], "output": tricky[(i // 8) % 8] * 9, "score": i / 2, "extra": [{"a": i}] if i % 3 else None} for i in range(4000)]
    os.makedirs(tmp_path / "track=A" / "step=3")
    os.makedirs(tmp_path / "track=B" / "step=4")
    for name, some in (("track=A/step=3/3_rollouts.json", records), ("track=B/step=4/4_rollouts.json", records[:1]), ("track=B/step=4/5_rollouts.json", [])):
        (tmp_path / name).write_text(json.dumps(some, ensure_ascii=False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = S.read_rollout_arrays(spark, str(tmp_path), schema=RECORD, partitions="track string, step int")
        rows = df.collect()
        shared = df.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(r["input"], r["output"], r["score"], r["extra"], "A", 3) for r in records] + [(records[0]["input"], records[0]["output"], 0.0, None, "B", 4)]
    got = [(r["input"], r["output"], r["score"], [{"a": x["a"]} for x in r["extra"]] if r["extra"] is not None else None, r["track"], r["step"]) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(shared) > 3
    stream = S.read_rollout_arrays(spark, str(tmp_path), schema=RECORD, partitions="track string, step int", stream=True, files_per_batch=1)
    assert ST.run_available(stream, [], "append").count() == 4001


def test_written_arrays_are_json(spark, tmp_path):
    df = spark.range(50).select(F.concat(F.lit('q"\n'), "id").alias("input"), F.lit(None).cast("string").alias("output"), (49 - F.col("id")).alias("index"),
                                F.lit("A").alias("track"), (F.col("id") % 3).cast("int").alias("step"))
    K.sink_rollout_arrays(df, f"{tmp_path}/out")
    files = [f for d, _, names in os.walk(f"{tmp_path}/out") for f in (os.path.join(d, n) for n in names) if "/part-" in f]
    assert len(files) == 3
    for f in files:
        with open(f, encoding="utf-8") as h:
            records = json.load(h)
        assert [r["index"] for r in records] == sorted(r["index"] for r in records) and all(r["output"] is None for r in records)
    back = S.read_rollout_arrays(spark, f"{tmp_path}/out", schema="input string, output string, index long", partitions="track string, step int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("input", "output", "index", "track", "step").collect()))
