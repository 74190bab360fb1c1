"""The paths for large and skewed data, forced at small size, against plain windows and numpy."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollmill.operators import credit as C
from rollmill.operators import diversity as D
from rollmill.operators import evaluation as E
from rollmill.operators import keyed as K
from rollmill.operators import runlog as R


@pytest.fixture(autouse=True)
def small_limits(monkeypatch):
    monkeypatch.setattr(K, "HOT_ROWS", 50)


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows; values repeat; some keys and values are null."""
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40 + 1).alias("g"),
        F.when(F.col("id") % 97 == 5, F.lit(None)).otherwise((F.col("id") * 7919 % 211).cast("double")).alias("v"),
    )
    return df.cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_group_stats_equal_windows(skewed):
    w = Window.partitionBy("g")
    want = skewed.select("id", F.avg("v").over(w).alias("m"), F.count("v").over(w).alias("n"))
    got = K.attach_group_stats(skewed, ["g"], F.avg("v").alias("m"), F.count("v").alias("n"), hot_rows=50)
    got = got.select("id", "m", "n")
    assert got.count() == 3000
    for a, b in zip(rows(got, "id"), rows(want, "id")):
        assert a[0] == b[0] and a[2] == b[2] and a[1] == pytest.approx(b[1])


def test_hot_group_is_split_over_slices(skewed):
    plan = K.attach_group_stats(skewed, ["g"], F.avg("v").alias("m"), hot_rows=50)._jdf.queryExecution().toString()
    assert "_slice" in plan and "Window" not in plan


def test_running_sum_positions_and_hash_positions(skewed):
    full = skewed.na.fill(-1, ["g"])
    w = Window.partitionBy("g").orderBy("id")
    want = full.select("id", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), (F.row_number().over(w) - 1).alias("p"))
    got = K.positions(K.running_sum(full, ["g"], ["id"], F.col("id"), "s"), "id", "p", ["g"]).select("id", "s", "p")
    assert rows(got, "id") == rows(want, "id")
    whole = K.positions(full, "id", "p").select("id", "p")
    assert all(i == p for i, p in rows(whole, "id"))
    hashed = K.hash_positions(full, "id", "1", "p", ["g"]).withColumn("h", K.hash_order(F.col("id"), "1"))
    w = Window.partitionBy("g").orderBy("h", "id")
    checked = hashed.withColumn("want", F.row_number().over(w) - 1)
    assert checked.where("p <> want").count() == 0


def test_positions_with_clustered_keys(spark):
    # One narrow range holds nearly all keys, and one far outlier stretches the span.
    df = spark.range(2000).select((F.when(F.col("id") == 1999, 10**15).otherwise(F.col("id"))).alias("k"))
    got = [r.pos for r in K.positions(df, "k").orderBy("k").collect()]
    assert got == list(range(2000))


def test_exact_percentiles(skewed):
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {r["g"]: r for r in K.exact_percentiles(skewed.na.drop(), ["g"], "v", probs).collect()}
    data = skewed.na.drop().toPandas()
    assert len(got) == data.g.nunique()
    for g, part in data.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part.v, p))
    overall = K.exact_percentiles(skewed, [], "v", probs).first()
    assert overall["p90"] == pytest.approx(np.quantile(skewed.na.drop(subset=["v"]).toPandas().v, 0.9))


def test_neighbours_and_interpolation(spark):
    series = spark.range(0, 4000, 10).select(F.lit("r").alias("run"), F.col("id").alias("step"), (F.col("id") * F.col("id")).cast("double").alias("y"))
    asked = spark.range(-50, 4100, 7).select(F.lit("r").alias("run"), F.col("id").alias("step"))
    got = R.interpolate(series, asked, ["run"], "step", "y").orderBy("step").collect()
    x = np.arange(0, 4000, 10)
    want = np.interp([r["step"] for r in got], x, (x * x).astype(float))
    assert len(got) == len(range(-50, 4100, 7))
    assert np.allclose([r["interpolated"] for r in got], want)


def test_rolling_mean(spark):
    df = spark.range(500).select(F.lit(1).alias("run"), F.col("id").alias("step"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    got = [r["rolling"] for r in R.rolling_mean(df, ["run"], "step", "v").orderBy("step").collect()]
    v = np.array([i * 37 % 101 for i in range(500)], float)
    want = [v[max(0, i - 3): i + 4].mean() for i in range(500)]
    assert np.allclose(got, want)


def test_best_worst_of_n_matches_resampling(spark):
    values = [0.0, 1.0, 1.0, 3.0, 7.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = {r["n"]: r for r in E.best_worst_of_n(df, ["g"], "v").collect()}
    assert set(got) == {2, 4, 5}
    rng = np.random.default_rng(0)
    for n, r in got.items():
        draws = rng.choice(values, size=(200_000, n))
        assert r["best_mean"] == pytest.approx(draws.max(1).mean(), abs=0.03)
        assert r["best_std"] == pytest.approx(draws.max(1).std(), abs=0.03)
        assert r["worst_mean"] == pytest.approx(draws.min(1).mean(), abs=0.03)
        assert r["worst_std"] == pytest.approx(draws.min(1).std(), abs=0.03)


def test_similarity_of_a_split_group_equals_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(90, 5))
    label = [0] * 60 + [1] * 29 + [2]
    df = spark.createDataFrame(
        [(i, label[i], [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, g int, e array<double>"
    )
    got = {r["g"]: r for r in D.group_similarity(df, ["g"], "id", "e", chunk_rows=16).collect()}
    assert set(got) == {0, 1}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for g in (0, 1):
        u = unit[np.array(label) == g]
        sims = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert got[g]["n_pairs"] == len(sims)
        assert got[g]["mean_similarity"] == pytest.approx(sims.mean())
        assert got[g]["std_similarity"] == pytest.approx(sims.std())


def test_group_advantage_is_centred_and_singletons_keep_scores(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "id int, g string, s double")
    got = {r["id"]: r["advantage"] for r in C.adv_grpo(df, ["g"], "s").collect()}
    assert got[1] == pytest.approx(-got[2]) and got[2] == pytest.approx(1 / (2**0.5 + 1e-6))
    assert got[3] == pytest.approx(5.0, abs=1e-4)
    rloo = {r["id"]: r["advantage"] for r in C.adv_rloo(df, ["g"], "s").collect()}
    assert rloo == {1: -2.0, 2: 2.0, 3: 5.0}


@pytest.mark.parametrize("values", [[], [None, None, None], ["b", "a", None, "ab", "a"], [7] * 40, [3, 1, 2, None]])
def test_positions_of_any_order_column(spark, values):
    kind = "string" if any(isinstance(v, str) for v in values) else "int"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")
    for keys in ([], ["k"]):
        got = K.positions(df.withColumn("k", F.lit(1)), "v", "pos", keys).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(len(values)))
        assert [r["v"] for r in got] == sorted(values, key=lambda v: (v is not None, v if v is not None else 0))


def test_percentiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert K.exact_percentiles(empty, ["g"], "v", {"p50": 0.5}).collect() == []


def test_one_order_value_on_all_rows_is_spread(spark):
    df = spark.range(4000).select("id", F.lit(7).alias("v"))
    sizes = [r["count"] for r in K.order_bucket(df, ["v"], 8).groupBy("_bucket").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2000
    got = [r["pos"] for r in K.positions(df, "v").collect()]
    assert sorted(got) == list(range(4000))
    assert rows(K.positions(df, "v"), "id") == rows(K.positions(df.repartition(7), "v"), "id")


@pytest.mark.parametrize("buckets", [1, 2, 3, 16, 500])
def test_ranges_follow_the_order(skewed, buckets):
    got = K.order_bucket(skewed, ["v", "id"], buckets).orderBy(F.col("v").asc_nulls_first(), "id").collect()
    labels = [r["_bucket"] for r in got]
    assert labels == sorted(labels) and 0 <= labels[0] and labels[-1] < buckets
    assert len(set(labels)) > buckets / 2


def test_nothing_runs_before_an_action(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        K.positions(skewed, "v")
        K.exact_percentiles(skewed, ["g"], ["v", "id"], {"p50": 0.5})
        E.best_worst_of_n(skewed, ["g"], "v")
        R.cumulative_tokens(skewed.withColumnsRenamed({"id": "step", "v": "value"}), ["g"], 512)
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_percentiles_of_several_columns_keep_groups_without_values(spark):
    data = [("a", 1.0, 5), ("a", 3.0, None), ("b", None, 2), ("b", None, 4), (None, 2.0, None), ("c", None, None)]
    df = spark.createDataFrame(data, "g string, v double, w int")
    got = {r["g"]: tuple(r)[1:] for r in K.exact_percentiles(df, ["g"], ["v", "w"], {"p0": 0.0, "p75": 0.75}).collect()}
    assert got == {"a": (1.0, 2.5, 5.0, 5.0), "b": (None, None, 2.0, 3.5), None: (2.0, 2.0, None, None), "c": (None,) * 4}
    one = {r["g"]: r["p50"] for r in K.exact_percentiles(df, ["g"], "v", {"p50": 0.5}).collect()}
    assert one == {"a": 2.0, "b": None, None: 2.0, "c": None}


def test_one_target_per_run_equals_the_ordered_way(spark):
    series = spark.range(60).select(F.when(F.col("id") < 40, "r").otherwise("q").alias("run"), (F.col("id") * 10).alias("step"), (F.col("id") * 1.5).alias("y"))
    for at in (-5, 0, 7, 200, 395, 396, 10_000):
        asked = spark.createDataFrame([("r", at, "k"), ("q", at, None)], "run string, step long, tag string")
        want = rows(R.interpolate(series, asked, ["run"], "step", "y"), "run")
        assert rows(R.interpolate_once(series, asked, "run", "step", "y", "interpolated"), "run") == want
        assert rows(R.interpolate(series, asked, ["run"], "step", "y", steps=True), "run") == want


def test_one_changed_row_is_one_range(spark, tmp_path):
    from rollmill.sources import files as S

    a = spark.range(5000).select("id", (F.col("id") % 20).alias("day"), F.lit(None).cast("string").alias("a b"))
    b = a.withColumn("id", F.when(F.col("id") == 77, -1).otherwise(F.col("id")))
    for name, df in (("a", a), ("b", b)):
        df.write.partitionBy("day").parquet(f"{tmp_path}/{name}")
    left, right = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    assert [r[0] for r in S.differing_ranges(left, right, F.col("day")).collect()] == [77 % 20]
    assert tuple(S.compare_tables(left, right, by="day").first()) == ("DIFFERENT", 1, 1)
    assert tuple(S.compare_tables(left, right).first()) == ("DIFFERENT", 1, 1)
    assert tuple(S.compare_tables(left, left.unionByName(left.where("id = 3"))).first()) == ("DIFFERENT", 0, 1)
    assert tuple(S.compare_tables(left, spark.read.parquet(f"{tmp_path}/a").orderBy("id"), by="day").first()) == ("IDENTICAL", 0, 0)
    assert tuple(S.compare_reads(spark, lambda: left, lambda: spark.read.parquet(f"{tmp_path}/none")).first()) == ("ERROR", None, None)
    failing = right.withColumn("id", F.when(F.col("id") == -1, F.raise_error(F.lit("unreadable")).cast("long")).otherwise(F.col("id")))
    assert S.compare_reads(spark, lambda: left, lambda: failing).first()["status"] == "ERROR"


def test_a_batch_is_dealt_without_a_window_over_it(spark):
    from rollmill.operators import balance as L

    df = spark.range(2000).select(F.lit("hot").alias("b"), "id", (F.col("id") * 37 % 90).alias("n"))
    got = L.snake(df, ["b"], "id", "n", F.lit(7)).collect()
    order = sorted(got, key=lambda r: (-r["n"], r["id"]))
    assert [r["part"] for r in order] == [i % 7 if i // 7 % 2 == 0 else 6 - i % 7 for i in range(2000)]
    parts = L.micro_batch_by_tokens(df, ["b"], "id", "n", 1000)
    sums = [r["s"] for r in parts.groupBy("part").agg(F.sum("n").alias("s")).collect()]
    assert len(sums) == -(-sum(r["n"] for r in got) // 1000) and max(sums) - min(sums) <= 90
