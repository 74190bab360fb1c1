"""Streams whose keys end: each key gives its row once, and its state is gone behind the watermark."""

import pytest
from pyspark.sql import functions as F

from rollmill.streaming import rollouts as R

ROWS = [
    # two stretches of one key, told apart by a silence of more than 12 hours
    ("a", "2024-01-01 10:00:00", 1, 1.0), ("a", "2024-01-01 12:00:00", 2, 3.0), ("a", "2024-01-02 20:00:00", 3, 9.0),
    # a stretch that goes on over midnight, and a key with two rows at one time
    ("b", "2024-01-01 20:00:00", 4, 2.0), ("b", "2024-01-02 05:00:00", 5, 4.0),
    ("c", "2024-01-01 05:00:00", 7, 5.0), ("c", "2024-01-01 05:00:00", 6, 7.0),
    ("end", "2024-01-03 23:00:00", 8, 0.0),
]
ENDS = R.Ending("time", "12 hours")
FORMS = {
    "last": (
        lambda s, ends: R.replay_keep_last(s, ["g"], ["time", "k"], ["k", "x"], ends=ends).select("g", "k", "x"),
        [("a", 2, 3.0), ("a", 3, 9.0), ("b", 5, 4.0), ("c", 7, 5.0)],
    ),
    "first": (
        lambda s, ends: R.replay_keep_first(s, ["g"], ["time", "k"], ["k", "x"], ends=ends).select("g", "k", "x"),
        [("a", 1, 1.0), ("a", 3, 9.0), ("b", 4, 2.0), ("c", 6, 7.0)],
    ),
    "complete": (
        lambda s, ends: R.complete_groups(s, ["g"], "x", 2, ends=ends).select("g", "n", "mean"),
        [("a", 2, 2.0), ("b", 2, 3.0), ("c", 2, 6.0)],
    ),
    "kl": (
        lambda s, ends: R.adaptive_kl(s, ["g"], "x", F.lit(5), init=1.0, target=1.0, horizon=10.0, ends=ends).select("g", "updates", F.round("kl_coef", 6)),
        [("a", 1, 1.1), ("a", 2, 1.1), ("b", 2, 1.21), ("c", 2, 1.21)],
    ),
}


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """The rows in three files, one per day, written one after the other."""
    folder = str(tmp_path_factory.mktemp("days"))
    df = spark.createDataFrame(ROWS, "g string, at string, k long, x double").withColumn("time", F.to_timestamp("at")).drop("at")
    for day in (1, 2, 3):
        df.where(F.dayofmonth("time") == day).coalesce(1).write.mode("append").parquet(folder)
    return folder, "g string, k long, x double, time timestamp"


def _run(spark, days, form, ends, per_batch, out, mode="append"):
    """Rows that the stream gave, and the keys that its state store still holds."""
    stream = form(R.stream_parquet(spark, *days, files_per_batch=per_batch), ends)
    rows = []
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: rows.extend(map(tuple, batch.collect()))).outputMode(mode)
        .option("checkpointLocation", out).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = spark.read.format("statestore").load(out).select("key.g").distinct().collect()
    return sorted(rows), sorted(r.g for r in kept)


@pytest.mark.parametrize("name", FORMS)
@pytest.mark.parametrize("per_batch", [None, 1])
def test_state_is_gone_behind_the_watermark(spark, days, tmp_path, name, per_batch):
    form, want = FORMS[name]
    rows, kept = _run(spark, days, form, ENDS, per_batch, str(tmp_path))
    assert rows == want
    assert kept == ["end"]  # the one key that the watermark has not passed


def test_state_without_an_end_stays(spark, days, tmp_path):
    _, kept = _run(spark, days, FORMS["last"][0], None, None, str(tmp_path), "update")
    assert kept == ["a", "b", "c", "end"]


@pytest.mark.parametrize("name", FORMS)
def test_batch_form_gives_every_stretch(spark, days, name):
    form, want = FORMS[name]
    got = {tuple(r) for r in form(spark.read.parquet(days[0]), ENDS).collect()}
    assert set(want) <= got and all(r[0] == "end" for r in got - set(want))
