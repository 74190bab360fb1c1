"""The group timer over many groups, against plain loops and however the input is cut."""

import datetime as dt
import random

import pytest

from rollmill.streaming import rollouts as R

HOUR = 3_600_000_000


def plain(rows, expected, patience, mark):
    """Rows (g, h, opened, n, mean, complete) by walking through every group."""
    out = []
    for g, h in {r[:2] for r in rows}:
        stretches = []
        for us, k, x in sorted((us, k, x) for a, b, us, k, x in rows if (a, b) == (g, h) and us // 1000 < mark):
            if not stretches or us - stretches[-1][-1][0] > patience:
                stretches.append([])
            stretches[-1].append((us, k, x))
        for i, s in enumerate(stretches):
            over = i + 1 < len(stretches) or (s[-1][0] + patience) // 1000 < mark
            if len(s) >= expected or over:
                xs = [x for _, _, x in s[:expected]]
                out.append((g, h, s[0][0], len(xs), sum(xs) / len(xs), len(s) >= expected))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_batch", [None, 1])
def test_groups_share_slots(spark, tmp_path, per_batch):
    rnd, start = random.Random(2), int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    rows = [(rnd.choice([None, 2**53 + 1, 2**53 + 3, *range(40)]), rnd.choice(["a", None, "b"]), start + rnd.randrange(72 * HOUR), k, rnd.random()) for k in range(1500)]
    rows.append((-1, "end", start + 74 * HOUR, 1500, 0.0))
    rows.sort(key=lambda r: r[2])
    for k, part in enumerate((rows[:500], rows[500:1000], rows[1000:])):  # by time, so that no row is late
        df = spark.createDataFrame(part, "g long, h string, us long, k long, x double").selectExpr("g", "h", "timestamp_micros(us) AS time", "k", "x")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = R.stream_parquet(spark, f"{tmp_path}/in", "g long, h string, time timestamp, k long, x double", files_per_batch=per_batch)
    out = R.complete_groups_with_timer(s, ["g", "h"], "time", "k", "x", 4, patience_ms=6 * 3_600_000, late="1 hour", slots=5)
    got = []
    query = (
        out.selectExpr("g", "h", "unix_micros(opened)", "n", "mean", "complete").writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect())))
        .outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = plain(rows, 4, 6 * HOUR, (start + 73 * HOUR) // 1000)
    assert len(want) > 300
    assert sorted(got, key=str) == [(*r[:4], pytest.approx(r[4]), r[5]) for r in want]
    assert 0 < spark.read.format("statestore").load(f"{tmp_path}/state").count() <= 5
