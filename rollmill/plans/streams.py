"""Streaming queries, run over all available input; the oracle is the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.plans.catalog import query
from rollmill.plans.scans import ROLLOUTS, rollout_records
from rollmill.schemas import TABLES
from rollmill.session import scratch_dir
from rollmill.sources.files import read_rollout_arrays
from rollmill.sources.sinks import sink_rollout_arrays
from rollmill.streaming import rollouts as R


def _stream(spark, sf, name):
    return R.stream_parquet(spark, sf, TABLES[name], f"{name}.parquet")


def _events(spark, sf):
    return _stream(spark, sf, "events").withColumn("time", F.col("ts").cast("timestamp"))


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("stream_rollout_files", views="ev", oracle="SELECT track, step, count(*) AS n, sum(score) AS correct FROM (" + ROLLOUTS + ") GROUP BY ALL")
def _(spark, sf):
    folder = sink_rollout_arrays(rollout_records(spark, sf), scratch_dir(spark, "landing"))
    s = read_rollout_arrays(spark, folder, partitions="track string, step int", stream=True, files_per_batch=20)
    agg = s.groupBy("track", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("correct"))
    return R.run_available(agg, ["track", "step"])


@query("stream_step_metrics", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def _(spark, sf):
    out = R.run_available(R.step_metrics(_events(spark, sf), "time", "value", ["event_type"], "1 hour"), ["window", "event_type"])
    return out.select(_text(F.col("window.start")).alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("stream_step_metrics_sliding", """
SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(b AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean
FROM events, range(3) u(b) GROUP BY ALL""")
def _(spark, sf):
    agg = R.step_metrics(_events(spark, sf), "time", "value", ["event_type"], "3 hours", "1 hour")
    out = R.run_available(agg, ["window", "event_type"])
    return out.select(_text(F.col("window.start")).alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def _stretches(keys, source, time, key, gap, what):
    """SQL: the rows of ``source`` in stretches without a silence of more than ``gap`` days, and ``what`` of those the watermark has passed."""
    us = 86_400_000_000 * gap
    order = f"PARTITION BY {keys} ORDER BY epoch_us({time}), {key}"
    return f"""
g AS (SELECT *, CASE WHEN epoch_us({time}) - lag(epoch_us({time})) OVER ({order}) <= {us} THEN 0 ELSE 1 END AS new FROM {source}),
s AS (SELECT *, sum(new) OVER ({order} ROWS UNBOUNDED PRECEDING) AS s FROM g),
o AS (SELECT {keys}, s, strftime(min({time}), '%Y-%m-%d %H:%M:%S') AS since, {what} FROM s GROUP BY {keys}, s
  HAVING epoch_us(max({time})) + {us} <= (SELECT (epoch_us(max({time})) // 1000 - 3600000) * 1000 FROM {source}))
"""


def _ended(stream, *columns):
    return R.run_available(stream, [], "append").select(*columns[:-1], _text(F.col("since")).alias("since"), *columns[-1])


def _history(spark, sf):
    return _stream(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("run_id"), (F.col("o_custkey") % 400).cast("int").alias("step"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"),
    )


@query("stream_replay_dedup", views="hist", oracle="," + _stretches(
    "run_id, metric, step", "hist", "created_at", "row_id", 300, "arg_max(row_id, (created_at, row_id)) AS row_id, arg_max(value, (created_at, row_id)) AS value"
) + "SELECT run_id, metric, step, since, row_id, value FROM o")
def _(spark, sf):
    ends = R.Ending("created_at", "300 days")
    last = R.replay_keep_last(_history(spark, sf), ["run_id", "metric", "step"], ["created_at", "row_id"], ["row_id", "value"], ends=ends)
    return _ended(last, "run_id", "metric", "step", ["row_id", "value"])


@query("stream_replay_keep_first", "WITH" + _stretches(
    "user_id, event_type", "events", "ts", "event_id", 5, "arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value"
) + "SELECT user_id, event_type, since, event_id, value FROM o")
def _(spark, sf):
    ends = R.Ending("time", "5 days")
    first = R.replay_keep_first(_events(spark, sf), ["user_id", "event_type"], ["time", "event_id"], ["event_id", "value"], ends=ends)
    return _ended(first, "user_id", "event_type", ["event_id", "value"])


@query("stream_group_complete", "WITH" + _stretches(
    "user_id, event_type", "events", "ts", "event_id", 5, "count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std"
) + "SELECT user_id, event_type, since, n, mean, std FROM o WHERE n >= 4")
def _(spark, sf):
    groups = R.complete_groups(_events(spark, sf), ["user_id", "event_type"], "value", 4, ends=R.Ending("time", "5 days"))
    return _ended(groups, "user_id", "event_type", ["n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")])


@query("stream_adaptive_kl", "WITH" + _stretches(
    "user_id", "events", "ts", "event_id", 1,
    "round(0.2 * exp(sum(ln(1 + least(greatest(value / 250.0 - 1, -0.2), 0.2) * 8 / 10000.0))), 6) AS kl_coef, count(*) AS updates"
) + "SELECT user_id, since, kl_coef, updates FROM o")
def _(spark, sf):
    runs = R.adaptive_kl(
        _events(spark, sf), ["user_id"], "value", F.lit(8), init=0.2, target=250.0, horizon=10000.0, ends=R.Ending("time", "1 day")
    )
    return _ended(runs, "user_id", [F.round("kl_coef", 6).alias("kl_coef"), "updates"])


# The same without an end, on request: state for the life of the stream, one small row per key.


@query("stream_replay_dedup_open", views="hist", oracle="""
SELECT run_id, metric, step, row_id, value FROM hist QUALIFY row_number() OVER (PARTITION BY run_id, metric, step ORDER BY created_at DESC, row_id DESC) = 1""")
def _(spark, sf):
    keys = ["run_id", "metric", "step"]
    return R.run_available(R.replay_keep_last(_history(spark, sf), keys, ["created_at", "row_id"], ["row_id", "value"], ends=None), keys)


@query("stream_replay_keep_first_open", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def _(spark, sf):
    keys = ["user_id", "event_type"]
    return R.run_available(R.replay_keep_first(_events(spark, sf), keys, ["time", "event_id"], ["event_id", "value"], ends=None), keys)


@query("stream_replay_drop_repeats", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def _(spark, sf):
    first = R.replay_drop_repeats(_events(spark, sf).select("time", "user_id", "event_type"), "time", ["user_id", "event_type"], "365 days")
    return R.run_available(first, [], "append").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_group_complete_open", """
SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY ALL HAVING count(*) >= 8""")
def _(spark, sf):
    groups = R.complete_groups(_stream(spark, sf, "events"), ["user_id", "event_type"], "value", 8, ends=None)
    out = R.run_available(groups, ["user_id", "event_type"])
    return out.select("user_id", "event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("stream_group_timer", """
WITH e AS (SELECT user_id, event_type, ts, event_id, value, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3 * 86400000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s, (SELECT max(us) // 1000 - 3600000 FROM e) AS mark FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, s ORDER BY ts, event_id) AS i FROM s WHERE us // 1000 < mark)
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, least(count(*), 12) AS n, round(avg(value) FILTER (i <= 12), 6) AS mean, count(*) >= 12 AS complete
FROM r GROUP BY user_id, event_type, s HAVING count(*) >= 12 OR (max(us) + 3 * 86400000000) // 1000 < any_value(mark)""")
def _(spark, sf):
    groups = R.complete_groups_with_timer(
        _events(spark, sf), ["user_id", "event_type"], "time", "event_id", "value", 12, patience_ms=3 * 86_400_000, late="1 hour"
    )
    return R.run_available(groups, [], "append").withColumns({"mean": F.round("mean", 6), "opened": _text(F.col("opened"))})


@query("stream_adaptive_kl_open", """
SELECT event_type, round(0.2 * exp(sum(ln(1 + least(greatest(value / 250.0 - 1, -0.2), 0.2) * 8 / 10000.0))), 6) AS kl_coef, count(*) AS updates FROM events GROUP BY event_type""")
def _(spark, sf):
    agg = R.adaptive_kl(_stream(spark, sf, "events"), ["event_type"], "value", F.lit(8), init=0.2, target=250.0, horizon=10000.0, ends=None)
    return R.run_available(agg, ["event_type"]).select("event_type", F.round("kl_coef", 6).alias("kl_coef"), "updates")


@query("stream_session_activity", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s
HAVING epoch_us(max(ts)) + 12 * 3600000000 <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)""")
def _(spark, sf):
    agg = R.session_activity(_events(spark, sf), "time", ["user_id"], "12 hours")
    out = R.run_available(agg, ["session", "user_id"], "append")
    return out.select("user_id", _text(F.col("session.start")).alias("start"), "n")
