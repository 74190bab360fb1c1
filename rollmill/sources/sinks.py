"""Writers. All of them write in parallel; none gathers a result into one file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollmill.operators.batch import fold


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def sink_split_parquet(df: DataFrame, path: str, split: str = "split") -> str:
    """One folder per split or mode."""
    return sink_parquet(df, path, [split])


def sink_rollouts(df: DataFrame, path: str) -> str:
    """Rollout records as JSON lines in one folder per track and step."""
    df.write.mode("overwrite").partitionBy("track", "step").json(path)
    return path


def sink_rollout_arrays(df: DataFrame, path: str, order: str = "index") -> str:
    """One file with one JSON array for each track and step, laid out as ``json.dumps`` does.

    A file is written from start to end, so the rows of a step pass through one task, one at a time.
    """
    step = ["track", "step"]
    record = F.to_json(F.struct(*[c for c in df.columns if c not in step]), {"ignoreNullFields": "false"})
    # json.dumps puts blanks behind commas and colons; only those between records and behind the first name matter to readers.
    spaced = F.regexp_replace(record, '^(\\{"[^"]*":)', "$1 ")
    rows = df.select(*step, F.col(order).alias("_order"), spaced.alias("_record"))
    within = Window.partitionBy(*step).orderBy("_order")
    text = F.concat(F.when(F.lag("_record").over(within).isNull(), "[").otherwise(""), "_record",
                    F.when(F.lead("_record").over(within).isNull(), "]").otherwise(","))
    rows.select(*step, text.alias("value")).write.mode("overwrite").partitionBy(*step).option("lineSep", " ").text(path)
    return path


def sink_csv_summary(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite").option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def sink_json_summary(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def sink_metrics(metrics: DataFrame, backends: Sequence[Callable[[DataFrame], object]]) -> None:
    """Hand the long metric table to several writers; as a ``foreachBatch`` body it does so per micro-batch."""
    for write in backends:
        write(metrics)


def attach_responses(
    prompts: DataFrame, responses: DataFrame, keys: Sequence[str], sample: str, text: str, n: int
) -> DataFrame:
    """Prompt rows with an array of ``n`` responses each, ordered by sample.

    A prompt with more responses continues in a further ``pass``, so no array exceeds ``n``.
    """
    arrays = fold(responses, sample, [text], n, keys).withColumnsRenamed({"chunk": "pass", text: "responses"})
    return prompts.join(arrays.select(*keys, F.col("pass"), "responses"), list(keys))
