"""Readers for prompt, training, rollout and run-history files. Any Hadoop URI works as a path."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.schemas import PER_PROBLEM, PROMPT_ROW, ROLLOUT_RECORD, RUN_METADATA


def read_prompts(spark: SparkSession, paths: Sequence[str], schema: str = PROMPT_ROW) -> DataFrame:
    """One or many parquet files or folders with one declared schema."""
    return spark.read.schema(schema).parquet(*paths)


def _pick(df: DataFrame, column: str, keys: Sequence[str]) -> Column:
    """A column, or a field inside it; one-element arrays on the way are opened."""
    value, dtype = F.col(column), df.schema[column].dataType
    for key in (*keys, None):
        while isinstance(dtype, T.ArrayType) and not (key is None and isinstance(dtype.elementType, T.StructType)):
            value, dtype = F.get(value, F.lit(0)), dtype.elementType
        if key is not None:
            value, dtype = value[key], dtype[key].dataType
    return value


def read_sft(
    spark: SparkSession, paths: Sequence[str], *, prompt: str = "prompt", response: str = "response",
    prompt_keys: Sequence[str] = (), response_keys: Sequence[str] = (), keep: Sequence[str] = (),
) -> DataFrame:
    """Prompt and response strings, which may sit below keys of nested columns."""
    df = spark.read.parquet(*paths)
    return df.select(
        *keep, _pick(df, prompt, prompt_keys).alias("prompt"), _pick(df, response, response_keys).alias("response")
    )


def read_messages(spark: SparkSession, paths: Sequence[str], messages: str = "messages", keep: Sequence[str] = ()) -> DataFrame:
    """Message arrays; an array that only wraps one message array is opened."""
    df = spark.read.parquet(*paths)
    value = F.col(messages)
    if isinstance(df.schema[messages].dataType.elementType, T.ArrayType):
        value = F.get(value, F.lit(0))
    return df.select(*keep, value.alias("messages"))


def read_preferences(spark: SparkSession, paths: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return spark.read.parquet(*paths).select(*keep, "prompt", "chosen", "rejected")


def with_track_and_step(df: DataFrame) -> DataFrame:
    """Track and step from the path ``.../<track>/<step>_rollouts.json``, or from partition folders."""
    path = F.input_file_name()
    out = df
    if "track" not in df.columns:
        out = out.withColumn("track", F.regexp_extract(path, r"([^/]+)/[0-9]+_[^/]*rollouts[^/]*$", 1))
    if "step" not in df.columns:
        out = out.withColumn("step", F.regexp_extract(path, r"([0-9]+)_[^/]*rollouts[^/]*$", 1).try_cast("int"))
    return out


def _array_pieces(first: str) -> str:
    """What separates two records of a JSON array as ``json.dumps`` writes it. Within a string its quotes would be escaped."""
    return f'}}, {{"{first}": '


def array_records(pieces: DataFrame, schema: str, first: str) -> DataFrame:
    """Records from the pieces (column ``value``) between separators; other columns stay.

    A piece has lost the opening of its record, but for the first of a file, and its closing brace, but for the last.
    """
    head = f'{{"{first}": '
    body = F.regexp_replace("value", r"^\s*\[\s*" + re.escape(head), "")
    inner = F.concat(F.lit(head), body, F.lit("}"))
    last = F.concat(F.lit(head), F.regexp_replace(body, r"\s*\]\s*\z", ""))
    text = F.when(F.try_parse_json(inner).isNotNull(), inner).otherwise(last)
    rest = [c for c in pieces.columns if c != "value"]
    filled = pieces.where(~F.col("value").rlike(r"^\s*(\[\s*\]\s*)?\z"))
    return filled.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("_record"), *rest).select("_record.*", *rest)


def read_rollout_arrays(
    spark: SparkSession, path: str, *, schema: str = ROLLOUT_RECORD, partitions: str = "", stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Records of files that hold one JSON array each, as ``json.dumps`` writes it, in a batch or as a stream.

    The files are read as text cut at the seam of two records, which an escaped string can't hold. So a file is split like any text
    file: one huge array is read by several tasks, and no record is held but the one being parsed. ``partitions`` declares the columns
    that folders name (``track string, step int``). A record that does not parse fails the job.
    """
    first = T.StructType.fromDDL(schema).fields[0].name
    reader = (spark.readStream if stream else spark.read).option("lineSep", _array_pieces(first))
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    reader = reader.schema(f"value string, {partitions}" if partitions else "value string")
    return array_records(reader.text(path), schema, first)


def read_rollouts(spark: SparkSession, path: str, *, arrays: bool = False, schema: str = ROLLOUT_RECORD) -> DataFrame:
    """Tidy rollouts of all tracks and steps below ``path``, from JSON lines as ``sink_rollouts`` writes them, with track and step as folders.

    ``arrays`` reads any JSON array, also one laid out over lines, which can't be split; see read_rollout_arrays for large ones.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*rollouts*.json")
    if arrays:
        return with_track_and_step(reader.schema(schema).option("multiLine", "true").json(path))
    return spark.read.schema(f"{schema}, track string, step int").json(path)


def read_histories(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``history.csv`` rows of every run folder, joined to its ``metadata.json``; runs without metadata are skipped."""
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    rows = (
        spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
        .schema(schema).csv(path).withColumn("_run_dir", folder)
    )
    runs = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        .schema(RUN_METADATA).json(path).withColumn("_run_dir", folder)
    )
    return rows.join(runs, "_run_dir")


def read_per_problem(spark: SparkSession, path: str, schema: str = PER_PROBLEM, partitions: str = "") -> DataFrame:
    """Per-problem result files, with the partition columns their folders name."""
    full = f"{schema}, {partitions}" if partitions else schema
    return spark.read.option("header", "true").schema(full).csv(path)


def read_latest_snapshot(spark: SparkSession, path: str, step: str = "global_step") -> DataFrame:
    """Rows of the newest ``global_step=N`` folder; the others are pruned by their folder names."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max(step)).scalar()
    return df.where(F.col(step) == newest)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive checksum, computed in place on each task's rows."""
    row_hash = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_hash), F.lit(0)).alias("checksum"))


def differing_ranges(left: DataFrame, right: DataFrame, range_of: Column) -> DataFrame:
    """Ranges (``_range``) whose row counts or checksums differ, or that one side lacks."""
    def marks(df: DataFrame, name: str) -> DataFrame:
        row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
        return df.groupBy(range_of.alias("_range")).agg(F.struct(F.count(F.lit(1)).alias("rows"), F.sum(row_hash).alias("sum")).alias(name))

    a, b = marks(left, "_a"), marks(right, "_b").withColumnRenamed("_range", "_of")
    both = a.join(b, F.col("_range").eqNullSafe(F.col("_of")), "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.when(F.col("_a").isNull(), F.col("_of")).otherwise(F.col("_range")).alias("_range"))


def compare_tables(left: DataFrame | None, right: DataFrame | None, by: str | None = None, ranges: int = 1024) -> DataFrame:
    """One row: status IDENTICAL, DIFFERENT, MISSING or LOCAL_MISSING, and rows found on one side only.

    Counts and checksums of ranges settle equality; only rows of ranges that differ are matched against each other, multiplicities
    included. A range is a value of ``by`` (a partition column: then other folders are not read again), or one of ``ranges`` hash classes of
    the row. Tables with other columns are DIFFERENT in all their rows.
    """
    some = left if left is not None else right
    if some is None:
        raise ValueError("there is nothing to compare")
    if left is None or right is None:
        status = "LOCAL_MISSING" if left is None else "MISSING"
        return some.agg(F.count(F.lit(1)).alias("_n")).select(
            F.lit(status).alias("status"),
            (F.lit(0).cast("bigint") if left is None else F.col("_n")).alias("left_only"),
            (F.lit(0).cast("bigint") if right is None else F.col("_n")).alias("right_only"),
        )
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        n = [d.agg(F.count(F.lit(1)).alias("_n")).scalar() for d in (left, right)]
        return left.sparkSession.range(1).select(F.lit("DIFFERENT").alias("status"), n[0].alias("left_only"), n[1].alias("right_only"))
    names = [F.col(f"`{c}`") for c in columns]
    range_of = F.col(f"`{by}`") if by else F.pmod(F.xxhash64(F.lit("range"), *names), F.lit(ranges))
    other = differing_ranges(left, right, range_of)

    def counted(df: DataFrame, sign: int) -> DataFrame:
        rows = df.select(*names, range_of.alias("_here")).join(other, F.col("_here").eqNullSafe(F.col("_range")), "left_semi")
        return rows.groupBy(*names).agg((sign * F.count(F.lit(1))).alias("_n"))

    net = counted(left, 1).unionByName(counted(right, -1)).groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    counts = net.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0)).alias("right_only"),
    )
    same = (F.col("left_only") == 0) & (F.col("right_only") == 0)
    return counts.select(F.when(same, "IDENTICAL").otherwise("DIFFERENT").alias("status"), "left_only", "right_only")


def compare_reads(
    spark: SparkSession, left: Callable[[], DataFrame | None], right: Callable[[], DataFrame | None], by: str | None = None
) -> DataFrame:
    """As compare_tables, for two reads that may fail: then the status is ERROR and the counts are null. Runs at once, to see a failure."""
    try:
        found = tuple(compare_tables(left(), right(), by).first())
    except (PySparkException, Py4JJavaError):
        found = ("ERROR", None, None)
    return spark.createDataFrame([found], "status string, left_only bigint, right_only bigint")
