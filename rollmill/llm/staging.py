"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below spark.checkpoint.dir; where it is unset, only a local master gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rollmill-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """The table written to the shared folder and read again: its work is done once, and a lost executor costs a re-read only."""
    path = shared_path(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    """A column name that may hold dots, blanks and the like."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(name: str, kind: DataType, rest: str) -> StructType:
    """A column of any name and type, and more in DDL. (A struct's text form can't be read back where its fields have odd names.)"""
    return StructType([StructField(name, kind), *StructType.fromDDL(rest).fields])
