"""From raw documents to packed training sequences: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.llm.decontaminate import find_contamination
from rollmill.llm.packing import pack_documents
from rollmill.llm.simhash import keep_one
from rollmill.llm.staging import quoted, written
from rollmill.llm.substring import remove_repeats
from rollmill.llm.toxicity import score_toxicity, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _carried(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The text, the language if there is one, and all that has to come through an operator as its id."""
    lang = [F.col("lang")] if "lang" in docs.columns else []
    return docs.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("row"), "text", *lang)


def _whole(rows: DataFrame, columns: list[str], **other: Column) -> DataFrame:
    """The columns of documents again, some of them anew."""
    return rows.select(*[other.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language; the rest go. Empty texts stay."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(_carried(docs, docs.columns), model, id_col="row")
    return _whole(scored.where(~F.col("flagged")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every component of near copies; rows without an id stay."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere, n_chars anew; documents of which nothing is left go."""
    rest = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(_carried(docs, rest), id_col="row", with_text=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _whole(left, docs.columns, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(_carried(docs, docs.columns), items, id_col="row")
    return _whole(found.where(~F.col("contaminated")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in windows of up to 2048."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the classifier, fingerprints and tokens; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
