"""The corpus pipeline: five operators in a row, from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import materialize, table
from lodestar.llm.decontamination import decontaminate
from lodestar.llm.host_quality import keep_good
from lodestar.llm.line_dedup import OVER_WORDS, remove_repeated_lines
from lodestar.llm.minhash_forest import drop_near_duplicates
from lodestar.llm.packing import pack_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(docs, over_words=OVER_WORDS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, k=5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs).drop("bound", "bins")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near),
    ("decontamination", clean),
    ("packing", pack),
]

#: The word shingles, line windows and packing have no practical SQL; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
