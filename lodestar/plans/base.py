"""The registry of queries, and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (read) under its name; `read` opens a table."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Pieces of SQL that several queries share.
TOKS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
WORDS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> '')"
PLAIN = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"


def words_sql(c: str = "text") -> str:
    return WORDS.format(c)
