"""Operator 4: quality rules with host-level verdicts.

Each whole text is measured in one pass. Rule failures are then aggregated by
host (the `source` of a document); host failure rates are shrunk towards an
empirical beta prior, fitted to all hosts' counts with binomial noise taken
out, and the verdict on each host is joined back to its documents.
A document that fails a softer rule is judged by the odds that it is bad: those
of its host's rate times the weight of each softer rule it fails. So a rule of
much weight rejects in nearly every host, one of little weight in bad hosts.
A document that fails no rule is always kept, whatever its host.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_caches, freed, materialize, row_struct, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 30
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.0, 15.0
BAD_THRESHOLD = 0.5
#: Likelihood ratios of the softer rules, bad to good, from the labels of sf0.1 among documents that pass the base rules
#: (301 bad, 3302 good; a half added to each count): symbols 293 and 0, repeated lines 2 and 10. Word length fails in
#: no labelled document and weighs as little as repeated lines.
SYMBOL_WEIGHT, DUP_LINE_WEIGHT, WORD_WEIGHT = 6420.0, 2.6, 2.6

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_MULT = np.uint64(0x9E3779B97F4A7C15)
METRICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: list[bytes], window: int) -> int:
    """Words inside windows of `window` words that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
        acc = np.zeros(n, np.uint64)
        for k in range(window):
            acc = (acc ^ (acc >> np.uint64(29))) * _MULT + h[k : k + n]
    ordered = np.sort(acc)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(acc, twice))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return int((np.cumsum(step) > 0).sum())


def measure(text: str | None, window: int = WINDOW) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words, window),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_caches()
    for b in batches:
        found = [measure(t.as_py()) for t in b.column("text")]
        cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(METRICS))]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("host"), *cols], ["row", "host", *METRICS])


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", bad_threshold: float = BAD_THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """`row` (the columns of docs, or those in `carry`, as a struct), the metrics, base_failed, soft_failed, host_rate, bad_rate (of a document that fails softer rules) and kept.

    A null or empty text has no words and fails the base rules. Rows with a
    null host form one host of their own. Repeated rows are judged like any
    others. The measured rows are written once, so that texts are scanned once.
    """
    src = docs.select(row_struct(docs.select(carry) if carry else docs), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    schema = T.StructType([src.schema["row"], T.StructField("host", T.StringType()), *[T.StructField(m, T.LongType()) for m in METRICS]])
    rows = materialize(src.mapInArrow(freed(_measured), schema), "host-measured")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = [
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"), SYMBOL_WEIGHT),
        (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"), DUP_LINE_WEIGHT),
        ((F.col("word_chars") < MIN_MEAN_WORD * F.col("n_words")) | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words")), WORD_WEIGHT),
    ]
    weight = reduce(lambda x, y: x * y, [F.when(failed, w).otherwise(1.0) for failed, w in soft])
    rows = rows.withColumns({"base_failed": base, "soft_failed": reduce(lambda x, y: x | y, [failed for failed, _ in soft])})
    hosts = host_rates(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("failed")))
    hosts = hosts.select(F.col("host").alias("h"), "host_rate")
    rate = F.coalesce("host_rate", F.lit(0.0))
    found = rows.join(hosts, rows["host"].eqNullSafe(hosts["h"]), "left").drop("h")
    found = found.withColumn("bad_rate", F.when(F.col("soft_failed"), rate * weight / (rate * weight + 1 - rate)))
    return found.withColumn("kept", ~F.col("base_failed") & (F.coalesce("bad_rate", F.lit(0.0)) <= bad_threshold))


def host_rates(hosts: DataFrame) -> DataFrame:
    """Adds host_rate, the posterior mean of each host's failure rate, to (host, n, failed).

    Failures are beta-binomial. The prior's mean m is the rate over all
    documents; its strength a + b = (1 - r) / r comes from the correlation r of
    failures within a host: the spread of the host rates, weighted by their
    documents, beyond what binomial noise alone gives, over the most that it
    could be. The strength is held between 1 and 10,000; one host alone, or
    hosts without spread beyond noise, get the strongest prior.
    """
    n, x = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("xx"), F.count(F.lit(1)).alias("k"))
    sums = sums.withColumn("m", F.coalesce(F.try_divide("x", "n"), F.lit(0.0))).withColumn("noise", F.col("m") * (1 - F.col("m")))
    spread = F.col("xx") - F.col("n") * F.col("m") * F.col("m") - F.col("noise") * (F.col("k") - 1)
    most = F.col("noise") * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))
    r = F.when(most > 0, spread / most).otherwise(0.0)
    prior = sums.select("m", F.when(r > 1e-4, F.greatest(F.lit(1.0), (1 - r) / r)).otherwise(1e4).alias("w"))
    return hosts.crossJoin(F.broadcast(prior)).select(  # one row
        "host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))).alias("host_rate")
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns."""
    return judge(docs, text_col, host_col).filter("kept").select("row.*")


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"),
    )


QUERIES = {"op4_host_quality": op4_host_quality}
SQL: dict[str, str] = {}
