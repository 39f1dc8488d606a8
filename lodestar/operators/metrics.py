"""Retrieval and answer metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row per qid of results (qid, doc_id, rank) against relevant (qid, doc_id).

    Precision divides by the rows returned in the first k; recall counts
    distinct documents; ndcg and map divide by min(relevant, k), context
    precision by all relevant.
    """
    rel = relevant.select("qid", "doc_id").distinct()
    n_rel = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    r = results.join(rel.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("hits", F.sum("hit").over(w))
    top = F.col("rank") <= k
    hit = F.col("hit") == 1
    agg = r.groupBy("qid").agg(
        F.max("hit").alias("hit_rate"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.avg(F.when(top, F.col("hit"))).alias("precision"),
        F.count_distinct(F.when(hit & top, F.col("doc_id"))).alias("found"),
        F.sum(F.when(top & hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(top & hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_all"),
    )
    agg = agg.join(n_rel, "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    m = F.least(F.col("n_rel"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("n_rel") > 0
    six = lambda c: F.round(F.when(some, c).otherwise(0.0), 6)
    return agg.select(
        "qid", F.col("hit_rate").cast("double").alias("hit_rate"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce("precision", F.lit(0.0)), 6).alias("precision"), six(F.col("found") / F.col("n_rel")).alias("recall"),
        six(F.col("dcg") / ideal).alias("ndcg"), six(F.col("ap") / m).alias("map"), six(F.col("ap_all") / F.col("n_rel")).alias("context_precision"),
    )


def faithfulness(pairs: DataFrame) -> DataFrame:
    """(id, unigram, bigram) of pairs (id, answer, source): answer words found in the source, distinct answer pairs of words found."""
    a, s = F.col("a"), F.col("s")
    t = pairs.select("id", words("answer").alias("a"), words("source").alias("s"))
    grams = lambda c: F.when(F.size(c) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat_ws(" ", F.element_at(c, i), F.element_at(c, i + 1))))).otherwise(F.expr("cast(array() as array<string>)"))
    ga, gs = grams(a), grams(s)
    uni = F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.array_contains(s, x))) / F.size(a)).otherwise(0.0)
    bi = F.when(F.size(ga) > 0, F.size(F.array_intersect(ga, gs)) / F.size(ga)).otherwise(0.0)
    return t.select("id", F.round(uni, 4).alias("unigram"), F.round(bi, 4).alias("bigram"))


def summary(per_query: DataFrame) -> DataFrame:
    """The mean of each metric over the queries, and their number."""
    names = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(*[F.round(F.avg(c), 4).alias(c) for c in names], F.count(F.lit(1)).alias("n"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    row = 0
    for x in a:
        y = row | where.get(x, 0)
        row = y & ~(y - (row << 1 | 1))
    return row.bit_count()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, precision, recall, f1) of pairs (id, answer, reference)."""

    @F.pandas_udf("precision double, recall double, f1 double")
    def score(answers: pd.Series, refs: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(answers.fillna(""), refs.fillna(""), strict=True):
            a, b = x.lower().split(), y.lower().split()
            n = lcs_length(a, b)
            p, r = (n / len(a), n / len(b)) if n else (0.0, 0.0)
            rows.append((round(p, 4), round(r, 4), round(2 * p * r / (p + r), 4) if n else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    return pairs.select("id", score("answer", "reference").alias("s")).select("id", "s.*")
