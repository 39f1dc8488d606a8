"""Operators over ordered context items (qid, seq, text, score, source, chunk_id, token_count)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words


def _first(items: DataFrame, *keys: Column | str) -> DataFrame:
    w = Window.partitionBy("qid", *keys).orderBy("seq")
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedup_exact(items: DataFrame) -> DataFrame:
    return _first(items, "text")


def dedup_hash(items: DataFrame) -> DataFrame:
    """Ignores case and white space around."""
    return _first(items, F.md5(F.lower(strip("text"))))


def _greedy_jaccard(limit: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        flags = []
        for text in group.sort_values("seq")["text"]:
            w = set((text or "").lower().split())
            ok = all(not (w | o) or len(w & o) / len(w | o) <= limit for o in kept)
            flags.append(ok)
            if ok:
                kept.append(w)
        return group.sort_values("seq")[flags]

    return run


def dedup_jaccard(items: DataFrame, limit: float = 0.85) -> DataFrame:
    """Keeps an item if it is not too similar to any kept before it; the order of a query's few items decides, so each query is one group."""
    return items.groupBy("qid").applyInPandas(_greedy_jaccard(limit), items.schema)


def ranked(items: DataFrame, by: str) -> DataFrame:
    """Adds pos, the place after a stable sort: relevance, recency (column ts), density or position."""
    order = {
        "relevance": lambda: F.col("score").desc(),
        "recency": lambda: F.col("ts").desc_nulls_last(),
        "density": lambda: (F.size(F.array_distinct(words("text"))) / F.greatest(F.lit(1), F.col("token_count"))).desc(),
        "position": lambda: F.col("chunk_id").asc(),
    }[by]()
    return items.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(order, "seq")))


def ranked_diverse(items: DataFrame, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance from the first item on: weight * score - (1 - weight) * the greatest similarity to those taken."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq").reset_index(drop=True)
        sets = [set((t or "").lower().split()) for t in group["text"]]
        score = group["score"].tolist()
        taken, rest = [0], list(range(1, len(group)))
        near = [0.0] * len(group)
        while rest:
            last = sets[taken[-1]]
            for i in rest:
                either = last | sets[i]
                near[i] = max(near[i], len(last & sets[i]) / len(either) if either else 0.0)
            best = max(rest, key=lambda i: (weight * score[i] - (1 - weight) * near[i], -i))
            taken.append(best)
            rest.remove(best)
        return group.iloc[taken].assign(pos=range(1, len(taken) + 1))

    return items.groupBy("qid").applyInPandas(run, items.withColumn("pos", F.lit(1)).schema)


def compress(items: DataFrame, max_tokens: int, shorten: Callable[[Column], Column] | None = None) -> DataFrame:
    """Items over the limit are rewritten, or cut to four characters a token."""
    cut = shorten(F.col("text")) if shorten else F.when(F.length("text") > 4 * max_tokens, F.concat(F.expr(f"substring(text, 1, {4 * max_tokens})"), F.lit("..."))).otherwise(F.col("text"))
    over = F.col("token_count") > max_tokens
    return items.withColumn("text", F.when(over, cut).otherwise(F.col("text"))).withColumn("token_count", F.least("token_count", F.lit(max_tokens)))


def resolve_conflicts(items: DataFrame) -> DataFrame:
    """Of each named source the best item stays, all without a source stay."""
    w = Window.partitionBy("qid", "source").orderBy(F.col("score").desc(), "seq")
    best = items.withColumn("_n", F.row_number().over(w))
    return best.filter((F.coalesce("source", F.lit("")) == "") | (F.col("_n") == 1)).drop("_n")


def budget(items: DataFrame, limit: int) -> DataFrame:
    """The longest prefix by seq whose tokens fit the limit."""
    w = Window.partitionBy("qid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum("token_count").over(w)).filter(F.col("used") <= limit)


def utilisation(items: DataFrame, limit: int) -> DataFrame:
    total = F.sum("token_count")
    return items.groupBy("qid").agg(total.alias("total_tokens"), (F.least(F.lit(1.0), total / limit) if limit > 0 else F.lit(0.0)).alias("utilisation"))


def render(items: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """(qid, context): numbered items with their scores, in order."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] (score: "), F.format_string("%.3f", F.col("score")), F.lit(")\n"), F.col("text"))
    numbered = items.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("seq"))).select("qid", "pos", line.alias("line"))
    return numbered.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), separator).alias("context"))


def keep(items: DataFrame, predicate: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """The items for which the predicate holds; null counts as not."""
    return items.filter(predicate(items) if callable(predicate) else predicate)


def filter_by_score(items: DataFrame, least: float) -> DataFrame:
    return keep(items, F.col("score") >= least)


def filter_by_source(items: DataFrame, sources: list[str]) -> DataFrame:
    return keep(items, F.col("source").isin(sources) if sources else F.lit(False))


def citations(items: DataFrame, length: int = 200, digits: int = 3) -> DataFrame:
    """(qid, number, source, chunk_id, excerpt, score): items numbered in order, their texts cut."""
    number = F.row_number().over(Window.partitionBy("qid").orderBy("seq"))
    return items.select("qid", number.alias("number"), "source", "chunk_id", F.expr(f"substring(text, 1, {length})").alias("excerpt"), F.round("score", digits).alias("score"))


def pipe(items: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps one after another."""
    for step in steps:
        items = items.transform(step)
    return items


def resolve_groups(items: DataFrame, resolve: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Items that share a source, or without one a chunk id, are replaced by what `resolve` returns for them; single items stay.

    A group is one query's few items of one source; `resolve` gets them in
    order and returns rows of the same columns.
    """
    key = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.col("chunk_id"), F.lit(""))
    counted = items.withColumn("_key", key).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("qid", "_key")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return resolve(group.sort_values("seq").drop(columns=["_key", "_n"]))

    merged = counted.filter("_n > 1").groupBy("qid", "_key").applyInPandas(run, items.schema)
    return counted.filter("_n = 1").drop("_key", "_n").unionByName(merged)


def summary(items: DataFrame) -> DataFrame:
    """(qid, n_items, n_sources, total_tokens, mean_score) of each window."""
    return items.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("source").alias("n_sources"), F.sum("token_count").alias("total_tokens"), F.round(F.avg("score"), 6).alias("mean_score")
    )


def prompt(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, prompt): the question (qid, text) after its rendered context (qid, context); without one the fixed message alone."""
    both = questions.join(contexts, "qid", "left")
    asked = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("text"))
    return both.select("qid", F.when(F.coalesce("context", F.lit("")) == "", F.lit(NO_CONTEXT)).otherwise(asked).alias("prompt"))


#: What stands for an answer where nothing was retrieved.
NO_CONTEXT = "No relevant context was found for this question."
