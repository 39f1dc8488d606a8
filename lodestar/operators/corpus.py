"""Corpus statistics and quality issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words

# Words that term statistics leave out.
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "and",
    "but", "or", "if", "it", "its", "this", "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her",
    "they", "them", "their", "what", "which", "who", "whom",
]


def term_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, term) of plain words of two or more letters that are not stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_\\P{ASCII}]+"), 0)
    terms = docs.select("doc_id", F.explode(found).alias("term"))
    return terms.filter(F.col("term").rlike("^[a-z]{2,}$") & ~F.col("term").isin(STOPWORDS))


def statistics(docs: DataFrame) -> DataFrame:
    n = F.length("text")
    shape = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("total_chars"), F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))
    # distinct terms by a grouped count, so that no task holds all of them
    vocabulary = term_rows(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count(F.lit(1)).alias("unique_words"))
    both = shape.crossJoin(F.broadcast(terms))  # one row each
    return both.withColumn("richness", F.round(F.when(F.col("total_words") > 0, F.col("unique_words") / F.col("total_words")).otherwise(0.0), 6))


def top_terms(docs: DataFrame, k: int = 20) -> DataFrame:
    return term_rows(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(k)


def _issue(kind: str, severity: str, other: Column | None = None) -> list[Column]:
    return ["doc_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), (F.lit(None).cast("long") if other is None else other).alias("other_id")]


def short_texts(docs: DataFrame, least: int = 50) -> DataFrame:
    t = strip(F.coalesce("text", F.lit("")))
    blank = docs.filter(F.length(t) == 0).select(*_issue("empty", "critical"))
    return blank.unionByName(docs.filter((F.length(t) > 0) & (F.length(t) < least)).select(*_issue("short", "medium")))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Each later copy with the first document that has its text; one narrow row per text meets the rest."""
    keyed = docs.select("doc_id", F.md5(strip(F.coalesce("text", F.lit("")))).alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(first, "key").filter("doc_id <> first").select(*_issue("duplicate", "high", F.col("first")))


def near_duplicates(docs: DataFrame, span: int = 49, limit: float = 0.85, place: str = "doc_id") -> DataFrame:
    """Pairs among each document and the next `span`, by Jaccard of their words, without pairs of a copy and its first.

    `place` names the column that numbers documents in their order of arrival;
    ids that are given without gaps are one. Places are dealt to cells as wide as the span, so candidates meet by an
    equi-join; a pair over the limit needs sizes in the ratio of the limit, and
    is then counted by a join of its shared words.
    """
    sets = docs.select("doc_id", F.col(place).alias("p"), F.array_distinct(words("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    placed = sets.withColumn("cell", F.floor(F.col("p") / (span + 1)))
    a = placed.select(F.col("doc_id").alias("a"), F.col("p").alias("pa"), F.col("n").alias("na"), F.col("w").alias("wa"), "cell")
    b = placed.select(F.col("doc_id").alias("b"), F.col("p").alias("pb"), F.col("n").alias("nb"), F.col("w").alias("wb"), F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"))
    close = (F.col("pb") > F.col("pa")) & (F.col("pb") <= F.col("pa") + span)
    ratio = F.least("na", "nb") > limit * F.greatest("na", "nb")
    both = F.size(F.array_intersect("wa", "wb"))
    pairs = a.join(b, "cell").filter(close & ratio).withColumn("both", both).filter(F.col("both") > limit * (F.col("na") + F.col("nb") - F.col("both")))
    copies = exact_duplicates(docs).select(F.col("doc_id").alias("b"), F.col("other_id").alias("a"))
    return pairs.select("a", "b").join(copies, ["a", "b"], "left_anti").select(F.col("b").alias("doc_id"), F.col("a").alias("other_id"))


def stale(docs: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Documents whose column ts lies more than `days` before `now`."""
    return docs.filter(F.col("ts") < now - F.expr(f"interval {days} days")).select(*_issue("stale", "medium"))


def low_quality(docs: DataFrame, least: float = 0.3) -> DataFrame:
    w = words("text")
    bad = (F.length(strip(F.coalesce("text", F.lit("")))) >= 10) & (F.size(w) > 20) & (F.size(F.array_distinct(w)) < least * F.size(w))
    return docs.filter(bad).select(*_issue("low_quality", "low"))


def health(issues: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: 1 less .15, .08, .03, .01 per issue by severity, .05 more for a rich vocabulary, within 0 and 1."""
    n = lambda s: F.count_if(F.col("severity") == s)
    loss = issues.agg((0.15 * n("critical") + 0.08 * n("high") + 0.03 * n("medium") + 0.01 * n("low")).alias("loss"))
    score = 1 - F.col("loss") + F.when(F.col("richness") > 0.5, 0.05).otherwise(0.0)
    return stats.crossJoin(F.broadcast(loss)).select(F.when(F.col("n_docs") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)).alias("health"))


def with_first_rank(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
