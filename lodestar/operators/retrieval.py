"""Scoring and top-k over tables of queries and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens, unit

#: Rows of a query set that travel with each pass over the vectors.
QUERY_BLOCK = 1024
#: Vectors that meet a block of queries in one task.
VECTOR_CHUNK = 50_000
#: Scores of one block of queries that a task holds at a time.
SCORES_AT_ONCE = 2_000_000


def top_k(scored: DataFrame, k: int, by: str = "score", key: str = "qid", tie: str = "doc_id") -> DataFrame:
    """rank 1 to k per key; ties go to the smaller id. Spark keeps k rows a task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl)."""
    t = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("toks"))
    return t.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, doc_id, score, rank); queries (qid, text). Query terms keep their multiplicity; scores above 0 only.

    Documents are scanned twice, once to count their tokens and once for the
    postings of the queries' terms; others are dropped before any shuffle.
    An index keeps both (operators.index).
    """
    asked = asked_terms(queries)
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN))).alias("avgdl"))
    counted = docs.select("doc_id", tokens("text").alias("toks")).select("doc_id", F.size("toks").alias("dl"), "toks")
    hits = counted.select("doc_id", "dl", F.explode("toks").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    return score_postings(hits.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")), stats, asked, k, k1, b)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qn) of queries (qid, text)."""
    return queries.select("qid", F.explode(tokens("text")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn"))


def score_postings(hits: DataFrame, stats: DataFrame, asked: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 over the postings (doc_id, term, dl, tf) of the asked terms; stats is one row (n, avgdl)."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    per = hits.join(df, "term").crossJoin(F.broadcast(stats)).select("doc_id", "term", (idf * F.col("tf") * (k1 + 1) / norm).alias("w"))  # stats is one row
    scored = per.join(asked, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qn")), 6).alias("score"))
    return top_k(scored.filter("score > 0"), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, doc_id, score, rank) by cosine; vectors (doc_id, embedding), queries (qid, embedding).

    The filter comes before scoring, so it reaches the scan. One block of
    queries, a fixed number of rows, goes to every task with the code. More are
    a table: chunks of vectors meet blocks of queries in tasks of bounded size.
    Each task keeps k rows a query.
    """
    if where is not None:
        vectors = vectors.filter(where)
    schema = "qid long, doc_id long, score double"
    vectors, queries = vectors.select("doc_id", "embedding"), queries.select("qid", "embedding")
    first = queries.limit(block + 1).collect()  # bounded
    if not first:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    if len(first) <= block:
        ids, matrix = np.array([r[0] for r in first]), _unit_rows([r[1] for r in first])
        return top_k(vectors.mapInPandas(_scorer(ids, matrix, k), schema), k)
    n_blocks, n_chunks = -(-queries.count() // block), max(1, -(-vectors.count() // VECTOR_CHUNK))
    deal = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    left = deal(vectors, "doc_id", "chunk", n_chunks, "block", n_blocks).groupBy("chunk", "block")
    right = deal(queries, "qid", "block", n_blocks, "chunk", n_chunks).groupBy("chunk", "block")

    def score(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = list(_scorer(q["qid"].to_numpy(), _unit_rows(q["embedding"].tolist()), k)(iter([v]))) if len(q) else []
        return found[0] if found else pd.DataFrame({"qid": [], "doc_id": [], "score": []}).astype({"qid": "int64", "doc_id": "int64", "score": "float64"})

    return top_k(left.cogroup(right).applyInPandas(score, schema), k)


def _unit_rows(rows: list) -> np.ndarray:
    m = np.asarray(rows, float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _scorer(ids: np.ndarray, matrix: np.ndarray, k: int) -> Callable:
    rows = max(1, SCORES_AT_ONCE // max(1, len(ids)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for b in (whole.iloc[at : at + rows] for whole in batches for at in range(0, len(whole), rows)):
            scores = np.round(matrix @ _unit_rows(b["embedding"].tolist()).T, 6)
            docs = b["doc_id"].to_numpy()
            take = min(k, len(docs))
            order = np.lexsort((np.broadcast_to(docs, scores.shape), -scores), axis=1)[:, :take]
            found = pd.DataFrame({"qid": np.repeat(ids, take), "doc_id": docs[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["qid", "score", "doc_id"], ascending=[True, False, True]).groupby("qid", sort=False).head(k)
        if best is not None:
            yield best

    return run


def rrf(ranked: list[tuple[DataFrame, float]], k: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked tables (qid, doc_id, rank) with weights."""
    parts = [r.select("qid", "doc_id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for r, w in ranked]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top_k(both.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, dense_weight: float = 0.6, sparse_weight: float = 0.4) -> DataFrame:
    """Three times k rows from each side are fused; queries need text and embedding."""
    return rrf([(dense(vectors, queries, 3 * k), dense_weight), (bm25(docs, queries, 3 * k), sparse_weight)], k)


def rerank(results: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 3, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Overwrites the score by one of the pair (query text, document text); the default is the share of query words found."""
    if score is None:
        score = lambda q, d: F.size(F.array_intersect(F.array_distinct(tokens(q)), F.array_distinct(tokens(d)))) / F.greatest(F.lit(1), F.size(F.array_distinct(tokens(q))))
    pairs = results.select("qid", "doc_id").join(queries.select("qid", F.col("text").alias("q")), "qid").join(docs.select("doc_id", F.col("text").alias("d")), "doc_id")
    return top_k(pairs.select("qid", "doc_id", F.round(score(F.col("q"), F.col("d")), 6).alias("score")), k)


def expand(queries: DataFrame, variants: Callable[[Column], Column]) -> DataFrame:
    """(qid, variant, text): variant 0 is the query; `variants` gives an array of rewritten queries."""
    every = F.concat(F.array("text"), F.filter(variants(F.col("text")), lambda x: F.length(x) > 5))
    return queries.select("qid", F.posexplode(every).alias("variant", "text"))


def merge_variants(results: DataFrame, k: int) -> DataFrame:
    """Results (qid, variant, doc_id, score) of expanded queries: each document by its first variant, then the best k."""
    w = Window.partitionBy("qid", "doc_id").orderBy("variant", F.col("score").desc())
    return top_k(results.withColumn("seen", F.row_number().over(w)).filter("seen = 1").drop("seen"), k)


def normalised(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length 1, as an index table keeps them."""
    return vectors.withColumn("embedding", unit("embedding"))


def upsert(table: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return table.unionByName(new).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def delete(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")
