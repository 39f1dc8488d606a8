"""A persisted index and the pipeline over it: build once, query many times.

An index is a folder of Parquet tables: `chunks` (doc_id, chunk_id, text),
`postings` (chunk_id, term, tf, dl), `lengths` (chunk_id, dl), `vectors`
(chunk_id, embedding) and `gone` (doc_id). Adding appends; deleting appends to
`gone`, which every reader leaves out. Scores are computed from the counts at
query time, so they are those of the whole index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, unit
from . import context, retrieval

TABLES = {"chunks": "doc_id long, chunk_id long, text string", "postings": "chunk_id long, term string, tf long, dl int", "lengths": "chunk_id long, dl int", "vectors": "chunk_id long, embedding array<double>", "gone": "doc_id long"}


class Index:
    """An index in a folder; a folder without tables is an empty index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self._path(name))

    def chunks(self) -> DataFrame:
        """The chunks whose document is not deleted."""
        return self.table("chunks").join(self.table("gone").distinct(), "doc_id", "left_anti")

    def _live(self, name: str) -> DataFrame:
        if not self.table("gone").limit(1).count():
            return self.table(name)
        return self.table(name).join(self.chunks().select("chunk_id"), "chunk_id", "left_semi")

    def add(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        """Appends chunks (doc_id, chunk_id, text), and what `embed` gives for them as (chunk_id, embedding)."""
        chunks = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_id").cast("long"), "text")
        chunks.write.mode("append").parquet(self._path("chunks"))
        counted = chunks.select("chunk_id", tokens("text").alias("t")).select("chunk_id", "t", F.size("t").alias("dl"))
        counted.select("chunk_id", "dl").write.mode("append").parquet(self._path("lengths"))
        postings = counted.select("chunk_id", "dl", F.explode("t").alias("term")).groupBy("chunk_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
        # sorted by term, so that a reader's filter skips most row groups
        postings.select("chunk_id", "term", "tf", "dl").repartitionByRange("term").sortWithinPartitions("term").write.mode("append").parquet(self._path("postings"))
        if embed is not None:
            embed(chunks).select(F.col("chunk_id").cast("long"), unit("embedding").alias("embedding")).write.mode("append").parquet(self._path("vectors"))
        return self

    def delete(self, ids: DataFrame) -> int:
        """Leaves out all chunks of the documents (doc_id); the number of chunks that go."""
        gone = self.chunks().join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        n = gone.count()
        gone.select("doc_id").distinct().write.mode("append").parquet(self._path("gone"))
        return n

    def count(self) -> int:
        return self.chunks().count()

    def search_text(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """BM25 over the stored postings: (qid, doc_id, score, rank), where doc_id is a chunk's."""
        asked = retrieval.asked_terms(queries)
        stats = self._live("lengths").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        hits = self._live("postings").join(asked.select("term").distinct(), "term", "left_semi").withColumnRenamed("chunk_id", "doc_id")
        return retrieval.score_postings(hits, stats, asked, k)

    def search_vector(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return retrieval.dense(self._live("vectors").withColumnRenamed("chunk_id", "doc_id"), queries, k)

    def search(self, queries: DataFrame, k: int = 5, dense_weight: float = 0.6, sparse_weight: float = 0.4) -> DataFrame:
        """Both searches fused; queries (qid, text, embedding), or text alone."""
        if "embedding" not in queries.columns:
            return self.search_text(queries, k)
        return retrieval.rrf([(self.search_vector(queries, 3 * k), dense_weight), (self.search_text(queries, 3 * k), sparse_weight)], k)


class Pipeline:
    """Chunk, index, retrieve, and answer; models are functions of DataFrames."""

    def __init__(self, index: Index, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None, rerank: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None):
        self.index, self.chunk, self.embed, self.rerank = index, chunk, embed, rerank

    def ingest(self, docs: DataFrame) -> int:
        """Chunks and indexes documents (doc_id, text); the number of chunks. A chunk's id is its document's times 2**20 plus its place."""
        chunks = self.chunk(docs).select("doc_id", (F.col("doc_id") * (1 << 20) + F.col("chunk_index")).alias("chunk_id"), "text")
        before = self.index.count()
        self.index.add(chunks, self.embed)
        return self.index.count() - before

    def retrieve(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(qid, chunk_id, score, rank, text) of questions (qid, text[, embedding])."""
        found = self.index.search(questions, 3 * k if self.rerank else k)
        chunks = self.index.chunks()
        if self.rerank:
            found = self.rerank(found, chunks.select(F.col("chunk_id").alias("doc_id"), "text"), questions)
            found = found.filter(F.col("rank") <= k)
        return found.withColumnRenamed("doc_id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").select("qid", "chunk_id", "score", "rank", "text")

    def query(self, questions: DataFrame, answer: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
        """(qid, answer, n_sources): `answer` gives (qid, answer) for prompts (qid, prompt)."""
        found = self.retrieve(questions, k)
        rendered = context.render(found.withColumnRenamed("rank", "seq"))
        answers = answer(context.prompt(questions.select("qid", "text"), rendered))
        n = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n_sources"))
        return answers.join(n, "qid", "left").select("qid", "answer", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
