"""Small cases of operators without SQL."""

import pytest

from lodestar.operators import agents, chunking, context, corpus, graph, guardrails, metrics, retrieval
from lodestar.sources import loaders


def test_recursive_split():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(50)) for _ in range(3))
    parts = chunking.split_recursive(text, 64, 8)
    assert all(len(p.split()) <= 64 for p in parts) and " ".join(parts).split() == text.split()
    assert chunking.split_recursive("  ") == []
    with pytest.raises(ValueError):
        chunking.split_recursive("a b", 4, 4)


def test_semantic_groups():
    assert chunking.semantic_groups([0.9, 0.1, 0.9], [5, 5, 5, 5], 0.5, 10) == [0, 0, 1, 1]
    assert chunking.semantic_groups([0.9, 0.1, 0.9], [5, 5, 5, 5], 0.5, 100) == [0, 0, 0, 0]


def test_lcs_length():
    assert metrics.lcs_length("a b c d".split(), "b x d".split()) == 2
    assert metrics.lcs_length([], ["a"]) == 0


def test_redaction(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("mail me at a.b@c.org or 555-123-4567",), (None,)], "t string")
    assert [r[0] for r in df.select(guardrails.redact(F.col("t"))).collect()] == ["mail me at [EMAIL_REDACTED] or [PHONE_REDACTED]", None]


def test_triples(spark):
    df = spark.createDataFrame([(1, "Paris is the capital. Lyon located in France! nothing here"), (2, None)], "doc_id long, text string")
    got = {(r.subject, r.predicate, r.object) for r in graph.triples(df).collect()}
    assert got == {("Paris", "is", "capital"), ("Lyon", "located_in", "France")}


def test_plan_steps(spark):
    df = spark.createDataFrame([(1, "compare apples and oranges"), (2, "find x, then use it"), (3, "who am I")], "qid long, text string")
    kinds = {(r.qid, r.kind): r.step for r in agents.plan_steps(df).orderBy("qid", "step").collect()}
    assert kinds[(1, "comparison")] == 3 and (3, "simple") in kinds and (2, "multi_hop") in kinds


def test_communities(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    df = spark.createDataFrame(edges, "src string, dst string").selectExpr("*", "1.0D as weight")
    got = {r.node: r.label for r in graph.communities(df).collect()}
    assert len({got[n] for n in "abc"}) == 1 and len({got[n] for n in "xyz"}) == 1 and got["a"] != got["x"]


def test_diversity_and_jaccard(spark):
    rows = [(1, 1, "a b c", 0.9), (1, 2, "a b c", 0.8), (1, 3, "d e f", 0.7)]
    df = spark.createDataFrame(rows, "qid long, seq int, text string, score double")
    assert [r.seq for r in context.ranked_diverse(df).orderBy("pos").collect()] == [1, 3, 2]
    assert {r.seq for r in context.dedup_jaccard(df).collect()} == {1, 3}


def test_dense_blocks(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "doc_id long, embedding array<float>")
    got = retrieval.dense(v, v.withColumnRenamed("doc_id", "qid"), 1, block=3).collect()
    assert {(r.qid, r.doc_id) for r in got} == {(i, i) for i in range(4)}
    assert retrieval.dense(v, v.withColumnRenamed("doc_id", "qid").limit(0), 1).count() == 0


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert corpus.statistics(empty).first().n_docs == 0
    assert chunking.token_chunks(empty).count() == 0


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.html").write_text("<title>t</title><script>x</script><p>one</p><p>two</p>")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "d.txt").write_text("no")
    assert {r.content for r in loaders.read_directory(spark, str(tmp_path)).collect()} == {"hello", "t\n\none\n\ntwo"}
    assert loaders.read_text(spark, str(tmp_path / "a.txt")).first().content == "hello"
    (tmp_path / "t.csv").write_text("a,b\n1,\n2,x\n")
    assert {r.content for r in loaders.read_csv(spark, str(tmp_path / "t.csv")).collect()} == {"a: 1", "a: 2 | b: x"}
