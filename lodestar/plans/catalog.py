"""Queries over sources, chunks, retrieval, metrics, context, corpus quality, guardrails, agents, graph and stores, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lineage import written
from ..operators import agents, chunking, context, corpus, graph, guardrails, metrics, retrieval, stores
from ..sources import loaders
from ..streaming import incremental
from .base import PLAIN, TOKS, query, words_sql

# ---- sources ----


@query("SELECT doc_id, substr(md5(text), 1, 12) AS content_id FROM documents")
def document_ids(read):
    return read("documents").select("doc_id", loaders.document_id("text").alias("content_id"))


@query("SELECT 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey AS content FROM nation")
def row_documents(read):
    df = read("nation")
    return df.select(loaders.rows_to_text(df, ["n_nationkey", "n_name", "n_regionkey"]).alias("content"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(read):
    return read("pages").select("page_id", loaders.html_title("html").alias("title"))


@query()
def page_texts(read):
    return read("pages").select("page_id", loaders.html_text("html").alias("text"))


# ---- chunkers ----


def _windows_sql(size: int, overlap: int) -> str:
    return f"list_filter(range(0, n, {size - overlap}), lambda s: s = 0 OR s + {overlap} < n)"


@query(f"""WITH w AS (SELECT doc_id, {PLAIN.format('text')} AS t, len({PLAIN.format('text')}) AS n FROM documents),
s AS (SELECT doc_id, t, n, unnest({_windows_sql(512, 64)}) AS s, generate_subscripts({_windows_sql(512, 64)}, 1) - 1 AS i FROM w)
SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(s AS INT) AS token_start, CAST(least(s + 512, n) AS INT) AS token_end, CAST(least(512, n - s) AS INT) AS token_count,
array_to_string(t[s + 1:s + 512], ' ') AS text FROM s""")
def token_chunks(read):
    return chunking.token_chunks(read("documents"))


@query(f"""WITH w AS (SELECT doc_id, {PLAIN.format('text')} AS t, len({PLAIN.format('text')}) AS n FROM documents),
p AS (SELECT doc_id, t, unnest({_windows_sql(512, 64)}) AS s, generate_subscripts({_windows_sql(512, 64)}, 1) - 1 AS i FROM w),
q AS (SELECT doc_id, i, t[s + 1:s + 512] AS pw, len(t[s + 1:s + 512]) AS n FROM p),
c AS (SELECT doc_id, i, pw, unnest({_windows_sql(128, 16)}) AS s, generate_subscripts({_windows_sql(128, 16)}, 1) - 1 AS j FROM q)
SELECT doc_id, CAST(i AS INT) AS parent_index, CAST(j AS INT) AS child_index, CAST(len(pw[s + 1:s + 128]) AS INT) AS n_words, array_to_string(pw[s + 1:s + 128], ' ') AS text, CAST(len(pw) AS INT) AS parent_words FROM c""")
def parent_child_chunks(read):
    return chunking.parent_child_chunks(read("documents"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS start FROM documents)
SELECT doc_id, CAST(start // 1000 AS INT) AS slice_index, substr(text, start + 1, 1000) AS text FROM s""")
def character_slices(read):
    return chunking.character_slices(read("documents"))


@query()
def recursive_chunks(read):
    return chunking.recursive_chunks(read("documents"))


# ---- retrieval ----

BM25 = rf"""toks AS (SELECT doc_id, {TOKS} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT qid, term, count(*) AS qn FROM (SELECT item_id AS qid, unnest({TOKS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT qid, doc_id, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN df USING (term) JOIN q USING (term), stats GROUP BY qid, doc_id),
bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def _items(read):
    return read("benchmark").select(F.col("item_id").alias("qid"), "text")


def _vectors(read):
    return read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _vector_queries(read):
    return read("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")


@query(f"WITH {BM25} SELECT qid, doc_id, score, CAST(rank AS INT) AS rank FROM bm WHERE rank <= 5")
def bm25_topk(read):
    return retrieval.bm25(read("documents"), _items(read), 5)


DENSE = """cos AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id, e.label AS label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE {}),
dn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM cos)"""


@query(f"WITH {DENSE.format('q.vec_id % 50 = 0')} SELECT qid, doc_id, score, CAST(rank AS INT) AS rank FROM dn WHERE rank <= 5")
def dense_topk(read):
    return retrieval.dense(_vectors(read), _vector_queries(read), 5)


@query(f"WITH {DENSE.format('q.vec_id % 50 = 0 AND e.label = 3')} SELECT qid, doc_id, score, CAST(rank AS INT) AS rank FROM dn WHERE rank <= 5")
def dense_filtered(read):
    return retrieval.dense(_vectors(read), _vector_queries(read), 5, F.col("label") == 3)


HYBRID = f"""{BM25}, {DENSE.format('q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id IN (SELECT doc_id FROM documents)')},
parts AS (SELECT qid, doc_id, CAST(0.6 AS DOUBLE) / (60 + rank) AS part FROM dn WHERE rank <= 15 UNION ALL SELECT qid, doc_id, CAST(0.4 AS DOUBLE) / (60 + rank) FROM bm WHERE rank <= 15),
fused AS (SELECT qid, doc_id, round(sum(part), 9) AS score FROM parts GROUP BY ALL),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused)"""


def _hybrid(read, k):
    docs = read("documents")
    vectors = _vectors(read).join(docs.select("doc_id"), "doc_id", "left_semi")
    q = _items(read).join(_vectors(read).select(F.col("doc_id").alias("qid"), "embedding"), "qid", "left")
    dense = retrieval.dense(vectors, q.filter("embedding is not null"), 3 * k)
    return retrieval.rrf([(dense, 0.6), (retrieval.bm25(docs, q.select("qid", "text"), 3 * k), 0.4)], k)


@query(f"WITH {HYBRID} SELECT qid, doc_id, score, CAST(rank AS INT) AS rank FROM hy WHERE rank <= 5")
def hybrid_rrf(read):
    return _hybrid(read, 5)


@query(rf"""WITH {BM25}, pairs AS (SELECT bm.qid, bm.doc_id, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+')) AS d
FROM bm JOIN benchmark b ON b.item_id = bm.qid JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 10),
s AS (SELECT qid, doc_id, round(len(list_intersect(q, d)) / greatest(1, len(q)), 6) AS score FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def rerank_lexical(read):
    docs, items = read("documents"), _items(read)
    return retrieval.rerank(retrieval.bm25(docs, items, 10), docs, items, 3)


@query("""SELECT item_id AS qid, CAST(v AS INT) AS variant, CASE v WHEN 0 THEN text ELSE 'Background of: ' || text END AS text FROM benchmark, (SELECT unnest([0, 1]) AS v)""")
def query_expansion(read):
    return retrieval.expand(_items(read), lambda q: F.array(F.concat(F.lit("Background of: "), q)))


# ---- metrics ----


@query(f"""WITH {DENSE.format('q.vec_id % 50 = 0')}, rel AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 50 = 0),
nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
r AS (SELECT d.qid, d.doc_id, d.rank, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM dn d LEFT JOIN rel ON rel.qid = d.qid AND rel.doc_id = d.doc_id WHERE rank <= 10),
h AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM r)
SELECT h.qid, CAST(max(hit) AS DOUBLE) AS hit_rate, round(coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN hit END), 6) AS precision,
round(count(DISTINCT CASE WHEN hit = 1 AND rank <= 5 THEN doc_id END) / any_value(n), 6) AS recall,
round(sum(CASE WHEN hit = 1 AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg,
round(sum(CASE WHEN hit = 1 AND rank <= 5 THEN hits / rank ELSE 0 END) / any_value(least(n, 5)), 6) AS map,
round(sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) / any_value(n), 6) AS context_precision FROM h JOIN nr ON nr.qid = h.qid GROUP BY h.qid""")
def retrieval_metrics(read):
    q, v = _vector_queries(read), _vectors(read)
    relevant = q.select("qid", "label").join(v.select("doc_id", "label"), "label").select("qid", "doc_id")
    return metrics.retrieval_metrics(retrieval.dense(v, q, 10), relevant, 5)


TURNS = """SELECT a.conv_id * 1000 + a.turn AS id, a.text AS answer, u.text AS source FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'"""


def _turns(read):
    c = read("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return c.filter("role = 'assistant'").join(before, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), "source")


@query(f"""WITH t AS ({TURNS}), w AS (SELECT id, {words_sql('answer')} AS a, {words_sql('source')} AS s FROM t),
g AS (SELECT id, a, s, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS ga, list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1])) AS gs FROM w)
SELECT id, round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(s, x))) / len(a) ELSE 0 END, 4) AS unigram, round(CASE WHEN len(ga) > 0 THEN len(list_intersect(ga, gs)) / len(ga) ELSE 0 END, 4) AS bigram FROM g""")
def faithfulness(read):
    return metrics.faithfulness(_turns(read))


# ---- context windows: ten BM25 results of each item ----

ITEMS = f"""{BM25}, items AS (SELECT bm.qid, CAST(bm.rank AS INT) AS seq, d.text, bm.score, d.source, d.doc_id || ':0' AS chunk_id, CAST(greatest(1, length(d.text) // 4) AS INT) AS token_count
FROM bm JOIN documents d USING (doc_id) WHERE rank <= 10)"""


def _context(read):
    docs = read("documents")
    found = retrieval.bm25(docs, _items(read), 10)
    return found.join(docs, "doc_id").select("qid", F.col("rank").alias("seq"), "text", "score", "source", F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), X.token_estimate("text").alias("token_count"))


@query(f"WITH {ITEMS} SELECT qid, min(seq) AS seq FROM items GROUP BY qid, text")
def context_dedup_exact(read):
    return context.dedup_exact(_context(read)).select("qid", "seq")


@query(rf"WITH {ITEMS} SELECT qid, min(seq) AS seq FROM items GROUP BY qid, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')))")
def context_dedup_hash(read):
    return context.dedup_hash(_context(read)).select("qid", "seq")


@query(f"""WITH {ITEMS} SELECT qid, seq, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS INT) AS relevance,
CAST(row_number() OVER (PARTITION BY qid ORDER BY len(list_distinct({words_sql()})) / greatest(1, token_count) DESC, seq) AS INT) AS density, CAST(row_number() OVER (PARTITION BY qid ORDER BY chunk_id, seq) AS INT) AS position FROM items""")
def context_prioritize(read):
    items = _context(read)
    out = context.ranked(items, "relevance").withColumnRenamed("pos", "relevance")
    out = context.ranked(out, "density").withColumnRenamed("pos", "density")
    return context.ranked(out, "position").select("qid", "seq", "relevance", "density", F.col("pos").alias("position"))


@query(f"""WITH {ITEMS} SELECT qid, seq, CASE WHEN token_count > 200 AND length(text) > 800 THEN substr(text, 1, 800) || '...' ELSE text END AS text, CAST(least(token_count, 200) AS INT) AS token_count FROM items""")
def context_compress(read):
    return context.compress(_context(read), 200).select("qid", "seq", "text", "token_count")


@query(f"""WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, seq) AS k FROM items) SELECT qid, seq FROM n WHERE k = 1 OR source = ''""")
def context_conflicts(read):
    return context.resolve_conflicts(_context(read)).select("qid", "seq")


@query(f"""WITH {ITEMS}, n AS (SELECT *, sum(token_count) OVER (PARTITION BY qid ORDER BY seq) AS used FROM items) SELECT qid, seq, CAST(used AS BIGINT) AS used FROM n WHERE used <= 2000""")
def context_budget(read):
    return context.budget(_context(read), 2000).select("qid", "seq", "used")


@query(f"WITH {ITEMS} SELECT qid, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(least(1.0, CAST(sum(token_count) AS DOUBLE) / 8000), 6) AS utilisation FROM items GROUP BY qid")
def context_utilisation(read):
    return context.utilisation(_context(read), 8000).withColumn("utilisation", F.round("utilisation", 6))


@query(f"""WITH {ITEMS} SELECT qid, md5(string_agg('[' || seq || '] (score: ' || CAST(CAST(score AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq)) AS context_md5 FROM items GROUP BY qid""")
def context_render(read):
    return context.render(_context(read)).select("qid", F.md5("context").alias("context_md5"))


# ---- corpus quality ----

STOP = ", ".join(f"'{w}'" for w in corpus.STOPWORDS)
TERMS = rf"""terms AS (SELECT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_\x{{80}}-\x{{10FFFF}}]+')) AS term FROM documents) WHERE regexp_matches(term, '^[a-z]{{2,}}$') AND term NOT IN ({STOP}))"""
STATS = f"""WITH {TERMS}, t AS (SELECT count(*) AS total_words, count(DISTINCT term) AS unique_words FROM terms),
d AS (SELECT count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(length(text)), 6) AS avg_chars, CAST(min(length(text)) AS INT) AS min_chars, CAST(max(length(text)) AS INT) AS max_chars FROM documents)"""


@query(f"{STATS} SELECT d.*, t.*, round(CASE WHEN total_words > 0 THEN unique_words / total_words ELSE 0 END, 6) AS richness FROM d, t")
def corpus_statistics(read):
    return corpus.statistics(read("documents"))


@query(f"WITH {TERMS} SELECT term, count(*) AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 20")
def top_terms(read):
    return corpus.top_terms(read("documents"))


ISSUES = r"""st AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t, text FROM documents),
short AS (SELECT doc_id, CASE WHEN t = '' THEN 'empty' ELSE 'short' END AS kind, CASE WHEN t = '' THEN 'critical' ELSE 'medium' END AS severity, CAST(NULL AS BIGINT) AS other_id FROM st WHERE length(t) < 50),
dup AS (SELECT doc_id, 'duplicate' AS kind, 'high' AS severity, first AS other_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS first FROM st) WHERE doc_id <> first),
lw AS (SELECT doc_id, t, """ + words_sql("t") + r""" AS w FROM st),
low AS (SELECT doc_id, 'low_quality' AS kind, 'low' AS severity, CAST(NULL AS BIGINT) AS other_id FROM lw WHERE length(t) >= 10 AND len(w) > 20 AND len(list_distinct(w)) < 0.3 * len(w)),
issues AS (SELECT * FROM short UNION ALL SELECT * FROM dup UNION ALL SELECT * FROM low)"""


def _issues(docs):
    return corpus.short_texts(docs).unionByName(corpus.exact_duplicates(docs)).unionByName(corpus.low_quality(docs))


@query(f"WITH {ISSUES} SELECT * FROM issues")
def quality_issues(read):
    return _issues(read("documents"))


@query(f"WITH {ISSUES} SELECT kind, count(*) AS n FROM issues GROUP BY kind")
def issues_by_kind(read):
    return _issues(read("documents")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ISSUES}, s AS ({STATS} SELECT d.*, t.*, unique_words / total_words AS richness FROM d, t),
l AS (SELECT 0.15 * count(*) FILTER (severity = 'critical') + 0.08 * count(*) FILTER (severity = 'high') + 0.03 * count(*) FILTER (severity = 'medium') + 0.01 * count(*) FILTER (severity = 'low') AS loss FROM issues)
SELECT round(greatest(0, least(1, 1 - CAST(loss AS DOUBLE) + CASE WHEN richness > 0.5 THEN 0.05 ELSE 0 END)), 6) AS health FROM s, l""")
def corpus_health(read):
    docs = read("documents")
    return corpus.health(_issues(docs), corpus.statistics(docs))


@query(f"""WITH {ISSUES}, s AS (SELECT doc_id, list_distinct({words_sql("coalesce(text, '')")}) AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM s WHERE len(w) > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS nboth, a.n AS na, b.n AS nb FROM n a JOIN n b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 49 WHERE least(a.n, b.n) > 0.85 * greatest(a.n, b.n))
SELECT b AS doc_id, a AS other_id FROM p WHERE nboth > 0.85 * (na + nb - nboth) AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.doc_id = p.b AND dup.other_id = p.a)""")
def near_duplicate_window(read):
    return corpus.near_duplicates(read("documents"))


@query("""WITH d AS (SELECT event_id AS doc_id, ts FROM events) SELECT doc_id, 'stale' AS kind, 'medium' AS severity, CAST(NULL AS BIGINT) AS other_id FROM d WHERE ts < TIMESTAMP '2025-01-15 00:00:00' - INTERVAL 365 DAY""")
def stale_records(read):
    return corpus.stale(read("events").select(F.col("event_id").alias("doc_id"), "ts"), F.expr("timestamp_ntz'2025-01-15 00:00:00'"))


# ---- guardrails ----


def _personal_sql(kind: str) -> str:
    return "(?i)" + guardrails.PERSONAL[kind][0].replace("'", "''")


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_personal_sql(k)}')) AS n_{k.lower()}" for k in guardrails.PERSONAL) + " FROM documents")
def personal_counts(read):
    return read("documents").select("doc_id", *[guardrails.count_personal(F.col("text"), k).cast("long").alias(f"n_{k.lower()}") for k in guardrails.PERSONAL])


def _redact_sql() -> str:
    out = "text"
    for k, (_, mark) in guardrails.PERSONAL.items():
        out = f"regexp_replace({out}, '{_personal_sql(k)}', '{mark}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redact_sql()}) AS redacted_md5 FROM documents")
def redaction(read):
    return read("documents").select("doc_id", F.md5(guardrails.redact(F.col("text"))).alias("redacted_md5"))


INJECTED = " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for _, p, w in guardrails.INJECTION)


@query(f"SELECT conv_id, turn, round(least(1.0, CAST({INJECTED} AS DOUBLE)), 6) AS risk, round(least(1.0, CAST({INJECTED} AS DOUBLE)), 6) >= 0.5 AS blocked FROM conversations")
def injection_check(read):
    risk = guardrails.injection_score(F.col("text"))
    return read("conversations").select("conv_id", "turn", risk.alias("risk"), (risk >= 0.5).alias("blocked"))


TOPICS = {"finance": ["price", "cost", "money"], "health": ["doctor", "medicine"], "travel": ["flight", "hotel", "the"]}


@query("""WITH s AS (SELECT conv_id * 1000 + turn AS qid, text, lower(text) AS q FROM conversations), o AS (SELECT qid, text,
greatest(CASE WHEN contains(q, 'finance') THEN 0.9 ELSE 0 END, round((CAST(contains(q, 'price') AS INT) + CAST(contains(q, 'cost') AS INT) + CAST(contains(q, 'money') AS INT)) / 3 * 0.8, 6)) AS f,
greatest(CASE WHEN contains(q, 'health') THEN 0.9 ELSE 0 END, round((CAST(contains(q, 'doctor') AS INT) + CAST(contains(q, 'medicine') AS INT)) / 2 * 0.8, 6)) AS h,
greatest(CASE WHEN contains(q, 'travel') THEN 0.9 ELSE 0 END, round((CAST(contains(q, 'flight') AS INT) + CAST(contains(q, 'hotel') AS INT) + CAST(contains(q, 'the') AS INT)) / 3 * 0.8, 6)) AS t FROM s),
b AS (SELECT qid, text, greatest(f, h, t) AS c, CASE WHEN greatest(f, h, t) = 0 THEN '' WHEN f >= h AND f >= t THEN 'finance' WHEN h >= t THEN 'health' ELSE 'travel' END AS topic FROM o)
SELECT qid, topic, CAST(c AS DOUBLE) AS confidence, CASE WHEN trim(text) = '' THEN true WHEN topic = 'health' THEN false WHEN topic = 'travel' THEN true WHEN c < 0.3 THEN true ELSE false END AS is_allowed FROM b""")
def topic_check(read):
    q = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return guardrails.topic_check(q, TOPICS, allowed=["travel"], blocked=["health"])


# ---- agents ----


def _case(column: str, pairs: list[tuple[str, list[str]]]) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains({column}, '{c}')" for c in cues) + f" THEN '{name}'" for name, cues in pairs)


KIND = f"CASE {_case('q', agents.CLASSES)} ELSE 'factual' END"


@query(rf"""WITH s AS (SELECT conv_id, turn, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS q FROM conversations), k AS (SELECT conv_id, turn, {KIND} AS kind FROM s)
SELECT conv_id, turn, kind, CASE kind WHEN 'factual' THEN 'dense' WHEN 'conversational' THEN 'dense' WHEN 'comparative' THEN 'multi_pass' ELSE 'hybrid' END AS strategy,
CASE kind WHEN 'factual' THEN 3 WHEN 'comparative' THEN 8 WHEN 'exploratory' THEN 10 ELSE 5 END AS top_k FROM k""")
def query_classes(read):
    kind = read("conversations").select("conv_id", "turn", agents.classify(F.col("text")).alias("kind"))
    how, k = agents.strategy(F.col("kind"))
    return kind.select("conv_id", "turn", "kind", how.alias("strategy"), k.alias("top_k"))


@query()
def query_plans(read):
    return agents.plan_steps(read("conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text"))


@query(f"""WITH {DENSE.format('q.vec_id % 50 = 0')}, r AS (SELECT * FROM dn WHERE rank <= 5)
SELECT qid, round(least(1.0, least(count(*) / 3, 1.0) * 0.5 + avg(score) * 0.5), 6) AS confidence, round(least(1.0, least(count(*) / 3, 1.0) * 0.5 + avg(score) * 0.5), 6) < 0.3 AS retry FROM r GROUP BY qid""")
def adaptive_confidence(read):
    return agents.retrieval_confidence(retrieval.dense(_vectors(read), _vector_queries(read), 5))


@query(f"""WITH {DENSE.format('q.vec_id % 50 = 0')}, r AS (SELECT dn.qid, CASE WHEN dn.label = q.label THEN 'correct' WHEN score > 0.2 THEN 'ambiguous' ELSE 'incorrect' END AS grade FROM dn JOIN embeddings q ON q.vec_id = dn.qid WHERE rank <= 5),
a AS (SELECT qid, round(count(*) FILTER (grade = 'correct') / count(*), 6) AS correct_ratio, round(count(*) FILTER (grade IN ('correct', 'ambiguous')) / count(*), 6) AS usable_ratio FROM r GROUP BY qid)
SELECT *, CASE WHEN correct_ratio >= 0.5 THEN 'direct' WHEN usable_ratio >= 0.5 THEN 'refine' ELSE 'search_elsewhere' END AS action FROM a""")
def corrective_action(read):
    q, v = _vector_queries(read), _vectors(read)
    found = retrieval.dense(v, q, 5).join(q.select("qid", F.col("label").alias("want")), "qid").join(v.select("doc_id", "label"), "doc_id")
    grade = F.when(F.col("label") == F.col("want"), "correct").when(F.col("score") > 0.2, "ambiguous").otherwise("incorrect")
    return agents.crag_action(found.select("qid", grade.alias("grade")))


def _overlap_sql(a: str, b: str) -> str:
    x, y = f"list_distinct({words_sql(a)})", words_sql(b)
    return f"CASE WHEN len({x}) > 0 THEN len(list_intersect({x}, {y})) / len({x}) ELSE 0 END"


@query(rf"""WITH t AS ({TURNS}), c AS (SELECT id, source, unnest(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS claim FROM t),
b AS (SELECT id, {_overlap_sql('claim', 'source')} AS best FROM c WHERE length(regexp_replace(claim, '^\s+|\s+$', '', 'g')) > 10)
SELECT id, count(*) AS n_claims, count(*) FILTER (best >= 0.5) AS n_supported, round(avg(best), 6) AS confidence FROM b GROUP BY id""")
def answer_verification(read):
    t = _turns(read)
    return agents.verify(t.select("id", "answer"), t.select("id", "source"))


@query("""WITH t AS (SELECT event_type AS config, event_id AS seq, value AS score, event_type = 'error' AS failed FROM events)
SELECT arg_max(config, struct_pack(s := score, k := -seq)) AS best_config, max(score) AS best, min(score) AS worst, round(avg(score), 6) AS mean, round(max(score) - min(score), 6) AS improvement FROM t WHERE NOT failed""")
def best_trial(read):
    t = read("events").select(F.col("event_type").alias("config"), F.col("event_id").alias("seq"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("failed"))
    return agents.best_trial(t)


# ---- graph ----


@query()
def triples(read):
    return graph.triples(read("documents"))


@query()
def entity_mentions(read):
    return graph.mentions(graph.triples(read("documents")))


KEYS_SQL = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _key_edges(read):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = read("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    s = read("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    return c.unionByName(s).unionByName(read("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))


@query(f"WITH {KEYS_SQL}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS entity, count(*) AS degree FROM b GROUP BY src")
def node_degrees(read):
    e = _key_edges(read)
    return graph.degrees(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@query(f"""WITH RECURSIVE {KEYS_SQL}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS hop FROM region UNION SELECT h.seed, b.dst, h.hop + 1 FROM h JOIN b ON b.src = h.node WHERE h.hop < 2)
SELECT seed, node, CAST(min(hop) AS INT) AS hop FROM h GROUP BY seed, node HAVING min(hop) > 0""")
def k_hop_neighbours(read):
    seeds = read("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))
    return graph.k_hop(_key_edges(read), seeds, 2, written)


@query()
def entities(read):
    return graph.typed_entities(read("documents"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, list_distinct(list_transform(range(1, length(name)), lambda i: substr(lower(name), i, 2))) AS g FROM n),
p AS (SELECT a.name AS a, b.name AS b, round(2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS dice FROM g a JOIN g b ON a.name < b.name)
SELECT 'part' AS kind, a, b, dice FROM p WHERE dice >= 0.85""")
def entity_resolution(read):
    return graph.similar_names(read("part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name")))


@query(f"""WITH {BM25}, {DENSE.format('q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id IN (SELECT doc_id FROM documents)')},
g AS (SELECT qid, CAST(doc_id AS VARCHAR) AS key, CAST(0.4 AS DOUBLE) * score / max(score) OVER (PARTITION BY qid) AS s FROM bm WHERE rank <= 5), v AS (SELECT qid, CAST(doc_id AS VARCHAR) AS key, CAST(0.6 AS DOUBLE) * score AS s FROM dn WHERE rank <= 5)
SELECT qid, key, round(sum(s), 6) AS score FROM (SELECT * FROM g UNION ALL SELECT * FROM v) GROUP BY qid, key""")
def fused_scores(read):
    docs = read("documents")
    vectors = _vectors(read).join(docs.select("doc_id"), "doc_id", "left_semi")
    q = _vectors(read).join(_items(read).select(F.col("qid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), "embedding")
    key = F.col("doc_id").cast("string").alias("key")
    return graph.fuse(retrieval.bm25(docs, _items(read), 5).select("qid", key, "score"), retrieval.dense(vectors, q, 5).select("qid", key, "score"))


# ---- stores ----


@query("""WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.qid, e.vec_id AS entry_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings e WHERE e.vec_id % 50 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, entry_id) AS k FROM p WHERE similarity >= 0.3) SELECT qid, entry_id, similarity FROM r WHERE k = 1""")
def semantic_cache(read):
    cache = read("embeddings").filter("vec_id % 50 <> 0").select(F.col("vec_id").alias("entry_id"), "embedding", F.expr("timestamp'2024-01-01 00:00:00'").alias("ts"))
    return stores.semantic_lookup(_vector_queries(read), cache, F.expr("timestamp'2024-01-01 00:30:00'"), 0.3)


@query("SELECT event_id AS entry_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 1000")
def cache_eviction(read):
    e = read("events").select(F.col("event_id").alias("entry_id"), "ts")
    return stores.evict(e, F.expr("timestamp_ntz'2024-01-30 00:00:00'"), "10 days", 1000)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || CASE WHEN role = 'assistant' AND length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, chr(10) ORDER BY turn) AS history FROM r WHERE k <= 10 GROUP BY conv_id""")
def conversation_history(read):
    return stores.history(read("conversations"))


@query("SELECT conv_id, max(turn) AS updated_at, count(*) AS n_messages FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conv_id LIMIT 100")
def conversation_list(read):
    m = read("conversations")
    return stores.conversation_list(m.groupBy("conv_id").agg(F.max("turn").alias("updated_at")), m, 100)


USAGE = """u AS (SELECT CASE event_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' ELSE 'llama3' END AS model, event_type AS operation, CAST(floor(abs(value) * 10) AS BIGINT) AS prompt_tokens, CAST(floor(abs(value)) AS BIGINT) AS completion_tokens FROM events),
c AS (SELECT *, (prompt_tokens * CASE model WHEN 'gpt-4o-mini' THEN CAST(0.15 AS DOUBLE) WHEN 'gpt-4o' THEN 2.5 ELSE 0 END + completion_tokens * CASE model WHEN 'gpt-4o-mini' THEN CAST(0.6 AS DOUBLE) WHEN 'gpt-4o' THEN 10.0 ELSE 0 END) / 1e6 AS cost_usd FROM u)"""


@query(f"""WITH {USAGE} SELECT coalesce(model, '*') AS model, coalesce(operation, '*') AS operation, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd), 6) AS cost_usd, count(*) AS calls FROM c GROUP BY ROLLUP (model, operation)""")
def cost_rollup(read):
    m = F.col("event_id") % 3
    u = read("events").select(F.when(m == 0, "gpt-4o-mini").when(m == 1, "gpt-4o").otherwise("llama3").alias("model"), F.col("event_type").alias("operation"), F.floor(F.abs("value") * 10).cast("long").alias("prompt_tokens"), F.floor(F.abs("value")).cast("long").alias("completion_tokens"))
    return stores.cost_rollup(stores.priced(u))


@query("""SELECT user_id AS trace_id, count(*) AS n_spans, round(max(value + 1) - min(value), 6) AS total_ms, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id""")
def trace_totals(read):
    e = read("events").select(F.col("user_id").alias("trace_id"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return stores.traces(e)


# ---- streaming forms, over batches ----


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(read):
    return incremental.windowed(read("events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(read):
    return incremental.sessions(read("events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
