"""Queries over the persisted index, the chat store, caches, spans and usage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import chunking, stores
from ..operators.index import Index, Pipeline
from ..sources import loaders
from .base import SQL, query
from .catalog import BM25, USAGE, _items

# ---- the index ----

CHUNKS_SQL = r"""ck AS (SELECT doc_id * 1048576 + i AS id, array_to_string(t[s + 1:s + 256], ' ') AS text FROM (SELECT doc_id, t, unnest(list_filter(range(0, n, 224), lambda s: s = 0 OR s + 32 < n)) AS s, generate_subscripts(list_filter(range(0, n, 224), lambda s: s = 0 OR s + 32 < n), 1) - 1 AS i
FROM (SELECT conv_id * 1000 + turn AS doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations WHERE role <> 'system')))"""
INDEXED = BM25.replace("SELECT doc_id, regexp_extract_all", "SELECT id AS doc_id, regexp_extract_all").replace("FROM documents)", "FROM ck)")


def _pipeline(read):
    c = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", "role")
    index = Index(c.sparkSession, f"{shared_folder(c.sparkSession)}/index-{uuid.uuid4().hex}")
    pipeline = Pipeline(index, lambda docs: chunking.token_chunks(docs, size=256, overlap=32))
    pipeline.ingest(c.select("doc_id", "text"))
    index.delete(c.filter("role = 'system'"))
    return pipeline


@query(f"WITH {CHUNKS_SQL}, {INDEXED} SELECT qid, doc_id AS chunk_id, score, CAST(rank AS INT) AS rank, md5(text) AS text_md5 FROM bm JOIN ck ON ck.id = bm.doc_id WHERE rank <= 5")
def pipeline_retrieve(read):
    """Conversation turns are ingested, those of the system deleted again, and the index asked for each item."""
    return _pipeline(read).retrieve(_items(read)).select("qid", "chunk_id", "score", "rank", F.md5("text").alias("text_md5"))


@query(f"""WITH {CHUNKS_SQL}, {INDEXED}, r AS (SELECT qid, string_agg('[' || rank || '] (score: ' || CAST(CAST(score AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM bm JOIN ck ON ck.id = bm.doc_id WHERE rank <= 3 GROUP BY qid)
SELECT item_id AS qid, CASE WHEN n IS NULL THEN 'No relevant context was found for this question.' ELSE substr('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text, 1, 120) END AS answer, coalesce(n, 0) AS n_sources FROM benchmark LEFT JOIN r ON r.qid = item_id""")
def pipeline_query(read):
    """The answer is the beginning of the prompt."""
    return _pipeline(read).query(_items(read), lambda p: p.select("qid", F.substring("prompt", 1, 120).alias("answer")), 3)


# ---- chat store ----


def _chats(read):
    m = read("conversations")
    return m.groupBy("conv_id").agg(F.max("turn").alias("updated_at")).select("conv_id", F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"), "updated_at"), m


CHATS_SQL = """c0 AS (SELECT conv_id, 'Chat ' || conv_id AS title, max(turn) AS updated_at FROM conversations GROUP BY conv_id),
c1 AS (SELECT * FROM c0 UNION ALL SELECT max(conv_id) + 1, 'New chat', 0 FROM c0), c2 AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'Renamed ' || conv_id ELSE title END AS title, updated_at FROM c1),
m1 AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, 1000, 'user', 'one more' FROM c2 WHERE conv_id % 5 = 0),
c3 AS (SELECT conv_id, title, CASE WHEN conv_id % 5 = 0 THEN 1000 ELSE updated_at END AS updated_at FROM c2 WHERE conv_id % 11 <> 1), m2 AS (SELECT * FROM m1 WHERE conv_id % 11 <> 1)"""


def _edited(read):
    chats, m = _chats(read)
    new = chats.agg((F.max("conv_id") + 1).alias("conv_id")).select("conv_id", F.lit(None).cast("string").alias("title"), F.lit(0).cast("long").alias("updated_at"))
    chats = stores.create_conversations(chats, new)
    chats = stores.rename_conversations(chats, chats.filter("conv_id % 7 = 0").select("conv_id", F.concat(F.lit("Renamed "), F.col("conv_id").cast("string")).alias("title")))
    more = chats.filter("conv_id % 5 = 0").select("conv_id", F.lit(1000).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("one more").alias("text"))
    chats, m = stores.add_messages(chats, m, more)
    return stores.delete_conversation(chats, m, chats.filter("conv_id % 11 = 1"))


@query(f"WITH {CHATS_SQL}, n AS (SELECT conv_id, count(*) AS n FROM m2 GROUP BY conv_id) SELECT conv_id, title, updated_at, coalesce(n, 0) AS n_messages FROM c3 LEFT JOIN n USING (conv_id) ORDER BY updated_at DESC, conv_id LIMIT 100")
def chat_store(read):
    """One conversation is made, some are renamed, added to and deleted; then they are listed."""
    return stores.conversation_list(*_edited(read), 100)


@query(f"WITH {CHATS_SQL}, a AS (SELECT conv_id, string_agg(turn || ' ' || role || ' ' || text, chr(10) ORDER BY turn) AS t FROM m2 GROUP BY conv_id) SELECT conv_id, title, md5(coalesce(t, '')) AS messages_md5 FROM c3 LEFT JOIN a USING (conv_id) WHERE conv_id % 3 = 0")
def chat_messages(read):
    chats, m = _edited(read)
    out = stores.get_conversations(chats, m, chats.filter("conv_id % 3 = 0"))
    line = F.array_join(F.transform("messages", lambda x: F.concat_ws(" ", x["turn"].cast("string"), x["role"], x["text"])), "\n")
    return out.select("conv_id", "title", F.md5(F.coalesce(line, F.lit(""))).alias("messages_md5"))


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id")
def conversation_counts(read):
    return stores.message_counts(read("conversations"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(read):
    return read("documents").select("doc_id", loaders.uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


# ---- caches ----


@query("SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(CAST(hit AS INT)), 6) AS hit_rate FROM (SELECT e.vec_id % 50 = 0 AND EXISTS (SELECT 1 FROM (" + SQL["semantic_cache"] + ") s WHERE s.qid = e.vec_id) AS hit FROM embeddings e WHERE e.vec_id % 50 = 0)")
def cache_statistics(read):
    q = read("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    cache = read("embeddings").filter("vec_id % 50 <> 0").select(F.col("vec_id").alias("entry_id"), "embedding", F.expr("timestamp'2024-01-01 00:00:00'").alias("ts"))
    return stores.lookup_statistics(q, stores.semantic_lookup(q, cache, F.expr("timestamp'2024-01-01 00:30:00'"), 0.3))


@query("""WITH t AS (SELECT md5(text) AS key, text FROM conversations), c AS (SELECT DISTINCT md5(text) AS key, length(text) AS n FROM conversations WHERE turn % 2 = 0)
SELECT DISTINCT t.key, CASE WHEN c.key IS NULL THEN -length(text) ELSE n END AS first FROM t LEFT JOIN c USING (key)""")
def embedding_cache(read):
    """Texts of even turns are cached; the others get what an embedder of one number would give."""
    m = read("conversations")
    cached = m.filter("turn % 2 = 0").select(F.md5("text").alias("key"), F.array(F.length("text")).alias("vector")).distinct()
    out = stores.cached_embed(m.select("text"), cached, lambda df: df.select("key", F.array(-F.length("text")).alias("vector")))
    return out.select("key", F.col("vector")[0].cast("long").alias("first"))


# ---- spans and usage ----


@query("SELECT p.event_id AS span_id, count(*) AS n_children, round(sum(c.value), 6) AS children_ms FROM events p JOIN events c ON c.event_id // 10 = p.event_id GROUP BY p.event_id")
def span_children(read):
    e = read("events")
    spans = e.select(F.col("event_id").alias("span_id"), F.floor(F.col("event_id") / 10).cast("long").alias("parent_id"), F.lit(0.0).alias("start"), F.col("value").alias("end"))
    return stores.span_children(spans)


@query(f"WITH {USAGE}, t AS (SELECT round(sum(cost_usd), 6) AS total_usd FROM c) SELECT total_usd, round(greatest(0.0, CAST(0.05 AS DOUBLE) - total_usd), 6) AS remaining_usd, total_usd >= CAST(0.05 AS DOUBLE) AS spent FROM t")
def budget_left(read):
    m = F.col("event_id") % 3
    u = read("events").select(F.when(m == 0, "gpt-4o-mini").when(m == 1, "gpt-4o").otherwise("llama3").alias("model"), F.floor(F.abs("value") * 10).cast("long").alias("prompt_tokens"), F.floor(F.abs("value")).cast("long").alias("completion_tokens"))
    return stores.budget_left(stores.priced(u), 0.05)
