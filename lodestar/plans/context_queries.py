"""Queries over context windows made of conversation turns, and over answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, context, guardrails, metrics, retrieval
from .base import query, words_sql
from .catalog import TURNS, _context, _turns, ITEMS  # the ten BM25 results of each item

#: A conversation is a window, its turns the items; the score is made up from the ids.
TURN_ITEMS = """items AS (SELECT conv_id AS qid, CAST(turn AS INT) AS seq, text, CAST((conv_id * 7 + turn * 13) % 10 AS DOUBLE) / 10 AS score, role AS source, conv_id || ':' || turn AS chunk_id,
CAST(greatest(1, length(text) // 4) AS INT) AS token_count, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((conv_id * 5 + turn * 3) % 17 AS INT)) AS ts FROM conversations)"""


def _items(read):
    c = read("conversations")
    hours = ((F.col("conv_id") * 5 + F.col("turn") * 3) % 17).cast("int")
    return c.select(
        F.col("conv_id").alias("qid"), F.col("turn").cast("int").alias("seq"), "text", (((F.col("conv_id") * 7 + F.col("turn") * 13) % 10).cast("double") / 10).alias("score"), F.col("role").alias("source"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), X.token_estimate("text").alias("token_count"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("t0"), hours.alias("h"),
    ).withColumn("ts", F.expr("t0 + make_dt_interval(0, h)")).drop("t0", "h")


@query(f"WITH {TURN_ITEMS} SELECT qid, seq, score FROM items WHERE score >= 0.5")
def context_filter_score(read):
    return context.filter_by_score(_items(read), 0.5).select("qid", "seq", "score")


@query(f"WITH {TURN_ITEMS} SELECT qid, seq, source FROM items WHERE source IN ('user', 'system')")
def context_filter_source(read):
    return context.filter_by_source(_items(read), ["user", "system"]).select("qid", "seq", "source")


@query(f"WITH {TURN_ITEMS} SELECT qid, seq FROM items WHERE token_count < 60 AND seq % 2 = 1")
def context_filter(read):
    return context.keep(_items(read), lambda d: (d["token_count"] < 60) & (d["seq"] % 2 == 1)).select("qid", "seq")


@query(f"WITH {TURN_ITEMS} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY seq) AS INT) AS number, source, chunk_id, substr(text, 1, 200) AS excerpt, round(score, 3) AS score FROM items")
def context_citations(read):
    return context.citations(_items(read))


@query(f"WITH {TURN_ITEMS} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY seq) AS INT) AS number, source, chunk_id, substr(text, 1, 500) AS excerpt, round(score, 4) AS score FROM items")
def answer_sources(read):
    return context.citations(_items(read), 500, 4)


@query(f"""WITH {TURN_ITEMS}, u AS (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY seq) AS k FROM items), f AS (SELECT * FROM u WHERE k = 1 AND score >= 0.2),
b AS (SELECT *, sum(token_count) OVER (PARTITION BY qid ORDER BY seq) AS used FROM f) SELECT qid, seq, CAST(used AS BIGINT) AS used FROM b WHERE used <= 300""")
def context_pipe(read):
    out = context.pipe(_items(read), context.dedup_exact, lambda d: context.filter_by_score(d, 0.2), lambda d: context.budget(d, 300))
    return out.select("qid", "seq", "used")


@query(f"""WITH {TURN_ITEMS}, n AS (SELECT *, count(*) OVER (PARTITION BY qid, source) AS n, row_number() OVER (PARTITION BY qid, source ORDER BY length(text) DESC, seq) AS k FROM items)
SELECT qid, seq, length(text) AS n_chars FROM n WHERE n = 1 OR k = 1""")
def context_resolve_groups(read):
    def longest(group):
        return group.loc[[group["text"].str.len().idxmax()]]

    return context.resolve_groups(_items(read), longest).select("qid", "seq", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {TURN_ITEMS} SELECT qid, seq, CAST(row_number() OVER (PARTITION BY qid ORDER BY ts DESC, seq) AS INT) AS pos FROM items")
def context_recency(read):
    return context.ranked(_items(read), "recency").select("qid", "seq", "pos")


@query(f"WITH {TURN_ITEMS} SELECT qid, count(*) AS n_items, count(DISTINCT source) AS n_sources, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(score), 6) AS mean_score FROM items GROUP BY qid")
def context_summary(read):
    return context.summary(_items(read))


@query(f"""WITH {TURN_ITEMS}, q AS (SELECT item_id AS qid, text FROM benchmark),
r AS (SELECT qid, string_agg('[' || k || '] (score: ' || CAST(CAST(score AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seq) AS k FROM items WHERE score >= 0.7) GROUP BY qid)
SELECT q.qid, md5(CASE WHEN coalesce(context, '') = '' THEN '{context.NO_CONTEXT}' ELSE 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text END) AS prompt_md5 FROM q LEFT JOIN r USING (qid)""")
def generation_prompts(read):
    questions = read("benchmark").select(F.col("item_id").alias("qid"), "text")
    found = context.render(context.filter_by_score(_items(read), 0.7))
    return context.prompt(questions, found).select("qid", F.md5("prompt").alias("prompt_md5"))


def _greedy(step: str) -> str:
    return f"""a AS (SELECT qid, list(struct_pack(seq := seq, score := score, w := list_distinct({words_sql()})) ORDER BY seq) AS xs FROM items GROUP BY qid), {step}"""


JACCARD = "CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


@query(f"""WITH RECURSIVE {ITEMS}, {_greedy("""r AS (SELECT qid, xs, 1 AS i, [xs[1]] AS kept FROM a UNION ALL
SELECT qid, xs, i + 1, CASE WHEN len(list_filter(kept, lambda k: """ + JACCARD.format(a="k.w", b="xs[i + 1].w") + """ > 0.85)) = 0 THEN list_append(kept, xs[i + 1]) ELSE kept END FROM r WHERE i < len(xs))""")}
SELECT qid, unnest(list_transform(kept, lambda k: k.seq)) AS seq FROM r WHERE i = len(xs)""")
def context_dedup_jaccard(read):
    return context.dedup_jaccard(_context(read)).select("qid", "seq")


@query(f"""WITH RECURSIVE {ITEMS}, {_greedy("""r AS (SELECT qid, [xs[1]] AS taken, xs[2:] AS rest FROM a UNION ALL
SELECT qid, list_append(taken, list_filter(rest, lambda y: y.seq = best.seq)[1]), list_filter(rest, lambda y: y.seq <> best.seq) FROM
(SELECT qid, taken, rest, list_min(list_transform(rest, lambda x: struct_pack(v := -(CAST(0.7 AS DOUBLE) * x.score - CAST(0.3 AS DOUBLE) * list_max(list_transform(taken, lambda t: CAST(""" + JACCARD.format(a="t.w", b="x.w") + """ AS DOUBLE)))), seq := x.seq))) AS best FROM r WHERE len(rest) > 0))""")}
SELECT qid, t.seq AS seq, CAST(pos AS INT) AS pos FROM (SELECT qid, unnest(taken) AS t, unnest(range(1, len(taken) + 1)) AS pos FROM r WHERE len(rest) = 0)""")
def context_diversity(read):
    return context.ranked_diverse(_context(read)).select("qid", "seq", "pos")


# ---- answers ----


@query(f"""WITH RECURSIVE t AS ({TURNS}), w AS (SELECT id, {words_sql('answer')} AS a, {words_sql('source')} AS b FROM t),
r AS (SELECT id, a, b, 0 AS i, list_transform(range(len(b)), lambda j: CAST(0 AS BIGINT)) AS row FROM w UNION ALL
SELECT id, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(up[1:j])) FROM
(SELECT id, a, b, i, list_transform(range(1, len(b) + 1), lambda j: greatest(row[j], coalesce(row[j - 1], 0) + CASE WHEN a[i + 1] = b[j] THEN 1 ELSE 0 END)) AS up FROM r WHERE i < len(a))),
l AS (SELECT id, len(a) AS na, len(b) AS nb, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE row[len(b)] END AS n FROM r WHERE i = len(a))
SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE round_even(n / na, 4) END AS precision, CASE WHEN n = 0 THEN 0.0 ELSE round_even(n / nb, 4) END AS recall, CASE WHEN n = 0 THEN 0.0 ELSE round_even(2 * (n / na) * (n / nb) / (n / na + n / nb), 4) END AS f1 FROM l""")
def rouge_l(read):
    return metrics.rouge_l(_turns(read).withColumnRenamed("source", "reference"))


@query("""WITH p AS (SELECT doc_id, CAST(i AS INT) AS parent_index, array_to_string(t[s + 1:s + 512], ' ') AS text FROM (SELECT doc_id, t, unnest(list_filter(range(0, n, 448), lambda s: s = 0 OR s + 64 < n)) AS s, generate_subscripts(list_filter(range(0, n, 448), lambda s: s = 0 OR s + 64 < n), 1) - 1 AS i
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)))
SELECT doc_id, parent_index, md5(text) AS parent_md5 FROM p""")
def parent_texts(read):
    docs = read("documents")
    parents = chunking.parents(docs)
    # every child finds the text of its parent
    found = chunking.with_parent_text(chunking.parent_child_chunks(docs), parents)
    return found.select("doc_id", "parent_index", F.md5("parent_text").alias("parent_md5")).distinct()


# ---- guardrails ----


def _sql(kind: str) -> str:
    return "(?i)" + guardrails.PERSONAL[kind][0].replace("'", "''")


ANY = " OR ".join(f"regexp_matches(text, '{_sql(k)}')" for k in guardrails.PERSONAL)


@query(f"SELECT doc_id, {ANY} AS has_personal FROM documents")
def personal_flags(read):
    return read("documents").select("doc_id", guardrails.contains_personal(F.col("text")).alias("has_personal"))


def _redacted() -> str:
    out = "text"
    for k, (_, mark) in guardrails.PERSONAL.items():
        out = f"regexp_replace({out}, '{_sql(k)}', '{mark}', 'g')"
    return out


@query("SELECT doc_id, md5(text) AS original_md5, md5(" + _redacted() + ") AS redacted_md5, " + " + ".join(f"len(regexp_extract_all(text, '{_sql(k)}'))" for k in guardrails.PERSONAL)
       + " AS n_matches, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{_sql(k)}') THEN '{k}' END" for k in guardrails.PERSONAL) + "], lambda x: x IS NOT NULL)), ',') AS kinds FROM documents")
def redaction_details(read):
    out = guardrails.redact_detailed(read("documents").select("doc_id", "text"))
    return out.select("doc_id", F.md5("original").alias("original_md5"), F.md5("redacted").alias("redacted_md5"), F.col("n_matches").cast("long").alias("n_matches"), F.array_join("kinds", ",").alias("kinds"))


def _places(kind: str) -> str:
    """Spans of one pattern: pieces between matches and the matches themselves, in turn."""
    return f"""SELECT doc_id, '{kind}' AS kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS start, length(m[i]) AS n FROM
(SELECT doc_id, regexp_extract_all(text, '{_sql(kind)}') AS m, regexp_split_to_array(text, '{_sql(kind)}') AS p, unnest(range(1, len(regexp_extract_all(text, '{_sql(kind)}')) + 1)) AS i FROM documents)"""


@query("SELECT doc_id, kind, start, CAST(start + n AS INT) AS \"end\" FROM (" + " UNION ALL ".join(map(_places, guardrails.PERSONAL)) + ")")
def personal_spans(read):
    return guardrails.personal_spans(read("documents"))


@query("SELECT conv_id, turn, " + "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p, _ in guardrails.INJECTION) + "], lambda x: x IS NOT NULL), ',') AS signs FROM conversations")
def injection_signs(read):
    return read("conversations").select("conv_id", "turn", F.array_join(guardrails.injection_signs(F.col("text")), ",").alias("signs"))


# ---- retrieval ----


@query("""WITH v AS (SELECT q.vec_id AS qid, 0 AS variant, q.embedding FROM embeddings q WHERE q.vec_id % 50 = 0 UNION ALL SELECT q.vec_id, 1, e.embedding FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1 WHERE q.vec_id % 50 = 0),
s AS (SELECT qid, variant, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM v, embeddings e),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, doc_id) AS r FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY variant, score DESC) AS seen FROM t WHERE r <= 5),
m AS (SELECT qid, doc_id, score, variant, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM u WHERE seen = 1)
SELECT qid, doc_id, score, CAST(variant AS INT) AS variant, CAST(rank AS INT) AS rank FROM m WHERE rank <= 6""")
def variant_merge(read):
    """Queries and the vectors after them as their variants: each document once, by its first variant."""
    e = read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id % 50 = 0").select((F.col("doc_id") * 2).alias("qid"), "embedding")
    after = e.filter("doc_id % 50 = 1").select(((F.col("doc_id") - 1) * 2 + 1).alias("qid"), "embedding")
    found = retrieval.dense(e, q.unionByName(after), 5)
    found = found.select(F.floor(F.col("qid") / 2).cast("long").alias("qid"), (F.col("qid") % 2).cast("int").alias("variant"), "doc_id", "score")
    return retrieval.merge_variants(found, 6)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS xs, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS words FROM documents),
j AS (SELECT doc_id, words, array_to_string(list_transform(xs, lambda x: CASE WHEN regexp_full_match(x, '[A-Z][a-z]+|\s+') THEN x ELSE chr(1) END), '') AS s FROM t),
n AS (SELECT doc_id, unnest(regexp_extract_all(s, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+')) AS name FROM j UNION ALL SELECT doc_id, unnest(list_filter(words, lambda w: regexp_full_match(w, '(?i)' || '""" + "API|SDK|Python|Java|JavaScript|TypeScript|Rust|Go|Docker|Kubernetes|AWS|Azure|GCP|SQL|NoSQL|GraphQL|REST|HTTP|TCP|GPU|CPU|ML|AI|NLP|LLM" + r"""'))) FROM j)
SELECT doc_id, min(name) AS name FROM n WHERE length(name) >= 2 GROUP BY doc_id, lower(name)""")
def entity_names(read):
    from ..operators import graph

    return graph.entities(read("documents"))
