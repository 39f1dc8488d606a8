"""Queries over model replies, routes, rounds of retrieval, trials, feedback, simulation and the guarded pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents, control, guardrails, metrics, replies, retrieval
from .base import SQL, query, words_sql
from .catalog import DENSE, INJECTED, KIND, TURNS, _redact_sql, _turns, _vector_queries, _vectors

# Replies of several shapes: JSON in a text, odd values, words alone, broken JSON, and plain conversation.
_REPLIES = [
    """Here: {"grade": "correct", "confidence": 0.9, "reasoning": "fine", "route": "multi_step", "sub_questions": ["first part", "b", "c", "d", "e"], "score": 4.5, "supported": true, "supporting_source": "page", "complexity": "Analytical", "decision": "no_retrieve", "relevance": "relevant", "support": "fully_supported", "usefulness": 9}""",
    """{"grade": " AMBIGUOUS ", "confidence": 1.7, "route": "SUMMARIZE", "score": 11, "supported": false, "complexity": "unknown kind", "decision": "continue", "relevance": "irrelevant", "support": "partially_supported", "usefulness": 2}""",
    "This looks correct and relevant, fully supported; compare it. 4 of 5.",
    """{"grade": broken, "score": }""",
    """{"confidence": "high", "score": "none", "usefulness": "many", "route": "direct"} not supported, ambiguous, why""",
]
_CASES = " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_REPLIES))
REPLIES_SQL = f"rp AS (SELECT conv_id * 1000 + turn AS id, text, CASE turn % 6 {_CASES} ELSE text END AS reply FROM conversations)"


def _json_sql(pattern: str, reply: str = "reply") -> str:
    return f"js AS (SELECT id, text, reply, lower(reply) AS low, CASE WHEN json_valid(o) THEN o END AS o FROM (SELECT *, regexp_extract({reply}, '{pattern}') AS o FROM rp))"


def _get(name: str) -> str:
    return f"json_extract_string(o, '$.{name}')"


def _num(name: str, default: float) -> str:
    return f"CASE WHEN o IS NULL THEN NULL WHEN {_get(name)} IS NULL THEN CAST({default} AS DOUBLE) ELSE TRY_CAST({_get(name)} AS DOUBLE) END"


def _replies(read):
    c = read("conversations")
    reply = F.col("text")
    for k, r in enumerate(_REPLIES):
        reply = F.when(F.col("turn") % 6 == k, F.lit(r)).otherwise(reply)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", reply.alias("reply"))


@query(f"""WITH {REPLIES_SQL}, {_json_sql(replies.FLAT)}, p AS (SELECT *, {_num('confidence', 0.5)} AS c, trim(lower(coalesce({_get('grade')}, 'incorrect'))) AS n FROM js),
w AS (SELECT *, CASE WHEN contains(low, 'correct') AND NOT contains(low, 'incorrect') THEN 'correct' WHEN contains(low, 'ambiguous') THEN 'ambiguous' ELSE 'incorrect' END AS bw FROM p)
SELECT id, CASE WHEN c IS NOT NULL THEN CASE WHEN n IN ('correct', 'ambiguous') THEN n ELSE 'incorrect' END ELSE bw END AS grade,
CASE WHEN c IS NOT NULL THEN greatest(0.0, least(1.0, c)) ELSE CASE bw WHEN 'correct' THEN CAST(0.7 AS DOUBLE) WHEN 'ambiguous' THEN 0.5 ELSE 0.3 END END AS confidence FROM w""")
def parsed_grades(read):
    return _replies(read).select("id", replies.grade(F.col("reply")).alias("g")).select("id", "g.grade", "g.confidence")


@query(f"""WITH {REPLIES_SQL}, {_json_sql(replies.FLAT, 'lower(reply)')}, p AS (SELECT *, trim(lower(coalesce({_get('complexity')}, ''))) AS n FROM js)
SELECT id, CASE WHEN n IN ('factual', 'analytical', 'comparative', 'exploratory', 'conversational') THEN n WHEN contains(low, 'compar') THEN 'comparative' WHEN contains(low, 'explor') OR contains(low, 'overview') OR contains(low, 'summar') THEN 'exploratory'
WHEN contains(low, 'analy') OR contains(low, 'why') OR contains(low, 'how') THEN 'analytical' WHEN contains(low, 'conversat') OR contains(low, 'follow') THEN 'conversational' ELSE 'factual' END AS kind FROM p""")
def parsed_complexity(read):
    return _replies(read).select("id", replies.complexity(F.col("reply")).alias("kind"))


@query(f"""WITH {REPLIES_SQL}, {_json_sql(replies.INNER)}, p AS (SELECT *, {_num('score', 0)} AS c FROM js) SELECT id, CASE WHEN c IS NULL THEN 0.0 ELSE greatest(0.0, least(5.0, c)) END AS score, CASE WHEN c IS NULL THEN 'Failed to parse judgment' ELSE coalesce({_get('reasoning')}, '') END AS reasoning FROM p""")
def parsed_judgments(read):
    return _replies(read).select("id", replies.judgment(F.col("reply")).alias("g")).select("id", "g.score", "g.reasoning")


@query(f"""WITH {REPLIES_SQL}, {_json_sql(replies.INNER)}, p AS (SELECT id // 1000 AS conv_id, id % 1000 AS turn, CASE WHEN {_num('score', 0)} IS NULL THEN 0.0 ELSE greatest(0.0, least(5.0, {_num('score', 0)})) END AS s FROM js),
d AS (SELECT conv_id, coalesce(max(s) FILTER (turn % 3 = 0), 0.0) AS faithfulness, coalesce(max(s) FILTER (turn % 3 = 1), 0.0) AS relevance, coalesce(max(s) FILTER (turn % 3 = 2), 0.0) AS completeness FROM p GROUP BY conv_id)
SELECT *, round(CAST(0.4 AS DOUBLE) * faithfulness + CAST(0.35 AS DOUBLE) * relevance + CAST(0.25 AS DOUBLE) * completeness, 2) AS overall FROM d""")
def judged_answers(read):
    """Three judgments a conversation, each the best of a third of its turns."""
    r = _replies(read).select(F.floor(F.col("id") / 1000).cast("long").alias("conv_id"), (F.col("id") % 1000).alias("turn"), replies.judgment(F.col("reply"))["score"].alias("s"))
    best = lambda k: F.coalesce(F.max(F.when(F.col("turn") % 3 == k, F.col("s"))), F.lit(0.0))
    d = r.groupBy("conv_id").agg(best(0).alias("faithfulness"), best(1).alias("relevance"), best(2).alias("completeness"))
    return d.withColumn("overall", replies.overall(F.col("faithfulness"), F.col("relevance"), F.col("completeness")))


@query(f"""WITH {REPLIES_SQL}, {_json_sql(replies.FLAT)}, p AS (SELECT *, {_num('confidence', 0.5)} AS c, contains(low, 'supported') AND NOT contains(low, 'not supported') AND NOT contains(low, 'unsupported') AS bw FROM js)
SELECT id, CASE WHEN c IS NOT NULL THEN coalesce({_get('supported')}, 'false') NOT IN ('false', '', '0', 'null') ELSE bw END AS supported, CASE WHEN c IS NOT NULL THEN greatest(0.0, least(1.0, c)) WHEN bw THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence,
CASE WHEN c IS NOT NULL THEN coalesce({_get('supporting_source')}, '') ELSE '' END AS source FROM p""")
def parsed_verifications(read):
    return _replies(read).select("id", replies.verification(F.col("reply")).alias("g")).select("id", "g.*")


@query(f"""WITH {REPLIES_SQL}, {_json_sql(replies.FLAT)}, p AS (SELECT *, trim(lower(coalesce({_get('decision')}, 'retrieve'))) AS d, trim(lower(coalesce({_get('relevance')}, 'irrelevant'))) AS r, trim(lower(coalesce({_get('support')}, 'not_supported'))) AS s, floor({_num('usefulness', 3)}) AS u, regexp_extract(reply, '[1-5]') AS digit FROM js)
SELECT id, CASE WHEN o IS NOT NULL THEN CASE WHEN d IN ('no_retrieve', 'continue') THEN d ELSE 'retrieve' END WHEN contains(low, 'no_retrieve') OR contains(low, 'no retrieve') THEN 'no_retrieve' WHEN contains(low, 'continue') THEN 'continue' ELSE 'retrieve' END AS decision,
CASE WHEN o IS NOT NULL THEN r = 'relevant' ELSE contains(low, 'relevant') AND NOT contains(low, 'irrelevant') END AS relevant,
CASE WHEN o IS NOT NULL THEN CASE s WHEN 'fully_supported' THEN 'full' WHEN 'partially_supported' THEN 'partial' ELSE 'none' END WHEN contains(low, 'fully') THEN 'full' WHEN contains(low, 'partial') THEN 'partial' ELSE 'none' END AS support,
CAST(CASE WHEN u IS NOT NULL THEN greatest(1, least(5, u)) WHEN digit <> '' THEN CAST(digit AS INT) ELSE 3 END AS INT) AS usefulness FROM p""")
def parsed_reflections(read):
    r = F.col("reply")
    return _replies(read).select("id", replies.decision(r).alias("decision"), replies.relevance(r).alias("relevant"), replies.support(r).alias("support"), replies.usefulness(r).alias("usefulness"))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN 'Claims: ["the first claim", " ", "claim of ' || conv_id || '"]' WHEN turn % 3 = 1 THEN '- a claim that is long' || chr(10) || 'short' || chr(10) || '* another claim of ' || conv_id ELSE 'tiny' END AS reply FROM conversations),
p AS (SELECT id, reply, regexp_extract(reply, '(?s)\\[.*\\]') AS o FROM c),
s AS (SELECT id, CASE WHEN json_valid(o) THEN list_filter(list_transform(json_extract_string(o, '$[*]'), lambda x: trim(x)), lambda x: x <> '') ELSE NULL END AS l, list_filter(list_transform(string_split(reply, chr(10)), lambda x: regexp_replace(trim(x), '^[-•* ]+', '')), lambda x: length(x) > 10) AS m, reply FROM p)
SELECT id, array_to_string(CASE WHEN l IS NOT NULL THEN l WHEN len(m) > 0 THEN m ELSE [reply] END, '|') AS claims FROM s""")
def parsed_claims(read):
    c, t, n = read("conversations"), F.col("turn") % 3, F.col("conv_id").cast("string")
    reply = F.when(t == 0, F.concat(F.lit('Claims: ["the first claim", " ", "claim of '), n, F.lit('"]'))).when(t == 1, F.concat(F.lit("- a claim that is long\nshort\n* another claim of "), n)).otherwise("tiny")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(replies.claims(reply), "|").alias("claims"))


@query("""WITH d AS (SELECT n_nationkey AS id, 'Found: [{"subject": "' || n_name || '", "predicate": "part_of", "object": "' || r_name || '"}, {"subject": "", "object": "x"}, {"subject": "y"}]' AS reply FROM nation JOIN region ON r_regionkey = n_regionkey),
j AS (SELECT id, unnest(from_json(regexp_extract(reply, '(?s)\\[.*\\]'), '[{"subject": "VARCHAR", "predicate": "VARCHAR", "object": "VARCHAR"}]')) AS t FROM d)
SELECT id, t.subject AS subject, t.predicate AS predicate, t.object AS object FROM j WHERE coalesce(t.subject, '') <> '' AND coalesce(t.object, '') <> ''""")
def reply_triples(read):
    n = read("nation").join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    reply = F.concat(F.lit('Found: [{"subject": "'), "n_name", F.lit('", "predicate": "part_of", "object": "'), "r_name", F.lit('"}, {"subject": "", "object": "x"}, {"subject": "y"}]'))
    return n.select(F.col("n_nationkey").alias("id"), F.explode(replies.triples(reply)).alias("t")).select("id", "t.*")


@query("""WITH d AS (SELECT n_nationkey AS id, 'So {"entities": [{"name": "' || n_name || '", "type": "location"}, {"name": "' || r_name || '", "type": "continent"}, {"type": "PERSON"}]}' AS reply FROM nation JOIN region ON r_regionkey = n_regionkey),
j AS (SELECT id, unnest(from_json(json_extract(regexp_extract(reply, '(?s)\\{.*\\}'), '$.entities'), '[{"name": "VARCHAR", "type": "VARCHAR"}]')) AS t FROM d)
SELECT id, t.name AS name, CASE WHEN upper(coalesce(t.type, '')) IN ('PERSON', 'ORGANIZATION', 'LOCATION', 'CONCEPT', 'EVENT', 'TECHNOLOGY', 'PRODUCT') THEN upper(t.type) ELSE 'CONCEPT' END AS kind FROM j WHERE coalesce(t.name, '') <> ''""")
def reply_entities(read):
    n = read("nation").join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    reply = F.concat(F.lit('So {"entities": [{"name": "'), "n_name", F.lit('", "type": "location"}, {"name": "'), "r_name", F.lit('", "type": "continent"}, {"type": "PERSON"}]}'))
    return n.select(F.col("n_nationkey").alias("id"), F.explode(replies.entities(reply)).alias("t")).select("id", "t.*")


# ---- routes and rounds ----


@query(f"""WITH {REPLIES_SQL}, {_json_sql(replies.INNER)}, p AS (SELECT id, text, trim(lower(coalesce({_get('route')}, 'single'))) AS n, list_transform(coalesce(json_extract_string(o, '$.sub_questions[*]'), []), lambda x: x)[1:4] AS subs FROM js),
r AS (SELECT id, text, CASE WHEN n IN ('direct', 'single', 'multi_step', 'summarize') THEN n ELSE 'single' END AS route, subs FROM p),
u AS (SELECT id, route, CASE WHEN route = 'multi_step' AND len(subs) > 0 THEN subs WHEN route = 'direct' THEN [] ELSE [text] END AS qs FROM r)
SELECT qid, route, CAST(CASE route WHEN 'summarize' THEN 15 ELSE 5 END AS INT) AS top_k, CAST(step AS INT) AS step, sub_question FROM (SELECT id AS qid, route, unnest(range(len(qs))) AS step, unnest(qs) AS sub_question FROM u)""")
def question_routes(read):
    return control.routed(_replies(read).withColumnRenamed("id", "qid"))


@query("""WITH v AS (SELECT q.vec_id - q.vec_id % 3 AS qid, q.vec_id % 3 AS step, q.embedding FROM embeddings q WHERE q.vec_id % 50 < 3),
s AS (SELECT qid, step, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM v, embeddings e),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, step ORDER BY score DESC, doc_id) AS r FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY step, score DESC) AS n FROM t WHERE r <= 5),
m AS (SELECT qid, step, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM u WHERE n = 1) SELECT qid, CAST(step AS INT) AS step, doc_id, score, CAST(rank AS INT) AS rank FROM m WHERE rank <= 8""")
def multi_step_merge(read):
    """Three vectors that follow one another are the steps of a question."""
    e = read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id % 50 < 3").select(F.col("doc_id").alias("qid"), "embedding")
    found = retrieval.dense(e, q, 5).select((F.col("qid") - F.col("qid") % 3).alias("qid"), (F.col("qid") % 3).cast("int").alias("step"), "doc_id", "score")
    return control.merge_steps(found, 4).select("qid", "step", "doc_id", "score", "rank")


@query(f"""WITH {DENSE.format('q.vec_id % 50 = 0')}, r AS (SELECT * FROM dn WHERE rank <= 5), a AS (SELECT qid, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS max_score FROM r WHERE score < 0.999 GROUP BY qid)
SELECT *, max_score >= 0.3 AND n >= 2 AS good, NOT (max_score >= 0.3 AND n >= 2) AS needs_more FROM a""")
def retrieval_verdicts(read):
    return control.evaluate_retrieval(retrieval.dense(_vectors(read), _vector_queries(read), 5).filter("score < 0.999"))


@query(f"""WITH {DENSE.format('q.vec_id % 50 = 0')}, g AS (SELECT dn.qid, dn.score, CASE WHEN dn.label = q.label THEN 'correct' WHEN score > 0.2 THEN 'ambiguous' ELSE 'incorrect' END AS grade FROM dn JOIN embeddings q ON q.vec_id = dn.qid WHERE rank <= 5),
a AS (SELECT qid, round(count(*) FILTER (grade = 'correct') / count(*), 6) AS c, round(count(*) FILTER (grade <> 'incorrect') / count(*), 6) AS u, avg(score) FILTER (grade <> 'incorrect') AS m FROM g GROUP BY qid)
SELECT qid, CASE WHEN c >= 0.5 THEN 'direct' WHEN u >= 0.5 THEN 'refine' ELSE 'no_answer' END AS action, round(CASE WHEN c >= 0.5 THEN m WHEN u >= 0.5 THEN m * CAST(0.8 AS DOUBLE) ELSE 0 END, 6) AS confidence FROM a""")
def corrective_confidence(read):
    q, v = _vector_queries(read), _vectors(read)
    found = retrieval.dense(v, q, 5).join(q.select("qid", F.col("label").alias("want")), "qid").join(v.select("doc_id", "label"), "doc_id")
    grade = F.when(F.col("label") == F.col("want"), "correct").when(F.col("score") > 0.2, "ambiguous").otherwise("incorrect")
    return control.crag(found.select("qid", "score", grade.alias("grade")))


@query("""WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.qid, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM q, embeddings e),
a AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM p), k AS (SELECT qid, CASE (qid // 50) % 3 WHEN 0 THEN 3 WHEN 1 THEN 8 ELSE 10 END AS k, CASE (qid // 50) % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'multi_pass' ELSE 'hybrid' END AS strategy FROM q),
f AS (SELECT a.qid, doc_id, score, rank, strategy, k FROM a JOIN k USING (qid) WHERE rank <= k), c AS (SELECT qid, least(1.0, least(count(*) / 3, 1.0) * 0.5 + avg(score) * 0.5) AS c FROM f GROUP BY qid)
SELECT f.qid, doc_id, score, CAST(rank AS INT) AS rank, strategy, CAST(1 AS INT) AS tried FROM f JOIN c USING (qid) WHERE c >= 0.3""")
def adaptive_retrieval(read):
    """Questions of three classes; each class has its strategy and number of results, all served by exact cosine here."""
    v, vq = _vectors(read), _vector_queries(read)
    n = F.floor(F.col("qid") / 50) % 3
    text = F.when(n == 0, "who wrote it").when(n == 1, "compare these two").otherwise("give an overview")
    serve = lambda q, k: retrieval.dense(v, q.join(vq, "qid").select("qid", "embedding"), k)
    return control.adaptive_retrieve(vq.select("qid", text.alias("text")), {"hybrid": serve})


@query("SELECT round(avg(hit_rate), 4) AS hit_rate, round(avg(mrr), 4) AS mrr, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg, round(avg(map), 4) AS map, round(avg(context_precision), 4) AS context_precision, count(*) AS n FROM (" + SQL["retrieval_metrics"] + ")")
def evaluation_summary(read):
    q, v = _vector_queries(read), _vectors(read)
    relevant = q.select("qid", "label").join(v.select("doc_id", "label"), "label").select("qid", "doc_id")
    return metrics.summary(metrics.retrieval_metrics(retrieval.dense(v, q, 10), relevant, 5))


# ---- self-reflection and verification ----


@query(rf"""WITH t AS ({TURNS}), c AS (SELECT id, source, unnest(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS claim, generate_subscripts(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM t),
b AS (SELECT id, k, claim, CASE WHEN len(list_distinct({words_sql('claim')})) > 0 THEN len(list_intersect(list_distinct({words_sql('claim')}), {words_sql('source')})) / len(list_distinct({words_sql('claim')})) ELSE 0 END AS best FROM c WHERE length(regexp_replace(claim, '^\s+|\s+$', '', 'g')) > 10)
SELECT id, coalesce(string_agg(claim, ' ' ORDER BY k) FILTER (best >= 0.5), '') AS grounded, count(*) FILTER (best < 0.5) AS n_unsupported FROM b GROUP BY id""")
def grounded_answers(read):
    t = _turns(read)
    return control.grounded(t.select("id", "answer"), t.select("id", "source"))


# ---- trials, feedback, simulation ----

FEEDBACK_SQL = "f AS (SELECT event_type || ':' || user_id % 4 AS params, event_id AS seq, value AS score FROM events)"


def _feedback(read):
    return read("events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 4).cast("string")).alias("params"), F.col("event_id").alias("seq"), F.col("value").alias("score"))


@query(f"WITH {FEEDBACK_SQL} SELECT params, count(*) AS n, round(avg(score), 6) AS mean FROM f GROUP BY params")
def feedback_by_params(read):
    return control.feedback_by_params(_feedback(read))


@query(f"""WITH {FEEDBACK_SQL}, b AS (SELECT params, avg(score) AS m, min(seq) AS first FROM f GROUP BY params), t AS (SELECT arg_max(params, struct_pack(m := m, k := -first)) AS best_params, max(m) AS m FROM b)
SELECT best_params, round(m, 6) AS best_mean, (SELECT count(*) FROM f) AS n, (SELECT round(avg(score), 6) FROM f) AS mean, round((m - 5) / 5 * 100, 6) AS improvement_pct FROM t""")
def feedback_improvement(read):
    return control.improvement(_feedback(read), 5.0)


@query(f"""WITH {DENSE.format('q.vec_id % 50 = 0')}, f AS (SELECT qid, count(*) AS n, max(score) AS top FROM dn WHERE rank <= 5 AND score > 0.25 AND qid % 100 = 0 GROUP BY qid),
s AS (SELECT vec_id AS qid, CASE (vec_id // 50) % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'noise' ELSE 'long' END AS scenario, CAST(vec_id % 7 AS DOUBLE) AS latency FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(top, 0) AS top, latency <= 4 AND coalesce(n, 0) >= 0 AS passed FROM s LEFT JOIN f USING (qid))
SELECT count(*) AS total, count(*) FILTER (passed) AS n_passed, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(coalesce(avg(latency) FILTER (latency > 0), 0), 6) AS mean_latency_ms, round(coalesce(avg(top) FILTER (top > 0), 0), 6) AS mean_top_score, round(avg(n), 6) AS mean_n_retrieved, string_agg(DISTINCT scenario, ',' ORDER BY scenario) AS scenarios FROM r""")
def simulation_summary(read):
    """Every second query finds nothing."""
    vq, v = _vector_queries(read), _vectors(read)
    n = F.floor(F.col("qid") / 50) % 3
    asked = vq.select("qid", F.when(n == 0, "empty").when(n == 1, "noise").otherwise("long").alias("scenario"), F.lit("?").alias("text"), (F.col("qid") % 7).cast("double").alias("latency_ms"))
    serve = lambda q: retrieval.dense(v, q.filter("qid % 100 = 0").join(vq, "qid").select("qid", "embedding"), 5).filter("score > 0.25")
    return control.simulation_summary(control.simulate(asked, serve, max_latency_ms=4, least_results=0))


# ---- the guarded pipeline ----

RISK = f"round(least(1.0, CAST({INJECTED} AS DOUBLE)), 6)"
GUARDED_SQL = rf"""uq AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user'), nx AS (SELECT conv_id * 1000 + turn - 1 AS qid, text AS source FROM conversations WHERE role = 'assistant'),
q AS (SELECT uq.qid, text, coalesce(source, '') AS source, {RISK} AS risk, {_redact_sql()} AS clean FROM uq LEFT JOIN nx USING (qid)),
k AS (SELECT *, lower(regexp_replace(clean, '^\s+|\s+$', '', 'g')) AS q FROM q), kinds AS (SELECT *, {KIND} AS kind FROM k),
ca AS (SELECT DISTINCT md5(lower(clean)) AS key FROM q WHERE qid % 5 = 0),
an AS (SELECT qid, risk, kind, source, ca.key IS NOT NULL AS cached, substr(source, 1, 80) AS text FROM kinds LEFT JOIN ca ON ca.key = md5(lower(clean))),
cl AS (SELECT qid, risk, kind, source, cached, {_redact_sql()} AS answer FROM an)"""


def _guarded(read):
    c = read("conversations")
    key = lambda t: (F.col("conv_id") * 1000 + t).alias("qid")
    q = c.filter("role = 'user'").select(key(F.col("turn")), "text").join(c.filter("role = 'assistant'").select(key(F.col("turn") - 1), F.col("text").alias("source")), "qid", "left")
    q = q.withColumn("source", F.coalesce("source", F.lit("")))
    cache = q.filter("qid % 5 = 0").select(F.md5(F.lower(guardrails.redact(F.col("text")))).alias("key"), F.lit("from the cache").alias("answer")).distinct()
    answer = lambda df: df.select("qid", F.substring("source", 1, 80).alias("answer"))
    return control.guarded(q, cache, guardrails.injection_score, guardrails.redact, answer)


@query(f"""WITH {GUARDED_SQL} SELECT qid, CASE WHEN risk >= 0.5 THEN 'blocked' ELSE 'answered' END AS status, CASE WHEN risk >= 0.5 THEN 'blocked' ELSE kind END AS route, CASE WHEN risk >= 0.5 THEN NULL WHEN cached THEN 'from the cache' ELSE answer END AS answer, risk < 0.5 AND cached AS cached, risk,
CASE WHEN risk >= 0.5 THEN 0.0 WHEN cached THEN 1.0 ELSE round(CASE WHEN len(list_distinct({words_sql('answer')})) > 0 THEN len(list_intersect(list_distinct({words_sql('answer')}), {words_sql('source')})) / len(list_distinct({words_sql('answer')})) ELSE 0 END, 6) END AS confidence FROM cl""")
def guarded_answers(read):
    return _guarded(read)


@query("WITH r AS (" + SQL["guarded_answers"] + ") SELECT count(*) AS total, count(*) FILTER (status = 'blocked') AS n_blocked, count(*) FILTER (cached) AS n_cached, round(avg(CAST(cached AS INT)), 6) AS hit_rate, round(avg(confidence) FILTER (status = 'answered'), 6) AS mean_confidence FROM r")
def guarded_statistics(read):
    return control.guarded_statistics(_guarded(read))


@query("SELECT event_type, round(sum(value), 4) AS total FROM events WHERE value > 2 AND event_type <> 'error' GROUP BY event_type HAVING count(*) > 1")
def dag_run(read):
    """A graph of five steps, of which one is skipped and one branch fails."""
    dag = control.Dag()
    dag.add("load", lambda df: df.select("event_type", "value")).add("filter", lambda df: df.filter("value > 2"))
    dag.add("never", lambda df: df.limit(0), condition=lambda df: False).add("broken", lambda df: df.select("nothing_of_that_name"))
    dag.add("total", lambda df: df.filter("event_type <> 'error'").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    dag.connect("load", "filter").connect("filter", "never").connect("never", "total").connect("load", "broken")
    return dag.run(read("events"))["total"]


@query(rf"""WITH p AS (SELECT conv_id * 1000 + turn AS id, text AS question, text AS passage, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
s AS (SELECT id, NOT ({' OR '.join(f"contains(lower(question), '{c}')" for c in agents.OPINION)}) AS retrieve, len(list_intersect(list_distinct({words_sql('question')}), {words_sql('passage')})) / greatest(1, len(list_distinct({words_sql('question')}))) > 0.2 AS relevant,
CASE WHEN len(list_distinct({words_sql('answer')})) > 0 THEN len(list_intersect(list_distinct({words_sql('answer')}), {words_sql('passage')})) / len(list_distinct({words_sql('answer')})) ELSE 0 END AS sup, length(answer) AS n FROM p WHERE answer IS NOT NULL),
l AS (SELECT id, retrieve, relevant, CASE WHEN sup > 0.5 THEN 'full' WHEN sup > 0.25 THEN 'partial' ELSE 'none' END AS support, CAST(CASE WHEN n > 200 THEN 4 WHEN n > 50 THEN 3 ELSE 2 END AS INT) AS usefulness FROM s)
SELECT *, round(least(1.0, CAST(CASE support WHEN 'full' THEN 0.4 WHEN 'partial' THEN 0.2 ELSE 0 END AS DOUBLE) + (usefulness - 1) / 4 * CAST(0.4 AS DOUBLE) + CASE WHEN relevant THEN CAST(1 AS DOUBLE) / 3 * CAST(0.2 AS DOUBLE) ELSE 0 END), 6) AS confidence FROM l""")
def self_reflection(read):
    """Each turn is the question and the passage, the next one the answer."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.col("text").alias("passage"), after.alias("answer"))
    return agents.reflect(c.filter("answer is not null"))
