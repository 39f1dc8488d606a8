"""Queries over a graph of regions, nations, suppliers and customers, and over names of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import graph, knowledge
from .base import query
from .catalog import KEYS_SQL, _key_edges

# Vertices and edges that name and id make up: a nation lies in a region, suppliers and customers in a nation.
GRAPH_SQL = """v AS (SELECT lower(r_name) AS id, r_name AS name, 'REGION' AS kind, 'region of the world' AS description, r_regionkey AS seq FROM region
UNION ALL SELECT lower(n_name), n_name, 'NATION', 'nation of ' || r_name, 100 + n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT lower(s_name), s_name, 'SUPPLIER', 'supplier in ' || n_name, 1000 + s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
e AS (SELECT lower(n_name) AS src, lower(r_name) AS dst, 'part_of' AS rel, 1.0 AS weight FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT lower(s_name), lower(n_name), 'located_in', 1.0 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
m AS (SELECT id, count(*) AS mentions FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
d AS (SELECT src AS id, count(*) AS degree FROM b GROUP BY src),
ask AS (SELECT n_nationkey AS qid, 'What do suppliers of ' || n_name || ' sell in ' || r_name || ' today?' AS text, lower(n_name) AS n, lower(r_name) AS r FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def _vertices(read):
    n = read("nation").join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = read("supplier").join(read("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    row = lambda df, name, kind, text, seq: df.select(F.lower(name).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"), text.alias("description"), seq.cast("long").alias("seq"))
    out = row(read("region"), "r_name", "REGION", F.lit("region of the world"), F.col("r_regionkey"))
    out = out.unionByName(row(n, "n_name", "NATION", F.concat(F.lit("nation of "), "r_name"), F.col("n_nationkey") + 100))
    return out.unionByName(row(s, "s_name", "SUPPLIER", F.concat(F.lit("supplier in "), "n_name"), F.col("s_suppkey") + 1000))


def _edges(read):
    n = read("nation").join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = read("supplier").join(read("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    row = lambda df, a, b, rel: df.select(F.lower(a).alias("src"), F.lower(b).alias("dst"), F.lit(rel).alias("rel"), F.lit(1.0).alias("weight"))
    return row(n, "n_name", "r_name", "part_of").unionByName(row(s, "s_name", "n_name", "located_in"))


def _mentions(read):
    e = _edges(read)
    return e.select(F.explode(F.array("src", "dst")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))


def _questions(read):
    n = read("nation").join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.select(F.col("n_nationkey").cast("long").alias("qid"), F.concat(F.lit("What do suppliers of "), "n_name", F.lit(" sell in "), "r_name", F.lit(" today?")).alias("text"))


@query(f"WITH {GRAPH_SQL} SELECT 'vertex' AS what, kind, count(*) AS n FROM v GROUP BY kind UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel")
def graph_statistics(read):
    return knowledge.statistics(_vertices(read), _edges(read))


@query(f"WITH {GRAPH_SQL} SELECT m.id AS entity, mentions, degree FROM m JOIN d USING (id) ORDER BY mentions DESC, degree DESC, entity LIMIT 60")
def graph_top_entities(read):
    return knowledge.top_entities(_mentions(read), graph.degrees(_edges(read).unionByName(_edges(read).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight"))))


@query(f"""WITH {GRAPH_SQL}, t AS (SELECT m.id FROM m JOIN d USING (id) ORDER BY mentions DESC, degree DESC, m.id LIMIT 20) SELECT src, dst, rel FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t) ORDER BY src, dst, rel LIMIT 200""")
def graph_view(read):
    e = _edges(read)
    top = knowledge.top_entities(_mentions(read), graph.degrees(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight"))), 20)
    return knowledge.subgraph(e, top.select(F.col("entity").alias("id"))).select("src", "dst", "rel").orderBy("src", "dst", "rel").limit(200)


@query(f"WITH {GRAPH_SQL}, a AS (SELECT n AS id FROM ask) SELECT id, dst AS neighbour, rel, 'out' AS direction FROM a JOIN e ON src = id UNION ALL SELECT id, src, rel, 'in' FROM a JOIN e ON dst = id")
def graph_neighbours(read):
    return knowledge.neighbours(_edges(read), read("nation").select(F.lower("n_name").alias("id")))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, h AS (SELECT id AS seed, id AS node, 0 AS hop, [id] AS path FROM v WHERE kind = 'REGION' UNION ALL SELECT h.seed, b.dst, hop + 1, list_append(path, b.dst) FROM h JOIN b ON b.src = h.node WHERE hop < 2 AND NOT list_contains(path, b.dst)),
f AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY hop, path) AS k FROM h WHERE hop > 0) SELECT seed, node, CAST(hop AS INT) AS hop, array_to_string(path, ' > ') AS path FROM f WHERE k = 1""")
def shortest_paths(read):
    seeds = read("region").select(F.lower("r_name").alias("seed"))
    return knowledge.paths(_edges(read), seeds, 2, written).withColumn("path", F.array_join("path", " > "))


REACH = """h AS (SELECT id AS seed, id AS node, 0 AS hop FROM v UNION SELECT h.seed, b.dst, h.hop + 1 FROM h JOIN b ON b.src = h.node WHERE h.hop < 2),
near AS (SELECT seed, node, min(hop) AS hop FROM h GROUP BY seed, node)"""


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACH}, seeds AS (SELECT qid, n AS id FROM ask UNION SELECT qid, r FROM ask), r AS (SELECT seed AS id, count(*) AS related FROM near WHERE hop > 0 GROUP BY seed)
SELECT qid, s.id AS entity, related, mentions, round(0.5 * related + 0.3 * mentions, 6) AS score FROM seeds s JOIN r USING (id) JOIN m USING (id)""")
def graph_search(read):
    v = _vertices(read).join(_mentions(read).withColumnRenamed("entity", "id"), "id")
    return knowledge.graph_search(_questions(read), v, _edges(read), 2, 5, written)


# A name in capitals of two words is no phrase, and its words are no names.
LOCAL = f"""{GRAPH_SQL}, {REACH}, seeds AS (SELECT qid, n AS id FROM ask UNION SELECT qid, r FROM ask WHERE NOT contains(r, ' ')), around AS (SELECT DISTINCT qid, node AS id FROM seeds JOIN near ON seed = id),
w AS (SELECT id, seq, list_distinct(string_split(lower(name), ' ')) AS nw, list_distinct(string_split(lower(name || ' ' || description), ' ')) AS aw FROM v), q AS (SELECT qid, list_distinct(string_split(lower(text), ' ')) AS qw FROM ask),
s AS (SELECT qid, id, seq, CAST(len(list_intersect(qw, aw)) + 2.0 * len(list_intersect(qw, nw)) AS DOUBLE) AS score FROM around JOIN w USING (id) JOIN q USING (qid)),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq, id) AS rank FROM s), top AS (SELECT * FROM k WHERE rank <= 5),
rels AS (SELECT DISTINCT t.qid, src, dst, rel FROM top t JOIN e ON src = t.id OR dst = t.id WHERE EXISTS (SELECT 1 FROM around a WHERE a.qid = t.qid AND a.id = src) AND EXISTS (SELECT 1 FROM around a WHERE a.qid = t.qid AND a.id = dst)),
nr AS (SELECT qid, count(*) AS n_relations FROM rels GROUP BY qid)"""


@query(f"WITH RECURSIVE {LOCAL} SELECT top.qid, id, score, CAST(rank AS INT) AS rank, coalesce(n_relations, 0) AS n_relations, round(least(1.0, count(*) OVER (PARTITION BY top.qid) / 5), 6) AS confidence FROM top LEFT JOIN nr USING (qid)")
def graph_local(read):
    return knowledge.local_search(_questions(read), _vertices(read), _edges(read), 5, 2, written)


@query(f"""WITH RECURSIVE {LOCAL}, docs AS (SELECT qid, count(*) AS n_documents FROM ask WHERE qid % 2 = 0 GROUP BY qid), en AS (SELECT qid, count(*) AS n_entities FROM top GROUP BY qid)
SELECT qid, n_entities, coalesce(n_documents, 0) AS n_documents, round(least(1.0, (n_entities + CASE WHEN n_documents > 0 THEN 1 ELSE 0 END) / 5), 6) AS confidence FROM en LEFT JOIN docs USING (qid)""")
def graph_hybrid(read):
    """Documents are found for every second question, as the vectors of a caller would."""
    asked = _questions(read)
    local = knowledge.local_search(asked, _vertices(read), _edges(read), 5, 2, written)
    return knowledge.hybrid_confidence(local, asked.filter("qid % 2 = 0").select("qid", F.col("qid").alias("doc_id")), 5)


# Communities of the customer graph: labels spread in step, each node votes for its own too.
LABELS = f"""{KEYS_SQL}, b AS (SELECT src, dst, CAST(sum(1.0) AS DOUBLE) AS w FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst GROUP BY ALL),
l AS (SELECT DISTINCT src AS node, src AS label, 0 AS turn FROM b UNION ALL
SELECT node, arg_min(label, struct_pack(v := -v, label := label)) AS label, turn + 1 AS turn FROM
(SELECT node, label, turn, sum(w) AS v FROM (SELECT b.src AS node, l.label, l.turn, b.w FROM l JOIN b ON b.dst = l.node UNION ALL SELECT node, label, turn, 1.0 FROM l) GROUP BY node, label, turn) WHERE turn < 12 GROUP BY node, turn),
c AS (SELECT node, label FROM l WHERE turn = 12)"""


def _communities(read):
    return graph.communities(knowledge.edge_weights(_key_edges(read)), write=written)


@query(f"WITH RECURSIVE {LABELS} SELECT node, label FROM c")
def communities(read):
    return _communities(read)


@query(f"""WITH RECURSIVE {LABELS}, s AS (SELECT label, count(*) AS n FROM c GROUP BY label), t AS (SELECT s.label, x.label AS t, count(*) AS n FROM s JOIN c ON c.label = s.label JOIN (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) p ON p.src = c.node JOIN c x ON x.node = p.dst JOIN s y ON y.label = x.label WHERE s.n < 20 AND y.n >= 20 GROUP BY ALL),
best AS (SELECT label, arg_min(t, struct_pack(n := -n, t := t)) AS t FROM t GROUP BY label), moved AS (SELECT node, CASE WHEN s.n >= 20 THEN c.label ELSE coalesce(best.t, (SELECT min(label) FROM s WHERE n >= 20), c.label) END AS label FROM c JOIN s ON s.label = c.label LEFT JOIN best ON best.label = c.label)
SELECT node, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS community FROM moved""")
def merged_communities(read):
    """Communities under 20 members join the large one that they have most edges to."""
    return knowledge.renumber(knowledge.merge_small(written(_communities(read)), _key_edges(read), 20))


SUMMARIES = """names AS (SELECT 'c' || c_custkey AS node, c_name AS name, 'CUSTOMER' AS kind, 10000 + c_custkey AS seq FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'SUPPLIER', 1000 + s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, 'NATION', 100 + n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'REGION', r_regionkey FROM region),
g AS (SELECT label, count(*) AS size, list(name ORDER BY seq, name) AS names, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM c JOIN names USING (node) GROUP BY label),
su AS (SELECT label, size, CASE WHEN size <= 3 THEN 'Community of ' || kinds || ' entities: ' || array_to_string(names, ', ') || '.' ELSE 'Community of ' || size || ' entities (' || kinds || ') including ' || array_to_string(names[1:3], ', ') || ', and others.' END AS summary FROM g)"""


def _summaries(read):
    name = lambda df, p, key, n, kind, base: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("kind"), (F.col(key) + base).cast("long").alias("seq"))
    v = name(read("customer"), "c", "c_custkey", "c_name", "CUSTOMER", 10000).unionByName(name(read("supplier"), "s", "s_suppkey", "s_name", "SUPPLIER", 1000))
    v = v.unionByName(name(read("nation"), "n", "n_nationkey", "n_name", "NATION", 100)).unionByName(name(read("region"), "r", "r_regionkey", "r_name", "REGION", 0))
    return knowledge.community_summaries(_communities(read), v)


@query(f"WITH RECURSIVE {LABELS}, {SUMMARIES} SELECT * FROM su")
def community_summaries(read):
    return _summaries(read)


@query(f"""WITH RECURSIVE {LABELS}, {SUMMARIES}, q AS (SELECT n_nationkey AS qid, list_distinct(string_split(lower('entities including ' || n_name || ' and others.'), ' ')) AS w FROM nation),
s AS (SELECT qid, label, round(len(list_intersect(w, list_distinct(string_split(lower(summary), ' ')))) / len(w), 6) AS score FROM q, su), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS rank FROM s WHERE score > 0)
SELECT qid, label, score, CAST(rank AS INT) AS rank, round(least(1.0, count(*) OVER (PARTITION BY qid) / 5), 6) AS confidence FROM k WHERE rank <= 5""")
def graph_global(read):
    q = read("nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.concat(F.lit("entities including "), "n_name", F.lit(" and others.")).alias("text"))
    return knowledge.global_search(q, _summaries(read), 5)


@query("""WITH p AS (SELECT p_brand AS id, list(p_type ORDER BY p_partkey) AS ts, min(p_partkey) AS seq FROM part GROUP BY p_brand)
SELECT id, list_reduce(ts, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || '; ' || x END) AS description, seq FROM p""")
def merged_entities(read):
    found = read("part").select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), F.lit("BRAND").alias("kind"), F.col("p_type").alias("description"), F.col("p_partkey").alias("seq"))
    return knowledge.merged_vertices(found).select("id", "description", "seq")


# Names of parts with a letter doubled in every third: similar to what they come from.
RESOLVED = """raw AS (SELECT p_partkey, p_name || ' ' || p_brand AS base, p_brand, p_type FROM part), nm AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN base || 's' ELSE base END AS name, p_brand, p_type FROM raw),
vx AS (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, name, repeat(p_type, CAST(p_partkey % 4 AS INT)) AS description FROM nm),
ed AS (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS src, 'p' || lpad(CAST(p_partkey + 1 AS VARCHAR), 9, '0') AS dst FROM nm),
g AS (SELECT id, name, list_distinct(list_transform(range(1, length(name)), lambda i: substr(lower(name), i, 2))) AS g FROM vx),
pr AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id < b.id WHERE a.name = b.name OR round(2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) >= 0.85),
bo AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), reach AS (SELECT id AS a, id AS b FROM vx UNION SELECT reach.a, bo.b FROM reach JOIN bo ON bo.a = reach.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a), can AS (SELECT id, first(id) OVER (PARTITION BY component ORDER BY length(description) DESC, id) AS canonical FROM comp JOIN vx USING (id)),
mv AS (SELECT s.canonical AS src, d.canonical AS dst, count(*) AS weight FROM ed JOIN can s ON s.id = ed.src JOIN can d ON d.id = ed.dst WHERE s.canonical <> d.canonical GROUP BY ALL)"""


def _part_graph(read):
    p = read("part")
    key = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 9, "0"))
    base = F.concat("p_name", F.lit(" "), "p_brand")
    v = p.select(key(F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(base, F.lit("s"))).otherwise(base).alias("name"), F.lit("PART").alias("kind"), F.expr("repeat(p_type, cast(p_partkey % 4 as int))").alias("description"), F.col("p_partkey").alias("seq"))
    e = p.select(key(F.col("p_partkey")).alias("src"), key(F.col("p_partkey") + 1).alias("dst"), F.lit("next").alias("rel"), F.lit(1).alias("weight"))
    return knowledge.resolve(v, e, knowledge.minimum_components(written))


@query(f"WITH RECURSIVE {RESOLVED} SELECT id, description FROM vx WHERE id IN (SELECT canonical FROM can)")
def resolved_entities(read):
    return _part_graph(read)[0].select("id", "description")


@query(f"WITH RECURSIVE {RESOLVED} SELECT src, dst, weight FROM mv")
def resolved_edges(read):
    return _part_graph(read)[1].select("src", "dst", "weight")


@query(r"""WITH d AS (SELECT a.p_partkey AS doc_id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT DISTINCT doc_id, least(x, y) AS a, greatest(x, y) AS b FROM d WHERE x <> y""")
def entity_cooccurrence(read):
    """A sentence for each two parts that follow one another, names in capitals."""
    p = read("part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    docs = p.join(after, "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.concat(F.initcap("p_name"), F.lit(" goes with "), F.initcap("next"), F.lit(". Nothing else.")).alias("text"))
    return graph.cooccurrence(docs, graph.entities(docs))
