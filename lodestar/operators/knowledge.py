"""Building, resolving, searching and summarising graphs of entities.

Vertices are (id, name, kind, description, seq) and edges (src, dst, rel,
weight); seq is the order in which a vertex arrived. Questions are (qid, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .graph import k_hop, similar_names

Write = Callable[[DataFrame], DataFrame]


def _same(df: DataFrame) -> DataFrame:
    return df


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) of every edge and its reverse, each once, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def merged_vertices(found: DataFrame) -> DataFrame:
    """One vertex per id: the first name and kind, and the descriptions in order, each unless the text so far holds it."""
    add = lambda acc, x: F.when((x == "") | F.contains(acc, x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit("; "), x))
    rows = F.sort_array(F.collect_list(F.struct("seq", "name", "kind", F.coalesce("description", F.lit("")).alias("d"))))
    out = found.groupBy("id").agg(rows.alias("r"))
    return out.select("id", F.col("r")[0]["name"].alias("name"), F.col("r")[0]["kind"].alias("kind"), F.aggregate(F.col("r.d"), F.lit(""), add).alias("description"), F.col("r")[0]["seq"].alias("seq"))


def merge_graphs(vertices: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of graphs: vertices of one id become one, edges of one kind add their weights."""
    v, e = vertices[0], edges[0]
    for more in vertices[1:]:
        v = v.unionByName(more)
    for more in edges[1:]:
        e = e.unionByName(more)
    return merged_vertices(v), e.groupBy("src", "dst", "rel").agg(F.sum("weight").alias("weight"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among ids (id)."""
    ends = ids.select("id").distinct()
    inside = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi")
    return inside.join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, src, dst, rel) of the edges with an end among each query's ids (qid, id), each once."""
    one = edges.join(ids.withColumnRenamed("id", "src"), "src").select("qid", "src", "dst", "rel")
    other = edges.join(ids.withColumnRenamed("id", "dst"), "dst").select("qid", "src", "dst", "rel")
    return one.unionByName(other).distinct()


def resolve(vertices: DataFrame, edges: DataFrame, components: Callable[[DataFrame], DataFrame], least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Vertices of one kind with similar names become one, and edges follow.

    Chains of similar names are followed to their end, by `components`, which
    gives (node, component) of pairs (a, b). The longest description is
    canonical, then the smallest id. Edges that become loops go.
    """
    pairs = similar_names(vertices.select("kind", "name"), least)
    ends = vertices.select("kind", "name", "id")
    # vertices of one name are joined to the first of them, so pairs of names stay pairs of ids
    first = ends.groupBy("kind", "name").agg(F.min("id").alias("x"))
    alike = pairs.join(first.withColumnRenamed("name", "a"), ["kind", "a"]).join(first.select("kind", F.col("name").alias("b"), F.col("x").alias("y")), ["kind", "b"])
    twins = ends.join(first, ["kind", "name"]).filter("id <> x").select("x", F.col("id").alias("y"))
    groups = components(alike.select("x", "y").unionByName(twins).select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = vertices.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = Window.partitionBy("component").orderBy(F.length(F.coalesce("description", F.lit(""))).desc(), "id")
    named = named.withColumn("canonical", F.first("id").over(best))
    to = named.select("id", "canonical")
    moved = edges.join(to.select(F.col("id").alias("src"), F.col("canonical").alias("s")), "src").join(to.select(F.col("id").alias("dst"), F.col("canonical").alias("d")), "dst")
    moved = moved.filter("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst"), "rel").agg(F.sum("weight").alias("weight"))
    return named.filter("id = canonical").drop("canonical", "component"), moved


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): numbers of vertices by kind and of edges by relation."""
    v = vertices.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("what"), "kind", "n")
    e = edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), F.col("rel").alias("kind"), "n")
    return v.unionByName(e)


def top_entities(mentions: DataFrame, degrees: DataFrame, limit: int = 60) -> DataFrame:
    """(entity, mentions, degree) of the most mentioned, then best connected entities."""
    both = mentions.join(degrees, "entity", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return both.orderBy(F.col("mentions").desc(), F.col("degree").desc(), "entity").limit(limit)


def seeds_in_text(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, seed) of the entities whose id stands in the question, else of those that share a word with it.

    An id stands in a question at one of its starts, so questions are cut into
    all runs of as many words as ids have, and joined by equality, after the
    marks around them are taken off.
    """
    sizes = ids.select(F.size(F.split("id", " ")).alias("n")).distinct()
    q = questions.select("qid", words("text").alias("w")).withColumn("w", F.transform("w", lambda x: F.regexp_replace(x, r"^[\p{P}\p{S}&&[^#_]]+|[\p{P}\p{S}&&[^#_]]+$", "")))
    runs = q.join(sizes, F.size("w") >= F.col("n")).select("qid", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("id"))
    whole = runs.join(ids.select("id"), "id").select("qid", F.col("id").alias("seed")).distinct()
    rest = q.join(whole.select("qid").distinct(), "qid", "left_anti").select("qid", F.explode(F.array_distinct("w")).alias("x")).filter("x <> ''")
    parts = ids.select("id", F.explode(F.array_distinct(F.split("id", " "))).alias("x"))
    return whole.unionByName(rest.join(parts, "x").select("qid", F.col("id").alias("seed")).distinct())


def graph_search(questions: DataFrame, vertices: DataFrame, edges: DataFrame, hops: int = 2, k: int = 5, write: Write = _same) -> DataFrame:
    """(qid, entity, related, mentions, score) of each question's first k seeds: half of the nodes within `hops`, plus 0.3 of the mentions.

    vertices (id, mentions, seq); seeds are taken in their order of arrival.
    """
    found = seeds_in_text(questions, vertices).join(vertices.select(F.col("id").alias("seed"), "mentions", "seq"), "seed")
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("seq", "seed"))).filter(F.col("_n") <= k).drop("_n")
    near = k_hop(edges, found.select("seed").distinct(), hops, write).groupBy("seed").agg(F.count(F.lit(1)).alias("related"))
    out = found.join(near, "seed", "left").withColumn("related", F.coalesce("related", F.lit(0)))
    return out.select("qid", F.col("seed").alias("entity"), "related", "mentions", F.round(0.5 * F.col("related") + 0.3 * F.col("mentions"), 6).alias("score"))


def paths(edges: DataFrame, seeds: DataFrame, hops: int, write: Write = _same) -> DataFrame:
    """(seed, node, hop, path) of every node within `hops`: the least of its shortest paths, as an array from the seed on."""
    links = both_ways(edges)
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.array("seed").alias("path")).distinct()
    seen = front
    for hop in range(1, hops + 1):
        step = front.join(links, front["node"] == links["src"]).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        # the least path to each node; combined before the shuffle
        step = step.groupBy("seed", "node").agg(F.min("path").alias("path"))
        front = write(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hop"), "path"))
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def question_entities(questions: DataFrame, vertices: DataFrame) -> DataFrame:
    """(qid, id): the vertices whose name a question holds, in capitals, as a phrase or as a word after the first."""
    text = F.coalesce("text", F.lit(""))
    phrases = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1)
    tokens = F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x, i: F.struct(F.regexp_replace(x, r"[^\p{L}\p{N}_]", "").alias("x"), i.alias("i")))
    capital = lambda t: F.length(t["x"]) > 1
    upper = lambda t: (F.substr(t["x"], F.lit(1), F.lit(1)).rlike(r"^\p{Lu}") & (t["i"] > 0)) | ((F.upper(t["x"]) == t["x"]) & t["x"].rlike(r"\p{L}"))
    single = F.transform(F.filter(tokens, lambda t: capital(t) & upper(t)), lambda t: t["x"])
    names = questions.select("qid", F.explode(F.concat(phrases, single)).alias("name")).select("qid", F.lower("name").alias("key")).distinct()
    # of vertices with one name the last to arrive counts
    ids = vertices.groupBy(F.lower("name").alias("key")).agg(F.max_by("id", "seq").alias("id"))
    return names.join(ids, "key").select("qid", "id")


def rank_entities(questions: DataFrame, found: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): words shared with name or description, and twice those shared with the name; ties by arrival."""
    v = vertices.select("id", "seq", F.array_distinct(words("name")).alias("n"), F.array_distinct(F.concat(words("name"), words("description"))).alias("w"))
    q = questions.select("qid", F.array_distinct(words("text")).alias("q"))
    score = F.size(F.array_intersect("q", "w")) + 2.0 * F.size(F.array_intersect("q", "n"))
    rows = found.join(v, "id").join(q, "qid").select("qid", "id", "seq", score.cast("double").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "seq", "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("seq")


def local_search(questions: DataFrame, vertices: DataFrame, edges: DataFrame, k: int = 5, hops: int = 2, write: Write = _same, name_of: Callable[[DataFrame, DataFrame], DataFrame] = question_entities) -> DataFrame:
    """(qid, id, score, rank, n_relations, confidence): the best entities around those that a question names."""
    seeds = name_of(questions, vertices)
    near = k_hop(edges, seeds.select(F.col("id").alias("seed")).distinct(), hops, write).select("seed", "node")
    around = seeds.join(near, seeds["id"] == near["seed"]).select("qid", F.col("node").alias("id")).unionByName(seeds).distinct()
    top = rank_entities(questions, around, vertices, k)
    inside = edges.select("src", "dst", "rel").distinct()
    # relations within what was reached, with an end among the best
    near_top = touching(inside, top.select("qid", "id"))
    near_top = near_top.join(around.withColumnRenamed("id", "src"), ["qid", "src"], "left_semi").join(around.withColumnRenamed("id", "dst"), ["qid", "dst"], "left_semi")
    n = near_top.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relations"))
    size = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    out = top.withColumn("confidence", F.round(F.least(F.lit(1.0), size / max(k, 1)), 6)).join(n, "qid", "left")
    return out.withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))


def community_summaries(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """(label, size, summary) of communities (node, label): kinds, and names in order of arrival."""
    rows = labels.join(vertices.select(F.col("id").alias("node"), "name", "kind", "seq"), "node")
    out = rows.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("seq", "name"))).alias("m"), F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kinds"))
    names = F.col("m.name")
    few = F.concat(F.lit("Community of "), F.col("kinds"), F.lit(" entities: "), F.array_join(names, ", "), F.lit("."))
    many = F.concat(F.lit("Community of "), F.size("m").cast("string"), F.lit(" entities ("), F.col("kinds"), F.lit(") including "), F.array_join(F.slice(names, 1, 3), ", "), F.lit(", and others."))
    return out.select("label", F.size("m").cast("long").alias("size"), F.when(F.size("m") <= 3, few).otherwise(many).alias("summary"))


def merge_small(labels: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(node, label): communities under `least` members join the large one with most edges to them, else the first large one."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    large, small = sizes.filter(F.col("n") >= least).select("label"), sizes.filter(F.col("n") < least).select("label")
    pairs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    of = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
    links = pairs.join(of("src", "label"), "src").join(small, "label", "left_semi").join(of("dst", "to"), "dst").join(large.withColumnRenamed("label", "to"), "to", "left_semi")
    tally = links.groupBy("label", "to").agg(F.count(F.lit(1)).alias("n"))
    best = tally.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "to")).alias("b")).select("label", F.col("b.to").alias("to"))
    first = large.agg(F.min("label").alias("first"))  # one row
    moved = labels.join(small, "label", "left_semi").join(best, "label", "left").crossJoin(F.broadcast(first))
    moved = moved.select("node", F.coalesce("to", "first", "label").alias("label"))
    return labels.join(small, "label", "left_anti").select("node", "label").unionByName(moved)


def renumber(labels: DataFrame) -> DataFrame:
    """(node, label, community): labels numbered from 0 in their order; one row a label meets in the numbering."""
    names = labels.select("label").distinct().withColumn("community", F.row_number().over(Window.orderBy("label")) - 1)
    return labels.join(names, "label").select("node", "label", "community")


def global_search(questions: DataFrame, summaries: DataFrame, k: int = 5) -> DataFrame:
    """(qid, label, score, rank, confidence): communities by the share of the question's words in their summary."""
    q = questions.select("qid", F.array_distinct(words("text")).alias("w"))
    asked = q.select("qid", F.size("w").alias("n"), F.explode("w").alias("x"))
    held = summaries.select("label", F.explode(F.array_distinct(words("summary"))).alias("x"))
    scored = asked.join(held, "x").groupBy("qid", "label", "n").agg(F.count(F.lit(1)).alias("m")).select("qid", "label", F.round(F.col("m") / F.col("n"), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "label")
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumn("confidence", F.round(F.least(F.lit(1.0), F.count(F.lit(1)).over(Window.partitionBy("qid")) / max(k, 1)), 6))


def hybrid_confidence(local: DataFrame, vector_results: DataFrame, k: int = 5) -> DataFrame:
    """(qid, n_entities, n_documents, confidence): local search's entities, and one more if vectors found documents (qid, doc_id)."""
    e = local.groupBy("qid").agg(F.count(F.lit(1)).alias("n_entities"))
    d = vector_results.groupBy("qid").agg(F.count(F.lit(1)).alias("n_documents"))
    both = e.join(d, "qid", "full_outer").select("qid", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
    share = (F.col("n_entities") + F.when(F.col("n_documents") > 0, 1).otherwise(0)) / max(k, 1)
    return both.withColumn("confidence", F.round(F.least(F.lit(1.0), share), 6))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, neighbour, rel, direction) of the asked ids."""
    out = ids.join(edges, ids["id"] == edges["src"]).select("id", F.col("dst").alias("neighbour"), "rel", F.lit("out").alias("direction"))
    back = ids.join(edges, ids["id"] == edges["dst"]).select("id", F.col("src").alias("neighbour"), "rel", F.lit("in").alias("direction"))
    return out.unionByName(back)


def minimum_components(write: Write) -> Callable[[DataFrame], DataFrame]:
    """A function that gives (node, component), the least node reached, of pairs (a, b); labels are written each turn."""

    def run(pairs: DataFrame) -> DataFrame:
        links = write(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = write(links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
        while True:
            near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
            new = write(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
            labels, moved = new.select("node", "component"), new.filter("old <> component").limit(1).count()
            if not moved:
                return labels

    return run


def edge_weights(edges: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    return edges.withColumn("weight", weight if isinstance(weight, Column) else F.lit(weight))
