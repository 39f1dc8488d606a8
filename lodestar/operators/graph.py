"""Triples, entities, traversal, resolution and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, strip

# Relation verbs, kinds of entity names and their key words.
RELATIONS = r"located\s+in|part\s+of|belongs?\s+to|founded\s+by|created\s+by|capital\s+of|contains?|includes?|connects?\s+to|borders?"
ORGANIZATION = "Inc|Corp|LLC|Ltd|Co|Company|Foundation|Institute|University|Association"
PERSON = "Mr|Mrs|Ms|Dr|Prof|President|CEO|CTO|Director|Manager|Senator|Judge"
TECHNOLOGY = "API|SDK|Python|Java|JavaScript|TypeScript|Rust|Go|Docker|Kubernetes|AWS|Azure|GCP|SQL|NoSQL|GraphQL|REST|HTTP|TCP|GPU|CPU|ML|AI|NLP|LLM"
LOCATION = "City|State|Country|Street|Avenue|Road|River|Mountain|Ocean|Lake|Island"
PHRASE = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"


def triples(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, subject, predicate, object): a relation verb first, else a form of to be.

    A subject is a run of letters and white space; a match that begins inside
    such a run could as well begin at its start, so only starts are tried and
    the work stays in proportion to the text.
    """
    s = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.!?]+")).alias("sentence", "raw")).withColumn("s", strip("raw"))
    start = r"(?i)(?:^|[^a-zA-Z\s])\s*([a-zA-Z][a-zA-Z\s]+?)\s+"
    rel = start + "(?:" + RELATIONS + r")\s+(.+)"
    being = start + r"(?:is|are|was|were)\s+(?:the\s+|a\s+|an\s+)?(.+)"
    s = s.filter(F.col("s").rlike(r"(?i)\s(?:is|are|was|were|" + RELATIONS + r")\s"))
    s = s.withColumn("r", F.regexp_extract("s", rel, 1)).withColumn("b", F.when(F.col("r") == "", F.regexp_extract("s", being, 1)).otherwise(""))
    s = s.filter("r <> '' or b <> ''").withColumn("by_rel", F.col("r") != "")
    out = s.select(
        "doc_id", "sentence", strip(F.when(F.col("by_rel"), F.col("r")).otherwise(F.col("b"))).alias("subject"),
        F.when(F.col("by_rel"), F.regexp_replace(F.regexp_extract("s", "(?i)(" + RELATIONS + ")", 1), " ", "_")).otherwise(F.lit("is")).alias("predicate"),
        strip(F.when(F.col("by_rel"), F.regexp_extract("s", rel, 2)).otherwise(F.regexp_extract("s", being, 2))).alias("object"), "by_rel",
    )
    return out.filter(F.col("by_rel") | ((F.length("subject") > 1) & (F.length("object") > 1))).drop("by_rel")


def name_id(c: Column | str) -> Column:
    return F.lower(strip(c))


def mentions(found: DataFrame) -> DataFrame:
    """(entity, mentions) over both ends of the triples."""
    ends = found.select(F.explode(F.array("subject", "object")).alias("name"))
    return ends.groupBy(name_id("name").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"))


def edges_of(found: DataFrame) -> DataFrame:
    """(src, dst, rel) both ways; the way back is marked inverse."""
    out = found.select(name_id("subject").alias("src"), name_id("object").alias("dst"), F.col("predicate").alias("rel"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("inverse_"), F.col("rel")).alias("rel")))


def degrees(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst").distinct()
    return pairs.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("src", "entity")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, write=lambda df: df) -> DataFrame:
    """(seed, node, hop) with the least hop of every node within `hops` of a seed, itself left out.

    The frontier alone is joined in each turn; `write` cuts the lineage between
    turns (a written table on a cluster).
    """
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(links, front["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = write(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, name) of capitalised phrases and technology words, each once per document regardless of case."""
    phrases = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PHRASE), 1)).alias("name"))
    tech = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?iU)\b(" + TECHNOLOGY + r")\b"), 1)).alias("name"))
    both = phrases.unionByName(tech).filter(F.length("name") >= 2)
    return both.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min("name").alias("name")).drop("key")


def kind_of(name: Column, around: Column) -> Column:
    """The kind by the name itself, then by what stands within 100 characters of it."""
    has = lambda c, words: c.rlike(r"(?iU)\b(?:" + words + r")\b")
    return (
        F.when(has(name, ORGANIZATION), "ORGANIZATION").when(has(name, TECHNOLOGY), "TECHNOLOGY")
        .when(F.regexp_like(around, F.concat(F.lit(r"(?iU)\b(?:" + PERSON + r")\b\.?\s*\Q"), name, F.lit(r"\E"))), "PERSON")
        .when(has(name, LOCATION), "LOCATION").when(has(around, ORGANIZATION), "ORGANIZATION").when(has(around, LOCATION), "LOCATION")
        .otherwise("CONCEPT")
    )


def typed_entities(docs: DataFrame) -> DataFrame:
    found = entities(docs).join(docs.select("doc_id", "text"), "doc_id")
    at = F.greatest(F.lit(1), F.expr("locate(name, text)") - 100)
    around = F.substr(F.col("text"), at, F.expr("locate(name, text)") + F.length("name") + 100 - at)
    return found.select("doc_id", "name", kind_of(F.col("name"), around).alias("kind"))


def cooccurrence(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, a, b): entities of a document that share a sentence, each pair once."""
    s = docs.select("doc_id", F.posexplode(sentences("text")).alias("k", "s"))
    inside = s.join(found.select("doc_id", F.lower("name").alias("e")), "doc_id").filter(F.contains(F.lower("s"), F.col("e"))).select("doc_id", "k", "e")
    other = inside.withColumnRenamed("e", "b")
    return inside.withColumnRenamed("e", "a").join(other, ["doc_id", "k"]).filter("a < b").select("doc_id", "a", "b").distinct()


def bigrams(name: Column) -> Column:
    n = F.lower(name)
    return F.when(F.length(n) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(n) - 1), lambda i: F.substr(n, i, F.lit(2))))).otherwise(F.array(n))


def similar_names(names: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, dice) of names (kind, name) of one kind whose bigram sets agree; shared bigrams make the candidates.

    Sets in which one shares at least 85 % of bigrams with the other share one
    of its rarest, so only the shortest prefix that must hold one is joined.
    """
    g = names.select("kind", "name").distinct().select("kind", "name", bigrams(F.col("name")).alias("g")).withColumn("n", F.size("g"))
    rows = g.select("kind", "name", "n", F.explode("g").alias("x"))
    often = rows.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("kind", "name").orderBy("df", "x")
    # Dice >= d needs an overlap of d / (2 - d) * n at least with any partner, so n - that + 1 rarest hold one in common
    prefix = rows.join(often, "x").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least / (2 - least)) + 1)
    a = prefix.select("kind", "x", F.col("name").alias("a"), F.col("n").alias("na"))
    b = prefix.select("kind", "x", F.col("name").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, ["kind", "x"]).filter("a < b").filter(2 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb"))).select("kind", "a", "b").distinct()
    dice = 2 * F.size(F.array_intersect(bigrams(F.col("a")), bigrams(F.col("b")))) / (F.size(bigrams(F.col("a"))) + F.size(bigrams(F.col("b"))))
    return pairs.withColumn("dice", F.round(dice, 6)).filter(F.col("dice") >= least)


def communities(edges: DataFrame, turns: int = 50, write=lambda df: df) -> DataFrame:
    """(node, label) by synchronous label propagation in which a node also votes for its own label; ties to the least label."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("src <> dst")
    both = write(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = write(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(turns):
        votes = both.join(labels, both["dst"] == labels["node"]).select(F.col("src").alias("node"), "label", "weight")
        votes = votes.unionByName(labels.withColumn("weight", F.lit(1.0)))
        tally = votes.groupBy("node", "label").agg(F.sum("weight").alias("v"))
        new = tally.groupBy("node").agg(F.min(F.struct((-F.col("v")).alias("v"), "label")).alias("b")).select("node", F.col("b.label").alias("label"))
        new = write(new)
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = new
        if not moved:
            break
    return labels


def fuse(graph_scores: DataFrame, vector_scores: DataFrame, graph_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """(qid, key, score): graph scores (relative to the best of the query) and vector scores by key."""
    best = F.max("score").over(Window.partitionBy("qid"))
    g = graph_scores.select("qid", "key", (graph_weight * F.col("score") / best).alias("score"))
    v = vector_scores.select("qid", F.lower(F.substring("key", 1, 50)).alias("key"), (vector_weight * F.col("score")).alias("score"))
    return g.unionByName(v).groupBy("qid", "key").agg(F.round(F.sum("score"), 6).alias("score"))
