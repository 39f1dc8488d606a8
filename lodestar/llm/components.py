"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Rows of a label table that a task takes, about; a few labels don't need many tasks in each turn.
TASK_ROWS = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it reaches.

    In each turn a node takes the smallest label among its neighbours', and
    then its label's label, so distances halve; labels are written each turn,
    and the turns end when none changes. Edges are never collected.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct()
    both = materialize(both, "edges")
    tasks = max(2, -(-both.count() // TASK_ROWS))
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("component")).coalesce(tasks), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component"))
        moved = materialize(moved.coalesce(tasks), "labels")
        changed = moved.filter("old <> component").limit(1).count()
        discard(spark, labels)
        labels = moved.select("node", "component")
        if not changed:
            discard(spark, both)
            return labels


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components `found` (node, component) joined by further links (a, b): only the links between them are followed. `found` is deleted."""
    own = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    named = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    named = materialize(named.select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y")), "named-links")
    joined = components(named.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    new = named.select(F.col("a").alias("node")).union(named.select("b")).distinct().join(found.select("node"), "node", "left_anti")
    every = found.select("node", "component").union(new.select("node", F.col("node").alias("component")))
    least = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    out = materialize(every.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")
    for used in (found, named, joined):
        discard(found.sparkSession, used)
    return out
