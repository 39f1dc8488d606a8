"""Operator 3: sharding by a minimax contiguous partition, in DataFrame operations only.

Rows with equal text form atomic groups. Groups are ordered by a 64-bit hash of
the text, and `n_units` consecutive hash ranges of that order are the atomic
units; a unit never splits a group. The smallest shard capacity for which a
greedy left-to-right fill needs at most `n_shards` shards is found by binary
search over the units' prefix sums, and the order is cut as near to equal
sizes as that capacity lets it. Only the `n_units` unit sizes (a fixed number, whatever the input)
ever meet in one task; the search itself is a nest of higher-order functions
over that one array, so nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

N_SHARDS = 16
N_UNITS = 16384
#: Rows that are numbered by one task, about.
SLICE_ROWS = 250_000


def _first_above(prefix: Column, limit: Column, steps: int) -> Column:
    """Index (from 0) of the last prefix sum that is <= limit; `prefix` ascends from 0."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        ok = F.get(prefix, mid) <= limit
        return F.struct(
            F.when(ok, mid).otherwise(s["lo"]).alias("lo"),
            F.when(ok, s["hi"]).otherwise(mid - 1).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), (F.size(prefix) - 1).cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])


def _cuts(prefix: Column, capacity: Column, n_shards: int, steps: int) -> Column:
    """Greedy fill: for each shard the index in `prefix` at which it ends."""

    def step(ends: Column, _: Column) -> Column:
        base = F.when(F.size(ends) == 0, F.lit(0).cast("long")).otherwise(F.get(prefix, F.element_at(ends, -1)))
        return F.concat(ends, F.array(_first_above(prefix, base + capacity, steps)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), F.expr("cast(array() as array<int>)"), step)


def _even_cuts(prefix: Column, capacity: Column, n_shards: int, steps: int) -> Column:
    """For each shard the index in `prefix` at which it ends: nearest to its share, no shard over the capacity.

    A shard ends no later than the capacity lets it, and no earlier than what
    follows needs: the earliest ends come from a greedy fill from the right.
    """
    total = F.element_at(prefix, -1)
    last = F.size(prefix) - 1

    def back(ends: Column, _: Column) -> Column:
        # the first index from which on the rest, up to the end before, fits in one shard
        lowest = F.get(prefix, F.element_at(ends, 1)) - capacity
        return F.concat(F.array(F.when(lowest <= 0, F.lit(0)).otherwise(_first_above(prefix, lowest - 1, steps) + 1).cast("int")), ends)

    earliest = F.aggregate(F.sequence(F.lit(1), F.lit(n_shards - 1)), F.array(last.cast("int")), back) if n_shards > 1 else F.array(last.cast("int"))

    def step(s: Column, k: Column) -> Column:
        base = F.when(F.size(s["ends"]) == 0, F.lit(0).cast("long")).otherwise(F.get(prefix, F.element_at(s["ends"], -1)))
        latest = _first_above(prefix, base + capacity, steps)
        share = total * k / n_shards
        below = _first_above(prefix, share, steps)
        above = F.least(below + 1, last).cast("int")
        nearest = F.when(F.get(prefix, above) - share < share - F.get(prefix, below), above).otherwise(below)
        end = F.greatest(F.least(nearest, latest), F.get(s["earliest"], k - 1)).cast("int")
        return F.struct(F.concat(s["ends"], F.array(end)).alias("ends"), s["earliest"].alias("earliest"))

    start = F.struct(F.expr("cast(array() as array<int>)").alias("ends"), earliest.alias("earliest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, step, lambda s: s["ends"])


def shard_of_units(units: DataFrame, n_shards: int) -> DataFrame:
    """(unit, total) -> (unit, shard); the smallest feasible capacity of ordered atomic units."""
    row = units.agg(F.sort_array(F.collect_list(F.struct("unit", F.col("total").cast("long").alias("total")))).alias("u"))
    # The running sum doubles the prefix of sums by a scan of log steps: sums[i] += sums[i - 2**k].
    row = row.select("u", F.col("u.total").alias("s"))
    for k in range(N_UNITS.bit_length()):
        d = 1 << k
        row = row.select("u", F.expr(f"transform(s, (x, i) -> x + if(i >= {d}, get(s, i - {d}), 0))").alias("s"))
    row = row.select("u", F.concat(F.array(F.lit(0).cast("long")), "s").alias("prefix"))
    steps = N_UNITS.bit_length() + 1
    prefix = F.col("prefix")

    def search(s: Column, _: Column) -> Column:
        mid = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2)
        ends = _cuts(prefix, mid, n_shards, steps)
        ok = F.element_at(ends, -1) == F.size(prefix) - 1
        return F.struct(F.when(ok, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi"))

    total = F.element_at(prefix, -1)
    start = F.struct(F.ceil(total / n_shards).cast("long").alias("lo"), total.alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, lambda s, i: F.when(s["lo"] < s["hi"], search(s, i)).otherwise(s), lambda s: s["hi"])
    row = row.select("u", "prefix", found.alias("capacity"))
    row = row.select("u", "capacity", _even_cuts(prefix, F.col("capacity"), n_shards, steps).alias("ends"))
    return row.select("ends", "capacity", F.posexplode("u").alias("i", "u")).select(
        F.col("u.unit").alias("unit"),
        F.size(F.filter("ends", lambda e: e <= F.col("i"))).cast("int").alias("shard"),
        "capacity",
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, shard and slot.

    size is the UTF-8 length of the text plus 1; a null text counts as empty.
    Equal texts share a shard; null ids and repeated rows are kept as rows of
    their own; an empty table gives an empty result. Slots count each shard's
    rows gapless from 0, in (slice, id) order: rows are dealt to
    `n_shards * n_slices` cells by their place in the table, so that a hot group is
    numbered by many tasks, and a cell's first slot is the sum of the counts
    of the cells before it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # the upper 14 bits of the hash: consecutive ranges of the hash order
        F.shiftrightunsigned(F.xxhash64(text), 64 - (N_UNITS.bit_length() - 1)).cast("int").alias("unit"),
    )
    base = materialize(base, "shard-rows")
    n_slices = max(1, -(-base.count() // (n_shards * slice_rows)))
    units = base.groupBy("unit").agg(F.sum("size").alias("total"))
    placed = base.join(F.broadcast(shard_of_units(units, n_shards)), "unit")  # at most N_UNITS rows
    placed = placed.withColumn("slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_slices)).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "slice"), "shard-placed")
    cells = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(cells, ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("k")).cast("long").alias("slot")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}
SQL: dict[str, str] = {}
