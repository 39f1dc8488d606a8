"""Operator 1: best-fit packing with certified bin counts.

Documents become token ids and an end id, and those over the capacity are cut.
Pieces are dealt evenly to partitions; each packs its pieces by best-fit
decreasing and certifies its number of bins with a lower bound from
dual-feasible functions. A partition that meets its bound is certified and
keeps still. One with a gap of g bins releases its emptiest bins, just as many
as have room for g bins between them; what they hold is dealt to new
partitions, so that documents of different partitions meet, and packed again.
That goes on while it saves bins. Where more bins are left than the bound of
the whole table asks for (each partition's bound is rounded up), its emptiest
bins, again as many as have the room, are exchanged in the same way. No partition ever holds
more than a fixed number of pieces, the last ones included.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, materialize, table
from .tokens import WordEncoder, encoder

CAPACITY = 2048
END_ID = 0
PIECES_PER_PARTITION = 60_000
#: Partitions of exchanged pieces are larger by this factor each time, up to POOL_PIECES.
FAN_IN, POOL_PIECES = 8, 400_000
#: Bins with less room than this share of the capacity are never exchanged for the bound of the whole table.
LEAST_ROOM = 1 / 256
#: So many times all bins with room are exchanged at most, unless a time saves a quarter of the gap.
LAST_ROUNDS = 4
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, room long, released boolean, bound long, bins long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual-feasible functions below, each summed over the pieces.

    f0(x) = x; for each threshold t up to half the capacity, ft(x) = capacity
    for x > capacity - t, x for t <= x <= capacity - t, else 0; and for k from
    2 to 20 the rounding function, x if (k + 1)x divides evenly by the
    capacity, else floor((k + 1)x / capacity) * capacity / k.
    """
    return lower_bound_of_counts(dict(enumerate(np.bincount(lengths, minlength=capacity + 1).tolist())), capacity) if len(lengths) else 0


def lower_bound_of_counts(counts: dict[int, int], capacity: int) -> int:
    """lower_bound() of counts by length."""
    count = np.zeros(capacity + 1, np.int64)
    count[list(counts)] = list(counts.values())
    if not count.any():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    cum_n, cum_s = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    large = cum_n[-1] - cum_n[capacity - t]
    middle = cum_s[capacity - t] - cum_s[t - 1]
    best = max(int(cum_s[-1]), int((large * capacity + middle).max(initial=0)))
    bound = -(-best // capacity)
    for k in range(2, 21):
        whole = ((k + 1) * size) % capacity == 0
        value = np.where(whole, size * k, ((k + 1) * size) // capacity * capacity)
        bound = max(bound, -(-int((value * count).sum()) // (capacity * k)))
    return bound


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r is set while some bin has room r
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        x = int(lengths[i])
        fit = rooms >> x
        if fit:
            room = x + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        room -= x
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bins, offsets, n


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        room = capacity - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        emptiest = np.argsort(-room, kind="stable")
        released = np.zeros(n, bool)
        if n > bound:
            enough = np.searchsorted(np.cumsum(room[emptiest]), (n - bound) * capacity) + 1
            released[emptiest[: max(enough, 2)]] = True
        return group.assign(bin=bins, offset=offsets, room=room[bins], released=released[bins], bound=bound, bins=n)

    return pack


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); a null or empty text is its end id alone."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, tokenizer)
        step = 4 * capacity
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(freed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def table_bound(pieces: DataFrame, capacity: int) -> int:
    """The lower bound of the whole table, from its counts of lengths (at most `capacity` of them)."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    return lower_bound_of_counts({r["length"]: r["n"] for r in counts}, capacity)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _dealt(pool: DataFrame, turn: int, n: int, capacity: int, per_partition: int) -> DataFrame:
    """The pool's pieces, `n` of them, packed in partitions of bounded size. Its rows are dealt by their number, so equal rows spread too."""
    most = max(per_partition, min(POOL_PIECES, per_partition * FAN_IN**turn))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(max(1, -(-n // most))))
    return materialize(pool.withColumn("part", part).groupBy("part").applyInPandas(_pack(capacity), PACKED), f"packed-{turn}").withColumn("turn", F.lit(turn).cast("long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32).

    `pieces` must be a written table. Lengths lie between 1 and the capacity.
    Repeated rows are packed as often as they occur, null ids like others; no
    pieces, no rows. `bound` and `bins` are those of the partition that placed
    the piece.
    """
    columns = pieces.columns
    n_bins = lambda df: df.select("turn", "part", "bin").distinct().count()
    packed = _dealt(pieces, 0, pieces.count(), capacity, per_partition)
    pool, done, turn = packed.filter("released"), [packed.filter(~F.col("released"))], 0
    # a pool is packed anew as long as that saves bins; one that doesn't keeps its bins
    while n := pool.count():
        turn += 1
        again = _dealt(pool.select(columns), turn, n, capacity, per_partition)
        if n_bins(again) >= n_bins(pool):
            done.append(pool)
            break
        pool = again.filter("released")
        done.append(again.filter(~F.col("released")))
    target, share, last = table_bound(pieces, capacity), 2, 0
    while True:
        rooms = sorted(((r["room"], r["n"]) for r in _union(done).select("turn", "part", "bin", "room").distinct().groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        gap, room, least = sum(n for _, n in rooms) - target, 0, capacity
        if gap <= 0:
            break
        for r, n in rooms:
            if room >= share * gap * capacity or r < max(1, capacity * LEAST_ROOM):
                break
            room, least = room + r * n, r
        pool = materialize(_union(done).filter(F.col("room") >= least), "packed-open")
        turn += 1
        again = _dealt(pool.select(columns), turn, pool.count(), capacity, per_partition)
        saved = n_bins(pool) - n_bins(again)
        if saved > 0:
            done = [*(d.filter(F.col("room") < least) for d in done), again]
        if 4 * saved < gap:
            last += room < share * gap * capacity
            if last >= LAST_ROUNDS or last and saved <= 0:
                break  # all bins with room have met
            share *= 4
    out = _union(done)
    sequence = F.shiftleft("turn", 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")
    return out.withColumn("sequence_id", sequence).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bound", "bins")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    pieces = pieces_of(docs, tokenizer or tokenizer_file("word_bpe_49k.json"), capacity)
    return pack(materialize(pieces, "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("bound", "bins")


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
