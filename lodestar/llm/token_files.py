"""Operator 7: token ids in binary shards with a minimal perfect hash index.

A shard is two files. The payload holds the raw ids, little-endian, two bytes
each (four if the vocabulary needs them), document after document. The index
holds the document keys in file order, where each one's ids begin, and a
minimal perfect hash over the distinct keys: displacements per bucket, and per
slot a fingerprint and the document's number. A key finds its slot in constant
time, and the fingerprint tells keys that are not in the shard.

Shards are ranges of the key, so that their order is the global order; a task
writes its ids as they come and begins a new shard at a bounded size. Tasks
name their files freshly and report them in rows that Spark commits; files of
lost attempts are never referred to.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, freed, make_folder, materialize, shared_path, table
from .packing import tokenizer_file
from .tokens import ByteEncoder, encoder

END_ID = 2
KEYS_PER_BUCKET = 4
#: A shard ends with the document in which its payload reaches this size.
SHARD_BYTES = 64 << 20
MANIFEST = "path string, low long, low_hash long, turn long, n_docs long, n_ids long"


def _mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit hash of integer keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct integer keys.

    Buckets are placed from the largest down, each with the first seed that
    sends its keys to free slots; a bucket of one key takes a free slot, which
    is written as -1 - slot.
    """
    n = len(keys)
    n_buckets = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = (_mix(keys, 0) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    shift = np.zeros(n_buckets, np.int64)
    taken = np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[sizes[by_size] > 1].tolist():
        own = keys[order[ends[b] - sizes[b] : ends[b]]]
        seed = 1
        while True:
            slots = _mix(own[None, :], np.arange(seed, seed + 16)[:, None]) % np.uint64(n)
            free = ~taken[slots].any(axis=1)
            hit = next((i for i in np.flatnonzero(free).tolist() if len(set(slots[i].tolist())) == len(own)), None)
            if hit is not None:
                break
            seed += 16
        shift[b] = seed + hit
        taken[slots[hit]] = True
    single = by_size[sizes[by_size] == 1]
    shift[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return shift


def slots_of(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    d = shift[(_mix(keys, 0) % np.uint64(len(shift))).astype(np.int64)]
    return np.where(d < 0, -1 - d, (_mix(keys, np.maximum(d, 0)) % np.uint64(max(n, 1))).astype(np.int64))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0xF1) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Writes the payload as ids come, and the index at the end. A key that occurs again, or is null, is only in the key list."""

    def __init__(self, folder: str, width: int):
        self.path, self.width = f"{folder}/{uuid.uuid4().hex}", width
        self.system, self.base = file_system(self.path)
        self.out = self.system.open_output_stream(f"{self.base}.ids")
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.size += len(ids) // 4 * self.width

    def close(self) -> None:
        self.out.close()
        null = np.array([k is None for k in self.keys], bool)
        values = np.array([0 if k is None else k for k in self.keys], "<i8")
        first = first_places(values, null)
        own = values[first]
        shift = build_hash(own)
        slot = slots_of(own, shift, len(own))
        prints, number = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
        prints[slot], number[slot] = fingerprints(own), first
        starts = np.cumsum([0, *self.counts], dtype="<i8")
        parts = {"keys": values, "null": null.astype("u1"), "starts": starts, "shift": shift.astype("<i8"), "prints": prints, "number": number}
        head = json.dumps({"width": self.width, "parts": {k: [v.dtype.str, len(v)] for k, v in parts.items()}}).encode()
        with self.system.open_output_stream(f"{self.base}.index") as out:
            out.write(len(head).to_bytes(4, "little") + head)
            for v in parts.values():
                out.write(v.tobytes())


def first_places(values: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Where each key that is not null stands first."""
    known = np.flatnonzero(~null)
    return known[np.unique(values[known], return_index=True)[1]]


class Shard:
    """One shard, read back."""

    def __init__(self, path: str):
        self.system, self.base = file_system(path)
        with self.system.open_input_stream(f"{self.base}.index") as f:
            raw = f.read()
        n = int.from_bytes(raw[:4], "little")
        head, at = json.loads(raw[4 : 4 + n]), 4 + n
        self.width = head["width"]
        for name, (kind, count) in head["parts"].items():
            setattr(self, name, np.frombuffer(raw, kind, count, at))
            at += np.dtype(kind).itemsize * count

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, place, count) of integer keys."""
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = slots_of(keys, self.shift, len(self.prints))
        number = np.minimum(self.number[slot], len(self.keys) - 1)
        # an equal fingerprint of another key is told by the key itself
        found = (self.prints[slot] == fingerprints(keys)) & (self.keys[number] == keys)
        return found, self.starts[number], self.starts[number + 1] - self.starts[number]

    def payload(self):
        return self.system.open_input_file(f"{self.base}.ids")

    def ids(self, file, place: int, count: int) -> np.ndarray:
        file.seek(place * self.width)
        return np.frombuffer(file.read(count * self.width), f"<u{self.width}")


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The manifest, one row per shard: path, its lowest key, documents, ids, and first_id (ids in all shards before).

    A null text is its end id alone. Documents with equal keys follow one
    another, by a hash of the text, which also deals many of them to several
    tasks; null keys come first. No documents, no shards.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_file("byte_bpe_50k.json")
    folder = make_folder(shared_path(spark, "token-shards"))
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ByteEncoder, tokenizer)
        width = 2 if enc.tok.get_vocab_size() <= 1 << 16 else 4
        rows, shard = [], None
        for b in batches:
            for key, other, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), enc.encode_all(b.column(2)), strict=True):
                if shard is None or shard.size >= shard_bytes:
                    if shard is not None:
                        shard.close()
                    shard = ShardWriter(folder, width)
                    rows.append((shard, key, other))
                shard.add(key, ids + end)
        if shard is not None:
            shard.close()
            cols = zip(*[(s.path, low, other, turn, len(s.keys), sum(s.counts)) for turn, (s, low, other) in enumerate(rows)], strict=True)
            names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "path" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

    src = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("other"), F.col(text_col).alias("text"))
    dealt = src.repartitionByRange("key", "other").sortWithinPartitions("key", "other")
    manifest = materialize(dealt.mapInArrow(freed(write), MANIFEST), "token-manifest")
    # one row a shard; shards of one task that begin with the same document's twins are in the order of their turns
    order = [F.col("low").asc_nulls_first(), F.col("low_hash"), F.col("turn")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone, each key found through the hash index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                keys = shard.keys
                found, place, count = shard.find(keys)
                # null keys, and a key's later documents, have their place in the key list alone
                indexed = np.zeros(len(keys), bool)
                indexed[first_places(keys, shard.null == 1)] = True
                listed, lengths = shard.starts[:-1], np.diff(shard.starts)
                wrong = indexed & ~(found & (place == listed) & (count == lengths))
                if wrong.any():
                    raise ValueError(f"the index of {path} does not find key {keys[wrong][0]} in its place")
                place, count = np.where(indexed, place, listed), np.where(indexed, count, lengths)
                with shard.payload() as f:
                    sums = [zlib.crc32(shard.ids(f, p, c).astype("<u4").tobytes()) for p, c in zip(place.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=shard.null == 1), pa.array(first + place, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # the hash of the path spreads the few wide rows over tasks
    return manifest.select("path", "first_id").repartition(F.col("path")).mapInArrow(freed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, ids) of each row of `keys`, a table with a long column `key`: the ids of the first document with that key.

    The driver holds each shard's path and lowest key, a row for SHARD_BYTES of
    payload; a task then reads the one shard that can hold a key, and of its
    payload only that key's ids. Absent and null keys are not found.
    """
    shards = [(r["low"], r["path"]) for r in manifest.orderBy(F.col("low").asc_nulls_first(), "low_hash", "turn").collect()]
    lows = np.array([-(2**63) if low is None else low for low, _ in shards], np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int] | None] = [None] * b.num_rows
            asked: dict[int, list[int]] = {}
            for row, key in enumerate(b.column(0).to_pylist()):
                if key is not None:
                    # shards before the first that begins with the key or above it may hold it, from the last that begins below it on
                    at = max(int(np.searchsorted(lows, key, "left")) - 1, 0)
                    while at < len(lows) and (lows[at] <= key):
                        asked.setdefault(at, []).append(row)
                        at += 1
            for at in sorted(asked):
                rows = [r for r in asked[at] if out[r] is None]
                if not rows:
                    continue
                shard = Shard(shards[at][1])
                found, place, count = shard.find(np.array([b.column(0)[r].as_py() for r in rows], np.int64))
                with shard.payload() as f:
                    for r, ok, p, n in zip(rows, found.tolist(), place.tolist(), count.tolist(), strict=True):
                        if ok:
                            out[r] = shard.ids(f, p, n).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x is not None for x in out]), pa.array(out, pa.list_(pa.int64()))], ["key", "found", "ids"])

    return keys.select(F.col("key").cast("long")).repartitionByRange("key").mapInArrow(freed(find), "key long, found boolean, ids array<long>")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))


QUERIES = {"op7_token_files": op7_token_files}
SQL: dict[str, str] = {}
