"""Operator 5: removal of long repeated byte strings with a run-length index.

Every 200-byte string of the corpus has an anchor, its least 32-byte substring
by hash, so equal strings have equal anchors. An anchor and the bytes around
it that any such string can reach form a segment. Anchors are counted first:
segments that occur twice or more, byte for byte, are repeated whole wherever
they stand, and those whose anchor occurs once hold nothing repeated. The
other segments, which share an anchor but differ, go to blocks by anchor, one
copy of each; those of an anchor with very many are split by the bytes around it. A block's text becomes a run-compressed Burrows-Wheeler transform
with the text places of both ends of every run and the match length across
each run boundary. Streaming these samples in text order gives the matching
statistics (the longest match elsewhere from each byte on), and where they
reach 200 the bytes are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_caches, freed, materialize, packed, table, unpack, utf8
from .shingles import mix

LENGTH = 200
GRAM = 32
STEP = 1 << 22
PIECE_BYTES = 1 << 18
BLOCK_BYTES = 2 << 20
#: Anchors with more differing segments than this have them dealt to several blocks, by what stands around the anchor.
HOT_KINDS, PARTS = 500, 4
SEPARATOR = 0xFF  # never in UTF-8

_RAND = np.random.RandomState(5).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MULTS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_PLACE = np.uint64((1 << 24) - 1)


def _window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor of each window, hash at each place)."""
    with np.errstate(over="ignore"):
        h, step = _RAND[data], 1
        for m in _MULTS:
            h = h[: len(h) - step] * m + h[step:]
            step *= 2
        h = mix(h)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    return (key & _PLACE).astype(np.int64), h


def anchors(raws: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(index of the text, place, hash) of every anchor, each place of a text once."""
    pieces, size = [], 0
    for k, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, STEP):
            part = raw[at : at + STEP + length - 1]
            if pieces and size + len(part) > PIECE_BYTES:
                yield from _of_pieces(pieces, length)
                pieces, size = [], 0
            pieces.append((k, at, part))
            size += len(part) + 1
    if pieces:
        yield from _of_pieces(pieces, length)


def _of_pieces(pieces: list[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    data = np.frombuffer(b"\xff".join(p for _, _, p in pieces) + b"\xff", np.uint8)
    place, h = _window_anchors(data, length)
    first = 0
    for k, at, part in pieces:
        own = place[first : first + len(part) - length + 1]
        new = own[np.concatenate([[True], own[1:] != own[:-1]])]
        for p, x in zip((new - first + at).tolist(), h[new].view(np.int64).tolist(), strict=True):
            yield k, p, x
        first += len(part) + 1


def segment(raw_len: int, place: int, length: int = LENGTH) -> tuple[int, int]:
    """The bytes that strings of `length` with this anchor can cover."""
    return max(0, place + GRAM - length), min(raw_len, place + length)


class RunLengthIndex:
    """Run-compressed BWT of a text with samples at both ends of every run.

    chars and heads give the runs; first and last the text places at each
    run's first and last row; across[r] is the length of the match between
    the last row of run r - 1 and the first of run r.
    """

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        self.n = len(data)
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        x = padded
        for w in (1, 2, 4):
            x = (x[: len(x) - w] << np.uint64(8 * w)) | x[w:]
        words = x[: self.n]
        order = self._suffix_order(words)
        before = np.where(order > 0, data[order - 1].astype(np.int16), -1)
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.heads = np.flatnonzero(head)
        self.chars = before[self.heads]
        self.first = order[self.heads]
        self.last = order[np.concatenate([self.heads[1:] - 1, [self.n - 1]])]
        self.across = np.zeros(len(self.heads), np.int64)
        self.across[1:] = self._match(words, self.last[:-1], self.first[1:])

    def _suffix_order(self, words: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling; only places that are still tied are sorted again."""
        n = self.n
        order = np.argsort(words, kind="stable")
        rank = np.zeros(n, np.int64)
        slots, keys, depth = np.arange(n), words[order], 8
        while True:
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            # rows of one key are adjacent slots: their rank is the first one's slot
            heads = np.maximum.accumulate(np.where(new, slots, 0))
            rank[order[slots]] = heads
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = slots[tied]
            if not len(slots) or depth >= 2 * n:
                return order
            places = order[slots]
            after = places + depth
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            keys = (rank[places] << 32) | second
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            order[slots] = places[by]
            depth *= 2

    def _match(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffix pairs."""
        out = np.zeros(len(a), np.int64)
        live, at = np.arange(len(a)), 0
        while len(live):
            p, q = a[live] + at, b[live] + at
            inside = (p < self.n) & (q < self.n)
            x = np.where(inside, words[np.minimum(p, self.n - 1)] ^ words[np.minimum(q, self.n - 1)], np.uint64(1 << 63))
            same = x == 0
            # leading equal bytes of the first word that differs
            d = x[~same]
            lead = np.zeros(len(d), np.int64)
            for byte in range(1, 8):
                lead += d >> np.uint64(64 - 8 * byte) == 0
            end = live[~same]
            out[end] = np.minimum(at + lead, self.n - np.maximum(a[end], b[end]))
            live, at = live[same], at + 8
        return out

    def reach(self) -> np.ndarray:
        """For each place the end of the longest match elsewhere that a sample at or before it starts."""
        ends = np.zeros(self.n, np.int64)
        for places, lengths in ((self.first[1:], self.across[1:]), (self.last[:-1], self.across[1:])):
            np.maximum.at(ends, places, places + lengths)
        return np.maximum.accumulate(ends)


def repeated_spans(segments: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each segment the merged spans covered by strings of `length` bytes that start elsewhere too."""
    text = bytes([SEPARATOR]).join(segments) + bytes([SEPARATOR])
    reach = RunLengthIndex(text).reach()
    out, at = [], 0
    for s in segments:
        n = len(s)
        here = np.minimum(reach[at : at + n], at + n) - np.arange(at, at + n) >= length
        edge = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        for a, b in zip(edge[::2].tolist(), (edge[1::2] + length - 1).tolist(), strict=True):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        out.append(spans)
        at += n + 1
    return out


_KEYS = ["id", "th"]  # a document: its id (for null another hash of its text) and a hash of its text, 128 bits in all


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, null_id, text): a row's key is its id and a hash that tells rows with equal ids apart."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.xxhash64(F.lit("null"), text)).alias("id"), F.xxhash64(text).alias("th"), own.isNull().alias("null_id"), text.alias("text"))


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    free_caches()
    for b in batches:
        raws = [utf8(t.as_py()) for t in b.column("text")]
        who, places, hashes, digests = [], [], [], []
        seen: tuple[int, set[int]] = (-1, set())
        for k, p, h in anchors(raws, length):
            if seen[0] != k:
                seen = (k, set())
            if p in seen[1]:
                continue
            seen[1].add(p)
            raw = raws[k]
            s, e = segment(len(raw), p, length)
            who.append(k)
            places.append(p)
            hashes.append(h)
            digests.append(xxhash.xxh3_64_intdigest(raw[s:e], p - s) - (1 << 63))
        who = pa.array(who, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(who), b.column("th").take(who), pa.array(places, pa.int32()), pa.array(hashes, pa.int64()), pa.array(digests, pa.int64())],
            ["id", "th", "place", "anchor", "digest"],
        )


def _parts(raw: bytes, place: int, length: int, n_blocks: int, n_hot: int) -> Iterator[int]:
    """The blocks of a segment with a hot anchor.

    A string of `length` bytes reaches l bytes before the anchor and
    length - GRAM - l after it. Its l lies in one of PARTS ranges; all strings
    of a range share the anchor, the range's least l bytes before it and the
    bytes after it that its largest l leaves. Equal strings thus have equal
    keys for their range, and other segments go elsewhere.
    """
    around = length - GRAM
    width = -(-(around + 1) // PARTS)
    for part in range(PARTS):
        before, after = part * width, max(0, around - (part + 1) * width + 1)
        if before <= place and place + GRAM + after <= len(raw):
            yield n_blocks + xxhash.xxh3_64_intdigest(raw[place - before : place + GRAM + after], part) % n_hot


def _cut_segments(batches: Iterator[pa.RecordBatch], length: int, n_blocks: int, n_hot: int) -> Iterator[pa.RecordBatch]:
    """The wanted segments of each text by block, those that overlap in one piece, so that no byte is twice in a block."""
    for b in batches:
        rows = []
        for doc, th, raw, wanted in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), unpack(b.column("packed")), b.column("wanted").to_pylist(), strict=True):
            last: dict[int, list[int]] = {}
            asked = set()
            for w in wanted:
                asked.update((block, w["place"]) for block in (_parts(raw, w["place"], length, n_blocks, n_hot) if w["hot"] else (w["block"],)))
            for block, place in sorted(asked):
                s, e = segment(len(raw), place, length)
                if block in last and s <= last[block][1]:
                    last[block][1] = max(e, last[block][1])
                    continue
                if block in last:
                    rows.append((block, doc, th, last[block][0], raw[last[block][0] : last[block][1]]))
                last[block] = [s, e]
            rows += [(block, doc, th, s, raw[s:e]) for block, (s, e) in last.items()]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block", "id", "th", "start", "bytes"])


def _indexed(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        found = repeated_spans([bytes(x) for x in group["bytes"]], length)
        for doc, th, start, spans in zip(group["id"].tolist(), group["th"].tolist(), group["start"].tolist(), found, strict=True):
            rows += [(doc, th, start + a, start + b) for a, b in spans]
        return pd.DataFrame(rows, columns=["id", "th", "lo", "hi"])

    return run


def repeated_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """(id, th, marks): for each document with repeated strings the byte spans that they cover.

    Anchors are found twice rather than kept: the first time only to count
    them, so that what is written follows the repeated ones.
    """
    keyed = _keyed(docs, id_col, text_col)
    long_ones = keyed.filter(F.octet_length("text") >= length)
    found = long_ones.mapInArrow(freed(lambda bs: _anchored(bs, length)), "id long, th long, place int, anchor long, digest long")
    # combined before the shuffle: an anchor that a third of all documents hold is one row a task
    count = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    often = materialize(count.filter("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    members = materialize(found.join(often, "anchor"), "members")
    mixed = members.filter("mixed")
    variants = mixed.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "place")).alias("rep"))
    variants = materialize(variants, "variants")
    # segments that occur twice or more, byte for byte
    twice = members.filter("not mixed").unionByName(mixed.join(variants.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"]))
    whole = twice.select("id", "th", F.greatest(F.lit(0), F.col("place") + GRAM - length).alias("lo"), (F.col("place") + length).alias("hi"))
    # segments that share an anchor and differ; where all kinds of an anchor occur twice, none is left to ask for
    kinds = variants.groupBy("anchor").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).filter("least = 1")
    differ = variants.join(kinds.select("anchor", (F.col("kinds") > hot_kinds).alias("hot")), "anchor")
    n_hot, n_all = differ.agg(F.count_if("hot"), F.count(F.lit(1))).first()
    n_blocks = max(1, n_all * (2 * length) // block_bytes)
    n_hot = max(1, n_hot * PARTS * (2 * length) // block_bytes)
    wanted = differ.select("rep.*", "hot", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).alias("block"))
    wanted = wanted.groupBy(_KEYS).agg(F.collect_list(F.struct("block", "place", "hot")).alias("wanted"))
    segments = packed(long_ones.select(*_KEYS, "text")).join(wanted, _KEYS).mapInArrow(freed(lambda bs: _cut_segments(bs, length, n_blocks, n_hot)), "block long, id long, th long, start int, bytes binary")
    partial = segments.dropDuplicates(["block", "id", "th", "start"]).groupBy("block").applyInPandas(_indexed(length), "id long, th long, lo int, hi int")
    return whole.unionByName(partial).groupBy(_KEYS).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))


def merge(marks: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of docs; kept holds the remaining bytes.

    A null text counts as empty. Rows equal in id and text are copies like any
    others: both lose what they share. Texts shorter than `length` lose nothing.
    """
    marks = repeated_marks(docs, id_col, text_col, length)
    rows = packed(_keyed(docs, id_col, text_col)).join(marks, _KEYS, "left").select(F.expr("if(null_id, null, id)").alias("id"), "packed", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, found in zip(unpack(b.column("packed")), b.column("marks").to_pylist(), strict=True):
                spans = merge([(m["lo"], m["hi"]) for m in found], len(raw)) if found else []
                at, kept = 0, []
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                out.append((len(raw), sum(e - s for s, e in spans), len(spans), b"".join([*kept, raw[at:]])))
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(freed(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_repeats": op5_repeats}
SQL: dict[str, str] = {}
