"""Operator 2: benchmark decontamination by a generalised suffix automaton.

The automaton holds the words of all items (in blocks of bounded size). Each
document's words stream through it; the length of the longest match that ends
at each word is tracked, and where it reaches the window (or, for a short item,
the whole item), those words are hit. Spans of hit words can then be removed,
or documents over a coverage limit dropped.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, freed, materialize, row_struct, table, utf8

WINDOW = 10
#: Words of items that one automaton, and so one broadcast, holds, about (some 80 MB); larger item tables take several passes.
BLOCK_WORDS = 200_000
MAX_COVERAGE = 0.5

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII."""
    return utf8(text).translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of item word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = [[]]
        self.names = [name for name, _ in items]
        self.short: dict[int, list[tuple[int, int]]] = {}
        short = []
        for k, (_, words) in enumerate(items):
            if not words:
                continue
            last = 0
            codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            for i, c in enumerate(codes, 1):
                last = self._extend(last, c, ends)
                if i >= window or i == len(codes):
                    ends[last].append(k)
            if len(codes) < window:
                short.append((k, codes))
        # the items of a state are those that end in it or below it in the link tree
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        held: list[set[int]] = [set(e) for e in ends]
        for s in by_length:
            up = self.link[s]
            if up > 0 and self.length[up] >= window:
                held[up] |= held[s]
        # the state whose strings contain the one of `window` words, and its items
        self.of_window: dict[int, tuple[int, ...]] = {s: tuple(sorted(held[s])) for s in by_length if self.length[s] >= window > self.length[self.link[s]]}
        for k, codes in short:
            s = 0
            for c in codes:
                s = self.next[s][c]
            self.short.setdefault(s, []).append((len(codes), k))
        # short items that are suffixes of a state's strings: its own and its ancestors'
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        if self.short:
            for s in reversed(by_length):
                found = self.short.get(s, []) + self.shorts.get(self.link[s], [])
                if found:
                    self.shorts[s] = found

    def _extend(self, last: int, c: int, ends: list[list[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            ends.append([])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        q = nxt[last].get(c)
        if q is not None:
            return q if length[last] + 1 == length[q] else split(last, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append([])
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else split(p, q)
        return cur

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [start, end) of hit words and the items with occurring windows."""
        window, nxt, link, length = self.window, self.next, self.link, self.length
        spans: list[list[int]] = []
        items: set[int] = set()
        state = size = 0
        shorts = self.shorts
        root = nxt[0]
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                state = size = 0
                continue
            to = nxt[state].get(c)
            if to is None:
                while state and c not in nxt[state]:
                    state = link[state]
                size = length[state]
                to = root.get(c) if not state else nxt[state][c]
            state = to
            size += 1
            reach = 0
            if size >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                reach = window
                items.update(self.of_window[s])
            if shorts and state in shorts:
                for n, k in shorts[state]:
                    if n <= size:
                        items.add(k)
                        reach = max(reach, n)
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [tuple(s) for s in spans], items


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about `block_words` words, by a hash of the id and text; the driver holds one block at a time."""
    # a word that ends before an ASCII character which belongs to none; the blank ends a last one
    ends = F.regexp_count(F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}][\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"), ends.alias("n")).filter("n > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // block_words)
    for k in range(n_blocks):
        block = rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == k).select("name", "text").collect()
        if block:
            yield [(r["name"], words_of(r["text"])) for r in block]


_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: list[str] | None = None, cut: bool = False) -> DataFrame:
    """`row` (all columns of docs, or those in `carry`), n_words, spans (of hit words), items (ids as strings, sorted), and with `cut` the text without the spans.

    A null or empty text has no words and no hits. Items without words match
    nothing; items that repeat each count by their id. Without items nothing
    is hit. Each block of items is one broadcast automaton of bounded size and
    one pass over the documents; passes after the first add to the spans and
    items that are already found, and each but the last is written.
    """
    spark = docs.sparkSession
    src = docs.select(row_struct(docs.select(carry) if carry else docs), F.col(text_col).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    found = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([src.schema["row"], T.StructField("text", T.StringType()), *found])

    def scan(automaton: Broadcast | None, last: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts, spans, names, left = [], [], [], []
                before = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True) if "spans" in b.schema.names else itertools.repeat(([], []))
                for t, (old_spans, old_names) in zip(b.column("text"), before):
                    words = words_of(t.as_py())
                    hits, ks = automaton.value.scan(words) if automaton else ([], set())
                    counts.append(len(words))
                    hits = _merged([*((s["start"], s["end"]) for s in old_spans), *hits]) if hits else [(s["start"], s["end"]) for s in old_spans]
                    spans.append([{"start": s, "end": e} for s, e in hits])
                    names.append(sorted({*old_names, *(automaton.value.names[k] for k in ks)}) if ks else old_names)
                    if last:
                        left.append(None if not cut else cut_words(t.as_py(), hits) if hits else t.as_py())
                cols = [b.column("row"), pa.array(left, pa.string()) if last else b.column("text"), pa.array(counts, pa.int64()), pa.array(spans, _SPAN_ARROW), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

        return freed(run)

    held = None
    for block in item_blocks(items, text_col="text", block_words=block_words):
        if held is not None:
            src, last = materialize(src.mapInArrow(scan(held), schema), "contamination-pass"), src
            held.destroy()
            discard(spark, last)
        held = spark.sparkContext.broadcast(Automaton(block, window))
    found = src.mapInArrow(scan(held, last=True), schema)
    return found if cut else found.drop("text")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words start to end - 1 of each span and what stands between them."""
    raw, out, at = utf8(text), [], 0
    places = [m.span() for m in _WORD.finditer(raw)]
    for s, e in spans:
        out.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The rows of docs without contaminated spans; rows with more than `max_coverage` of their words hit are dropped.

    Untouched texts stay as they are, null ones too.
    """
    found = find_contamination(docs, items, text_col=text_col, window=window, cut=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    kept = found.filter((F.size("spans") == 0) | (n_hit <= max_coverage * F.col("n_words")))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontamination": op2_decontamination}
SQL: dict[str, str] = {}
