"""Operator 9: line deduplication by winnowing over line hashes.

A document is its lines that hold more than white space. Its windows are all
RUN consecutive lines, all fewer lines that hold more than OVER_WORDS words
together, and the whole of a text of fewer than RUN lines. In every window the
smallest line hash (the last one, if equal) is selected as a fingerprint, so
any two equal windows share one. Fingerprints that occur once are dropped by a
count. The positions of the others are
joined, and matches extended both ways over the windows around them: a window
whose lines occurred in an earlier window, by id and place, is a later repeat,
unless it overlaps that first one. The union of the later windows, the maximal
later repeated runs, is deleted; the first place of a window stays whole where
a run repeats over itself, as equal lines do. Positions are joined by what
their windows hold and each with the first alone, never in pairs, so a line that
many documents hold costs a row for each of its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_caches, freed, materialize, row_struct, table, utf8

RUN = 3
#: Fewer lines than RUN are a run too if they hold more words than this.
OVER_WORDS = 50
_WINDOWS = "rid binary, id long, fp long, windows array<struct<start:int,size:int,digest:binary>>"


def lines_of(text: str | None) -> list[bytes]:
    return utf8(text).split(b"\n")


def fingerprints(lines: list[bytes], run: int, over_words: int | None = None) -> list[tuple[int, list[tuple[int, int, bytes]]]]:
    """(fingerprint, [(first line, lines, digest) of each window that selects it]); lines are stripped and not empty.

    Without over_words the windows of `run` lines are all.
    """
    if not lines:
        return []
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64).view(np.int64)
    words = np.cumsum([0, *(len(x.split()) for x in lines)]) if over_words is not None else None
    at: dict[int, list[tuple[int, int, bytes]]] = {}
    for size in range(1 if over_words is not None else run, min(run, len(lines)) + 1):
        view = np.lib.stride_tricks.sliding_window_view(hashes, size)
        picked = np.arange(len(view)) + size - 1 - view[:, ::-1].argmin(axis=1)
        whole = size == run or size == len(lines)
        able = range(len(view)) if whole else np.flatnonzero(words[size:] - words[:-size] > over_words).tolist()
        for i in able:
            at.setdefault(int(picked[i]), []).append((i, size, xxhash.xxh3_128_digest(b"\n".join(lines[i : i + size]))))
    return [(int(hashes[p]), windows) for p, windows in at.items()]


def _winnowed(batches: Iterator[pa.RecordBatch], run: int, over_words: int | None) -> Iterator[pa.RecordBatch]:
    free_caches()
    for b in batches:
        rows = []
        for rid, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            held = [y for x in lines_of(text.as_py()) if (y := x.strip())]
            for fp, windows in fingerprints(held, run, over_words):
                rows.append((rid, doc, fp, [{"start": s, "size": n, "digest": d} for s, n, d in windows]))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())])))
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rid", "id", "fp", "windows"])


def _row_id(id_col: str, text_col: str) -> F.Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit("")))))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, run: int = RUN, over_words: int | None = None) -> DataFrame:
    """(rid, repeats): for each document with later repeats the first lines and sizes of its repeated windows."""
    src = docs.select(_row_id(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = materialize(src.mapInArrow(freed(lambda bs: _winnowed(bs, run, over_words)), _WINDOWS), "line-fingerprints")
    # combined before the shuffle, so a line that a third of all documents hold is one row a task
    often = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
    windows = found.join(often, "fp", "left_semi").select("rid", "id", F.explode("windows").alias("w")).select("rid", "id", "w.start", "w.size", "w.digest")
    windows = materialize(windows, "line-windows")
    place = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "rid", "start")
    first = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    own = (F.col("rid") == F.col("first.rid")) & (F.col("start") < F.col("first.start") + F.col("size"))
    later = windows.join(first, "digest").filter(~own)
    return later.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("repeats"))


def _cut(text: str | None, repeats: list[dict[str, int]]) -> tuple[str | None, int, int, int]:
    """The text left, and its numbers of lines, removed lines and removed runs."""
    lines = lines_of(text)
    held = [i for i, x in enumerate(lines) if x.strip()]
    gone = sorted({k for w in repeats for k in range(w["start"], w["start"] + w["size"])})
    if not gone:
        return text, len(held), 0, 0
    runs: list[list[int]] = []
    for k in gone:
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    drop = {i for a, b in runs for i in range(held[a], held[b] + 1)}
    left = b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode("utf-8", "surrogatepass")
    return left, len(held), len(gone), len(runs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, over_words: int | None = None) -> DataFrame:
    """`row` (all columns of docs as a struct), kept_text, n_lines, n_removed, n_runs.

    Runs have `run` lines or more; with over_words also fewer lines of more
    words than that together, and whole texts of fewer lines.
    The first place of a run, by id and line, stays; null ids count as last.
    A null text stays null, and lines of white space belong to no run of their
    own but go with a run around them. Rows equal in id and text are one
    document and all get its result.
    """
    marks = repeated_windows(docs, id_col, text_col, run, over_words)
    rows = docs.select(row_struct(docs), F.col(text_col).alias("text"), _row_id(id_col, text_col).alias("rid"))
    src = rows.join(marks, "rid", "left").select("row", "text", "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_cut(t.as_py(), w or []) for t, w in zip(b.column("text"), b.column("repeats").to_pylist(), strict=True)]
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *cols], ["row", "kept_text", "n_lines", "n_removed", "n_runs"])

    schema = T.StructType([src.schema["row"], T.StructField("kept_text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_runs")]])
    return src.mapInArrow(freed(cut), schema)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, over_words: int | None = None) -> DataFrame:
    """The rows of docs with later repeated runs removed; rows that lose all their lines go."""
    found = dedup_lines(docs, id_col, text_col, run, over_words).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return found.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), over_words=OVER_WORDS)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL: dict[str, str] = {}
