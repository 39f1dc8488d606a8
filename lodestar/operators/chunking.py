"""Chunkers: one document row to many chunk rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_words, sentences, strip


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of `size` over n items: the next begins `overlap` before the last end; the last reaches the end."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(every, lambda s: (s == 0) | (s + overlap < n))


def token_chunks(docs: DataFrame, tokenize: Callable[[Column], Column] = plain_words, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_index, token_start, token_end, token_count, text); the tokenizer is any array expression."""
    toks = docs.select("doc_id", tokenize(F.col("text")).alias("toks"))
    cut = toks.select("doc_id", "toks", F.posexplode(window_starts(F.size("toks"), size, overlap)).alias("chunk_index", "token_start"))
    piece = F.slice("toks", F.col("token_start") + 1, F.lit(size))
    return cut.select("doc_id", "chunk_index", "token_start", (F.col("token_start") + F.size(piece)).alias("token_end"), F.size(piece).alias("token_count"), F.array_join(piece, " ").alias("text"))


def parent_child_chunks(docs: DataFrame, parent: int = 512, child: int = 128, parent_overlap: int = 64, child_overlap: int = 16) -> DataFrame:
    """Child windows inside parent windows, over words; overlaps are held below their windows."""
    parent_overlap, child_overlap = min(parent_overlap, parent - 1), min(child_overlap, child - 1)
    w = docs.select("doc_id", plain_words("text").alias("w"))
    p = w.select("doc_id", "w", F.posexplode(window_starts(F.size("w"), parent, parent_overlap)).alias("parent_index", "ps"))
    p = p.select("doc_id", "parent_index", F.slice("w", F.col("ps") + 1, F.lit(parent)).alias("pw"))
    c = p.select("doc_id", "parent_index", "pw", F.posexplode(window_starts(F.size("pw"), child, child_overlap)).alias("child_index", "cs"))
    words = F.slice("pw", F.col("cs") + 1, F.lit(child))
    return c.select("doc_id", "parent_index", "child_index", F.size(words).alias("n_words"), F.array_join(words, " ").alias("text"), F.size("pw").alias("parent_words"))


def parents(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, parent_index, parent_text): the windows that parent_child_chunks() cuts its children from."""
    w = docs.select("doc_id", plain_words("text").alias("w"))
    p = w.select("doc_id", "w", F.posexplode(window_starts(F.size("w"), size, min(overlap, size - 1))).alias("parent_index", "ps"))
    return p.select("doc_id", "parent_index", F.array_join(F.slice("w", F.col("ps") + 1, F.lit(size)), " ").alias("parent_text"))


def with_parent_text(children: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """Children with the text of their parent; parents are a table of their own, so no text is kept once a child."""
    return children.join(parent_rows, ["doc_id", "parent_index"])


def character_slices(docs: DataFrame, size: int = 1000) -> DataFrame:
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))).otherwise(F.expr("cast(array() as array<int>)"))
    cut = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.posexplode(starts).alias("slice_index", "at"))
    return cut.select("doc_id", "slice_index", F.expr(f"substring(text, at + 1, {size})").alias("text"))


# Where texts are cut, in the order in which it is tried.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(text: str, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Greedy packing of pieces by the coarsest separator; a piece that is too long is cut by the finer ones."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk")
    if not text.strip():
        return []
    if length(text) <= size:
        return [text.strip()]
    sep, finer = separators[0], separators[1:]
    if not sep:
        toks, out, at = text.split(), [], 0
        while at < len(toks):
            out.append(" ".join(toks[at : at + size]))
            if at + size >= len(toks):
                break
            at += size - overlap
        return out
    out, held = [], ""
    for part in text.split(sep):
        joined = held + sep + part if held else part
        if length(joined) <= size:
            held = joined
            continue
        if held.strip():
            out.append(held.strip())
        held = ""
        if length(part) > size:
            out += split_recursive(part, size, overlap, finer or ("",), length)
        else:
            held = part
    if held.strip():
        out.append(held.strip())
    return out


def recursive_chunks(docs: DataFrame, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Sequential packing, so the pieces come from a vectorised function per document."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: split_recursive(t, size, overlap, separators))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("chunk_index", "text"))


def semantic_groups(similar: list[float], lengths: list[int], threshold: float, limit: int) -> list[int]:
    """Group of each sentence: a break where similarity falls below the threshold, groups merged up to the limit."""
    groups, total, merged = [], 0, 0
    starts = [0] + [i + 1 for i, s in enumerate(similar) if s < threshold] + [len(lengths)]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        n = sum(lengths[a:b])
        if groups and total + n > limit:
            merged, total = merged + 1, 0
        total += n
        groups += [merged] * (b - a)
    return groups


def semantic_chunks(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float = 0.75, limit: int = 512, min_sentences: int = 2) -> DataFrame:
    """Sentences are embedded by an injected function and grouped per document."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, sents in zip(b["doc_id"], b["sentences"], strict=True):
                sents = list(sents)
                if len(sents) <= min_sentences:
                    rows += [(doc, 0, " ".join(sents))] if sents else []
                    continue
                v = np.asarray(embed(sents), float)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                groups = semantic_groups((v[1:] * v[:-1]).sum(axis=1).tolist(), [len(s.split()) for s in sents], threshold, limit)
                for g in sorted(set(groups)):
                    rows.append((doc, g, " ".join(s for s, k in zip(sents, groups, strict=True) if k == g)))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    return docs.select("doc_id", sentences("text").alias("sentences")).mapInPandas(run, "doc_id long, chunk_index int, text string")


def contextual_chunks(chunks: DataFrame, docs: DataFrame, context: Callable[[Column, Column], Column] | None = None, preview: int = 3000) -> DataFrame:
    """Puts a generated context before each chunk; without a generator chunks stay as they are."""
    if context is None:
        return chunks.withColumn("original_text", F.col("text"))
    heads = docs.select("doc_id", F.substring("text", 1, preview).alias("preview"))
    made = strip(context(F.col("preview"), F.col("text")))
    out = chunks.join(heads, "doc_id").withColumn("original_text", F.col("text"))
    return out.withColumn("text", F.when(F.length(made) > 0, F.concat_ws("\n\n", made, F.col("text"))).otherwise(F.col("text"))).drop("preview")
