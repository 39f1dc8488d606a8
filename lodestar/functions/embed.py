"""Embedding texts: models are functions of lists; a deterministic one serves where none is at hand."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_vector(text: str, dim: int = 64) -> list[float]:
    """A vector of length 1 that the text's MD5 determines; an empty text has one too."""
    v = np.random.RandomState(int.from_bytes(hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()[:4], "little")).standard_normal(dim)
    return (v / np.linalg.norm(v)).tolist()


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64, text_col: str = "text") -> DataFrame:
    """The rows with `embedding`; the model gets lists of at most `batch` texts, in order, null as empty."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        values, out = column.fillna("").tolist(), []
        for at in range(0, len(values), batch):
            found = model(values[at : at + batch])
            if len(found) != len(values[at : at + batch]):
                raise ValueError("the model must give one vector a text")
            out += found
        return pd.Series(out)

    return texts.withColumn("embedding", run(F.col(text_col)))


def hash_embed(texts: DataFrame, dim: int = 64, text_col: str = "text") -> DataFrame:
    return embed(texts, lambda batch: [hash_vector(t, dim) for t in batch], text_col=text_col)
