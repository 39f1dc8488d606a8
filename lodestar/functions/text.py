"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \w is ASCII; letters, digits and underscore of every script count as a token here.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), 0)


def words(text: Column | str) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"\s+"), lambda x: x != "")


def plain_words(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda x: x != "")


def sentences(text: Column | str) -> Column:
    """Pieces that end in . ! or ? before white space."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision."""
    prod = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column | str) -> Column:
    """The vector in double precision, scaled to length 1; a zero vector stays."""
    v = _col(vector)
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
