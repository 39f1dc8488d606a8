"""Parsers of model replies: JSON somewhere in a text, with key words to fall back on.

Each gives a struct column; the replies themselves come from a column, so
models are called elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

#: An object up to its first closing brace, and one without braces inside.
FLAT = r"(?s)\{[^}]+\}"
INNER = r"(?s)\{[^{}]*\}"
ARRAY = r"(?s)\[.*\]"


def _json(reply: Column, pattern: str) -> Column:
    """The first match as a variant; null if there is none or it isn't JSON."""
    return F.try_parse_json(F.regexp_extract(strip(F.coalesce(reply, F.lit(""))), pattern, 0))


def _text(v: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(default))


def _clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _number(v: Column, name: str, default: float) -> Column:
    """The number; the default where it is missing, null where it is no number."""
    missing = F.try_variant_get(v, f"$.{name}", "string").isNull()
    return F.when(missing, F.lit(default)).otherwise(F.try_variant_get(v, f"$.{name}", "double"))


def _lower(v: Column, name: str, default: str) -> Column:
    return strip(F.lower(_text(v, name, default)))


def grade(reply: Column) -> Column:
    """struct(grade, confidence, reasoning): correct, ambiguous or incorrect."""
    v = _json(reply, FLAT)
    confidence, low = _number(v, "confidence", 0.5), F.lower(F.coalesce(reply, F.lit("")))
    parsed = v.isNotNull() & confidence.isNotNull()
    name = _lower(v, "grade", "incorrect")
    start = F.substring(strip(F.coalesce(reply, F.lit(""))), 1, 200)
    by_word = F.when(F.contains(low, F.lit("correct")) & ~F.contains(low, F.lit("incorrect")), "correct").when(F.contains(low, F.lit("ambiguous")), "ambiguous").otherwise("incorrect")
    sure = F.when(by_word == "correct", 0.7).when(by_word == "ambiguous", 0.5).otherwise(0.3)
    return F.struct(
        F.when(parsed, F.when(name.isin("correct", "ambiguous"), name).otherwise("incorrect")).otherwise(by_word).alias("grade"),
        F.when(parsed, _clamped(confidence, 0.0, 1.0)).otherwise(sure).alias("confidence"),
        F.when(parsed, _text(v, "reasoning", "")).otherwise(start).alias("reasoning"),
    )


KINDS = ("factual", "analytical", "comparative", "exploratory", "conversational")
# Parts of words that tell a kind where a reply has no JSON, in the order in which they are tried.
KIND_WORDS = [("comparative", ["compar"]), ("exploratory", ["explor", "overview", "summar"]), ("analytical", ["analy", "why", "how"]), ("conversational", ["conversat", "follow"])]


def complexity(reply: Column) -> Column:
    """The kind of a query; factual if nothing tells."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    name = _lower(_json(low, FLAT), "complexity", "")
    out = F.when(name.isin(*KINDS), name)
    for kind, parts in KIND_WORDS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = out.when(hit, kind)
    return out.otherwise("factual")


ROUTES = ("direct", "single", "multi_step", "summarize")


def route(reply: Column) -> Column:
    """struct(route, sub_questions): single without questions if nothing can be read; four questions at most."""
    v = _json(reply, INNER)
    name = _lower(v, "route", "single")
    asked = F.coalesce(F.try_variant_get(v, "$.sub_questions", "array<string>"), F.expr("cast(array() as array<string>)"))
    return F.struct(F.when(name.isin(*ROUTES), name).otherwise("single").alias("route"), F.slice(asked, 1, 4).alias("sub_questions"))


def judgment(reply: Column) -> Column:
    """struct(score, reasoning): a score from 0 to 5, 0 if nothing can be read."""
    v = _json(reply, INNER)
    score = _number(v, "score", 0.0)
    parsed = v.isNotNull() & score.isNotNull()
    return F.struct(F.when(parsed, _clamped(score, 0.0, 5.0)).otherwise(0.0).alias("score"), F.when(parsed, _text(v, "reasoning", "")).otherwise(F.lit("Failed to parse judgment")).alias("reasoning"))


def overall(faithfulness: Column, relevance: Column, completeness: Column) -> Column:
    """The weighted mean of three judgments."""
    return F.round(0.4 * faithfulness + 0.35 * relevance + 0.25 * completeness, 2)


def verification(reply: Column) -> Column:
    """struct(supported, confidence, source)."""
    v = _json(reply, FLAT)
    confidence, low = _number(v, "confidence", 0.5), F.lower(F.coalesce(reply, F.lit("")))
    parsed = v.isNotNull() & confidence.isNotNull()
    told = _text(v, "supported", "false")
    by_word = F.contains(low, F.lit("supported")) & ~F.contains(low, F.lit("not supported")) & ~F.contains(low, F.lit("unsupported"))
    return F.struct(
        F.when(parsed, ~told.isin("false", "", "0", "null")).otherwise(by_word).alias("supported"),
        F.when(parsed, _clamped(confidence, 0.0, 1.0)).otherwise(F.when(by_word, 0.7).otherwise(0.3)).alias("confidence"),
        F.when(parsed, _text(v, "supporting_source", "")).otherwise("").alias("source"),
    )


def claims(reply: Column) -> Column:
    """The claims of a reply: a JSON array's, else its lines of more than ten characters without bullets, else the whole."""
    whole = strip(F.coalesce(reply, F.lit("")))
    listed = F.filter(F.transform(F.try_variant_get(_json(reply, ARRAY), "$", "array<string>"), strip), lambda x: x != "")
    lines = F.transform(F.split(F.regexp_replace(whole, r"^\d+[\.\)]\s*", "\n"), "\n"), lambda x: F.regexp_replace(strip(x), r"^[-•* ]+", ""))
    lines = F.filter(lines, lambda x: F.length(x) > 10)
    return F.coalesce(listed, F.when(F.size(lines) > 0, lines).otherwise(F.array(whole)))


def decision(reply: Column) -> Column:
    """retrieve, no_retrieve or continue."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    v = _json(reply, FLAT)
    name = _lower(v, "decision", "retrieve")
    by_word = F.when(F.contains(low, F.lit("no_retrieve")) | F.contains(low, F.lit("no retrieve")), "no_retrieve").when(F.contains(low, F.lit("continue")), "continue").otherwise("retrieve")
    return F.when(v.isNotNull(), F.when(name.isin("no_retrieve", "continue"), name).otherwise("retrieve")).otherwise(by_word)


def relevance(reply: Column) -> Column:
    """Whether a passage is relevant."""
    low, v = F.lower(F.coalesce(reply, F.lit(""))), _json(reply, FLAT)
    by_word = F.contains(low, F.lit("relevant")) & ~F.contains(low, F.lit("irrelevant"))
    return F.when(v.isNotNull(), _lower(v, "relevance", "irrelevant") == "relevant").otherwise(by_word)


def support(reply: Column) -> Column:
    """full, partial or none."""
    low, v = F.lower(F.coalesce(reply, F.lit(""))), _json(reply, FLAT)
    name = _lower(v, "support", "not_supported")
    parsed = F.when(name == "fully_supported", "full").when(name == "partially_supported", "partial").otherwise("none")
    by_word = F.when(F.contains(low, F.lit("fully")), "full").when(F.contains(low, F.lit("partial")), "partial").otherwise("none")
    return F.when(v.isNotNull(), parsed).otherwise(by_word)


def usefulness(reply: Column) -> Column:
    """1 to 5; the first such digit of a reply without JSON, else 3."""
    v = _json(reply, FLAT)
    n = F.floor(_number(v, "usefulness", 3.0)).cast("int")
    digit = F.regexp_extract(F.coalesce(reply, F.lit("")), "[1-5]", 0)
    return F.when(v.isNotNull() & n.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), n))).otherwise(F.when(digit != "", digit.cast("int")).otherwise(3))


def triples(reply: Column) -> Column:
    """array<struct<subject, predicate, object>> of a JSON array whose objects have a subject and an object."""
    rows = F.try_variant_get(_json(reply, ARRAY), "$", "array<struct<subject:string,predicate:string,object:string>>")
    return F.filter(F.coalesce(rows, F.expr("cast(array() as array<struct<subject:string,predicate:string,object:string>>)")), lambda x: (F.coalesce(x["subject"], F.lit("")) != "") & (F.coalesce(x["object"], F.lit("")) != ""))


KINDS_OF_ENTITY = ("PERSON", "ORGANIZATION", "LOCATION", "CONCEPT", "EVENT", "TECHNOLOGY", "PRODUCT")


def entities(reply: Column) -> Column:
    """array<struct<name, kind>> of a JSON object's `entities`; unknown kinds are concepts."""
    rows = F.try_variant_get(_json(reply, r"(?s)\{.*\}"), "$.entities", "array<struct<name:string,type:string>>")
    named = F.filter(F.coalesce(rows, F.expr("cast(array() as array<struct<name:string,type:string>>)")), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    kind = lambda x: F.upper(F.coalesce(x["type"], F.lit("")))
    return F.transform(named, lambda x: F.struct(x["name"].alias("name"), F.when(kind(x).isin(*KINDS_OF_ENTITY), kind(x)).otherwise("CONCEPT").alias("kind")))
