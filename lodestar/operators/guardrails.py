"""Scanning and redaction of personal data, injection and topics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, in the order in which redaction applies them.
PERSONAL = {
    "EMAIL": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    "PHONE": (r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    "SSN": (r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", "[SSN_REDACTED]"),
    "CREDIT_CARD": (r"\b(?:\d{4}[-.\s]?){3}\d{4}\b", "[CREDIT_CARD_REDACTED]"),
    "IP_ADDRESS": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    "DATE_OF_BIRTH": (r"\b(?:DOB|date of birth|born on)[:\s]*\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}\b", "[DOB_REDACTED]"),
}

# Name, pattern and weight of each sign of injection.
INJECTION = [
    ("instruction_override", r"(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|earlier|your)\s+(?:instructions|rules|guidelines|constraints|directives|prompts)", 0.9),
    ("role_manipulation", r"(?:you\s+are\s+now|act\s+as|pretend\s+(?:to\s+be|you\s+are)|assume\s+the\s+role|switch\s+to|enter\s+.{0,20}\s*mode)", 0.7),
    ("prompt_extraction", r"(?:print|show|reveal|display|output|repeat|tell)\s+(?:\w+\s+){0,3}(?:system\s+(?:prompt|message|instructions)|initial\s+(?:prompt|instructions)|hidden\s+(?:prompt|instructions))", 0.9),
    ("delimiter_injection", r"(?:</(?:system|assistant|user|s|message)>|```\s*(?:system|end)|<\|(?:im_end|endoftext|system)\|>|\[\/INST\]|\[SYSTEM\])", 0.8),
    ("jailbreak_attempt", r"(?:DAN\s*(?:mode|\d)?|do\s+anything\s+now|jailbreak|unlocked\s+mode|developer\s+mode|no\s+(?:restrictions|filters|limitations|rules))", 0.9),
    ("data_instruction_injection", r"(?:IMPORTANT|ATTENTION|NOTE|CRITICAL|URGENT)[:\s!]+(?:ignore|disregard|override|the\s+(?:real|actual|true)\s+(?:instruction|task|question))", 0.8),
    ("encoding_attack", r"(?:base64|atob|decode|eval|exec)\s*\(", 0.6),
    ("output_manipulation", r"(?:respond\s+(?:only\s+)?with|your\s+(?:only|sole)\s+(?:response|output|answer)\s+(?:is|should\s+be|must\s+be))\s+[\"']", 0.7),
]


def redact(text: Column, kinds: list[str] | None = None) -> Column:
    for k in kinds or PERSONAL:
        text = F.regexp_replace(text, "(?iU)" + PERSONAL[k][0], re.escape(PERSONAL[k][1]).replace("\\_", "_"))
    return text


def count_personal(text: Column, kind: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("(?iU)" + PERSONAL[kind][0]), 0))


def contains_personal(text: Column, kinds: list[str] | None = None) -> Column:
    out = F.lit(False)
    for k in kinds or PERSONAL:
        out = out | text.rlike("(?iU)" + PERSONAL[k][0])
    return out


def redact_detailed(docs: DataFrame) -> DataFrame:
    """(doc_id, original, redacted, n_matches, kinds) of (doc_id, text); kinds are sorted."""
    n = sum((count_personal(F.col("text"), k) for k in PERSONAL), F.lit(0))
    kinds = F.sort_array(F.array_compact(F.array(*[F.when(contains_personal(F.col("text"), [k]), F.lit(k)) for k in PERSONAL])))
    return docs.select("doc_id", F.col("text").alias("original"), redact(F.col("text")).alias("redacted"), n.alias("n_matches"), kinds.alias("kinds"))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end): offsets need a function over the text."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(texts: pd.Series) -> pd.Series:
        rules = [(k, re.compile(p, re.I)) for k, (p, _) in PERSONAL.items()]
        return texts.fillna("").map(lambda t: sorted(({"kind": k, "start": m.start(), "end": m.end()} for k, r in rules for m in r.finditer(t)), key=lambda x: x["start"]))

    return docs.select("doc_id", F.explode(find("text")).alias("s")).select("doc_id", "s.*")


def injection_score(text: Column) -> Column:
    """Weights of the signs found, 1 at most."""
    total = F.lit(0.0)
    for _, pattern, weight in INJECTION:
        total = total + F.when(text.rlike("(?i)" + pattern), F.lit(weight)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 6)


def injection_signs(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p, _ in INJECTION]))


def topic_check(queries: DataFrame, topics: dict[str, list[str]], allowed: list[str], blocked: list[str], default_allow: bool = True) -> DataFrame:
    """(qid, topic, confidence, is_allowed); topics are a parameter, ties go to the first name."""
    q = F.lower("text")
    options = []
    for name in sorted({*topics, *allowed, *blocked}):
        direct = F.when(q.contains(name), F.lit(0.9)).otherwise(0.0)
        keys = topics.get(name, [])
        share = sum((F.when(q.contains(k), 1).otherwise(0) for k in keys), F.lit(0)) / max(1, len(keys)) * 0.8
        options.append(F.struct(F.round(F.greatest(direct, share), 6).alias("score"), F.lit(name).alias("name")))
    best = F.aggregate(F.array(*options), F.struct(F.lit(0.0).cast("double").alias("score"), F.lit("").alias("name")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    t = queries.select("qid", "text", best.alias("b")).select("qid", "text", F.col("b.name").alias("name"), F.col("b.score").alias("confidence"))
    verdict = F.when(F.length(F.trim("text")) == 0, F.lit(default_allow)).when(F.col("name").isin(blocked or [""]) & (F.col("name") != ""), F.lit(False))
    if allowed:
        verdict = verdict.when(F.col("name").isin(allowed), F.lit(True)).when(F.col("confidence") < 0.3, F.lit(default_allow)).otherwise(F.lit(False))
    else:
        verdict = verdict.otherwise(F.lit(True))
    return t.select("qid", F.col("name").alias("topic"), "confidence", verdict.alias("is_allowed"))
