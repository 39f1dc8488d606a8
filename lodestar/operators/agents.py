"""Control decisions as columns: classification, planning, grading, reflection, verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, sentences, strip, words

# Cue phrases of the query classes, in the order in which they are tried.
CLASSES = [
    ("comparative", ["compare", "versus", " vs ", "difference between", "better than"]),
    ("exploratory", ["overview", "summarize", "key themes", "list all", "what are the"]),
    ("analytical", ["why ", "how does", "explain", "what causes", "reason for"]),
    ("conversational", ["what about", "tell me more", "and the", "also "]),
]
# Strategy and number of results per class, and what each strategy falls back to.
STRATEGY = {"factual": ("dense", 3), "analytical": ("hybrid", 5), "comparative": ("multi_pass", 8), "exploratory": ("hybrid", 10), "conversational": ("dense", 5)}
FALLBACK = {"dense": "hybrid", "sparse": "hybrid", "hybrid": "multi_pass", "multi_pass": "hybrid"}
# Cues of opinion questions and of the planner's query kinds.
OPINION = ["do you think", "in your opinion", "what do you feel", "should i", "would you recommend", "personal"]
COMPARE = ["compare", "versus", "vs", "difference between", "contrast"]
HOPS = ["then", "after that", "based on", "using the", "which leads to"]
TOTALS = ["how many", "total", "sum", "count", "all", "list all", "enumerate"]


def classify(query: Column) -> Column:
    q = F.lower(strip(query))
    out = None
    for name, cues in CLASSES:
        hit = contains_any(q, cues)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("factual")


def strategy(kind: Column) -> tuple[Column, Column]:
    """(strategy, number of results) of a query class."""
    s, k = F.lit("hybrid"), F.lit(5)
    for name, (how, n) in STRATEGY.items():
        s, k = F.when(kind == name, how).otherwise(s), F.when(kind == name, n).otherwise(k)
    return s, k


def fallback(how: Column) -> Column:
    out = F.lit("hybrid")
    for a, b in FALLBACK.items():
        out = F.when(how == a, b).otherwise(out)
    return out


def retrieval_confidence(results: DataFrame) -> DataFrame:
    """(qid, confidence, retry): half for up to three results, half for the mean score; below .3 is tried again."""
    c = F.least(F.lit(1.0), F.least(F.count(F.lit(1)) / 3, F.lit(1.0)) * 0.5 + F.avg("score") * 0.5)
    return results.groupBy("qid").agg(F.round(c, 6).alias("confidence")).withColumn("retry", F.col("confidence") < 0.3)


def plan_steps(queries: DataFrame) -> DataFrame:
    """(qid, kind, step, step_query, step_type) of queries (qid, text)."""
    low = F.lower("text")
    trim = lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"^[.,?!]+|[.,?!]+$", "")
    compared = F.filter(F.transform(F.split("text", r"(?i)\band\b|\bvs\.?\b|\bversus\b"), trim), lambda p: F.length(p) > 3)
    chained = F.filter(F.transform(F.split("text", r"(?i)\bthen\b|\bafter that\b|\bbased on\b"), trim), lambda p: F.length(p) > 5)
    step = lambda q, t: F.struct(q.alias("q"), F.lit(t).alias("t"))
    kind = (
        F.when(contains_any(low, COMPARE) & (F.size("compared") >= 2), "comparison")
        .when(contains_any(low, HOPS) & (F.size("chained") > 0), "multi_hop")
        .when(contains_any(low, TOTALS), "aggregation")
        .otherwise("simple")
    )
    q = queries.withColumn("compared", compared).withColumn("chained", chained).withColumn("kind", kind)
    steps = (
        F.when(F.col("kind") == "comparison", F.concat(F.transform("compared", lambda p: step(F.concat(F.lit("Information about "), p), "search")), F.array(step(F.col("text"), "compare"))))
        .when(F.col("kind") == "multi_hop", F.transform("chained", lambda p: step(p, "search")))
        .when(F.col("kind") == "aggregation", F.array(step(F.col("text"), "search"), step(F.concat(F.lit("Aggregate results for: "), F.col("text")), "aggregate")))
        .otherwise(F.array(step(F.col("text"), "search")))
    )
    out = q.select("qid", "kind", F.posexplode(steps).alias("at", "s"))
    return out.select("qid", "kind", (F.col("at") + 1).alias("step"), F.col("s.q").alias("step_query"), F.col("s.t").alias("step_type"))


def crag_action(graded: DataFrame) -> DataFrame:
    """(qid, correct_ratio, usable_ratio, action) of graded results (qid, grade)."""
    n = F.count(F.lit(1))
    correct, usable = F.count_if(F.col("grade") == "correct") / n, F.count_if(F.col("grade").isin("correct", "ambiguous")) / n
    out = graded.groupBy("qid").agg(F.round(correct, 6).alias("correct_ratio"), F.round(usable, 6).alias("usable_ratio"))
    return out.withColumn("action", F.when(F.col("correct_ratio") >= 0.5, "direct").when(F.col("usable_ratio") >= 0.5, "refine").otherwise("search_elsewhere"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of a that b has."""
    x = F.array_distinct(words(a))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, words(b))) / F.size(x)).otherwise(0.0)


def reflect(pairs: DataFrame) -> DataFrame:
    """Self-reflection on (id, question, passage, answer): retrieve, relevant, support, usefulness, confidence."""
    rel = overlap(F.col("question"), F.col("passage")) > 0.2
    sup = overlap(F.col("answer"), F.col("passage"))
    useful = F.when(F.length("answer") > 200, 4).when(F.length("answer") > 50, 3).otherwise(2)
    level = F.when(sup > 0.5, "full").when(sup > 0.25, "partial").otherwise("none")
    base = pairs.select("id", (~contains_any(F.lower("question"), OPINION)).alias("retrieve"), rel.alias("relevant"), level.alias("support"), useful.alias("usefulness"))
    score = F.when(F.col("support") == "full", 0.4).when(F.col("support") == "partial", 0.2).otherwise(0.0) + (F.col("usefulness") - 1) / 4 * 0.4 + F.when(F.col("relevant"), F.lit(1 / 3) * 0.2).otherwise(0.0)
    return base.withColumn("confidence", F.round(F.least(F.lit(1.0), score), 6))


def verify(answers: DataFrame, sources: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, n_claims, n_supported, confidence) of answers (id, answer) against sources (id, source).

    A claim is a sentence of more than ten characters; it is supported if some
    source of its id has half of its distinct words.
    """
    claims = answers.select("id", F.posexplode(F.filter(sentences("answer"), lambda s: F.length(strip(s)) > 10)).alias("k", "claim"))
    best = claims.join(sources, "id", "left").groupBy("id", "k").agg(F.max(overlap(F.col("claim"), F.coalesce("source", F.lit("")))).alias("best"))
    return best.groupBy("id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("best") >= least).alias("n_supported"), F.round(F.avg("best"), 6).alias("confidence"))


def smart_answers(questions: DataFrame, blocked: Callable[[Column], Column], answer: Callable[[Column], Column], clean: Callable[[Column], Column]) -> DataFrame:
    """Guarded pipeline over (qid, text): blocked questions get no answer, the others a cleaned one and a route."""
    q = questions.withColumn("blocked", blocked(F.col("text")))
    kind = classify(F.col("text"))
    return q.withColumn("route", F.when(F.col("blocked"), "blocked").otherwise(kind)).withColumn("answer", F.when(F.col("blocked"), F.lit(None)).otherwise(clean(answer(F.col("text")))))


def best_trial(trials: DataFrame) -> DataFrame:
    """(best_config, best, worst, mean, improvement) over trials (config, seq, score, failed); the first best one wins."""
    ok = F.when(~F.col("failed"), F.col("score"))
    out = trials.agg(F.max_by("config", F.when(~F.col("failed"), F.struct("score", -F.col("seq")))).alias("best_config"), F.max(ok).alias("best"), F.min(ok).alias("worst"), F.avg(ok).alias("mean"))
    return out.select("best_config", "best", "worst", F.round("mean", 6).alias("mean"), F.round(F.col("best") - F.col("worst"), 6).alias("improvement"))


def grid(spark, options: dict[str, list[str]]) -> DataFrame:
    """Every combination of a few options, one row each."""
    df = spark.range(1).select()
    for name, values in options.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*options)))
