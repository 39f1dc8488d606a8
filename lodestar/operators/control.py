"""Orchestration: routes, retrieval rounds, graphs of steps, trials and feedback, simulation, the guarded pipeline."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import agents, replies

#: Results of a route; direct questions retrieve nothing.
ROUTE_K = {"single": 5, "multi_step": 5, "summarize": 15, "direct": 0}


def routed(questions: DataFrame) -> DataFrame:
    """(qid, route, top_k, step, sub_question) of questions (qid, text, reply): a row for each retrieval, none for direct ones.

    A null reply, as without a model, is a single retrieval; a multi-step route
    without sub-questions asks the question itself.
    """
    q = questions.withColumn("r", replies.route(F.col("reply"))).withColumn("route", F.col("r.route"))
    parts = F.when((F.col("route") == "multi_step") & (F.size("r.sub_questions") > 0), F.col("r.sub_questions")).when(F.col("route") == "direct", F.expr("cast(array() as array<string>)")).otherwise(F.array("text"))
    k = F.lit(5)
    for name, n in ROUTE_K.items():
        k = F.when(F.col("route") == name, n).otherwise(k)
    return q.select("qid", "route", k.alias("top_k"), F.posexplode(parts).alias("step", "sub_question"))


def merge_steps(results: DataFrame, k: int) -> DataFrame:
    """Results (qid, step, doc_id, score) of a question's steps: each document from its first step, the best 2k of them."""
    first = Window.partitionBy("qid", "doc_id").orderBy("step", F.col("score").desc())
    once = results.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2 * k)


def evaluate_retrieval(results: DataFrame, round_number: int = 1, least_score: float = 0.3, least_results: int = 2, max_rounds: int = 3) -> DataFrame:
    """(qid, n, mean_score, max_score, good, needs_more) of results (qid, score)."""
    out = results.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"))
    good = (F.col("max_score") >= least_score) & (F.col("n") >= least_results)
    return out.withColumn("good", good).withColumn("needs_more", ~good & F.lit(round_number < max_rounds))


def retrieve_rounds(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], max_rounds: int = 3, suffix: str = " (detailed explanation)") -> DataFrame:
    """(qid, doc_id, score, rank, round) of questions (qid, text): those whose results are poor are asked again, with the suffix."""
    out, left = None, questions
    for n in range(1, max_rounds + 1):
        found = retrieve(left)
        verdict = evaluate_retrieval(found, n, max_rounds=max_rounds)
        again = verdict.filter("needs_more").select("qid") if n < max_rounds else verdict.limit(0).select("qid")
        part = found.join(again, "qid", "left_anti").withColumn("round", F.lit(n))
        out = part if out is None else out.unionByName(part)
        left = left.join(again, "qid", "left_semi").withColumn("text", F.concat("text", F.lit(suffix)))
    return out


def plan_confidence(results: DataFrame) -> DataFrame:
    """(qid, confidence): the mean score of all that a plan's steps found, 1 at most."""
    return results.groupBy("qid").agg(F.round(F.least(F.lit(1.0), F.avg("score")), 6).alias("confidence"))


def adaptive_retrieve(questions: DataFrame, retrievers: dict[str, Callable[[DataFrame, int], DataFrame]], least: float = 0.3) -> DataFrame:
    """(qid, doc_id, score, rank, strategy, tried): each class by its own strategy and number of results, poor ones once more by another.

    `retrievers` gives results (qid, doc_id, score, rank) of questions and a
    number; a strategy that is missing is served by `hybrid`.
    """
    q = questions.withColumn("kind", agents.classify(F.col("text")))
    how, k = agents.strategy(F.col("kind"))
    q = q.withColumn("strategy", how).withColumn("k", k)

    most = max(n for _, n in agents.STRATEGY.values())
    names = sorted({s for s, _ in agents.STRATEGY.values()} | set(agents.FALLBACK.values()))

    def run(df: DataFrame, extra: int, tried: int) -> list[DataFrame]:
        out = []
        # one call a retriever, for as many results as any class wants; each question keeps its own number
        for serve in dict.fromkeys(retrievers.get(n, retrievers["hybrid"]) for n in names):
            own = [n for n in names if retrievers.get(n, retrievers["hybrid"]) is serve]
            part = df if own == names else df.filter(F.col("strategy").isin(own))
            found = serve(part.select(*questions.columns), most + extra).join(part.select("qid", "strategy", "k"), "qid").filter(F.col("rank") <= F.col("k") + extra)
            out.append(found.select("qid", "doc_id", "score", "rank", "strategy", F.lit(tried).alias("tried")))
        return out

    # A retriever's results are judged and joined alone, and united only at the end: where exchanges are reused,
    # Spark 4.1 plans a union as partitioned by qid that it then runs as one that is not ("Can't zip RDDs").
    first, out = run(q, 0, 1), []
    for found in first:
        good = agents.retrieval_confidence(found).filter(F.coalesce(F.col("confidence") >= least, F.lit(True))).select("qid")
        out.append(found.join(good, "qid", "left_semi"))
        q = q.join(good, "qid", "left_anti")
    second = run(q.withColumn("strategy", agents.fallback(F.col("strategy"))), 2, 2)
    return reduce(DataFrame.unionByName, out + second)


def crag(graded: DataFrame, searched: bool = False) -> DataFrame:
    """(qid, action, confidence) of graded results (qid, grade, score): the mean score of what is kept, less if refined.

    Without another search to fall back on, a question whose results are of no
    use has no answer.
    """
    usable = F.avg(F.when(F.col("grade") != "incorrect", F.col("score")))
    found = agents.crag_action(graded).join(graded.groupBy("qid").agg(usable.alias("mean")), "qid")
    action = F.when((F.col("action") == "search_elsewhere") & F.lit(not searched), "no_answer").otherwise(F.col("action"))
    sure = F.when(action == "direct", F.col("mean")).when(action == "refine", F.col("mean") * 0.8).when(action == "search_elsewhere", 0.5).otherwise(0.0)
    return found.select("qid", action.alias("action"), F.round(sure, 6).alias("confidence"))


@dataclass
class Dag:
    """Named steps over DataFrames: a step gets its parent's output, or a dict of them by name.

    A step or edge whose condition fails is skipped and hands on its input; a
    step that raises gives None, its error is kept, and the others go on.
    """

    steps: dict[str, Callable] = field(default_factory=dict)
    edges: list[tuple[str, str, Callable | None]] = field(default_factory=list)
    conditions: dict[str, Callable] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, step: Callable, condition: Callable | None = None) -> Dag:
        if name in self.steps:
            raise ValueError(f"step {name} is there already")
        self.steps[name] = step
        if condition:
            self.conditions[name] = condition
        return self

    def connect(self, src: str, dst: str, condition: Callable | None = None) -> Dag:
        for name in (src, dst):
            if name not in self.steps:
                raise ValueError(f"there is no step {name}")
        self.edges.append((src, dst, condition))
        return self

    def order(self) -> list[str]:
        """The steps, each after its parents; those that are ready go by name."""
        waiting = {n: {a for a, b, _ in self.edges if b == n} for n in self.steps}
        out: list[str] = []
        while waiting:
            ready = min((n for n, parents in waiting.items() if not parents), default=None)
            if ready is None:
                raise ValueError("the steps form a cycle")
            out.append(ready)
            del waiting[ready]
            for parents in waiting.values():
                parents.discard(ready)
        return out

    def run(self, given):
        """The output of the one last step, or a dict of all of them."""
        out: dict = {}
        self.errors = {}
        for name in self.order():
            parents = [(a, c) for a, b, c in self.edges if b == name]
            got = {a: out[a] for a, _ in parents}
            value = given if not got else next(iter(got.values())) if len(got) == 1 else got
            try:
                open_ = all(c is None or c(out[a]) for a, c in parents) and (name not in self.conditions or self.conditions[name](value))
                out[name] = self.steps[name](value) if open_ else value
            except Exception as e:  # noqa: BLE001 a failed step is reported, not raised
                out[name], self.errors[name] = None, str(e)
        last = [n for n in self.steps if not any(a == n for a, _, _ in self.edges)]
        return out[last[0]] if len(last) == 1 else {n: out[n] for n in last}


def trials(options: dict[str, list], score: Callable[[dict], float], n: int | None = None, seed: int = 0) -> list[dict]:
    """One dict (config, seq, score, failed, error) a combination, or for `n` of them drawn with a seed; a failure scores 0."""
    every = [dict(zip(options, values, strict=True)) for values in product(*options.values())]
    if n is not None:
        rnd = random.Random(seed)
        every = [{k: rnd.choice(v) for k, v in options.items()} for _ in range(n)]
    out = []
    for seq, config in enumerate(every):
        try:
            out.append({"config": config, "seq": seq, "score": float(score(config)), "failed": False, "error": ""})
        except Exception as e:  # noqa: BLE001 a failed trial is a result
            out.append({"config": config, "seq": seq, "score": 0.0, "failed": True, "error": str(e)})
    return out


def feedback_by_params(feedback: DataFrame) -> DataFrame:
    """(params, n, mean) of feedback (params, seq, score); params are canonical strings."""
    return feedback.groupBy("params").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def improvement(feedback: DataFrame, baseline: float) -> DataFrame:
    """(best_params, best_mean, n, mean, improvement_pct): the params with the best mean, the first seen of equals."""
    by = feedback.groupBy("params").agg(F.avg("score").alias("m"), F.min("seq").alias("first"))
    best = by.agg(F.max_by("params", F.struct("m", -F.col("first"))).alias("best_params"), F.max("m").alias("m"))  # one row
    total = feedback.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    pct = (F.col("m") - baseline) / baseline * 100 if baseline > 0 else F.lit(0.0)
    return best.crossJoin(total).select("best_params", F.round("m", 6).alias("best_mean"), "n", "mean", F.round(pct, 6).alias("improvement_pct"))


def propose(scored: list[tuple[dict, float]], options: dict[str, list], seed: int = 0, explore: float = 0.2) -> dict:
    """The next params: at random with probability `explore` or without results, else the best with one option changed."""
    rnd = random.Random(seed)
    if not scored or rnd.random() < explore:
        return {k: rnd.choice(v) for k, v in options.items()}
    best = dict(max(scored, key=lambda x: x[1])[0])
    name = rnd.choice(sorted(options))
    best[name] = rnd.choice(options[name])
    return best


def simulate(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], max_latency_ms: float | None = None, least_score: float | None = None, least_results: int | None = None) -> DataFrame:
    """(qid, scenario, n_retrieved, top_score, latency_ms, passed) of queries (qid, scenario, text, latency_ms)."""
    found = retrieve(queries.select("qid", "text")).groupBy("qid").agg(F.count(F.lit(1)).alias("n_retrieved"), F.max("score").alias("top_score"))
    out = queries.join(found, "qid", "left").select("qid", "scenario", F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "latency_ms")
    passed = F.lit(True)
    if max_latency_ms is not None:
        passed = passed & (F.col("latency_ms") <= max_latency_ms)
    if least_score is not None:
        passed = passed & (F.col("top_score") >= least_score)
    if least_results is not None:
        passed = passed & (F.col("n_retrieved") >= least_results)
    return out.withColumn("passed", passed)


def simulation_summary(results: DataFrame) -> DataFrame:
    """One row: totals, pass rate, means over values above 0, and the scenarios, sorted."""
    above = lambda c: F.round(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)), 6).alias(f"mean_{c}")
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("n_passed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        above("latency_ms"), above("top_score"), F.round(F.avg("n_retrieved"), 6).alias("mean_n_retrieved"), F.array_join(F.sort_array(F.collect_set("scenario")), ",").alias("scenarios"),
    )


def react(question: str, think: Callable[[str], str], tools: dict[str, Callable[[str], str]], max_steps: int = 5) -> dict:
    """The loop of thought, action and observation: answer, observations, steps and confidence.

    A reply is read for `Final Answer:`, else for `Action:` and `Action Input:`;
    an unknown tool is an observation too.
    """
    import re

    log, seen = question, []
    for step in range(1, max_steps + 1):
        reply = think(log)
        final = re.search(r"Final Answer:\s*(.*)", reply, re.S)
        if final:
            return {"answer": final[1].strip(), "observations": seen, "steps": step, "confidence": round(min(len(seen) / 3, 1.0) * 0.6 + 0.4, 6)}
        action, given = re.search(r"Action:\s*(.*)", reply), re.search(r"Action Input:\s*(.*)", reply)
        name = action[1].strip() if action else ""
        seen.append(tools[name](given[1].strip() if given else "") if name in tools else f"there is no tool {name}")
        log = f"{log}\n{reply}\nObservation: {seen[-1]}"
    return {"answer": seen[-1] if seen else "", "observations": seen, "steps": max_steps, "confidence": round(min(len(seen) / 3, 1.0) * 0.6 * 0.7, 6)}


def guarded(questions: DataFrame, cache: DataFrame, risk: Callable[[Column], Column], clean: Callable[[Column], Column], answer: Callable[[DataFrame], DataFrame], threshold: float = 0.5, mode: str = "block") -> DataFrame:
    """(qid, status, route, answer, cached, risk, confidence) of questions (qid, text, source).

    Questions over the risk threshold are blocked (or in mode warn only
    marked). The others are cleaned of personal data and looked up in the cache
    (key, answer) by the hash of their cleaned text; what is not cached gets an
    answer from `answer`, a function from (qid, text, source) to (qid, answer),
    which is cleaned and verified against the source.
    """
    q = questions.withColumn("risk", risk(F.col("text"))).withColumn("clean", clean(F.col("text"))).withColumn("key", F.md5(F.lower("clean")))
    blocked = (F.col("risk") >= threshold) & F.lit(mode == "block")
    q = q.withColumn("blocked", blocked).withColumn("route", F.when(F.col("blocked"), "blocked").otherwise(agents.classify(F.col("clean"))))
    held = q.filter("not blocked").join(cache.select("key", F.col("answer").alias("held")), "key", "left")
    hits, rest = held.filter("held is not null"), held.filter("held is null")
    made = answer(rest.select("qid", F.col("clean").alias("text"), "source")).select("qid", clean(F.col("answer")).alias("answer"))
    made = rest.join(made, "qid", "left")
    sure = F.round(agents.overlap(F.coalesce("answer", F.lit("")), F.coalesce("source", F.lit(""))), 6)
    out = made.select("qid", F.lit("answered").alias("status"), "route", "answer", F.lit(False).alias("cached"), "risk", sure.alias("confidence"))
    out = out.unionByName(hits.select("qid", F.lit("answered").alias("status"), "route", F.col("held").alias("answer"), F.lit(True).alias("cached"), "risk", F.lit(1.0).alias("confidence")))
    return out.unionByName(q.filter("blocked").select("qid", F.lit("blocked").alias("status"), "route", F.lit(None).cast("string").alias("answer"), F.lit(False).alias("cached"), "risk", F.lit(0.0).alias("confidence")))


def new_cache_entries(answered: DataFrame, questions: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    """(key, answer) to be added to the cache: one for each new question."""
    keyed = questions.select("qid", F.md5(F.lower(clean(F.col("text")))).alias("key"))
    rows = answered.filter("status = 'answered' and not cached").join(keyed, "qid")
    return rows.groupBy("key").agg(F.min_by("answer", "qid").alias("answer"))


def guarded_statistics(results: DataFrame) -> DataFrame:
    """One row: totals, blocked, the share of cache hits and the mean confidence of what was answered."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "blocked").alias("n_blocked"), F.count_if("cached").alias("n_cached"),
        F.round(F.avg(F.col("cached").cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.when(F.col("status") == "answered", F.col("confidence"))), 6).alias("mean_confidence"),
    )


def grounded(answers: DataFrame, sources: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, grounded, n_unsupported): the supported claims of each answer, in order, put together again."""
    from ..functions.text import sentences, strip

    claims = answers.select("id", F.posexplode(F.filter(sentences("answer"), lambda s: F.length(strip(s)) > 10)).alias("k", "claim"))
    best = claims.join(sources, "id", "left").groupBy("id", "k", "claim").agg(F.max(agents.overlap(F.col("claim"), F.coalesce("source", F.lit("")))).alias("best"))
    ok = F.col("best") >= least
    out = best.groupBy("id").agg(F.sort_array(F.collect_list(F.when(ok, F.struct("k", "claim")))).alias("c"), F.count_if(~ok).alias("n_unsupported"))
    return out.select("id", F.array_join(F.col("c.claim"), " ").alias("grounded"), "n_unsupported")
