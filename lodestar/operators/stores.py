"""Caches, conversation memory, chat store, usage ledger, traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import dense

# Dollars per million input and output tokens.
GENERATION_PRICES = {
    "gpt-5.4": (2.50, 10.00),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "o3-mini": (1.10, 4.40),
    "claude-4.6": (3.00, 15.00),
    "claude-4": (3.00, 15.00),
    "claude-3.5-sonnet": (3.00, 15.00),
    "claude-3-haiku": (0.25, 1.25),
    "gemini-3.1": (1.25, 5.00),
    "gemini-2.5-pro": (1.25, 10.00),
    "gemini-2.5-flash": (0.15, 0.60),
    "ollama": (0.0, 0.0),
    "gemma": (0.0, 0.0),
    "llama": (0.0, 0.0),
    "qwen": (0.0, 0.0),
    "deepseek": (0.0, 0.0),
    "phi": (0.0, 0.0),
    "mistral-small": (0.0, 0.0),
}


def semantic_lookup(queries: DataFrame, cache: DataFrame, now: Column, threshold: float = 0.95, ttl: str | None = "1 hour") -> DataFrame:
    """(qid, entry_id, similarity): the best live entry over the threshold, and over 0.

    queries (qid, embedding), cache (entry_id, embedding, ts). Entries that have
    expired are left out before any vector is read; the search is that of
    exact retrieval, in blocks, with one result a query.
    """
    live = cache.filter(F.col("ts") > now - F.expr(f"interval {ttl}")) if ttl else cache
    best = dense(live.select(F.col("entry_id").alias("doc_id"), "embedding"), queries, 1)
    found = best.filter((F.col("score") >= threshold) & (F.col("score") > 0))
    return found.select("qid", F.col("doc_id").alias("entry_id"), F.col("score").alias("similarity"))


def store_entries(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries; equal queries are not merged."""
    return cache.unionByName(new)


def count_hits(lookups: DataFrame) -> DataFrame:
    """(entry_id, hits) of lookups (qid, entry_id)."""
    return lookups.groupBy("entry_id").agg(F.count(F.lit(1)).alias("hits"))


def lookup_statistics(queries: DataFrame, found: DataFrame, key: str = "qid") -> DataFrame:
    """One row: hits, misses and the hit rate of queries against what a lookup found for them."""
    rows = queries.select(key).join(found.select(key).distinct().withColumn("hit", F.lit(1)), key, "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return rows.select("hits", (F.col("total") - F.col("hits")).alias("misses"), F.round(F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)), 6).alias("hit_rate"))


def evict(cache: DataFrame, now: Column, ttl: str, size: int) -> DataFrame:
    """Live entries, the newest `size` of them."""
    live = cache.filter(F.col("ts") > now - F.expr(f"interval {ttl}"))
    return live.orderBy(F.col("ts").desc(), "entry_id").limit(size)


def embedding_cache(texts: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached vector, rows that are missing) by the hash of the text."""
    keyed = texts.withColumn("key", F.md5("text"))
    return keyed.join(cached, "key"), keyed.join(cached, "key", "left_anti")


def cached_embed(texts: DataFrame, cached: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, vector) of all texts: cached ones, and those that `embed` gives for the missing (key, text), each text once."""
    held, missing = embedding_cache(texts, cached)
    fresh = embed(missing.select("key", "text").distinct())
    return held.select("key", "vector").unionByName(fresh.select("key", "vector")).distinct()


def recent(messages: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def history(messages: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, history): the last n messages, assistants' cut to 200 characters."""
    text = F.when((F.col("role") == "assistant") & (F.length("text") > 200), F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.initcap("role"), F.lit(": "), text)
    rows = recent(messages, n).select("conv_id", F.struct("turn", line.alias("line")).alias("m"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["line"]), "\n").alias("history"))


def conversation_list(conversations: DataFrame, messages: DataFrame, limit: int = 100) -> DataFrame:
    """Conversations (conv_id, title, updated_at) with their numbers of messages, newest first."""
    n = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    out = conversations.join(n, "conv_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    return out.orderBy(F.col("updated_at").desc(), "conv_id").limit(limit)


def delete_conversation(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("conv_id").distinct()
    return conversations.join(ids, "conv_id", "left_anti"), messages.join(ids, "conv_id", "left_anti")


def create_conversations(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """With new conversations (conv_id, title, updated_at); an untitled one is a new chat."""
    return conversations.unionByName(new.withColumn("title", F.coalesce("title", F.lit("New chat"))))


def rename_conversations(conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """With the new titles (conv_id, title); others stay."""
    return conversations.join(titles.select("conv_id", F.col("title").alias("_t")), "conv_id", "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")


def add_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame, order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """Both tables with new messages of known conversations, whose updated_at moves on."""
    known = new.join(conversations.select("conv_id"), "conv_id", "left_semi")
    last = known.groupBy("conv_id").agg(F.max(order).alias("_u"))
    touched = conversations.join(last, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("_u", "updated_at"))).drop("_u")
    return touched, messages.unionByName(known.select(messages.columns))


def get_conversations(conversations: DataFrame, messages: DataFrame, ids: DataFrame, order: str = "turn") -> DataFrame:
    """(conv_id, title, messages): each asked conversation with its messages in order, none for an empty one."""
    rows = F.sort_array(F.collect_list(F.struct(order, "role", "text")))
    asked = conversations.join(ids.select("conv_id").distinct(), "conv_id", "left_semi")
    held = messages.join(ids.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(rows.alias("messages"))
    return asked.join(held, "conv_id", "left").select("conv_id", "title", "messages")


def message_counts(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, n_user)."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"))


def budget_left(usage: DataFrame, budget: float) -> DataFrame:
    """One row: total_usd, remaining_usd (never below 0) and whether the budget is spent."""
    out = usage.agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_usd"))
    return out.select("total_usd", F.round(F.greatest(F.lit(0.0), budget - F.col("total_usd")), 6).alias("remaining_usd"), (F.col("total_usd") >= budget).alias("spent"))


def span_children(spans: DataFrame) -> DataFrame:
    """(span_id, n_children, children_ms) of spans (span_id, parent_id, start, end) that others name as their parent."""
    child = spans.select(F.col("parent_id").alias("span_id"), (F.col("end") - F.col("start")).alias("ms"))
    return spans.select("span_id").join(child, "span_id").groupBy("span_id").agg(F.count(F.lit(1)).alias("n_children"), F.round(F.sum("ms"), 6).alias("children_ms"))


def trace_json(spans: DataFrame) -> DataFrame:
    """(trace_id, value): each trace's spans in order as one JSON text."""
    rows = F.sort_array(F.collect_list(F.struct("start", "span_id", "name", "end", "status")))
    return spans.groupBy("trace_id").agg(F.to_json(rows).alias("value"))


def priced(usage: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds cost_usd to (model, prompt_tokens, completion_tokens); the longest model name contained wins, unknown models are free."""
    options = sorted((prices or GENERATION_PRICES).items(), key=lambda x: -len(x[0]))
    cost_in, cost_out = F.lit(0.0), F.lit(0.0)
    for name, (i, o) in reversed(options):
        hit = F.contains(F.lower("model"), F.lit(name))
        cost_in, cost_out = F.when(hit, i).otherwise(cost_in), F.when(hit, o).otherwise(cost_out)
    return usage.withColumn("cost_usd", (F.col("prompt_tokens") * cost_in + F.col("completion_tokens") * cost_out) / 1e6)


def cost_rollup(usage: DataFrame) -> DataFrame:
    """Totals by model and operation, with subtotals."""
    total = usage.rollup("model", "operation").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count(F.lit(1)).alias("calls"))
    return total.select(F.coalesce("model", F.lit("*")).alias("model"), F.coalesce("operation", F.lit("*")).alias("operation"), "prompt_tokens", "completion_tokens", "cost_usd", "calls")


def traces(spans: DataFrame) -> DataFrame:
    """(trace_id, n_spans, total_ms, n_errors) of spans (trace_id, start, end, status)."""
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_spans"), F.round(F.max("end") - F.min("start"), 6).alias("total_ms"), F.count_if(F.col("status") == "error").alias("n_errors"))


def otlp(spans: DataFrame) -> DataFrame:
    """Spans as JSON lines of the OTLP shape."""
    attrs = F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    body = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), "name", (F.col("start") * 1e6).cast("long").alias("startTimeUnixNano"), (F.col("end") * 1e6).cast("long").alias("endTimeUnixNano"), attrs.alias("attributes"))
    return spans.select(F.to_json(body).alias("value"))
