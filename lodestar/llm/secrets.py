"""Operator 6: secret scans, in DataFrame operations only.

Base rules find assignments, access keys and long hexadecimal runs. Beside
them, every other long token is scored by two character Markov models, one of
random strings and one of ordinary identifiers: the mean log-likelihood ratio
of its character transitions decides. Both models are trained here, from
labelled samples, as counts of character pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of these classes are found whole, so a minimum in the pattern drops the same matches as a later test.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_LLR = 0.7  # nats a character
N_RANDOM, N_IDENTIFIERS = 4000, 4000

# Parts of ordinary identifiers for the labelled sample.
PARTS = (
    "get set add remove user name value index list item count number total first last next prev start end begin stop open close read write "
    "file path data base table row column key map hash array string buffer stream input output error message event handler request response "
    "server client session config option default parse format build create delete update insert select order group filter join sort merge "
    "width height size length color style button window view model controller service factory manager test check valid enable disable"
).split()


def labelled_samples(spark: SparkSession, n_random: int = N_RANDOM, n_identifiers: int = N_IDENTIFIERS) -> DataFrame:
    """(text, random): a bounded labelled sample, the same on every call.

    Random strings are base-64 and hexadecimal digests of a counter, and
    upper-case variants; identifiers join two to five ordinary parts in snake,
    camel, kebab, path or constant style, sometimes with a number.
    """
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    raw = F.unhex(digest)
    kind = F.pmod("id", F.lit(4))
    text = (
        F.when(kind == 0, F.substring(F.base64(raw), 1, 48))
        .when(kind == 1, F.substring(digest, 1, 48))
        .when(kind == 2, F.upper(F.substring(F.base64(raw), 1, 48)))
        .otherwise(F.regexp_replace(F.substring(F.base64(raw), 1, 60), "[+/=]", ""))
    )
    random = spark.range(n_random).select(text.alias("text"), F.lit(True).alias("random"))
    words = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda k: F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))).cast("int"))
    parts = F.slice(F.array(*[pick(k) for k in range(5)]), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)) + 2).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(6))
    camel = F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")
    number = F.when(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(5)) == 0, F.pmod(F.xxhash64("id", F.lit(12)), F.lit(100)).cast("string")).otherwise("")
    ident = (
        F.when(style == 0, F.array_join(parts, "_"))
        .when(style == 1, camel)
        .when(style == 2, F.array_join(parts, "-"))
        .when(style == 3, F.array_join(parts, "/"))
        .when(style == 4, F.upper(F.array_join(parts, "_")))
        .otherwise(F.array_join(parts, ""))
    )
    plain = spark.range(n_identifiers).select(F.concat(ident, number).alias("text"), F.lit(False).alias("random"))
    return random.unionByName(plain)


def train(samples: DataFrame) -> DataFrame:
    """One row with `llr`: for each pair of characters the log-ratio of their transition probabilities.

    Add-one smoothing over the alphabet and one class for all other characters;
    the array has (len(ALPHABET) + 1) ** 2 entries, whatever the sample.
    """
    c = len(ALPHABET) + 1
    codes = samples.filter("length(text) > 1").select("random", F.expr(f"transform(split(text, ''), x -> locate(x, '{ALPHABET}'))").alias("q"))
    pairs = codes.select("random", F.explode(F.expr(f"zip_with(slice(q, 1, size(q) - 1), slice(q, 2, size(q) - 1), (a, b) -> a * {c} + b)")).alias("pair"))
    every = samples.sparkSession.range(c * c).select(F.col("id").alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    full = every.join(F.broadcast(counts), "pair", "left").select("pair", F.floor(F.col("pair") / c).alias("a"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    sums = full.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    ratio = F.ln((F.col("r") + 1) / (F.col("ra") + c)) - F.ln((F.col("o") + 1) / (F.col("oa") + c))
    rows = full.join(F.broadcast(sums), "a").select("pair", ratio.alias("v"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("pair", "v"))).alias("x")).select(F.col("x.v").alias("llr"))


def log_ratio(text: str, llr: str = "llr") -> str:
    """SQL for the mean log-likelihood ratio of a string's character transitions; the string is split once."""
    c = len(ALPHABET) + 1
    codes = f"transform(split({text}, ''), x -> locate(x, '{ALPHABET}'))"
    total = f"aggregate(zip_with(slice(q, 1, size(q) - 1), slice(q, 2, size(q) - 1), (a, b) -> a * {c} + b), 0D, (s, pair) -> s + get({llr}, pair))"
    return f"transform(array({codes}), q -> {total} / (size(q) - 1))[0]"


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string>>"
#: Matches that are put together at a time, so that a text of very many costs little more for each.
CHUNK = 256


def _spans(kind: str, rank: int, pattern: str, value: str | None = None) -> Column:
    """array<struct<start, rank, kind, end, text>> of all matches of `pattern` in `text`, in code points."""
    sql_pattern = "r'" + pattern.replace("'", "\\x27") + "'"
    group = f"regexp_extract_all(text, {sql_pattern}, 2)" if value else "cast(null as array<string>)"
    long_enough = f"length(get(q.v, i - 1)) >= {MIN_ASSIGNED}" if value else "true"
    one = f"""
      (s, i) -> struct(
        s.at + length(get(q.m, i - 1)) + length(get(q.p, i)) as at,
        concat(s.xs, if({long_enough},
          array(struct(s.at as start, {rank} as rank, '{kind}' as kind, s.at + length(get(q.m, i - 1)) as end, get(q.m, i - 1) as text)),
          cast(array() as {_SPAN}))) as xs)"""
    chunk = f"aggregate(sequence(c * {CHUNK} + 1, least(size(q.m), (c + 1) * {CHUNK})), struct(t.at as at, cast(array() as {_SPAN}) as xs), {one})"
    found = f"""
    aggregate(
      sequence(0, cast((size(q.m) - 1) div {CHUNK} as int)),
      struct(length(get(q.p, 0)) as at, cast(array() as array<{_SPAN}>) as xss),
      (t, c) -> transform(array({chunk}), r -> struct(r.at as at, concat(t.xss, array(r.xs)) as xss))[0],
      t -> flatten(t.xss))"""
    bound = f"transform(array(struct(regexp_extract_all(text, {sql_pattern}, 0) as m, split(text, {sql_pattern}, -1) as p, {group} as v)), q -> {found})[0]"
    return F.expr(f"if(text rlike {sql_pattern}, {bound}, cast(array() as {_SPAN}))")


def scan(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """One row per row of `docs`: doc_id, base and markov (arrays of start, rank, kind, end, text), by start, then kind.

    Offsets are code points, ends exclusive. A null text counts as empty and
    has no spans. Markov spans are tokens of 20 or more characters whose mean
    log-ratio is at least `min_llr` and which overlap no base span. Rows are
    scanned one by one: repeated rows and null ids are reported as they are.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sort_array(F.concat(_spans("assign", 0, ASSIGN, "v"), _spans("access", 1, ACCESS), _spans("hex", 2, HEX))).alias("base"), _spans("markov", 3, TOKEN).alias("tokens"))
    rows = rows.crossJoin(F.broadcast(model))  # one row of fixed length
    free = "filter(tokens, t -> not exists(base, b -> b.start < t.end and t.start < b.end))"
    scored = f"filter({free}, t -> {log_ratio('t.text')} >= {min_llr})"
    return rows.select("doc_id", "base", F.when(F.size("tokens") > 0, F.expr(scored)).otherwise(F.col("tokens")).alias("markov"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(labelled_samples(spark)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "markov"))).alias("spans"),
    )


QUERIES = {"op6_secrets": op6_secrets}
SQL: dict[str, str] = {}
