"""Operator 8: near-duplicates by an LSH forest over MinHash signatures.

A signature of N_TREES * DEPTH minima is read in several orders, each starting
at another place. In each of N_ORDERS orders all texts are sorted by what they
read, in ranges, and a text is compared with its neighbour: the one with which
it shares the longest prefix. How deep that is follows from how dense the order
is there. Neighbours whose signatures agree well enough are confirmed on full
shingle sets, in two steps: those of the first two orders, and then those of
the others between which no chain of links runs yet. The links give components.

For whole results, texts that share at least DEPTH values in one of N_TREES
orders form a region. Regions in which two or more components remain are
searched across components, with the texts at hand: pairs whose signatures
agree well enough are confirmed on full sets there and then, so only links
leave the task. A region over REGION_LIMIT members or REGION_SHINGLES shingles
is dealt to cells of two blocks, in which the members outside its largest
component meet all its members.

Two texts with a similarity of 0.8 miss each other in all 32 orders at depth 4
with probability 0.59 ** 32 < 1e-7, whatever the sizes of their regions. The
signature filter, four standard deviations below, drops them with probability
of about 5e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_caches, freed, materialize, row_struct, sweep, table, unpack, utf8
from .components import components, extended
from .shingles import MinHash, mix, set_digest, shingles_of

N_TREES, DEPTH = 32, 4
WIDTH = N_TREES * DEPTH
N_ORDERS, FIRST_ORDERS = 8, 2
LEAST_PREFIX = 2
REGION_LIMIT = 4096
REGION_SHINGLES = 1_000_000
PERCENT = 80
#: Most bits in which the signature bytes of a candidate differ: equal minima differ in none, others in 4 of 8 on average,
#: so at 0.8 they are 102 with a standard deviation of 20.
MOST_BITS = 182
#: Partners of one text from which on a region's postings give all its intersections at once.
MANY = 24

_minhash = MinHash(WIDTH)
_TREE = mix(np.arange(1, N_TREES + 1, dtype=np.uint64))
_SIGNED = "id long, text_key binary, n_shingles long, digest binary, keys array<long>, sig binary, packed binary"


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    free_caches()
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        counts, digests, signatures, frames = [], [], [], []
        texts = b.column("text").to_pylist()
        for text, s in zip(texts, shingles_of(texts, k), strict=True):
            counts.append(len(s))
            digests.append(set_digest(s) if len(s) else None)
            frames.append(z.compress(utf8(text)) if len(s) else None)
            if len(s):
                signatures.append(_minhash(s))
        sig = np.array(signatures, np.uint32).reshape(len(signatures), N_TREES, DEPTH)
        acc = np.broadcast_to(_TREE, sig.shape[:2])
        with np.errstate(over="ignore"):
            for d in range(DEPTH):
                acc = mix(acc * np.uint64(5) + sig[:, :, d].astype(np.uint64))
        keys, small = iter(acc.view(np.int64)), iter((sig & np.uint32(255)).astype(np.uint8).reshape(len(sig), WIDTH))
        keys = pa.array([next(keys) if n else None for n in counts], pa.list_(pa.int64()))
        small = pa.array([next(small).tobytes() if n else None for n in counts], pa.binary())
        cols = [b.column("id"), b.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), keys, small, pa.array(frames, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in _SIGNED.split(", ")])


def _similar_sizes(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of signatures, (16, n) words each."""
    return np.bitwise_count(x ^ y).sum(axis=0, dtype=np.uint16)


def _words(sigs: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), WIDTH // 8).T)


def _neighbours(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Adjacent rows of each order with a common prefix of LEAST_PREFIX values or more that may be links."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        own = (b.column("tree").to_numpy(), np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(b.num_rows, WIDTH), b.column("id").to_numpy(), b.column("size").to_numpy())
        tree, key, ids, size = own if held is None else (np.concatenate(x) for x in zip(held, own, strict=True))
        held = tuple(x[-1:] for x in own)
        words = np.ascontiguousarray(np.ascontiguousarray(key).view(np.uint64).T)
        near = (tree[1:] == tree[:-1]) & (key[1:, :LEAST_PREFIX] == key[:-1, :LEAST_PREFIX]).all(axis=1)
        near &= (_bits(words[:, 1:], words[:, :-1]) <= MOST_BITS) & _similar_sizes(size[1:], size[:-1], percent) & (ids[1:] != ids[:-1])
        at = np.flatnonzero(near)
        x, y = ids[at], ids[at + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(tree[at])], ["a", "b", "tree"])


def _are_similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _sets(frames: list[bytes], k: int) -> list[np.ndarray]:
    """The shingle sets of packed texts."""
    return list(shingles_of([raw.decode("utf-8", "surrogatepass") for raw in unpack(pa.array(frames, pa.binary()))], k))


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        frames = list(dict.fromkeys([*b.column("packed_a").to_pylist(), *b.column("packed_b").to_pylist()]))
        sets = dict(zip(frames, _sets(frames, k), strict=True))
        keep = pa.array([_are_similar(sets[x], sets[y], percent) for x, y in zip(b.column("packed_a").to_pylist(), b.column("packed_b").to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


class _Members:
    """Rows of whole regions or cells, one group after another: signatures, shared regions, and sets as they are needed."""

    def __init__(self, columns: dict[str, np.ndarray], k: int, percent: int):
        self.k, self.percent = k, percent
        self.ids, self.size, self.label, self.tree = (columns[c] for c in ("id", "size", "component", "tree"))
        self.left, self.right = columns["left"], columns["right"]
        self.words, self.keys, self.frames = np.ascontiguousarray(columns["sig"].T), columns["keys"], columns["packed"]
        self.sets: dict[bytes, np.ndarray] = {}

    def able(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows may be links between components and meet here first: not in a region of an earlier tree."""
        ok = (self.label[i] != self.label[j]) & (self.ids[i] != self.ids[j]) & _similar_sizes(self.size[i], self.size[j], self.percent)
        at = np.flatnonzero(ok)
        i, j = (np.broadcast_to(x, ok.shape)[at] for x in (i, j))
        near = _bits(self.words[:, i], self.words[:, j]) <= MOST_BITS
        at, i, j = at[near], i[near], j[near]
        same = (self.keys[i] == self.keys[j]) & (self.keys[i] != NO_KEY)
        first = np.where(same.any(axis=1), same.argmax(axis=1), N_TREES)
        return at[first >= self.tree[i]]

    def fetch(self, rows: np.ndarray) -> None:
        missing = list({self.frames[r]: None for r in rows.tolist() if self.frames[r] not in self.sets})
        self.sets |= dict(zip(missing, _sets(missing, self.k), strict=True))

    def similar(self, i: int, j: int) -> bool:
        return _are_similar(self.sets[self.frames[i]], self.sets[self.frames[j]], self.percent)

    def small(self, starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Links of groups of `n` rows, all their pairs at once."""
        x, y = np.triu_indices(n, 1)
        i, j = (starts[:, None] + x).ravel(), (starts[:, None] + y).ravel()
        meet = (self.left[i] & self.right[j]) | (self.left[j] & self.right[i])
        i, j = i[meet], j[meet]
        at = self.able(i, j)
        i, j = i[at], j[at]
        self.fetch(np.concatenate([i, j]))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if self.similar(a, b):
                yield a, b

    def large(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """Links of one group, as many as its components need to be joined."""
        right, label = self.right[lo:hi].copy(), self.label
        postings = None
        for i in np.flatnonzero(self.left[lo:hi]).tolist():
            right[i] = False  # each pair once
            j = lo + np.flatnonzero(right)
            j = j[self.able(np.full(1, lo + i), j)]
            if not len(j):
                continue
            self.fetch(np.append(j, lo + i))
            if len(j) > MANY:
                if postings is None:
                    postings = self._postings(lo, hi)
                both = self._shared(lo, hi, lo + i, *postings)[j - lo]
                j = j[100 * both >= self.percent * (self.size[j] + self.size[lo + i] - both)]
                exact = True
            else:
                exact = False
            for b in j.tolist():
                if label[lo + i] != label[b] and (exact or self.similar(lo + i, b)):
                    yield lo + i, b
                    own = label[lo:hi]
                    own[own == label[b]] = label[lo + i]

    def _postings(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        self.fetch(np.arange(lo, hi))
        every = np.concatenate([self.sets[self.frames[r]] for r in range(lo, hi)])
        order = np.argsort(every, kind="stable")
        return every[order], np.repeat(np.arange(hi - lo), [len(self.sets[self.frames[r]]) for r in range(lo, hi)])[order]

    def _shared(self, lo: int, hi: int, i: int, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The sizes of the intersections of the set of row i with all sets of its group."""
        own = self.sets[self.frames[i]]
        first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        counts = last - first
        places = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.bincount(owner[places], minlength=hi - lo)


#: Ids up to this number (16 MB) go to all tasks, so that only the texts asked for are shuffled; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def _asked(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


#: A shared region that is not known, of ids that repeat.
NO_KEY = 0
SMALL = 12


def _columns_of(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    n = b.num_rows
    plain = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "id", "component", "size", "tree", "left", "right")}
    frames = np.empty(n, object)
    frames[:] = b.column("packed").to_pylist()
    wide = {"sig": np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(n, WIDTH // 8), "keys": np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint32).reshape(n, N_TREES)}
    return plain | wide | {"packed": frames}


def _search(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted regions or cells (key, i, j); a group that goes on in the next batch waits for it."""

    def links(columns: dict[str, np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        members = _Members(columns, k, percent)
        sizes = np.diff(bounds)
        found: list[tuple[int, int]] = []
        for n in np.unique(sizes).tolist():
            starts = bounds[:-1][sizes == n]
            if 1 < n <= SMALL:
                found += members.small(starts, n)
            elif n > 1:
                for lo in starts.tolist():
                    found += members.large(lo, lo + n)
                    members.sets.clear()
        x, y = (members.ids[np.array([f[c] for f in found], np.int64)] for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = _columns_of(b)
        if held and all(held[-1][c][-1] == now[c][0] == now[c][-1] for c in ("key", "i", "j")):
            held.append(now)
            continue
        every = [*held, now]
        columns = {c: np.concatenate([x[c] for x in every]) for c in now}
        new = np.any([columns[c][1:] != columns[c][:-1] for c in ("key", "i", "j")], axis=0)
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(bounds) > 1:
            yield links({c: v[: bounds[-1]] for c, v in columns.items()}, bounds)
        held = [{c: v[bounds[-1] :] for c, v in columns.items()}]
    if held:
        columns = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        yield links(columns, np.array([0, len(columns["id"])]))


def _text_key(text: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


class Forest:
    """The steps over one table of (id, text)."""

    def __init__(self, rows: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        keyed = rows.withColumn("text_key", _text_key("text"))
        self.signed = materialize(keyed.mapInArrow(freed(lambda bs: _signed(bs, k)), _SIGNED), "signatures")
        self.rows = materialize(self.signed.select("id", "text_key", "n_shingles", "digest"), "shingle-counts")
        found = self.signed.filter("digest is not null")
        classes = found.groupBy("digest").agg(F.min("id").alias("rep")).filter("rep is not null")
        self.classes = materialize(classes, "classes")
        # copies of a text are one node; its text is fetched when it is needed
        own = found.select("id", "digest", "keys", "sig", F.col("n_shingles").alias("size")).join(self.classes, "digest").filter("id = rep")
        self.nodes = materialize(own.select("id", "keys", "sig", "size").dropDuplicates(["id", "sig"]), "nodes")

    def _texts(self, ids: DataFrame) -> DataFrame:
        """(id, packed) of the given ids."""
        return self.signed.filter("packed is not null").select("id", "packed").join(ids, "id", "left_semi").distinct()

    def neighbours(self) -> DataFrame:
        """(a, b, tree): neighbours in the sorted orders that may be links."""
        starts = [o * (WIDTH // N_ORDERS) for o in range(N_ORDERS)]
        read = F.array(*[F.concat(F.substring("sig", o + 1, WIDTH - o), F.substring("sig", 1, o)) if o else F.col("sig") for o in starts])
        orders = self.nodes.select("id", "size", F.posexplode(read).alias("tree", "key"))
        orders = orders.repartitionByRange("tree", "key").sortWithinPartitions("tree", "key", "id")
        percent = self.percent
        return orders.mapInArrow(freed(lambda bs: _neighbours(bs, percent)), "a long, b long, tree int")

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold on the full sets."""
        k, percent = self.k, self.percent
        both = pairs.select("a", "b").distinct().join(texts.select(F.col("id").alias("a"), F.col("packed").alias("packed_a")), "a")
        both = both.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("packed_b")), "b")
        return materialize(both.mapInArrow(freed(lambda bs: _confirmed(bs, k, percent)), "a long, b long").distinct(), "links")

    def run(self) -> DataFrame:
        """(node, component) of all linked classes. Signatures and texts are deleted when they are not read any more."""
        spark = self.nodes.sparkSession
        near = materialize(self.neighbours(), "neighbours")
        sweep(spark)
        texts = materialize(self._texts(_asked(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())), "neighbour-texts")
        found = components(self.confirmed(near.filter(F.col("tree") < FIRST_ORDERS), texts))
        more = near.filter(F.col("tree") >= FIRST_ORDERS)
        for end in ("a", "b"):
            more = more.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        apart = more.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        found = extended(found, self.confirmed(apart, texts))
        for used in (near, texts):
            discard(spark, used)
        sweep(spark)
        found = extended(found, self.across(found))
        for used in (self.signed, self.nodes):
            discard(spark, used)
        sweep(spark)
        return found

    def across(self, found: DataFrame) -> DataFrame:
        """Links between the components `found`, from all regions that hold two or more of them."""
        named = self.nodes.select("id", "size", "keys").join(found.withColumnRenamed("node", "id"), "id", "left")
        spread = named.select("id", "size", F.coalesce("component", "id").alias("component"), F.posexplode("keys").alias("tree", "key"))
        regions = spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
        regions = materialize(regions.filter("lo <> hi").select("key", "n", "shingles"), "open-regions")
        rest = materialize(spread.select("key", "tree", "id", "component").join(regions, "key"), "open-members")
        ids = _asked(rest.select("id").distinct())
        # the low halves of all region keys tell in which tree two texts meet first; an id that repeats has none
        half = F.transform("keys", lambda x: F.substring(F.unhex(F.lpad(F.hex(x), 16, "0")), 5, 4))
        repeats = self.nodes.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("id", "times")
        full = self.nodes.join(ids, "id", "left_semi").join(repeats, "id", "left")
        joined = F.when(F.col("times").isNull(), F.aggregate(half, F.expr("X''"), lambda acc, x: F.concat(acc, x))).otherwise(F.lit(bytes(4 * N_TREES)))
        full = full.select("id", "sig", "size", joined.alias("keys")).join(self._texts(ids), "id")
        blocks = F.ceil(F.greatest(F.col("n") / REGION_LIMIT, F.col("shingles") / REGION_SHINGLES))
        members, rest = rest, materialize(rest.withColumn("blocks", blocks).drop("n", "shingles").join(full, "id"), "open-texts")
        for used in (regions, members):
            discard(rest.sparkSession, used)
        sweep(rest.sparkSession)
        zero, yes = F.lit(0).cast("long"), F.lit(True)
        whole = rest.filter("blocks = 1").withColumns({"i": zero, "j": zero, "left": yes, "right": yes})
        big = rest.filter("blocks > 1")
        main = big.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "component")).alias("m"))
        big = big.join(main.select("key", F.col("m.component").alias("main")), "key").withColumn("at", F.pmod(F.xxhash64("id"), "blocks"))
        outside, every = F.col("component") != F.col("main"), F.sequence(zero, F.col("blocks") - 1)
        # a member is on the right of the cells (i, at), and outside the main component on the left of the cells (at, j)
        right = big.withColumns({"j": F.col("at"), "i": F.explode(every), "right": yes}).withColumn("left", outside & (F.col("i") == F.col("at")))
        left = big.filter(outside).withColumns({"i": F.col("at"), "j": F.explode(every), "right": F.lit(False), "left": yes}).filter("i <> j")
        cells = whole.unionByName(right.unionByName(left).drop("at", "main")).drop("blocks")
        cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        k, percent = self.k, self.percent
        links = materialize(cells.mapInArrow(freed(lambda bs: _search(bs, k, percent)), "a long, b long"), "links")
        discard(rest.sparkSession, rest)
        return links


def near_duplicates(docs: DataFrame, k: int, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key), one row per row of docs; text_key is the MD5 of the text.

    Texts with equal shingle sets are one class, whose smallest id stands for
    it, so copies never meet in pairs. A null text, or one without words, has no
    shingles and links with nothing. A row with a null id takes its class's
    component; where that has no id either, the component is null and the row
    kept. Rows that repeat an id are one node.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    forest = Forest(rows, k, percent)
    found = forest.run()
    of_class = forest.classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("class_component"))
    out = forest.rows.join(of_class, "digest", "left")
    component = F.coalesce("class_component", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their group; of rows that repeat an id one stays. Null ids stay unless their group has an id."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    rows = docs.select(row_struct(docs), F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("text_key"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    return out.filter("id is not null").dropDuplicates(["id"]).unionByName(out.filter("id is null")).select("row.*")


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2).drop("text_key")


QUERIES = {"op8_minhash_forest": op8_minhash_forest}
SQL: dict[str, str] = {}
