"""Similarity join on word n-grams by a MinHash LSH forest (operator 3).

A label of minima a trie; a trie is held as the table of its labels, a node as a prefix, and node sizes are counted by
aggregates, as one sorted run would put a node of a third of all texts into one task. Every text starts at its longest
prefix in each trie and shortens its prefixes, those first whose nodes stay small, until a pair at the threshold is
missed with at most the given chance. The members of the nodes reached are candidates, verified on their full shingle sets.
"""

from __future__ import annotations

from functools import cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, id_filter, map_columns, materialize, only, split_by_filter
from .linking import HOT_ROWS, HOT_SHARE, SALTS, link, numbered, settle

#: Words of a shingle, similarity, tries, hashes of a label, and the share of pairs at the threshold that may be missed.
N, THRESHOLD, TREES, DEPTH, MISS = 5, 0.8, 28, 8, 2e-7
#: Prefixes are shortened to the end where a node has so few members; levels of a label beyond the shortest prefix.
NODE, LEVELS = 64, 4
MEMO = 250_000
_SEED = 20240229


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, miss: float = MISS) -> int:
    """The prefix at which no text need shorten further: a pair at the threshold meets in no trie with a chance of at most ``miss``."""
    while depth > 1 and (1 - threshold**depth) ** trees > miss:
        depth -= 1
    if (1 - threshold**depth) ** trees > miss:
        raise ValueError("the target recall needs more tries")
    return depth


@cache
def _hashes(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    a = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
    return a, b


_words: dict[bytes, int] = {}


def _word(w: bytes) -> int:
    h = xxhash.xxh64_intdigest(w)
    if len(w) <= 64:
        if len(_words) >= MEMO:
            _words.clear()
        _words[w] = h
    return h


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; a text of fewer words, but some, has one run of all."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    get = _words.get
    h = np.array([get(w) or _word(w) for w in words], np.uint64)
    if len(h) < n:
        h = np.concatenate([h, np.zeros(n - len(h), np.uint64)])
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        acc = (acc ^ h[k : k + len(acc)]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def labels(sets: np.ndarray, trees: int = TREES, depth: int = DEPTH, use: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A label a trie: a hash of its first ``use`` minima, and 16 bits of each of the next, at most LEVELS, first ones highest."""
    a, b = _hashes(trees, depth)
    use = depth if use is None else use
    ends = min(depth, use + LEVELS)
    at = np.arange(trees * depth).reshape(trees, depth)[:, :ends].ravel()
    low = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    a, b = a[at, None], b[at, None]
    for s in range(0, len(sets), 512):
        x = sets[None, s : s + 512] * a
        x ^= x >> np.uint64(32)
        x += b
        x *= np.uint64(0xD6E8FEB86659FD93)
        low = np.minimum(low, x.min(1))
    low = low.reshape(trees, ends).T
    head = np.arange(1, trees + 1, dtype=np.uint64)
    for m in low[:use]:
        head = (head ^ m) * np.uint64(0xBF58476D1CE4E5B9)
        head ^= head >> np.uint64(31)
    tail = np.zeros(trees, np.uint64)
    for m in low[use:]:
        tail = tail << np.uint64(16) | m * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
    return head, tail


def jaccard(a: list[bytes], b: list[bytes] | None, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold; exact counts by products of incidence matrices."""
    x = [np.frombuffer(s, np.uint64) for s in a]
    y = x if b is None else [np.frombuffer(s, np.uint64) for s in b]
    nx, ny = np.array([len(s) for s in x], np.int64), np.array([len(s) for s in y], np.int64)
    if len(x) * len(y) <= 64:
        both = np.zeros((len(x), len(y)), np.int64)
        for i, s in enumerate(x):
            for j, t in enumerate(y):
                if b is not None or i < j:
                    both[i, j] = len(s) + len(t) - len(np.union1d(s, t))
        if b is None:
            both += both.T
    else:
        rows = x if b is None else x + y
        flat = np.concatenate(rows)
        _, col, many = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(rows)), [len(s) for s in rows])
        place = np.full(len(many), -1)
        use = np.flatnonzero(many > 1)
        place[use] = np.arange(len(use))
        at = place[col]
        row, at = row[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        both = np.zeros((len(x), len(y)), np.int64)
        for s in range(0, len(use), 4096):
            lo, hi = np.searchsorted(at, [s, s + 4096])
            m = np.zeros((len(rows), min(4096, len(use) - s)), np.float32)
            m[row[lo:hi], at[lo:hi] - s] = 1
            both += (m @ m.T if b is None else m[: len(x)] @ m[len(x) :].T).astype(np.int64)
    union = nx[:, None] + ny[None, :] - both
    return (both > 0) & (both >= threshold * union - 1e-9)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def signatures(df: DataFrame, doc_id: str, text: str, n: int, trees: int, depth: int, use: int) -> DataFrame:
    """(id, t, a, b, size, head, tail): the text's hash, the shingle set's 128-bit hash, its size and its label in each trie."""
    new = [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("size", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("head", "tail"))]

    def make():
        only("shingles", _words.clear)

        def f(texts):
            out: list[list] = [[], [], [], [], []]
            for t in texts:
                s = shingles(t, n)
                h = xxhash.xxh128_intdigest(s.tobytes())
                head, tail = (x.view(np.int64) for x in labels(s, trees, depth, use)) if len(s) else (None, None)
                for o, v in zip(out, (_signed(h >> 64), _signed(h & ((1 << 64) - 1)), len(s), head, tail), strict=True):
                    o.append(v)
            return out

        return f

    src = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
    return map_columns(src, ["text"], new, make, ["id", "t"])


def _sized(rows: DataFrame, nodes: DataFrame, on: list[str], total: int, by: str = "id") -> DataFrame:
    """``rows`` joined to ``nodes`` (``on``, n, ...); the rows of a node with many of them are dealt to SALTS tasks by the column ``by``."""
    # Fewer than HOT_SHARE nodes a level can have more than a HOT_SHARE-th of the rows: a bounded broadcast.
    big = F.col("n") > max(total // HOT_SHARE, HOT_ROWS)
    hot = nodes.where(big).select(*on, F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), on, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("long")).drop("hot")
    salts = F.when(big, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    nodes = nodes.withColumn("salt", F.explode(salts)).withColumn("salt", F.col("salt").cast("long"))
    return rows.join(nodes, [*on, "salt"]).drop("salt")


def forest(ends: DataFrame, total: int, levels: int, use: int, threshold: float, trees: int, miss: float) -> DataFrame:
    """(id, key, bytes) of the nodes to which texts shorten their prefixes. ends: (id, bytes, head, tail), ``total`` rows.

    A text takes in each trie the shortest prefix whose node has at most a bound of members, or its longest one, and
    the least bound, a power of two from NODE, with which the chance to miss a pair at the threshold is at most
    ``miss``. All members of a node that some text has shortened to meet there.
    """
    tops = materialize(ends.groupBy("head").agg(F.count("*").alias("n")).where("n > 1"), "tops")
    meet = materialize(_sized(ends, tops, ["head"], total), "meet")
    small = meet.where(F.col("n") <= NODE).select("id", F.col("head").alias("key"), "bytes")
    wide = meet.where(F.col("n") > NODE)
    rows = wide.count()
    if not rows or not levels:
        return small.union(wide.select("id", F.col("head").alias("key"), "bytes"))
    # Nodes are counted over different labels, each with its number of members, not over the members.
    prefix = F.expr(f"if(level = 0, 0L, shiftrightunsigned(tail, 16 * ({levels} - level)))")
    node, label = ["head", "level", "prefix"], ["head", "tail"]
    some = materialize(wide.groupBy(*label).agg(F.max("n").alias("top"), F.count("*").alias("n")), "labels")
    inner = some.withColumn("level", F.explode(F.array(*map(F.lit, range(1, levels))).cast("array<int>"))).withColumn("prefix", prefix)
    nodes = materialize(inner.groupBy(*node).agg(F.sum("n").alias("n")), "nodes")
    between = _sized(inner.select(*node, "tail"), nodes, node, rows, "tail").groupBy(*label).agg(F.sort_array(F.collect_list(F.struct("level", "n"))).alias("between"))
    sizes = F.concat(F.array("top"), F.coalesce(F.col("between.n"), F.array().cast("array<bigint>")), F.array("n"))
    own = _sized(wide.select("id", *label), some.join(between, label, "left").select(*label, "n", sizes.alias("sizes")), label, rows)
    own = own.groupBy("id").agg(F.collect_list(F.struct(*label, "sizes")).alias("tries"))
    # A trie's share in the logarithm of the chance of a miss, by level; tries without a wide node are at the shortest prefix.
    share = [log(1 - threshold ** (use + k)) for k in range(levels + 1)]
    table = F.array(*map(F.lit, share))
    level = lambda sizes, bound: F.least(F.size(F.filter(sizes, lambda s: s > bound)), F.lit(levels))
    chance = lambda bound: F.lit(trees * share[0]) + F.aggregate("tries", F.lit(0.0), lambda acc, x: acc + F.get(table, level(x["sizes"], bound)) - F.lit(share[0]))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda k: F.lit(float(NODE)) * F.pow(F.lit(2.0), k))
    bound = F.get(F.filter(bounds, lambda x: chance(x) <= F.lit(log(miss) + 1e-9)), F.lit(0))
    asked = own.withColumn("bound", bound).select("bound", F.explode("tries").alias("x")).select(F.col("x.head").alias("head"), F.col("x.tail").alias("tail"), F.col("x.sizes").alias("sizes"), level(F.col("x.sizes"), F.col("bound")).alias("level"))
    asked = materialize(asked.withColumn("prefix", prefix).groupBy(*node).agg(F.max(F.get("sizes", F.col("level"))).alias("n")), "asked")
    # The shortest prefix of a label that any text has shortened to; where there is none, the whole label.
    above = some.select(*label, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).withColumn("prefix", prefix)
    above = _sized(above, asked, node, rows, "tail").groupBy(*label).agg(F.min("level").alias("level"), F.min_by("prefix", "level").alias("prefix"))
    key = F.when(F.col("level") == 0, F.col("head")).otherwise(F.xxhash64("head", F.coalesce("level", F.lit(levels)), F.coalesce("prefix", "tail")))
    reached = _sized(wide.select("id", *label, "bytes"), some.join(above, label, "left").select(*label, "n", key.alias("key")), label, rows)
    return small.union(materialize(reached.select("id", "key", "bytes"), "reached"))


def ngram_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, miss: float = MISS) -> DataFrame:
    """One row a document: doc_id, n_links (other documents with Jaccard >= threshold), component_id, kept.

    Words are separated by ASCII white space and compared as they are. component_id is the smallest doc_id that links
    reach, kept marks it. Documents of equal shingle sets are one class: joined once, counted in full. A null, empty or
    blank text has no shingles and links with nothing. A null doc_id is kept and links with nothing. Where a doc_id
    repeats, each of its rows is a document: it counts its own links, and rows of one doc_id may be in different
    components. Other columns are ignored.
    """
    return _rows(df, doc_id, text, n, threshold, trees, depth, miss).drop("t")


def _rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, miss: float = MISS) -> DataFrame:
    """The rows of ``ngram_join`` with a hash of the text (t)."""
    use = shortest_prefix(threshold, trees, depth, miss)
    sig = materialize(signatures(df, doc_id, text, n, trees, depth, use), "signatures")
    classes = sig.where("size > 0 and id is not null").groupBy("a", "b", "size").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = numbered(classes, "classes")
    labelled = sig.where("size > 0").select(F.col("id").alias("rep"), "a", "b", "size", "head", "tail").join(classes.select("id", "rep", "a", "b", "size"), ["rep", "a", "b", "size"]).dropDuplicates(["id"])
    ends = labelled.select("id", (F.col("size") * 8).alias("bytes"), F.explode(F.arrays_zip("head", "tail")).alias("e")).select("id", "bytes", "e.head", "e.tail")
    keys = forest(ends, classes.count() * trees, min(depth - use, LEVELS), use, threshold, trees, miss)

    def items(need: DataFrame) -> DataFrame:
        # Shingle sets of the candidates only: other texts are passed over while they are read, and no text is shuffled.
        need = materialize(classes.join(need, "id").select("id", "rep", "a", "b", F.col("copies").alias("weight")), "candidates")
        words, bits = id_filter(need.select(F.col("rep").alias("id")), need.count())
        passed = df.sparkSession.sparkContext.broadcast(words)
        rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        rows = rows.where(F.col("id").isNotNull()).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(bits)))

        def sets(batches):
            only("shingles", _words.clear)
            has = passed.value
            for b in batches:
                at = b.column(2).to_numpy()
                b = b.filter(pa.array((has[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
                got = [shingles(t, n).tobytes() for t in b.column(1).to_pylist()]
                hs = [xxhash.xxh128_intdigest(s) for s in got]
                cols = [b.column(0), pa.array([_signed(h >> 64) for h in hs], pa.int64()), pa.array([_signed(h & ((1 << 64) - 1)) for h in hs], pa.int64()), pa.array(got, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "a", "b", "payload"])

        got = rows.mapInArrow(sets, "id long, a long, b long, payload binary")
        got = got.withColumnRenamed("id", "rep")
        return got.join(need, ["rep", "a", "b"]).dropDuplicates(["id"]).select("id", "weight", "payload")

    found = materialize(link(keys, items, lambda a, b: jaccard(a, b, threshold), "ngram"), "links")
    per = settle(classes, found, "ngram").select("a", "b", "n_links", "component_id")
    out = sig.select("id", "t", "a", "b", "size").join(per, ["a", "b"], "left")
    own = F.coalesce("component_id", "id")
    linked = (F.col("size") > 0) & F.col("id").isNotNull()
    return out.select("t", F.col("id").alias("doc_id"), F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(linked, own).otherwise(F.col("id")).alias("component_id"), F.coalesce(~linked | (own == F.col("id")), F.lit(True)).alias("kept"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df``, one document of each component: the smallest doc_id; of its repeated rows, one a text.

    Rows without a doc_id stay. Rows of one doc_id are decided one by one.
    """
    named, mark, turn = free_name(df, "lq_kept_id"), free_name(df, "lq_text_hash"), free_name(df, "lq_turn")
    found = _rows(df, doc_id, text, **how).where("doc_id is not null").groupBy("doc_id", "t").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    unclear = materialize(found.where("not kept or n > 1"), "unclear").withColumnRenamed("doc_id", "id")
    # Rows that surely stay pass as they are read; only the others are shuffled to the decisions on their ids.
    words, bits = id_filter(unclear, unclear.count())
    decided = unclear.select(F.col("id").alias(named), F.col("t").alias(mark), F.col("kept").alias(turn))
    rows = split_by_filter(df, doc_id, words, bits, True)
    rows = rows.join(decided, (F.col(doc_id).cast("long") == F.col(named)) & (F.xxhash64(F.col(text)) == F.col(mark)), "left")
    rows = rows.where(F.coalesce(turn, F.lit(True))).drop(turn, mark).withColumn(mark, F.xxhash64(F.col(text)))
    w = Window.partitionBy(doc_id, mark).orderBy(F.col(text))
    one = rows.withColumn(turn, F.row_number().over(w)).where(F.col(turn) == 1)
    cols = [f"`{c}`" for c in df.columns]
    return split_by_filter(df, doc_id, words, bits, False).unionByName(one.select(*cols))
