"""From candidate keys to verified links: blocks of bounded size, no pair leaves a task.

Items share a key where a filter (a signature prefix, a spherical cap) says they may be close. A key's members are
dealt into blocks, every two blocks of a key meet in one task, and a task emits a count and a root per item, never
a pair. So rows stay in proportion to items even where a third of the table is one group of near copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Members, and payload bytes, that a block may hold; a task reads two blocks.
BLOCK_ROWS, BLOCK_BYTES = 1024, 24 << 20
#: A node with more than so large a part of all edges, and so many, is dealt to SALTS tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 128, 64


def link(keys: DataFrame, items: DataFrame, verify, name: str) -> DataFrame:
    """Verified links between items that share a key.

    keys: (id long, key long, bytes long), distinct in (id, key). items: (id long, weight long, payload binary), one
    row an id, or a function that gives it for a DataFrame (id) of the items that any task needs.
    verify(a: list[bytes], b: list[bytes] | None) gives a boolean matrix; b None asks for a against itself.
    Returns (id, n_links, root): for each item with a link, the summed weight of the items it links with, and an id
    of its component that is smaller or its own (edges for ``components``), one row per task and item.
    """
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")).where("n > 1")
    # Keys with the same members say the same: one of them stays.
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    buckets = buckets.select("key", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = materialize(keys.select("id", "key").join(buckets, "key"), f"{name}-members")
    own = members.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("own"))
    if callable(items):
        items = items(own.select("id"))
    mine = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    tasks = members.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("id", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    rows = tasks.join(items.join(own, "id"), "id")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "task").sortWithinPartitions("task", "key", "i", "j", "block", "id").select("key", "i", "j", "block", "id", "weight", "own", "payload")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                t = pa.Table.from_batches(held)
                k = [t.column(c).to_numpy() for c in ("key", "i", "j")]
                new = np.flatnonzero((np.diff(k[0]) != 0) | (np.diff(k[1]) != 0) | (np.diff(k[2]) != 0)) + 1
                if len(new):
                    yield from _results(t.slice(0, int(new[-1])), np.concatenate([[0], new]), verify)
                    held = t.slice(int(new[-1])).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from _results(t, np.array([0, t.num_rows]), verify)

    return rows.mapInArrow(run, "id long, n_links long, root long")


def _results(t: pa.Table, cuts: np.ndarray, verify):
    ids, weight, block, i, j, key = (t.column(c).to_numpy() for c in ("id", "weight", "block", "i", "j", "key"))
    own, payload = t.column("own").to_pylist(), t.column("payload").to_pylist()
    out: tuple[list, list, list] = ([], [], [])
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z - a < 2:
            continue
        if i[a] == j[a]:
            x = y = np.arange(a, z)
            hit = np.asarray(verify(payload[a:z], None)).copy()
            np.fill_diagonal(hit, False)
        else:
            x, y = a + np.flatnonzero(block[a:z] == i[a]), a + np.flatnonzero(block[a:z] == j[a])
            if not len(x) or not len(y):
                continue
            hit = np.asarray(verify([payload[k] for k in x], [payload[k] for k in y]))
        p, q = np.nonzero(hit)
        if not len(p):
            continue
        first = _first(own, x, y, p, q, key[a])
        links = np.zeros(z - a, np.int64)
        np.add.at(links, x[p[first]] - a, weight[y[q[first]]])
        if x is not y:
            np.add.at(links, y[q[first]] - a, weight[x[p[first]]])
        root = _roots(x[p] - a, y[q] - a, ids[a:z])
        seen = np.unique(np.concatenate([x[p], y[q]])) - a
        out[0].extend(ids[a + seen].tolist())
        out[1].extend(links[seen].tolist())
        out[2].extend(root[seen].tolist())
        if len(out[0]) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "n_links", "root"])
            out = ([], [], [])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "n_links", "root"])


def _first(own: list, x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, key: int) -> np.ndarray:
    """Which pairs have no smaller key in common: a pair that meets under several keys counts under the smallest."""
    if len(p) <= 16:
        sets: dict = {}
        get = lambda k: sets.get(k) or sets.setdefault(k, frozenset(own[k]))
        return np.array([min(get(a) & get(b)) == key for a, b in zip(x[p].tolist(), y[q].tolist(), strict=True)], bool)
    # Members by smaller keys: one product of incidence matrices counts the smaller keys that two members share.
    lists = [[k for k in own[r] if k < key] for r in np.concatenate([x, y])]
    flat = np.array([k for ks in lists for k in ks], np.int64)
    if not len(flat):
        return np.ones(len(p), bool)
    _, col, many = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), [len(ks) for ks in lists])
    shared = np.zeros((len(x), len(y)), np.float32)
    use = np.flatnonzero(many > 1)
    place = np.full(len(many), -1)
    place[use] = np.arange(len(use))
    for s in range(0, len(use), 4096):
        m = np.zeros((len(lists), min(4096, len(use) - s)), np.float32)
        at = place[col] - s
        ok = (place[col] >= 0) & (at >= 0) & (at < m.shape[1])
        m[row[ok], at[ok]] = 1
        shared += m[: len(x)] @ m[len(x) :].T
    return shared[p, q] == 0


def _roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each member reaches, by repeated minima over the links and pointer jumps."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    lab = rank.copy()
    while True:
        old = lab.copy()
        np.minimum.at(lab, a, old[b])
        np.minimum.at(lab, b, old[a])
        lab = np.minimum(lab, lab[order[lab]])
        if (lab == old).all():
            return ids[order[lab]]


def numbered(classes: DataFrame, name: str) -> DataFrame:
    """``classes`` with an id of their own (id long): doc ids repeat, and two classes may share their smallest one.

    The numbers hold because the table is written once and read back.
    """
    return materialize(classes.withColumn("id", F.monotonically_increasing_id()), name)


def settle(classes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``classes`` (id, rep, copies, ...) with n_links and component_id, the smallest rep of a component, from ``link``'s rows."""
    links = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    comp = components(found.select("id", "root"), name)
    per = materialize(classes.join(links, "id", "left").join(comp, "id", "left").withColumn("root", F.coalesce("component_id", "id")).drop("component_id"), f"{name}-per")
    low = per.groupBy("root").agg(F.min("rep").alias("component_id"))
    return per.join(low, "root").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0))).drop("root", "links", "id", "copies", "rep")


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of (id, root) by alternating large-star and small-star steps: (id, component_id).

    Each round is written to the shared folder, until every id has one edge and no id that it leads to has an edge on;
    the driver sees counts, never an edge.
    """
    e = materialize(edges.where("id <> root").select(F.greatest("id", "root").alias("u"), F.least("id", "root").alias("v")).distinct(), f"{name}-edges")
    rows = e.count()
    for k in range(rounds):
        both = _with_least(e.union(e.select("v", "u")), 2 * rows).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large, rows).select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), "m"), F.struct("u", "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        e = materialize(small.where("u <> v").distinct(), f"{name}-edges{k}")
        rows, ids = e.agg(F.count("*"), F.count_distinct("u")).first()
        ends = e.select("v").distinct()
        if rows == ids and ends.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    raise RuntimeError(f"{name}: components have not settled after {rounds} rounds")


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v) with m, the least v of u. The edges of a u with many of them are dealt to SALTS tasks."""
    per = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    # Fewer than HOT_SHARE of the u can have more than a HOT_SHARE-th of the edges: a bounded broadcast.
    hot = per.where(F.col("n") > max(rows // HOT_SHARE, HOT_ROWS))
    salted = edges.join(F.broadcast(hot.select("u", F.lit(True).alias("hot"))), "u", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0)).drop("hot")
    least = per.withColumn("salt", F.explode(F.when(F.col("n") > max(rows // HOT_SHARE, HOT_ROWS), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).select("u", F.col("salt").cast("long").alias("salt"), "m")
    return salted.withColumn("salt", F.col("salt").cast("long")).join(least, ["u", "salt"]).select("u", "v", "m")
