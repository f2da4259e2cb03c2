"""Near-duplicate vectors by spherical-cap filters (operator 5).

Filters are the directions of a structured random product code: the space is turned at random and cut into blocks,
each block has random unit code words, and every choice of one word a block is a filter. A vector lies in the cap of
a filter when their product exceeds a bound (a little less than its best product); its caps are list-decoded
from the blocks' products without going through all filters. Vectors that share a cap are candidates, and the cosine
in double precision decides.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .linking import link, numbered, settle

THRESHOLD = 0.98
#: Blocks, bounds of the code words a block (fewer in few dimensions), and independent codes. There are about as many
#: filters as vectors, so that a cap holds as many however large the table is.
BLOCKS, WORDS, ROUNDS = 2, (64, 32_768), 2
#: A vector is in the caps of all filters whose product is at most SLACK / sqrt(dimensions) below its best one. Of
#: 40,000 random pairs at the threshold in 64 dimensions, none failed to share a cap of one code.
SLACK = 0.36
_SEED = 77


@cache
def _code(dim: int, k: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation, and per block its code words over all dimensions (scaled so that a filter has length 1)."""
    rng = np.random.default_rng([_SEED, dim, k])
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    out = []
    blocks = min(BLOCKS, dim)
    for part in np.array_split(np.arange(dim), blocks):
        w = rng.normal(size=(min(words, 2 ** len(part)), len(part)))
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        full = np.zeros((len(w), dim))
        full[:, part] = w / np.sqrt(blocks)
        out.append(full)
    return q, out


def words_for(rows: int) -> int:
    """Code words a block for a table of so many vectors: a power of two of at least their root."""
    return min(max(1 << max(math.isqrt(max(rows - 1, 0)), 0).bit_length(), WORDS[0]), WORDS[1])


def caps(x: np.ndarray, words: int, slack: float = SLACK, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every cap that holds a unit row of ``x``."""
    n, dim = x.shape
    rows, filters = [], []
    for k in range(rounds):
        q, code = _code(dim, k, words)
        y = x @ q
        s = [y @ w.T for w in code]
        while len(s) > 2:  # halves of the product code
            s = [(s[i][:, :, None] + s[i + 1][:, None, :]).reshape(n, -1) if i + 1 < len(s) else s[i] for i in range(0, len(s), 2)]
        left, right = s[0], s[1] if len(s) > 1 else np.zeros((n, 1))
        need = left.max(1) + right.max(1) - slack / np.sqrt(dim)
        order = np.argsort(-right, axis=1, kind="stable")
        sorted_right = np.take_along_axis(right, order, 1)
        r, i = np.nonzero(left >= (need - sorted_right[:, 0])[:, None])
        # For each first half, the second halves in falling order until the sum is short.
        missing = need[r] - left[r, i]
        many = np.array([np.searchsorted(-sorted_right[a], -m, side="right") for a, m in zip(r.tolist(), missing.tolist(), strict=True)], np.int64)
        base = np.repeat(np.arange(len(r)), many)
        step = np.arange(len(base)) - np.repeat(np.cumsum(many) - many, many)
        rows.append(r[base])
        filters.append((np.int64(k) << np.int64(40)) + i[base].astype(np.int64) * right.shape[1] + order[r[base], step])
    return np.concatenate(rows), np.concatenate(filters)


def _unit(batch: list) -> tuple[np.ndarray, list[int]]:
    """Double rows and their places; rows that are null, zero or hold a null or non-finite number are left out."""
    good, at = [], []
    for k, v in enumerate(batch):
        if v is None or not len(v) or any(c is None for c in v):
            continue
        a = np.array(v, np.float64)
        n = np.sqrt((a * a).sum())
        if np.isfinite(a).all() and n > 0 and np.isfinite(n):
            good.append(a)
            at.append(k)
    return good, at


def cosines(a: list[bytes], b: list[bytes] | None, threshold: float) -> np.ndarray:
    x = [np.frombuffer(v, np.float64) for v in a]
    y = x if b is None else [np.frombuffer(v, np.float64) for v in b]
    out = np.zeros((len(x), len(y)), bool)
    for d in {len(v) for v in x}:
        i, j = [k for k, v in enumerate(x) if len(v) == d], [k for k, v in enumerate(y) if len(v) == d]
        if i and j:
            p, q = np.stack([x[k] for k in i]), np.stack([y[k] for k in j])
            c = (p @ q.T) / np.sqrt((p * p).sum(1))[:, None] / np.sqrt((q * q).sum(1))[None, :]
            out[np.ix_(i, j)] = c >= threshold
    return out


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: vec_id, n_links (other vectors of its label with cosine >= threshold), component_id, kept.

    component_id is the smallest vec_id that links reach, kept marks it. A vector that is null, empty or zero, holds a
    null or non-finite number, or has a null label or id links with nothing and is kept. Vectors of different lengths
    link with nothing. Equal vectors of a label are one class, compared once and counted in full. Where a vec_id
    repeats, each of its rows is a vector: it counts its own links, and rows of one vec_id may be in different
    components. Other columns are ignored.
    """
    src = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("l"))
    v = F.col("v")
    usable = F.col("id").isNotNull() & F.col("l").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(usable & F.exists(v, lambda x: x != 0), F.lit(False))
    sig = src.withColumn("ok", usable)
    classes = sig.where("ok").groupBy("l", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = numbered(classes, "vectors")
    words = words_for(classes.count())
    chunk = max(8, min(256, (1 << 20) // words))

    def keys(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, labs = b.column(0).to_pylist(), b.column(1).to_pylist()
            good, at = _unit(b.column(2).to_pylist())
            out: tuple[list, list, list] = ([], [], [])
            for d in sorted({len(g) for g in good}):
                pick = [k for k, g in enumerate(good) if len(g) == d]
                for s in range(0, len(pick), chunk):
                    part = pick[s : s + chunk]
                    x = np.stack([good[k] for k in part])
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    r, f = caps(x, words)
                    out[0].extend(ids[at[part[k]]] for k in r.tolist())
                    out[1].extend(labs[at[part[k]]] for k in r.tolist())
                    out[2].extend((f + (np.int64(d) << np.int64(44))).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["id", "l", "filter"])

    size = 8 * F.size("v")
    k = classes.select("id", "l", "v").mapInArrow(keys, T.StructType([T.StructField("id", T.LongType()), T.StructField("l", T.StringType()), T.StructField("filter", T.LongType())]))
    k = k.select("id", F.xxhash64("l", "filter").alias("key"), F.lit(1024).alias("bytes"))

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(x, np.float64).tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["id", "weight", "payload"])

    items = classes.where(size > 0).select("id", "copies", "v").mapInArrow(pack, "id long, weight long, payload binary")
    # A key is a hash of label and filter: two labels could share one, so the label's hash is compared as well.
    tagged = items.join(classes.select("id", F.xxhash64("l").alias("tag")), "id").select("id", "weight", F.concat(F.to_binary(F.lpad(F.hex("tag"), 16, "0"), F.lit("hex")), "payload").alias("payload"))

    def verify(a, b):
        y = a if b is None else b
        same = np.array([v[:8] for v in a])[:, None] == np.array([v[:8] for v in y])[None, :]
        return cosines([v[8:] for v in a], None if b is None else [v[8:] for v in b], threshold) & same

    found = materialize(link(k, tagged, verify, "caps"), "links")
    per = settle(classes, found, "caps").select(F.col("l").alias("pl"), F.col("v").alias("pv"), "n_links", "component_id")
    out = sig.join(per, F.col("ok") & (F.col("l") == F.col("pl")) & (v == F.col("pv")), "left")
    own = F.when(F.col("ok"), F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
