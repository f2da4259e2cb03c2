"""Exact top-k search by distributed histogram selection (operator 10).

For a block of queries, every partition scores all its vectors and counts scores by bins; the counts of all partitions
are summed and each query's interval shrinks to the bin that holds its k-th best score, until that bin is one value.
A last pass returns the scores above that value, and of those equal to it the smallest ids.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, work_dir, written

#: Queries that are broadcast at once (the bound of what is broadcast), bins of a histogram, and vectors scored at once.
QUERY_BLOCK, BINS, CHUNK = 4096, 256, 512
SCALE = 256


def quantized(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): floor(256 * x) of every component; vectors that are null or hold a null or non-finite number are left out."""
    v = F.col("v")
    src = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    ok = F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.where(ok).select("id", F.transform("v", lambda x: F.floor(x * SCALE)).cast("array<long>").alias("v"))


class _Block:
    """Queries of one block, and each one's interval of values [low, low + width * BINS) that holds its k-th score."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.low = self.width = None


def _scores(batches, block: _Block):
    """(ids, scores[vector, query]) of the batch's vectors of the queries' length; exact in double below 2**53."""
    dim = block.x.shape[1]
    for b in batches:
        ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        sizes = np.diff(v.offsets.to_numpy())
        flat = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() :] if len(v) else np.empty(0)
        at = np.flatnonzero(sizes == dim)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for s in range(0, len(at), CHUNK):
            pick = at[s : s + CHUNK]
            x = flat[starts[pick][:, None] + np.arange(dim)[None, :]].astype(np.float64)
            if np.abs(x).sum(1, initial=0).max(initial=0) * np.abs(block.x).max(initial=0) < 2**52:
                yield ids[pick], (x @ block.x.T.astype(np.float64)).astype(np.int64)
            else:
                yield ids[pick], x.astype(np.int64) @ block.x.T


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products over all rows of ``df``.

    Ties go to the smaller vec_id; rows with the query's own vec_id are no candidates. Components are floor(256 * x).
    Vectors that are null, hold a null or non-finite number, or have no vec_id take no part, and a query meets only
    vectors of its own length. Equal query rows are one query; where a vec_id repeats with other vectors, each is a
    candidate and, as a query, the smallest vector counts. Fewer candidates than ``k`` give fewer rows. Scores must
    stay below 2**62. Queries are taken in blocks of at most QUERY_BLOCK; only a block is broadcast.
    """
    spark = df.sparkSession
    data = materialize(quantized(df, vec_id, embedding), "quantized")
    asked = quantized(queries, vec_id, embedding).groupBy("id").agg(F.min("v").alias("v")).where(F.size("v") > 0)
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "asked")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    shapes = asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    # |score| <= |query|_1 * max |component|: the first interval holds every score.
    most = data.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    out, path = None, f"{work_dir(spark)}/lq-found-{uuid.uuid4().hex}"
    several = sum(len(_parts(n)) for _, n in shapes) > 1
    for dim, n in shapes:
        for low, high in _parts(n):
            rows = asked.where((F.size("v") == dim) & (F.col("block") >= low) & (F.col("block") < high)).select("id", "v").orderBy("id").toArrow()
            if not rows.num_rows:
                continue
            ids = rows.column("id").to_numpy()
            x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
            out = _block(spark, data, _Block(ids, x), k, most)
            if several:  # each block's result is written, so the plan does not grow with their number
                out.write.mode("append").parquet(path)
    if out is not None and several:
        written(spark, path)
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema) if out is None else out


def _parts(n: int) -> list[tuple[int, int]]:
    """Ranges of a 20-bit hash that split ``n`` queries into blocks of three quarters of QUERY_BLOCK on average."""
    parts = 1 if n <= QUERY_BLOCK else min(1 << 20, -(-n * 4 // (3 * QUERY_BLOCK)))
    ends = [(1 << 20) * i // parts for i in range(parts + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _block(spark, data: DataFrame, block: _Block, k: int, most: int) -> DataFrame:
    sc, q = spark.sparkContext, len(block.ids)
    reach = np.abs(block.x).sum(1) * max(most, 1)
    block.low = -reach
    block.width = np.maximum(1, -(-(2 * reach + 1) // BINS))
    while True:
        shared = sc.broadcast(block)

        def count(batches, shared=shared):
            b = shared.value
            total = np.zeros((len(b.ids), BINS + 1), np.int64)
            row = np.arange(len(b.ids))[None, :]
            for ids, s in _scores(batches, b):
                bin_ = (s - b.low[None, :]) // b.width[None, :]
                use = (bin_ >= 0) & (ids[:, None] != b.ids[None, :])
                flat = (row * (BINS + 1) + np.minimum(bin_, BINS))[use]
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
            # Below the bin of a partition's own k-th best score no bin can hold the global one.
            below = np.cumsum(total[:, ::-1], 1)[:, ::-1] - total
            r, c = np.nonzero((total > 0) & (below < k))
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(total[r, c], pa.int64())], names=["query", "bin", "n"])

        counts = data.mapInArrow(count, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n")).toArrow()
        r, c, n = (counts.column(x).to_numpy() for x in ("query", "bin", "n"))
        order = np.lexsort((-c, r))
        r, c, n = r[order], c[order], n[order]
        run = np.cumsum(n)
        first = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1]) if len(r) else np.empty(0, np.int64)
        base = np.repeat(run[first] - n[first], np.diff(np.append(first, len(r)))) if len(r) else run
        reached = np.flatnonzero(run - base >= k)
        where = np.full(q, -1, np.int64)
        where[r[reached][::-1]] = c[reached][::-1]  # the highest bin at which k scores are reached
        narrow = block.width == 1
        move = where >= 0
        block.low = np.where(move, block.low + np.maximum(where, 0) * block.width, block.low)
        short = ~move  # fewer than k candidates: all of them are wanted
        if (narrow | short).all():
            break
        block.width = np.where(narrow | short, block.width, np.maximum(1, -(-block.width // BINS)))
    block.low = np.where(short, -reach, block.low)
    final = sc.broadcast(block)

    def best(batches):
        b = final.value
        keep_q, keep_i, keep_s = [], [], []
        held = 0

        def cut():
            if not keep_q:
                return None
            a, i, s = np.concatenate(keep_q), np.concatenate(keep_i), np.concatenate(keep_s)
            o = np.lexsort((i, -s, a))
            a, i, s = a[o], i[o], s[o]
            start = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
            turn = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
            ok = turn < k
            return a[ok], i[ok], s[ok]

        for ids, s in _scores(batches, b):
            v, a = np.nonzero((s >= b.low[None, :]) & (ids[:, None] != b.ids[None, :]))
            keep_q.append(a)
            keep_i.append(ids[v])
            keep_s.append(s[v, a])
            held += len(a)
            if held > 400_000:  # many ties: of this partition's, the smallest ids are enough
                one = cut()
                keep_q, keep_i, keep_s = [one[0]], [one[1]], [one[2]]
                held = len(one[0])
        one = cut()
        if one is not None:
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[one[0]], pa.int64()), pa.array(one[1], pa.int64()), pa.array(one[2], pa.int64())], names=["query_id", "vec_id", "score"])

    found = data.mapInArrow(best, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
