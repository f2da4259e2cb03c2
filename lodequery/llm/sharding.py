"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 4).

Rows lie in source blocks (by a hash of the whole row). How many rows each block sends to each destination chunk is drawn
exactly: row by row of the matrix, a multivariate hypergeometric draw from the chunks' free places. A block's rows
are put in random order and dealt by those counts, exchanged, and put in random order again inside each chunk. A
shard is a fixed number of chunks, so the place of a row in its shard is the chunk's offset plus its rank there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Rows that a block or chunk should hold, and the most blocks, and chunks of all shards, of the matrix; beyond, each is
#: ordered in parts by the leading bits of its random keys, at most MOST_PARTS of them.
BLOCK_ROWS, MOST_BLOCKS, MOST_PARTS = 4096, 1024, 256


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` without replacement; any sizes. Inversion over the ratios of neighbouring chances."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up, down = [1.0], []
    p, k = 1.0, mode
    while k < high and p > 1e-18:
        p *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        k += 1
        up.append(p)
    p, k = 1.0, mode
    while k > low and p > 1e-18:
        p *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        k -= 1
        down.append(p)
    w = np.array(down[::-1] + up)
    c = np.cumsum(w)
    return mode - len(down) + int(np.searchsorted(c, rng.random() * c[-1], side="right"))


def communication_matrix(rng: np.random.Generator, rows: list[int], capacity: list[int]) -> np.ndarray:
    """counts[block, chunk] with the given sums of rows and columns, as a uniform permutation would have them."""
    assert sum(rows) == sum(capacity)
    out = np.zeros((len(rows), len(capacity)), np.int64)
    free, total = list(capacity), sum(capacity)
    for i, n in enumerate(rows):
        left, rest = n, total
        for j, c in enumerate(free):
            if not left:
                break
            rest -= c
            k = hypergeometric(rng, c, rest, left)
            out[i, j] = k
            free[j] = c - k
            left -= k
        total -= n
    return out


def even_parts(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def shard(df: DataFrame, shards: int = 16, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) in uniform random order.

    Shard sizes differ by one at most (larger ones first). Input columns named shard or slot are replaced. The order
    depends on the rows' values, the seed and the numbers of blocks alone, so a lost partition is recomputed alike;
    rows equal in all columns are interchangeable, and lie in one block. Nulls are values; an empty table gives an empty one.
    """
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in ("shard", "slot")])
    spark, cols = df.sparkSession, [F.to_json(F.struct(f"`{f.name}`")) if _unhashable(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]
    n_name, block, key, rank, chunk = (free_name(df, x) for x in ("lq_n", "lq_block", "lq_key", "lq_rank", "lq_chunk"))
    drawn = F.xxhash64(F.lit(seed), *cols)
    total = df.count()
    blocks = int(min(MOST_BLOCKS, max(1, -(-total // block_rows))))
    per = int(min(max(1, MOST_BLOCKS // shards), max(1, -(-total // (block_rows * shards)))))
    parts = int(min(MOST_PARTS, max(1, -(-total // (block_rows * MOST_BLOCKS)))))
    at = F.pmod(drawn, F.lit(blocks)).cast("int")
    have = {r[block]: r[n_name] for r in df.select(at.alias(block)).groupBy(block).agg(F.count("*").alias(n_name)).collect()}
    sizes = even_parts(total, shards)
    capacity = [c for s in sizes for c in even_parts(s, per)]
    matrix = communication_matrix(np.random.default_rng(seed), [have.get(k, 0) for k in range(blocks)], capacity)
    # At most MOST_BLOCKS rows of at most MOST_BLOCKS numbers: a bounded table.
    schema = T.StructType([T.StructField(block, T.IntegerType()), T.StructField(n_name, T.ArrayType(T.LongType()))])
    ends = spark.createDataFrame([(k, row) for k, row in enumerate(np.cumsum(matrix, 1).tolist())], schema)
    starts = np.concatenate([[0], np.cumsum(capacity)])
    first = [int(starts[k] - starts[k - k % per]) for k in range(len(capacity))]
    sent = df.withColumn(key, drawn).withColumn(block, F.pmod(F.col(key), F.lit(blocks)).cast("int")).withColumn(key, F.xxhash64(F.lit(seed + 1), F.col(key)))
    sent = _ranked(sent, block, F.col(key), [F.col(key), *_order(cols)], parts, rank)
    sent = sent.join(F.broadcast(ends), block)
    # The chunk whose cumulated counts hold the rank: as many chunks end at or before it.
    sent = sent.withColumn(chunk, _upper_bound(F.col(n_name), F.col(rank))).drop(n_name, block, rank)
    again = F.xxhash64(F.lit(seed + 2), F.col(key))
    sent = _ranked(sent, chunk, again, [again, F.col(key), *_order(cols)], parts, rank)
    offsets = F.array(*[F.lit(x).cast("long") for x in first])
    slot = (F.element_at(offsets, F.col(chunk) + 1) + F.col(rank)).cast("long")
    out = sent.withColumn("slot", slot).withColumn("shard", F.floor(F.col(chunk) / per).cast("int"))
    return out.select(*[f"`{c}`" for c in df.columns], "shard", "slot")


def _ranked(df: DataFrame, group: str, key: Column, order: list[Column], parts: int, name: str) -> DataFrame:
    """``df`` with the rank, from 0, of each row in its group by ``order``, which begins with ``key``, a hash.

    With more than one part, a group is ordered in parts by the key's leading bits, and a part starts where the counts
    of those before it end: a table of at most MOST_BLOCKS * MOST_PARTS rows.
    """
    if parts == 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    part, begin = free_name(df, "lq_part"), free_name(df, "lq_begin")
    # The signed key, shifted to start at 0, over the width of a part: rises with the key.
    df = df.withColumn(part, F.least(F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * parts / F.lit(1 << 32)), F.lit(parts - 1)).cast("int"))
    sizes = df.groupBy(group, part).agg(F.count("*").alias(begin))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(begin, F.coalesce(F.sum(begin).over(before), F.lit(0)))
    df = df.join(F.broadcast(sizes), [group, part])
    turn = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) - 1
    return df.withColumn(name, (F.col(begin) + turn).cast("long")).drop(part, begin)


def _upper_bound(ends: Column, rank: Column) -> Column:
    return F.size(F.filter(ends, lambda e: e <= rank)).cast("int")


def _unhashable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _unhashable(t.elementType)
    if isinstance(t, T.StructType):
        return any(_unhashable(f.dataType) for f in t)
    return isinstance(t, T.MapType) or t.typeName() == "variant"


def _order(cols: list[Column]) -> list[Column]:
    """Ties of the random key are broken by a second hash of the whole row; what still ties is equal."""
    return [F.xxhash64(F.lit(-1), *cols)]
