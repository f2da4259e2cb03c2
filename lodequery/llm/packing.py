"""Packing along a space-filling curve (operator 7).

A document's hashed vector (random directions of its token ids, summed) is projected to a few dimensions; documents
are range-sorted by the Hilbert key of that point, so neighbours on the curve have similar texts, and each range is
cut into full sequences in that order. Only the last sequence of a range may be short.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import map_columns, materialize
from .merges import byte_chars

LENGTH, EOD = 1024, 0
#: Dimensions of the curve and bits of each; their product is the key's length.
DIMS, BITS = 4, 8
#: Bytes of token ids that a range should hold: a RANGES-th of all of them, but within these bounds.
RANGE_BYTES, RANGES = (8 << 20, 512 << 20), 4096
#: Bits of a curve key that the histogram of tokens has: its rows, at most 2**HISTOGRAM_BITS, go through the driver.
HISTOGRAM_BITS = 16
#: White space of this length is too much for the faster encoder's regular expressions.
_LONG = re.compile(r"\s{20000}")
_SEED = 424242
#: The vocabulary's pre-splitting (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoder(path: str):
    """The JSON vocabulary behind the faster encoder: in a byte-level file ids rise with merges, so they are ranks."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    back = {c: b for b, c in byte_chars().items()}
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    vocab = content["model"]["vocab"]
    raw = {t: bytes(back[c] for c in t) for t in vocab if t not in special}
    order = sorted((t for t in raw if len(raw[t]) == 1), key=vocab.get) + [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"])]
    ranks = {raw[t]: k for k, t in enumerate(order)}
    ids = np.array([vocab[t] for t in order], np.uint32)
    top = len(order)
    enc = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={t: top + k for k, t in enumerate(special)})
    return enc, np.concatenate([ids, np.array(list(special.values()), np.uint32)]), int(max(vocab.values(), default=0)) + len(special) + 1


@cache
def _library(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a text (uint32), special strings inside it as the library's default has them."""
    if len(text) >= 20_000 and _LONG.search(text):
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    enc, ids, _ = _encoder(path)
    return ids[enc.encode_to_numpy(text, allowed_special="all")]


@cache
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(_SEED).normal(size=(size, DIMS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of unsigned coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:  # undo the excess rotations, from the top bit down
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def vector(ids: np.ndarray, size: int) -> np.ndarray:
    """A document's point: the summed directions of its tokens over the root of their number."""
    return _directions(size).take(ids, 0).sum(0) / math.sqrt(max(len(ids), 1))


def curve_keys(points: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents' points, each squashed to a grid by a scale that follows its number of tokens."""
    # Sums of frequent tokens lie far out: the arc tangent keeps the grid in use.
    scale = 1 + 0.1 * np.sqrt(tokens)[:, None]
    grid = np.clip((np.arctan(points / scale) / math.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(grid.astype(np.int64))


def pack(df: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and with ``ids`` the ids, uint32).

    A document is its token ids and then id 0; a null or empty text is id 0 alone. Pieces fill sequences of ``length``
    without gaps; the last sequence of a range of the curve may be short and would be padded. sequence_id is the range's
    number times 2**32 plus the sequence's number there. Ranges hold about equal numbers of tokens: a histogram of
    tokens over the curve says where each cell's ranges begin, and a cell with more tokens than a range holds is dealt to
    several by a hash of ids and doc_id, so one group of copies spreads over ranges. A null doc_id is a document like any
    other, repeated rows are packed each. Other columns are ignored.
    """
    wide = 2 if _encoder(vocab)[2] <= 1 << 16 else 4
    new = [T.StructField("key", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]

    def make():
        size = _encoder(vocab)[2]

        def f(texts):
            raw, ties, many, points = [], [], [], np.zeros((len(texts), DIMS))
            for k, t in enumerate(texts):
                x = encode(vocab, t or "")
                b = np.append(x, np.uint32(EOD)).astype(f"<u{wide}").tobytes()
                points[k] = vector(x, size)
                raw.append(b)
                ties.append(zlib.crc32(b))
                many.append(len(x) + 1)
            return curve_keys(points, np.array(many) - 1).tolist(), ties, many, raw

        return f

    docs = map_columns(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["text"], new, make, ["doc_id"])
    cell = F.shiftright("key", DIMS * BITS - HISTOGRAM_BITS)
    docs = materialize(docs, "ids").withColumn("tie", F.xxhash64("tie", "doc_id")).withColumn("cell", cell)
    held = docs.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, tokens = held.column("cell").to_numpy(), held.column("n").to_numpy().astype(np.int64)
    order = np.argsort(cells)
    cells, tokens = cells[order], tokens[order]
    total = int(tokens.sum())
    size = min(max(total * wide / RANGES, RANGE_BYTES[0]), RANGE_BYTES[1]) / wide
    ranges = max(1, math.ceil(total / size))
    # At most 2**HISTOGRAM_BITS rows: where a cell starts, and how far it reaches, in ranges.
    starts = (np.cumsum(tokens) - tokens) * (ranges / max(total, 1))
    table = pa.table({"cell": pa.array(cells, pa.int64()), "begin": pa.array(starts, pa.float64()), "reach": pa.array(tokens * (ranges / max(total, 1)), pa.float64())})
    docs = docs.join(F.broadcast(docs.sparkSession.createDataFrame(table)), "cell")
    at = F.floor(F.col("begin") + F.col("reach") * F.pmod("tie", F.lit(1 << 40)) / float(1 << 40))
    docs = docs.withColumn("range", F.least(at, F.lit(ranges - 1)).cast("int"))
    docs = docs.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "tie", "doc_id", "ids")

    def cut(batches):
        seq, at, now = 0, 0, -1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, n, raw, part in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now:
                    seq, at, now = part << 32, 0, part
                full = np.frombuffer(raw, f"<u{wide}").astype("<u4")
                start = 0
                while start < n:
                    take = min(n - start, length - at)
                    piece = full[start : start + take].tobytes()
                    for o, v in zip(out, [doc, start, take, zlib.crc32(piece), n, seq, at] + [piece] * ids, strict=True):
                        o.append(v)
                    start += take
                    at += take
                    if at == length:
                        seq, at = seq + 1, 0
            kinds = [b.schema.field(0).type] + [pa.int64()] * 6 + [pa.binary()] * ids
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=names)

    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())] * ids)
    return docs.select("doc_id", "n", "ids", "range").mapInArrow(cut, schema)
