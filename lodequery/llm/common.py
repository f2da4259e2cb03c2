"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the Unicode property White_Space, as a regex class (fixed values).
WS = "\t-\r \x85\xa0  -     　"

#: Rows of one Arrow batch; texts may be long, so the default of 10,000 would not bound memory.
ARROW_ROWS = 1000

#: Share of the driver's greatest heap from which on it is collected between tables; it is garbage of planning that grows there.
HEAP = 0.5

_made: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, one of our own in local mode (tests), else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodequery-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/lq-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(spark, path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Return to the system what the driver has freed: the allocators of its Python and its JVM keep it else, and it adds up over stages."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP * heap.maxMemory():
        gc.collect()  # plans that only Python still holds
        jvm.java.lang.System.gc()
    with contextlib.suppress(Exception):  # a JVM without that command; it is reached by reflection, as its class is not public
        command = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        command[0], command[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def written(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the interpreter ends."""
    _made.append((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: S112  the session may be gone: then its owner clears the shared folder
            continue


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name (compared as Spark does, without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"{name}_"
    return name


_memories: dict[str, object] = {}


def only(name: str, forget) -> None:
    """Called where a task of an operator starts: what other operators remember in this worker is dropped by their ``forget``."""
    for other in [k for k in _memories if k != name]:
        _memories.pop(other)()
    _memories[name] = forget


#: Bits of an id filter at most: 8 MB. Beyond, more rows pass than are needed, and a join still decides.
FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A one-hash Bloom filter of about ``n`` ids (column id): its words, at most FILTER_BITS / 64, and its bits."""
    bits = max(64, min(FILTER_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(at / 64).cast("int").alias("w"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out, bits


def split_by_filter(df: DataFrame, doc_id: str, words: np.ndarray, bits: int, inside: bool) -> DataFrame:
    """The rows of ``df`` whose id may be in the filter, or (``inside`` false) those whose id is surely not; null ids are not."""
    at = free_name(df, "lq_at")
    passed = df.sparkSession.sparkContext.broadcast(words)
    cols = [f"`{c}`" for c in df.columns]
    rows = df.withColumn(at, F.when(F.col(doc_id).isNotNull(), F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(bits))).otherwise(F.lit(-1))).select(*cols, at)

    def run(batches):
        has = passed.value
        for b in batches:
            k = b.column(b.num_columns - 1).to_numpy()
            hit = ((has[np.maximum(k, 0) >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) == 1) & (k >= 0)
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(hit if inside else ~hit))

    return rows.mapInArrow(run, df.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def map_columns(df: DataFrame, uses: list[str], fields: list[T.StructField], make, keep: list[str] | None = None) -> DataFrame:
    """Append the columns ``fields``: per Arrow batch, ``make()`` gives a function from lists to lists.

    ``make`` runs once a task. ``keep`` names the input columns that stay (all by default).
    """
    keep = df.columns if keep is None else keep
    out = T.StructType([df.schema[c] for c in keep] + fields)
    src = df.select(*[f"`{c}`" for c in dict.fromkeys([*keep, *uses])])
    at = [src.columns.index(c) for c in uses]
    stay = [src.columns.index(c) for c in keep]
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches):
        f = make()
        for b in batches:
            if b.num_rows:
                new = f(*[b.column(i).to_pylist() for i in at])
                cols = [b.column(i) for i in stay] + [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return src.mapInArrow(run, out)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)
