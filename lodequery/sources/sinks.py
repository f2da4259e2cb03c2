"""Outputs: caches, logs, models and result formats (SNK*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, version: int | str, may_be_empty: bool = False) -> str:
    """Write ``df`` aside and rename it to root/version (SNK1, SNK10, CRW18); an empty table is an error unless ``may_be_empty``.

    The rename is one step on a file system that renames at once; a reader sees the old version or the whole new one.
    """
    spark = df.sparkSession
    tmp, out = f"{root}/_tmp-{uuid.uuid4().hex}", f"{root}/{version}"
    df.write.parquet(tmp)
    if not may_be_empty and spark.read.parquet(tmp).isEmpty():
        raise ValueError("the new table is empty; the old one stays")
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(out)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(a, b):
        raise OSError(f"can't rename {tmp} to {out}")
    return out


def latest_version(spark, root: str) -> str | None:
    """The greatest numbered folder (IDX16)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = sorted(int(n) for n in names if n.isdigit())
    return f"{root}/{found[-1]}" if found else None


def drop_old_versions(spark, root: str, keep: int = 10) -> None:
    """IDX4: at most ``keep`` published versions stay."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())
    for v in found[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{v}"), True)


def query_log(queries: DataFrame) -> DataFrame:
    """Queries with a result (SNK7)."""
    return queries.where("total_results > 0").select("query")


def checked_tags(tag_lists: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag rows; an unknown tag is an error (SNK8)."""
    known = tag_lists.join(tags.select("tag_id", F.lit(True).alias("lq_known")), "tag_id", "left")
    bad = F.raise_error(F.concat(F.lit("unknown tag "), F.col("tag_id").cast("string")))
    return known.select(F.when(F.col("lq_known"), F.col("tag_id")).otherwise(bad).cast("long").alias("tag_id"), *[c for c in tag_lists.columns if c != "tag_id"])


def cache_rows(docs: DataFrame, at: Column) -> DataFrame:
    """Rows of the page cache (SNK4, D17)."""
    return docs.select("url", at.alias("fetched_at"), F.lit("text/html").alias("mime"), F.lit("UTF-8").alias("encoding"), F.encode("html", "UTF-8").alias("content"))


def history_id(ts: Column, url: Column) -> Column:
    """SNK6."""
    return F.concat_ws("_", ts.cast("string"), url)


def model_lines(model: DataFrame) -> DataFrame:
    """``token:prob`` lines (SNK11)."""
    return model.select(F.concat_ws(":", "token", F.col("prob").cast("string")).alias("value"))


def crawl_lines(docs: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Lines of the crawl log: url, tags, categories and the named attributes, or all (SNK12)."""
    some = F.col("attributes") if attributes is None else F.map_filter("attributes", lambda k, _: k.isin(attributes))
    return docs.select(F.to_json(F.struct("url", F.array_sort("tags").alias("tags"), F.array_sort("categories").alias("categories"), some.alias("attributes"))).alias("value"))


def result_xml(page: DataFrame) -> DataFrame:
    """One XML element a hit (SNK9)."""
    return page.select("rank", F.to_xml(F.struct(*page.columns), {"rowTag": "result"}).alias("xml"))


def result_json(page: DataFrame) -> DataFrame:
    return page.select("rank", F.to_json(F.struct(*page.columns)).alias("json"))


def opensearch_items(page: DataFrame, title: str = "title", link: str = "url", text: str = "snippet_text") -> DataFrame:
    """RSS items of a result page (SNK9)."""
    return page.select("rank", F.to_xml(F.struct(F.col(title).alias("title"), F.col(link).alias("link"), F.col(text).alias("description")), {"rowTag": "item"}).alias("xml"))
