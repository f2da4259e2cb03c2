"""Inputs: page tables, caches, seed and label lists, click-log and index XML, databases, random documents (SRC*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.crawl import PAGE, injected, seeds

INDEX_FEED = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("boost", T.DoubleType()),
        T.StructField("fields", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("stored", T.BooleanType()), T.StructField("indexed", T.BooleanType()), T.StructField("tokenized", T.BooleanType()), T.StructField("boost", T.DoubleType())]))),
        T.StructField("payloads", T.MapType(T.StringType(), T.LongType())),
        T.StructField("seq", T.LongType()),
    ]
)
#: Five tables of the click log (D15).
LOG_TABLES = {
    "queries": "query_id int, query string, results int, ip string, time timestamp",
    "results": "result_id int, link string, clicked boolean, distance int, query_id int",
    "tag_lists": "result_id int, tag_id int",
    "tags": "tag_id int, type_id int, name string",
    "tag_types": "type_id int, name string",
}


def page_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC1."""
    return spark.read.schema(PAGE).parquet(path)


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC2."""
    return seeds(spark.read.text(path))


def injected_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: the list becomes pages only if every line is a URL."""
    return seeds(injected(spark.read.text(path)))


def from_cache(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache's rows of the pages' URLs, each once however often a URL comes (SRC6)."""
    return cache.join(pages.select("url"), "url", "left_semi")


def fetch_with_retry(fetch, urls: DataFrame, tries: int = 3) -> DataFrame:
    """``fetch(urls)`` again while it brought nothing at all (SRC5, EXT8); it returns url, ok and more."""
    for k in range(tries):
        got = fetch(urls)
        if k == tries - 1 or not got.where("ok").isEmpty():
            return got
    raise ValueError("tries must be 1 or more")


def index_documents(xml: DataFrame, column: str = "value") -> DataFrame:
    """Index commands from XML strings (SRC11, D6): documentAdd with fields and payloads, or documentDelete; ``seq`` must come with them."""
    root = F.regexp_extract(column, r"<(documentAdd|documentDelete|command)\b", 1)
    schema = "documentId string, boost double, field array<struct<_name string, _VALUE string, _stored boolean, _indexed boolean, _tokenized boolean, _boost double>>, payload array<struct<_name string, _VALUE bigint>>"
    d = xml.select("*", root.alias("root"), F.from_xml(F.col(column), schema).alias("d"))
    fields = F.transform("d.field", lambda f: F.struct(f._name.alias("name"), f._VALUE.alias("text"), f._stored.alias("stored"), f._indexed.alias("indexed"), f._tokenized.alias("tokenized"), f._boost.alias("boost")))
    pay = F.map_from_entries(F.transform("d.payload", lambda p: F.struct(p._name, p._VALUE)))
    op = F.when(F.col("root") == "documentAdd", "add").when(F.col("root") == "documentDelete", "delete").otherwise("command")
    return d.select(op.alias("op"), F.col("d.documentId").alias("doc_id"), F.coalesce("d.boost", F.lit(1.0)).alias("boost"), fields.alias("fields"), pay.alias("payloads"), F.col("seq").cast("long").alias("seq"))


def valid_adds(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds whose boost is a number above 0, and the others (SCR2)."""
    ok = (F.col("op") != "add") | (~F.isnan("boost") & (F.col("boost") > 0) & (F.col("boost") < float("inf")))
    return feed.where(ok), feed.where(~ok)


def click_log(spark: SparkSession, path: str) -> DataFrame:
    """Clicks from XML ``track`` rows (SRC12): distance is page * 10 + index; every row is a click."""
    schema = "query string, ip string, link string, pageNo int, indexOnPage int, subdomain string, scope string, category string"
    rows = spark.read.format("xml").option("rowTag", "track").schema(schema).load(path)
    return rows.select("query", "ip", "link", (F.col("pageNo") * 10 + F.col("indexOnPage")).alias("distance"), F.lit(True).alias("clicked"), F.array_compact(F.array("subdomain", "scope", "category")).alias("tags"))


def database(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """SRC13; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def random_documents(spark: SparkSession, n: int, words: list[str], length: int = 100, seed: int = 0) -> DataFrame:
    """SRC15: documents of random words, by id and seed alone."""
    lit = F.array(*[F.lit(w) for w in words])
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.element_at(lit, (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(len(words))) + 1).cast("int"))), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))


def label_lists(included: DataFrame, excluded: DataFrame, unknown: DataFrame, category: str) -> DataFrame:
    """(category, url, state) of three URL lists (SRC17); a URL in several keeps the first state."""
    rows = [d.select(F.col(d.columns[0]).alias("url"), F.lit(k).alias("at"), F.lit(s).alias("state")) for k, (d, s) in enumerate(((included, "included"), (excluded, "excluded"), (unknown, "unknown")))]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.groupBy("url").agg(F.min_by("state", "at").alias("state")).select(F.lit(category).alias("category"), "url", "state")


def cached_page(cache: DataFrame, url: str, at: Column | None = None) -> DataFrame:
    """The newest version of a page, at or before a time (SRC16)."""
    rows = cache.where(F.col("url") == url)
    return (rows if at is None else rows.where(F.col("fetched_at") <= at)).orderBy(F.desc("fetched_at")).limit(1)
