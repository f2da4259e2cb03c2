"""Inverted index, index statistics and last-operation-wins maintenance (IDX*, SNK2, D6-D8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import shard_of


def postings(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id", positions: bool = False) -> DataFrame:
    """(term, key, tf[, positions]): one row a term and document."""
    rows = docs.select(key, F.posexplode(tokens).alias("pos", "term"))
    aggs = [F.count("*").alias("tf")] + ([F.sort_array(F.collect_list("pos")).alias("positions")] if positions else [])
    return rows.groupBy("term", key).agg(*aggs)


def term_stats(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, total_tf) (IDX15)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def merged_texts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the text, one row for equal keys: their texts follow each other. Only the keys are read to find such rows."""
    rows = docs.select(*keys, text)
    again = docs.groupBy(*keys).agg(F.count("*").alias("lq_n")).where("lq_n > 1").select(*keys)
    if again.isEmpty():
        return rows
    many = rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.concat_ws("\n", F.collect_list(text)).alias(text))
    return rows.join(again, keys, "left_anti").unionByName(many)


def once_and_all(docs: DataFrame, tokens: str, *more: str) -> DataFrame:
    """(once, token, more): each token of a row with ``once`` 0, each distinct one with 1, to count both in one aggregate."""
    both = F.posexplode(F.array(F.col(tokens), F.array_distinct(tokens))).alias("once", "lq_t")
    return docs.select(*more, both).select(*more, "once", F.explode("lq_t").alias("token"))


def term_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """As ``term_stats`` of the postings, from documents of one row each: what is shuffled are counts, not postings."""
    return once_and_all(docs, tokens).groupBy(F.col("token").alias("term")).agg(F.count_if(F.col("once") == 1).alias("df"), F.count_if(F.col("once") == 0).alias("total_tf"))


def last_operations(feed: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last operation of each document (IDX3), by an aggregate, so repeated keys combine before the shuffle."""
    rest = [c for c in feed.columns if c != key]
    return feed.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def upsert(base: DataFrame, feed: DataFrame, key: str = "doc_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """``base`` after the feed: documents without an operation stay, added ones replace, deleted ones go (IDX3)."""
    last = last_operations(feed, key, seq)
    stay = base.join(last.select(key), key, "left_anti")
    return stay.unionByName(last.where(F.col(op) == "add").select(*base.columns))


def append_only(base: DataFrame, feed: DataFrame, op: str = "op") -> DataFrame:
    """Batch mode: every add is kept, a delete is an error (IDX5)."""
    bad = F.raise_error(F.lit("a batch index can't delete"))
    checked = feed.withColumn(op, F.when(F.col(op) == "add", F.col(op)).otherwise(bad))
    return base.unionByName(checked.where(F.col(op) == "add").select(*base.columns))


def has_required(names: Column, required: list[str]) -> Column:
    """All required field names are there (IDX10)."""
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(names, F.array().cast("array<string>")))) == 0


def long_fields_ok(op: Column, fields: list[Column]) -> Column:
    """Adds need each of the fields as a whole number, other operations pass (IDX11)."""
    ok = reduce(lambda a, b: a & b, [c.try_cast("bigint").isNotNull() for c in fields], F.lit(True))
    return (op != "add") | ok


def route(docs: DataFrame, n: int, key: Column) -> DataFrame:
    """Documents with their shard (IDX7)."""
    return docs.withColumn("shard", shard_of(key, n))


def split_index(docs: DataFrame, n: int, key: Column, path: str) -> None:
    """Write one folder a shard (IDX8)."""
    routed = route(docs, n, key)
    routed.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def merge_indexes(parts: list[DataFrame]) -> DataFrame:
    """Union of child indexes (IDX8, D8)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compose_latest(indexes: DataFrame, cluster: str = "cluster", version: str = "version", known: list | None = None) -> DataFrame:
    """The newest index of each cluster; nothing unless all ``known`` clusters are there (IDX9)."""
    newest = indexes.groupBy(cluster).agg(F.max(version).alias(version))
    if known is not None:
        have = newest.where(F.col(cluster).isin(known)).agg((F.count("*") == len(set(known))).alias("all_there"))
        newest = newest.where(F.col(cluster).isin(known)).crossJoin(F.broadcast(have)).where("all_there").drop("all_there")
    return newest


def delete_by_term(docs: DataFrame, tokens: str, term: str) -> DataFrame:
    return docs.where(~F.array_contains(tokens, term))


def changed_versions(fetches: DataFrame, url: str = "url", at: str = "ts", content: str = "hash") -> DataFrame:
    """Cache with history (SNK5): each fetch with content_ts, the time of the last fetch that changed the content."""
    w = Window.partitionBy(url).orderBy(at)
    new = F.lag(content).over(w).isNull() | (F.lag(content).over(w) != F.col(content))
    marked = fetches.withColumn("changed", new)
    return marked.withColumn("content_ts", F.last(F.when(F.col("changed"), F.col(at)), ignorenulls=True).over(w))


def compact(docs: DataFrame, files: int, path: str) -> None:
    """Rewrite into fewer files (IDX6 optimize)."""
    docs.coalesce(files).write.mode("overwrite").parquet(path)
