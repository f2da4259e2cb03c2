"""Click-log reports (LOG1-LOG9, MET1, SRV4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 30 * 60


def between(df: DataFrame, ts: str, start: object = None, end: object = None) -> DataFrame:
    """Rows in [start, end]; a bound that is None is none (LOG9)."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    return df.where(F.col(ts) <= F.lit(end)) if end is not None else df


def top(counted: DataFrame, text: str, n: int | None, count: str = "n") -> DataFrame:
    """By count, falling, then text (SRT9)."""
    out = counted.orderBy(F.desc(count), F.asc(text))
    return out if n is None else out.limit(n)


def top_queries(queries: DataFrame, n: int | None = None, start: object = None, end: object = None) -> DataFrame:
    return top(between(queries, "time", start, end).groupBy("query").agg(F.count("*").alias("n")), "query", n)


def unsuccessful(queries: DataFrame, results: DataFrame, n: int | None = None) -> DataFrame:
    """Queries without a clicked result, by how often (LOG2)."""
    lost = queries.join(results.where("clicked").select("query_id"), "query_id", "left_anti")
    return top(lost.groupBy("query").agg(F.count("*").alias("n")), "query", n)


def with_tags(results: DataFrame, tag_lists: DataFrame, tags: list[int] | None) -> DataFrame:
    """Results with any of the tags, once for each that they have; all if no tags are asked for."""
    return results if tags is None else results.join(tag_lists.where(F.col("tag_id").isin(tags)), "result_id")


def worst_placed(results: DataFrame, tag_lists: DataFrame | None = None, tags: list[int] | None = None, n: int | None = None) -> DataFrame:
    """Links by the mean distance of their clicks, cut to a whole number (LOG3)."""
    rows = with_tags(results, tag_lists, tags).where("clicked")
    return top(rows.groupBy("link").agg(F.floor(F.avg("distance")).cast("long").alias("distance")), "link", n, "distance")


def clicks(results: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct (query_id, clicked, link), links that begin with ``prefix`` (LOG4)."""
    return results.where(F.startswith("link", F.lit(prefix))).select("query_id", "clicked", "link").distinct()


def click_ratio(rows: DataFrame) -> DataFrame:
    """(link, shown, clicks, ratio): shown counts rows that were not clicked; no ratio where there are none (LOG5)."""
    per = rows.groupBy("link").agg(F.count_if(~F.col("clicked")).alias("shown"), F.count_if("clicked").alias("clicks"))
    return per.withColumn("ratio", F.when(F.col("shown") > 0, F.col("clicks") / F.col("shown")))


def best_placed_spam(results: DataFrame, tag_lists: DataFrame | None = None, tags: list[int] | None = None, n: int | None = None) -> DataFrame:
    """Links by how often they were shown and not clicked (LOG6)."""
    rows = with_tags(results, tag_lists, tags).where(~F.col("clicked"))
    return top(rows.groupBy("link").agg(F.count("*").alias("n")), "link", n)


def sessions(queries: DataFrame, who: str, ts: str, ties: list[str], gap: int = GAP_SECONDS) -> DataFrame:
    """Rows with ``session``, numbered per visitor: a gap of ``gap`` seconds or more begins one."""
    w = Window.partitionBy(who).orderBy(ts, *ties)
    new = F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) >= gap * 1_000_000).cast("int"), F.lit(0))
    return queries.withColumn("lq_new", new).withColumn("session", F.sum("lq_new").over(w)).drop("lq_new")


def query_sequences(queries: DataFrame, who: str, ts: str, text: str, ties: list[str], n: int | None = None) -> DataFrame:
    """Sequences of two queries or more in a session, joined by an arrow, by count (LOG7); the last session counts too."""
    s = sessions(queries, who, ts, ties)
    seq = s.groupBy(who, "session").agg(F.sort_array(F.collect_list(F.struct(ts, *ties, text))).alias("q"))
    seq = seq.where(F.size("q") >= 2).select(F.array_join(F.transform("q", lambda x: x[text]), " --> ").alias("sequence"))
    return top(seq.groupBy("sequence").agg(F.count("*").alias("n")), "sequence", n)


def tagged(results: DataFrame, tag_lists: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    """Results that have a tag of these names (LOG8)."""
    ids = tag_lists.join(tags.where(F.col("name").isin(names)), "tag_id", "left_semi")
    return results.join(ids, "result_id", "left_semi")


def event_stats(events: DataFrame, event: str, value: str, error: Column) -> DataFrame:
    """Per event: most, least, p95, mean of the good values, and how many were good and errors (MET1)."""
    good = F.when(~error, F.col(value))
    return events.groupBy(event).agg(F.max(good).alias("most"), F.min(good).alias("least"), F.percentile(good, 0.95).alias("p95"), F.avg(good).alias("mean"), F.count_if(~error).alias("correct"), F.count_if(error).alias("errors"))


def moving_throughput(samples: DataFrame, by: str, ts: str, value: str, n: int = 10) -> DataFrame:
    """Mean of the last ``n`` samples (SRV4)."""
    return samples.withColumn("throughput", F.avg(value).over(Window.partitionBy(by).orderBy(ts).rowsBetween(1 - n, 0)))
