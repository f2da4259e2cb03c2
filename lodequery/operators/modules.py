"""Document modules of the crawl pipeline (MOD0-MOD13): each a function of a DataFrame of documents.

A document has url, text, title, tags array, categories array, attributes map<string, double>, boost double and
field_boost map<string, double>.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import UrlPatterns, host

Module = Callable[[DataFrame], DataFrame]
NONE = "array<string>"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(NONE)


def passes(on: list[str], on_missing: list[str]) -> Column:
    """Documents that a module leaves alone: they have a tag of ``on``, or lack one of ``on_missing`` (MOD0)."""
    return F.arrays_overlap("tags", strings(on)) | (F.size(F.array_except(strings(on_missing), "tags")) > 0)


def gated(module: Module, on: list[str] = (), on_missing: list[str] = ()) -> Module:
    def run(df: DataFrame) -> DataFrame:
        skip = passes(list(on), list(on_missing))
        return df.where(skip).unionByName(module(df.where(~skip)), allowMissingColumns=True)

    return run


def set_tags(tags: Column, add: list[str], drop: list[str]) -> Column:
    return F.array_sort(F.array_union(F.array_except(tags, strings(drop)), strings(add)))


def true_false(df: DataFrame, answer: Column, on_true: tuple[list[str], list[str]], on_false: tuple[list[str], list[str]]) -> DataFrame:
    """Tags to set and to drop by an answer; null changes nothing (MOD1)."""
    t = F.when(answer, set_tags(F.col("tags"), *on_true)).when(~answer, set_tags(F.col("tags"), *on_false)).otherwise(F.col("tags"))
    return df.withColumn("tags", t)


def threshold(df: DataFrame, value: Column, at: float, below: tuple[list[str], list[str]], above: tuple[list[str], list[str]], name: str) -> DataFrame:
    """Tags by whether a value is below ``at``; the value becomes an attribute (MOD2)."""
    df = true_false(df.withColumn("lq_value", value), F.col("lq_value") >= at, above, below)
    put = F.map_concat(F.map_filter("attributes", lambda k, _: k != name), F.create_map(F.lit(name), F.col("lq_value")))
    return df.withColumn("attributes", F.when(F.col("lq_value").isNull(), F.col("attributes")).otherwise(put)).drop("lq_value")


def match_url(df: DataFrame, patterns: UrlPatterns, on_true: tuple = ([], []), on_false: tuple = ([], [])) -> DataFrame:
    return true_false(df, patterns.match(F.col("url")), on_true, on_false)


def white_list(df: DataFrame, patterns: UrlPatterns, on_true: tuple = ([], []), on_false: tuple = ([], [])) -> DataFrame:
    """As ``match_url``, and what matches is a hotspot (MOD3, MOD4)."""
    return match_url(df, patterns, (["hotspot", *on_true[0]], on_true[1]), on_false)


def pattern_categories(df: DataFrame, patterns: UrlPatterns, on_true: tuple = ([], []), on_false: tuple = ([], [])) -> DataFrame:
    """Tokens of the patterns that match become categories (MOD5)."""
    found = patterns.tokens(F.col("url"))
    df = df.withColumn("categories", F.array_sort(F.array_union("categories", F.coalesce(found, F.array().cast(NONE)))))
    return true_false(df, found.isNotNull(), on_true, on_false)


def bayes_categories(df: DataFrame, scores: dict[str, str], at: float) -> DataFrame:
    """Categories whose score column reaches ``at``; attribute OVERALL is the greatest (MOD6)."""
    new = reduce(lambda acc, kv: F.array_union(acc, F.when(F.col(kv[1]) >= at, strings([kv[0]])).otherwise(F.array().cast(NONE))), scores.items(), F.col("categories"))
    most = F.greatest(*[F.col(c) for c in scores.values()]) if len(scores) > 1 else F.col(next(iter(scores.values())))
    put = F.map_concat(F.map_filter("attributes", lambda k, _: k != "OVERALL"), F.create_map(F.lit("OVERALL"), most))
    return df.withColumn("categories", F.array_sort(new)).withColumn("attributes", put)


def keyword_condition(text: Column, keywords: list[str]) -> Column:
    """Any keyword is a blank-separated word of the text (MOD7a)."""
    return F.arrays_overlap(F.split(text, " "), strings(keywords))


def url_value(patterns: UrlPatterns, url: Column) -> Column:
    """The greatest number among the tokens of the patterns that match; null without one (MOD7a)."""
    return F.array_max(F.transform(patterns.tokens(url), lambda t: t.try_cast("double")))


def attribute_value(name: str, default: float = 1.0) -> Column:
    return F.coalesce(F.element_at("attributes", name), F.lit(default))


def boost_document(df: DataFrame, condition: Column, value: Column) -> DataFrame:
    return df.withColumn("boost", F.when(condition, F.col("boost") * value).otherwise(F.col("boost")))


def boost_field(df: DataFrame, condition: Column, value: Column, name: str) -> DataFrame:
    was = F.coalesce(F.element_at("field_boost", name), F.lit(1.0))
    put = F.map_concat(F.map_filter("field_boost", lambda k, _: k != name), F.create_map(F.lit(name), was * value))
    return df.withColumn("field_boost", F.when(condition, put).otherwise(F.col("field_boost")))


def boost_keyword(df: DataFrame, condition: Column, value: Column, name: str, tokens: list[str]) -> DataFrame:
    """Append the tokens int(value) times to a field (MOD7c)."""
    more = F.repeat(F.lit(" " + " ".join(tokens)), F.greatest(value.cast("int"), F.lit(0)))
    return df.withColumn(name, F.when(condition, F.concat(F.coalesce(name, F.lit("")), more)).otherwise(F.col(name)))


def outlinks_ratio(links: Column, first: str, second: str, ignore: str = "^$", known: tuple[list[str], list[str], list[str]] = ([], [], [])) -> Column:
    """Links to hosts of the first kind per link of the second (MOD8): 0 without a first, the largest double without a second.

    A host is tried for ignore, first and second in this order; other hosts are ignored.
    """
    hosts = F.filter(F.transform(links, lambda x: host(x.url)), lambda h: h != "")

    def kind(h: Column) -> Column:
        is_in = lambda names, re: F.array_contains(strings(names), h) | h.rlike(f"^(?:{re})$")
        return F.when(is_in(known[0], ignore), 0).when(is_in(known[1], first), 1).when(is_in(known[2], second), 2).otherwise(0)

    kinds = F.transform(hosts, kind)
    n1, n2 = F.size(F.filter(kinds, lambda k: k == 1)), F.size(F.filter(kinds, lambda k: k == 2))
    return F.when(n1 == 0, F.lit(0.0)).when(n2 == 0, F.lit(1.7976931348623157e308)).otherwise(n1 / n2)


def override_categories(categories: Column, order: list[str]) -> Column:
    """Take away the listed categories in order, while two or more are left (MOD9)."""
    return reduce(lambda acc, c: F.when(F.size(acc) >= 2, F.array_remove(acc, c)).otherwise(acc), order, categories)


def word_filter(text: Column, phrases: list[str]) -> Column:
    """The words of a phrase stand in a text in this order, with others between or not (MOD10)."""

    def has(p: str) -> Column:
        gap = r"(?:\s(?:.*\s)?)"
        body = gap.join(_quote(w) for w in p.lower().split())
        return F.lower(text).rlike(rf"(?s)(?:^|\s){body}(?:\s|$)")

    return reduce(lambda a, b: a | b, [has(p) for p in phrases if p.split()], F.lit(False))


def _quote(w: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in w)


def language_tag(df: DataFrame, lang: Column) -> DataFrame:
    """Tag TAG_LANGUAGE_xx (MOD11)."""
    return df.withColumn("tags", F.array_sort(F.array_union("tags", F.array(F.concat(F.lit("TAG_LANGUAGE_"), lang)))))


def spam_score(title: Column, url: Column, patterns: UrlPatterns, longest: int = 150) -> Column:
    """0.3 for a title that is too long, 1 for a spam URL (MOD12)."""
    return F.when(F.length(title) > longest, 0.3).otherwise(0.0) + F.when(patterns.match(url), 1.0).otherwise(0.0)


def pipeline(modules: list[Module]) -> Module:
    """Modules in order (IDX2): each maps documents to documents."""
    return lambda df: reduce(lambda d, m: m(d), modules, df)


def crawl_stats(df: DataFrame) -> DataFrame:
    """Documents seen, to be indexed and hotspots (SNK13)."""
    return df.agg(F.count("*").alias("seen"), F.count_if(F.array_contains("tags", "emitdoc")).alias("indexable"), F.count_if(F.array_contains("tags", "hotspot")).alias("hotspots"))


def index_feed(df: DataFrame) -> DataFrame:
    """What goes to the index: add what is tagged emitdoc, delete what was sent before and is not (SNK3)."""
    op = F.when(F.array_contains("tags", "emitdoc"), "add").when(F.col("emitted"), "delete")
    return df.withColumn("op", op).where("op is not null")
