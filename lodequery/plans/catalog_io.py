"""Queries on request parameters, query syntax, feeds, module gates and the lines of sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, index, modules, search
from ..sources import sinks, tables
from . import ast, parser
from .catalog_search import _TWO, docs, indexed
from .registry import TOK_SQL, query, table


@query(f"{_TWO} SELECT doc_id, round((sa + sb) / norm, 6) AS score FROM s WHERE ha AND hb")
def lazy_query(spark, sf):
    """QRY9: a text inside a tree, parsed when it is compiled."""
    hits = search.search(indexed(spark, sf), ast.And((ast.Lazy("from tion"),)))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_TWO} SELECT doc_id FROM s WHERE ha AND hb")
def phrase_added(spark, sf):
    """QRY11: the words, or the same words as a phrase."""
    return search.search(indexed(spark, sf), parser.add_phrase("from tion")).select("doc_id")


@query(f"WITH {TOK_SQL} SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'fro'))) > 0")
def prefix_query(spark, sf):
    """QRY10: terms that begin so."""
    return search.search(indexed(spark, sf), "fro*").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source >= 'src1' AND source < 'src3'")
def range_syntax(spark, sf):
    """QRY10: a range with one open end."""
    return search.search(indexed(spark, sf), "source:[src1 TO src3}").select("doc_id")


@query(f"WITH {TOK_SQL} SELECT doc_id FROM tok WHERE list_contains(t, 'from') AND source IN ('src1', 'src2')")
def field_group_syntax(spark, sf):
    """QRY10: several words of one field."""
    return search.search(indexed(spark, sf), "from source:(src1 OR src2)").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'")
def filters_param(spark, sf):
    """FLT5: filters of request parameters."""
    ix = search.Index(docs(spark, sf), {"text": "tokens"}, {"categories": "lang", "site": "source"})
    return search.search(ix, ast.MatchAll(), parser.filters_of(["en, fr"], site="src1")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source BETWEEN 'src1' AND 'src3'")
def filter_vectors(spark, sf):
    """FLT6."""
    return search.search(indexed(spark, sf), ast.MatchAll(), parser.filters_of_vectors([["lang", "en"], ["source", "src1", "src3"]])).select("doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY lang DESC NULLS LAST, n_chars NULLS LAST, doc_id LIMIT 50")
def order_param(spark, sf):
    """SRT3: an order given as text; the limit is the page's."""
    d = table(spark, sf, "documents").withColumn("score", F.lit(1.0))
    return search.top_hits(d, parser.order_of("lang:reverse,n_chars:int"), "doc_id", 50).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 <> 0 THEN 1.0 ELSE 9.0 END::DOUBLE AS boost FROM documents")
def gated_module(spark, sf):
    """MOD0: a module leaves alone what has one tag or lacks another."""
    tags = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, "skip"), F.when(F.col("doc_id") % 5 == 0, "due")))
    d = table(spark, sf, "documents").select("doc_id", tags.alias("tags"), F.lit(1.0).alias("boost"))
    return modules.gated(lambda x: x.withColumn("boost", F.lit(9.0)), on=["skip"], on_missing=["due"])(d).select("doc_id", "boost")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def batch_append(spark, sf):
    """IDX5: a batch index keeps every add."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    feed = o.where("o_orderkey % 2 = 1").withColumn("op", F.lit("add"))
    return index.append_only(o.where("o_orderkey % 2 = 0"), feed)


@query("SELECT url, n::BIGINT AS n FROM (SELECT url, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 2 = 0) GROUP BY url)")
def append_pages(spark, sf):
    """CRW15."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return crawl.append(p.select("url"), p.where("page_id % 2 = 0").select("url")).groupBy("url").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'delete' ELSE 'add' END AS op FROM documents WHERE doc_id % 6 IN (4, 5)")
def valid_adds(spark, sf):
    """SCR2: adds need a finite boost above 0."""
    k = F.col("doc_id") % 6
    boost = F.when(k == 0, 0.0).when(k == 1, -1.0).when(k == 2, float("nan")).when(k == 3, float("inf")).when(k == 4, 1.5)
    feed = table(spark, sf, "documents").select("doc_id", F.when(k == 5, "delete").otherwise("add").alias("op"), boost.alias("boost"))
    return tables.valid_adds(feed)[0].select("doc_id", "op")


@query(
    """SELECT 'good' AS category, 'd' || d.doc_id AS url, CASE WHEN max(l.quality) = 1 THEN 'included' WHEN max(l.toxic) = 1 THEN 'excluded' ELSE 'unknown' END AS state
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def label_lists(spark, sf):
    """SRC17."""
    of = lambda d: d.select(F.concat(F.lit("d"), "doc_id").alias("url"))
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    return tables.label_lists(of(lab.where("quality = 1")), of(lab.where("toxic = 1")), of(table(spark, sf, "documents")), "good")


@query("SELECT 300::BIGINT AS documents, 20::INTEGER AS least_words, 20::INTEGER AS most_words, 3::BIGINT AS words")
def random_documents(spark, sf):
    """SRC15."""
    d = tables.random_documents(spark, 300, ["one", "two", "three"], 20, 7).withColumn("w", F.split("text", " "))
    return d.select(F.size("w").alias("n"), F.array_distinct("w").alias("w")).agg(F.count("*").alias("documents"), F.min("n").alias("least_words"), F.max("n").alias("most_words"), F.max(F.size("w")).cast("long").alias("words"))


@query("SELECT url, 2::BIGINT AS fetched_at FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)")
def cached_page(spark, sf):
    """SRC16: the newest version up to a time."""
    p = table(spark, sf, "pages")
    cache = p.select("url", F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, 5)])).alias("fetched_at"))
    first = p.orderBy("page_id").first()
    return tables.cached_page(cache, first["url"], F.lit(2))


@query("SELECT url, true AS ok FROM pages")
def fetch_with_retry(spark, sf):
    """SRC5: a fetch that brings nothing is tried again."""
    p = table(spark, sf, "pages").select("url")
    calls = iter((False, True))
    return tables.fetch_with_retry(lambda urls: urls.withColumn("ok", F.lit(next(calls))), p)


@query("SELECT 'add' AS op, doc_id::VARCHAR AS doc_id, 2.5::DOUBLE AS boost, lang AS lang, true AS stored, n_chars AS size, doc_id AS seq FROM documents")
def index_documents(spark, sf):
    """SRC11: index commands from XML."""
    d = table(spark, sf, "documents")
    xml = F.concat(F.lit("<documentAdd><documentId>"), "doc_id", F.lit('</documentId><boost>2.5</boost><field name="lang" stored="true" indexed="true" tokenized="false">'), "lang", F.lit('</field><payload name="size">'), "n_chars", F.lit("</payload></documentAdd>"))
    out = tables.index_documents(d.select(xml.alias("value"), F.col("doc_id").alias("seq")))
    f = F.element_at("fields", 1)
    return out.select("op", "doc_id", "boost", f["text"].alias("lang"), f["stored"].alias("stored"), F.element_at("payloads", "size").alias("size"), "seq")


@query("SELECT n_nationkey::BIGINT AS result_id, n_regionkey::BIGINT AS tag_id FROM nation")
def checked_tags(spark, sf):
    """SNK8: every tag must be known."""
    tags = table(spark, sf, "region").select(F.col("r_regionkey").alias("tag_id"))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("result_id"), F.col("n_regionkey").alias("tag_id"))
    return sinks.checked_tags(rows, tags).select("result_id", "tag_id")


@query("SELECT p_partkey || ':' || (p_size / 64.0)::DOUBLE AS value FROM part")
def model_lines(spark, sf):
    """SNK11."""
    return sinks.model_lines(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("token"), (F.col("p_size") / 64.0).alias("prob")))


@query("""SELECT '{"url":"' || url || '","tags":["a","b"],"categories":["c"],"attributes":{"size":' || page_id::DOUBLE || '}}' AS value FROM pages WHERE NOT contains(url, '"')""")
def crawl_lines(spark, sf):
    """SNK12: one attribute of two is written."""
    attributes = F.create_map(F.lit("size"), F.col("page_id").cast("double"), F.lit("other"), F.lit(1.0))
    d = table(spark, sf, "pages").where(~F.contains("url", F.lit('"'))).select("url", F.array(F.lit("b"), F.lit("a")).alias("tags"), F.array(F.lit("c")).alias("categories"), attributes.alias("attributes"))
    return sinks.crawl_lines(d, ["size"])


@query("""SELECT n_nationkey AS rank, '{"rank":' || n_nationkey || ',"name":"' || n_name || '"}' AS json FROM nation""")
def result_json(spark, sf):
    """SNK9."""
    return sinks.result_json(table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("name")))
