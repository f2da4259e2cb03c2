"""More queries: cleaning, feeds, routing, labels, boosts and one whole crawl cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import classifier, crawl, index, modules
from ..sources import html, sinks, tables
from .catalog_crawl import _CHILD_SQL, _PAGES_SQL, _TITLE, NOW, _children, _documents, page_table
from .registry import query, table


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS clean_md5 FROM pages")
def sanitize_html(spark, sf):
    """FN4."""
    return table(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("clean_md5"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS clean_md5 FROM documents")
def sanitize_xml(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.strip_invalid_xml(F.col("text"))).alias("clean_md5"))


@query(f"SELECT page_id, CASE WHEN left(trim({_TITLE}), 200) = '' THEN 'Untitled' ELSE left(trim({_TITLE}), 200) END AS title FROM pages")
def title_default(spark, sf):
    """FN11."""
    return table(spark, sf, "pages").select("page_id", text.title_or_default(html.title(F.col("html"))).alias("title"))


@query(f"WITH {_CHILD_SQL} SELECT url, string_agg(anchor, ' ' ORDER BY anchor) AS anchors FROM child GROUP BY url")
def anchor_text(spark, sf):
    """FN10."""
    return _children(spark, sf).groupBy("url").agg(text.anchor_text(F.sort_array(F.collect_list("anchor"))).alias("anchors"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'good,hotspot' ELSE 'bad' END AS tags FROM pages")
def white_list(spark, sf):
    """MOD3."""
    p = urls.UrlPatterns.parse(["https:// | .*"])
    return modules.white_list(_documents(spark, sf), p, (["good"], []), (["bad"], [])).select("page_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id, CASE WHEN n_chars >= 3000 AND doc_id % 7 >= 3 THEN 'long,odd' WHEN n_chars >= 3000 THEN 'long' WHEN doc_id % 7 >= 3 THEN 'odd' ELSE '' END AS categories, greatest(n_chars / 6000.0, (doc_id % 7) / 6.0)::DOUBLE AS overall FROM documents")
def category_scores(spark, sf):
    """MOD6 on given scores."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 6000.0).alias("a"), (F.col("doc_id") % 7 / 6.0).alias("b"), F.array().cast("array<string>").alias("categories"), F.from_json(F.lit("{}"), "map<string,double>").alias("attributes"))
    out = modules.bayes_categories(d, {"long": "a", "odd": "b"}, 0.5)
    return out.select("doc_id", F.array_join("categories", ",").alias("categories"), F.element_at("attributes", "OVERALL").alias("overall"))


@query(f"SELECT page_id, CASE WHEN contains(url, '/en/') THEN 2.5 ELSE 1.0 END::DOUBLE AS title_boost, length({_TITLE}) + CASE WHEN contains(url, '/en/') THEN 2 * length(' best page') ELSE 0 END::BIGINT AS title_chars FROM pages")
def field_boost(spark, sf):
    """MOD7: a field's boost, and words put behind a field."""
    p = urls.UrlPatterns.parse(["http | .*/en/.* ||| 2.5"])
    d = modules.boost_field(_documents(spark, sf), p.match(F.col("url")), modules.url_value(p, F.col("url")), "title")
    d = modules.boost_keyword(d, p.match(F.col("url")), modules.url_value(p, F.col("url")), "title", ["best", "page"])
    return d.select("page_id", F.coalesce(F.element_at("field_boost", "title"), F.lit(1.0)).alias("title_boost"), F.length("title").cast("long").alias("title_chars"))


@query("SELECT doc_id, 'TAG_LANGUAGE_' || lang AS tags FROM documents")
def language_tag(spark, sf):
    """MOD11 on the given language; ``lang_detect`` finds it."""
    d = table(spark, sf, "documents").withColumn("tags", F.array().cast("array<string>"))
    return modules.language_tag(d, F.col("lang")).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_CHILD_SQL} SELECT count(*) FILTER (distance > 2) AS discovered, count(*) AS children FROM child")
def discovery_count(spark, sf):
    """CRW20."""
    return _children(spark, sf).agg(F.count_if(F.col("distance") > 2).alias("discovered"), F.count("*").alias("children"))


@query("SELECT url, octet_length(encode(html))::INTEGER AS bytes FROM pages WHERE contains(url, '/en/')")
def cache_refresh(spark, sf):
    """SRC6: every page against a cache that holds the English ones."""
    p = table(spark, sf, "pages")
    cache = sinks.cache_rows(p.where(F.contains("url", F.lit("/en/"))), F.lit(NOW))
    return tables.from_cache(p.select("url"), cache).select("url", F.octet_length("content").alias("bytes"))


_SHARD3 = "(((('0x' || substr(md5(x), 1, 2))::INT + 128) % 256 * 256 + (('0x' || substr(md5(x), 3, 2))::INT + 128) % 256) % 3)::INTEGER"


@query(f"SELECT shard, count(*) AS n FROM (SELECT {_SHARD3} AS shard FROM (SELECT doc_id::VARCHAR AS x FROM documents)) GROUP BY shard")
def index_route(spark, sf):
    """IDX7, IDX8."""
    return index.route(table(spark, sf, "documents"), 3, F.col("doc_id").cast("string")).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT 'toxic' AS category, doc_id::VARCHAR AS url, CASE WHEN quality = 0 THEN 'unknown' WHEN toxic = 1 THEN 'included' ELSE 'excluded' END AS state FROM labels")
def relabel(spark, sf):
    """CLS9: labels of poor texts are taken back."""
    lab = table(spark, sf, "labels").select(F.lit("toxic").alias("category"), F.col("doc_id").cast("string").alias("url"), F.when(F.col("toxic") == 1, "included").otherwise("excluded").alias("state"), "quality")
    changes = lab.where("quality = 0").select("category", "url", F.lit("unknown").alias("state"), F.lit(1).cast("long").alias("seq"))
    return classifier.relabel(lab.drop("quality"), changes)


@query("SELECT DISTINCT 'http://' || c_mktsegment || '.example/' AS url, 1.0::DOUBLE AS score, 0::BIGINT AS distance FROM customer")
def seed_pages(spark, sf):
    """SRC2, SRC3."""
    names = table(spark, sf, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit(".example/ ")).alias("value")).distinct()
    return crawl.seeds(crawl.injected(names)).select("url", "score", "distance")


@query("SELECT event_type AS query FROM events WHERE value > 50")
def query_log(spark, sf):
    """SNK7: only what found something."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("query"), F.when(F.col("value") > 50, 1).otherwise(0).alias("total_results"))
    return sinks.query_log(e)


@query("SELECT event_id, epoch_us(ts) // 1000 || '_' || event_type AS history_id FROM events")
def history_ids(spark, sf):
    """SNK6."""
    return table(spark, sf, "events").select("event_id", sinks.history_id(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_type")).alias("history_id"))


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'add' ELSE 'delete' END AS op FROM pages WHERE contains(url, '/en/') OR starts_with(url, 'https')")
def index_feed(spark, sf):
    """SNK3."""
    d = _documents(spark, sf).withColumn("emitted", F.startswith("url", F.lit("https")))
    d = modules.match_url(d, urls.UrlPatterns.parse(["http | .*/en/.*"]), (["emitdoc"], []))
    return modules.index_feed(d).select("page_id", "op")


@query("SELECT DISTINCT l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 49")
def set_difference(spark, sf):
    """Sets of documents as the reference's Difference has them, on other keys."""
    li = table(spark, sf, "lineitem")
    a, b = li.where("l_returnflag = 'R'").select("l_suppkey"), li.where("l_returnflag = 'N' and l_quantity > 49").select("l_suppkey")
    return a.distinct().join(b, "l_suppkey", "left_anti").withColumnRenamed("l_suppkey", "supplier")


@query(f"WITH {_PAGES_SQL} SELECT page_id, last_success > 0 AS fetched, CASE WHEN page_id % 9 = 0 THEN 'pdf' ELSE 'html' END AS kind, CASE WHEN page_id % 9 = 1 THEN 'latin1' ELSE 'UTF-8' END AS charset FROM pg")
def content_kinds(spark, sf):
    """SRC8, SRC9 on content types by the id."""
    k = F.col("page_id") % 9
    kind = F.when(k == 0, "application/pdf").when(k == 1, "text/html; charset=latin1").otherwise(F.lit("text/html"))
    return page_table(spark, sf).select("page_id", (F.col("last_success") > 0).alias("fetched"), html.kind(kind, F.col("url")).alias("kind"), html.charset(kind).alias("charset"))


@query()
def crawl_cycle(spark, sf):
    """CRW18: the pages are the seeds, and all of them are fetched."""
    p = table(spark, sf, "pages")
    fetched = p.select("url", F.lit(True).alias("ok"), html.links(F.col("html"), F.col("url")).alias("links"), F.md5("html").alias("signature"))
    cfg = crawl.Config(max_distance=2, max_retries=(5, 5, 5))
    out = crawl.cycle(crawl.seeds(p.select(F.col("url").alias("value"))), fetched, NOW, 1, cfg)
    return out.select("url", F.round("score", 6).alias("score"), "distance", "n_inlinks", "last_success", F.round("priority", 4).alias("priority"))
