"""Queries on pages, the crawl cycle, document modules and click logs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, urls
from ..operators import crawl, loganalysis, modules
from ..sources import html
from .registry import query, table

# URL functions

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
_LABELS = f"string_split({_HOST}, '.')"
_DOMAIN = f"array_to_string({_LABELS}[CASE WHEN length({_LABELS}[-1]) = 2 THEN -3 ELSE -2 END :], '.')"


@query(f"SELECT page_id, {_HOST} AS host, array_to_string(list_filter({_LABELS}, lambda x: x NOT IN ('www', 'com', 'org', 'net')), ' ') || ' ' || {_DOMAIN} AS host_tokens FROM pages")
def host_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.host_tokens(urls.host(F.col("url"))).alias("host_tokens"))


@query("SELECT page_id, string_split(url, '#')[1] AS url FROM pages")
def url_fragment_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.strip_fragment(F.col("url")).alias("url"))


_SHARD = "(((('0x' || substr(md5(url), 1, 2))::INT + 128) % 256 * 256 + (('0x' || substr(md5(url), 3, 2))::INT + 128) % 256) % 7)::INTEGER"


@query(f"SELECT page_id, md5(url) AS url_md5, {_SHARD} AS shard FROM pages")
def url_md5_shard(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_hash(F.col("url")).alias("url_md5"), urls.shard_of(F.col("url"), 7).alias("shard"))


@query("SELECT event_id, ms // 86400000 AS fetched_day, ms // 3600000 AS fetched_hour, ms // 60000 AS fetched_minute, ms AS fetched_long FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)")
def time_attributes(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", *scoring.time_attributes(ms, "fetched"))


_RULES = ["http:// | .*/en/.* || page= ||| english,10", "https:// | .*example\\.com/.* ||| com,25", "https:// | .*\\.org/.* || #top ||| org", "# nothing", "http://ththre.example.com/ | .* ||| ththre,7"]


@query(
    """WITH u AS (SELECT page_id, lower(url) AS u FROM pages), m AS (SELECT page_id,
  starts_with(u, 'http://') AND regexp_full_match(substr(u, 8), '.*/en/.*') AND NOT contains(substr(u, 8), 'page=') AS a,
  starts_with(u, 'https://') AND regexp_full_match(substr(u, 9), '.*example\\.com/.*') AS b,
  starts_with(u, 'https://') AND regexp_full_match(substr(u, 9), '.*\\.org/.*') AND NOT contains(substr(u, 9), '#top') AS c,
  starts_with(u, 'http://ththre.example.com/') AS d FROM u)
SELECT page_id, a OR b OR c OR d AS matches, CASE WHEN a OR b OR c OR d THEN array_to_string(list_sort(list_concat(list_concat(
  CASE WHEN a THEN ['english', '10'] ELSE [] END, CASE WHEN b THEN ['com', '25'] ELSE [] END), list_concat(CASE WHEN c THEN ['org'] ELSE [] END, CASE WHEN d THEN ['ththre', '7'] ELSE [] END))), ',') END AS tokens FROM m"""
)
def url_patterns(spark, sf):
    p = urls.UrlPatterns.parse(_RULES)
    return table(spark, sf, "pages").select("page_id", p.match(F.col("url")).alias("matches"), F.array_join(p.tokens(F.col("url")), ",").alias("tokens"))


@query(
    """SELECT page_id, NOT regexp_matches(url, '^(file|ftp|mailto):') AND NOT regexp_matches(url, '\\.(gif|GIF|jpg|JPG|png|PNG|ico|ICO|css|sit|eps|wmf|zip|ppt|mpg|xls|gz|rpm|tgz|mov|MOV|exe|jpeg|JPEG|bmp|BMP|mpeg|swf)$') AS accepted FROM pages"""
)
def url_filter(spark, sf):
    """The rule on repeated segments has a back-reference, which the SQL form leaves out: no URL here repeats one."""
    return table(spark, sf, "pages").select("page_id", urls.accepted(F.col("url")).alias("accepted"))


_UNESC = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_BODY = "html"
for _p in ("(?is)<head[^>]*>.*?</head>", "(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<select[^>]*>.*?</select>", "(?is)<style[^>]*>.*?</style>", "(?s)<[^>]*>"):
    _BODY = f"regexp_replace({_BODY}, '{_p}', ' ', 'g')"
_BODY = f"trim(regexp_replace({_UNESC.format(_BODY)}, '[ \\t\\r\\n]+', ' ', 'g'))"
_TITLE = f"trim({_UNESC.format(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))})"


@query(f"SELECT page_id, {_TITLE} AS title, md5({_BODY}) AS text_md5, length({_BODY})::INTEGER AS n_chars, len(regexp_extract_all(html, '(?is)<a [^>]*?href=\"[^\"]*\"[^>]*>.*?</a>'))::INTEGER AS n_links FROM pages")
def html_extract(spark, sf):
    p = html.parsed(table(spark, sf, "pages"))
    return p.select("page_id", "title", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), F.size("links").alias("n_links"))


# The crawl cycle. Page states that the tables lack are derived from page_id.

NOW = 1_700_000_000_000
#: Page states by the id, in words that both engines read alike.
_STATE = {
    "distance": "page_id % 4",
    "retries": "page_id % 5",
    "score": "(page_id % 97 + 1) / 10.0",
    "anti_score": "CASE WHEN page_id % 13 = 0 THEN 0.5 + page_id % 3 ELSE 0.0 END",
    "last_success": f"CASE WHEN page_id % 3 = 0 THEN 0 ELSE {NOW} - (page_id % 400) * 86400000 END",
    "last_attempt": f"{NOW} - (page_id % 200) * 86400000",
    "last_change": f"CASE WHEN page_id % 3 = 0 THEN 0 ELSE {NOW} - (page_id % 700) * 86400000 END",
    "n_inlinks": "page_id % 6",
}
_PAGES_SQL = "pg AS (SELECT page_id, url, html, " + ", ".join(f"({v})::{'DOUBLE' if 'score' in k else 'BIGINT'} AS {k}" for k, v in _STATE.items()) + " FROM pages)"
_PRIO_SQL = f", pr AS (SELECT *, (({NOW} - last_success) - 0.4 * greatest(({NOW} - last_change) - ({NOW} - last_success), ({NOW} - last_success) - ({NOW} - last_attempt)) - 2 * (({NOW} - last_success) - ({NOW} - last_attempt))) / 10000.0 AS priority FROM pg)"


def page_table(spark: SparkSession, sf: str):
    p = table(spark, sf, "pages").select("page_id", "url", "html", *[F.expr(v).cast("double" if "score" in k else "long").alias(k) for k, v in _STATE.items()])
    return crawl.with_priority(p, NOW)


_OK_URL = "NOT regexp_matches({u}, '^(file|ftp|mailto):') AND NOT regexp_matches({u}, '\\.(gif|GIF|jpg|JPG|png|PNG|ico|ICO|css|sit|eps|wmf|zip|ppt|mpg|xls|gz|rpm|tgz|mov|MOV|exe|jpeg|JPEG|bmp|BMP|mpeg|swf)$')"
_CHILD_SQL = (
    _PAGES_SQL
    + """, hrefs AS (SELECT url AS parent, score, distance, regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) AS root, regexp_extract_all(html, '(?is)(<a [^>]*?href="[^"]*"[^>]*>.*?</a>)', 1) AS a FROM pg),
flat AS (SELECT parent, score, distance, root, unnest(a) AS a FROM hrefs),
abs_ AS (SELECT parent, score, distance, trim(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g')) AS anchor, """
    + _UNESC.format("CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN root || h ELSE root || '/' || h END")
    + """ AS url FROM (SELECT *, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS h FROM flat)),
good AS (SELECT * FROM abs_ WHERE """
    + _OK_URL.format(u="url")
    + """), cnt AS (SELECT parent, count(*) AS n FROM good GROUP BY parent),
child AS (SELECT parent, string_split(url, '#')[1] AS url, anchor, score / n AS score, distance + 1 AS distance FROM good JOIN cnt USING (parent)
  UNION ALL SELECT url, string_split(url, '#')[1], '', score, distance + 1 FROM pg WHERE url NOT IN (SELECT parent FROM cnt))"""
)


def _children(spark, sf):
    p = page_table(spark, sf)
    return crawl.children(p.select("url", "score", "distance", html.links(F.col("html"), F.col("url")).alias("links")))


@query(f"WITH {_CHILD_SQL} SELECT parent, url, anchor, round(score, 6) AS score, distance FROM child")
def link_explode(spark, sf):
    return _children(spark, sf).withColumn("score", F.round("score", 6))


@query(f"WITH {_PAGES_SQL}{_PRIO_SQL} SELECT page_id, (priority >= (SELECT quantile_cont(priority, 0.8) FROM pr) OR last_success = 0 AND retries < 3) AND {_OK_URL.format(u='url')} AS to_fetch FROM pr")
def fetch_select(spark, sf):
    return crawl.select_to_fetch(page_table(spark, sf)).select("page_id", "to_fetch")


@query(
    f"WITH {_PAGES_SQL} SELECT page_id, CASE WHEN page_id % 7 > 2 THEN 'done' WHEN page_id % 7 = 0 THEN 'keep' WHEN page_id % 7 = 1 AND NOT (distance >= 3 OR retries > [3, 2, 1][least(distance + 1, 3)] AND n_inlinks = 0) THEN 'retry' ELSE 'drop' END AS outcome FROM pg"
)
def retry_policy(spark, sf):
    cfg = crawl.Config(max_distance=2, max_retries=(3, 2, 1))
    k = F.col("page_id") % 7
    state = html.fetch_state(F.when(k > 2, "FETCH_SUCCESS").when(k == 0, "BLOCKED").when(k == 1, "RETRY").otherwise("GONE"))
    p = page_table(spark, sf).withColumn("s", state)
    late = crawl.too_many_retries(cfg, F.col("distance"), F.col("retries"), F.col("n_inlinks"))
    return p.select("page_id", crawl.retry_policy(F.col("s.success"), F.col("s.recoverable"), F.col("s.internal"), late).alias("outcome"))


def _records(spark, sf):
    p = page_table(spark, sf)
    none = F.array().cast("array<string>")
    own = p.select("url", "score", "anti_score", "priority", "distance", "retries", "last_attempt", "last_success", "last_change", F.lit(0).cast("long").alias("n_inlinks"), F.lit(False).alias("emitted"), none.alias("anchors"), none.alias("parents"), F.lit(None).cast("string").alias("signature"))
    kids = _children(spark, sf)
    zero = F.lit(0).cast("long")
    kids = kids.select("url", "score", F.lit(0.0).alias("anti_score"), F.lit(0.0).alias("priority"), "distance", zero.alias("retries"), zero.alias("last_attempt"), zero.alias("last_success"), zero.alias("last_change"), zero.alias("n_inlinks"), F.lit(False).alias("emitted"), F.array("anchor").alias("anchors"), F.array("parent").alias("parents"), F.lit(None).cast("string").alias("signature"))
    return own.unionByName(kids)


@query(
    f"""WITH {_CHILD_SQL}, rec AS (SELECT url, score, anti_score, distance, retries, last_attempt, last_success, last_change, NULL AS anchor, NULL AS parent FROM pg
  UNION ALL SELECT url, score, 0, distance, 0, 0, 0, 0, anchor, parent FROM child), w AS (SELECT count(*) AS n FROM rec)
SELECT min(url) AS url, round(CASE WHEN count(*) FILTER (last_success = 0) > 0 THEN 0.15 / n + 0.85 * sum(score) FILTER (last_success = 0) ELSE arg_max(score, last_success) END, 6) AS score,
  coalesce(min(distance), 0) AS distance, coalesce(max(retries) FILTER (last_success = 0), 0) AS retries, max(last_attempt) AS last_attempt, max(last_success) AS last_success, max(last_change) AS last_change,
  count(*) FILTER (last_success = 0) AS n_inlinks, coalesce(string_agg(DISTINCT anchor, '|' ORDER BY anchor), '') AS anchors, coalesce(string_agg(DISTINCT parent, '|' ORDER BY parent), '') AS parents
FROM rec, w GROUP BY lower(url), n"""
)
def trim_aggregate(spark, sf):
    r = _records(spark, sf)
    t = crawl.trim(r, r.agg(F.count("*").alias("web_size")))
    return t.select("url", F.round("score", 6).alias("score"), "distance", "retries", "last_attempt", "last_success", "last_change", "n_inlinks", F.array_join("anchors", "|").alias("anchors"), F.array_join("parents", "|").alias("parents"))


@query(
    f"""WITH {_PAGES_SQL}, front AS (SELECT page_id FROM pg WHERE distance = 2 AND last_success = 0 AND retries = 0 ORDER BY md5(url), url LIMIT 5)
SELECT page_id FROM pg WHERE distance <= 1 AND NOT (retries > 3 AND n_inlinks = 0) UNION ALL SELECT page_id FROM front"""
)
def page_filter(spark, sf):
    return crawl.keep_pages(page_table(spark, sf), 32, crawl.Config(max_distance=1, max_retries=(3,), front_size=5)).select("page_id")


@query(f"WITH {_PAGES_SQL}{_PRIO_SQL} SELECT page_id, round(priority, 4) AS priority FROM pr")
def priority(spark, sf):
    return page_table(spark, sf).select("page_id", F.round("priority", 4).alias("priority"))


def _rank_sql(rounds: int) -> str:
    out = """WITH e0 AS (SELECT DISTINCT 'c' || c_nationkey || '_' || o_custkey % 100 AS src, 's' || s_nationkey || '_' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  UNION SELECT DISTINCT 's' || s_nationkey || '_' || l_suppkey, 'c' || c_nationkey || '_' || o_custkey % 100 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 25),
n AS (SELECT src AS node FROM e0 UNION SELECT dst FROM e0), e AS (SELECT * FROM e0 UNION ALL SELECT node, node FROM n WHERE node NOT IN (SELECT src FROM e0)),
o AS (SELECT src, count(*) AS n_out FROM e GROUP BY src), w AS (SELECT count(*) AS n FROM n), r0 AS (SELECT node, 1.0::DOUBLE AS score FROM n)"""
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT n.node, 0.15 / w.n + 0.85 * coalesce(g.g, 0) AS score FROM n CROSS JOIN w LEFT JOIN (SELECT dst, sum(score / n_out) AS g FROM e JOIN o USING (src) JOIN r{k} ON r{k}.node = e.src GROUP BY dst) g ON g.dst = n.node)"
    return out + f" SELECT node, round(score, 6) AS score FROM r{rounds}"


@query(_rank_sql(4))
def pagerank_k(spark, sf):
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    bought = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey", (F.col("o_custkey") % 100).alias("k"))
    li = li.select("l_orderkey", "l_suppkey", (F.col("l_quantity") > 25).alias("back"))
    j = li.join(bought, li.l_orderkey == bought.o_orderkey).groupBy("c_nationkey", "k", "l_suppkey").agg(F.max("back").alias("back"))
    s = s.select("s_nationkey", "s_suppkey").distinct()
    low, high, most, n = s.agg(F.min("s_nationkey"), F.max("s_nationkey"), F.max(F.abs("s_suppkey")), F.count("*")).first()
    j = j.join(F.broadcast(s) if n <= crawl.HELD else s, j.l_suppkey == s.s_suppkey)
    a, b = F.concat(F.lit("c"), "c_nationkey", F.lit("_"), "k"), F.concat(F.lit("s"), "s_nationkey", F.lit("_"), "l_suppkey")
    name = F.col("node")
    if most is not None and low is not None and low >= 0 and high < 4096 and most < 1 << 50:  # a node is a number: its parts, and at last whose it is
        a = F.shiftleft(F.col("c_nationkey").cast("long"), 9).bitwiseOR(((F.col("k") + 100) * 2).cast("long"))
        b = F.shiftleft(F.col("l_suppkey").cast("long"), 13).bitwiseOR((F.col("s_nationkey") * 2 + 1).cast("long"))
        part = lambda at, bits: F.shiftright("node", at).bitwiseAND(F.lit((1 << bits) - 1))
        of_c = F.concat(F.lit("c"), F.shiftright("node", 9), F.lit("_"), part(1, 8) - 100)
        name = F.when(part(0, 1) == 0, of_c).otherwise(F.concat(F.lit("s"), part(1, 12), F.lit("_"), F.shiftright("node", 13)))
    both = F.array(F.struct(a.alias("src"), b.alias("dst")), F.when(F.col("back"), F.struct(b.alias("src"), a.alias("dst"))))
    edges = j.select(F.explode(F.array_compact(both)).alias("e")).select("e.src", "e.dst")
    return crawl.pagerank(edges, None, 4).select(name.alias("node"), F.round("score", 6).alias("score"))


@query(f"WITH {_CHILD_SQL}, par AS (SELECT DISTINCT url, parent FROM child), k AS (SELECT url, count(*) AS n FROM par GROUP BY url) SELECT parent AS url, -1.0::DOUBLE AS score, round(CASE WHEN length(url) % 5 = 0 THEN 0.5 ELSE 0 END / n, 6) AS anti_score FROM par JOIN k USING (url) WHERE length(url) % 5 = 0")
def antiscore_backprop(spark, sf):
    kids = _children(spark, sf).groupBy("url").agg(F.collect_set("parent").alias("parents"))
    bad = kids.withColumn("anti_score", F.when(F.length("url") % 5 == 0, 0.5).otherwise(0.0))
    return crawl.anti_scores(bad).withColumn("anti_score", F.round("anti_score", 6))


@query("SELECT url, CASE WHEN starts_with(url, 'https') THEN 'first' ELSE 'second' END AS origin FROM pages WHERE starts_with(url, 'https') OR contains(url, '/en/')")
def pagedb_merge(spark, sf):
    p = table(spark, sf, "pages")
    a = p.where(F.startswith("url", F.lit("https"))).select("url", F.lit("first").alias("origin"))
    b = p.where(F.contains("url", F.lit("/en/"))).select("url", F.lit("second").alias("origin"))
    return crawl.merge_tables(a, b)


@query(
    f"""WITH {_PAGES_SQL}{_PRIO_SQL} SELECT count(*) AS pages, count(*) FILTER (last_success > 0) AS fetched, count(*) FILTER (last_success = 0 AND last_attempt > 0) AS failed, round(sum(score) FILTER (last_success > 0), 4) AS score_fetched,
  round(min(priority), 4) AS least_priority, round(max(score), 4) AS most_score, round(quantile_cont(score, 0.25), 4) AS score_25, round(quantile_cont(anti_score, 0.95), 4) AS anti_95 FROM pr"""
)
def pagedb_stats(spark, sf):
    s = crawl.page_stats(page_table(spark, sf))
    r = lambda c: F.round(c, 4)
    return s.select("pages", "fetched", "failed", r("score_fetched").alias("score_fetched"), r("least_priority").alias("least_priority"), r("most_score").alias("most_score"), r(F.element_at("score_percentiles", 6)).alias("score_25"), r(F.element_at("anti_score_percentiles", 20)).alias("anti_95"))


@query(f"WITH {_PAGES_SQL} SELECT distance, retries, count(*) AS n FROM pg GROUP BY ALL")
def pagedb_histogram(spark, sf):
    return page_table(spark, sf).groupBy("distance", "retries").agg(F.count("*").alias("n"))


# Scoring

@query("SELECT event_id, CASE WHEN g < 3600000 THEN 100.0 WHEN g < 7200000 THEN 60.0 WHEN g < 43200000 THEN 40.0 WHEN g < 86400000 THEN 30.0 WHEN g < 172800000 THEN 20.0 WHEN g < 604800000 THEN 10.0 WHEN g < 2592000000 THEN 5.0 ELSE 1.0 END::DOUBLE AS boost FROM (SELECT event_id, abs(1706000000000 - epoch_ms(ts)) AS g FROM events)")
def date_payload_boost(spark, sf):
    return table(spark, sf, "events").select("event_id", scoring.date_boost(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(1_706_000_000_000)).alias("boost"))


@query("SELECT o_orderkey, round(1 + 3.0 * 30 / (d + 30), 6) AS boost FROM (SELECT o_orderkey, abs(date_diff('day', o_orderdate::DATE, DATE '1998-01-01')) AS d FROM orders)")
def shortdate_boost(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("long")
    return table(spark, sf, "orders").select("o_orderkey", F.round(scoring.short_date_boost(day, F.lit("1998-01-01").cast("date"), 3.0, 30.0), 6).alias("boost"))


@query("SELECT p_partkey, round(1 + 2.5 * least(p_size, 40) / 40.0, 6)::DOUBLE AS boost FROM part")
def scalar_boost(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(scoring.scalar_boost(F.col("p_size"), 2.5, 40), 6).alias("boost"))


_BUCKET = "CASE WHEN len(list_filter({b}, lambda x: x <= {v})) >= 11 THEN 10.0 ELSE greatest(greatest(len(list_filter({b}, lambda x: x <= {v})) - 1, 0) + CASE WHEN len(list_filter({b}, lambda x: x <= {v})) >= 1 AND {b}[len(list_filter({b}, lambda x: x <= {v})) + 1] > {b}[len(list_filter({b}, lambda x: x <= {v}))] THEN ({v} - {b}[len(list_filter({b}, lambda x: x <= {v}))]) / ({b}[len(list_filter({b}, lambda x: x <= {v})) + 1] - {b}[len(list_filter({b}, lambda x: x <= {v}))]) ELSE 0 END, 0.1) END"


def _damp(x: str) -> str:
    return f"pow(least(greatest({x}, 0.01), 15), pow(2, -6))"


_DEC = "[k / 10.0 for k in range(0, 11)]"


@query(
    f"""WITH {_PAGES_SQL}, q AS (SELECT quantile_cont(score, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS sb, quantile_cont(anti_score, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS ab FROM pg),
f AS (SELECT page_id, {_BUCKET.format(b='sb', v='score')} AS pr, CASE WHEN ab[1] = ab[11] THEN 1.0 ELSE greatest((10 - {_BUCKET.format(b='ab', v='anti_score')}) / 10, 0.01) END AS sp,
  CASE WHEN n_inlinks > 1 THEN ln(n_inlinks) ELSE 0.1 END AS lg, 1 + 10.0 * 15 / (greatest(({NOW} - last_change) // 86400000, 1) + 15) AS fr FROM pg, q)
SELECT page_id, round(greatest({_damp('pr')} * {_damp('sp')} * {_damp('lg')} * {_damp('fr')}, 1e-6), 6) AS boost FROM f"""
)
def doc_boost_product(spark, sf):
    p = page_table(spark, sf)
    b = scoring.deciles(p, F.col("score"), "sb").crossJoin(scoring.deciles(p, F.col("anti_score"), "ab"))
    p = p.crossJoin(F.broadcast(b))
    days = F.floor((F.lit(NOW) - F.col("last_change")) / 86_400_000)
    parts = [scoring.decile_bucket(F.col("score"), F.col("sb")), scoring.spam_boost(F.col("anti_score"), F.col("ab")), scoring.log_boost(F.col("n_inlinks")), scoring.freshness_boost(days)]
    return p.select("page_id", F.round(scoring.document_boost([scoring.damped(x, 0.3) for x in parts]), 6).alias("boost"))


# Document modules

def _documents(spark, sf):
    none = F.array().cast("array<string>")
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    p = html.parsed(table(spark, sf, "pages"))
    return p.select("page_id", "url", "title", "text", "links", none.alias("tags"), none.alias("categories"), empty.alias("attributes"), F.lit(1.0).alias("boost"), empty.alias("field_boost"))


@query(
    f"""WITH {_CHILD_SQL.replace('child AS', 'child0 AS')}, h AS (SELECT parent, {_HOST} AS host FROM abs_ WHERE {_HOST} <> ''), c AS (SELECT parent, count(*) FILTER (regexp_full_match(host, '.*\\.com')) AS a, count(*) FILTER (NOT regexp_full_match(host, '.*\\.com') AND regexp_full_match(host, '.*\\.(org|net)')) AS b FROM h GROUP BY parent)
SELECT page_id, CASE WHEN coalesce(a, 0) = 0 THEN 0.0 WHEN b = 0 THEN 1.7976931348623157e308 ELSE round(a / b, 6) END::DOUBLE AS ratio FROM pages LEFT JOIN c ON parent = url"""
)
def outlinks_ratio(spark, sf):
    d = _documents(spark, sf)
    r = modules.outlinks_ratio(F.col("links"), r".*\.com", r".*\.(org|net)")
    return d.select("page_id", F.when(r < 1e300, F.round(r, 6)).otherwise(r).alias("ratio"))


@query(f"SELECT page_id, (CASE WHEN length({_TITLE}) > 40 THEN 0.3 ELSE 0.0 END + CASE WHEN contains(lower(url), 'page=') THEN 1.0 ELSE 0.0 END)::DOUBLE AS anti_score FROM pages")
def spam_score(spark, sf):
    p = urls.UrlPatterns.parse(["http | .*page=.*"])
    return _documents(spark, sf).select("page_id", modules.spam_score(F.col("title"), F.col("url"), p, 40).alias("anti_score"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND n_chars > 2000 THEN 'long' WHEN lang = 'en' THEN 'en' ELSE lang || ',long' END AS categories FROM (SELECT doc_id, lang, n_chars FROM documents)")
def override_category(spark, sf):
    long_ = F.col("n_chars") > 2000
    cats = F.when(F.col("lang") == "en", F.when(long_, F.array(F.lit("en"), F.lit("long"))).otherwise(F.array(F.lit("en")))).otherwise(F.array(F.col("lang"), F.lit("long")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(modules.override_categories(cats, ["en"]), ",").alias("categories"))


@query("SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'body,long' END AS tags, n_chars::DOUBLE AS attribute FROM documents")
def threshold_tags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.array().cast("array<string>").alias("tags"), F.from_json(F.lit("{}"), "map<string,double>").alias("attributes"))
    t = modules.threshold(d, F.col("n_chars").cast("double"), 1000, (["short"], ["long", "body"]), (["long", "body"], ["short"]), "SIZE_MODULE_RESULTING_SCORE")
    return t.select("doc_id", F.array_join("tags", ",").alias("tags"), F.element_at("attributes", "SIZE_MODULE_RESULTING_SCORE").alias("attribute"))


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' ELSE '' END AS categories, CASE WHEN contains(url, '/en/') THEN 'found' ELSE 'other' END AS tags FROM pages")
def pattern_categories(spark, sf):
    p = urls.UrlPatterns.parse(["http | .*/en/.* ||| english"])
    out = modules.pattern_categories(_documents(spark, sf), p, (["found"], []), (["other"], []))
    return out.select("page_id", F.array_join("categories", ",").alias("categories"), F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id, CASE WHEN list_contains(string_split(text, ' '), 'from') OR list_contains(string_split(text, ' '), 'idiot') THEN 2.5 ELSE 1.0 END::DOUBLE AS boost FROM documents")
def keyword_boost(spark, sf):
    d = table(spark, sf, "documents").withColumn("boost", F.lit(1.0))
    return modules.boost_document(d, modules.keyword_condition(F.col("text"), ["from", "idiot"]), F.lit(2.5)).select("doc_id", "boost")


@query("SELECT doc_id, regexp_matches(lower(text), '(?s)(?:^|\\s)apache(?:\\s(?:.*\\s)?)version(?:\\s|$)') OR regexp_matches(lower(text), '(?s)(?:^|\\s)idiot(?:\\s|$)') AS found FROM documents")
def word_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", modules.word_filter(F.col("text"), ["apache version", "idiot"]).alias("found"))


@query("SELECT count(*) AS seen, count(*) FILTER (contains(url, '/en/')) AS indexable, count(*) FILTER (starts_with(url, 'https')) AS hotspots FROM pages")
def crawl_stats(spark, sf):
    d = _documents(spark, sf)
    steps = modules.pipeline([
        lambda x: modules.white_list(x, urls.UrlPatterns.parse(["https | .*"])),
        lambda x: modules.match_url(x, urls.UrlPatterns.parse(["http | .*/en/.*"]), (["emitdoc"], [])),
    ])
    return modules.crawl_stats(steps(d))


# Click logs: a visitor's event is a query of its type with one result

_LOG_SQL = """q AS (SELECT event_id AS query_id, event_type AS query, user_id AS ip, ts AS time FROM events),
r AS (SELECT event_id AS query_id, event_id AS result_id, 'link' || user_id % 50 AS link, event_type = 'click' AS clicked, (event_id * 7) % 23 AS distance FROM events WHERE event_type <> 'error')"""


def _queries(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("query"), F.col("user_id").alias("ip"), F.col("ts").alias("time"))


def _results(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'error'")
    return e.select(F.col("event_id").alias("query_id"), F.col("event_id").alias("result_id"), F.concat(F.lit("link"), F.col("user_id") % 50).alias("link"), (F.col("event_type") == "click").alias("clicked"), (F.col("event_id") * 7 % 23).alias("distance"))


def _tag_lists(spark, sf):
    return _results(spark, sf).select("result_id", (F.col("result_id") % 5).alias("tag_id"))


@query(f"WITH {_LOG_SQL} SELECT query, count(*) AS n FROM q WHERE time >= TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-20' GROUP BY query ORDER BY n DESC, query LIMIT 3")
def top_queries(spark, sf):
    import datetime as dt

    return loganalysis.top_queries(_queries(spark, sf), 3, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))


@query(f"WITH {_LOG_SQL} SELECT query, count(*) AS n FROM q WHERE query_id NOT IN (SELECT query_id FROM r WHERE clicked) GROUP BY query ORDER BY n DESC, query LIMIT 3")
def unsuccessful_queries(spark, sf):
    return loganalysis.unsuccessful(_queries(spark, sf), _results(spark, sf), 3)


@query(f"WITH {_LOG_SQL} SELECT link, floor(avg(distance))::BIGINT AS distance FROM r WHERE clicked AND result_id % 5 IN (1, 3) GROUP BY link")
def worst_placed(spark, sf):
    return loganalysis.worst_placed(_results(spark, sf), _tag_lists(spark, sf), [1, 3])


@query(f"WITH {_LOG_SQL} SELECT DISTINCT query_id, clicked, link FROM r WHERE starts_with(link, 'link1')")
def clicks_distinct(spark, sf):
    return loganalysis.clicks(_results(spark, sf), "link1")


@query(f"WITH {_LOG_SQL} SELECT link, count(*) FILTER (NOT clicked) AS shown, count(*) FILTER (clicked) AS clicks, round(CASE WHEN count(*) FILTER (NOT clicked) > 0 THEN count(*) FILTER (clicked) / count(*) FILTER (NOT clicked) END, 6) AS ratio FROM r GROUP BY link")
def click_ratio(spark, sf):
    return loganalysis.click_ratio(_results(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_LOG_SQL} SELECT link, count(*) AS n FROM r WHERE NOT clicked GROUP BY link ORDER BY n DESC, link LIMIT 10")
def best_placed_spam(spark, sf):
    return loganalysis.best_placed_spam(_results(spark, sf), n=10)


@query(
    f"""WITH {_LOG_SQL}, s AS (SELECT *, CASE WHEN time - lag(time) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY ip ORDER BY time, query_id)),
t AS (SELECT *, sum(new) OVER (PARTITION BY ip ORDER BY time, query_id) AS k FROM s), u AS (SELECT string_agg(query, ' --> ' ORDER BY time, query_id) AS sequence FROM t GROUP BY ip, k HAVING count(*) >= 2)
SELECT sequence, count(*) AS n FROM u GROUP BY sequence"""
)
def query_sequences(spark, sf):
    return loganalysis.query_sequences(_queries(spark, sf), "ip", "time", "query", ["query_id"])


@query(f"WITH {_LOG_SQL} SELECT result_id, link FROM r WHERE result_id % 5 IN (0, 2)")
def tag_semijoin(spark, sf):
    tags = spark.createDataFrame([(k, name) for k, name in enumerate(["news", "blog", "shop", "wiki", "forum"])], "tag_id long, name string")
    return loganalysis.tagged(_results(spark, sf), _tag_lists(spark, sf), tags, ["news", "shop"]).select("result_id", "link")


@query("SELECT event_type, round(max(value) FILTER (value < 60), 6) AS most, round(min(value) FILTER (value < 60), 6) AS least, round(quantile_cont(value, 0.95) FILTER (value < 60), 6) AS p95, round(avg(value) FILTER (value < 60), 6) AS mean, count(*) FILTER (value < 60) AS correct, count(*) FILTER (value >= 60) AS errors FROM events GROUP BY event_type")
def event_stats(spark, sf):
    s = loganalysis.event_stats(table(spark, sf, "events"), "event_type", "value", F.col("value") >= 60)
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("most", "least", "p95", "mean")], "correct", "errors")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 6) AS throughput FROM events")
def moving_throughput(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return loganalysis.moving_throughput(e, "user_id", "at", "value").select("event_id", F.round("throughput", 6).alias("throughput"))
