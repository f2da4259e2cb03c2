import random

from pyspark.sql import functions as F

from lodequery.functions.urls import UrlPatterns
from lodequery.operators import classifier, crawl, index, loganalysis, modules
from lodequery.sources import tables


def test_pagerank_sums_to_one(spark):
    rng = random.Random(4)
    edges = {(f"n{a}", f"n{rng.randrange(12)}") for a in range(10) for _ in range(3)}
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(12)], "node string")
    got = crawl.pagerank(spark.createDataFrame(sorted(edges), "src string, dst string"), nodes, 8)
    total = got.agg(F.sum("score")).first()[0]
    assert abs(total - (12 * 0.85**8 + (1 - 0.85**8))) < 1e-6  # from 12 towards 1


def test_spam_reaches_the_parents(spark):
    rows = [("n1", 0.6, ["n0", "n9"]), ("n2", 0.0, ["n1"])]
    got = crawl.anti_scores(spark.createDataFrame(rows, "url string, anti_score double, parents array<string>")).collect()
    assert sorted((r.url, r.score, r.anti_score) for r in got) == [("n0", -1.0, 0.3), ("n9", -1.0, 0.3)]


def _pages(spark, rows):
    names = ["url", "score", "anti_score", "distance", "retries", "last_success", "anchors", "parents"]
    df = spark.createDataFrame(rows, "url string, score double, anti_score double, distance long, retries long, last_success long, anchors array<string>, parents array<string>")
    zero = F.lit(0).cast("long")
    given = {"last_attempt": F.col("last_success"), "last_change": F.col("last_success"), "n_inlinks": zero, "priority": F.lit(0.0), "emitted": F.lit(False), "signature": F.lit(None).cast("string")}
    return df.select(*names, *[v.alias(k) for k, v in given.items()])


def test_trim(spark):
    rows = [("http://A/", 1.0, 0.0, 3, 0, 50, [], []), ("http://a/", 0.5, 0.0, 1, 2, 0, ["x"], ["p"]), ("http://a/", -1.0, 0.4, 0, 0, 0, [], []), ("http://b/", 2.0, 0.0, 2, 1, 0, ["y"], [])]
    got = {r.url.lower(): r for r in crawl.trim(_pages(spark, rows), spark.createDataFrame([(4,)], "web_size long")).collect()}
    a = got["http://a/"]
    assert a.distance == 1 and a.retries == 2 and a.n_inlinks == 1 and a.anchors == ["x"] and a.parents == ["p"] and a.last_success == 50
    assert abs(a.score - (0.15 / 4 + 0.85 * 0.5)) < 1e-9 and abs(a.anti_score - (0.15 / 4 + 0.85 * 0.4) / 2) < 1e-9


def test_cycle_reaches_new_pages(spark):
    seeds = crawl.seeds(spark.createDataFrame([("http://a.x/",), (" ",)], "value string"))
    fetched = spark.createDataFrame([("http://a.x/", True, [("http://b.x/#top", "b")], "s")], "url string, ok boolean, links array<struct<url: string, anchor: string>>, signature string")
    out = crawl.cycle(seeds, fetched, 1000, 1, crawl.Config(max_distance=2, max_retries=(5, 5, 5))).collect()
    assert {r.url for r in out} == {"http://a.x/", "http://b.x/"}
    assert {r.url: r.last_success for r in out}["http://a.x/"] == 1000


def test_injection_is_all_or_nothing(spark):
    import pytest

    assert crawl.injected(spark.createDataFrame([("a.com/x",)], "value string")).first()[0] == "http://a.com/x"
    with pytest.raises(Exception, match="no URL"):
        crawl.injected(spark.createDataFrame([("a.com",), ("http://",)], "value string")).collect()


def test_modules(spark):
    none = F.array().cast("array<string>")
    m = F.from_json(F.lit("{}"), "map<string,double>")
    d = spark.createDataFrame([("http://spam/", "big idiot here"), ("http://ok/", "fine")], "url string, text string").select("url", "text", F.lit("t").alias("title"), none.alias("tags"), none.alias("categories"), m.alias("attributes"), F.lit(1.0).alias("boost"), m.alias("field_boost"))
    p = UrlPatterns.parse(["http://spam | .* ||| bad,3"])
    out = {r.url: r for r in modules.pattern_categories(d, p, (["hit"], []), (["miss"], [])).collect()}
    assert out["http://spam/"].categories == ["3", "bad"] and out["http://spam/"].tags == ["hit"] and out["http://ok/"].tags == ["miss"]
    b = modules.boost_field(modules.boost_document(d, p.match(F.col("url")), modules.url_value(p, F.col("url"))), F.lit(True), F.lit(2.0), "title")
    assert {r.url: (r.boost, r.field_boost["title"]) for r in b.collect()} == {"http://spam/": (3.0, 2.0), "http://ok/": (1.0, 2.0)}
    assert d.select(modules.word_filter(F.col("text"), ["big here"]).alias("v"), "url").where("v").first().url == "http://spam/"
    gate = modules.gated(lambda x: x.withColumn("boost", F.lit(9.0)), on=["skip"])
    tagged = d.withColumn("tags", F.when(F.col("url") == "http://ok/", F.array(F.lit("skip"))).otherwise(F.col("tags")))
    assert {r.url: r.boost for r in gate(tagged).collect()} == {"http://spam/": 9.0, "http://ok/": 1.0}


def test_override_categories(spark):
    f = lambda cats, order: spark.range(1).select(modules.override_categories(F.array(*[F.lit(c) for c in cats]), order).alias("v")).first().v
    assert f(["a", "b", "c"], ["b", "a"]) == ["c"] and f(["a"], ["a"]) == ["a"] and f(["a", "b"], ["b", "a"]) == ["a"]


def test_outlinks(spark):
    d = spark.createDataFrame([([("http://x.ar/", ""), ("http://y.com/", ""), ("http://z.com/", ""), ("bad", "")],)], "links array<struct<url: string, anchor: string>>")
    r = lambda a, b: d.select(modules.outlinks_ratio(F.col("links"), a, b).alias("v")).first().v
    assert r(r".*\.ar", r".*\.com") == 0.5 and r(r".*\.fr", ".*") == 0.0 and r(r".*\.ar", r".*\.fr") > 1e300


def test_token_probabilities(spark):
    rows = [("only_in", 9, 0), ("mostly_in", 9, 2), ("even", 5, 4), ("mostly_out", 1, 8), ("only_out", 0, 6)]
    counts = spark.createDataFrame(rows, "token string, doc_in long, doc_out long")
    totals = spark.createDataFrame([(10, 8)], "n_in long, n_out long")
    got = {r.token: r.prob for r in classifier.token_probabilities(counts, totals, (0, 0, 0), (0.45, 0.55)).collect()}
    assert set(got) == {"only_in", "mostly_in", "mostly_out", "only_out"}  # 0.5 to 0.5 says nothing
    assert got["only_in"] == 0.99 and got["only_out"] == 0.01
    assert abs(got["mostly_in"] - 0.9 / (0.9 + 0.25)) < 1e-12 and abs(got["mostly_out"] - 0.1 / (0.1 + 1.0)) < 1e-12


def test_size_limit_counts_what_stays(spark):
    far = [(f"http://far{k}/", 0.0, 0.0, 9, 0, 0, [], []) for k in range(40)]
    near = [(f"http://new{k}/", 0.0, 0.0, 1, 0, 0, [], []) for k in range(6)]
    seen = [(f"http://old{k}/", 0.0, 0.0, 1, 0, 5, [], []) for k in range(10)]
    cfg = crawl.Config(max_distance=2, max_retries=(5, 5, 5), size_limit=14, front_size=0)
    got = {r.url for r in crawl.keep_pages(_pages(spark, far + near + seen), 1, cfg).collect()}
    assert len([u for u in got if "new" in u]) == 5 and len([u for u in got if "old" in u]) == 10 and len(got) == 15


def test_scores_and_overlay(spark):
    model = spark.createDataFrame([("x", 0.9), ("y", 0.2)], "token string, prob double")
    docs = spark.createDataFrame([(1, ["x", "x", "z"]), (2, ["y"]), (3, [])], "doc_id long, t array<string>")
    got = {r.doc_id: round(r.score, 6) for r in classifier.scores(docs, "t", model).collect()}
    assert got == {1: 0.9, 2: 0.2, 3: 0.5}
    mine = spark.createDataFrame([("y", 0.8)], "token string, prob double")
    assert {r.token: r.prob for r in classifier.overlay(model, mine).collect()} == {"x": 0.9, "y": 0.8}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string")
    feed = spark.createDataFrame([(1, "add", "c", 1), (1, "delete", None, 2), (2, "delete", None, 3), (2, "add", "d", 4), (3, "add", "e", 5)], "doc_id long, op string, v string, seq long")
    out = index.upsert(base, feed)
    assert sorted(map(tuple, out.collect())) == [(2, "d"), (3, "e")]
    assert sorted(map(tuple, index.upsert(out, feed).collect())) == [(2, "d"), (3, "e")]


def test_format_check(spark):
    d = spark.createDataFrame([("add", "7"), ("add", "x"), ("add", None), ("delete", None)], "op string, n string")
    assert d.where(index.long_fields_ok(F.col("op"), [F.col("n")])).count() == 2


def test_last_session_counts(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "u", "a", t), (2, "u", "b", t + dt.timedelta(minutes=29)), (3, "u", "c", t + dt.timedelta(minutes=59))]
    q = spark.createDataFrame(rows, "query_id long, ip string, query string, time timestamp")
    assert [tuple(r) for r in loganalysis.query_sequences(q, "ip", "time", "query", ["query_id"]).collect()] == [("a --> b", 1)]


def test_a_url_twice_in_pages_and_cache(spark):
    pages = spark.createDataFrame([("http://a/",), ("http://a/",), ("http://b/",)], "url string")
    cache = spark.createDataFrame([("http://a/", 1), ("http://a/", 2), ("http://c/", 3)], "url string, content int")
    assert sorted(map(tuple, tables.from_cache(pages, cache).collect())) == [("http://a/", 1), ("http://a/", 2)]


def test_rows_of_one_url_share_the_count_of_its_links(spark):
    rows = [("http://a/", 4.0, 1, [("http://x/", "x")]), ("http://a/", 2.0, 3, [("http://y/#t", "y")]), ("http://a/", 1.0, 0, []), ("http://b/", 5.0, 0, [])]
    fetched = spark.createDataFrame(rows, "url string, score double, distance long, links array<struct<url: string, anchor: string>>")
    got = sorted(map(tuple, crawl.children(fetched).collect()))
    assert got == [("http://a/", "http://x/", "x", 2.0, 2), ("http://a/", "http://y/", "y", 1.0, 4), ("http://b/", "http://b/", "", 5.0, 1)]


def test_a_seed_given_twice_is_one_page(spark):
    seeds = crawl.seeds(spark.createDataFrame([("http://a/",), (" http://a/",)], "value string"))
    assert [r.url for r in seeds.collect()] == ["http://a/"]


def test_merge_keeps_every_row_of_the_first_table(spark):
    a = spark.createDataFrame([("http://a/", "1"), ("http://a/", "2")], "url string, origin string")
    b = spark.createDataFrame([("http://a/", "3"), ("http://b/", "4"), ("http://b/", "5")], "url string, origin string")
    assert sorted(map(tuple, crawl.merge_tables(a, b).collect())) == [("http://a/", "1"), ("http://a/", "2"), ("http://b/", "4"), ("http://b/", "5")]


def test_trim_counts_the_links_of_a_url_that_comes_twice(spark):
    rows = [("http://a/", 3.0, 0, [("http://x/", "x")]), ("http://a/", 6.0, 0, [("http://y/", "y"), ("http://x/", "z")])]
    kids = crawl.children(spark.createDataFrame(rows, "url string, score double, distance long, links array<struct<url: string, anchor: string>>"))
    kids = [(k.url, k.score, 0.0, k.distance, 0, 0, [k.anchor], [k.parent]) for k in kids.collect()]
    got = {r.url: r for r in crawl.trim(_pages(spark, kids), spark.createDataFrame([(3,)], "web_size long")).collect()}
    assert got["http://x/"].n_inlinks == 2 and abs(got["http://x/"].score - (0.05 + 0.85 * (3 / 3 + 6 / 3))) < 1e-9
    assert abs(got["http://y/"].score - (0.05 + 0.85 * 2)) < 1e-9 and set(got) == {"http://x/", "http://y/"}
