from pyspark.sql import functions as F

from lodequery.functions import scoring, text, urls
from lodequery.operators import spell
from lodequery.sources import html


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


def test_analyze_drops_stop_words_before_accents(spark):
    got = one(spark, text.analyze(F.col("t")), t="The xsín of Straße 42")
    assert got == ["xsin", "strasse", "42"]


def test_empty_text_has_no_tokens(spark):
    assert one(spark, text.analyze(F.lit(None).cast("string"))) == []


def test_tuples(spark):
    got = one(spark, text.tuples(F.array(*[F.lit(f"t{k}") for k in range(1, 11)]), 3))
    assert len(got) == 10 + 9 + 8
    assert got[10] == "t1_t2" and got[19] == "t1_t2_t3"
    assert one(spark, text.tuples(F.array(F.lit("a")), 3)) == ["a"]


def test_title_default(spark):
    assert one(spark, text.title_or_default(F.lit("  "))) == "Untitled"
    assert one(spark, text.title_or_default(F.lit(None).cast("string"))) == "Untitled"


def matching(spark, rules, candidates):
    p = urls.UrlPatterns.parse(rules)
    rows = spark.createDataFrame([(c,) for c in candidates], "u string")
    return {r.u for r in rows.where(p.match(F.col("u"))).collect()}


def test_url_rule_is_a_whole_address_without_a_pattern(spark):
    pages = ["http://shop.example/", "http://shop.example/cart", "http://news.example/"]
    assert matching(spark, ["http://shop.example/"], pages) == {"http://shop.example/"}
    assert matching(spark, ["http://shop.example/ ||| retail"], pages) == {"http://shop.example/"}
    assert matching(spark, [], pages) == set() and matching(spark, ["", "# http://news.example/"], pages) == set()
    assert matching(spark, ["*"], pages) == set(pages)


def test_url_pattern_covers_the_rest_of_the_address(spark):
    pages = [f"http://shop.example/{x}" for x in ("", "item7", "item", "item7/reviews", "ITEM9")]
    rule = "http://shop.example/ | item[0-9]+"
    assert matching(spark, [rule], pages) == {pages[1], pages[4]}  # all of the rest, in any case
    assert matching(spark, [rule, "http://shop.example/ | .*reviews"], pages) == {pages[1], pages[3], pages[4]}


def test_url_anti_pattern_is_found_anywhere(spark):
    pages = [f"http://wiki.example/{x}" for x in ("talk", "page", "page?draft=1", "draft/page")]
    assert matching(spark, ["http://wiki.example/ | .* || draft"], pages) == set(pages[:2])
    # What one rule rejects another may accept.
    assert matching(spark, ["http://wiki.example/ | .* || draft", "http://wiki.example/ | draft/.* || [?]"], pages) == {pages[0], pages[1], pages[3]}


def test_url_tokens(spark):
    p = urls.UrlPatterns.parse(["http://a.example/ | .* || off ||| red, blue", "http://a.example/ | z.* ||| green"])
    assert one(spark, p.tokens(F.lit("http://a.example/q"))) == ["blue", "red"]
    assert one(spark, p.tokens(F.lit("http://a.example/zoo"))) == ["blue", "green", "red"]
    assert one(spark, p.tokens(F.lit("http://b.example/"))) is None


def test_url_filter_repeated_segments(spark):
    assert one(spark, urls.accepted(F.lit("http://a/b/c/"))) is True
    assert one(spark, urls.accepted(F.lit("http://h/x/y/x/y/x/"))) is False
    assert one(spark, urls.accepted(F.lit("mailto:a@b"))) is False
    assert one(spark, urls.accepted(F.lit("http://a/b.jpeg"))) is False


def test_shards_cover_all(spark):
    got = spark.range(2000).select(urls.shard_of(F.concat(F.lit("http://u/"), "id"), 5).alias("s")).groupBy("s").count().collect()
    assert sorted(r["s"] for r in got) == [0, 1, 2, 3, 4] and min(r["count"] for r in got) > 300


def test_damping_steps():
    assert scoring.damp_steps(0.0) == 10
    assert scoring.damp_steps(0.3) == 6


def test_date_boost(spark):
    now = F.lit(10**12)
    hour = 3_600_000
    assert [one(spark, scoring.date_boost(F.lit(10**12 - h * hour), now)) for h in (0, 1, 5, 13, 30, 100, 500, 5000)] == [100, 60, 40, 30, 20, 10, 5, 1]


def test_unchanged(spark):
    a, b = F.split(F.lit("a b c d e"), " "), F.split(F.lit("a b c d x"), " ")
    assert one(spark, text.unchanged(a, a)) is True
    assert one(spark, text.unchanged(a, b)) is False


def test_weighted_distance():
    assert spell.distance("casa", "caza") == 0.4
    assert spell.distance("vaca", "baca") == 0.4
    assert spell.distance("ab", "ba") == 1.0
    assert spell.distance("", "") == 0.0
    assert spell.distance("", "abc") == 3.0 and spell.distance("abcd", "") == 4.0


def test_html(spark):
    page = '<html><head><title>A &amp; B</title><style>x{}</style></head><body><!-- no --><script>1</script><p>Hi&lt;<a href="/de">go <b>on</b></a></body>'
    assert one(spark, html.title(F.lit(page))) == "A & B"
    assert one(spark, html.body_text(F.lit(page))) == "Hi< go on"
    assert [tuple(r) for r in one(spark, html.links(F.lit(page), F.lit("http://h.x/a/b")))] == [("http://h.x/de", "go  on")]
