import random

import pytest
from pyspark.sql import functions as F

from lodequery.functions import text
from lodequery.operators import search, snippets
from lodequery.plans import ast, parser, serve


def index(spark, rows, **how):
    d = spark.createDataFrame(rows, "doc_id long, text string, site string, boost double, day long").withColumn("tokens", text.analyze(F.col("text")))
    return search.Index(d, {"text": "tokens"}, {"site": "site"}, {"day": "day"}, boost="boost", **how)


ROWS = [(1, "content xsín one", "g1", 1.0, 5), (2, "content two", "g1", 1.0, None), (3, "content three", "g2", 10.0, 9), (4, "other words", "g2", 1.0, 1), (5, "content five", "g3", 1.0, 2)]


def test_accents_find_both_ways(spark):
    ix = index(spark, ROWS)
    assert [r.doc_id for r in search.search(ix, "xsín").collect()] == [r.doc_id for r in search.search(ix, "xsin").collect()] == [1]


def test_boost_comes_first(spark):
    hits = search.search(index(spark, ROWS), "content")
    assert search.top_hits(hits, [("score", "double", True)], "doc_id", 1).first().doc_id == 3


def test_groups(spark):
    from pyspark.sql import Window

    hits = search.search(index(spark, ROWS), ast.MatchAll()).withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))
    got = search.group_hits(hits, F.col("site"), 10, 2)
    assert sorted((r.group_key, r["count"]) for r in got.groupBy("group_key").count().collect()) == [("g1", 2), ("g2", 2), ("g3", 1)]
    two = search.group_hits(hits, F.col("site"), 2, 5)
    assert sorted(r.doc_id for r in two.collect()) == [1, 2, 3]  # the scan ends when the second group opens


def test_payload_changes_the_order(spark):
    ix = index(spark, ROWS, scorers={"day": lambda c: F.lit(1.0) + c})
    hits = search.search(ix, ast.And((ast.Term("text", "content"), ast.Payload("day")))).orderBy(F.desc("score"))
    assert [r.doc_id for r in hits.collect()][0] == 3
    assert 2 not in [r.doc_id for r in hits.collect()]


def test_filters(spark):
    ix = index(spark, ROWS)
    f = parser.filters_of_vectors([["site", "g1", "g2"]])
    assert sorted(r.doc_id for r in search.search(ix, "content", f).collect()) == [1, 2, 3]


def test_equality():
    a, b = ast.Term("f", "x"), ast.Term("f", "y")
    assert ast.And((a, b)) == ast.And((b, a)) and ast.Or((a, b)) == ast.Or((b, a))
    assert ast.Difference(a, b) != ast.Difference(b, a) and ast.And((a, b)) != ast.Or((a, b))
    assert ast.And((ast.And((a, b)), a)).parts == (a, b, a)
    with pytest.raises(ValueError):
        ast.Term("f", "x", 0.0)


def test_parser():
    p = parser.Parser()
    assert p.parse("one two") == ast.And((ast.Term("text", "one"), ast.Term("text", "two")))
    assert p.parse("one OR two") == ast.Or((ast.Term("text", "one"), ast.Term("text", "two")))
    assert p.parse("one -two") == ast.Difference(ast.Term("text", "one"), ast.Term("text", "two"))
    assert p.parse('"one two"') == ast.Phrase("text", ("one", "two"))
    assert p.parse("title:one^2") == ast.Term("title", "one", 2.0)
    for bad in ("(one", "one)", '"one', "", "-one"):
        with pytest.raises(ValueError):
            p.parse(bad)
    both = parser.Parser(("a", "b"), (1.0, 0.5)).parse("x")
    assert both == ast.Or((ast.Term("a", "x"), ast.Term("b", "x", 0.5)))
    with pytest.raises(ValueError):
        parser.Parser(("a", "b"), (1.0,))
    syn = parser.Parser(synonyms=(("car", ("auto",)),), synonym_fields=("text",)).parse("car")
    assert syn == ast.Or((ast.Term("text", "car"), ast.Term("text", "auto")))


def test_query_syntax(spark):
    p = parser.Parser(keyword_fields=("site",))
    assert p.parse("day:[20200101 TO 20200131]") == ast.Range("day", "20200101", "20200131")
    assert p.parse("day:{5 TO *}") == ast.Range("day", "5", parser.LAST, False, True)
    assert p.parse("lamp [b TO c}") == ast.And((ast.Term("text", "lamp"), ast.Range("text", "b", "c", True, False)))
    assert p.parse("title:(red car)") == ast.And((ast.Term("title", "red"), ast.Term("title", "car")))
    assert p.parse("title:(red OR blue) car") == ast.And((ast.Or((ast.Term("title", "red"), ast.Term("title", "blue"))), ast.Term("text", "car")))
    assert p.parse("Fóo*") == ast.Prefix("text", "foo") and p.parse("site:G*^2") == ast.Prefix("site", "G", 2.0)
    for bad in ("fo?", "f*o", "foo~", '"a b"~2', "title:", "*", "day:[1 TO", "a]"):
        with pytest.raises(ValueError):
            p.parse(bad)
    ix = index(spark, ROWS)
    assert sorted(r.doc_id for r in search.search(ix, "t*").collect()) == [2, 3]
    assert sorted(r.doc_id for r in search.search(ix, "[one TO two]").collect()) == [1, 2, 3, 4]  # terms of the text
    assert sorted(r.doc_id for r in search.search(ix, "site:[g2 TO *]").collect()) == [3, 4, 5]


def test_language_profiles_held_and_joined(spark):
    from lodequery.operators import language

    rows = [(1, "the house of the thin man", "en"), (2, "das haus und der mann", "de"), (3, "that other thing", "en"), (4, "und das ist der", "de"), (5, "", "en"), (6, None, "de"), (7, "!!!", None), (8, "qqq zzz", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = d.where("lang is not null").select("lang", F.explode(text.words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("m"))
    known, low = language.profiles(words)
    held = sorted(map(tuple, language.detect(d, text.words(F.col("text")), known, low).collect()))
    assert held == [(1, "en"), (2, "de"), (3, "en"), (4, "de"), (8, "de")]
    assert held == sorted(map(tuple, language.detect(d, text.words(F.col("text")), known, low, held=0).collect()))
    assert language.detect(d.limit(0), text.words(F.col("text")), known, low).count() == 0


def test_phrase_adder():
    assert parser.add_phrase("a b") == '(a b) OR "a b"' and parser.add_phrase('"a"') == '"a"'


def test_phrase_matcher():
    m = parser.PhraseMatcher(["green tea", "tea", "hot water bottle"])
    assert m.recognize("buy GREEN Tea and a hot water bottle") == 'buy "GREEN Tea" and a "hot water bottle"'
    assert m.recognize("hot water, green tea") == 'hot water, "green tea"'  # words are compared whole
    assert m.recognize('say "green tea" over tea') == 'say "green tea" over "tea"'  # quoted text stays as it is
    assert m.recognize("hot water hot water") == "hot water hot water"
    rng = random.Random(2)
    words = [f"w{k}" for k in range(6)]
    m = parser.PhraseMatcher([" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(5)])
    for _ in range(300):
        q = " ".join(rng.choices(words, k=rng.randint(0, 8)))
        out = m.recognize(q)
        assert out.replace('"', "") == q
        assert all(tuple(p.split()) in m.phrases for p in out.split('"')[1::2])


def test_params():
    import datetime as dt

    assert parser.order_of("a:int:reverse,b") == [("a", "int", True), ("b", "string", False), ("score", "double", True)]
    assert parser.range_of("day:20200101-20200131") == ast.Range("day", "20200101", "20200131")
    assert parser.past_of("day:3:yyyyMMdd", dt.datetime(2020, 1, 4)) == ast.Range("day", "20200101", "20200104")


def test_snippets():
    doc = "rain fell on the town. we read by the lamp until dawn. birds sang"
    t = {"lamp"}
    whole = doc.replace("lamp", "<B>lamp</B>")
    assert snippets.snippet(doc, t, 200, set()) == whole
    short = snippets.snippet(doc, t, 30, set())
    assert short in whole and "<B>lamp</B>" in short and len(short) - len("<B></B>") <= 40
    assert snippets.snippet("nothing here", t, 7, set()) == "nothing" and snippets.snippet("nothing", t, 7, set(), True) == ""


def test_estimate():
    assert search.estimate_groups(100, 10, 5) == 50 and search.estimate_groups(100, 3, 5) == 0 and search.estimate_groups(7, 0, 0) == 0


def test_session(spark):
    s = serve.Session(index(spark, ROWS))
    r = s.search({"query": "content", "groupBy": "site", "group_size": 2})
    assert r.total == 4 and r.groups == 3
    assert s.search({"query": "content", "groupBy": "site", "group_size": 2}) is r
    assert s.log == ["content"] and s.statistics()["n"] == 1
    with pytest.raises(ValueError):
        s.search({"query": "content", "start": 1000})
