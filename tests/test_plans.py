"""How often a query reads its texts, and what it shuffles."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from lodequery.operators import classifier, index

SF = "/root/testdata/sf0.001"
#: Queries whose plan analyses texts once, and shuffles no row a document and term.
ONCE = ["multi_class_overall", "spell_candidates", "confusion", "ngram_index", "bayes_scores", "why_tokens", "spell_dictionary", "group_estimate"]


@pytest.mark.parametrize("name", ONCE)
def test_texts_are_analysed_once(spark, name):
    df = entry_module.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("regexp_extract_all") == 1
    assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "doc_id" in x and ("term" in x or "token" in x)]


def test_texts_of_one_key_are_merged(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "b")], "doc_id long, text string")
    one = index.merged_texts(d, ["doc_id"]).withColumn("tokens", F.filter(F.split("text", r"\s"), lambda x: x != ""))
    got = sorted(map(tuple, index.term_counts(one).collect()))
    posted = index.postings(d.withColumn("tokens", F.split("text", " ")))
    assert got == sorted(map(tuple, index.term_stats(posted).select("term", "df", "total_tf").collect())) == [("a", 1, 1), ("b", 2, 3), ("c", 1, 1)]


def test_a_model_that_is_not_held_gives_the_same_scores(spark):
    docs = spark.createDataFrame([(1, ["x", "y"], 1, 0), (2, ["x"], 1, 1), (3, ["y", "z"], 0, 1), (4, ["z"], 0, 0), (5, [], 0, 0)], "doc_id long, t array<string>, p int, q int")
    model = classifier.token_probabilities(classifier.token_counts(docs, "t", "p", "q"), classifier.totals(docs, "p", "q"))
    got = [sorted(map(tuple, classifier.scores(docs, "t", classifier.held(model, most)).collect())) for most in (10, 0)]
    assert got[0] == got[1] and got[0][4] == (5, 0.5, 0.5)
    for k, y in enumerate("pq"):
        alone = classifier.token_probabilities(classifier.token_counts(docs, "t", y), classifier.totals(docs, y))
        assert sorted((r[0], r[1 + k]) for r in got[0]) == sorted(map(tuple, classifier.scores(docs, "t", alone).collect()))


def test_changes_compare_only_texts_that_may_be_the_same(spark, monkeypatch):
    from lodequery.functions import text
    from lodequery.operators import changes

    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, "s", long), (2, "s", long + " more"), (3, "s", "other words here"), (4, "s", "ab"), (5, "s", "ab"), (6, "s", ""), (7, "s", ""), (1, "t", "x"), (2, None, "ab cd"), (3, None, "ab cd")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = [(2, True), (3, False), (3, True), (4, False), (5, True), (6, False), (7, True)]
    compared = []
    monkeypatch.setattr(text, "unchanged", lambda a, b, k, t, f=text.unchanged: compared.append(1) or f(a, b, k, t))
    for held in (100, 0):
        assert sorted(map(tuple, changes.changes(d, held=held).collect())) == want
    assert compared
    few = [(k, "s", " ".join(f"w{k}x{j}" for j in range(50))) for k in range(50)]
    s = changes.sketches(spark.createDataFrame(few, "doc_id long, source string, text string"), changes.shingle_hashes(F.split("text", " "), 3), ["doc_id"]).collect()
    assert all(sum(r.sketch) == 48 for r in s)
    pairs = spark.createDataFrame([(a.sketch, b.sketch) for a, b in zip(s, s[1:])], "a array<int>, b array<int>")
    assert pairs.where(changes.may_be_same(F.col("a"), F.col("b"), 0.95)).count() == 0


def test_text_change_shuffles_no_tokens(spark):
    df = entry_module.queries()["text_change"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    windows = plan[plan.index("Window"):].split("+- Exchange hashpartitioning(source")[0]
    assert "tokens" not in windows


def test_ranks_of_many_nodes_and_a_plan_that_does_not_double(spark):
    from lodequery.operators import crawl

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "src long, dst long")
    got = [sorted((r.node, round(r.score, 9)) for r in crawl.pagerank(edges, None, 6, held=held).collect()) for held in (10, 0)]
    score = dict.fromkeys((1, 2, 3, 4), 1.0)
    for _ in range(6):
        given = {1: score[3] / 2, 2: score[1] / 2, 3: score[2] + score[1] / 2, 4: score[3] / 2 + score[4]}
        score = {k: 0.15 / 4 + 0.85 * v for k, v in given.items()}
    assert got[0] == got[1] == sorted((k, round(v, 9)) for k, v in score.items())
    size = [len(crawl.pagerank(edges, None, k)._jdf.queryExecution().analyzed().toString()) for k in (2, 4)]
    assert size[1] < 2.5 * size[0]


def test_no_round_of_pagerank_k_sorts_its_edges(spark):
    df = entry_module.queries()["pagerank_k"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "src" in plan and not [x for x in plan.splitlines() if "Sort [src" in x or "hashpartitioning(src" in x]


def test_profiles_are_learned_by_one_job(spark):
    from lodequery.functions import text
    from lodequery.operators import language

    d = spark.createDataFrame([(1, "en", "the cat"), (2, "fr", "le chat")], "doc_id long, lang string, text string")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    seen = d.mapInArrow(count, d.schema)
    words = seen.select("lang", F.explode(text.words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("m"))
    found = language.detect(d, text.words(F.col("text")), *language.profiles(words))
    assert sorted(map(tuple, found.collect())) == [(1, "en"), (2, "fr")] and read.value == 2


def test_labelled_texts_are_not_shuffled(spark):
    from lodequery.plans import catalog_search

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog_search._texts(spark, SF)
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
