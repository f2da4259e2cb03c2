"""Queries on text, search, classification, spelling and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import changes, classifier, index, language, search, snippets, spell
from . import ast
from .parser import Parser, past_of
from .registry import POST_SQL, TOK_SQL, query, table


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return text.with_tokens(table(spark, sf, "documents"), "tokens", text.analyze(F.col("text")))


def merged(docs: DataFrame, *keys: str) -> DataFrame:
    """Documents with their tokens, one row for equal keys."""
    return text.with_tokens(index.merged_texts(docs, list(keys)), "tokens", text.analyze(F.col("text"))).drop("text")


def indexed(spark: SparkSession, sf: str, **how) -> search.Index:
    d = docs(spark, sf).withColumn("source_tokens", text.keyword(F.col("source")))
    return search.Index(d, {"text": "tokens", "source": "source_tokens"}, {"source": "source", "lang": "lang"}, {"n_chars": "n_chars"}, **how)


def _found(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {TOK_SQL} SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM tok")
def tokens_analyze(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(f"SELECT doc_id, md5(translate(lower(text), '{text.ACCENTS[0]}', '{text.ACCENTS[1]}')) AS folded_md5 FROM documents")
def accent_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded_md5"))


@query(
    f"""WITH {TOK_SQL}, x AS (SELECT doc_id, list_concat(t, list_concat(
  [t[i] || '_' || t[i + 1] for i in range(1, len(t))], [t[i] || '_' || t[i + 1] || '_' || t[i + 2] for i in range(1, len(t) - 1)])) AS g FROM tok)
SELECT doc_id, len(g)::BIGINT AS n_tuples, md5(array_to_string(g, ' ')) AS tuples_md5 FROM x"""
)
def tuple_tokens(spark, sf):
    d = docs(spark, sf).select("doc_id", text.tuples(F.col("tokens"), 3).alias("g"))
    return d.select("doc_id", F.size("g").cast("long").alias("n_tuples"), F.md5(F.array_join("g", " ")).alias("tuples_md5"))


_STATS = "st AS (SELECT count(*) AS n FROM documents)"


def _df(term: str, name: str) -> str:
    return f"{name} AS (SELECT 1 + ln((SELECT n FROM st) / (count(*) FILTER (list_contains(t, '{term}')) + 1)) AS w FROM tok)"


def _part(term: str, name: str, col: str = "t") -> str:
    return f"sqrt(len(list_filter({col}, lambda x: x = '{term}'))) * {name}.w * {name}.w / sqrt(greatest(len({col}), 1))"


_TWO = f"WITH {TOK_SQL}, {_STATS}, {_df('from', 'a')}, {_df('tion', 'b')}, s AS (SELECT doc_id, source, lang, n_chars, list_contains(t, 'from') AS ha, list_contains(t, 'tion') AS hb, {_part('from', 'a')} AS sa, {_part('tion', 'b')} AS sb, sqrt(a.w * a.w + b.w * b.w) AS norm FROM tok, a, b)"


@query(f"WITH {TOK_SQL}, {_STATS}, {_df('from', 'a')} SELECT doc_id, round({_part('from', 'a')} / a.w, 6) AS score FROM tok, a WHERE list_contains(t, 'from')")
def term_query(spark, sf):
    return _found(search.search(indexed(spark, sf), ast.Term("text", "from")))


@query(_TWO + " SELECT doc_id, round((sa + sb) / norm, 6) AS score FROM s WHERE ha AND hb")
def and_query(spark, sf):
    return _found(search.search(indexed(spark, sf), "from tion"))


@query(_TWO + " SELECT doc_id, round((sa + sb) * (ha::INT + hb::INT) / 2 / norm, 6) AS score FROM s WHERE ha OR hb")
def or_query(spark, sf):
    return _found(search.search(indexed(spark, sf), "from OR tion"))


@query(f"WITH {TOK_SQL}, {_STATS}, {_df('from', 'a')} SELECT doc_id, round({_part('from', 'a')} / a.w, 6) AS score FROM tok, a WHERE list_contains(t, 'from') AND NOT list_contains(t, 'tion')")
def difference_query(spark, sf):
    return _found(search.search(indexed(spark, sf), "from -tion"))


@query(
    f"""WITH {TOK_SQL}, {_STATS}, {_df('apache', 'a')}, {_df('license', 'b')},
p AS (SELECT doc_id, t, len([i for i in range(1, len(t)) if t[i] = 'apache' AND t[i + 1] = 'license']) AS tf FROM tok)
SELECT doc_id, round(sqrt(tf) * (a.w + b.w) / sqrt(len(t)), 6) AS score FROM p, a, b WHERE tf > 0"""
)
def phrase_query(spark, sf):
    return _found(search.search(indexed(spark, sf), '"apache license"'))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE source >= 'src1' AND source < 'src3'")
def range_query(spark, sf):
    return _found(search.search(indexed(spark, sf), ast.Range("source", "src1", "src3", True, False)))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 20 OFFSET 20")
def match_all_page(spark, sf):
    return _found(search.page(search.search(indexed(spark, sf), ast.MatchAll()), [("score", "double", True)], offset=20, count=50))


@query(
    f"""WITH {TOK_SQL}, {_STATS}, {_df('ble', 'a')}, b AS (SELECT 1 + ln((SELECT n FROM st) / (count(*) FILTER (source = 'ble') + 1)) AS w FROM documents)
SELECT doc_id, round({_part('ble', 'a')} * 2 / 2 / sqrt(4 * a.w * a.w + 0.25 * b.w * b.w), 6) AS score FROM tok, a, b WHERE list_contains(t, 'ble')"""
)
def multi_field_boosted(spark, sf):
    ix = indexed(spark, sf, parser=Parser(("text", "source"), (2.0, 0.5)))
    return _found(search.search(ix, "ble"))


_SYNONYMS = [("from", "source"), ("from", "since"), ("ing", "ed"), ("than", "then")]


@query(f"WITH {POST_SQL}, syn(word, synonym) AS (VALUES {', '.join(map(str, _SYNONYMS))}) SELECT term, term AS expanded FROM (SELECT DISTINCT term FROM post) UNION ALL SELECT p.term, synonym FROM (SELECT DISTINCT term FROM post) p JOIN syn ON word = term")
def synonym_expand(spark, sf):
    terms = index.postings(docs(spark, sf)).select("term").distinct()
    return search.expand_synonyms(terms, spark.createDataFrame(_SYNONYMS, "word string, synonym string"), "term").select("term", "expanded")


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def value_filter(spark, sf):
    return search.search(indexed(spark, sf), ast.MatchAll(), ast.ValueFilter("lang", "fr")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source BETWEEN 'src1' AND 'src2'")
def range_filter(spark, sf):
    return search.search(indexed(spark, sf), ast.MatchAll(), ast.RangeFilter("source", "src1", "src2")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang = 'fr' OR lang = 'de') AND source BETWEEN 'src1' AND 'src5'")
def bool_filter(spark, sf):
    f = ast.BoolFilter(False, frozenset([ast.BoolFilter(True, frozenset([ast.ValueFilter("lang", "fr"), ast.ValueFilter("lang", "de")])), ast.RangeFilter("source", "src1", "src5")]))
    return search.search(indexed(spark, sf), ast.MatchAll(), f).select("doc_id")


@query(_TWO + " SELECT doc_id, round((sa + sb) / norm, 6) AS score FROM s WHERE ha AND hb ORDER BY score DESC, doc_id LIMIT 10")
def tfidf_topk(spark, sf):
    return search.top_hits(_found(search.search(indexed(spark, sf), "from tion")), [("score", "double", True)], "doc_id", 10)


@query(_TWO + " SELECT doc_id, round((sa + sb) / norm * (1 + 2.0 * least(n_chars, 5000) / 5000), 6) AS score FROM s WHERE ha AND hb")
def payload_query(spark, sf):
    ix = indexed(spark, sf, scorers={"n_chars": lambda c: scoring.scalar_boost(c, 2.0, 5000)})
    both = ast.And((ast.Term("text", "from"), ast.Term("text", "tion"), ast.Payload("n_chars")))
    return _found(search.search(ix, both))


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY lang, n_chars DESC, doc_id LIMIT 20")
def sort_multi(spark, sf):
    d = table(spark, sf, "documents")
    return search.page(d, [("lang", "string", False), ("n_chars", "long", True)]).select("doc_id", "lang", "n_chars")


_RANKED = _TWO + ", r AS (SELECT doc_id, source, row_number() OVER (ORDER BY round((sa + sb) / norm, 6) DESC, doc_id) AS rank FROM s WHERE ha AND hb), top AS (SELECT * FROM r WHERE rank <= 300), o AS (SELECT source, min(rank) AS open FROM top GROUP BY source), g AS (SELECT *, row_number() OVER (ORDER BY open) AS group_rank FROM o), l AS (SELECT coalesce(max(open) FILTER (group_rank = 10), 1000000) AS last FROM g)"


def _ranked(spark, sf, hits=None):
    from pyspark.sql import Window

    hits = search.search(indexed(spark, sf), "from tion") if hits is None else hits
    hits = hits.select("doc_id", "source", F.round("score", 6).alias("score"))
    # As a page of ten groups of three rows looks ahead.
    top = search.top_hits(hits, [("score", "double", True)], "doc_id", 3 * 10 * search.LOOKUP)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query(_RANKED + " SELECT doc_id, group_key, group_rank, rank_in_group FROM (SELECT doc_id, top.source AS group_key, group_rank::INTEGER AS group_rank, row_number() OVER (PARTITION BY top.source ORDER BY rank)::INTEGER AS rank_in_group FROM top JOIN g ON g.source = top.source, l WHERE group_rank <= 10 AND rank <= last) WHERE rank_in_group <= 3")
def group_by_field_topn(spark, sf):
    return search.group_hits(_ranked(spark, sf), F.col("source"), 10, 3).select("doc_id", "group_key", "group_rank", "rank_in_group")


@query(_RANKED + ", x AS (SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM g WHERE group_rank <= 10)::BIGINT AS opened, (SELECT least(last, (SELECT max(rank) FROM top)) FROM l)::BIGINT AS consumed) SELECT total, opened, consumed, CASE WHEN consumed // opened > 0 THEN total // (consumed // opened) ELSE 0 END::BIGINT AS estimate FROM x")
def group_estimate(spark, sf):
    from pyspark.sql import Window

    hits, total = search.search_and_count(indexed(spark, sf), "from tion")
    ranked = _ranked(spark, sf, hits).withColumn("most", F.max("rank").over(Window.partitionBy()))
    grouped = search.group_hits(ranked, F.col("source"), 10, 3 * 10 * search.LOOKUP)
    o = grouped.agg(F.countDistinct("group_key").alias("opened"), F.max("rank").cast("long").alias("last"), F.max("most").alias("most")).withColumn("total", F.lit(total).cast("long"))
    o = o.select("total", "opened", F.when(F.col("opened") < 10, F.col("most")).otherwise(F.col("last")).cast("long").alias("consumed"))
    step = F.floor(F.col("consumed") / F.col("opened"))
    return o.select("total", "opened", "consumed", F.when(step > 0, F.floor(F.col("total") / step)).otherwise(0).cast("long").alias("estimate"))


@query(_TWO + " SELECT doc_id, round((sa + sb) / norm, 6) AS score FROM s WHERE ha AND hb ORDER BY score DESC, doc_id LIMIT 15")
def shard_merge_topk(spark, sf):
    hits = _found(search.search(indexed(spark, sf), "from tion"))
    hits = index.route(hits, 4, F.col("doc_id").cast("string"))
    return search.merge_shards([hits.where(F.col("shard") == k).drop("shard") for k in range(4)], [("score", "double", True)], "doc_id", 15)


@query("SELECT doc_id FROM documents WHERE lang BETWEEN 'de' AND 'en'")
def query_range_string(spark, sf):
    return search.search(indexed(spark, sf), ast.Range("lang", "de", "en")).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19960105' AND '19960404'")
def past_range(spark, sf):
    import datetime as dt

    q = past_of("day:90:yyyyMMdd", dt.datetime(1996, 4, 4))
    d = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyyMMdd"))
    return d.where(F.col("day").between(q.start, q.end)).select("o_orderkey")


# Rewrites and spelling

_STAT_SQL = POST_SQL + ", stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM post GROUP BY term)"
_DICT_SQL = _STAT_SQL + ", dict AS (SELECT term, df, df - (SELECT quantile_cont(df, 0.9) FROM stats) + 1 AS boost FROM stats WHERE df >= (SELECT quantile_cont(df, 0.9) FROM stats))"


def _stats(spark, sf):
    return index.term_counts(merged(table(spark, sf, "documents"), "doc_id"))


@query(f"WITH {_STAT_SQL} SELECT * FROM stats")
def term_stats(spark, sf):
    return _stats(spark, sf)


@query(f"WITH {POST_SQL} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf) AS most FROM post GROUP BY doc_id")
def postings_summary(spark, sf):
    return index.postings(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("most"))


@query(f"WITH {_DICT_SQL} SELECT * FROM dict")
def spell_dictionary(spark, sf):
    return spell.dictionary(_stats(spark, sf))


_GRAM_SQL = """sized AS (SELECT term, unnest(CASE WHEN length(term) > 5 THEN [3, 4] WHEN length(term) = 5 THEN [2, 3] ELSE [1, 2] END) AS size FROM {src} WHERE length(term) >= 3),
cut AS (SELECT term, size, unnest(range(1, length(term) - size + 2)) AS i FROM sized),
{name} AS (SELECT DISTINCT term, kind || size AS kind, substr(term, i::INT, size) AS gram FROM cut, (VALUES ('gram'), ('start'), ('end')) k(kind)
  WHERE kind = 'gram' OR kind = 'start' AND i = 1 OR kind = 'end' AND i = length(term) - size + 1)"""


@query(f"WITH {_DICT_SQL}, {_GRAM_SQL.format(src='dict', name='gram')} SELECT * FROM gram")
def ngram_index(spark, sf):
    return spell.grams(spell.dictionary(_stats(spark, sf))).select("term", "kind", "gram")


_ASKED = ["thredd", "tionn", "inng", "fron", "bleh", "erhaed"]
_ASKED_SQL = _GRAM_SQL.format(src="asked0", name="agram").replace("sized", "asized").replace("cut", "acut")


@query(
    f"""WITH {_DICT_SQL}, {_GRAM_SQL.format(src='dict', name='gram')}, asked0(term) AS (VALUES {', '.join(f"('{a}')" for a in _ASKED)}), {_ASKED_SQL},
hit AS (SELECT a.term AS asked, g.term, sum(CASE WHEN g.kind LIKE 'start%' THEN 2.0 ELSE 1.0 END) AS weight FROM agram a JOIN gram g USING (kind, gram) WHERE a.term <> g.term GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY weight DESC, term) AS turn FROM hit),
s AS (SELECT asked, term, round(1 - levenshtein(asked, term)::DOUBLE / least(length(asked), length(term)), 6) AS score, df FROM c JOIN stats USING (term) WHERE turn <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, df DESC, term) AS turn FROM s WHERE score >= 0.5)
SELECT asked, term, score, df FROM r WHERE turn <= 5"""
)
def spell_candidates(spark, sf):
    words = spell.dictionary(_stats(spark, sf))
    asked = spark.createDataFrame([(a,) for a in _ASKED], "asked string")
    return spell.suggestions(asked, spell.grams(words), words, 5).withColumn("score", F.round("score", 6))


@query()
def weighted_distance(spark, sf):
    """Words of part names against each other where they share the first letter (FN16)."""
    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct()
    pairs = w.join(w.select(F.col("a").alias("b")), (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") < F.col("b")))
    return pairs.select("a", "b", spell.weighted_distance("a", "b").alias("distance"))


@query("SELECT query, rewrite FROM (VALUES ('from ble', 'form ble'), ('from ble', 'from able'), ('than from', 'then from'), ('than from', 'than form')) v(query, rewrite)")
def suggest_rewrite(spark, sf):
    asked = spark.createDataFrame([("from ble",), ("than from",)], "query string")
    more = spark.createDataFrame([("from", "form"), ("ble", "able"), ("than", "then")], "token string, suggestion string")
    return search.suggest_rewrites(asked, more)


@query()
def snippet_page(spark, sf):
    hits = search.top_hits(search.search(indexed(spark, sf), "from tion").select("doc_id", "text", "score"), [("score", "double", True)], "doc_id", 20)
    from pyspark.sql import Window

    page = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    return snippets.with_snippets(page, ["from", "tion"]).select("doc_id", "rank", "snippet_text")


@query()
def signature_groups(spark, sf):
    return snippets.group_by_signature(_ranked(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")).select("doc_id", "rank", "group_no")


@query(
    f"""WITH {TOK_SQL}, x AS (SELECT doc_id, source, t, lag(t) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM tok),
y AS (SELECT doc_id, t, p, CASE WHEN len(t) >= 3 THEN list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS a,
  CASE WHEN len(p) >= 3 THEN list_distinct([p[i] || ' ' || p[i + 1] || ' ' || p[i + 2] for i in range(1, len(p) - 1)]) WHEN len(p) > 0 THEN [array_to_string(p, ' ')] ELSE [] END AS b FROM x WHERE p IS NOT NULL)
SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN t = p ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.95 END AS same FROM y"""
)
def text_change(spark, sf):
    """Each document against the one before it of its source: is the text the same but for little?"""
    return changes.changes(table(spark, sf, "documents"))


@query(
    """WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
g AS (SELECT doc_id, lang, unnest([substr(' ' || w || ' ', i::INT, 3) for i in range(1, length(w) + 1)]) AS g FROM w),
prof AS (SELECT lang, g, ln((count(*) + 1.0) / (sum(count(*)) OVER (PARTITION BY lang) + 1000.0)) AS lp FROM g GROUP BY lang, g),
lo AS (SELECT lang, ln(1.0 / (count(*) + 1000.0)) AS lp0 FROM g GROUP BY lang),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, lo.lang, round(sum(n * coalesce(prof.lp, lp0)), 4) AS s FROM c CROSS JOIN lo LEFT JOIN prof ON prof.g = c.g AND prof.lang = lo.lang GROUP BY ALL)
SELECT doc_id, lang AS detected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS k FROM s) WHERE k = 1"""
)
def lang_detect(spark, sf):
    """FN17: each language's profile from all its documents, then every document's likeliest language."""
    d = table(spark, sf, "documents")
    words = d.select("lang", F.explode(text.words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("m"))
    return language.detect(d, text.words(F.col("text")), *language.profiles(words))


# Classifier

_LAB_SQL = TOK_SQL + ", lab AS (SELECT doc_id, t, quality, toxic FROM tok JOIN labels USING (doc_id))"
_PROB = """tot_{y} AS (SELECT count(*) FILTER ({y} = 1) AS n_in, count(*) FILTER ({y} <> 1) AS n_out FROM lab),
cnt_{y} AS (SELECT token, count(*) FILTER ({y} = 1) AS doc_in, count(*) FILTER ({y} <> 1) AS doc_out, coalesce(sum(tf) FILTER ({y} = 1), 0)::BIGINT AS tf_in, coalesce(sum(tf) FILTER ({y} <> 1), 0)::BIGINT AS tf_out
  FROM (SELECT doc_id, {y}, token, count(*) AS tf FROM (SELECT doc_id, {y}, unnest(t) AS token FROM lab) GROUP BY ALL) GROUP BY token),
prob_{y} AS (SELECT token, p AS prob FROM (SELECT token, CASE WHEN doc_in = 0 AND doc_out > 1 THEN 0.01 WHEN doc_out = 0 AND doc_in > 1 THEN 0.99
  WHEN doc_in > 0 AND doc_out > 0 AND doc_in + doc_out > 1 THEN (doc_in::DOUBLE / n_in) / (doc_in::DOUBLE / n_in + doc_out::DOUBLE / n_out) END AS p FROM cnt_{y}, tot_{y}) WHERE p > 0 AND NOT p BETWEEN 0.4 AND 0.6),
score_{y} AS (SELECT doc_id, round(1 / (1 + exp(-sum(ln(coalesce(prob, 0.5) / (1 - coalesce(prob, 0.5)))))), 6) AS score FROM (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE list_distinct(t) END) AS token FROM tok) x LEFT JOIN prob_{y} USING (token) GROUP BY doc_id)"""


#: Labels up to which they are broadcast, so that no text is shuffled to be labelled.
LABELS = 2_000_000


def _labels(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return F.broadcast(lab) if lab.count() <= LABELS else lab


def _texts(spark, sf):
    """Labelled texts; only they are analysed."""
    return table(spark, sf, "documents").select("doc_id", "text").join(_labels(spark, sf), "doc_id")


def _labelled(spark, sf, *labels):
    return merged(_texts(spark, sf), "doc_id", *labels)


def _model(spark, sf, *labels):
    counts = classifier.token_counts(_labelled(spark, sf, *labels), "tokens", *labels)
    return classifier.token_probabilities(counts, classifier.totals(_texts(spark, sf), *labels))


@query(f"WITH {_LAB_SQL}, {_PROB.format(y='toxic')} SELECT token, doc_in, doc_out, tf_in, tf_out FROM cnt_toxic")
def token_counts(spark, sf):
    return classifier.token_counts(_labelled(spark, sf, "toxic"), "tokens", "toxic")


@query(f"WITH {_LAB_SQL}, {_PROB.format(y='toxic')} SELECT token, round(prob, 6) AS prob FROM prob_toxic")
def token_probs(spark, sf):
    return _model(spark, sf, "toxic").withColumn("prob", F.round("prob", 6))


def _scores(spark, sf, model, texts=None):
    texts = docs(spark, sf) if texts is None else texts
    s = classifier.scores(texts, "tokens", classifier.held(model))
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in s.columns if c != "doc_id"])


@query(f"WITH {_LAB_SQL}, {_PROB.format(y='toxic')} SELECT doc_id, score FROM score_toxic")
def bayes_scores(spark, sf):
    return _scores(spark, sf, _model(spark, sf, "toxic"))


@query(f"WITH {_LAB_SQL}, {_PROB.format(y='toxic')}, {_PROB.format(y='quality')} SELECT doc_id, greatest(a.score, b.score) AS overall FROM score_toxic a JOIN score_quality b USING (doc_id)")
def multi_class_overall(spark, sf):
    if _texts(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        s = _scores(spark, sf, _model(spark, sf, "toxic", "quality"))
        return s.select("doc_id", F.greatest("score", "score1").alias("overall"))
    # A document with several rows is merged by each label, so the labels are learned apart.
    both = [_scores(spark, sf, _model(spark, sf, y)) for y in ("toxic", "quality")]
    return classifier.overall(both[0].unionByName(both[1]))


@query(f"WITH {_LAB_SQL}, {_PROB.format(y='toxic')} SELECT CASE WHEN toxic = 1 THEN 'uinc' ELSE 'unot' END || '_' || CASE WHEN score >= 0.5 THEN 'cinc' ELSE 'cnot' END AS bucket, count(*) AS n FROM lab JOIN score_toxic USING (doc_id) GROUP BY bucket")
def confusion(spark, sf):
    lab = table(spark, sf, "documents").select("doc_id", "text").join(_labels(spark, sf), "doc_id", "left_semi")
    s = _scores(spark, sf, _model(spark, sf, "toxic"), text.with_tokens(lab, "tokens", text.analyze(F.col("text"))))
    return classifier.confusion(s.join(_labels(spark, sf), "doc_id"), "toxic")


@query(f"WITH {_LAB_SQL}, {_PROB.format(y='toxic')} SELECT doc_id, token, round(coalesce(prob, 0.5), 6) AS prob FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM lab) LEFT JOIN prob_toxic USING (token)")
def why_tokens(spark, sf):
    return classifier.why(merged(_texts(spark, sf), "doc_id"), "tokens", classifier.held(_model(spark, sf, "toxic"))).withColumn("prob", F.round("prob", 6))


@query(f"WITH {POST_SQL} SELECT term AS token, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM post GROUP BY term")
def who_has(spark, sf):
    return classifier.who_has(docs(spark, sf), "tokens").groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"WITH {_LAB_SQL}, {_PROB.format(y='toxic')} SELECT token, round(CASE token WHEN 'idiot' THEN 0.7 WHEN 'from' THEN 0.2 ELSE prob END, 6) AS prob FROM (SELECT token, prob FROM prob_toxic UNION SELECT * FROM (VALUES ('idiot', NULL), ('from', NULL)) v WHERE col0 NOT IN (SELECT token FROM prob_toxic))")
def model_overlay(spark, sf):
    mine = spark.createDataFrame([("idiot", 0.7), ("from", 0.2)], "token string, prob double")
    return classifier.overlay(_model(spark, sf, "toxic"), mine).withColumn("prob", F.round("prob", 6))


# Index maintenance

_FEED = "SELECT o_custkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'add' END AS op, o_totalprice AS price, o_orderkey AS seq FROM orders"


@query(f"WITH feed AS ({_FEED}), last AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS k FROM feed) SELECT c_custkey AS doc_id, c_acctbal AS price FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM feed) UNION ALL SELECT doc_id, price FROM last WHERE k = 1 AND op = 'add'")
def upsert_last_op(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("price"))
    feed = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("add").alias("op"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    return index.upsert(base, feed)


@query("SELECT event_id FROM events WHERE event_type <> 'view' OR try_cast(regexp_extract(props, '\"k\": ([^}]*)', 1) AS BIGINT) IS NOT NULL")
def field_format_check(spark, sf):
    op = F.when(F.col("event_type") == "view", "add").otherwise("delete")
    return table(spark, sf, "events").where(index.long_fields_ok(op, [F.regexp_extract("props", '"k": ([^}]*)', 1)])).select("event_id")


@query("SELECT page_id, contains(html, '<title>') AND contains(html, '<article>') AS complete FROM pages")
def required_fields(spark, sf):
    names = F.filter(F.transform(F.array(F.lit("title"), F.lit("article")), lambda n: F.when(F.contains("html", F.concat(F.lit("<"), n, F.lit(">"))), n)), lambda n: n.isNotNull())
    return table(spark, sf, "pages").select("page_id", index.has_required(names, ["title", "article"]).alias("complete"))


@query("SELECT source AS cluster, max(doc_id) AS version FROM documents GROUP BY source")
def compose_latest(spark, sf):
    return index.compose_latest(table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.col("doc_id").alias("version")))


@query(
    """WITH h AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, p IS NULL OR p <> event_type AS changed FROM h)
SELECT event_id, changed, epoch_us(last_value(CASE WHEN changed THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS content_us FROM c"""
)
def cache_history(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id"))
    h = index.changed_versions(e, "user_id", "at", "event_type")
    return h.select("event_id", "changed", F.col("content_ts.us").alias("content_us"))


@query("SELECT doc_id FROM documents WHERE NOT list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'tion')")
def delete_by_term(spark, sf):
    return index.delete_by_term(docs(spark, sf), "tokens", "tion").select("doc_id")
