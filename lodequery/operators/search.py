"""Search over a table of analysed documents (QRY*, FLT*, SCR1, SRT*, GRP*, SRV*).

A query becomes two Columns over token arrays: does a row match, and its score. One aggregate gives the document
frequencies of all the query's terms; the search itself is a scan and a top-k. No posting leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ast
from ..plans.parser import Parser

MAX_OFFSET, HITS_PER_PAGE, LOOKUP = 200, 20, 10


@dataclass
class Index:
    """Documents with a token array a searchable field. ``values``: field to string column; ``payloads``: name to long column."""

    docs: DataFrame
    tokens: dict[str, str]
    values: dict[str, str] = field(default_factory=dict)
    payloads: dict[str, str] = field(default_factory=dict)
    scorers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    key: str = "doc_id"
    boost: str | None = None
    field_boost: dict[str, float] = field(default_factory=dict)
    parser: Parser = Parser()


def phrase_at(tokens: Column, terms: tuple[str, ...]) -> Column:
    """How often the terms follow each other in an array."""
    n = len(terms)
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    want = F.array(*[F.lit(t) for t in terms])
    return F.when(F.size(tokens) >= n, F.size(F.filter(starts, lambda i: (F.element_at(tokens, i) == terms[0]) & (F.slice(tokens, i, n) == want)))).otherwise(0)


def _leaves(q: ast.Query) -> list[tuple[str, str]]:
    if isinstance(q, ast.Term):
        return [(q.field, q.term)]
    if isinstance(q, ast.Phrase):
        return [(q.field, t) for t in q.terms]
    if isinstance(q, ast._Many):
        return [x for p in q.parts for x in _leaves(p)]
    if isinstance(q, ast.Difference):
        return _leaves(q.left)
    return []


def resolve(q: ast.Query, parser: Parser) -> ast.Query:
    """The tree with its unparsed leaves parsed."""
    if isinstance(q, ast.Lazy):
        return parser.parse(q.text)
    if isinstance(q, ast._Many):
        return type(q)(tuple(resolve(p, parser) for p in q.parts), q.boost)
    if isinstance(q, ast.Difference):
        return ast.Difference(resolve(q.left, parser), resolve(q.right, parser), q.boost)
    return q


def matches(q: ast.Query, ix: Index) -> Column:
    """Whether a row matches."""
    if isinstance(q, ast.Term):
        return F.array_contains(ix.tokens[q.field], q.term)
    if isinstance(q, ast.Phrase):
        t = F.col(ix.tokens[q.field])
        return reduce(lambda a, b: a & b, [F.array_contains(t, x) for x in dict.fromkeys(q.terms)]) & (phrase_at(t, q.terms) > 0)
    if isinstance(q, ast.And):
        return reduce(lambda a, b: a & b, [matches(p, ix) for p in q.parts])
    if isinstance(q, ast.Or):
        return reduce(lambda a, b: a | b, [matches(p, ix) for p in q.parts])
    if isinstance(q, ast.Difference):
        return matches(q.left, ix) & ~matches(q.right, ix)
    if isinstance(q, ast.Range):
        def inside(v: Column) -> Column:
            return (v >= q.start if q.with_start else v > q.start) & (v <= q.end if q.with_end else v < q.end)

        return F.coalesce(inside(F.col(ix.values[q.field])) if q.field in ix.values else F.exists(ix.tokens[q.field], inside), F.lit(False))
    if isinstance(q, ast.Prefix):
        return F.coalesce(F.exists(ix.tokens[q.field], lambda x: F.startswith(x, F.lit(q.start))), F.lit(False))
    if isinstance(q, ast.Payload):
        return F.col(ix.payloads[q.field]).isNotNull()
    if isinstance(q, ast.MatchAll):
        return F.lit(True)
    raise TypeError(f"can't search for {q!r}")


def document_frequencies(ix: Index, q: ast.Query, *more: Column) -> DataFrame:
    """One row: n documents and df_k, the documents with the k-th distinct (field, term) of the query; and ``more`` counts."""
    leaves = list(dict.fromkeys(_leaves(q)))
    return ix.docs.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains(ix.tokens[f], t)).alias(f"df_{k}") for k, (f, t) in enumerate(leaves)], *more)


def _score(q: ast.Query, ix: Index, idf: dict, boost: float = 1.0) -> tuple[Column, Column, list[Column]]:
    """Sum of the leaves' parts, number of clauses that match, and squared weights (for the query's norm)."""
    b = boost * q.boost
    if isinstance(q, (ast.Term, ast.Phrase)):
        t = F.col(ix.tokens[q.field])
        terms = (q.term,) if isinstance(q, ast.Term) else q.terms
        w = reduce(lambda x, y: x + y, [idf[q.field, x] for x in terms])
        tf = F.size(F.filter(t, lambda x: x == q.term)) if isinstance(q, ast.Term) else phrase_at(t, q.terms)
        norm = ix.field_boost.get(q.field, 1.0) / F.sqrt(F.greatest(F.size(t), F.lit(1)))
        doc = F.col(ix.boost) if ix.boost else F.lit(1.0)
        return F.sqrt(tf) * w * w * b * norm * doc, (tf > 0).cast("int"), [(w * b) * (w * b)]
    if isinstance(q, ast._Many):
        parts = [_score(p, ix, idf, b) for p in q.parts]
        hit = [matches(p, ix) for p in q.parts]
        total = reduce(lambda x, y: x + y, [F.when(h, p[0]).otherwise(0.0) for h, p in zip(hit, parts, strict=True)])
        found = reduce(lambda x, y: x + y, [h.cast("int") for h in hit])
        return total * found / len(parts), (found > 0).cast("int"), [w for p in parts for w in p[2]]
    if isinstance(q, ast.Difference):
        return _score(q.left, ix, idf, b)
    if isinstance(q, ast.Payload):
        scorer = ix.scorers.get(q.field, lambda c: F.lit(1.0))
        return scorer(F.col(ix.payloads[q.field])) * b, matches(q, ix).cast("int"), [F.lit(b * b)]
    return F.lit(b), matches(q, ix).cast("int"), [F.lit(b * b)]


def search_and_count(ix: Index, query: ast.Query | str) -> tuple[DataFrame, int]:
    """As ``search``, and the number of matches, which the scan for the document frequencies counts: it runs now, and once."""
    q = resolve(ast.Lazy(query) if isinstance(query, str) else query, ix.parser)
    stats = document_frequencies(ix, _scored(q)[0], F.count_if(matches(q, ix)).alias("found"))
    row = stats.first()
    held = ix.docs.sparkSession.createDataFrame([row], stats.schema)
    return search(ix, q, stats=held.drop("found")), row["found"]


def _scored(q: ast.Query) -> tuple[ast.Query, list[ast.Payload]]:
    """The part of a tree whose leaves are scored, and the payload parts of an And, which multiply it."""
    parts = [p for p in q.parts if isinstance(p, ast.Payload)] if isinstance(q, ast.And) else []
    if not parts:
        return q, []
    left = tuple(p for p in q.parts if not isinstance(p, ast.Payload))
    return ast.And(left, q.boost) if len(left) > 1 else left[0] if left else ast.MatchAll(), parts


def search(ix: Index, query: ast.Query | str, where: object = None, stats: DataFrame | None = None) -> DataFrame:
    """The rows that match, with ``score`` (SCR1: coord, tf, idf, boosts and length norm; norms are not quantised).

    Payload parts of an And multiply the score of the others by their scorer. ``stats``: document frequencies, if they
    are there already.
    """
    q = resolve(ast.Lazy(query) if isinstance(query, str) else query, ix.parser)
    match = matches(q, ix)
    rest, payloads = _scored(q)
    factors = [ix.scorers.get(p.field, lambda c: F.lit(1.0))(F.col(ix.payloads[p.field])) for p in payloads]
    leaves = list(dict.fromkeys(_leaves(rest)))
    stats = document_frequencies(ix, rest) if stats is None else stats
    idf = {x: 1 + F.ln(F.col("lq_n") / (F.col(f"lq_df_{k}") + 1)) for k, x in enumerate(leaves)}
    total, _, weights = _score(rest, ix, idf)
    norm = F.sqrt(reduce(lambda a, b: a + b, weights))
    score = total / norm
    for f in factors:
        score = score * f
    docs = ix.docs.where(match)
    if where is not None:
        docs = docs.where(filter_column(where, ix))
    if leaves:  # one row: joining it costs no shuffle
        named = stats.select(*[F.col(c).alias(f"lq_{c}") for c in stats.columns])
        docs = docs.crossJoin(F.broadcast(named))
    out = docs.withColumn("score", score.cast("double"))
    return out.drop("lq_n", *[f"lq_df_{k}" for k in range(len(leaves))])


def filter_column(f: object, ix: Index) -> Column:
    """A filter tree as a Column; a null value passes no filter (FLT1-FLT3)."""
    if isinstance(f, ast.ValueFilter):
        c = F.array_contains(ix.tokens[f.field], f.value) if f.field in ix.tokens and f.field not in ix.values else F.col(ix.values[f.field]) == f.value
    elif isinstance(f, ast.RangeFilter):
        c = F.col(ix.values[f.field]).between(f.start, f.end)
    elif isinstance(f, ast.BoolFilter):
        parts = [filter_column(p, ix) for p in f.parts]
        c = reduce(lambda a, b: (a | b) if f.any else (a & b), parts, F.lit(not f.any))
    else:
        raise TypeError(f"no filter: {f!r}")
    return F.coalesce(c, F.lit(False))


def order_columns(order: list[tuple[str, str, bool]], key: str) -> list[Column]:
    """Sort columns, nulls last, the key last of all (SRT1-SRT4)."""
    cols = []
    for name, kind, down in order:
        c = F.col(name).cast(kind)
        cols.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    return [*cols, F.col(key).asc()]


def page(hits: DataFrame, order: list[tuple[str, str, bool]], key: str = "doc_id", offset: int = 0, count: int = HITS_PER_PAGE) -> DataFrame:
    """One page of ordered hits; the count is held to HITS_PER_PAGE (SRT5, SRT6)."""
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be from 0 to {MAX_OFFSET}")
    return hits.orderBy(*order_columns(order, key)).offset(offset).limit(max(0, min(count, HITS_PER_PAGE)))


def top_hits(hits: DataFrame, order: list[tuple[str, str, bool]], key: str, n: int) -> DataFrame:
    return hits.orderBy(*order_columns(order, key)).limit(n)


def group_hits(ranked: DataFrame, group: Column, n_groups: int, size: int, rank: str = "rank") -> DataFrame:
    """Groups of ranked hits (GRP0-GRP2): the first ``n_groups`` groups by their best rank, ``size`` rows of each.

    As the scan ends when the last group opens, rows after that rank are not taken. ``rank`` counts from 1. Adds
    group_rank and rank_in_group. The input is a bounded top-k, so its windows are small.
    """
    g = ranked.withColumn("group_key", group)
    best = Window.partitionBy("group_key")
    g = g.withColumn("lq_open", F.min(rank).over(best))
    g = g.withColumn("group_rank", F.dense_rank().over(Window.orderBy("lq_open")))
    last = F.max(F.when(F.col("group_rank") <= n_groups, F.col("lq_open"))).over(Window.partitionBy())
    opened = F.max("group_rank").over(Window.partitionBy())
    g = g.withColumn("lq_last", last).withColumn("lq_opened", opened)
    g = g.where((F.col("group_rank") <= n_groups) & ((F.col(rank) <= F.col("lq_last")) | (F.col("lq_opened") < n_groups)))
    g = g.withColumn("rank_in_group", F.row_number().over(best.orderBy(rank)))
    return g.where(F.col("rank_in_group") <= size).drop("lq_open", "lq_last", "lq_opened")


def estimate_groups(total: int, consumed: int, groups: int) -> int:
    """totalGroupsEstimation, whole divisions (GRP4)."""
    ratio = consumed // groups if groups else 0
    return total // ratio if ratio else 0


def merge_shards(shards: list[DataFrame], order: list[tuple[str, str, bool]], key: str, n: int) -> DataFrame:
    """Each shard's best ``n`` rows, then the best of all (GRP5, SRV11)."""
    parts = [top_hits(s, order, key, n) for s in shards]
    return top_hits(reduce(lambda a, b: a.unionByName(b), parts), order, key, n)


def expand_synonyms(tokens: DataFrame, synonyms: DataFrame, token: str = "token", most: int = 10) -> DataFrame:
    """Tokens and their synonyms (word, synonym), ``most`` of each word in order (QRY13)."""
    few = synonyms.groupBy("word").agg(F.slice(F.sort_array(F.collect_set("synonym")), 1, most).alias("more"))
    out = tokens.join(few, tokens[token] == few.word, "left")
    return out.withColumn("expanded", F.explode(F.concat(F.array(token), F.coalesce("more", F.array().cast("array<string>"))))).drop("word", "more")


def suggest_rewrites(queries: DataFrame, suggestions: DataFrame, query: str = "query") -> DataFrame:
    """Each query with one token replaced by a suggestion (token, suggestion), the others as they are (SRV8)."""
    t = queries.select(query, F.split(F.trim(query), r"\s+").alias("t"), F.posexplode(F.split(F.trim(query), r"\s+")).alias("at", "token"))
    j = t.join(suggestions, "token")
    return j.select(query, F.array_join(F.transform("t", lambda x, i: F.when(i == F.col("at"), F.col("suggestion")).otherwise(x)), " ").alias("rewrite"))


def accept_suggestion(counts: list[tuple[str, int]], current: int, factor: float = 2.0, tries: int = 5, enough: int = 100) -> str | None:
    """The rewrite to offer: of the first ``tries``, the best whose count beats ``factor`` times the current one (SRV7)."""
    if current >= enough:
        return None
    best, most = None, current * factor
    for text, n in counts[:tries]:
        if n > most:
            best, most = text, n
    return best
