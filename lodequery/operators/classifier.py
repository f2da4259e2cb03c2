"""Bayesian text classifier (CLS1-CLS9, MOD6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import once_and_all

SURE_IN, SURE_OUT, UNKNOWN = 0.99, 0.01, 0.5
IGNORE, MIN_REQUIRED = (0.4, 0.6), (1, 1, 1)
#: Tokens of a model up to which it is learned once, by way of the driver, and held by every executor; beyond, it is joined.
HELD = 3_000_000


def token_counts(docs: DataFrame, tokens: str, *labels: str) -> DataFrame:
    """(token, doc_in, doc_out, tf_in, tf_out): documents and occurrences inside and outside the category (CLS1).

    docs: one row a document and label. Of more labels than one, the names of the second's counts end in 1, and so on.
    """

    def of(name: str, k: int) -> list[Column]:
        y, once = F.col(name) == 1, F.col("once") == 1
        parts = {"doc_in": y & once, "doc_out": ~y & once, "tf_in": y & ~once, "tf_out": ~y & ~once}
        return [F.count_if(c).alias(f"{n}{k or ''}") for n, c in parts.items()]

    return once_and_all(docs, tokens, *labels).groupBy("token").agg(*[c for k, x in enumerate(labels) for c in of(x, k)])


def probability(c: Column, n: Column, total_in: Column, total_out: Column, least: tuple[int, int, int] = MIN_REQUIRED) -> Column:
    """Chance of the category given a token, from its document counts; null where the counts are too small (CLS2).

    least: counts that must be exceeded by tokens seen outside only, inside only, and in both.
    """
    p, q = c / total_in, n / total_out
    return F.when((c == 0) & (n > least[0]), F.lit(SURE_OUT)).when((n == 0) & (c > least[1]), F.lit(SURE_IN)).when((c > 0) & (n > 0) & (c + n > least[2]), p / (p + q))


def token_probabilities(counts: DataFrame, totals: DataFrame, least: tuple[int, int, int] = MIN_REQUIRED, ignore: tuple[float, float] = IGNORE) -> DataFrame:
    """(token, prob) for tokens that say something: 0 and the band ``ignore`` are dropped. ``totals``: one row n_in, n_out."""
    names = [c.replace("doc_in", "prob") for c in counts.columns if c.startswith("doc_in")]
    at = [n.replace("prob", "") for n in names]
    p = [probability(*[F.col(f"{c}{k}") for c in ("doc_in", "doc_out", "n_in", "n_out")], least).alias(n) for n, k in zip(names, at, strict=True)]
    rows = counts.crossJoin(F.broadcast(totals)).select("token", *p)
    told = [F.when((F.col(n) > 0) & ~F.col(n).between(*ignore), F.col(n)).alias(n) for n in names]
    return rows.select("token", *told).where(F.coalesce(*names).isNotNull())


def totals(docs: DataFrame, *labels: str) -> DataFrame:
    return docs.agg(*[F.count_if(c).alias(f"{n}{k or ''}") for k, x in enumerate(labels) for n, c in (("n_in", F.col(x) == 1), ("n_out", F.col(x) != 1))])


def held(model: DataFrame, most: int | None = None) -> DataFrame:
    """The model, learned now and broadcast to its joins if it has at most ``most`` tokens, so that no text's tokens are shuffled; else as it is."""
    most = HELD if most is None else most
    rows = model.limit(most + 1).toArrow()
    return model if rows.num_rows > most else F.broadcast(model.sparkSession.createDataFrame(rows, model.schema))


def overlay(model: DataFrame, mine: DataFrame) -> DataFrame:
    """The model with one's own probabilities before the learned ones (CLS3, D13)."""
    m = mine.select("token", F.col("prob").alias("own"))
    return model.join(m, "token", "full").select("token", F.coalesce("own", "prob").alias("prob"))


def remove_tokens(model: DataFrame, tokens: DataFrame) -> DataFrame:
    return model.join(tokens, "token", "left_anti")


def scores(docs: DataFrame, tokens: str, model: DataFrame, key: str = "doc_id", unknown: float = UNKNOWN) -> DataFrame:
    """(key, score): over a document's distinct tokens, the sigmoid of the summed log odds (CLS4); no tokens gives 0.5.

    Tokens that the model lacks count as ``unknown``. Of a model of more labels, score1 is the second's, and so on.
    """
    rows = docs.select(key, F.explode_outer(F.array_distinct(tokens)).alias("token"))
    joined = rows.join(model, "token", "left")

    def of(prob: str) -> Column:
        p = F.when(F.col("token").isNull(), F.lit(0.5)).otherwise(F.coalesce(prob, F.lit(unknown)))
        return (1 / (1 + F.exp(-F.sum(F.ln(p / (1 - p)))))).alias(prob.replace("prob", "score"))

    return joined.groupBy(key).agg(*[of(c) for c in model.columns if c != "token"])


def overall(by_category: DataFrame, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The greatest score of all categories (CLS5)."""
    return by_category.groupBy(key).agg(F.max(score).alias("overall"))


def confusion(scored: DataFrame, label: str, score: str = "score", at: float = 0.5) -> DataFrame:
    """(bucket, n): u for the user's label, c for the classifier's (CLS6)."""
    u = F.when(F.col(label) == 1, "uinc").otherwise("unot")
    c = F.when(F.col(score) >= at, "cinc").otherwise("cnot")
    return scored.groupBy(F.concat_ws("_", u, c).alias("bucket")).agg(F.count("*").alias("n"))


def why(docs: DataFrame, tokens: str, model: DataFrame, key: str = "doc_id", unknown: float = UNKNOWN) -> DataFrame:
    """(key, token, prob): what each distinct token says (CLS7)."""
    rows = docs.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    return rows.join(model, "token", "left").select(key, "token", F.coalesce("prob", F.lit(unknown)).alias("prob"))


def who_has(docs: DataFrame, tokens: str, key: str = "doc_id") -> DataFrame:
    """(token, key): who has a token, one row each; ``who_has_lists`` gathers them (CLS8, D14)."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token"), key)


def who_has_lists(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    return pairs.groupBy("token").agg(F.sort_array(F.collect_set(key)).alias("who"))


def relabel(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """URL labels (category, url, state) after changes: the last state wins, the states exclude each other (CLS9)."""
    both = labels.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    return both.groupBy("category", "url").agg(F.max_by("state", "seq").alias("state"))


def model_by_probability(model: DataFrame) -> DataFrame:
    """For inspection: by probability, then token, both descending (SRT8)."""
    return model.orderBy(F.desc("prob"), F.desc("token"))
