"""Spelling dictionary, gram index and suggestions (SPL1-SPL4, FN16)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILE, SHORTEST, START, END = 0.9, 3, 2.0, 1.0
#: Costs of likely confusions, of inserting or dropping a letter, and of a silent one (fixed values).
CONFUSED = {frozenset(p): c for p, c in (("sz", 0.4), ("mn", 0.6), ("ck", 0.6), ("cs", 0.6), ("bv", 0.4), ("gj", 0.6))}
EDIT, SILENT = 1.0, {"h": 0.2}


def dictionary(stats: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """(term, df, boost) of the terms whose document frequency reaches the percentile (SPL1).

    The rows come out of a generator, so no filter on a term goes below the counts, and all that use them share one exchange.
    """
    bar = stats.agg(F.percentile("df", percentile).alias("bar"))
    rows = stats.crossJoin(F.broadcast(bar)).where("df >= bar")
    return rows.select(F.inline(F.array(F.struct("term", "df", (F.col("df") - F.col("bar") + 1).alias("boost")))))


def gram_sizes(word: Column) -> tuple[Column, Column]:
    n = F.length(word)
    return F.when(n > 5, 3).when(n == 5, 2).otherwise(1), F.when(n > 5, 4).when(n == 5, 3).otherwise(2)


def grams(words: DataFrame, word: str = "term") -> DataFrame:
    """(word, kind, gram): grams of a word by its length, and its first and last of each size (SPL2)."""
    low, high = gram_sizes(F.col(word))
    rows = words.where(F.length(word) >= SHORTEST).withColumn("size", F.explode(F.sequence(low, high)))
    rows = rows.select(word, "size", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(word) - F.col("size") + 1), lambda i: F.substring(F.col(word), i, F.col("size")))).alias("at", "gram"))
    kinds = F.concat(F.array(F.concat(F.lit("gram"), "size")), F.when(F.col("at") == 0, F.array(F.concat(F.lit("start"), "size"))).otherwise(F.array().cast("array<string>")), F.when(F.col("at") == F.length(word) - F.col("size"), F.array(F.concat(F.lit("end"), "size"))).otherwise(F.array().cast("array<string>")))
    return rows.select(word, F.explode(kinds).alias("kind"), "gram").distinct()


def candidates(asked: DataFrame, index: DataFrame, n: int, word: str = "term") -> DataFrame:
    """(asked, word, weight): the best 10 n words by shared grams, first ones counting START, last ones END (SPL3)."""
    a = grams(asked.withColumnRenamed("asked", word), word).withColumnRenamed(word, "asked")
    w = F.when(F.col("kind").startswith("start"), START).otherwise(END)
    hits = a.join(index, ["kind", "gram"]).where(F.col("asked") != F.col(word)).groupBy("asked", word).agg(F.sum(w).alias("weight"))
    turn = Window.partitionBy("asked").orderBy(F.desc("weight"), word)
    return hits.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= 10 * n).drop("turn")


def suggestions(asked: DataFrame, index: DataFrame, stats: DataFrame, n: int, distance=None, least: float = 0.5, word: str = "term") -> DataFrame:
    """(asked, word, score, df): score 1 - distance / shorter length, at least ``least``; best first by score, then df (SPL3)."""
    distance = distance or (lambda a, b: F.levenshtein(a, b).cast("double"))
    c = candidates(asked, index, n, word)
    d = distance(F.col("asked"), F.col(word)) / F.least(F.length("asked"), F.length(word))
    scored = c.withColumn("score", 1 - d).where(F.col("score") >= least).join(stats.select(word, "df"), word)
    turn = Window.partitionBy("asked").orderBy(F.desc("score"), F.desc("df"), word)
    return scored.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n).select("asked", word, "score", "df")


def _swap(a: str, b: str) -> float:
    return 0.0 if a == b else CONFUSED.get(frozenset((a, b)), EDIT)


def distance(s: str, t: str) -> float:
    """Weighted edit distance with swaps of neighbours (FN16); its border holds single costs, not sums.

    The distance to an empty word is the other word's length.
    """
    if not s or not t:
        return float(len(s) + len(t))
    drop = [0.0] + [SILENT.get(c, EDIT) for c in s]
    add = [0.0] + [SILENT.get(c, EDIT) for c in t]
    rows = [add]
    for i in range(1, len(s) + 1):
        row = [drop[i]]
        for j in range(1, len(t) + 1):
            cost = _swap(s[i - 1], t[j - 1])
            best = min(rows[i - 1][j] + drop[i], row[j - 1] + add[j], rows[i - 1][j - 1] + cost)
            if i > 1 and j > 1 and s[i - 1] == t[j - 2] and s[i - 2] == t[j - 1]:
                best = min(best, rows[i - 2][j - 2] + cost)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def weighted_distance(a: Column | str, b: Column | str) -> Column:
    """FN16 as a Column, in Arrow batches."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(batch, "double")(a, b)
