"""Language detection by character trigrams (FN17): a profile a language, learned from texts whose language is known."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Added to a trigram's count, and to the sum of all.
ONE, MORE = 1.0, 1000.0
#: Rows of the profiles (language and trigram) up to which they are held by every worker; beyond, a join finds them.
HELD = 1_000_000
MEMO = 200_000
#: Texts that are scored at a time.
ROWS = 2000


def _trigrams(word: str) -> Column:
    """The trigrams of a word between blanks, one for each of its letters."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))).alias("g")


def profiles(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (lang, w, m): (lang, g, lp) log probabilities of trigrams, and (lang, low) that of one not seen."""
    per = words.groupBy("lang", "w").agg(F.sum("m").alias("m")).select("lang", "m", _trigrams("w")).groupBy("lang", "g").agg(F.sum("m").alias("n"))
    size = per.groupBy("lang").agg(F.sum("n").alias("total"))
    known = per.join(F.broadcast(size), "lang").select("lang", "g", F.ln((F.col("n") + ONE) / (F.col("total") + MORE)).alias("lp"))
    return known, size.select("lang", F.ln(ONE / (F.col("total") + MORE)).alias("low"))


def detect(docs: DataFrame, words: Column, known: DataFrame, low: DataFrame, key: str = "doc_id", held: int = HELD) -> DataFrame:
    """(key, detected): the language whose profile gives a document's words the greatest likelihood, first by name of equals.

    Documents without words have no row. Profiles of at most ``held`` rows go to every worker and texts are scored as they
    are read; greater ones are joined to the texts' distinct words.
    """
    rows = known.join(F.broadcast(low), "lang").select("lang", "g", "lp", "low").limit(held + 1).toArrow()
    return _scan(docs, words, rows, key) if rows.num_rows <= held else _join(docs, words, known, low, key)


def _scan(docs: DataFrame, words: Column, rows: pa.Table, key: str) -> DataFrame:
    """``rows``: (lang, g, lp, low), learned by one job."""
    floor = dict(zip(rows.column("lang").to_pylist(), rows.column("low").to_pylist(), strict=True))
    langs = sorted(floor)
    base = np.array([floor[x] for x in langs])
    at = {x: k for k, x in enumerate(langs)}
    grams = {g: k for k, g in enumerate(dict.fromkeys(rows.column("g").to_pylist()))}
    lps = np.tile(base, (len(grams) + 1, 1))  # the last row is that of a trigram not seen
    for g, lang, lp in zip(*(rows.column(c).to_pylist() for c in ("g", "lang", "lp")), strict=True):
        lps[grams[g], at[lang]] = lp
    shared = docs.sparkSession.sparkContext.broadcast((grams, lps))
    schema = T.StructType([docs.schema[key], T.StructField("detected", T.StringType())])

    def run(batches):
        grams, lps = shared.value
        get, none = grams.get, len(grams)
        seen: dict[str, int] = {}
        known = np.zeros((0, len(langs)))

        def sums(new: list[str]) -> np.ndarray:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            at = np.fromiter((get(p[i : i + 3], none) for w in new for p in (f" {w} ",) for i in range(len(w))), np.int64)
            return np.add.reduceat(lps[at], np.cumsum(sizes) - sizes, 0)

        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            lists = b.column(1)
            flat = lists.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            if len(seen) > MEMO:
                seen, known = {}, known[:0]
            new = [w for w in names if w not in seen]
            parts = [sums(new[k : k + MEMO]) for k in range(0, len(new), MEMO)]
            seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
            known = np.concatenate([known, *parts])
            scores = known[[seen[w] for w in names]] if names else known[:0]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            has = np.flatnonzero(sizes)
            index = flat.indices.to_numpy()
            starts = (np.cumsum(sizes) - sizes)[has]
            total = np.round(np.add.reduceat(scores[index], starts, 0), 4) if len(has) else np.zeros((0, len(langs)))
            best = [langs[k] for k in total.argmax(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(best, pa.string())], names=schema.names)

    return docs.select(key, words.alias("lq_w")).mapInArrow(run, schema)


def _join(docs: DataFrame, words: Column, known: DataFrame, low: DataFrame, key: str) -> DataFrame:
    w = docs.select(F.col(key).alias("lq_id"), F.explode(words).alias("w")).groupBy("lq_id", "w").agg(F.count("*").alias("m"))
    prof = known.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("lang", "lp"))).alias("lp"))
    floor = low.agg(F.sort_array(F.collect_list(F.struct("lang", "low"))).alias("langs"))
    # Every trigram of a word counts, also one that no profile has.
    rows = w.select("w").distinct().select("w", _trigrams("w")).join(prof, "g", "left").crossJoin(F.broadcast(floor))
    scored = rows.select("w", F.explode(F.transform("langs", lambda x: F.struct(x.lang.alias("of"), F.coalesce(F.element_at("lp", x.lang), x.low).alias("s")))).alias("x"))
    scored = scored.groupBy("w", "x.of").agg(F.sum("x.s").alias("s"))
    s = w.join(scored, "w").groupBy("lq_id", "of").agg(F.round(F.sum(F.col("m") * F.col("s")), 4).alias("s"))
    best = s.groupBy("lq_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "of")).alias("best"))
    return best.select(F.col("lq_id").alias(key), F.col("best.of").alias("detected"))
