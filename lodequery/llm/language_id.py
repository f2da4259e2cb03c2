"""Language identification by segmentation-marginalised unigrams (operator 2).

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations of the product of their pieces' probabilities (forward algorithm); a text's is the
product over its words. The piece probabilities come from expectation maximisation over the words of labelled texts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, held_out, map_columns, only

#: Labelled texts that a language is learned from, about (the documented bound), and rounds of expectation maximisation.
TRAIN_TEXTS, ROUNDS = 150, 2
#: Languages that a model may have; a column with more distinct values is not one of languages.
MOST_LANGUAGES = 5000
#: Words that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 250_000, 200
#: Letters, and numbers that are no decimal digits; and letters alone, which is slower.
_ALMOST, _WORD = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Probability of a character that no piece covers, and the weight of the smoothing distribution.
UNKNOWN, SMOOTH = 1e-7, 0.02


def words_of(text: str) -> list[str]:
    """Runs of letters (the Unicode categories L*), lower case."""
    text = text.lower()
    words = _ALMOST.findall(text)
    return words if text.isascii() or not words or "".join(words).isalpha() else _WORD.findall(text)


def vocabulary(path: str) -> list[str]:
    """Pieces of the public vocabulary in lower case that hold letters only (after the word mark)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(k).lower() for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))}
    return sorted(p for p in pieces if p.lstrip("▁").isalpha())


class Model:
    """``prob``: piece to its probability in each language; langs in sorted order."""

    def __init__(self, langs: list[str], prob: dict[str, tuple[float, ...]]):
        self.langs, self.prob, self.key = langs, prob, uuid.uuid4().hex
        self.heads = {p[:k] for p in prob for k in range(1, len(p))}
        self.longest = max(map(len, prob), default=1)

    def forward(self, word: str) -> list[float]:
        """Log probability of a word in each language, all segmentations summed."""
        prob, heads, some = self.prob, self.heads, range(len(self.langs))
        w = "▁" + word
        n = len(w)
        total = [0.0] * len(self.langs)
        alpha: list = [None] * (n + 1)
        alpha[0] = [1.0] * len(self.langs)
        for j in range(n):
            a = alpha[j]
            if j % 16 == 0 and j:  # long words: what lies ahead is scaled, language by language
                ahead = [x for x in alpha[j : j + self.longest + 1] if x is not None]
                for k in some:
                    if a[k] < 1e-100:
                        by = a[k] or 1e-300
                        total[k] += math.log(by)
                        for x in ahead:
                            x[k] /= by
            alpha[j] = None
            for i in range(j + 1, n + 1):
                s = w[j:i]
                p = prob.get(s)
                if p is None and i == j + 1:
                    p = (UNKNOWN,) * len(self.langs)
                if p is not None:
                    b = alpha[i]
                    if b is None:
                        alpha[i] = [x * y for x, y in zip(a, p)]  # noqa: B905
                    else:
                        for k in some:
                            b[k] += a[k] * p[k]
                if s not in heads:
                    break
        return [t + math.log(max(x, 1e-300)) for t, x in zip(total, alpha[n], strict=True)]


def learn(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation maximisation of each language's piece probabilities from its word counts."""
    langs = sorted(counts)
    every = set(pieces)
    heads = {p[:k] for p in pieces for k in range(1, len(p))}
    first = {p: 1.0 / len(pieces) for p in pieces}
    learned = {}
    for lang in langs:
        q = first
        for _ in range(rounds):
            got: dict[str, float] = defaultdict(float)
            for word, times in counts[lang].items():
                _expect("▁" + word, times, q, every, heads, got)
            total = sum(got.values()) or 1.0
            q = {p: v / total for p, v in got.items()}
        learned[lang] = q
    seen = sorted(set().union(*learned.values())) if learned else []
    even = {p: sum(learned[lang].get(p, 0.0) for lang in langs) / len(langs) for p in seen}
    floor = SMOOTH / max(len(seen), 1) / 10
    return Model(langs, {p: tuple((1 - SMOOTH) * learned[lang].get(p, 0.0) + SMOOTH * even[p] + floor for lang in langs) for p in seen})


def _expect(w: str, times: int, q: dict, every: set, heads: set, got: dict) -> None:
    """Add how often each piece is expected in ``times`` words ``w``, over all segmentations.

    Forward sums are held as logarithms; going back, an end shares its chance among the arcs that lead to it.
    """
    n = len(w)
    into: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    alpha = [0.0] * (n + 1)
    for j in range(n):
        if j:
            arcs = into[j]
            if len(arcs) == 1:
                alpha[j] = arcs[0][2]
            else:
                top = max(x for _, _, x in arcs)
                alpha[j] = top + math.log(sum(math.exp(x - top) for _, _, x in arcs))
        for i in range(j + 1, n + 1):
            s = w[j:i]
            p = q.get(s, 1e-9) if s in every else UNKNOWN if i == j + 1 else 0.0
            if p:
                into[i].append((j, s, alpha[j] + math.log(p)))
            if s not in heads:
                break
    share = [0.0] * n + [1.0]
    for i in range(n, 0, -1):
        if share[i]:
            top = max(x for _, _, x in into[i])
            parts = [math.exp(x - top) for _, _, x in into[i]]
            by = share[i] / sum(parts)
            for (j, s, _), x in zip(into[i], parts, strict=True):
                share[j] += x * by
                if s in every:
                    got[s] += times * x * by


def train(df: DataFrame, vocab: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", texts: int = TRAIN_TEXTS) -> Model:
    """Learn from rows with a language and a text that are not held out: about ``texts`` of each language, by a hash of the id.

    Only words and their counts reach the driver, those of the sampled texts in full.
    """
    may = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit("language"), F.col(doc_id)), F.lit(1 << 30)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} values")
    if not sizes:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, texts / n) * (1 << 30)))])
    sample = may.where(F.col("draw") < share[F.col("lang")]).select("lang", "text")
    # One round of counting in Python (texts become words by the same rule as in prediction), summed by Spark.
    def count(batches):
        import pyarrow as pa

        for b in batches:
            c: Counter = Counter()
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c.update((k, w) for w in words_of(t))
            rows = list(c.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "word", "n"])

    counts = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got: dict[str, Counter] = {k: Counter() for k in sizes}
    table = counts.orderBy("lang", F.desc("n"), "word").toArrow()
    for b in table.to_batches():
        for k, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[k][w] = n
    model = learn({k: c for k, c in got.items() if c}, vocabulary(vocab))
    del got, table
    give_back(df.sparkSession)
    return model


_memo: dict = {"key": None}


class Predictor:
    """Sums words' log probabilities; words are remembered over batches and tasks of a worker."""

    def __init__(self, model: Model):
        self.model = model
        if _memo["key"] != model.key:
            _memo.clear()
            _memo.update(key=model.key, at={}, table=np.empty((0, len(model.langs))))
        only("language", lambda: _memo.update(key=None, at={}, table=None))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        if not model.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(_memo["at"]) > MEMO:
            _memo.update(at={}, table=np.empty((0, len(model.langs))))
        at, base = _memo["at"], len(_memo["table"])
        get, new, ids = at.get, [], []
        for t in texts:
            words = words_of(t) if t else []
            got = list(map(get, words))
            if None in got:
                for k, g in enumerate(got):
                    if g is None:
                        w = words[k]
                        g = get(w)
                        if g is None:
                            g = base + len(new)
                            new.append(model.forward(w))
                            if len(w) <= MEMO_CHARS:
                                at[w] = g
                        got[k] = g
            ids.append(np.array(got, np.int64))
        if new:
            _memo["table"] = np.concatenate([_memo["table"], np.array(new).reshape(-1, len(model.langs))])
        table = _memo["table"]
        langs, scores = [], []
        for k in ids:
            if not len(k):
                langs.append("und")
                scores.append(0.0)
                continue
            s = table[k].sum(0)
            best = int(s.argmax())
            langs.append(model.langs[best])
            scores.append(float(1.0 / np.exp(np.clip(s - s[best], -700, 0)).sum()))
        return langs, scores


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score (posterior of lang_pred under equal priors) to the columns ``keep`` (default: all).

    Columns of these names in the input are replaced. A null text, one without a letter, or a model that learned
    nothing gives ``und`` with score 0; ties go to the language that sorts first.
    """
    names = ("lang_pred", "score")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return Predictor(shared.value).predict

    return map_columns(df, [text], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, keep)
