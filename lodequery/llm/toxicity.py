"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks (operator 9).

Two strings are alike as far as they share subsequences of ORDER characters that span at most SPAN, each weighted by
DECAY to the stretch it spans; so a gap or an inserted character costs a factor and does not hide a word. Words stand
between marks. Landmarks are pieces of marked words that labelled toxic texts hold significantly more often than clean
ones: whole insults, or roots that take any ending. A word's features are its kernel values with the landmarks, mapped
by the Nyström matrix. A linear machine is trained on the words of labelled texts' sentences, where a toxic text teaches
by its most suspicious words. A text's score is a logistic function of the decisions on its WORST worst different words:
one harsh word weighs less than several.
"""

from __future__ import annotations

import math
import re
import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, held_out, map_columns, only

#: Characters of a subsequence, the most that it may span, and the factor of each character of that stretch.
ORDER, SPAN, DECAY = 4, 7, 0.6
#: Characters of a landmark, marks included.
PIECE = range(4, 11)
#: Landmarks at least, where so many pieces are in more toxic texts than their share: all significant ones, then the next best.
LANDMARKS = 24
#: Toxic texts that a piece must be in to be tested: fewer can't be significant.
FEWEST = 4
#: Labelled texts learned from, about, of each class (the documented bound).
TRAIN_TEXTS = 1500
#: A word's greatest kernel value over a landmark's own from which on it is learned by itself; others are one like another.
LIKE = 0.5
#: Clean texts whose pieces are counted at once: this bounds the driver's memory only.
TEXTS = 200
#: Different words of a text that its score depends on.
WORST = 3
BEGIN, FINISH, MORE = "\x02", "\x03", "\x04"
#: Words that a worker remembers before it starts anew, tokens that are scored at once, and words that are compared at once.
MEMO, SLICE, WORDS = 250_000, 100_000, 4096
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
_TOKEN = re.compile(r"\S+")
_JUNK = re.compile(r"[\W_]+")
#: Where the last three characters of a subsequence may lie after its first.
_SHAPES = [s for s in combinations(range(1, SPAN), ORDER - 1)]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.lower()) if s and not s.isspace()]


def words_of(sentence: str) -> list[str]:
    """White-space words; runs of three or more one-character words count as one more word."""
    words = _TOKEN.findall(sentence)
    if sum(map(len, words)) > 2.5 * len(words):
        short = [k for k, w in enumerate(words) if len(w) == 1]
        if len(short) < 3 or not any(a + 2 == b for a, b in zip(short, short[2:])):  # noqa: B905
            return words
    run, extra = [], []
    for w in [*words, "--"]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                extra.append("".join(run))
            run = []
    return words + extra


def marked(word: str) -> str:
    """A word as the kernel sees it: letters and digits between marks."""
    return BEGIN + _JUNK.sub("", word) + FINISH


def subsequences(s: str) -> dict[str, float]:
    """The subsequences of ORDER characters that span at most SPAN, with their weights."""
    out: dict[str, float] = {}
    for i in range(len(s)):
        for shape in _SHAPES:
            if i + shape[-1] < len(s):
                u = s[i] + "".join([s[i + d] for d in shape])
                out[u] = out.get(u, 0.0) + DECAY ** (shape[-1] + 1)
    return out


def kernel(s: str, t: str) -> float:
    """The subsequence kernel of two strings."""
    a, b = subsequences(s), subsequences(t)
    return sum(v * b[u] for u, v in a.items() if u in b)


class Landmarks:
    """The kernel of any words with all landmarks at once, over each landmark's kernel with itself."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        feats = [subsequences(t) for t in strings]
        self.own = [sum(v * v for v in f.values()) for f in feats]
        letters = sorted(set("".join(strings)))
        self.base = len(letters) + 1
        self.letters = np.array([ord(c) for c in letters], np.int64)
        code = {c: k + 1 for k, c in enumerate(letters)}
        rows: dict[int, list[tuple[int, float]]] = {}
        for j, f in enumerate(feats):
            for u, v in f.items():
                key = 0
                for c in u:
                    key = key * self.base + code[c]
                rows.setdefault(key, []).append((j, v / self.own[j]))
        self.keys = np.array(sorted(rows), np.int64)
        lists = [rows[k] for k in self.keys.tolist()]
        self.ptr = np.cumsum([0] + [len(x) for x in lists])
        self.at = np.array([j for x in lists for j, _ in x], np.int64)
        self.weight = np.array([v for x in lists for _, v in x], np.float64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._hash(self.keys)] = True

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def gram(self) -> np.ndarray:
        """The landmarks' normalised kernel matrix."""
        g = self.values([], self.strings)
        own = np.sqrt(np.array(self.own))
        return g * own[None, :] / own[:, None]

    def values(self, words: list[str], strings: list[str] | None = None) -> np.ndarray:
        """[word, landmark]: the kernel of the marked word (or of ``strings`` as they are) over the landmark's own."""
        strings = [marked(w) for w in words] if strings is None else strings
        out = np.zeros(len(strings) * len(self.strings))
        if not self.strings or not strings:
            return out.reshape(len(strings), len(self.strings))
        raw = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        place = np.minimum(np.searchsorted(self.letters, raw), len(self.letters) - 1)
        code = np.where(self.letters[place] == raw, place + 1, 0)
        word = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
        two = {}
        for d in range(1, SPAN - 1):
            x, y = code[:-d], code[d:]
            two[d] = np.where((x > 0) & (y > 0), x * self.base + y, 0)
        found: list[np.ndarray] = []
        for a, b, c in _SHAPES:
            n = len(code) - c
            if n <= 0:
                continue
            x, y = two[a][:n], two[c - b][b : b + n]
            at = np.flatnonzero((x > 0) & (y > 0) & (word[:n] == word[c:]))
            key = x[at] * self.base**2 + y[at]
            ok = self.maybe[self._hash(key)]
            at, key = at[ok], key[ok]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            at, k = at[ok], k[ok]
            many = self.ptr[k + 1] - self.ptr[k]
            each = np.repeat(self.ptr[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append(np.repeat(word[at], many) * len(self.strings) + self.at[each])
            np.add.at(out, found[-1], self.weight[each] * DECAY ** (c + 1))
        return out.reshape(len(strings), len(self.strings))


class Model:
    """Landmarks, the Nyström map folded into ``weights`` and ``bias``, and the logistic function of the worst words."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, mix: np.ndarray):
        self.landmarks, self.weights, self.bias, self.mix = landmarks, weights, bias, mix
        self.index = Landmarks(landmarks)
        self.key = uuid.uuid4().hex

    def decisions(self, words: list[str]) -> np.ndarray:
        x = np.minimum(self.index.values(words), 1.0)
        return np.round((x * self.weights).sum(1) + self.bias, 9)

    def probability(self, worst: list[float]) -> float:
        """The score of a text by its worst words' decisions; words that it lacks count as unlike any landmark."""
        z = float((_evidence(np.array([worst + [self.bias] * (WORST - len(worst))])) @ self.mix)[0])
        return 1.0 / (1.0 + math.exp(min(700.0, max(-700.0, -z))))


def _evidence(worst: np.ndarray) -> np.ndarray:
    """The decisions on texts' worst words, up to the margin, and a constant."""
    return np.hstack([np.minimum(worst, 1.0), np.ones((len(worst), 1))])


def nystroem(landmarks: list[str]) -> np.ndarray:
    """Inverse square root of the landmarks' normalised kernel matrix."""
    w, v = np.linalg.eigh(Landmarks(landmarks).gram())
    return (v / np.sqrt(np.maximum(w, 1e-6))) @ v.T


class _Pieces:
    """Which pieces of ``length`` characters lie in which texts and words, as hashes."""

    def __init__(self, words: list[str], docs: list[np.ndarray]):
        self.words, self.text = words, "".join(words)
        self.code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.texts = len(docs)
        self.doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.word = np.concatenate(docs) if docs else np.empty(0, np.int64)

    def of(self, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, word, place) of every piece of the distinct words of the texts from ``low`` to before ``high``.

        A word's beginning that more letters follow counts as a piece of its own too: a root with an ending; its place
        is given as -1 - place.
        """
        h = np.zeros(max(len(self.code) - length + 1, 0), np.uint64)
        for k in range(length):
            h = (h ^ self.code[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        a, z = np.searchsorted(self.doc, [low, high])
        doc, word = self.doc[a:z].astype(np.int32), self.word[a:z].astype(np.int32)
        many = np.maximum(self.size[word] - length + 1, 0)
        first = np.repeat(np.cumsum(many) - many, many)
        place = (np.repeat(self.start[word], many) + np.arange(many.sum()) - first).astype(np.int32)
        root = self.size[word] > length + 1
        begin = self.start[word][root].astype(np.int32)
        if not len(h):
            return h, doc[:0], word[:0], place
        return (
            np.concatenate([h[place], ~h[begin]]),
            np.concatenate([np.repeat(doc, many), doc[root]]),
            np.concatenate([np.repeat(word, many), word[root]]),
            np.concatenate([place, -1 - begin]),
        )


def _pieces(texts: list[str]) -> _Pieces:
    ids: dict[str, int] = {}
    docs = []
    for t in texts:
        docs.append(np.array(sorted({ids.setdefault(marked(w), len(ids)) for s in sentences(t) for w in words_of(s)}), np.int64))
    return _Pieces(list(ids), docs)


def _ratio(c: np.ndarray, q: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood ratio of ``c`` toxic and ``q`` clean texts against the classes' shares; 0 where not in excess."""
    n = np.maximum(c + q, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(c > 0, c * np.log(c / (share * n)), 0.0) + np.where(q > 0, q * np.log(q / ((1 - share) * n)), 0.0)
    return np.where(c > share * n, r, 0.0)


def choose_landmarks(toxic: _Pieces, clean: _Pieces) -> list[str]:
    """Pieces of words in more toxic texts than chance gives any of the pieces, by the likelihood ratio, best first.

    As many pieces are tested, a ratio that one of them would reach by chance is not enough; but the LANDMARKS best are
    taken in any case, and the machine weighs them. After each pick the words that hold it no longer count, so that one
    root gives one landmark. Of equal pieces the longest, then the first in order is taken. A root that counted only with
    an ending is a landmark without one as well, and so are whole words that hold a pick and that clean texts hold more
    often than other such words: a harmless word may be the root of an insult.
    """
    n1, n0 = toxic.texts, clean.texts
    if not n1 or not n0:
        return []
    share, tested, rated = n1 / (n1 + n0), 0, []
    for length in PIECE:
        h, doc, word, place = toxic.of(length, 0, n1)
        if not len(h):
            continue
        hashes, first, ids = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(np.unique(ids * n1 + doc) // n1, minlength=len(hashes))
        q = np.zeros(len(hashes), np.int64)
        for s in range(0, n0, TEXTS):
            other, their = clean.of(length, s, s + TEXTS)[:2]
            at = np.minimum(np.searchsorted(hashes, other), len(hashes) - 1)
            ok = hashes[at] == other
            q += np.bincount(np.unique(at[ok] * n0 + their[ok]) // n0, minlength=len(hashes))
        tested += int((c >= FEWEST).sum())
        r = np.where(c >= FEWEST, _ratio(c, q, share), 0.0)
        best = np.argsort(-r, kind="stable")[: max(int((r >= math.log(max(tested, 1))).sum()), 8 * LANDMARKS)]
        best = best[r[best] > 0]
        turn = np.full(len(hashes), -1)
        turn[best] = np.arange(len(best))
        keep = turn[ids] >= 0
        names = [toxic.text[p : p + length] if p >= 0 else toxic.text[-1 - p : length - 1 - p] + MORE for p in place[first[best]].tolist()]
        rated.append((names, q[best], turn[ids[keep]], doc[keep], word[keep]))
    names = [x for r in rated for x in r[0]]
    if not names:
        return []
    clean_texts = np.concatenate([r[1] for r in rated])
    base = np.cumsum([0] + [len(r[0]) for r in rated])
    piece = np.concatenate([r[2] + b for r, b in zip(rated, base, strict=False)])
    doc, word = (np.concatenate([r[k] for r in rated]) for k in (3, 4))
    order = np.lexsort((doc, piece))
    piece, doc, word = piece[order], doc[order], word[order]
    group = np.flatnonzero(np.diff(piece * n1 + doc, prepend=-1))  # first row of each (piece, text)
    owner = piece[group]
    rank = np.lexsort((np.array(names), -np.array([len(x) for x in names])))
    prefer = np.empty(len(names), np.int64)
    prefer[rank] = np.arange(len(names))
    alive, out, least = np.ones(len(piece), bool), [], math.log(max(tested, 1))
    while True:
        there = np.logical_or.reduceat(alive, group)
        r = _ratio(np.bincount(owner[there], minlength=len(names)), clean_texts, share)
        top = np.flatnonzero(r >= r.max() - 1e-9)
        k = int(top[prefer[top].argmin()])
        if r[k] <= 0 or (len(out) >= LANDMARKS and r[k] < least):
            break
        out.append(names[k])
        gone = np.zeros(len(toxic.size), bool)
        gone[word[piece == k]] = True
        alive &= ~gone[word]
    roots = [x[:-1] for x in out if x[-1] == MORE]
    out = [x.rstrip(MORE) for x in out]
    return list(dict.fromkeys(out + [x + FINISH for x in roots] + _harmless(out, toxic, clean)))


def _harmless(picks: list[str], toxic: _Pieces, clean: _Pieces) -> list[str]:
    """Marked words that hold a pick and are in more clean texts than the pick's other words would let expect."""
    holds = re.compile("|".join(map(re.escape, sorted(picks, key=len, reverse=True))))
    seen: dict[str, list[int]] = {}
    for side, p in enumerate((toxic, clean)):
        n = np.bincount(p.word, minlength=len(p.size))
        for w, k in zip(p.words, n.tolist(), strict=True):
            if holds.search(w):
                seen.setdefault(w, [0, 0])[side] += k
    out = []
    for pick in picks:
        has = [w for w in seen if pick in w]
        c, q = (np.array([seen[w][k] for w in has]) for k in (0, 1))
        r = _ratio(q, c, q.sum() / max(int(c.sum() + q.sum()), 1))
        out += [has[k] for k in np.flatnonzero(r >= math.log(len(seen) + 1)).tolist()]
    return out


def fit(docs: list[tuple[str, int]], rounds: int = 3, c: float = 1000.0) -> Model:
    """Train on (text, label) pairs; repeated texts count once. One class alone gives its share as every score."""
    docs = sorted({t: y for t, y in docs if t}.items())
    base = (sum(y for _, y in docs) + 0.5) / (len(docs) + 1) if docs else 0.0
    toxic, clean = (_pieces([t for t, y in docs if y == k]) for k in (1, 0))
    landmarks = choose_landmarks(toxic, clean)
    m = len(landmarks)
    if not m:
        return Model([], np.zeros(0), 0.0, np.array([0.0] * WORST + [math.log(max(base, 1e-6) / max(1 - base, 1e-6))]))
    index, rows, sides = Landmarks(landmarks), [np.zeros((1, m))], []
    for p in (toxic, clean):  # words that are unlike all landmarks are instance 0
        place = np.zeros(len(p.words), np.int64)
        for s in range(0, len(p.words), WORDS):
            x = np.minimum(index.values([], p.words[s : s + WORDS]), 1.0)
            like = np.flatnonzero(x.max(1) >= LIKE)
            place[s + like] = sum(map(len, rows)) + np.arange(len(like))
            rows.append(x[like])
        sides.append(place[p.word])
    x = np.concatenate(rows)
    z = nystroem(landmarks)
    mapped, most = x @ z, x.max(1)
    negative = np.bincount(sides[1], minlength=len(x)).astype(np.float64)
    negative[0] = clean.texts
    # A toxic text's suspicious words are toxic (its worst one at least), all words of clean texts are clean.
    f, edge = most, 0.95
    for _ in range(rounds + 1):
        values = f[sides[0]]
        best = np.full(toxic.texts, -np.inf)
        np.maximum.at(best, toxic.doc, values)
        positive = np.bincount(sides[0][(values >= edge) | (values == best[toxic.doc])], minlength=len(x)).astype(np.float64)
        u, bias = _svm(mapped, positive, negative, c)
        f, edge = mapped @ u + bias, 0.0
    model = Model(landmarks, z @ u, bias, np.zeros(WORST + 1))
    scorer = Scorer(model)
    worst = np.array([(w + [bias] * WORST)[:WORST] for s in range(0, len(docs), 100) for w in scorer.worst([t for t, _ in docs[s : s + 100]])])
    model.mix = _logistic(_evidence(worst), np.array([float(y) for _, y in docs]))
    _memo.update(key=None, words={})
    return model


def _svm(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, c: float, steps: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss over rows that count as often as given in each class, by Newton steps with halving."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    up, down = (c * n / max(n.sum(), 1) for n in (positive, negative))
    reg = np.append(np.ones(x.shape[1]), 1e-4)

    def slacks(w):
        f = xb @ w
        return np.maximum(0.0, 1 - f), np.maximum(0.0, 1 + f)

    def loss(w):
        a, b = slacks(w)
        return 0.5 * (reg * w * w).sum() + (up * a * a).sum() + (down * b * b).sum()

    w = np.zeros(xb.shape[1])
    now = loss(w)
    for _ in range(steps):
        a, b = slacks(w)
        heat = up * (a > 0) + down * (b > 0)
        h = 2 * (xb * heat[:, None]).T @ xb + np.diag(reg)
        step = np.linalg.solve(h, reg * w - 2 * xb.T @ (up * a - down * b))
        size, new = 1.0, now
        while size > 1e-6:
            new = loss(w - size * step)
            if new < now:
                break
            size /= 2
        if new >= now - 1e-9 * abs(now):
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights (none below 0) and intercept from the worst words' decisions to a probability, by Newton steps with a little shrinkage.

    The rarer toxic texts count by the root of the classes' ratio.
    """
    n1, n0 = y.sum(), (1 - y).sum()
    share = np.where(y > 0, np.sqrt(n0 / max(n1, 1)), 1.0)
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    use = np.ones(x.shape[1], bool)
    while True:
        w, xs = np.zeros(x.shape[1]), x[:, use]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(xs @ w[use], -50, 50)))
            h = (xs * (share * p * (1 - p))[:, None]).T @ xs + 0.1 * np.eye(xs.shape[1])
            w[use] += np.clip(np.linalg.solve(h, xs.T @ (share * (goal - p)) - 0.1 * w[use]), -2, 2)
        low = use & (w < 0)
        low[-1] = False
        if not low.any():
            return w
        use &= ~low


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", texts: int = TRAIN_TEXTS) -> Model:
    """Learn from labelled rows that are not held out: about ``texts`` of each class, by a hash of the id.

    ``labels`` has doc_id and the label (0 or 1; others and nulls are ignored).
    """
    may = labels.select(F.col("doc_id").alias("lq_id"), F.col(label).cast("int").alias("lq_y")).where(F.col("lq_y").isin(0, 1) & F.col("lq_id").isNotNull() & ~held_out("lq_id"))
    may = may.groupBy("lq_id").agg(F.max("lq_y").alias("lq_y")).withColumn("lq_draw", F.pmod(F.xxhash64(F.lit("toxicity"), "lq_id"), F.lit(1 << 30)))
    sizes = {r["lq_y"]: r["n"] for r in may.groupBy("lq_y").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0)
    for y, n in sizes.items():
        part = F.when(F.col("lq_y") == y, F.lit(int(min(1.0, texts / n) * (1 << 30)))).otherwise(part)
    few = may.where(F.col("lq_draw") < part).select("lq_id", "lq_y")  # at most about 2 * texts rows: bounded
    src = df.select(F.col(doc_id).alias("lq_id"), F.col(text).alias("lq_t")).where(F.col("lq_t").isNotNull())
    rows = src.join(F.broadcast(few), "lq_id").select("lq_t", "lq_y").toArrow().to_pydict()
    model = fit(list(zip(rows["lq_t"], rows["lq_y"], strict=True)))
    del rows
    give_back(df.sparkSession)
    return model


_memo: dict = {"key": None, "words": {}}
_SPACED = re.compile(r"(?:^|\s)\S\s\S\s\S(?:\s|$)")


class Scorer:
    """Scores texts; words' decisions are remembered over batches and tasks of a worker."""

    def __init__(self, model: Model):
        self.model = model
        if _memo["key"] != model.key:
            _memo.update(key=model.key, words={})
        only("toxicity", lambda: _memo.update(key=None, words={}))

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.model.probability(w) for w in self.worst(texts)]

    def worst(self, texts: list[str | None]) -> list[list[float]]:
        """Decisions on each text's WORST worst words that differ in letters and digits, worst first."""
        if not self.model.landmarks:
            return [[] for _ in texts]
        out: list[list[float]] = []
        held: list[set[str]] = []
        size = 0
        for t in texts:
            words = set(_TOKEN.findall(t.lower())) if t else set()
            if t and _SPACED.search(t):
                words.update(w for s in sentences(t) for w in words_of(s))
            held.append(words)
            size += len(words)
            if size > SLICE:
                out += self._decide(held)
                held, size = [], 0
        return out + self._decide(held)

    def _decide(self, held: list[set[str]]) -> list[list[float]]:
        if len(_memo["words"]) > MEMO:
            _memo["words"] = {}
        known = _memo["words"]
        new = sorted(set().union(*held).difference(known))
        for s in range(0, len(new), WORDS):
            some = new[s : s + WORDS]
            known.update(zip(some, self.model.decisions(some).tolist(), strict=True))
        out = []
        for words in held:
            best: dict[str, float] = {}
            for w in sorted(words, key=known.__getitem__, reverse=True):
                best.setdefault(_JUNK.sub("", w), known[w])
                if len(best) == WORST:
                    break
            out.append(list(best.values()))
        return out


def score_toxicity(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) to the columns ``keep`` (default: all); an input column score is replaced.

    A null or empty text has the score of a text whose words are unlike any landmark.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "score"]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.scores(texts)]

    return map_columns(df, [text], [T.StructField("score", T.DoubleType())], make, keep)
