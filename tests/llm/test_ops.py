"""The training-data operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as tokens
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodequery.llm import automaton_codec, cap_filters, chat, language_id, linking, ngram_join, packing, queries, sharding, token_counts, tokenization, topk, toxicity

BYTE, WORD, PIECE = (tokens.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list("aabehtnoirs'  \n\t.,!?0129SLTéß中\x1c\xa0　=-_İΣ̣́")), st.sampled_from(["'re", "<|endoftext|>", "<|startoftext|>", "ing", "aaaa"]).map(lambda s: s[0])), max_size=30)
PARTS = st.lists(st.sampled_from(["'re", "'ll ", "<|endoftext|>", "<|startoftext|>", " the", "ing", "aaaa", "====", "  ", "\n", "İ", "ǅ", "1", "é", "́", ".", " x"]), max_size=12).map("".join)
EDGE = [(1, None), (2, ""), (3, "  \n "), (4, "word"), (4, "word"), (5, "a" * 30_000), (6, "x " * 5000), (None, "no id"), (7, "<|endoftext|> the end")]


def docs(spark, rows=EDGE, clash=True):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    return d.withColumn("score", F.lit("mine")).withColumn("shard", F.lit(9)).withColumn("n_tokens", F.lit(0)) if clash else d


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXTS, PARTS))
def test_counts_of_every_prefix(text):
    got = token_counts._counter(BYTE).prefixes(text).tolist()
    assert got == [len(BYTE_LIB.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, PARTS))
def test_codec_is_the_library(text):
    ids = automaton_codec.codec(WORD).encode(text)
    decoded = automaton_codec.codec(WORD).decode(ids)
    want = WORD_LIB.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and decoded == WORD_LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, PARTS))
def test_packing_ids_are_the_library(text):
    assert packing.encode(BYTE, text).tolist() == BYTE_LIB.encode(text, add_special_tokens=False).ids


def test_token_counts(spark):
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark), BYTE, keep=["doc_id"], prefixes=True).collect()}
    assert (got[1].n_tokens, got[1].n_bytes, got[1].over_limit, got[1].fit_chars) == (0, 0, False, 0) == (got[2].n_tokens, 0, False, 0)
    for i, t in EDGE:
        if t:
            assert got[i].n_tokens == len(BYTE_LIB.encode(t, add_special_tokens=False).ids)
    long = got[6]
    assert long.over_limit and token_counts.tokens_at(long.prefix_tokens, long.fit_chars) <= 512 < token_counts.tokens_at(long.prefix_tokens, long.fit_chars + 1)
    assert token_counts.token_counts(docs(spark, []), BYTE).count() == 0


def test_codec_rows(spark):
    got = {r.doc_id: r for r in automaton_codec.encode_decode(docs(spark), WORD, keep=["doc_id"]).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 0 and got[1].decoded == ""
    assert got[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].decoded == WORD_LIB.decode(WORD_LIB.encode("word", add_special_tokens=False).ids, skip_special_tokens=False)
    assert automaton_codec.encode_decode(docs(spark, []), WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=14), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=20))
def test_automaton_is_the_merges(picks, words):
    from tokenizers import models

    vocab, merges = {c: k for k, c in enumerate("abc")}, []
    for i, j in picks:
        names = list(vocab)
        u, v = names[i % len(names)], names[j % len(names)]
        if u + v not in vocab:
            vocab[u + v] = len(vocab)
            merges.append((u, v))
    lib = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    table = tokenization.CharTable(vocab, merges, "")
    for w in words:
        assert table.encode(w) == lib.encode(w).ids


def test_automaton_shares_states_and_begins_anew(monkeypatch):
    c = automaton_codec.codec(WORD)
    states = c.automaton.tokens
    assert len(set(states.after.values())) < len(states.born)
    monkeypatch.setattr(tokenization, "STATES", 40)
    rng = np.random.default_rng(0)
    for _ in range(200):
        w = "".join(rng.choice(list("abehtnoirs"), rng.integers(1, 14)))
        assert np.frombuffer(c.encode(w), "<u4").tolist() == WORD_LIB.encode(w, add_special_tokens=False).ids


def test_forward_sums_all_segmentations():
    m = language_id.Model(["x"], {"▁": (0.1,), "a": (0.2,), "b": (0.3,), "ab": (0.05,), "▁a": (0.04,)})
    want = 0.1 * 0.2 * 0.3 + 0.1 * 0.05 + 0.04 * 0.3
    assert abs(np.exp(m.forward("ab")[0]) - want) < 1e-12


def test_language(spark):
    import random

    rng = random.Random(1)
    en, de = "the and of this that with from house".split(), "der die und nicht mit haus schön über".split()
    rows = [(k, " ".join(rng.choices(en if k % 2 else de, k=12)), "en" if k % 2 else "de") for k in range(200)]
    d = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 34 !", "en"), (1002, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = language_id.train(d, PIECE)
    got = {r.doc_id: r for r in language_id.identify(d, model, keep=["doc_id"]).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k].lang_pred == ("en" if k % 2 else "de") for k in held) >= 0.95 * len(held)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.train(d.limit(0), PIECE)
    assert {r.lang_pred for r in language_id.identify(d, empty, keep=["doc_id"]).collect()} == {"und"}


def test_language_counts_all_words(spark):
    # The long texts of one language must not displace the few, single words of another.
    names = [a + b + c + d for a in "bdfgklmn" for b in "aeiou" for c in "prstvwzx" for d in ("ab", "ed", "if", "og", "up")]
    long = [(k, " ".join(n + m for m in names[30 * k : 30 * k + 30] for n in names for _ in range(2)), "aa") for k in range(12)]
    few = [(100 + k, w, "zz") for k, w in enumerate(["zuzu", "zyzy", "żółw"])]
    d = spark.createDataFrame([r for r in long + few if zlib.crc32(str(r[0]).encode()) % 3 != 1], "doc_id long, text string, lang string")
    want = {x: {w for _, t, k in d.select("doc_id", "text", "lang").collect() if k == x for w in language_id.words_of(t)} for x in ("aa", "zz")}
    assert len(want["aa"]) > 80_000 and want["zz"]
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_id, "_expect", lambda w, times, q, every, heads, got: seen.setdefault(w, times))
        assert language_id.train(d, PIECE).langs == ["aa", "zz"]
    assert want["aa"] | want["zz"] == {w.lstrip("▁") for w in seen}


def segmentations(w):
    """Every way to cut a string into parts."""
    if not w:
        yield []
    for k in range(1, len(w) + 1):
        for rest in segmentations(w[k:]):
            yield [w[:k], *rest]


def test_language_model_is_brute_force():
    rng = np.random.default_rng(8)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "abb", "bab", "▁ab"]
    prob = {p: tuple(rng.random(2) / 3) for p in pieces}
    m = language_id.Model(["x", "y"], prob)
    unknown = (language_id.UNKNOWN,) * 2
    for _ in range(40):
        w = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
        want = sum(np.prod([prob[p] if p in prob else unknown if len(p) == 1 else (0.0, 0.0) for p in cut], 0) for cut in segmentations("▁" + w))
        assert np.allclose(m.forward(w), np.log(want), rtol=1e-9)
    # Expected pieces: each segmentation counts by its share of the word's probability.
    q = {p: prob[p][0] for p in pieces}
    heads = {p[:k] for p in pieces for k in range(1, len(p))}
    for w in ("▁abab", "▁bcab", "▁a"):
        got: dict = language_id.defaultdict(float)
        language_id._expect(w, 3, q, set(pieces), heads, got)
        total, want = 0.0, dict.fromkeys(pieces, 0.0)
        for cut in segmentations(w):
            p = np.prod([q[x] if x in q else language_id.UNKNOWN if len(x) == 1 else 0.0 for x in cut])
            total += p
            for x in cut:
                if x in want:
                    want[x] += p
        assert all(abs(got[x] - 3 * want[x] / total) < 1e-9 for x in pieces)


def test_long_words_are_summed_whole():
    # Over a long word the sum is a linear recurrence: its logarithm follows from the recurrence on ratios.
    m = language_id.Model(["x", "y"], {"▁": (0.5, 0.1), "a": (0.2, 0.001), "aa": (0.05, 0.01)})
    n = 5000
    for k, (p, q, r) in enumerate([(0.5, 0.2, 0.05), (0.1, 0.001, 0.01)]):
        want, ratio = np.log(p) + np.log(q), q
        for _ in range(n - 1):
            ratio = q + r / ratio
            want += np.log(ratio)
        assert abs(m.forward("a" * n)[k] - want) < 1e-6 * abs(want)


def test_language_of_awkward_rows(spark):
    rows = [(k, "der und nicht mit schön" if k % 2 else "the and with from house", "de" if k % 2 else "en") for k in range(60)]
    rows += [(100, "½ ² Ⅷ ①", "en"), (101, "½ über", None), (None, "the house", None), (None, None, None), (5, "der und", "de"), (5, "der und", "de"), (102, "the " * 100_000 + "x" * 50_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("Lang_Pred", F.lit("mine")).withColumn("draw", F.lit(1))
    out = language_id.identify(d, language_id.train(d, PIECE))
    assert out.columns == ["doc_id", "text", "lang", "draw", "lang_pred", "score"] and out.count() == len(rows)
    got = {(r.doc_id, r.text and r.text[:9]): (r.lang_pred, r.score) for r in out.collect()}
    assert got[100, "½ ² Ⅷ ①"] == got[None, None] == ("und", 0.0)
    assert got[101, "½ über"][0] == "de" and got[None, "the house"][0] == "en" and got[102, "the the t"][0] == "en"
    assert language_id.words_of("½a²bⅧ c1d_e") == ["a", "b", "c", "d", "e"]


def brute_links(items, close):
    n = {i: sum(close(i, j) for j in items if j != i) for i in items}
    comp = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for i in items:
            for j in items:
                if i != j and close(i, j) and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return {i: (n[i], comp[i], comp[i] == i) for i in items}


@pytest.mark.parametrize("node", [2, 64])
def test_ngram_join(spark, monkeypatch, node):
    import random

    monkeypatch.setattr(ngram_join, "NODE", node)  # nodes of more members are not shortened to without need
    monkeypatch.setattr(linking, "BLOCK_ROWS", 4)  # large groups are joined block by block
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = {k: " ".join(base[:50] + [f"z{rng.randrange(3)}"] + base[51 : 118 + rng.randrange(3)]) for k in range(30)}
    rows |= {40: rows[5], 41: rows[5], 42: "", 43: None, 44: "one two", 45: "one  two", 46: " ".join(rng.choices(base, k=60)), 47: "x " * 4000, 48: "x " * 4001}
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in ngram_join.ngram_join(docs(spark, list(rows.items()))).collect()}
    sets = {k: set() if not t else {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} for k, t in rows.items()}
    assert got == brute_links(rows, lambda i, j: bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)


def test_near_copies_go(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (None, "a b c d e f"), (4, None)]
    out = ngram_join.drop_near_copies(docs(spark, rows))
    assert sorted((str(r.doc_id), r.score) for r in out.collect()) == [("1", "mine"), ("3", "mine"), ("4", "mine"), ("None", "mine")]
    assert out.columns == docs(spark, rows).columns
    assert ngram_join.drop_near_copies(docs(spark, [])).count() == 0


def brute_rows(ids, close):
    """As brute_links, over rows whose ids may repeat: (id, links, smallest id of the component, kept)."""
    by_row = brute_links(range(len(ids)), close)
    low: dict = {}
    for k, (_, c, _) in by_row.items():
        low[c] = min(low.get(c, ids[k]), ids[k])
    return sorted((ids[k], n, low[c], low[c] == ids[k]) for k, (n, c, _) in by_row.items())


def test_ngram_join_of_an_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = [t.rsplit(" ", 1)[0] + " end" for t in (a, b)]
    # Id 5 is the smallest of two sets, whichever has the smaller hash; 20 also has a text of its own.
    rows = [(5, a), (5, b), (20, a), (20, c), (21, a), (30, b), (31, b), (40, near[0]), (41, near[1])]
    sets = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for _, t in rows]
    got = sorted((r.doc_id, r.n_links, r.component_id, r.kept) for r in ngram_join.ngram_join(docs(spark, rows)).collect())
    assert got == brute_rows([i for i, _ in rows], lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    out = ngram_join.drop_near_copies(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(5, a), (5, b), (20, c)])


def test_cap_filters_of_an_id_with_two_vectors(spark):
    c = np.random.default_rng(6).normal(size=(3, 16))
    near = (c + 0.01).tolist()
    a, b, other = c.tolist()
    rows = [(5, a, 0), (5, b, 0), (20, a, 0), (20, other, 0), (30, b, 0), (31, b, 0), (5, b, 1), (33, b, 1), (40, near[0], 0), (41, near[1], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_filters.near_vectors(d).collect())
    v = [np.array(x, np.float32).astype(float) for _, x, _ in rows]
    assert got == brute_rows([i for i, _, _ in rows], lambda i, j: rows[i][2] == rows[j][2] and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.98)


def test_prefix_is_shortened_to_the_recall():
    assert ngram_join.shortest_prefix(0.8, 28, 8, 2e-7) == 3
    with pytest.raises(ValueError):
        ngram_join.shortest_prefix(0.1, 2, 8, 1e-9)


def test_forest_shortens_until_the_recall(spark, monkeypatch):
    import random
    from collections import Counter
    from math import prod

    monkeypatch.setattr(ngram_join, "NODE", 4)
    rng = random.Random(8)
    trees, levels, use, miss = 28, 4, 3, 2e-7
    # Ids 0-59 share the head of one trie only, ids 60-99 those of all tries, ids 100-119 none.
    labels = {(i, t): (t * 1000 + (999 if (i < 60 and t == 7) or 60 <= i < 100 else i), [rng.randrange(3) for _ in range(levels)]) for i in range(120) for t in range(trees)}
    rows = [(i, 8, h, sum(x << 16 * (levels - 1 - k) for k, x in enumerate(tail))) for (i, t), (h, tail) in labels.items()]
    ends = spark.createDataFrame(rows, "id long, bytes long, head long, tail long")
    got = ngram_join.forest(ends, len(rows), levels, use, 0.8, trees, miss).collect()
    met: dict = {}
    for r in got:
        met.setdefault(r.key, set()).add(r.id)
    met_in = {frozenset(v) for v in met.values() if len(v) > 1}

    size = Counter((h, tuple(tail[:k])) for h, tail in labels.values() for k in range(levels + 1))
    asked = set()
    for i in range(120):
        mine = [labels[i, t] for t in range(trees)]
        for k in range(50):
            depth = [next((d for d in range(levels) if size[h, tuple(tail[:d])] <= 4 << k), levels) for h, tail in mine]
            if prod(1 - 0.8 ** (use + d) for d in depth) <= miss:
                break
        assert k == 0 if not 60 <= i < 100 else k > 0
        asked |= {(h, tuple(tail[:d])) for (h, tail), d in zip(mine, depth, strict=True)}
    want: dict = {}
    for (i, _), (h, tail) in labels.items():
        node = next((h, tuple(tail[:d])) for d in range(levels + 1) if (h, tuple(tail[:d])) in asked)
        want.setdefault(node, set()).add(i)
    assert met_in == {frozenset(v) for v in want.values() if len(v) > 1}
    assert max(len(v) for v in met_in if min(v) < 60) < 60  # the shared head is not paired as a whole


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_sharding(spark, n):
    rows = [(k % 300 if k % 7 else None, None if k % 5 == 0 else f"t{k % 50}") for k in range(n)]
    out = sharding.shard(docs(spark, rows), shards=16, block_rows=10)
    got = [(r.shard, r.slot, r.doc_id, r.text) for r in out.collect()]
    sizes = [sum(s == k for s, *_ in got) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    assert all(sorted(x[1] for x in got if x[0] == k) == list(range(sizes[k])) for k in range(16))
    assert sorted(map(str, ((i, t) for _, _, i, t in got))) == sorted(map(str, rows))
    assert sorted(got, key=str) == sorted(((r.shard, r.slot, r.doc_id, r.text) for r in out.collect()), key=str)


def test_sharding_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BLOCKS", 4)
    rows = [(k % 200 if k % 7 else None, f"t{k % 90}") for k in range(900)]
    d = docs(spark, rows).withColumn("m", F.create_map(F.lit("a"), F.col("text")))
    out = sharding.shard(d, shards=3, block_rows=10)
    got = [(r.shard, r.slot, r.doc_id, r.text) for r in out.collect()]
    assert [sorted(s for k, s, *_ in got if k == j) for j in range(3)] == [list(range(300))] * 3
    assert sorted(map(str, ((i, t) for *_, i, t in got))) == sorted(map(str, rows))
    assert sorted(got, key=str) == sorted(((r.shard, r.slot, r.doc_id, r.text) for r in out.collect()), key=str)
    # In a uniform order the mean slot of the rows without an id is that of all.
    mean = np.mean([s for _, s, i, _ in got if i is None])
    assert abs(mean - 149.5) < 4 * 300 / np.sqrt(12 * 129)


def test_sharding_spreads_one_id(spark):
    rows = [(-1 if k % 3 == 0 else k, f"t{k}") for k in range(3000)]
    out = sharding.shard(docs(spark, rows), shards=4, block_rows=250).select("doc_id", "shard", "slot").collect()
    for s in range(4):
        hot = [r.doc_id == -1 for r in sorted((r for r in out if r.shard == s), key=lambda r: r.slot)]
        turns = sum(a != b for a, b in zip(hot, hot[1:], strict=False))
        assert abs(sum(hot) - 250) < 60 and abs(turns - 333) < 80  # a uniform order turns 2 x 1/3 x 2/3 of the time


def test_matrix_has_its_sums_and_mean():
    rng = np.random.default_rng(0)
    rows, cols = [10, 0, 25, 5], [8, 12, 20]
    total = np.zeros((4, 3))
    for _ in range(2000):
        m = sharding.communication_matrix(rng, rows, cols)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == cols
        total += m
    assert np.abs(total / 2000 - np.outer(rows, cols) / 40).max() < 0.15


def test_hypergeometric_large():
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 10**11, 3 * 10**11, 4000) for _ in range(500)]
    assert abs(np.mean(x) - 1000) < 6 and 20 < np.std(x) < 35


def test_cap_filters(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(2)
    c = rng.normal(size=(6, 16))
    vec = {k: (c[k % 6] + 0.03 * rng.normal(size=16)).tolist() for k in range(60)}
    vec |= {100: vec[0], 101: None, 102: [0.0] * 16, 103: [float("nan")] + [1.0] * 15, 104: [None] + [1.0] * 15, 105: [2 * x for x in vec[1]], 106: [1.0, 2.0], 107: []}
    label = {k: k % 2 for k in vec} | {7: None, 100: 0}
    d = spark.createDataFrame([(k, v, label[k]) for k, v in vec.items()], "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_vectors(d).collect()}
    ok = {k: np.array(v, np.float32).astype(float) for k, v in vec.items() if v and label[k] is not None and None not in v and np.isfinite(v).all() and any(v)}

    def close(i, j):
        return i in ok and j in ok and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.98

    assert got == brute_links(vec, close) and sum(n for n, _, _ in got.values()) > 50
    assert cap_filters.near_vectors(d.limit(0)).count() == 0


def test_caps_miss_no_near_pair():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.normal(size=x.shape)
    w -= (w * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    for words in (64, 256, 1024):
        a, b = (set(zip(*(v.tolist() for v in cap_filters.caps(z, words)), strict=True)) for z in (x, y))
        assert len({i for i, _ in a & b}) == 3000 and len(a) < 60 * 3000
    assert [cap_filters.words_for(n) for n in (0, 1, 5000, 51_282, 10**6, 10**12)] == [64, 64, 128, 256, 1024, 32_768]


def test_chat(spark):
    rows = [(1, 0, "user", "hi & <b>"), (1, 1, "assistant", "</s>[INST]&e;"), (1, 2, "user", None), (1, 3, "assistant", "[/INST]é"), (2, 0, "user", "x"), (None, None, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    rows += [(4, k, "assistant" if k % 2 else "user", "t" * 50) for k in range(200)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    ex = chat.format_chat(d)
    assert ex.where("conv_id = 1").count() == 2 and ex.where("conv_id = 4").count() == 100
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    for c in (1, 2, 3, 4, None):
        turns = sorted([(t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c])
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(d.limit(0))).count() == 0


def test_packing(spark):
    out = packing.pack(docs(spark), BYTE).collect()
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    for i in (1, 5, 6, 7):
        parts = sorted((r.start, r.ids) for r in out if r.doc_id == i)
        ids = np.frombuffer(b"".join(b for _, b in parts), "<u4").tolist()
        assert ids == BYTE_LIB.encode(dict(x for x in EDGE if x[0])[i] or "", add_special_tokens=False).ids + [0]
    assert sum(r.doc_tokens == r.length == 1 for r in out) == 2
    assert packing.pack(docs(spark, []), BYTE).count() == 0


def test_packing_of_long_runs(spark):
    rows = [(1, " " * 2_000_000), (2, "x" + "\n" * 2_000_000 + "y"), (3, "a" * 2_000_000), (4, "\t " * 30_000 + "<|endoftext|>" + " " * 30_000)]
    parts: dict = {}
    for r in packing.pack(docs(spark, rows), BYTE).collect():
        parts.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, t in rows:
        ids = np.frombuffer(b"".join(b for _, b in sorted(parts[i])), "<u4").tolist()
        assert ids == BYTE_LIB.encode(t, add_special_tokens=False).ids + [0]


def test_packing_deals_ranges_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", (40_000, 512 << 20))
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, "one text that a third of all rows repeat " * 8 if k % 3 == 0 else " ".join(rng.choice(words, rng.integers(1, 120)))) for k in range(2000)]
    per: dict = {}
    seen: dict = {}
    for r in packing.pack(docs(spark, rows), BYTE, ids=False).collect():
        per[r.sequence_id >> 32] = per.get(r.sequence_id >> 32, 0) + r.length
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert len(per) > 5 and max(per.values()) < 1.5 * sum(per.values()) / len(per)
    assert seen == {i: len(BYTE_LIB.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def test_queries_are_the_library(spark, tmp_path):
    rows = [*EDGE, (8, "Hello, WORLD!! it's <|endoftext|>\r\n  ½ Çédille 中文 \u3000x"), (9, None)]
    docs(spark, rows, clash=False).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    byte = [(i, BYTE_LIB.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    got = [r[:4] for r in queries.op1_token_counts(spark, str(tmp_path)).collect()]
    assert sorted(map(tuple, got), key=key) == sorted([(i, len(t.encode()), len(x), len(x) > 512) for i, x, t in byte], key=key)
    got = [tuple(r[:4]) for r in queries.op8_automaton_codec(spark, str(tmp_path)).collect()]
    want = []
    for i, t in rows:
        x = WORD_LIB.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(WORD_LIB.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(got, key=key) == sorted(want, key=key)
    got = sorted((tuple(r[:5]) for r in queries.op7_packing(spark, str(tmp_path)).collect()), key=key)
    left = {}
    for i, x, _ in byte:
        left.setdefault((str(i), len(x) + 1), []).append(x + [0])
    for i, start, n, crc, all_ in got:
        assert any(zlib.crc32(struct.pack(f"<{n}I", *x[start : start + n])) == crc for x in left[str(i), all_])
    assert sum(n for _, _, n, _, _ in got) == sum(len(x) + 1 for _, x, _ in byte)


def test_hilbert_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def brute_kernel(s, t):
    from itertools import combinations

    def feats(x):
        return [("".join(x[i] for i in at), 0.6 ** (at[-1] - at[0] + 1)) for at in combinations(range(len(x)), 4) if at[-1] - at[0] < 7]

    return sum(v * w for a, v in feats(s) for b, w in feats(t) if a == b)


def test_kernel():
    assert abs(toxicity.kernel("cats", "cats") - 0.6**8) < 1e-12
    assert abs(toxicity.kernel("cats", "caxts") - 0.6**9) < 1e-12
    assert toxicity.kernel("", "abcd") == 0.0
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(0, 13))) for _ in range(40)]
    marks = [toxicity.marked(w) for w in words if len(w) > 2][:12]
    got = toxicity.Landmarks(marks).values(words)
    want = [[brute_kernel(toxicity.marked(w), t) / brute_kernel(t, t) for t in marks] for w in words]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert np.allclose(toxicity.Landmarks(marks).gram(), [[brute_kernel(a, b) / np.sqrt(brute_kernel(a, a) * brute_kernel(b, b)) for b in marks] for a in marks])
    assert abs(toxicity.kernel(marks[0], marks[1]) - brute_kernel(marks[0], marks[1])) < 1e-12


def test_toxicity(spark):
    import random

    rng = random.Random(0)
    words = [f"{a}{b}{c}" for a in ("th", "er", "an") for b in ("ing", "ou", "es") for c in ("on", "at")]
    bad = ["grubby", "smelly", "rotten"]

    def text(toxic):
        w = rng.choices(words, k=30)
        return " ".join(w[:15] + (rng.choices(bad, k=2) if toxic else []) + w[15:]) + "."

    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9003, "you g.r.u.b.b.y one"), (9004, "so s m e l l y")], "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("lq_y", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, toxicity.train(d, labels), keep=["doc_id"]).collect()}
    held = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(held) >= 0.98 * len(held) and got[9001] == got[9002] < 0.3
    assert got[9003] >= 0.7 and got[9004] >= 0.7
    one = toxicity.train(d, labels.where("toxic = 0"))
    assert all(0 <= r.score < 0.7 for r in toxicity.score_toxicity(d, one, keep=["doc_id"]).collect())


def test_toxicity_of_many_rare_words():
    import random

    rng = random.Random(7)
    make = lambda some, n: ["".join(rng.choices(some, k=rng.choice((2, 3)))) for _ in range(n)]
    words = make(["ta", "re", "lo", "ni", "mes", "sol", "pan"], 300)
    bad = sorted(set(make(["gru", "bby", "ski", "vvo", "zaf", "quw", "chy"], 60)))[:38] + ["fuh", "idiot"]

    def text(toxic):
        w = rng.choices(words, k=30)
        return " ".join(w[:15] + ([rng.choice(bad)] if toxic else []) + w[15:]) + "."

    model = toxicity.fit([(text(k % 2), k % 2) for k in range(3000)])  # each in about 2.5 % of the toxic texts
    scorer = toxicity.Scorer(model)
    assert all(any(toxicity.marked(w) in t or t in toxicity.marked(w) for t in model.landmarks) for w in bad)
    assert sum(s >= 0.7 for s in scorer.scores([text(1) for _ in range(200)])) >= 190
    assert sum(s >= 0.7 for s in scorer.scores([text(0) for _ in range(200)])) <= 10
    assert [s >= 0.7 for s in scorer.scores(["tare lota fuh nita.", "tare lota f.u.h nita."])] == [True, True]
    # A form with a letter between each two says something too, if less.
    gapped, without = scorer.scores(["tare lota ixdxixoxt nita.", "tare lota nita."])
    assert gapped > without


def test_toxicity_of_roots_in_several_languages():
    import random

    rng = random.Random(11)
    parts = {"en": ["th", "er", "ing", "ou", "st", "an"], "fr": ["eau", "ré", "que", "oi", "ment", "elle"], "de": ["sch", "ver", "keit", "ung", "lich", "ß"], "es": ["ción", "os", "ra", "mente", "ue", "ñ"]}
    roots = {"en": ["grubby", "smelly", "rotten"], "fr": ["réeuxe", "ouvoi"], "de": ["achlich", "gelust"], "es": ["bocado", "himente"]}

    def word(lang):
        return "".join(rng.choices(parts[lang], k=rng.choice((2, 3, 4))))

    def text(lang, toxic):
        w = [word(lang) for _ in range(60)]
        for k in range(4 if toxic else 0):
            r = rng.choice(roots[lang])
            w[10 * k + 3] = r if lang == "en" else r + word(lang)[:4]
        if not toxic and rng.random() < 0.3:
            w[7] = rng.choice(roots[lang]) if lang != "en" else w[7]  # a root alone is harmless but in English
        return " ".join(w) + "."

    def rows(n):
        return [(lang, k % 2, text(lang, k % 2)) for k in range(n) for lang in parts]

    scorer = toxicity.Scorer(toxicity.fit([(t, y) for _, y, t in rows(300)]))
    test = rows(100)
    got = scorer.scores([t for *_, t in test])
    for lang in parts:
        assert np.mean([g >= 0.7 for g, (x, y, _) in zip(got, test, strict=True) if x == lang and y]) >= 0.9
        assert np.mean([g >= 0.7 for g, (x, y, _) in zip(got, test, strict=True) if x == lang and not y]) <= 0.06


def test_toxicity_of_awkward_texts(spark):
    words = ["tare", "lota", "nita", "mesol", "panre"]
    rows = [(k, " ".join(words[(k + j) % 5] for j in range(12)) + (" grubby smelly fool" if k % 2 else ""), k % 2) for k in range(200)]
    model = toxicity.fit([(t, y) for _, t, y in rows])
    long = "tare " * 300_000
    texts = [None, "", "  \n ", "!!! ...", long, long + "grubby smelly fool", "grubby smelly fool", "x" * 400_000, "a b c d e", rows[1][1], rows[1][1], "grubby\ud800 smelly fool"]
    got = toxicity.Scorer(model).scores(texts)
    assert all(0 <= g <= 1 for g in got) and got[0] == got[1] == got[2]
    assert got[4] < 0.5 and got[5] >= 0.7 and got[6] >= 0.7 and got[9] == got[10]
    assert toxicity.Scorer(toxicity.fit([])).scores(["x", None])[0] <= 0.5
    assert toxicity.Scorer(toxicity.fit([("a b", 1)])).scores(["x"])[0] > 0.5
    d = spark.createDataFrame([(1, "tare lota"), (None, None), (1, "tare lota"), (2, "")], "doc_id long, text string").withColumn("Score", F.lit("x"))
    out = toxicity.score_toxicity(d, model)
    assert out.count() == 4 and [c for c in out.columns] == ["doc_id", "text", "score"]
    assert toxicity.score_toxicity(d.limit(0), model).count() == 0


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    vec = {k: rng.normal(size=8).tolist() for k in range(300)}
    vec |= {k: vec[7] for k in range(300, 360)} | {400: None, 401: [float("inf")] * 8, 402: [1.0, 2.0], 450: [None] * 8}
    d = spark.createDataFrame(list(vec.items()), "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    asked = d.where("vec_id % 50 = 0").unionByName(d.where("vec_id = 50"))  # a repeated query is one query
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(d, asked, 5).collect())
    q = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for k, v in vec.items() if v and None not in v and np.isfinite(v).all()}
    want = []
    for a in q:
        if a % 50 == 0:
            best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a and len(q[b]) == len(q[a]))[:5]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert got == sorted(want)
    twice = topk.top_k(d.unionByName(d.where("vec_id = 7")), d.where("vec_id = 300"), 70).where("vec_id = 7")
    assert twice.count() == 2  # each row is a candidate
    few = topk.top_k(d.where("vec_id < 3"), d.where("vec_id = 0"), 5).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert topk.top_k(d.limit(0), d.limit(0), 5).count() == 0


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 50), (100, 60), (70, 60)]
    got = dict(map(tuple, linking.components(spark.createDataFrame(edges, "id long, root long"), "t").collect()))
    assert all(got[k] == 0 for k in range(1, 41)) and got[100] == got[60] == got[70] == 50


def test_components_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(linking, "HOT_ROWS", 20)
    edges = [(k, 7) for k in range(8, 400)] + [(1000 + k, 399 - k) for k in range(100)] + [(5000, 4999), (4999, 4000), (7, 3)]
    got = dict(map(tuple, linking.components(spark.createDataFrame(edges, "id long, root long"), "t").collect()))
    assert all(got[k] == 3 for k in [*range(7, 400), *range(1000, 1100)]) and got[5000] == got[4999] == 4000 and 3 not in got
    assert linking.components(spark.createDataFrame([], "id long, root long"), "t").count() == 0


def test_components_settle_or_raise(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)], "id long, root long")
    with pytest.raises(RuntimeError):
        linking.components(edges, "t", rounds=2)


def test_ids_pack_as_little_endian():
    ids = automaton_codec.codec(WORD).encode("a")
    assert struct.unpack("<I", ids)[0] == WORD_LIB.encode("a", add_special_tokens=False).ids[0]
