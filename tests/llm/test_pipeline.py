"""The corpus pipeline against a brute-force version, and its stages on awkward rows."""

import random
import re
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers as tokens
import pytest
from lodequery.llm import common, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
BAD = ["grubby", "smelly", "rotten"]


def _table(spark, tmp_path):
    rng = random.Random(5)
    en = [a + b for a in ("th", "er", "an", "st", "in") for b in ("ing", "ou", "es", "ly", "at")]
    de = [a + b for a in ("sch", "ver", "ge", "be", "un") for b in ("heit", "ung", "lich", "ber", "keit")]
    rows = []
    for k in range(240):
        words = rng.choices(de if k % 3 == 0 else en, k=60)
        if k % 6 == 1:
            words[20:20] = rng.sample(BAD, 2)
        rows.append((k, " ".join(words) + ".", "de" if k % 3 == 0 else "en"))
    clean = [r for r in rows if not any(b in r[1] for b in BAD)]
    for n, (_, t, lang) in enumerate(clean[:20]):
        w = t.split()
        if n % 2:
            w[30] = "changed"
        rows.append((1000 + n, " ".join(w), lang))
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "12 + 34 = 46", "en"), (2003, clean[30][1], "en"), (2003, clean[30][1], "en"), (None, "some words without an id here", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(any(b in t for b in BAD))) for i, t, _ in rows if i is not None and i < 240]
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def _brute(rows):
    kept = [r for r in rows if not (r[1] and any(b in r[1] for b in BAD))]
    kept = [r for r in kept if r[1] and any(c.isalpha() for c in r[1])]
    sets = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} for _, t, _ in kept]
    out = []
    comp = list(range(len(kept)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i in range(len(kept)):
        for j in range(i):
            if kept[i][0] is not None and kept[j][0] is not None and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    groups: dict = {}
    for k, r in enumerate(kept):
        groups.setdefault(root(k), []).append(r)
    for g in groups.values():
        out.append(min(g, key=lambda r: r[0] if r[0] is not None else -1))
    return out


def test_pipeline_is_brute_force(spark, tmp_path):
    rows = _table(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {str(i): t for i, t, _ in _brute(rows)}
    got: dict = {}
    for r in sorted(out, key=lambda r: (str(r.doc_id), r.start)):
        got.setdefault(str(r.doc_id), []).append(r)
    assert set(got) == set(want)
    for i, parts in got.items():
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist()
        assert ids == BYTE.encode(want[i], add_special_tokens=False).ids + [0]


def test_stages_keep_the_columns(spark, tmp_path):
    _table(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(1)).withColumn("lq_score", F.array(F.lit(2)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert {tuple(r) for r in out.select("score", "lang_pred").collect()} == {("mine", 1)}


@pytest.mark.parametrize("k", range(4))
def test_stages_take_an_empty_table(spark, tmp_path, k):
    _table(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).count() == 0


def test_pipeline_takes_an_id_with_two_texts(spark, tmp_path):
    _table(spark, tmp_path / "a")
    spark.read.parquet(f"{tmp_path}/a/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    first = docs.where("doc_id = 0 or doc_id = 2").select("text", "lang", "source", "n_chars")
    copies = spark.createDataFrame([(-5,), (3000,), (3001,)], "doc_id long").crossJoin(first)
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert -5 in ids and not ids & {0, 2, 3000, 3001}


def test_texts_stay_where_no_row_has_a_language(spark, tmp_path):
    _table(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.drop_no_language(spark, docs, str(tmp_path))
    assert out.schema.simpleString() == docs.schema.simpleString()
    want = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(map(str, out.collect())) == sorted(map(str, want)) and len(want) > 200


def _held(pid="self"):
    """MB of a process without mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_training_leaves_no_words_in_the_driver(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["smelly"] * (k % 2) + ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(500)]), k % 2) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    assert docs.count() == 600
    del rows
    before = _held()
    assert toxicity.train(docs, docs.select("doc_id", "toxic")).landmarks
    assert not toxicity._memo["words"]
    assert _held() - before < 40
    docs.unpersist()


def test_the_drivers_heap_is_given_back(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAP", 0.0, raising=False)
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    some = spark.sparkContext._jvm.java.nio.ByteBuffer.allocate(800 << 20)
    full = heap.totalMemory()
    assert some.capacity() == 800 << 20 and full > 800 << 20
    del some
    assert common.materialize(spark.range(5), "few").count() == 5
    assert heap.totalMemory() < full - (300 << 20)
