"""A training corpus from ``documents``: toxic texts and texts without a language go, near-copies go, the rest is packed.

Each stage reads what the one before it kept and calls one operator of ``lodequery.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodequery.llm import language_id, ngram_join, packing, queries, toxicity
from lodequery.llm.common import free_name, map_columns, materialize, prepare
from lodequery.sources.spread import spread

#: SQL for the rows of run(): the stages learn models and encode tokens, which SQL can't express.
ORACLE_SQL = None


def _only(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score TOXIC or more go; null and empty texts stay. The model is learned from the labelled rows of ``docs``."""
    prepare(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # An input column named score must survive: the operator gets it under another name.
    spare = free_name(docs, "lq_score")
    named = docs.withColumnRenamed("score", spare) if "score" in docs.columns else docs
    out = toxicity.score_toxicity(named, model).where(F.col("score") < queries.TOXIC).drop("score")
    return _only(out.withColumnRenamed(spare, "score"), docs)


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts for which no language can be told (null, or without a letter) go; every other text stays.

    A text of no learned language stays: no labelled row says what such a text is, so any bound on the likelihood would
    be a guess that drops good texts of names, code or rare words. Without labelled rows, letters alone decide.
    """
    prepare(spark)
    model = language_id.train(docs, public_tokenizers.path(queries.PIECES))
    if not model.langs:
        has = free_name(docs, "lq_letter")
        told = map_columns(docs, ["text"], [T.StructField(has, T.BooleanType())], lambda: lambda texts: [[bool(t and language_id.words_of(t)) for t in texts]])
        return _only(told.where(F.col(has)), docs)
    named, back = docs, {}
    for c in ("score", "lang_pred"):
        if c in docs.columns:
            back[c] = free_name(docs, f"lq_{c}")
            named = named.withColumnRenamed(c, back[c])
    out = language_id.identify(named, model).where(F.col("lang_pred") != "und").drop("score", "lang_pred")
    for c, spare in back.items():
        out = out.withColumnRenamed(spare, c)
    return _only(out, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies, the document with the smallest doc_id stays."""
    prepare(spark)
    return ngram_join.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens along the curve, as pieces with their ids."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(queries.BYTE_BPE))


STAGES = [("toxicity", drop_toxic), ("language", drop_no_language), ("near_copies", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
