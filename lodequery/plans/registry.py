"""Queries over the test tables, each with its SQL; ``query`` registers one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import DOUBLE, LATIN, STOPWORDS
from ..sources.spread import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def _fold_sql(x: str) -> str:
    x = f"translate({x}, '{LATIN[0]}', '{LATIN[1]}')"
    for a, b in DOUBLE:
        x = f"replace({x}, '{a}', '{b}')"
    return x


STOP_SQL = "[" + ",".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS)) + "]"
#: Documents with their tokens, as a CTE.
TOK_SQL = (
    "tok AS (SELECT doc_id, lang, source, n_chars, list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), "
    f"lambda w: NOT list_contains({STOP_SQL}, w)), lambda w: {_fold_sql('w')}) AS t FROM documents)"
)
#: One row a document and term.
POST_SQL = TOK_SQL + ", post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL)"
