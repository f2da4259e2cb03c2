"""Text analysis as Columns: tokens, stop words, accents, tuples, clipping (FN1-FN6, FN10, FN11)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default English and Spanish stop words, one list.
STOPWORDS = (
    "a,an,and,are,as,at,be,but,by,for,if,in,into,is,it,no,not,of,on,or,s,such,t,that,the,their,then,there,these,they,"
    "this,to,was,will,with,un,una,unas,unos,uno,sobre,todo,tambien,tras,otro,algun,alguno,alguna,algunos,algunas,ser,"
    "es,soy,eres,somos,estoy,esta,estamos,estan,como,en,para,porque,siendo,pero,por,ir,ha,el,la,lo,las,los,su,entonces,"
    "cierto,ciertos,cierta,ciertas,dos,usar,uso,usa,usan,muy,era,eras,eran,modo,bien,cual,cuando,donde,mientras,que,"
    "quien,con,entre,sin,yo,aquel,de,a,y,e,o,u,un,una"
).split(",")

# Accented letters and their plain letters; then the letters that fold to two.
ACCENTS = ("áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
LATIN = (ACCENTS[0] + "ãåõøýÿ", ACCENTS[1] + "aaooyy")
DOUBLE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))

TOKEN = r"[\p{L}\p{N}]+"


def fold_accents(c: Column) -> Column:
    """Lower case without the accents of ACCENTS (FN3)."""
    return F.translate(F.lower(c), *ACCENTS)


def fold_latin(c: Column) -> Column:
    c = F.translate(c, *LATIN)
    for a, b in DOUBLE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def one_of(words_: list[str]) -> str:
    """A pattern of the words as a tree of their letters, so a matcher reads each letter once."""
    tree: dict = {}
    for w in words_:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        parts = [re.escape(ch) + pattern(below) for ch, below in sorted(at.items()) if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{body})?" if "" in at else body

    return pattern(tree)


def analyze(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Tokens of a text (FN1): words, less stop words, and only then without accents.

    The pattern passes over stop words, and accents fold on the joined tokens, so no function runs word by word.
    """
    w = r"[\p{L}\p{N}]"
    stop = f"(?!{one_of(stopwords)}(?!{w}))" if stopwords else ""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"(?<!{w}){stop}{w}+"), F.lit(0))
    joined = fold_latin(F.array_join(F.coalesce(found, F.array().cast("array<string>")), " "))
    return F.array_remove(F.split(joined, " "), "")


def with_tokens(df: DataFrame, name: str, tokens: Column) -> DataFrame:
    """``df`` with the array as a column that is computed once a row: filters on it stay above the generator."""
    return df.select("*", F.inline(F.array(F.struct(tokens.alias(name)))))


def keyword(c: Column) -> Column:
    """A field that is not tokenized: its value is its only token (FN2)."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def tuples(tokens: Column, k: int) -> Column:
    """All 1-tuples, then 2-tuples, to k-tuples of neighbouring tokens joined by ``_`` (FN5); shorter texts give what they have."""
    n = F.size(tokens)

    def of(m: int) -> Column:
        if m == 1:
            return tokens
        starts = F.when(n >= m, F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, m), "_"))

    return F.concat(*[of(m) for m in range(1, k + 1)])


def token_bag(df: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """(key, token, tf) (FN6)."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def anchor_text(anchors: Column) -> Column:
    """Anchors joined by blanks (FN10)."""
    return F.array_join(anchors, " ")


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def title_or_default(c: Column, n: int = 200) -> Column:
    """Clipped title, ``Untitled`` where empty (FN11)."""
    return F.coalesce(F.nullif(clip(F.trim(c), n), F.lit("")), F.lit("Untitled"))


def strip_html(c: Column) -> Column:
    """Text without tags (FN4)."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "[ \t\r\n]+", " "))


def strip_invalid_xml(c: Column) -> Column:
    """Text without characters that XML 1.0 forbids (FN4)."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def unchanged(a: Column, b: Column, k: int = 3, threshold: float = 0.95) -> Column:
    """Whether two token arrays are the same text but for little: Jaccard of their k-word shingles (FN15).

    Two texts without shingles are equal if their tokens are.
    """
    x, y = F.array_distinct(_shingles(a, k)), F.array_distinct(_shingles(b, k))
    both, one = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(one == 0, a == b).otherwise(both / one >= threshold)


def _shingles(t: Column, k: int) -> Column:
    n = F.size(t)
    starts = F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).when(n > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, k), " "))
