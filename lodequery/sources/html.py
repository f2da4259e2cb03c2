"""Fetched pages as rows: text, title and links out of HTML (SRC4, SRC7-SRC9, IDX12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text (fixed values).
DROPPED = ("script", "select", "style")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, plain in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(plain))
    return c


def title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def body_text(html: Column) -> Column:
    """Text of a page: without the head, comments, dropped elements and tags; white space runs are one blank."""
    c = F.regexp_replace(html, "(?is)<head[^>]*>.*?</head>", " ")
    c = F.regexp_replace(c, "(?s)<!--.*?-->", " ")
    for name in DROPPED:
        c = F.regexp_replace(c, f"(?is)<{name}[^>]*>.*?</{name}>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "(?s)<[^>]*>", " ")), "[ \t\r\n]+", " "))


def links(html: Column, base: Column) -> Column:
    """array<struct<url, anchor>>; a path is put behind the base's scheme and host."""
    found = F.regexp_extract_all(html, F.lit('(?is)(<a [^>]*?href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/]+)", 1)

    def one(a: Column) -> Column:
        href = F.regexp_extract(a, '(?is)href="([^"]*)"', 1)
        full = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))
        return F.struct(unescape(full).alias("url"), F.trim(F.regexp_replace(a, "(?s)<[^>]*>", " ")).alias("anchor"))

    return F.transform(found, one)


def kind(content_type: Column, url: Column) -> Column:
    """html or pdf by content type, then suffix; html if unknown (SRC8)."""
    return F.when(content_type.contains("html"), "html").when(content_type.contains("pdf") | F.endswith(F.lower(url), F.lit(".pdf")), "pdf").otherwise("html")


def charset(content_type: Column, default: str = "UTF-8") -> Column:
    """SRC9."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(content_type, "charset=([^;]+)", 1)), F.lit("")), F.lit(default))


def fetch_state(status: Column) -> DataFrame | Column:
    """struct<success, recoverable, internal> of a fetch status (SRC4)."""
    return F.struct((status == "FETCH_SUCCESS").alias("success"), (status != "GONE").alias("recoverable"), status.isin("WOULDBLOCK", "BLOCKED").alias("internal"))


def parsed(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with title, text and links."""
    return pages.select("*", title(F.col(html)).alias("title"), body_text(F.col(html)).alias("text"), links(F.col(html), F.col(url)).alias("links"))
