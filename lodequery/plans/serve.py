"""Serving: request parameters to a page of results, with a result cache, suggestions and snippets (SRV1-SRV9, SRV11, SRV12)."""

from __future__ import annotations

import datetime as dt
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import search as s
from ..operators import snippets
from . import ast
from . import parser as p


@dataclass
class Results:
    page: DataFrame
    total: int
    groups: int
    next_offset: int
    groups_estimate: int
    suggested: str | None = None
    seconds: float = 0.0


@dataclass
class Session:
    """One index behind the decorators, in this order: snippets, result cache, suggestion, log, statistics."""

    index: s.Index
    cache_size: int = 500
    suggestions: DataFrame | None = None
    log: list[str] = field(default_factory=list)
    times: list[float] = field(default_factory=list)
    _cache: OrderedDict = field(default_factory=OrderedDict)

    def swap(self, index: s.Index) -> None:
        """A new index version: the cache is emptied (IDX16)."""
        self.index = index
        self._cache.clear()

    def search(self, params: dict, now: dt.datetime | None = None) -> Results:
        """params: query, start, hitsPerPage, orderBy, categories, site, crawl, range, past, groupBy, group_size, payload (SRV12)."""
        began = time.monotonic()
        q: ast.Query = s.resolve(ast.Lazy(params["query"]), self.index.parser)
        more = [ast.Payload(x) for x in params.get("payload", [])] + [p.range_of(x) for x in params.get("range", [])]
        more += [p.past_of(x, now or dt.datetime.now(dt.UTC)) for x in params.get("past", [])]
        if more:
            q = ast.And((q, *more))
        where = p.filters_of(params.get("categories", []), params.get("site"), params.get("crawl"))
        order = p.order_of(params.get("orderBy", ""))
        start, count = int(params.get("start", 0)), min(int(params.get("hitsPerPage", 10)), s.HITS_PER_PAGE)
        group, size = params.get("groupBy"), int(params.get("group_size", 1))
        key = (q.key(), where, tuple(order), start, count, group, size)
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        out = self._run(q, where, order, start, count, group, size)
        if self.suggestions is not None:
            out.suggested = self._suggest(params["query"], out.total)
        out.seconds = time.monotonic() - began
        self.times.append(out.seconds)
        if out.total:
            self.log.append(params["query"])
        self._cache[key] = out
        while len(self._cache) > self.cache_size:
            self._cache.popitem(last=False)
        return out

    def _run(self, q, where, order, start, count, group, size) -> Results:
        if not 0 <= start <= s.MAX_OFFSET:
            raise ValueError(f"start must be from 0 to {s.MAX_OFFSET}")
        hits = s.search(self.index, q, where)
        total = hits.count()
        if start > total:
            raise ValueError("start is behind the last result")
        k = self.index.key
        top = s.top_hits(hits, order, k, start + max(size, 1) * count * s.LOOKUP)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*s.order_columns(order, k)))).where(F.col("rank") > start)
        ranked = ranked.withColumn("rank", F.col("rank") - start)
        g = F.col(group) if group else F.col(k)
        page = s.group_hits(ranked, g, count, size)
        terms = [t for _, t in s._leaves(q)]
        page = snippets.with_snippets(page, terms).cache()  # at most HITS_PER_PAGE groups
        n, last = page.agg(F.countDistinct("group_key"), F.max("rank")).first()
        consumed = last or 0
        return Results(page, total, n, start + consumed, s.estimate_groups(total, consumed, n))

    def _suggest(self, text: str, current: int) -> str | None:
        asked = self.suggestions.sparkSession.createDataFrame([(text,)], "query string")
        tried = [r["rewrite"] for r in s.suggest_rewrites(asked, self.suggestions).orderBy("rewrite").limit(5).collect()]
        counts = [(t, s.search(self.index, t).count()) for t in tried]
        return s.accept_suggestion(counts, current)

    def statistics(self) -> dict[str, float]:
        """Response times: most, least, mean and how many (SRV9)."""
        t = self.times
        return {"n": len(t), "most": max(t, default=0.0), "least": min(t, default=0.0), "mean": sum(t) / len(t) if t else 0.0}
