"""URL functions: fragments, hosts, hashes, pattern rules and filters (FN7-FN9, FN12, FN13, URLP, URLF)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST_STOPWORDS = ("www", "com", "org", "net")
#: Rules of the default filter, the first that is found decides (fixed values): reject or accept, pattern.
URL_FILTER = (
    (False, r"^(file|ftp|mailto):"),
    (False, r"\.(gif|GIF|jpg|JPG|png|PNG|ico|ICO|css|sit|eps|wmf|zip|ppt|mpg|xls|gz|rpm|tgz|mov|MOV|exe|jpeg|JPEG|bmp|BMP|mpeg|swf)$"),
    (False, r".*(/.+?)/.*?\1/.*?\1/"),
    (True, r"."),
)


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def host(url: Column) -> Column:
    """Host, or an empty string where there is none or the URL is no URL (FN8)."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def host_labels(h: Column, stopwords: tuple[str, ...] = HOST_STOPWORDS) -> Column:
    stop = F.array(*[F.lit(s) for s in stopwords])
    return F.filter(F.split(h, r"\."), lambda x: (x != "") & ~F.array_contains(stop, x))


def registrable_domain(h: Column) -> Column:
    """The last three labels where the last has two characters, else the last two."""
    labels = F.split(h, r"\.")
    n = F.when(F.length(F.element_at(labels, -1)) == 2, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def host_tokens(h: Column, stopwords: tuple[str, ...] = HOST_STOPWORDS) -> Column:
    """Labels less stop words, and the registrable domain (FN9)."""
    return F.when(h == "", F.lit("")).otherwise(F.concat_ws(" ", F.array_join(host_labels(h, stopwords), " "), registrable_domain(h)))


def url_hash(url: Column) -> Column:
    return F.md5(url)


def shard_of(url: Column, n: int) -> Column:
    """Shard by the first two signed MD5 bytes, each moved up by 128 (FN13)."""
    h = F.md5(url)
    byte = lambda at: F.pmod(F.conv(F.substring(h, at, 2), 16, 10).cast("int") + 128, F.lit(256))
    return F.pmod(byte(1) * 256 + byte(3), F.lit(n)).cast("int")


def accepted(url: Column, rules: tuple[tuple[bool, str], ...] = URL_FILTER) -> Column:
    """The first rule that is found in the URL decides; none rejects (URLF)."""
    out = F.lit(False)
    for keep, pattern in reversed(rules):
        out = F.when(url.rlike(pattern), F.lit(keep)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def pattern_parts(line: str) -> tuple[str, str | None, str | None, list[str]]:
    """prefix, pattern, anti-pattern and tokens of a rule ``prefix | pattern || anti-pattern ||| tok,tok``."""
    line, _, tokens = line.partition("|||")
    line, _, anti = line.partition("||")
    prefix, _, pattern = line.partition("|")
    return prefix.strip(), pattern.strip() or None, anti.strip() or None, [t.strip() for t in tokens.split(",") if t.strip()]


@dataclass
class UrlPatterns:
    """Rules of URLP. A rule with a prefix alone is that URL; with tokens alone beside the prefix likewise.

    ``*`` matches all (with the tokens given after it), ``#`` begins a comment line. Rules and URLs are compared in lower case.
    """

    rules: list[tuple[str, str | None, str | None, list[str]]] = field(default_factory=list)
    match_all: bool = False
    default_tokens: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> UrlPatterns:
        out = cls()
        for line in (x.strip().lower() for x in lines):
            if not line or line.startswith("#"):
                continue
            prefix, pattern, anti, tokens = pattern_parts(line)
            if line.startswith("*"):
                out.match_all, out.default_tokens = True, tokens
            else:
                out.rules.append((prefix, pattern, anti, tokens))
        return out

    def _hit(self, url: Column, rule: tuple) -> Column:
        prefix, pattern, anti, _ = rule
        rest = F.substring(url, len(prefix) + 1, 1 << 20)
        ok = F.startswith(url, F.lit(prefix)) & rest.rlike(f"^(?:{pattern or ''})$")
        return ok & ~rest.rlike(anti) if anti else ok

    def match(self, url: Column) -> Column:
        """True where any rule matches; the rules become one condition, so no join is needed."""
        if self.match_all:
            return F.lit(True)
        low = F.lower(url)
        return F.coalesce(reduce(lambda a, b: a | b, [self._hit(low, r) for r in self.rules], F.lit(False)), F.lit(False))

    def tokens(self, url: Column) -> Column:
        """Sorted tokens of all rules that match; null where none does and ``*`` is not given."""
        low = F.lower(url)
        none = F.array().cast("array<string>")
        lit = lambda ts: F.array(*[F.lit(t) for t in ts]) if ts else none
        parts = [F.when(self._hit(low, r), lit(r[3])).otherwise(none) for r in self.rules]
        found = F.array_sort(F.array_distinct(F.concat(none, lit(self.default_tokens) if self.match_all else none, *parts)))
        return F.when(self.match(url), found)
