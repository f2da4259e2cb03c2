"""Token counts at every prefix of a text (operator 1).

Prefix dynamic programming: the tokenization of a prefix ends with the one token that may follow the tokenization
of the prefix before it, so one pass gives the exact count of every prefix. Texts are cut before each run of white
space: no piece of the pre-splitting reaches across such a cut, so counts of units add up and equal units share
their work.
"""

from __future__ import annotations

import re
import struct
from functools import cache
from operator import sub

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WS, map_columns, only
from .merges import MergeAutomaton, byte_chars, load

#: Units that a worker remembers before it starts anew, and the longest that it remembers.
MEMO, MEMO_CHARS = 800_000, 64
UNIT = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
#: The vocabulary's pre-splitting (a fixed value).
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
_CONTRACTION = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")
#: A word and marks behind it: two pieces, as no apostrophe is among the marks.
_ENDED = re.compile(r"([^\W\d_]+)([^\w\s']+)\Z")
_SPACES = re.compile(f"[{WS}]*")


class PrefixCounter:
    def __init__(self, automaton: MergeAutomaton, special: list[str]):
        self.automaton, self.chars = automaton, byte_chars()
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo: dict[str, bytes] = {}

    def _piece(self, piece: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of one piece."""
        if piece.isascii():
            return self.automaton.run("".join(map(self.chars.__getitem__, piece.encode())))[2][1:]
        raw = piece.encode("utf-8", "surrogatepass")
        count = self.automaton.run("".join(map(self.chars.__getitem__, raw)))[2]
        ends = [k for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80]
        return [count[k] for k in ends]

    def _plain(self, unit: str) -> list[int]:
        spaces = _SPACES.match(unit).end()
        out = self._piece(unit[:spaces]) if spaces else []  # a text that ends in white space has it in one piece
        at = total = 0
        for piece in PIECE.findall(unit):
            end = at + len(piece)
            if end > spaces:
                count = self._piece(piece)
                if len(piece) > 2 and _CONTRACTION.fullmatch(piece):  # cut short, it is an apostrophe and letters
                    quote, rest = self._piece("'")[0], self._piece(piece[1:])
                    count = [quote] + [quote + c for c in rest[:-1]] + count[-1:]
                elif len(piece) == 2 and _CONTRACTION.fullmatch(piece):
                    count = self._piece("'") + count[-1:]
                out.extend(total + c for c in count[max(0, spaces - at) :])
                total += count[-1]
            else:
                total += self._piece(piece)[-1]
            at = end
        return out

    def unit(self, unit: str) -> list[int]:
        """Counts of every prefix of a unit; a special string is one token once it is whole."""
        m = self.special and self.special.search(unit)
        if not m:
            return self._plain(unit)
        head = self._plain(unit[: m.start()]) if m.start() else []
        total = (head[-1] if head else 0) + 1
        out = self._plain(unit[: m.end()])[:-1] + [total]
        if m.end() < len(unit):
            out += [total + c for c in self.unit(unit[m.end() :])]
        return out

    def deltas(self, unit: str) -> bytes:
        """Changes of the count with each character (int32); pieces that can't touch are looked up alone."""
        first = unit[0]
        rest = unit[1:] if first == " " else unit
        got = None
        if rest.isalpha():
            count = self._piece(unit)
            got = struct.pack(f"<{len(unit)}i", *map(sub, count, [0, *count]))
        elif first in "\n\t\r" and not unit[1:2].isspace():
            got = self._get(first) + self._get(unit[1:]) if len(unit) > 1 else None
        elif m := _ENDED.match(rest):
            head = unit[: len(unit) - len(m[2])]
            if m[1].isalpha():
                got = self._get(head) + self._get(m[2])
        if got is None:
            count = self.unit(unit)
            got = struct.pack(f"<{len(unit)}i", *map(sub, count, [0, *count]))
        if len(unit) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[unit] = got
        return got

    def _get(self, unit: str) -> bytes:
        return self.memo.get(unit) or self.deltas(unit)

    def prefixes(self, text: str) -> np.ndarray:
        """n_tokens of text[:1], text[:2], ... (int32)."""
        get, slow = self.memo.get, self.deltas
        return np.cumsum(np.frombuffer(b"".join([get(u) or slow(u) for u in UNIT.findall(text)]), np.int32), dtype=np.int32)


@cache
def _counter(path: str) -> PrefixCounter:
    automaton, content = load(path)
    return PrefixCounter(automaton, [t["content"] for t in content["added_tokens"]])


def token_counts(df: DataFrame, vocab: str, limit: int = 512, text: str = "text", keep: list[str] | None = None, prefixes: bool = False) -> DataFrame:
    """Append n_bytes, n_tokens, over_limit and fit_chars to the columns ``keep`` (default: all).

    Columns of these names in the input are replaced. fit_chars: characters of the longest prefix of at most ``limit``
    tokens. With ``prefixes`` the column prefix_tokens holds the count of every prefix (little-endian int32, one a
    character; read it with ``tokens_at`` or ``longest_prefix``). A null text counts as empty: no bytes, no tokens.
    Special strings of the vocabulary inside a text are one token each, as the library's default has it.
    """
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())]
    if prefixes:
        new.append(T.StructField("prefix_tokens", T.BinaryType()))
    names = {f.name for f in new}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]

    def make():
        counter = _counter(vocab)
        only("token_counts", counter.memo.clear)

        def f(texts):
            out: list[list] = [[] for _ in new]
            for t in texts:
                t = t or ""
                c = counter.prefixes(t)
                n = int(c[-1]) if len(c) else 0
                row = [len(t.encode("utf-8", "surrogatepass")), n, n > limit, longest_prefix(c, limit) if n > limit else len(t)]
                for o, v in zip(out, row + [c.tobytes()] * prefixes, strict=True):
                    o.append(v)
            return out

        return f

    return map_columns(df, [text], new, make, keep)


def tokens_at(prefix_tokens: bytes | np.ndarray, chars: int) -> int:
    """Tokens of the first ``chars`` characters, read from the stored counts."""
    c = np.frombuffer(prefix_tokens, "<i4") if isinstance(prefix_tokens, bytes) else prefix_tokens
    return int(c[min(chars, len(c)) - 1]) if chars > 0 and len(c) else 0


def longest_prefix(prefix_tokens: bytes | np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens (counts may fall as a text grows)."""
    c = np.frombuffer(prefix_tokens, "<i4") if isinstance(prefix_tokens, bytes) else prefix_tokens
    ok = np.flatnonzero(c <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0
