"""Encoding and decoding by the tokenization automaton of a word-end vocabulary's merges (operator 8).

The automaton is compiled from the merges (``tokenization``); pre-split words are encoded by its table of transitions,
and ids are decoded by emitting the labels of their arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import WS, map_columns, only
from .merges import byte_chars
from .tokenization import CharTable

MEMO, MEMO_CHARS = 600_000, 64
UNIT = re.compile(f"[^{WS}]+")
#: The vocabulary's words (a fixed value), and the same over lower-case ASCII.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WS}\p{{L}}\p{{N}}]+")
#: A word and ASCII marks behind it: they can't touch, as no apostrophe is among the marks.
_ENDED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)\Z")
_CONTROL = re.compile(r"[\x1c-\x1f]")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|[\x1c-\x1f]+")


class Codec:
    """Table-driven transitions for words; normalisation is the library's, and decoding emits the arcs' labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = CharTable(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chars = byte_chars()
        normalizer = Tokenizer.from_file(path).normalizer
        self.normal = normalizer.normalize_str if normalizer else lambda s: s
        self.label = {k: t for t, k in (model["vocab"] | self.special).items()}
        self.memo: dict[str, bytes] = {}

    def _words(self, part: str) -> list[int]:
        if part.isascii() and not _CONTROL.search(part):
            words = [part.lower()] if part.isalpha() else _ASCII.findall(part.lower())
        else:
            words = WORD.findall(self.normal(part))
        out: list[int] = []
        for w in words:
            out += self.automaton.encode("".join(map(self.chars.__getitem__, w.encode())))
        return out

    def unit(self, unit: str) -> bytes:
        m = _ENDED.match(unit)
        if m and (m[1].isascii() or self.normal(m[1]).isalpha()) and m[1].isalpha():
            return self._keep(unit, self._get(m[1]) + self._get(m[2]))
        ids: list[int] = []
        for k, part in enumerate(self.split.split(unit) if self.split and "<" in unit else [unit]):
            if part:
                ids += [self.special[part]] if k % 2 else self._words(part)
        return self._keep(unit, struct.pack(f"<{len(ids)}I", *ids))

    def _get(self, unit: str) -> bytes:
        got = self.memo.get(unit)
        return self.unit(unit) if got is None else got

    def _keep(self, unit: str, got: bytes) -> bytes:
        if len(unit) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        """Token ids (little-endian uint32)."""
        get = self._get
        memo = self.memo.get
        return b"".join([memo(u) or get(u) for u in UNIT.findall(text)])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after the other."""
        return " ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(df: DataFrame, vocab: str, text: str = "text", keep: list[str] | None = None, outputs: bool = True) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256, and with ``outputs`` the ids (little-endian uint32) and the decoded text.

    Columns of these names in the input are replaced. A null or empty text, or one of white space, has no tokens and
    decodes to an empty text. Special strings inside a text become their ids, as the library's default has it.
    """
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if outputs:
        new += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    names = {f.name for f in new}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]

    def make():
        c = codec(vocab)
        only("codec", lambda: (c.memo.clear(), c.automaton.begin()))

        def f(texts):
            out: list[list] = [[] for _ in new]
            for t in texts:
                ids = c.encode(t or "")
                decoded = c.decode(ids)
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), ids, decoded]
                for o, v in zip(out, row):  # noqa: B905
                    o.append(v)
            return out

        return f

    return map_columns(df, [text], new, make, keep)
