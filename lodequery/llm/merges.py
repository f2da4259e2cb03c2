"""The automaton of correct tokenizations that a list of merges defines.

Every merge (u, v) -> uv is a gadget: arcs that reach the state after u may no longer read v (the arc is cut), and
wherever u could be read, uv can be read too and leads where v led. States after two tokens stay shared until a
gadget splits them, so a state needs no list of its arcs: whether an arc exists follows from the tokens' births and
the cuts, and rows of the table are filled when they are first asked for. A string's tokenization is the one path
whose labels spell it; each of its prefixes has one such path as well.
"""

from __future__ import annotations

import json

#: Entries of the transition table before it starts anew.
TABLE = 1_000_000
_NEVER = 1 << 60


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


class MergeAutomaton:
    """``vocab``: token string to id; ``merges``: pairs of token strings, in order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.birth: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        made = {vocab[u + v] for u, v in merges}
        self.labels = {t: k for t, k in vocab.items() if k not in made}
        for k in self.labels.values():
            self.birth[k] = -1
        for at, (a, b) in enumerate(merges):
            self._gadget(at, vocab.get(a), vocab.get(b), vocab[a + b])
            if vocab[a + b] in self.birth:
                self.labels[a + b] = vocab[a + b]
        #: Every ending of a label: the label's id, or -1 where only longer labels end so.
        self.endings: dict[str, int] = {}
        for t in self.labels:
            for k in range(len(t)):
                self.endings.setdefault(t[k:], -1)
        self.endings.update(self.labels)

    def _gadget(self, at: int, u: int | None, v: int | None, uv: int) -> None:
        if u not in self.birth or v not in self.birth or uv in self.birth or not self._arc(u, v, at - 1):
            return  # no path reads u and then v: the merge never happens
        self.birth[uv], self.left[uv], self.right[uv] = at, u, v
        self.cut[u, v] = at

    def _arc(self, p: int, w: int, now: int) -> bool:
        """Is there an arc w in the state after p, once the merges up to ``now`` are in?"""
        birth, cut = self.birth, self.cut
        while True:
            if cut.get((p, w), _NEVER) <= now:
                return False
            bp, bw = birth[p], birth[w]
            if bp < 0 and bw < 0:
                return True
            if bp > bw:  # the state after p was the one after its right part when p was made
                p, now = self.right[p], min(now, bp - 1)
            else:  # w was put wherever its left part could be read just before
                u = self.left[w]
                if p == u and u == self.right[w]:
                    return False  # three equal tokens: the first two join
                w, now = u, min(now, bw - 1)

    def follows(self, p: int, w: int) -> bool:
        key = p << 32 | w
        ok = self.table.get(key)
        if ok is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            ok = self.table[key] = self._arc(p, w, _NEVER - 1)
        return ok

    def run(self, word: str, end: str = "") -> tuple[list[int], list[int], list[int]]:
        """For each prefix of ``word``: its last token, where that token starts, and its number of tokens.

        ``end`` is written after the last character; a prefix that no path spells has token -1.
        """
        n = len(word)
        last, back, count = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        get, table = self.endings.get, self.table
        for i in range(1, n + 1):
            tail = end if i == n else ""
            for j in range(i - 1, -1, -1):
                t = get(word[j:i] + tail if tail else word[j:i])
                if t is None:  # no label ends with this or anything longer
                    break
                if t < 0:
                    continue
                if j:
                    p = last[j]
                    if p < 0:
                        continue
                    ok = table.get(p << 32 | t)
                    if ok is None:
                        ok = self.follows(p, t)
                    if not ok:
                        continue
                last[i], back[i], count[i] = t, j, count[j] + 1
                break
        return last, back, count

    def encode(self, word: str, end: str = "") -> list[int]:
        last, back, _ = self.run(word, end)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]


def load(path: str) -> tuple[MergeAutomaton, dict]:
    """The automaton of a tokenizers JSON file, and the file's content."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model = content["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return MergeAutomaton(model["vocab"], merges), content
