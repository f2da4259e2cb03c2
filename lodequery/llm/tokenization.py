"""The deterministic automaton of correct tokenizations, compiled from a list of merges gadget by gadget.

Over tokens: at first one state reads every base token. A merge (u, v) -> uv splits the state after u: the arcs u now
lead to a copy of it that no longer reads v, and wherever u could be read uv can be read too and leads where v led. A
state is held as what it lacks: its owner's first cuts and, beyond them, the state that it was split from; tokens whose
states never came to differ share one. Over characters: a state of the table is the set of tokens begun (each with
the state it was begun in), and reading a character goes to one other state and completes exactly one token. These
states are numbered, and their rows filled, when a word first needs them; a table that is full is begun anew.
"""

from __future__ import annotations

#: States of the character table at most.
STATES = 150_000


class TokenStates:
    """``vocab``: token string to id; ``merges``: pairs of token strings, in order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        made = {vocab[u + v] for u, v in merges}
        self.born: dict[int, int] = {k: -1 for k in vocab.values() if k not in made}
        self.left: dict[int, int] = {}
        #: Of every owner of states: the tokens that its states lack, each with the time and the turn of its cut.
        self.cuts: dict[int, dict[int, tuple[int, int]]] = {}
        #: A state: its owner, how many of the owner's cuts it has, and the state it was split from. State 0 lacks nothing.
        self.owner, self.has, self.origin = [-1], [0], [0]
        self.numbers: dict[tuple[int, int], int] = {}
        #: The state that arcs with a token's label lead to.
        self.after: dict[int, int] = dict.fromkeys(self.born, 0)
        for at, (a, b) in enumerate(merges):
            u, v, uv = vocab.get(a), vocab.get(b), vocab[a + b]
            if u in self.born and v in self.born and uv not in self.born and self.reads(self.after[u], v):
                self._gadget(at, u, v, uv)

    def _gadget(self, at: int, u: int, v: int, uv: int) -> None:
        cuts = self.cuts.setdefault(u, {})
        whence = self.origin[self.after[u]] if self.owner[self.after[u]] == u else self.after[u]
        cuts[v] = (at, len(cuts))
        self.owner.append(u)
        self.has.append(len(cuts))
        self.origin.append(whence)
        leads = self.after[v]  # where v led before arcs u are redirected: for u = v, uv is followed by u again
        self.after[u] = len(self.owner) - 1
        self.born[uv], self.left[uv], self.after[uv] = at, u, leads

    def reads(self, state: int, token: int) -> bool:
        """Has the state an arc with this label? It has none if it, or a state it was split from, lacks the token or a beginning of it."""
        while state:
            cuts, has = self.cuts[self.owner[state]], self.has[state]
            part, born = token, 1 << 60
            while part is not None:
                cut = cuts.get(part)
                # What began with a part once it was cut off could no longer be put in its place.
                if cut and cut[1] < has and cut[0] <= born:
                    return False
                born, part = self.born[part], self.left.get(part)
            state = self.origin[state]
        return True


class CharTable:
    """Encodes by table-driven transitions over characters; ``end`` marks a word's last character."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.tokens, self.closes = TokenStates(vocab, merges), int(bool(end))
        self.symbol: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        self.size: dict[int, int] = {}
        for text, k in vocab.items():
            if k in self.tokens.born:
                closed = bool(end) and text.endswith(end) and text != end
                chars = list(text[: len(text) - len(end)] if closed else text)
                node = 0
                for n, c in enumerate(chars):
                    key = node << 12 | self.number(c, closed and n + 1 == len(chars))
                    self.inner[node] = True
                    if key not in self.child:
                        self.child[key] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(False)
                    node = self.child[key]
                self.token[node] = k
                self.size[k] = len(chars)
        self.begin()

    def number(self, char: str, last: bool) -> int:
        """The symbol of a character: even inside a word, odd at its end."""
        return 2 * self.symbol.setdefault(char, len(self.symbol)) + last

    def begin(self) -> None:
        self.states: dict[tuple[int, ...], int] = {(0,): 0}
        self.begun: list[tuple[int, ...]] = [(0,)]
        self.emits: list[int] = [-1]
        self.next: dict[int, int] = {}

    def _step(self, state: int, symbol: int) -> int:
        """The state after a character: every token begun goes on or ends, and one that ends may be followed by any new one."""
        done, going = -1, []
        for pair in self.begun[state]:
            node = self.child.get((pair & 0xFFFFFFFF) << 12 | symbol)
            if node is not None:
                if done < 0 and self.token[node] >= 0 and self.tokens.reads(pair >> 32, self.token[node]):
                    done = self.token[node]
                if self.inner[node]:
                    going.append(pair >> 32 << 32 | node)
        if done >= 0:
            going.append(self.tokens.after[done] << 32)
        key = (done, *going)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = len(self.begun)
            self.begun.append(tuple(going))
            self.emits.append(done)
        self.next[state << 12 | symbol] = got
        return got

    def encode(self, word: str) -> list[int]:
        """The labels of the one path that spells ``word``; a character that is in no token gives -1."""
        if len(self.begun) > STATES:
            self.begin()
        symbols = [2 * self.symbol.get(c, 2000) for c in word]
        symbols[-1] += self.closes
        state, path, get = 0, [], self.next.get
        for s in symbols:
            to = get(state << 12 | s)
            state = self._step(state, s) if to is None else to
            path.append(self.emits[state])
        out, i = [], len(word)
        while i:
            t = path[i - 1]
            out.append(t)
            i -= self.size.get(t, 1)
        return out[::-1]
