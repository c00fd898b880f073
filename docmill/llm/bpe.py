"""Byte-pair tokenization as a deterministic automaton.

The merge list is compiled by successive merge gadgets: start from the one-state machine with an arc per byte; the
gadget of merge ``(u, v) -> w`` adds, wherever a ``u`` arc is followed by a ``v`` arc, one ``w`` arc to the target of
``v``, and sends ``u`` to a copy of its target that lacks the ``v`` arc. After all merges every state is "the token
just emitted", and an arc ``t`` leaves state ``s`` exactly if ``s t`` survives all merges. Materialised, that machine
has about |V|^2 arcs, so the transition table is filled on demand: whether arc ``t`` leaves state ``s`` is decided by
undoing the gadgets in reverse order (``_arc``) and kept in a table. A word has exactly one accepting path, so it is
encoded left to right from table look-ups without any merge loop, and decoded by emitting the labels of its arcs.
"""

from __future__ import annotations

import json
from itertools import chain
from typing import Any

import regex

#: White space as the tokenizers' regular expression engine sees it (Unicode White_Space). Fixed values.
WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public pre-split pattern of byte_bpe_50k (fixed value), with white space written out.
PIECES = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: A single space between two visible characters always starts a new piece, so a text may be cut there.
CUTS = regex.compile(rf"(?<=[^{WS}]) (?=[^{WS}])")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """Encoder and decoder of one byte-level BPE vocabulary given as the text of a ``tokenizers`` JSON file."""

    def __init__(self, vocabulary_json: str) -> None:
        model = json.loads(vocabulary_json)["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.alphabet = byte_alphabet()
        size = max(self.ids.values()) + 1
        self.size = size
        self.born = [-1] * size  # the rank of the merge that makes a token; -1 for bytes
        self.left, self.right = [0] * size, [0] * size
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            made, a, b = self.ids[u + v], self.ids[u], self.ids[v]
            self.merge[a * size + b] = rank
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, a, b
        tokens = [t for t in self.ids if self.born[self.ids[t]] >= 0 or len(t) == 1]
        self.labels = {self.ids[t]: t for t in tokens}
        self.ids = {t: self.ids[t] for t in tokens}
        self.suffixes = {t[i:] for t in tokens for i in range(len(t))}
        self.arcs: dict[int, bool] = {}
        self._bytes = {ord(c): b for b, c in self.alphabet.items()}

    def _arc(self, a: int, b: int) -> bool:
        """Does arc ``b`` leave state ``a``? Undoes the later of both tokens' gadgets until two bytes remain."""
        size, merge, born = self.size, self.merge, self.born
        limit = 1 << 60
        while True:
            rank = merge.get(a * size + b)
            if rank is not None and rank < limit:
                return False
            x, y = born[a], born[b]
            if x < 0 and y < 0:
                return True
            if x == y:
                limit, a, b = x, self.right[a], self.left[b]
            elif x > y:
                limit, a = x, self.right[a]
            else:  # of two overlapping merges of one rank the left one is made
                limit, b = y + 1, self.left[b]

    def extend(self, word: str, path: list[int], start: list[int], count: list[int]) -> None:
        """Carry the state on from ``word[:len(path) - 1]`` to all of ``word`` (in the byte alphabet).

        ``path[i]`` is the last arc of the only path of ``word[:i]``, ``start[i]`` where that arc begins, ``count[i]``
        the number of arcs.
        """
        ids, suffixes, arcs, size = self.ids, self.suffixes, self.arcs, self.size
        for i in range(len(path), len(word) + 1):
            j = i - 1
            found = -1
            while j >= 0:
                piece = word[j:i]
                if piece not in suffixes:
                    break
                token = ids.get(piece)
                if token is not None:
                    if j == 0:
                        found = token
                        break
                    key = path[j] * size + token
                    ok = arcs.get(key)
                    if ok is None:
                        if len(arcs) > 2_000_000:
                            arcs.clear()
                        ok = arcs[key] = self._arc(path[j], token)
                    if ok:
                        found = token
                        break
                j -= 1
            path.append(found)
            start.append(j)
            count.append(count[j] + 1)

    def spell(self, piece: str) -> str:
        """A piece in the byte alphabet."""
        return piece.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        word = self.spell(piece)
        whole = self.ids.get(word)
        if whole is not None and len(word) == 1:
            return (whole,)
        path, start, count = [-1], [0], [0]
        self.extend(word, path, start, count)
        out, i = [], len(word)
        while i > 0:
            out.append(path[i])
            i = start[i]
        return tuple(reversed(out))

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding is ``ids``: the arcs' labels, one after the other."""
        return bytes(self._bytes[ord(c)] for c in "".join(self.labels[i] for i in ids)).decode("utf-8", "replace")


class Memo(dict):
    """A dictionary that computes what it lacks; emptied when it holds ``most`` entries, so its memory is bounded."""

    def __init__(self, make: Any, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> Any:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Encodes whole texts: cuts them at safe spaces, pre-splits, and looks frequent words up."""

    def __init__(self, automaton: Automaton, memo_entries: int = 250_000) -> None:
        self.automaton = automaton
        self.pieces: Memo = Memo(automaton.encode_piece, memo_entries)
        self.words: Memo = Memo(lambda w: self._run(" " + w), memo_entries)
        self.heads: Memo = Memo(self._run, memo_entries // 10)

    def _run(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, PIECES.findall(text))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty or null one."""
        if not text:
            return []
        parts = CUTS.split(text)
        out = list(self.heads[parts[0]])
        for ids in map(self.words.__getitem__, parts[1:]):
            out += ids
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        parts = CUTS.split(text)
        return len(self.heads[parts[0]]) + sum(map(len, map(self.words.__getitem__, parts[1:])))


_OPEN: dict[int, Encoder] = {}


def encoder(vocabulary_json: str) -> Encoder:
    """The encoder of a vocabulary, built once in each Python worker."""
    key = hash(vocabulary_json)
    if key not in _OPEN:
        _OPEN[key] = Encoder(Automaton(vocabulary_json))
    return _OPEN[key]
