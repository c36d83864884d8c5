"""Byte-pair encoding by a lazily determinised finite-state transducer.

A sequence of tokens is the byte-pair encoding of a byte string exactly when every two neighbouring tokens are, on their
own, the encoding of their two byte strings joined. That makes the encoder a finite-state machine: a configuration is the
last complete token and the part of the next one that has been read. The nondeterministic machine guesses where a token
ends; determinising it keeps all live guesses together with the tokens on which they still differ, and writes out a token
once all guesses agree on it, so after a lookahead of at most the longest token. Determinised states and arrows are built
the first time a text needs them, and dropped all together when there are too many: only time is lost by that.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable

import regex

#: The pattern by which the public byte-level vocabulary splits text before merging. Fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: States, and pairs of tokens that are known to fit, above which all are dropped.
MAX_STATES, MAX_FITS = 200_000, 1_000_000
MAX_WORDS = 300_000
NEVER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a .tiktoken file: one base64 token and its id a line, ids in merge order after the single bytes."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _State:
    __slots__ = ("arrows", "final", "guesses")

    def __init__(self, guesses):
        self.guesses = guesses
        self.arrows: dict[int, tuple[_State, tuple[int, ...]]] = {}
        #: What is still to be written if the input ends here: the first guess is the one that ends with a whole token.
        self.final = guesses[0][0]


class Transducer:
    """Encodes byte strings with the vocabulary ``ranks`` (bytes to id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.inner: set[bytes] = {t[:k] for t in ranks for k in range(1, len(t))}
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = _State((((), None, b""),))

    def merge(self, data: bytes, below: float = NEVER) -> list[bytes]:
        """Tokens of ``data`` by the definition: of all joins with an id under ``below``, the lowest is made first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """The parts that stand at the right (left) end of ``token`` while it is merged, each with the id that ends it."""
        key = (token, right)
        edge = self.edges.get(key)
        if edge is None:
            edge = [(token, NEVER)]
            if len(token) > 1:
                rank = self.ranks[token]
                inner = self._edge(self.merge(token, rank)[-1 if right else 0], right)
                edge = [*inner[:-1], (inner[-1][0], rank), *edge]
            self.edges[key] = edge
        return edge

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two tokens: no join across their border comes before the parts at it end.

        Of equal joins the leftmost is made first, so a join across wins against an equal one inside the right token.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            a, b, i, j, get = self._edge(self.bytes_of[left], True), self._edge(self.bytes_of[right], False), 0, 0, self.ranks.get
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                across = get(x + y, NEVER)
                if across < x_ends and across <= y_ends and across < NEVER:
                    known = False
                    break
                if x_ends <= y_ends:
                    if x_ends == NEVER:
                        known = True
                        break
                    i += 1
                else:
                    j += 1
            if len(self.fits) >= MAX_FITS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _arrow(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Builds the arrow of ``state`` for ``byte``."""
        step, live, ranks, inner, fits = bytes((byte,)), [], self.ranks, self.inner, self.fits
        for held, last, part in state.guesses:
            part += step
            if part in inner:
                live.append((held, last, part))  # parts differ in length and stay in its order, so equal sets are equal tuples
            if part in ranks:
                token = ranks[part]
                if last is None or (fits[last, token] if (last, token) in fits else self._fit(last, token)):
                    live.insert(0, ((*held, token), token, b""))
        agreed, whole = 0, live[0][0]
        for agreed, token in enumerate(whole):  # noqa: B007
            if any(len(held) == agreed or held[agreed] != token for held, _, _ in live):
                break
        else:
            agreed = len(whole)
        out = whole[:agreed]
        guesses = tuple([(held[agreed:], last, part) for held, last, part in live]) if agreed else tuple(live)
        target = self.states.get(guesses)
        if target is None:
            if len(self.states) >= MAX_STATES:
                self._reset()  # with the start, so that nothing leads to the old states any more
            target = self.states[guesses] = _State(guesses)
        state.arrows[byte] = arrow = (target, out)
        return arrow

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for byte in data:
            arrow = state.arrows.get(byte) or self._arrow(state, byte)
            if arrow[1]:
                out += arrow[1]
            state = arrow[0]
        out += state.final
        return out


class _Known(dict):
    """Ids of the strings seen so far, packed as 32-bit integers; makes those that are missing."""

    def __init__(self, make, limit: int = MAX_WORDS):
        self.make, self.limit = make, limit

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) < 100:
            if len(self) >= self.limit:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Text to token ids: splits by pattern, then runs the transducer; remembers the words it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT):
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        #: A single space before a visible character always begins a new piece, so text can be cut there first.
        self.uneven = re.compile(r" \s")
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.pieces = _Known(lambda piece: array("i", self.machine.encode(piece.encode("utf-8", "surrogatepass"))).tobytes())
        self.first = _Known(self._packed)
        self.later = _Known(lambda word: self._packed(" " + word))

    def _packed(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def packed(self, text: str | None) -> bytes:
        """Ids of ``text`` as 32-bit integers in the machine's order, without special tokens, whose strings are ordinary
        text. Null and empty give no ids."""
        if not text:
            return b""
        words = self.cut.split(text) if self.uneven.search(text) or text[-1] == " " else text.split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


class Decoder:
    """Token ids to text as they arrive, by an incremental UTF-8 machine.

    ``feed`` gives the characters that are complete so far; an invalid sequence becomes U+FFFD as soon as it is seen to be
    invalid, one for each longest valid beginning, as the standard decoder does. ``close`` ends the stream.
    """

    #: For each lead byte range: bytes that follow, and the bounds of the first of them. Fixed values (Unicode, table 3-7).
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def _byte(self, b: int, out: list[str]) -> None:
        if self.need:
            if self.low <= b <= self.high:
                self.value, self.low, self.high = self.value << 6 | b & 0x3F, 0x80, 0xBF
                self.need -= 1
                if not self.need:
                    out.append(chr(self.value))
                return
            out.append("�")
            self.need, self.low, self.high = 0, 0x80, 0xBF
        if b < 0x80:
            out.append(chr(b))
            return
        for first, last, need, low, high in self.LEADS:
            if first <= b <= last:
                self.need, self.low, self.high = need, low, high
                self.value = b & (0x3F >> need)
                return
        out.append("�")

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for i in ids:
            for b in self.bytes_of[i]:
                self._byte(b, out)
        return "".join(out)

    def close(self) -> str:
        left, self.need, self.low, self.high = self.need, 0, 0x80, 0xBF
        return "�" if left else ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(load_ranks(path))
    return _encoders[path]
