"""Ropes: balanced trees over pieces of one text, whose nodes cache how many units and code points lie below.

A unit is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, matched from left to right: it begins with the text, or with white space after
a word. Leaves hold at most LEAF bytes of UTF-8, cut between code points and not between units, so no leaf grows with a unit. Trees
are never changed: a split makes new nodes along one path and shares all others, and a join adds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from skein.llm.textkit import WHITE

#: Bytes of a leaf.
LEAF = 2048


class Leaf:
    """text: bytes of a piece. opens: whether its first byte begins a unit."""

    __slots__ = ("chars", "opens", "size", "text", "units")

    def __init__(self, text: memoryview, opens: bool, units: int | None = None, chars: int | None = None):
        self.text, self.opens, self.size = text, opens, len(text)
        self.units = len(self.starts()) if units is None else units
        self.chars = len(self.places()) if chars is None else chars

    def starts(self) -> np.ndarray:
        """Bytes that begin a unit."""
        white = WHITE[np.frombuffer(self.text, np.uint8)]
        begins = white.copy()
        begins[1:] &= ~white[:-1]
        begins[:1] = self.opens
        return np.flatnonzero(begins)

    def places(self) -> np.ndarray:
        """Bytes that begin a code point."""
        return np.flatnonzero((np.frombuffer(self.text, np.uint8) & 0xC0) != 0x80)

    def cut(self, at: int) -> tuple[Rope, Rope]:
        if at == 0:
            return EMPTY, self
        white = WHITE[self.text[at]] and not WHITE[self.text[at - 1]]
        return Leaf(self.text[:at], self.opens), Leaf(self.text[at:], bool(white))


class Node:
    __slots__ = ("chars", "left", "right", "size", "units")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.chars, self.size = left.units + right.units, left.chars + right.chars, left.size + right.size


Rope = Leaf | Node
EMPTY = Leaf(memoryview(b""), False, 0, 0)


def build(text: bytes) -> Rope:
    """The rope of a text; counts of all its leaves come from one pass over its bytes."""
    if not text:
        return EMPTY
    raw = np.frombuffer(text, np.uint8)
    heads = (raw & 0xC0) != 0x80
    cuts = np.arange(0, len(raw), LEAF)
    while not heads[cuts].all():  # never inside a code point
        cuts -= ~heads[cuts]
    cuts = np.unique(cuts)
    white = WHITE[raw]
    begins = white.copy()
    begins[1:] &= ~white[:-1]
    begins[0] = True
    units, chars, view = np.add.reduceat(begins, cuts, dtype=np.int64).tolist(), np.add.reduceat(heads, cuts, dtype=np.int64).tolist(), memoryview(text)
    row: list[Rope] = [Leaf(view[a:b], bool(begins[a]), u, c) for a, b, u, c in zip(cuts.tolist(), [*cuts[1:].tolist(), len(raw)], units, chars, strict=True)]
    while len(row) > 1:
        row = [Node(*row[k : k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0]


def join(*ropes: Rope) -> Rope:
    out = EMPTY
    for r in ropes:
        out = r if not out.size else Node(out, r) if r.size else out
    return out


def _split(rope: Rope, rank: int, by: str, marks: str) -> tuple[Rope, Rope]:
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if isinstance(rope, Leaf):
        return rope.cut(int(getattr(rope, marks)()[rank]))
    here = getattr(rope.left, by)
    if rank < here:
        a, b = _split(rope.left, rank, by, marks)
        return a, join(b, rope.right)
    a, b = _split(rope.right, rank - here, by, marks)
    return join(rope.left, a), b


def split_units(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """What is before the unit of that rank, and the rest. Leaves in which no unit begins stay with the unit before them."""
    return _split(rope, rank, "units", "starts")


def split_chars(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first code points, so many, and the rest."""
    return _split(rope, rank, "chars", "places")


def leaves(rope: Rope) -> Iterator[Leaf]:
    stack = [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, Leaf):
            yield r
        else:
            stack += [r.right, r.left]


def text_of(rope: Rope) -> bytes:
    return b"".join(x.text for x in leaves(rope))


def find(rope: Rope, what: bytes) -> int:
    """Code points before the first occurrence of a few ASCII characters, or -1; leaves are read one by one with the end of those before."""
    tail, before = b"", 0
    for leaf in leaves(rope):
        here = tail + bytes(leaf.text)
        at = here.find(what)
        if at >= 0:
            return before - len(_heads(tail)) + len(_heads(here[:at]))
        before += leaf.chars
        tail = here[len(here) - min(len(here), len(what) - 1) :]
    return -1


def _heads(raw: bytes) -> bytes:
    return bytes(b for b in raw if b & 0xC0 != 0x80)
