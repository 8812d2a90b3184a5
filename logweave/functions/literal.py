"""Templates matched by their literal segments, in time linear in the body, as greedy values would be captured."""

from __future__ import annotations

import re
from itertools import groupby

#: A piece of a pattern that stands for one character or place.
_PIECE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[0-7]{1,3}|\\.|[^\\]", re.S)
_VALUE = "(.+)"
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
_CLASSES, _PLACES = frozenset("wWdDsS"), frozenset("bBAZ")


def _decoded(piece: str) -> str | None:
    """The character that a piece stands for, None if it is a class or a place, ValueError if it refers to a value."""
    if len(piece) == 1:
        return piece
    kind = piece[1]
    if kind in "xuU" and len(piece) > 2:
        return chr(int(piece[2:], 16))
    if kind.isdigit():
        if kind != "0" and len(piece) < 4:
            raise ValueError(piece)
        return chr(int(piece[1:], 8))
    if kind in _CONTROL:
        return _CONTROL[kind]
    if kind in _CLASSES or kind in _PLACES:
        return None
    if kind.isalnum():
        raise ValueError(piece)
    return kind


class Segment:
    """What stands between two values: literal text, or a pattern of fixed width where it has classes or places."""

    __slots__ = ("pattern", "runs", "text", "width")

    def __init__(self, source: str) -> None:
        if "\\" not in source:
            self.width, self.runs, self.text, self.pattern = len(source), [source] if source else [], source, None
            return
        pieces = [(p, _decoded(p)) for p in _PIECE.findall(source)]
        self.width = sum(c is not None or p[1] in _CLASSES for p, c in pieces)
        #: Stretches of literal text.
        self.runs = ["".join(c for _, c in run) for fixed, run in groupby(pieces, lambda x: x[1] is not None) if fixed]
        literal = all(c is not None for _, c in pieces)
        self.text = "".join(self.runs) if literal else None
        self.pattern = None if literal else re.compile(source, re.S)

    def at(self, body: str, place: int) -> bool:
        return body.startswith(self.text, place) if self.pattern is None else self.pattern.match(body, place) is not None

    def last(self, body: str, low: int, high: int) -> int:
        """The last place from low on at which the segment lies before high, -1 if there is none."""
        if self.pattern is None:
            return body.rfind(self.text, low, high) if low <= high else -1
        return next((k for k in range(high - self.width, low - 1, -1) if self.pattern.match(body, k)), -1)


def literals(executable: str) -> list[str]:
    """The stretches of literal text of an executable pattern."""
    if "\\" not in (inner := _inner(executable)):
        return [x for x in inner.split(_VALUE) if x]
    return Matcher(executable).literals()


def _inner(executable: str) -> str:
    return executable.removeprefix("(?s)").removeprefix("\\A").removesuffix("\\z")


class Matcher:
    """An executable pattern, matched from its end: each segment takes its last place before the one that follows.

    That gives every value the length that a greedy search from the left would give it, without backtracking. Patterns
    that refer to an earlier value (a template with an escaped digit) are left to the regex library.
    """

    __slots__ = ("pattern", "segments")

    def __init__(self, executable: str) -> None:
        self.pattern = None
        try:
            self.segments = [Segment(x) for x in _inner(executable).split(_VALUE)]
        except ValueError:
            self.segments = []
            self.pattern = re.compile(executable.removesuffix("\\z") + "\\Z")

    def literals(self) -> list[str]:
        """The stretches of literal text, none if the segments aren't known."""
        return [r for s in self.segments for r in s.runs]

    def values(self, body: str) -> list[str] | None:
        """The values that the body has for the template, None if it doesn't fit."""
        if self.pattern is not None:
            m = self.pattern.match(body)
            return list(m.groups()) if m else None
        first = self.segments[0]
        if len(self.segments) == 1:
            return [] if len(body) == first.width and first.at(body, 0) else None
        low, high = first.width, len(body) - self.segments[-1].width
        if high <= low or not first.at(body, 0) or not self.segments[-1].at(body, high):
            return None
        out = []
        for segment in self.segments[-2:0:-1]:
            # A value has one character at least.
            at = segment.last(body, low + 1, high - 1)
            if at < 0:
                return None
            out.append(body[at + segment.width : high])
            high = at
        out.append(body[low:high])
        return out[::-1]
