"""Spans in texts: finding with checks, digests of span lists, and what a list of spans leaves free."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

#: (kind, start, end) in code points, end exclusive
Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Covered:
    """The union of spans as sorted intervals that do not touch; each question is one binary search."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k == len(self.starts) or self.starts[k] >= end

    def gaps(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """What of start to end no interval covers."""
        k = bisect.bisect_right(self.ends, start)
        while k < len(self.starts) and self.starts[k] < end:
            if start < self.starts[k]:
                yield start, self.starts[k]
            start = self.ends[k]
            k += 1
        if start < end:
            yield start, end

    def take(self, start: int, end: int) -> bool:
        """Adds a span if it is free."""
        k = bisect.bisect_right(self.ends, start)
        if k < len(self.starts) and self.starts[k] < end:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True
