"""Runs that a question shares with texts, by a suffix automaton of the question."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """All substrings of some segments, in time and memory that go with their length, and how much of each was met in texts."""

    def __init__(self, segments: Iterable[str]):
        self._next: list[dict[str, int]] = [{}]
        self._link, self._size = [-1], [0]
        last = 0
        for c in "\n".join(segments):
            last = self._extend(last, c)
        self._met = [0] * len(self._size)

    def _extend(self, last: int, c: str) -> int:
        new = self._state({}, 0, self._size[last] + 1)
        p = last
        while p >= 0 and c not in self._next[p]:
            self._next[p][c] = new
            p = self._link[p]
        if p >= 0:
            q = self._next[p][c]
            if self._size[q] != self._size[p] + 1:
                part = self._state(dict(self._next[q]), self._link[q], self._size[p] + 1)
                self._link[q] = part
                while p >= 0 and self._next[p].get(c) == q:
                    self._next[p][c] = part
                    p = self._link[p]
                q = part
            self._link[new] = q
        return new

    def _state(self, following: dict[str, int], link: int, size: int) -> int:
        self._next.append(following)
        self._link.append(link)
        self._size.append(size)
        return len(self._size) - 1

    def meet(self, text: str) -> None:
        """Notes which substrings stand in the text."""
        at = run = 0
        for c in text:
            while at and c not in self._next[at]:
                at = self._link[at]
                run = self._size[at]
            if c in self._next[at]:
                at, run = self._next[at][c], run + 1
                if run > self._met[at]:
                    self._met[at] = run
            else:
                run = 0

    def spread(self) -> None:
        """What stands in a text stands there with all its suffixes."""
        for s in sorted(range(1, len(self._size)), key=self._size.__getitem__, reverse=True):
            if self._met[s] and self._link[s] > 0:
                self._met[self._link[s]] = self._size[self._link[s]]

    def longest_at(self, segment: str, place: int) -> int:
        """How many characters of the segment from `place` on stand together in one text."""
        at, run = 0, 0
        for i in range(place, len(segment)):
            at = self._next[at][segment[i]]
            if self._met[at] < run + 1:
                break
            run += 1
        return run


def greedy_longest(segments: list[str], texts: Iterable[str | None]) -> int:
    """The longest of the runs of 2 characters or more that a scan from the left takes: at each place the longest that a text has, going on behind it."""
    known = SuffixAutomaton(segments)
    for text in texts:
        if text:
            known.meet(text)
    known.spread()
    best = 0
    for segment in segments:
        at = 0
        while at < len(segment):
            run = known.longest_at(segment, at)
            best = max(best, run if run > 1 else 0)
            at += max(run, 1) if run > 1 else 1
    return best
