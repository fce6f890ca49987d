"""A suffix automaton over words, and the matching statistics of a text against it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """All runs of words of the sequences added so far, in space linear in their length."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def add(self, words: Sequence) -> None:
        """Adds one sequence; nothing runs across the end of one into the next."""
        last = 0
        for w in words:
            last = self._known(last, w) if w in self.step[last] else self._extend(last, w)

    def _known(self, at: int, w) -> int:
        to = self.step[at][w]
        return to if self.length[to] == self.length[at] + 1 else self._split(at, w, to)

    def _extend(self, at: int, w) -> int:
        new = self._state(self.length[at] + 1, {}, 0)
        while at != -1 and w not in self.step[at]:
            self.step[at][w] = new
            at = self.link[at]
        if at != -1:
            self.link[new] = self._known(at, w)
        return new

    def _split(self, at: int, w, to: int) -> int:
        """The part of state ``to`` that is reached from ``at`` becomes a state of its own."""
        part = self._state(self.length[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = part
        while at != -1 and self.step[at].get(w) == to:
            self.step[at][w] = part
            at = self.link[at]
        return part

    def statistics(self, words: Sequence) -> Iterator[int]:
        """For each word, how many words up to it occur together in some added sequence."""
        step, link, length = self.step, self.link, self.length
        at = have = 0
        for w in words:
            while at and w not in step[at]:
                at = link[at]
                have = length[at]
            if w in step[at]:
                at = step[at][w]
                have += 1
            else:
                have = 0
            yield have
