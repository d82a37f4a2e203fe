"""Suffix automata and matching statistics: the method that problem 10 names, kept to check the one in use and to measure.

An automaton of a reference text recognises its substrings; streaming another text through it gives, at each place, the
length of the longest substring of the reference that ends there. ``README`` has the figures why the corpus is not run
through broadcast automata: states and bytes a character, and seconds a gigabyte, of one shard alone.
"""

from __future__ import annotations


class SuffixAutomaton:
    """States as parallel lists: length of the longest string, suffix link, transitions."""

    def __init__(self, text: str = ""):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.last = 0
        for c in text:
            self.add(c)

    def add(self, c: str) -> None:
        new = len(self.length)
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        self.next.append({})
        p = self.last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[p] + 1 == self.length[q]:
                self.link[new] = q
            else:  # the strings that end here as well as after c get a state of their own
                twin = len(self.length)
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                self.next.append(dict(self.next[q]))
                self.link[q] = self.link[new] = twin
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
        self.last = new

    def statistics(self, text: str) -> list[int]:
        """For each place the length of the longest substring of the reference that ends there."""
        out, state, n = [], 0, 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            out.append(n)
        return out


def covered(texts: list[str], span: int) -> list[int]:
    """Characters of each text in spans of ``span`` and more that stand in another text: each against all others."""
    ends = [SuffixAutomaton(t) for t in texts]
    out = []
    for i, t in enumerate(texts):
        most = [0] * len(t)
        for j, a in enumerate(ends):
            if i != j:
                most = [max(x, y) for x, y in zip(most, a.statistics(t), strict=True)]
        inside = [False] * len(t)
        for at, n in enumerate(most):
            if n >= span:
                inside[at - n + 1 : at + 1] = [True] * n
        out.append(sum(inside))
    return out
