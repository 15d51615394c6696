"""Suffix automata over sequences of symbols, with the number of places of each substring."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Of several strings; a substring never runs from one into the next.

    Strings are joined by separators that occur nowhere else, so each state's count is the number of places
    where its substrings end.
    """

    def __init__(self, strings: Sequence[Sequence[int]]):
        total = sum(len(s) + 1 for s in strings)
        step: list[dict] = [{}]
        link, length, count = [-1], [0], [0]
        last = 0
        for i, string in enumerate(strings):
            for c in (*string, ("end", i)):
                cur = len(step)
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(1)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        clone = len(step)
                        step.append(step[q].copy())
                        link.append(link[q])
                        length.append(length[p] + 1)
                        count.append(0)
                        while p >= 0 and step[p].get(c) == q:
                            step[p][c] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur
        by_length: list[list[int]] = [[] for _ in range(total + 1)]
        for v, n in enumerate(length):
            by_length[n].append(v)
        for states in reversed(by_length[1:]):
            for v in states:
                count[link[v]] += count[v]
        self.step, self.link, self.length, self.count = step, link, length, count

    def matching(self, string: Sequence[int], most: int):
        """Matching statistics, cut at `most`: at each symbol, the length of the longest substring that ends there
        and occurs in the automaton, and in how many places that substring (of `most` symbols at most) occurs."""
        step, link, length, count = self.step, self.link, self.length, self.count
        v, n = 0, 0
        for c in string:
            while v and c not in step[v]:
                v = link[v]
                n = length[v]
            if c in step[v]:
                v, n = step[v][c], n + 1
            if n >= most:
                n = most
                while length[link[v]] >= most:
                    v = link[v]
            yield n, count[v]
