"""Byte-pair vocabularies: which token ends each prefix, and which tokens may stand side by side.

The encoding of every prefix of a word ends in exactly one token: the longest vocabulary suffix that
is *compatible* with the last token of the prefix before it. Two tokens are compatible if merging
their concatenation gives those two tokens back. Both the counting transducer and the prefix-table
encoder rest on that fact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Sequence


#: Answers kept.
KEPT_PAIRS = 300_000


def merge_symbols(symbols: Sequence[str], rank: Callable[[str, str], float | None]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging by definition, the best-ranked and then leftmost pair first; and the last pair merged."""
    parts: list[str | None] = list(symbols)
    left = list(range(-1, len(parts) - 1))
    right = [*range(1, len(parts)), -1]
    heap: list = []
    last = None

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0:
            r = rank(parts[i], parts[right[i]])
            if r is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[right[i]]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else -1
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        last = a, b
        parts[i], parts[j] = a + b, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [p for p in parts if p is not None], last


class Vocabulary:
    """Tokens in the order of their merges, and the answers to "may b follow a?"."""

    def __init__(self, merged: Iterable[str], pairs: Callable[[str], Iterable[tuple[str, str]]], singles: Iterable[str]):
        """merged: tokens of two or more symbols, best rank first; pairs(t): the pairs that merge to t."""
        order = [*dict.fromkeys(singles)]
        self.first_merged = len(order)
        order += merged
        self.rank = {t: i for i, t in enumerate(order)}
        self.names = order
        by_pair = {(a, b): self.rank[t] for t in order[self.first_merged :] for a, b in pairs(t) if a in self.rank and b in self.rank}
        #: Pairs are keyed by first << 16 | second.
        self.merges = {self.rank[a] << 16 | self.rank[b]: r for (a, b), r in by_pair.items()}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(order))]
        self.reachable = set(order[: self.first_merged])
        for t in order[self.first_merged :]:
            parts, last = merge_symbols(t, lambda a, b: by_pair.get((a, b)))
            if parts == [t]:
                a, b = (self.rank[x] for x in last)
                if max(a, b) >= self.rank[t]:
                    raise ValueError(f"{t!r} merges before its parts")
                self.reachable.add(t)
                self.split[self.rank[t]] = a, b
        if len(order) > 1 << 16:
            raise ValueError("more tokens than a pair's key has room for")
        self.known: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens of ranks a and b stay apart: their edges are taken back merge by merge."""
        key = a << 16 | b
        answer = self.known.get(key)
        if answer is None:
            if len(self.known) > KEPT_PAIRS:
                self.known.clear()
            answer = self.known[key] = self._apart(a, b)
        return answer

    def _apart(self, a: int, b: int) -> bool:
        merges, split, singles = self.merges, self.split, self.first_merged
        limit = len(split) + 1
        while True:
            joined = merges.get(a << 16 | b)
            if joined is not None and joined < limit:
                return False
            # the later merge is undone first; of equal ones the right-hand one
            if a >= singles and (a > b or b < singles):
                limit, a = a, split[a][1]
            elif b >= singles:
                limit, b = b + 1, split[b][0]
            else:
                return True
