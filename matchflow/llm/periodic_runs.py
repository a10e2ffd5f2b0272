"""Periodic runs in texts, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST_WORDS, REPEATS * q) words that
no neighbouring word extends keeping period q. Each of its words stands in it REPEATS times or more, so a word
that occurs less often within a segment belongs to no run in it and splits it. Splitting is repeated for the
segments that changed until all are stable. Surviving segments are scanned at each lag q: sums of powers
compare aligned blocks of q words with the following ones, and where three blocks agree the words q apart are
compared one by one. Blocks within a run of a period that divides q are known already, and are passed over.

Results: words are what white space in ASCII parts; null, empty and blank texts have no runs and collapse to an empty text;
texts of any length are used whole, each in one task's memory; every input row gives one row, repeated ids and
ties included; an empty table gives none; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from matchflow.llm.common import in_pandas, texts

#: A run has at least so many words and so many periods.
LEAST_WORDS, REPEATS = 6, 4
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values."""
    change = np.diff(np.concatenate([[0], on.view(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def surviving_segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """The segments, as (begin, end), in which every word occurs REPEATS times or more."""
    kinds = int(codes.max()) + 1 if len(codes) else 0
    stable: list[tuple[int, int]] = []
    begins, ends = np.array([0]), np.array([len(codes)])
    while len(begins):
        sizes = ends - begins
        segment = np.repeat(np.arange(len(begins)), sizes)
        place = np.arange(sizes.sum()) + np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        if len(begins) == 1:
            often = np.bincount(codes[place], minlength=kinds)[codes[place]] >= REPEATS
        else:
            _, inverse, counts = np.unique(segment * kinds + codes[place], return_inverse=True, return_counts=True)
            often = counts[inverse] >= REPEATS
        whole = np.bincount(segment, weights=~often, minlength=len(begins)) == 0
        stable += zip(begins[whole].tolist(), ends[whole].tolist(), strict=True)
        # the changed segments' parts, a gap between segments
        on = np.zeros(len(codes) + len(begins) + 1, bool)
        on[place + segment] = often & ~whole[segment]
        b, e = stretches(on)
        of = np.searchsorted(begins + np.arange(len(begins)), b, "right") - 1
        long = e - b >= LEAST_WORDS
        begins, ends = (b - of)[long], (e - of)[long]
    return sorted(s for s in stable if s[1] - s[0] >= LEAST_WORDS)


def segment_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in one segment of word codes."""
    n = len(x)
    powers = np.multiply.accumulate(np.full(n, _FACTOR))
    mixed = (x.astype(np.uint64) + np.uint64(1)) * _MIX
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * powers)])
    found: dict[tuple[int, int], int] = {}
    for q in range(1, n // REPEATS + 1):
        blocks = np.diff(sums[::q])
        alike = blocks[1:] == blocks[:-1] * powers[q - 1]
        at = np.flatnonzero(alike[1:] & alike[:-1]) * q
        for (start, end), period in found.items() if len(at) else ():
            if q % period == 0:
                at = at[(at < start) | (at + 3 * q > end)]
        if len(at):
            b, e = stretches(x[:-q] == x[q:])
            long = e - b + q >= max(LEAST_WORDS, REPEATS * q)
            for start, end in zip(b[long].tolist(), (e[long] + q).tolist(), strict=True):
                found.setdefault((start, end), q)
    return [(start, end - start, q) for (start, end), q in found.items()]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(words) - len(known) < LEAST_WORDS - 2:  # the fewest repeated words that a run has
        return []
    return sorted(((b + s, n, q) for b, e in surviving_segments(codes) for s, n, q in segment_runs(codes[b:e])), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run contains behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period) and the collapsed text. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs, kept = [], []
            for text in pdf.text:
                words = text.encode().split()  # split() of bytes parts at ASCII white space only
                found = word_runs(words)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(collapsed(words, found).decode())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "runs": runs, "collapsed": kept})

    return in_pandas(texts(docs), run, ("doc_id",), "runs array<struct<start: long, length: long, period: long>>, collapsed string")
