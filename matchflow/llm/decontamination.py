"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: wherever the item occurs within
its budget, at least one piece occurs unchanged. An automaton over all pieces finds those places in one
pass over a document. Myers' bit-parallel algorithm then verifies: j neighbouring pieces have a budget
of j - 1 edits, so a hit must hold within its half, its quarter and so on up to the whole item (if j
pieces hold j - 1 edits or fewer, one of their halves is within its own budget too). Chance hits end
after a few characters; for the others it finds the least edit distance of the whole item to any part
of the window.

Both sides are lower-cased and white space runs become one space first; positions are of that text.
Results: a null or blank document has no leaks, a null or blank item matches nothing, items with the
same text are all reported, repeated documents each get their leaks; an empty table gives no rows, an empty benchmark no
leaks; texts of any length are searched whole; other columns are not read. Items are taken in blocks of at
most BLOCK_CHARS characters, so what is sent to executors at once has a fixed bound, whatever the size
of the benchmark; a longer single item is a block of its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import in_pandas

#: Edits allowed per character of an item.
ERROR_RATE = 0.1
BLOCK_CHARS = 4_000_000
#: Characters of documents that meet one block after another, where there are several.
SLAB_CHARS = 64_000_000

LEAKS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item, or neighbouring pieces of one, ready for Myers' algorithm."""

    def __init__(self, item: str, budget: int):
        self.item, self.size, self.budget = item, len(item), budget
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i

    def best(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """Least distance within the budget of the item to a part of text[begin:end], and where that part ends."""
        exact = text.find(self.item, begin, end)
        if exact >= 0:
            return 0, exact + self.size
        size, masks = self.size, self.masks
        every, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score, found = every, 0, size, None
        most = self.budget
        for at in range(begin, end):
            same = masks.get(text[at], 0)
            across = same | minus
            same = (((same & plus) + plus) ^ plus) | same
            up = minus | ~(same | plus)
            down = plus & same
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up <<= 1
            down <<= 1
            plus = (down | ~(across | up)) & every
            minus = up & across & every
            if score <= most:
                found, most = (score, at + 1), score - 1
                if most < 0:
                    break
            elif score - most > end - at - 1:  # it can fall by one a character
                break
        return found


def climbs(item: str, cut: list[tuple[int, str]]) -> list[list[tuple[int, Pattern]]]:
    """For each piece, the parts that hold it, smallest first, without the whole item: (offset, pattern)."""
    out: list[list[tuple[int, Pattern]]] = [[] for _ in cut]
    ends = [offset + len(piece) for offset, piece in cut]

    def split(a: int, b: int) -> None:
        if b - a > 1:
            half = (a + b + 1) // 2
            split(a, half)
            split(half, b)
            if b - a < len(cut):
                part = cut[a][0], Pattern(item[cut[a][0] : ends[b - 1]], b - a - 1)
                for k in range(a, b):
                    out[k].append(part)

    split(0, len(cut))
    return out


class Matcher:
    """The automaton and patterns of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids: list[int] = []
        self.patterns: list[Pattern] = []
        #: Of each piece: the item, the piece's offset, and the larger and larger parts to verify below the whole item.
        places: dict[str, list[tuple[int, int, list[tuple[int, Pattern]]]]] = defaultdict(list)
        for item_id, item in items:
            k = len(self.patterns)
            pattern = Pattern(item, int(len(item) * rate))
            self.ids.append(item_id)
            self.patterns.append(pattern)
            cut = pieces(item, pattern.budget)
            for (offset, piece), parts in zip(cut, climbs(item, cut), strict=True):
                places[piece].append((k, offset, parts))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[dict]:
        """The best match of each item in a normal text."""
        if not text or not self.patterns:
            return []
        windows: dict[int, list[list[int]]] = {}
        for at, (size, places) in self.automaton.iter(text):
            for k, offset, parts in places:
                pattern = self.patterns[k]
                zero = at + 1 - size - offset
                begin, end = zero - pattern.budget, zero + pattern.size + pattern.budget
                spans = windows.get(k)
                if spans and spans[-1][0] <= begin and end <= spans[-1][1]:
                    continue
                if all(part.best(text, max(0, zero + o - part.budget), min(len(text), zero + o + part.size + part.budget)) for o, part in parts):
                    if spans and begin <= spans[-1][1]:  # the same place, from another piece
                        spans[-1] = [min(begin, spans[-1][0]), max(end, spans[-1][1])]
                    else:
                        windows.setdefault(k, []).append([begin, end])
        out = []
        for k in sorted(windows):
            pattern = self.patterns[k]
            best = min((found for a, b in windows[k] if (found := pattern.best(text, max(0, a), min(len(text), b)))), default=None)
            if best:
                out.append({"item_id": self.ids[k], "distance": best[0], "start": max(0, best[1] - pattern.size), "end": best[1]})
        return out


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalised, in blocks of bounded size; one block at a time is in memory."""
    block, size = [], 0
    rows = benchmark.select("item_id", "text").where("item_id is not null and length(trim(text)) > 0").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        item = normal(text)
        if not item:
            continue
        if block and size + len(item) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, item))
        size += len(item)
    if block:
        yield block


def released(block: Broadcast, use: Callable[[list[tuple[int, str]]], Matcher]) -> Matcher:
    """What `use` makes of a block, which the worker then forgets: it reads a block from its file again when the next texts meet it."""
    made = use(block.value)
    if getattr(block, "_path", None):
        block.__dict__.pop("_value", None)
    return made


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns in keep, and `leaks`: item_id, distance, start and end of each item found in the text.

    One pass over the documents, one Python stage and no shuffle. With several blocks of items a task
    holds the texts of some batches (SLAB_CHARS, compressed) and meets one block after another, so that one
    block and its automaton at a time are in memory. start is the end less the item's length.
    """
    sent = [docs.sparkSession.sparkContext.broadcast(block) for block in item_blocks(benchmark, block_chars)]
    rows = docs.select(*keep, F.col("text").alias("__text"))
    if not sent:
        return rows.select(*keep, F.array().cast(LEAKS).alias("leaks"))

    def slabs(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
        slab, size = [], 0
        for pdf in batches:
            whole = [normal(t) for t in pdf.pop("__text")]
            size += sum(map(len, whole))
            pdf["__packed"] = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in whole]
            pdf["leaks"] = [[] for _ in whole]
            slab.append(pdf)
            if size > SLAB_CHARS:
                yield slab
                slab, size = [], 0
        if slab:
            yield slab

    def one_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = released(sent[0], lambda items: Matcher(items, rate))
        for pdf in batches:
            pdf["leaks"] = [matcher.leaks(normal(t)) for t in pdf.pop("__text")]
            yield pdf

    def all_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for slab in slabs(batches):
            for block in sent:
                matcher = released(block, lambda items: Matcher(items, rate))
                for pdf in slab:
                    for leaks, packed in zip(pdf["leaks"], pdf["__packed"], strict=True):
                        leaks += matcher.leaks(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
            yield from (pdf.drop(columns="__packed") for pdf in slab)

    return in_pandas(rows, one_block if len(sent) == 1 else all_blocks, keep, f"leaks {LEAKS}")
