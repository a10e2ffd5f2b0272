"""Token counts by finite-state tokenizer compilation.

Two deterministic machines replace the tokenizer:

* the *word machine* has eight states over eight character classes; each of its transitions says
  whether a pre-token starts there. A text is cut into equal chunks, each chunk becomes its state map
  (the exit state for every entry state), the maps compose through a parallel prefix scan, and a second
  pass marks the starts from the entry states so found;
* the *merge machine* reads the bytes of one pre-token; its states hold the last tokens of the prefixes
  that a vocabulary entry may still reach back to, and each transition is annotated with the change in
  emitted tokens. Its states are determinised when first reached and forgotten together at a limit.

Results: a null text counts as empty (0 bytes, 0 tokens); a special string inside a text is one token,
as the library's default has it; repeated ids give repeated rows; an empty table gives none; texts of any length are
counted whole, in slabs; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.bpe_automaton import Vocabulary
from matchflow.llm.common import in_pandas, texts

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_RUN, LAST_SPACE, LAST_WHITE = range(8)
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, ATTACHING, ONE_MORE, TWO_MORE = range(8)
STATES = 8
#: Symbols are a class, plus FRESH at the first character of a text.
FRESH = 8
CHUNK = 256
SLAB = 4_000_000
KEPT_STATES = 400_000
#: Words whose counts a worker remembers, each of at most so many letters.
KEPT_WORDS, KEPT_LETTERS = 600_000, 48


def _word_machine() -> tuple[np.ndarray, np.ndarray]:
    """next state and "a pre-token starts here", both indexed by state * 16 + symbol."""
    goes, starts = np.zeros((STATES, 16), np.uint8), np.zeros((STATES, 16), np.uint8)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE_RUN: IN_SPACES}
    for state in range(STATES):
        for symbol in range(8):
            if state in (ONE_MORE, TWO_MORE):  # the letters of 's, 're, ...
                goes[state, symbol], starts[state, symbol] = (DONE if state == ONE_MORE else ONE_MORE), 0
            elif symbol in (LAST_SPACE, LAST_WHITE):
                goes[state, symbol], starts[state, symbol] = (ATTACHING if symbol == LAST_SPACE else DONE), 1
            elif symbol in (SHORT, LONG):
                joins = state in (IN_OTHERS, ATTACHING)
                goes[state, symbol] = IN_OTHERS if joins else (ONE_MORE if symbol == SHORT else TWO_MORE)
                starts[state, symbol] = not joins
            else:
                goes[state, symbol] = run[symbol]
                starts[state, symbol] = not (state == run[symbol] or state == ATTACHING and symbol != SPACE_RUN)
    goes[:, FRESH:], starts[:, FRESH:] = goes[DONE, :8], 1
    return goes.ravel(), starts.ravel()


GOES, STARTS = _word_machine()


def character_classes() -> np.ndarray:
    """Class of every code point: letters, numbers, white space (SPACE_RUN), the rest."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_RUN, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            kinds[a:b] = kind
    return kinds


def symbols(codes: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Machine symbols of code points; first: marks the first code point of each text."""
    out = kinds[codes]
    n = len(codes)
    white = out == SPACE_RUN
    # what follows within the same text
    inside = np.zeros(n, bool)
    inside[:-1] = ~first[1:]
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:]
    last = white & inside & follows
    out[last] = np.where(codes[last] == 32, LAST_SPACE, LAST_WHITE)
    quotes = np.flatnonzero((codes == 39) & inside)
    if len(quotes):
        one = codes[quotes + 1]
        two = np.zeros_like(one)
        far = quotes + 2 < n
        far[far] = ~first[quotes[far] + 2]
        two[far] = codes[quotes[far] + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[pair]] = LONG
    return out + FRESH * first.astype(np.uint8)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2 steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def pretoken_starts(syms: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens start, by chunk maps, their scan, and one marking pass."""
    n = len(syms)
    lanes = -(-n // chunk)
    grid = np.zeros(lanes * chunk, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for row in grid:
        maps = GOES[maps * np.uint8(16) + row[:, None]]
    state = np.full(lanes, DONE, np.uint8)
    state[1:] = scan(maps)[:-1, DONE]
    marks = np.empty((chunk, lanes), np.uint8)
    for k, row in enumerate(grid):
        at = state * np.uint8(16) + row
        marks[k] = STARTS[at]
        state = GOES[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class MergeMachine:
    """The lazily determinised transducer of a byte-level vocabulary: words in, token counts out."""

    def __init__(self, vocabulary: Vocabulary, letters: list[str]):
        self.vocabulary, self.letters = vocabulary, letters
        self.ranks = {t: vocabulary.rank[t] for t in vocabulary.reachable}
        self.prefixes = {t[:k] for t in self.ranks for k in range(len(t) + 1)}
        self.forget()

    def forget(self) -> None:
        start = ("", (-1,), (0,))
        self.ids, self.states = {start: 0}, [start]
        #: state * 256 + byte: next state * 256 + change + 128
        self.arcs: dict[int, int] = {}

    def arc(self, state: int, byte: int) -> int:
        """The next state, and the change in the number of tokens, on reading a byte.

        A state is the longest suffix read that starts some token, with the last token and the
        relative token count at each position inside it; -1 is the start of the word.
        """
        suffix, lasts, counts = self.states[state]
        read, ranks, compatible = suffix + self.letters[byte], self.ranks, self.vocabulary.compatible
        for k in range(len(read)):
            token = ranks.get(read[k:])
            if token is not None and (lasts[k] < 0 or compatible(lasts[k], token)):
                break
        else:
            raise ValueError(f"no token ends in byte {byte}")
        change = counts[k] + 1
        cut = 0
        while read[cut:] not in self.prefixes:
            cut += 1
        new = (read[cut:], (*lasts[cut:], token), (*[c - change for c in counts[cut:]], 0))
        arc = self.arcs[state << 8 | byte] = self.number(new) << 8 | change + 128
        return arc

    def number(self, state: tuple) -> int:
        n = self.ids.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def count(self, word: str) -> int:
        state = total = 0
        for first in range(0, len(word), KEPT_STATES // 8):  # a letter has four bytes at most, and a byte makes a state at most
            if len(self.states) > KEPT_STATES:
                here = self.states[state]
                self.forget()
                state = self.number(here)
            known = self.arcs.get
            for byte in word[first : first + KEPT_STATES // 8].encode():
                arc = known(state << 8 | byte) or self.arc(state, byte)
                state = arc >> 8
                total += (arc & 255) - 128
        return total


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class CompiledTokenizer:
    """Counts tokens of whole texts by the two machines."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in said["model"]["merges"]]
        pair = {a + b: (a, b) for a, b in merges}
        vocabulary = Vocabulary((a + b for a, b in merges), lambda t: [pair[t]], byte_letters())
        self.machine = MergeMachine(vocabulary, byte_letters())
        self.specials = [t["content"] for t in said["added_tokens"] if t["content"]]
        self.kinds = character_classes()
        self.words: dict[str, int] = {}

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of those it has."""
        parts = [text]
        for special in self.specials:
            if special in text:
                parts = [x for p in parts for x in p.split(special)]
        return parts, len(parts) - 1

    def word(self, word: str) -> int:
        n = self.machine.count(word)
        if len(word) <= KEPT_LETTERS:
            self.words[word] = n
        return n

    def counts(self, batch: list[str]) -> np.ndarray:
        out = np.zeros(len(batch), np.int64)
        waiting: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(batch):
            parts, special = self.segments(text)
            out[i] += special
            for part in parts:
                if part:
                    waiting.append((i, part))
                    size += len(part)
                    if size > SLAB:
                        self._slab(waiting, out)
                        waiting, size = [], 0
        if waiting:
            self._slab(waiting, out)
        return out

    def _slab(self, segments: list[tuple[int, str]], out: np.ndarray) -> None:
        whole = "".join(s for _, s in segments)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0, *(len(s) for _, s in segments)])[:-1]
        first = np.zeros(len(codes), bool)
        first[begins] = True
        starts = pretoken_starts(symbols(codes, first, self.kinds))
        ends = np.append(starts[1:], len(codes))
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words.get
        each = np.fromiter(((n if (n := known(w := whole[a:b])) is not None else self.word(w)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        sums = np.add.reduceat(each, np.searchsorted(starts, begins))
        np.add.at(out, [i for i, _ in segments], sums)


_compiled: dict[str, CompiledTokenizer] = {}


def compiled(path: str) -> CompiledTokenizer:
    if path not in _compiled:
        _compiled[path] = CompiledTokenizer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; one pass, no shuffle.

    The file at tokenizer_path has to be at that path on every executor, as the library's own is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = compiled(tokenizer_path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": pdf.n_bytes, "n_tokens": machine.counts(pdf.text.tolist())})

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return in_pandas(rows, run, ("doc_id", "n_bytes"), "n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
