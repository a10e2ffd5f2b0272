"""SentencePiece encoding and decoding by a merge-type prefix table.

A text becomes units: runs of the space mark with the word behind them. No piece of the vocabulary has
a mark after another character, so no merge crosses from one unit to the next. Within a unit the table
holds, for each prefix, the unique last piece: of the automaton's matches that end there, the longest
that the last piece of the prefix before it is compatible with. Ids are recovered backwards from the
end of the table; characters without a piece become their bytes.

Results: a null text counts as empty and gives the end id alone; repeated ids give repeated rows; an empty table
gives none; the table is unique for each prefix, so there are no ties; columns besides doc_id and text (and
those to be kept) are not read. The table of a unit is forgotten behind it; only short units are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.bpe_automaton import Vocabulary
from matchflow.llm.common import in_pandas, texts

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Units whose ids a worker remembers, each of at most so many letters.
KEPT_UNITS, KEPT_LETTERS = 300_000, 48


class PieceWriter:
    """The bytes of each id: all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        name = model.id_to_piece
        kinds = ((model.is_control, lambda i: b""), (model.is_unknown, lambda i: " ⁇ ".encode()), (model.is_byte, lambda i: bytes([int(name(i)[3:5], 16)])), (lambda i: True, lambda i: name(i).replace(MARK, " ").encode()))
        self.written = [next(write(i) for fits, write in kinds if fits(i)) for i in range(model.vocab_size())]

    def decode(self, ids: list[int]) -> str:
        """Pieces written out; the mark put before the text is taken off again."""
        whole = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole[:1] == " " else whole


class PieceTable:
    """The vocabulary of a .model file with its prefix tables. The library only reads the file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        names = [model.id_to_piece(i) for i in size]
        normal = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {names[i]: model.get_score(i) for i in normal}
        if any(x != MARK and y == MARK for n in scores for x, y in zip(n, n[1:], strict=False)):
            raise ValueError("pieces of this vocabulary cross words")
        self.ids = {names[i]: i for i in normal}
        self.bytes = {int(names[i][3:5], 16): i for i in size if model.is_byte(i)}
        self.end, self.unknown = model.eos_id(), model.unk_id()
        singles = sorted(n for n in scores if len(n) == 1)
        merged = sorted((n for n in scores if len(n) > 1), key=lambda n: -scores[n])
        self.vocabulary = Vocabulary(merged, lambda t: [(t[:k], t[k:]) for k in range(1, len(t))], singles)
        ranks = self.vocabulary.rank
        self.automaton = ahocorasick.Automaton()
        for piece in self.vocabulary.reachable:
            self.automaton.add_word(piece, (ranks[piece], len(piece)))
        self.automaton.make_automaton()
        #: By rank: the id, and the length in characters.
        self.by_rank = [(self.ids[n], len(n)) for n in self.vocabulary.names]
        self.units: dict[str, tuple[int, ...]] = {}

    def last_pieces(self, unit: str) -> list[int]:
        """The prefix table: entry k is the rank of the last piece of the first k characters, -1 if that is a character without a piece."""
        table = [-1] * (len(unit) + 1)
        known, compatible = self.vocabulary.known.get, self.vocabulary.compatible
        done = 0
        for at, (piece, size) in self.automaton.iter(unit):  # of the matches that end at a place, the longest comes first
            if at < done:
                continue
            start = at + 1 - size
            before = table[start]
            if before < 0 or (ok if (ok := known(before << 16 | piece)) is not None else compatible(before, piece)):
                table[at + 1], done = piece, at + 1
        return table

    def unit(self, unit: str) -> tuple[int, ...]:
        table, at, out = self.last_pieces(unit), len(unit), []
        while at:
            rank = table[at]
            if rank >= 0:
                i, size = self.by_rank[rank]
                out.append(i)
                at -= size
            else:
                at -= 1
                out += [self.bytes[b] for b in reversed(unit[at].encode())] if self.bytes else [self.unknown]
        if len(self.units) > KEPT_UNITS:
            self.units.clear()
        ids = tuple(reversed(out))
        if len(unit) <= KEPT_LETTERS:
            self.units[unit] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if text:
            known, make, add = self.units.get, self.unit, out.extend
            for unit in UNIT.findall(MARK + text.replace(" ", MARK)):
                add(known(unit) or make(unit))
        out.append(self.end)
        return out


_tables: dict[str, PieceTable] = {}
_writers: dict[str, PieceWriter] = {}


def piece_table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def piece_writer(path: str) -> PieceWriter:
    if path not in _writers:
        _writers[path] = PieceWriter(path)
    return _writers[path]


def encode_pieces(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, and ids (array of int, the end id last). One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = piece_table(model_path)
        for pdf in batches:
            pdf["ids"] = [table.encode(t) for t in pdf["__text"]]
            yield pdf[[*names, "ids"]]

    names = ["doc_id", *keep]
    return in_pandas(docs.select(*names, F.coalesce("text", F.lit("")).alias("__text")), run, names, "ids array<int>")


def decode_pieces(df: DataFrame, model_path: str) -> DataFrame:
    """df with `decoded`, the text of its ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = piece_writer(model_path)
        for pdf in batches:
            pdf["decoded"] = [writer.decode(i) for i in pdf.ids]
            yield pdf

    return in_pandas(df, run, df.columns, "decoded string")


def pieces_round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and decoded in one pass: what decode_pieces gives for encode_pieces, without ids going back and forth between workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, writer = piece_table(model_path), piece_writer(model_path)
        for pdf in batches:
            ids = [table.encode(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "ids": ids, "decoded": [writer.decode(i) for i in ids]})

    return in_pandas(texts(docs), run, ("doc_id",), "ids array<int>, decoded string")
