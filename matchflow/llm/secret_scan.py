"""Secret scanning: a keyword automaton, anchored patterns at its hits, and checksums.

One Aho-Corasick pass over a text finds keyword hits; a pattern is tried only where a hit begins, so the
patterns never run over the rest. Lower-case hexadecimal runs have no keyword and are found by their
character class. Keys of the forms that carry a checksum (a base-62 CRC-32 in the last six characters)
are reported only if it agrees.

Results: positions are code points, ends exclusive; spans come by start, then by kind in the order of
KINDS (so ties at a start are in a fixed order). A null text counts as empty and has no spans; texts of any
length are scanned whole; repeated ids give repeated rows; an empty table gives none; columns that are not
asked for are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import in_pandas

KINDS = ("assign", "access", "hex", "forge", "registry")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KEYWORDS = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access"} | {f"gh{c}_": "forge" for c in "pousr"} | {"npm_": "registry"}

SPANS = "array<struct<kind:string,start:int,end:int>>"


def checksum(body: str) -> str:
    """CRC-32 of the key's body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lower-cased
        low = text.translate(ASCII_LOWER)
    found: list[tuple[int, int, str, int]] = []
    hits = sorted((at + 1 - size, kind) for at, (kind, size) in automaton.iter(low))
    done = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                done[kind] = m.end()
                if len(m[2]) >= ASSIGN_LEAST:
                    found.append((start, 0, kind, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= ACCESS_LEAST:
                    found.append((start, 1, kind, m.end()))
        elif m := CHECKED.match(text, start):
            if checksum(m[1]) == m[2]:
                done[kind] = m.end()
                found.append((start, KINDS.index(kind), kind, m.end()))
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and `spans`. One pass over whole texts, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = keyword_automaton()
        for pdf in batches:
            pdf["spans"] = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, automaton)] if t else [] for t in pdf["__text"]]
            yield pdf[[*keep, "spans"]]

    return in_pandas(docs.select(*keep, F.col("text").alias("__text")), run, keep, f"spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column | str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def masked(found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """found with the characters of its spans replaced in text, overlapping ones by one mask, and n_chars counted anew."""
    text, start = F.col("text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, span: Column) -> Column:
        opens = F.concat(text.substr(so_far["at"] + 1, span["start"] - so_far["at"]), F.lit(mask))
        longer = F.struct(F.greatest(so_far["at"], span["end"]).alias("at"), F.concat(so_far["out"], F.when(span["start"] >= so_far["at"], opens).otherwise("")).alias("out"))
        return F.when(span["end"] <= so_far["at"], so_far).otherwise(longer)

    rest = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
    clean = found.withColumn("text", F.when(F.size("spans") > 0, rest).otherwise(text))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(found.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
