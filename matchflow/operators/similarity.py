"""Similar texts of a batch: token sets compared by the parities of hashed tokens, block by block, then by their tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from matchflow.operators.audit import TERM
from matchflow.operators.written import checkpointed

#: Texts of TEXT_BYTES of parities that a block of comparison holds.
TILE, TEXT_BYTES = 8_192, 128
#: Blocks that a large batch is cut into, while they are not larger than BLOCK_BYTES.
BLOCKS, BLOCK_BYTES = 64, 32 << 20
#: Bytes of a text's name.
UNIT = 16
#: Texts of one block of verification.
BLOCK_TEXTS = 2_000
#: So many texts' hashed ids at most are broadcast, so that only texts that may have pairs are shuffled.
NAMED = 500_000


def width(size: int) -> int:
    """Parity bits of a set of that size: half as many again as tokens, as a power of two, so that wide parities fold to narrow ones."""
    return max(64, 1 << (size + size // 2 - 1).bit_length())


def words_of(text: str | None) -> list[str]:
    """The distinct terms of a text, in order."""
    return sorted({t.rstrip("-+&").lower() for t in set(re.findall(TERM, text))}) if text else []


def unit_of(batch: str, words: list[str]) -> bytes:
    """A class's name, that of its batch and its words."""
    return sha256(f"{batch}\u0001{' '.join(words)}".encode()).digest()[:UNIT]


def parities(words: list[str]) -> bytes:
    """Bits that are each the parity of the words whose hash falls on it: two sets' bits differ in no more places than their words do."""
    n = width(len(words))
    hashes = np.fromiter(map(crc32, " ".join(words).encode().split(b" ")), dtype="int64", count=len(words))
    return np.packbits(np.bincount(hashes & (n - 1), minlength=n).astype("uint8") & 1, bitorder="little").tobytes()


def described(batch: Column, text: str) -> Column:
    """Name, size and parities of a text's set of words; without words, nulls."""

    @F.pandas_udf("unit binary, size int, bits binary")
    def of_texts(batches: pd.Series, texts: pd.Series) -> pd.DataFrame:
        sets = [words_of(t) for t in texts]
        rows = [(unit_of(b, w), len(w), parities(w)) if w else (None, None, None) for b, w in zip(batches, sets, strict=True)]
        return pd.DataFrame(rows, columns=["unit", "size", "bits"]).astype({"size": "Int32"})

    return of_texts(batch, text)


def told(batch: Column, text: str) -> Column:
    """Name and words of a text."""

    @F.pandas_udf("unit binary, said string")
    def of_texts(batches: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(unit_of(b, w), " ".join(w)) for b, w in zip(batches, map(words_of, texts), strict=True)], columns=["unit", "said"])

    return of_texts(batch, text)


def packed(classes: DataFrame, least: float) -> DataFrame:
    """Blocks of a batch's classes in the order of their sizes: __b, block, the least and most size, units, sizes and bits in a row.

    A block holds so many bytes, not texts; texts of one size may lie in several blocks.
    """
    order = Window.partitionBy("__b").orderBy("size")
    cells = classes.groupBy("__b", "size").agg(F.sum(F.length("bits") + 2 * UNIT).alias("w"))
    limit = F.least(F.lit(BLOCK_BYTES), F.greatest(F.lit(TILE * TEXT_BYTES), F.ceil(F.sum("w").over(Window.partitionBy("__b")) / BLOCKS)))
    cells = cells.select("__b", "size", "w", (F.sum("w").over(order) - F.col("w")).alias("before"), limit.alias("limit"))
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("unit"), F.col("w"))) / F.col("limit"))
    placed = classes.join(cells, ["__b", "size"]).select("__b", at.cast("long").alias("block"), "unit", "size", "bits")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        sizes = rows["size"].to_numpy("int32")
        return pd.DataFrame([(*key, sizes[0], sizes[-1], b"".join(rows.unit), sizes.tobytes(), b"".join(rows.bits))], columns=["__b", "block", "least", "most", "units", "sizes", "bits"])

    names = {"block": LongType(), "least": IntegerType(), "most": IntegerType(), "units": BinaryType(), "sizes": BinaryType(), "bits": BinaryType()}
    return placed.groupBy("__b", "block").applyInPandas(pack, StructType([classes.schema["__b"], *(StructField(k, v) for k, v in names.items())]))


def by_width(sizes: np.ndarray, bits: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of one width: their start, sizes, and bits as rows of words."""
    widths = np.array([width(int(n)) for n in sizes])
    starts = [0, *(np.flatnonzero(np.diff(widths)) + 1), len(sizes)]
    byte = 0
    for a, b in zip(starts, starts[1:]):
        n = (b - a) * int(widths[a]) // 8
        yield a, sizes[a:b], np.frombuffer(bits, "<u8", n // 8, byte).reshape(b - a, -1)
        byte += n


def folded(words: np.ndarray, n: int) -> np.ndarray:
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def close(small: tuple[np.ndarray, bytes], large: tuple[np.ndarray, bytes] | None, least: float) -> tuple[list[int], list[int]]:
    """Places in both blocks (sizes, bits) of the pairs that sizes and bits allow to be similar; without large, the pairs within small."""
    x, y, share = [], [], least / (1 + least)
    for a, sizes, words in by_width(*(large or small)):
        for b, others, bits in by_width(*small):
            n = min(words.shape[1], bits.shape[1])
            rows, columns = folded(words, n), np.ascontiguousarray(folded(bits, n).T)
            # most pairs are told apart by these words
            first = max(1, n * 5 // 8)
            kind = "uint16" if n < 1024 else "int64"
            for k, (m, row) in enumerate(zip(sizes.tolist(), rows, strict=True)):
                low, high = int(np.searchsorted(others, m * least - 1e-9)), len(others) if large else min(len(others), a + k - b)
                if low >= high:
                    continue
                differ = np.bitwise_count(columns[0, low:high] ^ row[0]).astype(kind)
                for w in range(1, first):
                    differ += np.bitwise_count(columns[w, low:high] ^ row[w])
                found = np.flatnonzero(differ <= (m + int(others[high - 1])) * (1 - 2 * share) + 1e-6)
                if not len(found):
                    continue
                total = m + others[low + found].astype("int64")
                every = differ[found].astype("int64") + np.bitwise_count(columns[first:, low + found] ^ row[first:, None]).sum(axis=0, dtype="int64")
                found = found[every <= total - 2 * np.ceil(total * share - 1e-9)]
                x += [a + k] * len(found)
                y += (b + low + found).tolist()
    return x, y


def close_pairs(classes: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y, m, n) of units (__b, unit, size, bits) of one batch that sizes and bits allow to be similar.

    All texts of like sizes of a batch are compared, but in memory, block by block: blocks are shuffled once for each block that they
    meet, and only pairs within the bounds become rows.
    """
    blocks = checkpointed(packed(classes, least))
    edges = lambda *names: blocks.select("__b", *(F.col(a).alias(b) for a, b in zip(("block", "least", "most"), names, strict=True)))
    met = edges("i", "__0", "most").join(edges("j", "least", "__1"), "__b").filter((F.col("i") <= F.col("j")) & (F.col("most") >= F.col("least") * least - 1e-9))
    tiles = met.select("__b", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = blocks.join(tiles, ["__b", "block"]).select("__b", "i", "j", "block", "units", "sizes", "bits").repartition(tasks, "__b", "i", "j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [(np.frombuffer(r.sizes, "int32"), r.bits, r.units) for r in rows.sort_values("block").itertuples()]
        small, large = sides[0], sides[-1]
        x, y = close(small[:2], large[:2] if len(sides) > 1 else None, least)
        unit = lambda side, k: side[2][k * UNIT : (k + 1) * UNIT]
        return pd.DataFrame({"x": [unit(large, k) for k in x], "y": [unit(small, k) for k in y], "m": large[0][x].astype("int32"), "n": small[0][y].astype("int32")})

    return held.groupBy("__b", "i", "j").applyInPandas(compare, "x binary, y binary, m int, n int")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (x, y, m, n) with `both`, the number of tokens that they share; classes are (__b, unit, first), texts (__b, doc_id, text).

    Texts that have pairs are dealt to blocks by hash. A pair of blocks gets the tokens of each text that has a pair there once, so
    tokens travel once for each block that a text meets, not for each pair.
    """
    pairs = checkpointed(pairs)
    units = checkpointed(pairs.select(F.col("x").alias("unit")).union(pairs.select("y")).distinct().join(classes, "unit"))
    total = units.count()
    blocks = max(1, -(-total // BLOCK_TEXTS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.withColumn("bx", block("x")).withColumn("by", block("y"))
    needed = placed.select("bx", "by", F.col("x").alias("unit")).union(placed.select("bx", "by", "y")).distinct()
    if total <= NAMED:
        ids = units.select(F.xxhash64("__b", "first").alias("__id")).distinct()
        texts = texts.withColumn("__id", F.xxhash64("__b", "doc_id")).join(F.broadcast(ids), "__id", "left_semi").drop("__id")
    asked = texts.join(units.select("__b", F.col("first").alias("doc_id"), F.col("unit").alias("__unit")), ["__b", "doc_id"])
    tokens = asked.select("__unit", told(F.col("__b").cast("string"), "text").alias("t")).filter("t.unit = __unit").select("t.*")
    held = needed.join(tokens, "unit").select(F.col("bx").alias("cx"), F.col("by").alias("cy"), "unit", "said")

    def count(pair_rows: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(texts.unit, (set(said.split(" ")) for said in texts.said), strict=True))
        return pair_rows[["x", "y", "m", "n"]].assign(both=[len(sets[x] & sets[y]) for x, y in zip(pair_rows.x, pair_rows.y, strict=True)])

    return placed.groupBy("bx", "by").cogroup(held.groupBy("cx", "cy")).applyInPandas(count, "x binary, y binary, m int, n int, both int")


def batch_similarity(docs: DataFrame, batch: str, least: float = 0.70) -> DataFrame:
    """Links of a batch's texts whose token sets have a Jaccard similarity of `least` or more: a, b, similarity.

    Texts of equal sets are a class: its first text is linked to each other one (similarity 1), and only first
    texts are linked to those of other classes, so copies never form pairs among themselves. Texts without tokens,
    null texts and texts without a batch have no links.

    A pair of m >= n tokens can only reach the threshold if n >= m * least and no more than m + n - 2 * needed tokens are in one of
    them alone. Parities of hashed tokens, a few bits a token, bound these from below; they alone are shuffled for all texts, and
    the tokens of pairs within the bounds are compared. Those texts are cut into tokens again, no tokens are written.
    """
    given = docs.filter(F.col(batch).isNotNull()).select(F.col(batch).alias("__b"), "doc_id", "text")
    every = checkpointed(given.select("__b", "doc_id", described(F.col("__b").cast("string"), "text").alias("d")).select("__b", "doc_id", "d.*").filter("unit is not null"))
    classes = checkpointed(every.groupBy("__b", "unit").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("texts"), F.first("size").alias("size"), F.first("bits").alias("bits")))
    copies = every.select("__b", "doc_id", "unit").join(classes.filter("texts > 1").select("unit", "first"), "unit").filter("doc_id > first")
    # similarities are compared when rounded to six places
    pairs = close_pairs(classes.select("__b", "unit", "size", "bits"), least - 5e-7)
    counted = verified(pairs, classes.select("__b", "unit", "first"), given)
    linked = counted.withColumn("similarity", F.round(F.col("both") / (F.col("m") + F.col("n") - F.col("both")), 6)).filter(F.col("similarity") >= least)
    names = classes.select("__b", "unit", "first")
    out = linked.join(names.select("__b", F.col("unit").alias("x"), F.col("first").alias("__x")), "x").join(names.select(F.col("unit").alias("y"), F.col("first").alias("__y")), "y")
    ends = out.select(F.col("__b").alias(batch), F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"), "similarity")
    return ends.union(copies.select("__b", F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))
