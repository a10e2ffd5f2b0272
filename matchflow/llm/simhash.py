"""SimHash near-duplicates, candidates discarded by pivot distance tables.

Fingerprints: the majority bits of the XXH64 hashes of a text's four-word shingles. Equal fingerprints
are one class; only classes are compared. Each class gets, once, its row of the pivot table: the Hamming
distances to fixed reference fingerprints, kept as columns of the class. By the triangle inequality a
pair that differs by more than d in any coordinate cannot link.

Classes come together when they agree in enough blocks of bits: with b blocks and at most d differing
bits, b - d blocks are equal, so every link shares one of the block choices (b is chosen by the number of
classes; any b finds every link). Distances to references alone crowd around 32, so no cells of them
would part most classes. Within a group rows are in the order of their first coordinate: pairs are formed only
from rows at most d apart there, pairs whose other coordinates differ by more are discarded, and survivors
are verified by their exact distance.

A choice of blocks that many classes share is split into pairs of tiles, each a task's work of bounded
size, and gives one edge per member to the smallest of each linked set, never all pairs. Components
come from minimum labels with pointer jumping over written tables.

Results: a text without words has fingerprint zero, linked like any other; a shorter text than a shingle
is one shingle; equal texts always share a component; rows without an id get the component of their
fingerprint's class (null if no row of the component has an id); every input row gives one output row; an empty table
gives none; texts of any length are used whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import checkpointed, discarded, in_pandas, texts

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Reference fingerprints, from a fixed generator.
PIVOTS = np.random.default_rng(2024).integers(0, 2**64, 24, dtype=np.uint64, endpoint=False)
#: Groups of more classes than this are split into tiles; ones of up to SMALL are compared pair by pair.
TILE, SMALL = 2048, 16


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.encode().lower().split()  # lower() and split() of bytes know ASCII only
    if not words:
        return 0
    whole = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(begins, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, the latter as a signed long with the same bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = np.fromiter((fingerprint(t) for t in pdf.text), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fingerprint": prints.view(np.int64)})

    return in_pandas(texts(docs), run, ("doc_id",), "fingerprint long")


def blocks_for(classes: int, most_bits: int = MOST_BITS) -> int:
    """The fewest blocks with which few unrelated classes agree by chance."""
    for blocks in range(most_bits + 2, 17):
        if classes <= 2 ** (64 * (blocks - most_bits) // blocks - 2):
            return blocks
    return 16


def block_keys(col: Column, blocks: int, most_bits: int = MOST_BITS) -> Column:
    """An array of keys, one for each choice of blocks that may all be equal."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - most_bits)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
        keys.append(F.struct(F.lit(k).alias("choice"), col.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints, a row for each."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def with_pivots(classes: DataFrame) -> DataFrame:
    """classes with `near`, the distance to the first reference, and `pivots`, those to all as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            table = distance_table(pdf.fingerprint.astype(np.int64).to_numpy().view(np.uint64))
            yield pdf.assign(near=table[:, 0].astype(np.int32), pivots=[row.tobytes() for row in table])

    return in_pandas(classes, run, classes.columns, "near int, pivots binary")


def near_pairs(keys: np.ndarray, near: np.ndarray, most_bits: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows with equal keys at most most_bits apart in their first coordinate; rows come sorted by both."""
    left = np.arange(len(keys))
    for shift in range(1, len(keys)):
        left = left[left + shift < len(keys)]
        right = left + shift
        left = left[(keys[left] == keys[right]) & (near[right].astype(int) - near[left] <= most_bits)]
        if not len(left):
            return
        yield left, left + shift


def screened(table: np.ndarray, i: np.ndarray, j: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those whose coordinates differ by at most most_bits everywhere."""
    for p in range(table.shape[1]):
        if not len(i):
            break
        near = np.abs(table[i, p] - table[j, p]) <= most_bits
        i, j = i[near], j[near]
    return i, j


def verified(prints: np.ndarray, i: np.ndarray, j: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those whose fingerprints differ in at most most_bits bits."""
    near = np.bitwise_count(prints[i] ^ prints[j]) <= most_bits
    return i[near], j[near]


def linked_sets(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each member of one large group, sorted by its first coordinate, to the first member that it is connected with."""
    n = len(prints)
    near = np.zeros((n, n), bool)
    for i, j in near_pairs(np.zeros(n, np.int8), table[:, 0]):
        i, j = verified(prints, *screened(table, i, j))
        near[i, j] = near[j, i] = True
    root = np.full(n, -1)
    for a in range(n):
        if root[a] < 0:
            wave = np.array([a])
            root[a] = a
            while len(wave):
                reach = near[wave].any(axis=0) & (root < 0)
                wave = np.flatnonzero(reach)
                root[wave] = a
    member = np.flatnonzero(root != np.arange(n))
    return prints[root[member]], prints[member]


def group_edges(keys: np.ndarray, prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within groups of equal keys; rows come sorted by key, then by their first coordinate."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    small = np.repeat(sizes <= SMALL, sizes)
    x, t = prints[small], table[small]
    for i, j in near_pairs(keys[small], t[:, 0]):
        i, j = verified(x, *screened(t, i, j))
        left.append(x[i])
        right.append(x[j])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = linked_sets(prints[start : start + size], table[start : start + size])
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def class_edges(classes: DataFrame, total: int) -> DataFrame:
    """Edges a, b between distinct fingerprints that connect exactly what links of at most MOST_BITS connect."""
    key = F.explode(block_keys(F.col("fingerprint"), blocks_for(total))).alias("key")
    keyed = classes.select("fingerprint", "near", "pivots", key).select("fingerprint", "near", "pivots", "key.*")
    shared = checkpointed(keyed.groupBy("choice", "bits").count().filter("count > 1"))
    met = keyed.join(shared, ["choice", "bits"])
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), tiles)
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    met = met.select(F.xxhash64("choice", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fingerprint", "near", "pivots")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, prints, table = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((0, len(PIVOTS)), np.int8)

        def edges(keys: np.ndarray, prints: np.ndarray, table: np.ndarray) -> pd.DataFrame:
            a, b = (x.view(np.int64) for x in group_edges(keys, prints, table))
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

        for pdf in batches:
            keys = np.concatenate([keys, pdf.key.to_numpy(np.int64)])
            prints = np.concatenate([prints, pdf.fingerprint.to_numpy(np.int64).view(np.uint64)])
            table = np.concatenate([table, np.frombuffer(b"".join(pdf.pivots), np.int8).reshape(-1, len(PIVOTS))])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last group may go on
            if whole > 20_000:
                yield edges(keys[:whole], prints[:whole], table[:whole])
                keys, prints, table = keys[whole:], prints[whole:], table[whole:]
        if len(keys):
            yield edges(keys, prints, table)

    together = met.repartition(F.col("key")).sortWithinPartitions("key", "near")
    return together.mapInPandas(run, "a long, b long").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of the edges is connected with.

    Each round takes the least label of the neighbours, then the label of the label; the tables of a
    round are written, so a lost executor costs a round at most.
    """
    both = checkpointed(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")))
    labels = checkpointed(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")))
    while True:
        said = both.join(labels, "node").select(F.col("next").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        heard = said.union(labels.select("node", "label", F.col("label").alias("was")))
        least = checkpointed(heard.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = checkpointed(least.join(jump, "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("was")).alias("moved")))
        discarded(least)
        discarded(labels)
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id, the smallest doc_id reachable over links."""
    prints = checkpointed(fingerprints(docs))
    classes = checkpointed(with_pivots(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))))
    edges = checkpointed(class_edges(classes, classes.count()))
    if edges.isEmpty():
        of_class = classes.select("fingerprint", F.col("least_id").alias("component_id"))
    else:
        labels = component_labels(edges).withColumnRenamed("node", "fingerprint")
        rooted = checkpointed(classes.join(labels, "fingerprint", "left").select("fingerprint", "least_id", F.coalesce("label", "fingerprint").alias("root")))
        least = checkpointed(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
        of_class = checkpointed(rooted.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(of_class, "fingerprint").select("doc_id", "fingerprint", "component_id")
