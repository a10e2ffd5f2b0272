"""Language-model scores by context-tree weighting over bytes.

A text is lower-cased (A-Z), its words joined by one space, and ended by one end byte. Every byte is eight
binary decisions; a decision's contexts are the last 0 to DEPTH bytes together with the bits of the byte
so far. Each node of that tree has a Krichevsky-Trofimov estimate, and the weighting recursion

    Pw(node) = 1/2 Pe(node) + 1/2 product of Pw(children)

mixes the estimates of all depths by how well they coded the training texts. A context not met in
training inherits the estimate of the deepest one that was. The sum over a text of log10 of the mixed
probabilities is its score, a probability over whole texts; divided by its bytes, its code length.

Nothing of the corpus is held in one place:

1. A task cuts its texts into chunks of CHUNK_BYTES. A chunk lists its distinct keys (windows of a byte
   behind its context, word hashes) with training counts, cut into buckets, and keeps its texts compressed.
2. Lists of up to FAN chunks are added up, then up to FAN such sums, and so on to one list a bucket; each
   round has FINER times the buckets, so that a list stays of one size while the corpus grows.
3. A bucket has whole subtrees from depth 3 down (at most 2^24 windows under three bytes, however many
   texts have them). It sends the sums of its depth-2 nodes up; those are joined, and theirs of depths 1
   and 0 (65,280 nodes at most) pass through the driver.
4. A bucket answers its keys, the answers go down the rounds of step 2, and each chunk sums the answers to
   its own keys over its texts.

Results: null and word-free texts score their end alone; texts are used whole; repeated rows are scored
(and, if in training, counted) each; rows with null ids are training rows; with no training rows every bit
has probability 1/2 and the base counts are zero; an empty table gives none. Other columns are not read.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import checkpointed, crc_remainder, text_bytes, texts

DEPTH = 5
#: Ends each text, and stands before it as its context; no UTF-8 text has it.
EDGE = 255
SPACE = 32
#: Bytes of text of one chunk, and of a block whose windows are sorted at once.
CHUNK_BYTES, BLOCK = 32_000_000, 1 << 22
#: Bytes whose windows are looked up, or whose words are hashed, at once.
STEP = 1 << 20
#: Lists added up at once, and how many times more buckets the sums have.
FAN, FINER = 64, 8
#: Bytes of the corpus for each bucket of a chunk's list, and the least and most of these.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16_000_000, 16, 256
#: Buckets of a list between which the windows of one pair of last bytes are dealt.
PAIR_BUCKETS = 4

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = SPACE
LOWER[EDGE] = EDGE - 1

u64 = np.uint64
#: Word hashes are polynomials in MULTIPLIER modulo 2^64, with a fixed random number for each byte.
MULTIPLIER = u64(0x9E3779B97F4A7C15)
INVERSE = u64(pow(int(MULTIPLIER), -1, 1 << 64))
BYTE_NUMBERS = np.random.default_rng(64).integers(0, 2**64, 256, dtype=u64)
END_KEY = u64(2**64 - 1)


def bodies(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of given sizes, one behind another, to bodies each ended by EDGE, and the sizes of these."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.empty(len(data) + len(sizes), np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = LOWER[data]
    out[ends] = EDGE
    space = out == SPACE
    behind_gap = np.append(True, (space | ~inside)[:-1])
    out = out[~(space & behind_gap)]
    trailing = (out[:-1] == SPACE) & (out[1:] == EDGE)
    out = out[np.append(~trailing, np.ones(min(1, len(out)), bool))]
    return out, np.diff(np.flatnonzero(out == EDGE), prepend=-1)


def windows(data: np.ndarray, begins: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each byte of data[first:last], its context (the last byte foremost) and itself, 8 bits each."""
    lead = max(0, DEPTH - first)
    part = data[first - DEPTH + lead : last].astype(u64)
    part = np.concatenate([np.full(lead, EDGE, u64), part]) if lead else part
    n = last - first
    keys = part[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        keys |= part[DEPTH - back : DEPTH - back + n] << u64(8 * (DEPTH + 1 - back))
    # what lies before a text's begin is EDGE
    near = begins[np.searchsorted(begins, first - DEPTH) : np.searchsorted(begins, last)]
    ends = np.append(begins[1:], len(data))[np.searchsorted(begins, first - DEPTH) : np.searchsorted(begins, last)]
    for k in range(DEPTH):
        at = near + k
        at = at[(at >= first) & (at < last) & (at < ends)] - first
        keys[at] |= u64((1 << 8 * (DEPTH + 1 - k)) - (1 << 8))
    return keys


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, u64), np.full(n, x)])) for x in (MULTIPLIER, INVERSE))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place and the hash of every word of some bodies."""
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, u64)]
    gaps = np.flatnonzero((data == SPACE) | (data == EDGE))
    first = 0
    while first < len(data):
        # whole words: up to the last gap within STEP bytes, or else the next one
        cut = max(0, np.searchsorted(gaps, first + STEP, side="right") - 1)
        last = int(gaps[cut]) + 1 if gaps[cut] >= first else int(gaps[np.searchsorted(gaps, first)]) + 1
        part = data[first:last]
        n = len(part)
        forth, back = powers(STEP * (n // STEP + 1))
        inside = (part != SPACE) & (part != EDGE)
        sums = np.append(u64(0), np.cumsum(np.where(inside, BYTE_NUMBERS[part] * forth[:n], u64(0)), dtype=u64))
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        h = (sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(u64)
        h ^= h >> u64(32)
        h *= MULTIPLIER
        h ^= h >> u64(29)
        hashes.append(np.minimum(h, END_KEY - u64(1)))
        places.append(starts + first)
        first = last
    return np.concatenate(places), np.concatenate(hashes)


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, the first bytes of all values first: what follows compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=u64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, u64), dtype=u64)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))


def summed(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with their counts added up."""
    whole = np.concatenate([np.empty(0, u64), *keys])
    order = np.argsort(whole)
    whole = whole[order]
    first = runs(whole)
    sums = (np.add.reduceat(np.concatenate(c)[order], first) if len(first) else np.empty(0) for c in counts)
    return whole[first], *sums


def pair_bits(buckets: int) -> int:
    """Bits of a bucket's number that its last two context bytes decide; the third decides the others."""
    return max(0, (buckets // PAIR_BUCKETS).bit_length() - 1)


def places_of(keys: np.ndarray, is_word: bool, bits: int) -> np.ndarray:
    """A number for each key of which any low bits are its bucket among a power of two of them."""
    if is_word:
        return keys >> u64(8)
    pair, three = keys >> u64(32), keys >> u64(24)
    of_pair = (pair * MULTIPLIER) >> u64(64 - bits) if bits else np.zeros(len(keys), u64)
    return (three * MULTIPLIER) >> u64(33) << u64(bits) | of_pair


def bucket_rows(keys: np.ndarray, counts: np.ndarray, is_word: bool, bits: int, buckets: int) -> Iterator[tuple]:
    """(bucket, keys, counts) by bucket, packed; words have negative buckets."""
    place = (places_of(keys, is_word, bits) & u64(buckets - 1)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = runs(place[order])
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        mine = order[a:b]
        bucket = int(place[mine[0]])
        yield -1 - bucket if is_word else bucket, pack_keys(keys[mine]), pack(counts[mine].astype(np.int64))


LISTED = "chunk long, bucket int, keys binary, counts binary, size long, blob binary, ids array<{kind}>, held_out array<boolean>"


class Chunk:
    """The keys and texts of one chunk, while a task collects them."""

    def __init__(self) -> None:
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.texts: list[tuple] = []
        self.size = 0

    def add(self, data: np.ndarray, sizes: np.ndarray, ids: pa.Array, held_out: np.ndarray) -> None:
        data, sizes = bodies(data, sizes)
        begins = np.cumsum(sizes) - sizes
        training = np.repeat(~held_out, sizes)
        for first in range(0, len(data), BLOCK):
            last = min(first + BLOCK, len(data))
            both = np.concatenate([windows(data, begins, k, min(k + STEP, last)) for k in range(first, last, STEP)])
            both = both << u64(1) | training[first:last]
            both.sort()
            keys = both >> u64(1)
            at = runs(keys)
            self.grams.append((keys[at], np.add.reduceat((both & u64(1)).astype(np.int64), at)))
        places, hashes = word_hashes(data)
        for counted in (True, False):
            keys, n = np.unique(hashes[training[places] == counted], return_counts=True)
            self.words.append((keys, n * counted))
        self.words.append((np.array([END_KEY]), np.array([int((~held_out).sum())])))
        self.texts.append((len(data), pa.compress(data.tobytes(), "zstd", asbytes=True), ids, held_out))
        self.size += len(data)
        for lists in (self.grams, self.words):
            if len(lists) > 16:
                lists[:] = [summed(*zip(*lists, strict=True))]

    def batches(self, chunk: int, bits: int, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = [r for is_word, lists in enumerate((self.grams, self.words)) for r in bucket_rows(*summed(*zip(*lists, strict=True)), bool(is_word), bits, buckets)]
        n = len(rows)
        listed = dict(zip(("bucket", "keys", "counts"), zip(*rows, strict=True), strict=True)) | {"chunk": [chunk] * n}
        yield pa.RecordBatch.from_arrays([pa.array(listed.get(f.name, [None] * n), f.type) for f in schema], schema=schema)
        for size, blob, ids, held_out in self.texts:
            one = {"chunk": [chunk], "size": [size], "blob": [blob], "held_out": [held_out.tolist()]}
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(schema.field("ids").type)
            yield pa.RecordBatch.from_arrays([lists if f.name == "ids" else pa.array(one.get(f.name, [None]), f.type) for f in schema], schema=schema)


def chunk_lists(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: the packed keys of a chunk and bucket; some texts of a chunk, compressed, with their ids."""
    kind, bits = rows.schema["doc_id"].dataType.simpleString(), pair_bits(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, schema = TaskContext.get().partitionId() << 32, Chunk(), None
        for batch in batches:
            if schema is None:
                plain = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<boolean>": pa.list_(pa.bool_())}
                schema = pa.schema([(name, plain.get(type_, pa.list_(batch.schema.field("doc_id").type))) for name, type_ in (f.split(" ") for f in LISTED.split(", "))])
            text = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            first = 0
            while first < len(text):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
                chunk.add(data[offsets[first] : offsets[last]], np.diff(offsets[first : last + 1]), pa.array(batch.column("doc_id").slice(first, last - first).to_pylist(), batch.column("doc_id").type), held_out[first:last])
                first = last
                if chunk.size >= CHUNK_BYTES:
                    yield from chunk.batches(number, bits, buckets, schema)
                    number, chunk = number + 1, Chunk()
        if chunk.size:
            yield from chunk.batches(number, bits, buckets, schema)

    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out").mapInArrow(run, LISTED.format(kind=kind))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up for small arguments."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: log_gamma of small counts + 1/2 and + 1, which most nodes have.
HALF, ONE = log_gamma(np.arange(4096) + 0.5), log_gamma(np.arange(4096) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    both = zeros + ones
    small = np.minimum(both, len(ONE) - 1).astype(np.int64)
    out = HALF[np.minimum(zeros, small).astype(np.int64)] + HALF[np.minimum(ones, small).astype(np.int64)] - np.log(np.pi) - ONE[small]
    large = np.flatnonzero(both >= len(ONE))
    z, o = zeros[large], ones[large]
    out[large] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - np.log(np.pi) - log_gamma(z + o + 1.0)
    return out


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """log Pw of nodes, and the weight of their own estimate; below: the children's log Pw added up (None: leaves)."""
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


class Subtree:
    """The tree over the windows of one bucket: its entries (a context of depth d and a byte), sorted, for d from DEPTH to 2.

    At each bit of the byte the entries that agree so far are a node, and stand together.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.parent = {DEPTH: keys}, {DEPTH: counts.astype(float)}, {}
        for d in range(DEPTH - 1, 1, -1):
            upper = (self.keys[d + 1] >> u64(16)) << u64(8) | self.keys[d + 1] & u64(255)
            self.keys[d], self.parent[d + 1] = np.unique(upper, return_inverse=True)
            self.counts[d] = np.bincount(self.parent[d + 1], self.counts[d + 1], len(self.keys[d]))

    def nodes(self, k: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: (first entry of each node, node of each entry, zeros, ones) of bit k."""
        out = {}
        for d, keys in self.keys.items():
            first = runs(keys >> u64(8 - k))
            node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            ones = np.bincount(node, self.counts[d] * (keys >> u64(7 - k) & u64(1)), len(first))
            out[d] = first, node, np.bincount(node, self.counts[d], len(first)) - ones, ones
        return out

    def up(self, k: int) -> tuple[dict, dict, np.ndarray]:
        """The nodes of bit k, own weights by depth below 2, and what the children of the depth-2 nodes add up to."""
        nodes, own, below = self.nodes(k), {}, None
        for d in range(DEPTH, 2, -1):
            first, _, zeros, ones = nodes[d]
            pw, own[d] = weighted(zeros, ones, below)
            upper = nodes[d - 1]
            below = np.bincount(upper[1][self.parent[d][first]], pw, len(upper[0]))
        return nodes, own, below

    def tops(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (two context bytes and the bits so far behind a 1) of the depth-2 nodes; their zeros, ones, and children's sum."""
        keys, values = [], []
        for k in range(8):
            nodes, _, below = self.up(k)
            first, _, zeros, ones = nodes[2]
            entry = self.keys[2][first]
            keys.append((entry >> u64(8)) << u64(8) | u64(1 << k) | (entry & u64(255)) >> u64(8 - k))
            values.append(np.stack([zeros, ones, below]))
        return np.concatenate(keys), np.concatenate(values, axis=1)

    def log10_probabilities(self, top: dict[str, np.ndarray], keys2: np.ndarray, values2: np.ndarray) -> np.ndarray:
        """log10 of the mixed probability of each window's byte, given the nodes of depths 0 and 1, and those of depth 2."""
        total = np.zeros(len(self.keys[DEPTH]))
        entry = self.keys[2]
        byte, last = (entry & u64(255)).astype(np.int64), (entry >> u64(16)).astype(np.int64)
        for k in range(8):
            nodes, own, _ = self.up(k)
            prefix = 1 << k | byte >> (8 - k)
            place = np.searchsorted(keys2, (entry >> u64(8)) << u64(8) | prefix.astype(u64))
            path = [top["nodes0"][:, prefix], top["nodes1"][:, last, prefix], values2[:, place]]
            bit = byte >> (7 - k) & 1
            done, mass, estimate, share = np.zeros(len(bit)), np.ones(len(bit)), None, None
            for d in range(DEPTH + 1):
                if d < 3:
                    zeros, ones, weight = path[d]
                else:
                    up = self.parent[d]
                    bit, done, mass, estimate, share = bit[up], done[up], mass[up], estimate[up], share[up]
                    _, node, zeros, ones = nodes[d]
                    zeros, ones, weight = zeros[node], ones[node], own[d][node]
                if d:
                    seen = zeros + ones > 0
                    done = done + mass * np.where(seen, share, 1.0) * estimate
                    mass = np.where(seen, mass * (1 - share), 0.0)
                estimate, share = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0), weight
            total += np.log10(done + mass * estimate)
        return total


def binary_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def added_up(listed: DataFrame, bits: int, finer: int) -> DataFrame:
    """node, bucket, keys, counts: for each node and bucket of the lists their sum, cut into more buckets."""
    schema = pa.schema([("node", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        keys, counts = summed([unpack_keys(k.as_py()) for k in table["keys"]], [unpack(c.as_py(), np.int64) for c in table["counts"]])
        node = table["node"][0].as_py()
        return binary_table([(node, *r) for r in bucket_rows(keys, counts, table["bucket"][0].as_py() < 0, bits, finer)], schema)

    return listed.groupBy("node", "bucket").applyInArrow(run, "node long, bucket int, keys binary, counts binary")


def sums_by_bucket(listed: DataFrame, buckets: int) -> list[tuple[DataFrame, int, int]]:
    """Lists of (node, bucket, keys, counts), with their number of buckets and of the groups that are added up: the chunks',
    sums of about FAN of these, and so on to a single one."""
    levels, bits = [], pair_bits(buckets)
    nodes = listed.agg(F.count_distinct("node")).first()[0]
    while True:
        groups = -(-max(1, nodes) // FAN)
        levels.append((listed, buckets, groups))
        finer = buckets * FINER if groups > 1 else buckets
        listed, buckets = checkpointed(added_up(listed.withColumn("node", above("node", groups)), bits, finer)), finer
        if groups == 1:
            return [*levels, (listed, buckets, 0)]
        nodes = groups


def above(node: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(groups))


PACKED_NODES = pa.schema([("part", pa.int32()), ("keys2", pa.binary()), ("values2", pa.binary())])


def depth_two(sums: DataFrame, bits: int) -> DataFrame:
    """part, keys2, values2: the depth-2 nodes (zeros, ones, children's sum) of the pairs of last bytes of each part."""
    part = F.col("bucket").bitwiseAND(F.lit((1 << bits) - 1)).alias("part")

    def of_bucket(table: pa.Table) -> pa.Table:
        rows = []
        for part_, keys, counts in zip(*(table[c].to_pylist() for c in ("part", "keys", "counts")), strict=True):
            keys2, values2 = Subtree(unpack_keys(keys), unpack(counts, np.int64)).tops()
            rows.append((part_, pack(keys2), pack(values2.ravel())))
        return binary_table(rows, PACKED_NODES)

    def of_part(table: pa.Table) -> pa.Table:
        values = [unpack(v.as_py(), float).reshape(3, -1) for v in table["values2"]]
        keys2, *sums_ = summed([unpack(k.as_py(), u64) for k in table["keys2"]], *([v[i] for v in values] for i in range(3)))
        return binary_table([(table["part"][0].as_py(), pack(keys2), pack(np.concatenate(sums_)))], PACKED_NODES)

    schema = "part int, keys2 binary, values2 binary"
    partial = sums.filter("bucket >= 0").select(part, "bucket", "keys", "counts").groupBy("bucket").applyInArrow(of_bucket, schema)
    return checkpointed(partial.groupBy("part").applyInArrow(of_part, schema))


def top_nodes(depth2: DataFrame) -> dict[str, np.ndarray]:
    """(zeros, ones, own weight) of the nodes of depths 0 and 1 by last byte and bits so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys2, values2 in zip(batch.column("keys2").to_pylist(), batch.column("values2").to_pylist(), strict=True):
                keys, (zeros, ones, below) = unpack(keys2, u64), unpack(values2, float).reshape(3, -1)
                pw = weighted(zeros, ones, below)[0]
                upper, *sums_ = summed([(keys >> u64(16)) << u64(8) | keys & u64(255)], [zeros], [ones], [pw])
                yield pa.RecordBatch.from_arrays([pa.array(upper.astype(np.int32)), *map(pa.array, sums_)], names=["node", "zeros", "ones", "below"])

    rows = depth2.mapInArrow(run, "node int, zeros double, ones double, below double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toPandas()
    nodes0, nodes1 = np.zeros((3, 256)), np.zeros((3, 256, 256))
    nodes0[2], nodes1[2] = 1.0, 1.0
    if len(rows):
        last, prefix = rows.node.to_numpy() >> 8, rows.node.to_numpy() & 255
        zeros, ones = rows.zeros.to_numpy(), rows.ones.to_numpy()
        pw, own = weighted(zeros, ones, rows.below.to_numpy())
        nodes1[:, last, prefix] = zeros, ones, own
        nodes0[0], nodes0[1] = np.bincount(prefix, zeros, 256), np.bincount(prefix, ones, 256)
        nodes0[2] = weighted(nodes0[0], nodes0[1], np.bincount(prefix, pw, 256))[1]
    return {"nodes0": nodes0, "nodes1": nodes1}


ANSWERS = pa.schema([("node", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("answers", pa.binary())])
ANSWERS_SQL = "node long, bucket int, keys binary, answers binary"


def bucket_answers(sums: DataFrame, depth2: DataFrame, bits: int, buckets: int, top: dict[str, np.ndarray]) -> DataFrame:
    """The answers to each bucket's keys: log10 probabilities of windows, counts of words."""
    sent = sums.sparkSession.sparkContext.broadcast(top)
    of_part = depth2.withColumn("bucket", F.explode(F.sequence(F.col("part"), F.lit(buckets - 1), F.lit(1 << bits))))

    def run(lists: pa.Table, nodes: pa.Table) -> pa.Table:
        rows = []
        for node, bucket, keys, counts in zip(*(lists[c].to_pylist() for c in ("node", "bucket", "keys", "counts")), strict=True):
            found = unpack(counts, np.int64)
            if bucket >= 0:
                keys2, (zeros, ones, below) = unpack(nodes["keys2"][0].as_py(), u64), unpack(nodes["values2"][0].as_py(), float).reshape(3, -1)
                values2 = np.stack([zeros, ones, weighted(zeros, ones, below)[1]])
                found = Subtree(unpack_keys(keys), found).log10_probabilities(sent.value, keys2, values2)
            rows.append((node, bucket, keys, pack(found.astype(float))))
        return binary_table(rows, ANSWERS)

    return sums.groupBy("bucket").cogroup(of_part.groupBy("bucket")).applyInArrow(run, ANSWERS_SQL)


def handed_down(lists: DataFrame, buckets: int, answers: DataFrame, groups: int) -> DataFrame:
    """The answers to the keys of each node's lists, from those to the sums of these lists."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, u64), *(unpack_keys(k.as_py()) for k in known["keys"])])
        values = np.concatenate([np.empty(0), *(unpack(a.as_py(), float) for a in known["answers"])])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        rows = [(node, bucket, k, pack(values[np.searchsorted(keys, unpack_keys(k))])) for node, bucket, k in zip(*(asked[c].to_pylist() for c in ("node", "bucket", "keys")), strict=True)]
        return binary_table(rows, ANSWERS)

    coarse = F.when(F.col("bucket") >= 0, F.col("bucket").bitwiseAND(F.lit(buckets - 1))).otherwise(-1 - (-1 - F.col("bucket")).bitwiseAND(F.lit(buckets - 1)))
    asked = lists.select("node", "bucket", "keys").withColumn("group", above("node", groups))
    known = answers.select(F.col("node").alias("group"), coarse.alias("bucket"), "keys", "answers")
    return asked.groupBy("group", "bucket").cogroup(known.groupBy("group", "bucket")).applyInArrow(run, ANSWERS_SQL)


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """values of 48-bit keys: blocks of 65,536 are sorted with their places in the low bits, so that near keys are sought together."""
    out, low = np.empty(len(asked)), np.arange(1 << 16, dtype=u64)
    for first in range(0, len(asked), 1 << 16):
        both = asked[first : first + (1 << 16)] << u64(16)
        both |= low[: len(both)]
        both.sort()
        whole = both >> u64(16)
        at = runs(whole)
        each = values[np.searchsorted(keys, whole[at])]
        out[first + (both & u64(0xFFFF)).astype(np.int64)] = np.repeat(each, np.diff(np.append(at, len(whole))))
    return out


def by_slot(keys: np.ndarray) -> np.ndarray:
    """A table of about four slots a key: a slot has the place of some key whose hash it is."""
    bits = max(2, int(len(keys)).bit_length() + 1)
    slots = np.zeros(1 << bits, np.int32)
    slots[((keys * MULTIPLIER) >> u64(64 - bits)).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)
    return slots


def slot_lookup(keys: np.ndarray, slots: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked key, all of which are there; what shares a slot is sought by bisection."""
    bits = len(slots).bit_length() - 1
    at = slots[((asked * MULTIPLIER) >> u64(64 - bits)).astype(np.int64)].astype(np.int64)
    missed = np.flatnonzero(keys[at] != asked)
    at[missed] = np.searchsorted(keys, asked[missed])
    return at


SCORED = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def chunk_scores(texts_: DataFrame, answers: DataFrame, n_train: int, distinct: int, kind: str) -> DataFrame:
    """The rows of the texts of each chunk, from the answers to its keys."""
    base = float(n_train) + 0.1 * (distinct + 1)

    def lookup(table: pa.Table, is_word: bool) -> tuple[np.ndarray, np.ndarray]:
        mine = [(k.as_py(), a.as_py()) for b, k, a in zip(table["bucket"], table["keys"], table["answers"], strict=True) if (b.as_py() < 0) == is_word]
        keys = np.concatenate([np.empty(0, u64), *(unpack_keys(k) for k, _ in mine)])
        values = np.concatenate([np.empty(0), *(unpack(a, float) for _, a in mine)])
        order = np.argsort(keys)
        return keys[order], values[order]

    def run(texts_: pa.Table, answers: pa.Table) -> pa.Table:
        gram_keys, gram_values = lookup(answers, False)
        word_keys, word_counts = lookup(answers, True)
        logs, known = np.log10((word_counts + 0.1) / base), (word_counts > 0).astype(float)
        slots, out = by_slot(word_keys), []
        for size, blob, ids, held_out in zip(texts_["size"].to_pylist(), texts_["blob"].to_pylist(), texts_["ids"], texts_["held_out"], strict=True):
            data = np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.uint8)
            sizes = np.diff(np.flatnonzero(data == EDGE), prepend=-1)
            begins = np.cumsum(sizes) - sizes
            score = np.zeros(len(sizes))
            for first in range(0, size, STEP):
                last = min(first + STEP, size)
                a, b = np.searchsorted(begins, first, side="right") - 1, np.searchsorted(begins, last)
                found = looked_up(gram_keys, gram_values, windows(data, begins, first, last))
                score[a:b] += np.add.reduceat(found, np.maximum(begins[a:b] - first, 0))
            places, hashes = word_hashes(data)
            of_text = np.searchsorted(begins, places, side="right") - 1
            at = slot_lookup(word_keys, slots, hashes)
            n = np.bincount(of_text, minlength=len(sizes))
            rows = {
                "doc_id": ids.values,
                "held_out": held_out.values,
                "n_tokens": n + 1,
                "n_known": np.bincount(of_text, known[at], len(sizes)).astype(np.int64) + int(known[-1]),  # END_KEY is the largest key
                "train_tokens": np.full(len(sizes), n_train),
                "base_score": np.bincount(of_text, logs[at], len(sizes)) + logs[-1],
                "score": score,
                "bits_per_byte": -score * np.log2(10) / sizes,
            }
            out.append(pa.table(rows))
        return pa.concat_tables(out)

    by_chunk = answers.withColumnRenamed("node", "chunk").groupBy("chunk")
    return texts_.groupBy("chunk").cogroup(by_chunk).applyInArrow(run, SCORED.format(kind=kind))


def model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    rows = texts(docs).withColumn("held_out", F.coalesce(crc_remainder("doc_id", 10) == 0, F.lit(False)))
    asked_for = min(MOST_BUCKETS, max(LEAST_BUCKETS, text_bytes(rows) // BUCKET_BYTES))
    buckets = 1 << (int(asked_for) - 1).bit_length()
    kept = checkpointed(chunk_lists(rows, buckets))
    listed = kept.filter("bucket is not null").select(F.col("chunk").alias("node"), "bucket", "keys", "counts")
    levels, bits = sums_by_bucket(listed, buckets), pair_bits(buckets)
    sums, finest, _ = levels[-1]

    def word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [unpack(c, np.int64) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [int(c.sum()) for c in each], "v": [int((c > 0).sum()) for c in each]})

    totals = sums.filter("bucket < 0").select("counts").mapInArrow(word_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    depth2 = depth_two(sums, bits)
    answers = bucket_answers(sums, depth2, bits, finest, top_nodes(depth2))
    for lists, coarse, groups in levels[-2::-1]:
        answers = handed_down(lists, coarse, answers, groups)
    texts_ = kept.filter("bucket is null").select("chunk", "size", "blob", "ids", "held_out")
    return chunk_scores(texts_, answers, totals[0] or 0, totals[1] or 0, docs.schema["doc_id"].dataType.simpleString())
