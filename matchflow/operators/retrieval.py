"""Top-k retrieval over vectors: an inverted file of cells around centroids, pruned by the triangle inequality, with exact results.

Centroids are fitted on a hash sample of at most about SAMPLE_ROWS vectors; every vector is indexed, in the cell of its nearest
centroid and with its distance to that. A search first measures each query's PROBES nearest cells, whose k-th distance bounds the
result by some u. As no vector can be nearer than |d(query, centroid) - d(vector, centroid)|, only cells for which that can be at
most u are measured then; all others are out. Equal vectors are one entry of the index, equal queries are asked once.

Cells are dealt to blocks of about BLOCK entries, which meet their collection's queries, ASKERS at once at most, in one task. There
matrix products tell which pairs can be among the k nearest, and only those are measured from the vectors' differences. In a cloud
of many dimensions no cell is out: then the products are as many as queries times vectors.

Results: chunks without a vector are not indexed, queries without one get no rows; a collection of fewer than k chunks gives
all of them; equal distances rank by chunk_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchflow.operators.postings import limit_per_source
from matchflow.operators.written import checkpointed

#: Vectors that centroids are fitted on, and the most centroids, whose broadcast they bound.
SAMPLE_ROWS, MOST_CELLS = 16_384, 1024
#: Cells of a query that are measured first.
PROBES = 4
#: Entries of a block, queries that meet one at once, and the pairs of a strip of them that are held as numbers.
BLOCK, ASKERS, STRIP = 8_192, 8_192, 4_000_000
#: Collections of up to so many entries share blocks.
SMALL = BLOCK // 16
#: Bounds are widened by this share, more than rounding takes; distances to centroids, which products give, by that share of the vectors' lengths.
SLACK, TO_CENTROID = 1e-9, 1e-6


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it, measured from the difference itself."""
    cell = np.empty(len(x), np.int64)
    half = (centroids**2).sum(axis=1) / 2
    for k in range(0, len(x), 4096):
        cell[k : k + 4096] = np.argmin(half - x[k : k + 4096] @ centroids.T, axis=1)
    return cell, np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))


def fit_centroids(chunks: DataFrame, vector: str = "embedding", cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Centroids of the vectors, by Lloyd's rounds over a hash sample; as many as the root of the number of rows, MOST_CELLS at most."""
    whole = chunks.filter(F.col(vector).isNotNull())
    rows = whole.count()
    cells = min(cells or int(rows**0.5), MOST_CELLS)
    share = F.pmod(F.xxhash64("chunk_id", F.lit("cells")), F.lit(1_000_000)) < int(min(1.0, sample_rows / max(1, rows)) * 1_000_000)
    # about sample_rows vectors, whatever the table's size
    x = np.array([r[0] for r in whole.filter(share).select(F.col(vector).cast("array<double>")).collect()])
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(7)
    centroids = x[rng.choice(len(x), max(1, min(cells, len(x))), replace=False)]
    for _ in range(rounds):
        cell, _ = nearest(x, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(cell, minlength=len(centroids))
        np.add.at(sums, cell, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def build_index(chunks: DataFrame, centroids: np.ndarray, collection: str = "doc_fp", vector: str = "embedding") -> DataFrame:
    """A row for each distinct vector of a collection: its first chunk_id, how many chunks have it, its cell and its distance to that centroid."""
    entries = chunks.filter(F.col(vector).isNotNull()).groupBy(collection, vector).agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("n"))
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, radius = nearest(np.array(pdf[vector].tolist(), float), shared.value)
                yield pdf.assign(cell=cell, radius=radius)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInPandas(run, f"{kinds}, cell int, radius double")


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row for each vector of an Arrow column."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def products(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs as a matrix product gives them, and by how much those of a row may be wrong."""
    of_q, of_x = (q * q).sum(axis=1), (x * x).sum(axis=1)
    rough = q @ x.T
    rough *= -2
    rough += of_q[:, None]
    rough += of_x
    return rough, 8 * (q.shape[1] + 8) * np.finfo(float).eps * (of_q + of_x.max())


def closest(q: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and squared distance of the pairs that can be among a row's k nearest within its limit; distances add up dimension by dimension."""
    rough, error = products(q, x)
    met = rough <= (limit + error)[:, None]
    if k < len(x) and np.count_nonzero(met) > 4 * k * len(q):
        met = rough <= (np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1]) + 2 * error)[:, None]
    row, place = np.nonzero(met)
    distance = np.zeros(len(row))
    for a, b in zip(q.T, x.T):
        distance += (a[row] - b[place]) ** 2
    return row, place, distance


def asked_slices(q: np.ndarray, bound: np.ndarray, only: np.ndarray, cell: np.ndarray, radius: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
    """Rows of queries and the slice of entries, in order of their cells, that these have to meet; everything at once if that is most of it."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    least, most, here = np.minimum.reduceat(radius, first), np.maximum.reduceat(radius, first), centroids[cell[first]]
    reach = bound + TO_CENTROID * (np.sqrt((q * q).sum(axis=1)) + np.sqrt((here * here).sum(axis=1).max()))
    to = np.sqrt(np.maximum(products(q, here)[0], 0))
    asks = (to - most <= reach[:, None]) & (least - to <= reach[:, None]) & ((only[:, None] < 0) | (only[:, None] == cell[first]))
    if asks.mean() > 0.5:
        yield np.flatnonzero(asks.any(axis=1)), slice(0, len(cell))
        return
    for k, (a, b) in enumerate(zip(first, np.r_[first[1:], len(cell)])):
        if asks[:, k].any():
            yield np.flatnonzero(asks[:, k]), slice(a, b)


def met(asked: pa.Table, entries: pa.Table, centroids: np.ndarray, k: int, collection: str, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of asked and of entries, which are in order of chunk_id, and their distances: for each query the k nearest in its collection; and how many pairs were multiplied."""
    q, x = matrix(asked[vector]), matrix(entries[vector])
    bound, only = asked["bound"].to_numpy(), asked["cell"].fill_null(-1).to_numpy()
    cell, radius = entries["cell"].to_numpy(), entries["radius"].to_numpy()
    code = pd.factorize(pd.concat([asked[collection].to_pandas(), entries[collection].to_pandas()]))[0]
    of_q, of_x = code[: len(q)], code[len(q) :]
    by_q, by_x = np.argsort(of_q, kind="stable"), np.lexsort((cell, of_x))
    found, pairs = [], 0
    for c in np.intersect1d(of_q, of_x):
        rows = by_q[slice(*np.searchsorted(of_q[by_q], [c, c + 1]))]
        places = by_x[slice(*np.searchsorted(of_x[by_x], [c, c + 1]))]
        step = max(1, STRIP // len(places))
        for strip in (rows[i : i + step] for i in range(0, len(rows), step)):
            parts = []
            for asking, part in asked_slices(q[strip], bound[strip], only[strip], cell[places], radius[places], centroids):
                i, j, distance = closest(q[strip[asking]], x[places[part]], bound[strip[asking]] ** 2, k)
                parts.append((strip[asking][i], places[part][j], distance))
                pairs += len(asking) * (part.stop - part.start)
            if parts:
                i, j, distance = map(np.concatenate, zip(*parts))
                order = np.lexsort((j, distance, i))
                i, j, distance = i[order], j[order], distance[order]
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
                keep = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < k
                found.append((i[keep], j[keep], distance[keep]))
    i, j, distance = map(np.concatenate, zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return i, j, distance, pairs


def candidates(asked: DataFrame, entries: DataFrame, centroids: np.ndarray, k: int, collection: str, vector: str) -> DataFrame:
    """The k nearest entries of each block to each query that meets it, with squared distances; those that lie out of its `bound` or, if given, its `cell` may be missing."""
    shared = asked.sparkSession.sparkContext.broadcast(centroids)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
        i, j, distance, _ = met(left, right, shared.value, k, collection, vector) if len(left) and len(right) else ([], [], np.zeros(0), 0)
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        columns = [left["query_id"].take(i), right["chunk_id"].take(j), right["copies"].take(j), pa.chunked_array([pa.array(distance, pa.float64())])]
        return pa.table(columns, ["query_id", "chunk_id", "copies", "distance"])

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {entries.schema['chunk_id'].dataType.simpleString()}, copies long, distance double"
    return asked.groupBy("__block", "__set").cogroup(entries.groupBy("__block", "__set")).applyInArrow(run, kinds)


def near_cells(queries: DataFrame, centroids: np.ndarray, vector: str) -> DataFrame:
    """queries once for each of their PROBES nearest cells."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) and len(shared.value):
                rough, _ = products(matrix(batch.column(vector)), shared.value)
                cells = np.argsort(rough, axis=1)[:, :PROBES]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{kinds}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def block_cells(index: DataFrame, collection: str) -> DataFrame:
    """The block that each cell of a collection begins in, of how many it has its entries, and how many entries the collection has.

    Blocks are cut along cells, of which a collection has MOST_CELLS at most; only a cell of over BLOCK entries lies in several.
    """
    cells = index.groupBy(collection, "cell").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(collection)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.select(collection, "cell", F.floor(before / BLOCK).alias("__first"), F.ceil(F.col("__n") / BLOCK).alias("__parts"), F.sum("__n").over(whole).alias("__entries"))


def search(queries: DataFrame, index: DataFrame, chunks: DataFrame, centroids: np.ndarray, k: int, collection: str = "doc_fp", vector: str = "embedding") -> DataFrame:
    """query_id, chunk_id, the collection, squared distance and rank of the k nearest chunks of each query; reads the index several times."""
    given = queries.filter(F.col(vector).isNotNull())
    alone = given.groupBy(collection, vector).agg(F.min("query_id").alias("query_id"))
    sets = alone.groupBy(collection).agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("__sets"))
    shares = 1 + index.count() // BLOCK
    block = lambda number: F.when(F.col("__entries") <= SMALL, F.pmod(F.xxhash64(collection), F.lit(shares))).otherwise(F.xxhash64(collection, number))
    cells = block_cells(index, collection).join(sets, collection)
    numbers = F.sequence(F.col("__first"), F.col("__first") + F.col("__parts") - 1)
    of_cells = cells.select(collection, "cell", F.explode(numbers).alias("__number"), "__entries").select(collection, "cell", block(F.col("__number")).alias("__block"))
    dealt = F.col("__first") + F.pmod(F.xxhash64("chunk_id"), F.col("__parts"))
    entries = index.join(cells, [collection, "cell"]).select("chunk_id", collection, vector, "cell", "radius", F.col("n").alias("copies"), block(dealt).alias("__block"), F.explode(F.sequence(F.lit(0), F.col("__sets") - 1)).alias("__set"))
    asked = alone.join(sets, collection).withColumn("__set", F.pmod(F.xxhash64("query_id"), F.col("__sets")).cast("int")).drop("__sets")
    probing = near_cells(asked, centroids, vector).join(of_cells, [collection, "cell"]).withColumn("bound", F.lit(float("inf")))
    measured = candidates(probing, entries, centroids, k, collection, vector)
    by_query = Window.partitionBy("query_id")
    # the k-th distance so far, copies counted; without k chunks nothing is out
    up_to = F.sum("copies").over(by_query.orderBy("distance", "chunk_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounds = measured.withColumn("__up_to", up_to).groupBy("query_id").agg(F.min(F.when(F.col("__up_to") >= k, F.col("distance"))).alias("u"))
    bound = F.coalesce(F.sqrt("u") * (1 + SLACK) + SLACK, F.lit(float("inf")))
    bounded = asked.join(bounds, "query_id", "left").withColumn("bound", bound).drop("u").withColumn("cell", F.lit(None).cast("int"))
    found = candidates(bounded.join(of_cells.select(collection, "__block").distinct(), collection), entries, centroids, k, collection, vector)
    best = found.withColumn("__n", F.row_number().over(by_query.orderBy("distance", "chunk_id"))).filter(F.col("__n") <= k).drop("__n")
    # all chunks of the vectors, k of one vector at most
    repeated = index.filter("n > 1").select(collection, vector, F.col("chunk_id").alias("entry"))
    copies = limit_per_source(chunks.select(collection, vector, "chunk_id").join(repeated, [collection, vector]).select("entry", "chunk_id"), k, "chunk_id", "entry")
    expanded = best.filter("copies > 1").withColumnRenamed("chunk_id", "entry").join(copies, "entry").select("query_id", "chunk_id", "distance")
    ranked = best.filter("copies = 1").select("query_id", "chunk_id", "distance").unionByName(expanded)
    ranked = ranked.withColumn("rank", F.row_number().over(by_query.orderBy("distance", "chunk_id"))).filter(F.col("rank") <= k)
    askers = given.select(F.col("query_id").alias("__asker"), collection, vector).join(alone, [collection, vector]).select("query_id", "__asker", collection)
    return ranked.join(askers, "query_id").select(F.col("__asker").alias("query_id"), collection, "chunk_id", "distance", "rank")


def retrieve_topk(queries: DataFrame, chunks: DataFrame, k: int, collection: str = "doc_fp", vector: str = "embedding", cells: int | None = None) -> DataFrame:
    """The k nearest chunks of each query within its collection, by squared L2 distance: centroids, index and search in one."""
    k = max(1, k)
    centroids = fit_centroids(chunks, vector, cells)
    index = checkpointed(build_index(chunks, centroids, collection, vector))
    return search(queries, index, chunks, centroids, k, collection, vector)
