"""Top-k retrieval against all distances, and how many of them it measures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.operators import retrieval as R

SCHEMA = "id long, doc_fp string, embedding array<float>"


def by_hand(queries, chunks, k):
    out = []
    for q, fp, x in queries:
        if x is not None:
            near = sorted((float(((np.float32(x).astype(float) - np.float32(c).astype(float)) ** 2).sum()), i) for i, f, c in chunks if f == fp and c is not None)[:k]
            out += [(q, i, pytest.approx(d), rank + 1) for rank, (d, i) in enumerate(near)]
    return sorted(out, key=lambda r: (r[0], r[3]))


def tables(spark, queries, chunks):
    frame = lambda rows, name: spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", name).withColumn("cell", F.lit("clash"))
    return frame(queries, "query_id").drop("cell"), frame(chunks, "chunk_id").drop("cell")


def found(df):
    return sorted(((r.query_id, r.chunk_id, r.distance, r["rank"]) for r in df.collect()), key=lambda r: (r[0], r[3]))


def test_topk_equals_all_distances_and_measures_few(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 20, (30, 8))
    chunks = [(i, "a", (centres[i % 30] + rng.normal(0, 1, 8)).tolist()) for i in range(3000)]
    queries = [(i, "a", x) for i, _, x in chunks[::100]]
    q, c = tables(spark, queries, chunks)
    measured, plain = [], R.candidates
    monkeypatch.setattr(R, "candidates", lambda *args: measured.append(plain(*args)) or measured[-1])
    assert found(R.retrieve_topk(q, c, 10)) == by_hand(queries, chunks, 10)
    pairs = sum(m.count() for m in measured)
    assert pairs < 0.1 * len(queries) * len(chunks), pairs


@pytest.mark.parametrize("cells", [1, 3, 50])
def test_topk_of_odd_tables(spark, cells):
    rng = np.random.default_rng(cells)
    points = rng.integers(-2, 3, (40, 2)).astype(float).tolist()  # many ties
    chunks = [(i, "ab"[i % 2], points[i % 40]) for i in range(120)]
    chunks += [(200, "a", None), (201, None, [0.0, 0.0]), (202, "lone", [9.0, 9.0])] + [(300 + i, "a", [0.5, 0.5]) for i in range(60)]
    queries = [(1, "a", [0.5, 0.5]), (2, "a", [0.5, 0.5]), (3, "b", [5.0, 5.0]), (4, "lone", [0.0, 0.0]), (5, "none", [0.0, 0.0]), (6, "a", None), (7, "b", points[1])]
    q, c = tables(spark, queries, chunks)
    assert found(R.retrieve_topk(q, c, 7, cells=cells)) == by_hand(queries, chunks, 7)
    assert R.retrieve_topk(q, c.limit(0), 7).count() == 0 and R.retrieve_topk(q.limit(0), c, 7).count() == 0


def test_a_cloud_of_many_dimensions_forms_few_rows(spark, monkeypatch):
    """No cell can be left out there, but only a block's nearest become rows; blocks are small, a cell of near copies spans several, sets of queries too."""
    for name, value in {"BLOCK": 250, "SMALL": 20, "ASKERS": 7}.items():
        monkeypatch.setattr(R, name, value, raising=False)
    rng = np.random.default_rng(5)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(0, 1, (n, 32))]
    near = [(np.ones(32) / 32**0.5 + rng.normal(0, 1e-4, 32)).tolist() for _ in range(700)]
    chunks = [(i, "a", x) for i, x in enumerate(unit(1300) + near)] + [(3000 + i, f"own{i % 9}", x) for i, x in enumerate(unit(30))]
    queries = [(i, fp, x) for i, fp, x in chunks if i % 100 == 0] + [(9000 + i, f"own{i}", x) for i, x in enumerate(unit(9))]
    q, c = tables(spark, queries, chunks)
    formed, plain = [], R.candidates
    monkeypatch.setattr(R, "candidates", lambda *args: formed.append(plain(*args)) or formed[-1])
    assert found(R.retrieve_topk(q, c, 5)) == by_hand(queries, chunks, 5)
    rows = sum(f.count() for f in formed)
    assert rows < 0.1 * len(queries) * len(chunks), rows


def test_a_block_multiplies_only_cells_within_the_bound():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (30, 8))
    x = np.repeat(centres, 50, axis=0) + rng.normal(0, 1, (1500, 8))
    cell, radius = R.nearest(x, centres)
    q = x[::100]
    distances = ((q[:, None] - x) ** 2).sum(axis=2)
    asked = pa.table({"embedding": q.tolist(), "doc_fp": ["a"] * len(q), "bound": np.sqrt(np.sort(distances, axis=1)[:, 4]) + 1e-9, "cell": pa.nulls(len(q), pa.int32())})
    entries = pa.table({"embedding": x.tolist(), "doc_fp": ["a"] * len(x), "cell": cell, "radius": radius})
    i, j, distance, pairs = R.met(asked, entries, centres, 5, "doc_fp", "embedding")
    assert [j[i == r].tolist() for r in range(len(q))] == np.argsort(distances, axis=1, kind="stable")[:, :5].tolist()
    assert np.allclose(distance, distances[i, j]) and pairs < 0.1 * len(q) * len(x)
