"""The prefix trie, periodic runs and sharding against brute force, on odd tables, and with pieces of a few rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in nodes.items())


def random_conversations(n, seed, hot=25):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 60) if rng.random() < 0.6 else hot, rng.choice([None, *range(10)]), rng.choice(["u", "a", None, ""]), rng.choice(["x", "yé", None, "z", ""])) for _ in range(n)]
    return [*rows, (None, 1, "u", "x"), (-3, 0, "u", "x"), (2**60, 0, "u", "x"), (61, None, None, None), (1000, 0, "u", "x")]


@pytest.mark.parametrize(("n", "piece_rows"), [(300, 40), (300, 9), (300, 50_000), (0, 10)])
def test_trie_equals_brute_force(spark, n, piece_rows):
    from matchflow.llm.prefix_trie import prefix_trie

    rows = random_conversations(n, n + piece_rows) if n else []
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 AS depth", "'x' AS piece", "2 AS ka")
    assert sorted(map(tuple, prefix_trie(df, piece_rows).collect())) == trie_by_hand(rows)


def test_summaries_of_pieces_carry_on():
    """One long conversation, its base and a follower, cut anywhere: the same prefixes."""
    import pandas as pd

    from matchflow.llm.prefix_trie import carries, piece_prefixes, piece_summary

    rng = random.Random(5)
    for trial in range(200):
        lengths = [rng.randint(1, 14) for _ in range(4)]
        turns = [(c, rng.randint(0, 5), rng.randint(0, 5), 1) for c, n in zip((10, 11, 13, 15), lengths, strict=True) for _ in range(n)]
        cuts = sorted({0, len(turns), *(rng.randint(0, len(turns)) for _ in range(rng.randint(0, 6)))})

        def table(cuts):
            pieces = [pd.DataFrame(turns[a:b], columns=["conv_id", "x", "y", "n_bytes"]).assign(piece=i) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            begins = carries([piece_summary(p) for p in pieces])
            return sorted(t for p in pieces for t in piece_prefixes(p, begins[p.piece.iloc[0]]).itertuples(index=False, name=None))

        assert [t for t in table(cuts) if t[-1]] == [t for t in table([0, len(turns)]) if t[-1]], trial
        assert len(table(cuts)) == len(table([0, len(turns)]))


def test_a_long_chain_is_ranked(spark):
    """One conversation of 4,000 turns, in pieces of 50 nodes: the tour crosses all of them twice."""
    from matchflow.llm.prefix_trie import prefix_trie

    rows = [(5, i, "u", str(i)) for i in range(4000)]
    found = {r.depth: r for r in prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), 50).collect()}
    assert len(found) == 4001 and all(r.n_leaves == 1 and r.n_convs == 1 and r.saved_tokens == 0 for r in found.values())
    assert found[4000].ends_sha256 == hashlib.sha256(b"5").hexdigest() and found[4000].n_children == 0


def test_local_chains():
    from matchflow.llm.prefix_trie import local_chains

    head, last, sums = local_chains(np.array([1, 2, -1, 0, -1, 4]), np.array([[1], [2], [4], [8], [16], [32]]))
    assert head.tolist() == [3, 3, 3, 3, 5, 5] and last.tolist() == [2, 2, 2, 2, 4, 4] and sums[:, 0].tolist() == [7, 6, 4, 15, 16, 48]


# 12


def runs_by_hand(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
                if not smaller:
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    from matchflow.llm.periodic_runs import word_runs

    rng = random.Random(7)
    for trial in range(1500):
        words = []
        while len(words) < rng.choice((8, 40, 120)):
            unit = [rng.choice("ab" if trial % 2 else "abcdefghij") for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
        words = [w.encode() for w in words]
        assert word_runs(words) == runs_by_hand(words), words
    long = [b"word"] * 200_000
    assert word_runs(long) == [(0, 200_000, 1)]
    lone = [str(i).encode() for i in range(100_000)]
    assert word_runs(lone) == []


def test_segments_are_stable():
    from matchflow.llm.periodic_runs import surviving_segments

    rng = np.random.default_rng(3)
    for kinds in (2, 8, 30):
        codes = rng.integers(0, kinds, 200)
        found = surviving_segments(codes)
        assert all(np.bincount(codes[b:e])[codes[b:e]].min() >= 4 and e - b >= 6 for b, e in found)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_runs_of_odd_tables(spark, odd, empty):
    from matchflow.llm.periodic_runs import collapsed, periodic_runs

    found = periodic_runs(odd.withColumn("runs", odd.ids)).collect()
    assert len(found) == odd.count() and {len(r.runs) for r in found if r.doc_id != 7} == {0}
    assert [(r.runs[0].start, r.runs[0].length, r.runs[0].period, r.collapsed) for r in found if r.doc_id == 7] == [(0, 20000, 1, "word")]
    assert {r.collapsed for r in found if r.doc_id in (2, 3, 4)} == {""}
    words = [b"x", *[b"a", b"b"] * 4, b"y"]
    assert collapsed(words, [(1, 8, 2)]) == b"x a b y"
    assert periodic_runs(empty).count() == 0


def test_planted_runs(spark):
    from matchflow.llm.queries import with_planted_runs

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 7 * 5)) if i % 11 else None) for i in range(300)] + [(None, "a b"), (300, " \n")]
    got = {r.doc_id: r.text for r in with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[j] if j < a else words[a + (j - a) % p] for j in range(n))
        assert got[i] == text


# 13


def test_shards_of_odd_tables(spark, odd, empty):
    from matchflow.llm.sharding import even_tree, sharded

    many = odd.union(odd.filter("doc_id = 9").selectExpr("explode(array_repeat(struct(*), 25000)) AS r").select("r.*"))
    found = sharded(many, even_tree(8)).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r.doc_id for r in many.select("doc_id").collect())
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and r.grown_shard in (r.shard, 8)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id == 9}) == 1
    assert sharded(empty, even_tree(8)).count() == 0


def assigned(spark, tree, n=20_000):
    from pyspark.sql import functions as F

    from matchflow.llm.sharding import shard_of

    return [r[0] for r in spark.range(n).orderBy("id").select(shard_of(F.col("id").cast("string"), tree)).collect()]


def test_movement_stays_in_changed_subtrees(spark):
    from dataclasses import replace

    from matchflow.llm.sharding import even_tree, grown

    tree = even_tree(8)
    region, rack = (lambda s: s // 4), (lambda s: s // 2)
    before = assigned(spark, tree)
    shares = np.bincount(before, minlength=8) / len(before)
    assert np.abs(shares - 1 / 8).max() < 0.01
    after = assigned(spark, grown(tree))
    assert all(b in (a, 8) for a, b in zip(before, after, strict=True)) and abs(after.count(8) / len(after) - 1 / 9) < 0.01
    heavy = [replace(s, weight=3.0) if s.number == 2 else s for s in tree]
    after = assigned(spark, heavy)
    assert abs(after.count(2) / len(after) - 3 / 10) < 0.01
    for a, b in zip(before, after, strict=True):
        if a != b:  # into the heavier region, or within it into the heavier rack or shard
            assert (region(a), region(b)) == (1, 0) or region(a) == region(b) == 0 and (rack(b) == 1 and (rack(a) != 1 or b == 2))
    assert [a for a in before if region(a) == 1 and a] and all(b == a for a, b in zip(before, after, strict=True) if region(b) == 1)
    with pytest.raises(ValueError, match="positive"):
        assigned(spark, [replace(tree[0], weight=0.0)], 1)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_periodic_runs", "op13_sharding"])
def test_query_equals_its_sql(spark, sf_dir, name):
    from matchflow.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, sf_dir).toPandas()
    plain = lambda df: sorted(tuple(re.sub(r"\.0$", "", str(v)).replace("<NA>", "nan").replace("None", "nan") for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
