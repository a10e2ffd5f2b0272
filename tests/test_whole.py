"""Queries and operators that have to cover all of their input."""

import re
from collections import defaultdict

from matchflow import plans
from matchflow.functions import text as X
from matchflow.operators import audit as A
from matchflow.operators import layout as Y
from matchflow.operators.keys import resolve_keys


def test_flagship_reads_whole_texts(spark, tmp_path):
    head = "word " * 5000
    texts = [head + "education", head + "experience, 7 years of it", head + "education"]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in plans.QUERIES["flagship"](spark, str(tmp_path)).collect()}
    assert {i: (r.chars, r.years) for i, r in got.items()} == {0: (len(texts[0]), 0), 1: (len(texts[1]), 7)}


def test_the_cap_stays_where_it_is_asked_for(spark):
    df = spark.createDataFrame([("a" * 20_001,)], "x string")
    row = df.select(X.sanitise_untrusted("x").alias("cut"), X.sanitise_untrusted("x", most=None).alias("whole"), X.fence_block("x", "T").alias("fenced")).first()
    assert row.whole == "a" * 20_001 and row.cut.startswith("a" * 20_000 + "\n\n[[TRUNCATED") and row.cut in row.fenced


def test_resolve_keys_resolves_every_order(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority").collect()
    keys, headers = defaultdict(set), defaultdict(list)
    for n, doc, level in sorted(orders):
        keys[doc].add([f"Acme {level}", f"acme {level.lower()} Jan 2020", "Globex North team lead", "nothing"][n % 4])
        headers[doc].append((n, f"Acme {level}" if n % 3 == 0 else "Lead of North, Globex"))

    def tokens(text):
        return {w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 2 and w not in A.KEY_STOP_WORDS and not w.isdigit()}

    def best(key, places):
        found = []
        for place, header in places:
            k, h, share = key.lower().strip(), header.lower().strip(), len(tokens(key) & tokens(header)) / max(1, len(tokens(key)))
            if k == h:
                found.append((0, 0, 0, place, header))
            elif h.startswith(k) or k.startswith(h) or k in h:
                found.append((1, 0, 0, place, header))
            elif share >= 0.6:
                found.append((2, -share, len(header), place, header))
        return min(found)[-1] if found else None

    got = [tuple(r) for r in plans.QUERIES["resolve_keys"](spark, sf_dir).select("doc_id", "key", "header").collect()]
    want = {(doc, key, best(key, headers[doc])) for doc in keys for key in keys[doc]}
    assert len(got) == len(want) and set(got) == want


def test_repeated_headers_meet_a_key_once(spark):
    keys = spark.createDataFrame([(1, "Acme North")], "doc_id int, key string")
    headers = spark.createDataFrame([(1, "Acme", 5), (1, "Acme North Lead", 3)] + [(1, "Acme", k) for k in range(6, 40)], "doc_id int, header string, place int")
    assert [tuple(r) for r in resolve_keys(keys, headers).collect()] == [(1, "Acme North", "Acme North Lead")]


def test_columns_come_from_peaks_of_line_starts(spark):
    pages = {
        1: [20.0] * 10 + [220.0] * 10 + [420.0] * 10,  # three columns
        2: [30.0] * 6 + [200.0] * 24,  # a sidebar left of the middle
        3: [40.0] * 26 + [400.0] * 4,  # a right column with an eighth of the lines
        4: [40.0] * 10 + [90.0] * 10,  # an indent
        5: [40.0, 500.0],
    }
    rows = [(1, page, k, x, float(k % 10)) for page, xs in pages.items() for k, x in enumerate(xs)]
    got = {(r.page, r.line_no): (r.column, r.place) for r in Y.reading_order(spark.createDataFrame(rows, "doc_id int, page int, line_no int, x0 double, y0 double"), 600.0).collect()}
    for page, xs in pages.items():
        bins = [sum(int(x / 600 * 20) == k for x in xs) for k in range(20)]
        peaks = []
        for k, n in enumerate(bins):
            if n >= max(3, int(0.1 * len(xs))) and (not peaks or k - peaks[-1] >= 3):
                peaks.append(k)
        edges = [(a + b) / 2 / 20 * 600 for a, b in zip(peaks, peaks[1:])]
        order = sorted((sum(x >= e for e in edges), float(k % 10), x, k) for k, x in enumerate(xs))
        assert [got[page, k] for *_, k in order] == [(column, place + 1) for place, (column, *_) in enumerate(order)]
    assert [len({c for (p, _), (c, _) in got.items() if p == page}) for page in pages] == [3, 2, 2, 1, 1]


def test_novel_terms_of_several_targets_are_distinct(spark):
    turn = lambda texts: spark.createDataFrame([(1, t) for t in texts], "pair_id int, text string")
    got = A.novel_terms(turn(["known words"]), turn(["Fresh word", "fresh idea", "known"])).collect()
    assert sorted(r.term for r in got) == ["fresh", "idea"]


def test_keys_of_one_document_with_many_headers(spark):
    """100,000 headers of one document: keys equal to one, inside one, begun by one, or sharing words with one."""
    from pyspark.sql import functions as F

    many = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("Team lead number"), "id", F.lit(" of group"), F.col("id") % 97).alias("header"), F.col("id").alias("place"))
    keys = ["team LEAD number7 of group7", "number99999 of group", "Team lead number5 of group5 and more", "number123 chief group26", "chief of nothing", "", None]
    got = {r.key: r.header for r in resolve_keys(spark.createDataFrame([(1, k) for k in keys], "doc_id int, key string"), many).collect()}
    assert got == {
        keys[0]: "Team lead number7 of group7",
        keys[1]: f"Team lead number99999 of group{99999 % 97}",
        keys[2]: "Team lead number5 of group5",
        keys[3]: "Team lead number123 of group26",
        keys[4]: None,
        "": None,
        None: None,
    }


def keys_by_hand(keys, headers):
    low = lambda t: (t or "").strip(" ").lower()
    words = lambda t: {w for w in re.split("[^a-z0-9]+", low(t)) if len(w) >= 2 and w not in A.KEY_STOP_WORDS and not w.isdigit()}
    for key in keys:
        k, found = low(key), None
        if k:
            equal = [h for h in headers if low(h) == k]
            held = [h for h in headers if k in low(h) or k.startswith(low(h))]
            best = sorted((-len(words(k) & words(h)) / len(words(k)), len(h), i) for i, h in enumerate(headers) if words(k) and len(words(k) & words(h)) / len(words(k)) >= 0.6)
            found = equal[0] if equal else held[0] if held else headers[best[0][2]] if best else None
        yield key, found


def test_keys_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["acme", "North", "lead", "Data", "x", "of", "role", "42", "ab", "Globex"]) for _ in range(rng.randint(1, n)))
    for _ in range(3):
        headers = list(dict.fromkeys(text(4) for _ in range(12)))
        keys = list(dict.fromkeys([text(5) for _ in range(60)] + ["a", "ac", "h l"]))
        h = spark.createDataFrame([(1, t, i) for i, t in enumerate(headers)], "doc_id int, header string, place int")
        got = {r.key: r.header for r in resolve_keys(spark.createDataFrame([(1, k) for k in keys], "doc_id int, key string"), h).collect()}
        assert got == dict(keys_by_hand(keys, headers))


def test_similar_texts_equal_brute_force(spark, monkeypatch):
    """Links of batches with copies, near copies and a token that every text has, in tiles of a few rows."""
    import random

    from matchflow.operators import similarity as S

    monkeypatch.setattr(S, "TILE", 20)
    rng = random.Random(3)
    letters = [f"{a}{b}x" for a in "abcdefgh" for b in "mnopqrst"]
    rows = []
    for i in range(240):
        base = rng.sample(letters, rng.randint(1, 14)) if i % 3 == 0 or not rows else [w if rng.random() > 0.15 else rng.choice(letters) for w in rng.choice(rows[-20:])[2].split()]
        rows.append((rng.choice("pq"), i, " ".join({*base, "every"})))
    rows += [("p", 900, None), ("p", 901, ""), (None, 902, "every")] + [("q", 1000 + k, "same words here") for k in range(40)]
    got = sorted(map(tuple, S.batch_similarity(spark.createDataFrame(rows, "source string, doc_id long, text string"), "source").collect()))
    sets = {(b, i): frozenset(w for w in (t or "").split()) for b, i, t in rows if t and b}
    first = {}
    for (b, i), s in sorted(sets.items()):
        first.setdefault((b, s), i)
    want = [(b, first[b, s], i, 1.0) for (b, i), s in sets.items() if first[b, s] < i]
    alone = [(b, i, s) for (b, s), i in first.items()]
    for b, i, s in alone:
        for c, j, t in alone:
            if b == c and i < j and round(len(s & t) / len(s | t), 6) >= 0.7:
                want.append((b, i, j, round(len(s & t) / len(s | t), 6)))
    assert got == sorted(want)


def test_pages_take_linear_time():
    import time

    from matchflow.sources.pages import Tree

    took = []
    for n in (4_000, 40_000):
        html = "".join(f"<div class='c{i % 7}'>w{i} v </x>" for i in range(n))
        began = time.perf_counter()
        tree = Tree(html)
        assert len(tree.words) == 2 * n and tree.elements[0].last_word == 2 * n and tree.first(".c3").at == 3
        assert all(tree.first(".c5", within=e) for e in tree.elements[: n // 2])
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1
