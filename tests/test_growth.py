"""What a query moves or forms as its tables grow, next to right results."""

import random


def test_texts_that_only_share_a_rare_token_form_no_pairs(spark, monkeypatch):
    """Ten groups of thirty texts with a token of their own, and else frequent ones: within the bounds of sizes and places, not of their bits."""
    from matchflow.operators import similarity as S

    rng = random.Random(5)
    pool = [f"{a}{b}w" for a in "abcdefgh" for b in "mnopqrst"]
    rows = [("p", i, " ".join([f"group{'abcdefghij'[i % 10]}", *rng.sample(pool, 19)])) for i in range(300)]
    rows.append(("p", 300, rows[0][2] + " alone"))
    formed, plain = [], S.verified
    monkeypatch.setattr(S, "verified", lambda pairs, *rest: formed.append(pairs.count()) or plain(pairs, *rest))
    got = [tuple(r) for r in S.batch_similarity(spark.createDataFrame(rows, "source string, doc_id long, text string"), "source").collect()]
    assert got == [("p", 0, 300, round(20 / 21, 6))] and formed[0] < 20


def test_keys_and_headers_are_not_broadcast(spark, monkeypatch):
    """Twenty thousand documents of equal headers make small files and large tables."""
    from pyspark.sql import functions as F

    from matchflow.operators import keys as K

    plans, plain = [], K.checkpointed
    physical = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(K, "checkpointed", lambda df: plain(physical(df)))
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    keys = ids.select("doc_id", F.lit("Acme North team").alias("key"))
    headers = ids.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Lead of Acme North team").otherwise("Globex").alias("header"), F.lit(1).alias("place"))
    got = physical(K.resolve_keys(keys, headers))
    assert got.filter("header = 'Lead of Acme North team'").count() == 10_000 and got.count() == 20_000
    assert not [p for p in plans if "Broadcast" in p]


def shuffled(spark, df):
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = total()
    got = df().collect()
    return got, total() - before


def test_rows_of_single_keys_are_not_shuffled(spark):
    """Words of one row a key stay where they are; keys of several rows, and null ones, are merged as before."""
    from matchflow.operators import audit as A
    from matchflow.operators import outline as O

    rng = random.Random(4)
    texts = {i: " ".join(f"{rng.choice('aAbB')}{rng.randrange(10**6):06d}x" for _ in range(300)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "id long, t string").selectExpr("id", "t", "split(t, ' ') as a", "array('aa ', 'AAA', 'aaa') as b")
    bytes_ = sum(map(len, texts.values()))
    got, moved = shuffled(spark, lambda: A.vocabulary(df, "id", "t"))
    assert {(r.id, r.term) for r in got} == {(i, w) for i, t in texts.items() for ws in [t.lower().split()] for w in [*ws, *map(" ".join, zip(ws, ws[1:]))]} and moved < bytes_ / 3
    got, moved = shuffled(spark, lambda: A.merge_terms(df, "id", "a", "b"))
    first = lambda ws: list({w.lower(): w for w in reversed(ws)}.values())[::-1]
    assert {r.id: sorted(r.terms) for r in got} == {i: sorted([*first(t.split()), "AAA"]) for i, t in texts.items()} and moved < bytes_ / 3
    got, moved = shuffled(spark, lambda: O.list_mode(df, "id", "a", "-"))
    assert {r.id: r.mode for r in got} == {i: max(dict.fromkeys(t.split()), key=t.split().count) for i, t in texts.items()} and moved < bytes_ / 3
    odd = spark.createDataFrame([(1, ["x", "y"]), (1, ["y"]), (2, ["b", "a", "b", "a"]), (3, [None]), (None, ["q"]), (None, ["q"]), (4, []), (5, None)], "id long, a array<string>")
    assert sorted(((r.id or 0), r.mode) for r in O.list_mode(odd, "id", "a", "-").collect()) == [(0, "q"), (1, "y"), (2, "b"), (3, "-")]
    assert sorted((r.id or 0, r.term) for r in A.vocabulary(odd.selectExpr("id", "array_join(a, ' ') as t"), "id", "t").collect()) == [(1, "x y"), (2, "a b"), (2, "b a")]


def test_pairs_of_one_class_are_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from matchflow.operators import postings as P

    monkeypatch.setattr(P, "POSTING_PART", 50, raising=False)
    text = lambda t: F.when(F.rand(1) < 0, "Chef").otherwise(t)
    candidates = spark.range(30).select(F.col("id").alias("candidate_id"), text("Senior (6-10)").alias("experience_level"))
    postings = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("seq"), text("Senior Product Manager").alias("title"), text("5+ years of work").alias("description"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = P.candidate_pairs(candidates, postings).select("candidate_id", "seq", F.spark_partition_id().alias("task")).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = pairs.task.value_counts()
    assert len(pairs) == 60_000 == len(pairs.drop_duplicates(["candidate_id", "seq"])) and len(tasks) > 2 and tasks.max() < 40_000


def test_lines_of_a_document_are_not_shuffled_for_its_roles(spark, sf_dir):
    """Only keys move; odd texts, null and repeated keys give the roles that windows over their lines give."""
    from matchflow.operators import outline as O
    from matchflow.plans import QUERIES

    size = sum(len(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect())
    got, moved = shuffled(spark, lambda: QUERIES["assign_roles"](spark, sf_dir))
    assert len(got) > 200 and moved < size / 10
    rng = random.Random(1)
    pool = ["Experience", "  Projects:: ", "Own Projects", "Skills", "", "   ", "- a", "• b  ", "  2. c", "plain", "  plain two ", "-x", "a: :", "Experience:\r", "x" * 50]
    pool += ["x" * 50 + ":", "• " + "y" * 60, "Education", "1) q\r", "\t• tab", "-", "- ", "Projects " + ":" * 60, "𝒳 wide", "- 𝒳", "Summary  "]
    rows = [(i % 280, "\n".join(rng.choice(pool) for _ in range(rng.randrange(30)))) for i in range(300)] + [(500, None), (501, ""), (502, "\n"), (None, "Experience\n- n"), (None, "- m\nP")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = docs.filter("doc_id >= 20")
    plain = lambda d: O.role_table(O.assign_roles(O.assign_sections(O.coalesce_bullets(O.doc_lines(d)))))
    roles = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert roles(O.document_roles(once)) == roles(plain(once)) and len(roles(plain(once))) > 200
    assert O.document_roles(docs.filter("doc_id is null")).count() == plain(docs.filter("doc_id is null")).count() > 0
    assert O.document_roles(docs).filter("doc_id < 20").count() == plain(docs).filter("doc_id < 20").count() > 0


def test_candidates_are_copied_as_often_as_cores_need(spark, monkeypatch):
    """A class of 50,000 postings, a thousand of the least parts: its candidates are shuffled for a few larger ones."""
    from pyspark.sql import functions as F

    from matchflow.operators import postings as P

    monkeypatch.setattr(P, "POSTING_PART", 50)
    monkeypatch.setattr(P, "PARTS_A_CORE", 2, raising=False)
    text = lambda t: F.when(F.rand(1) < 0, "Chef").otherwise(t)
    candidates = spark.range(1_000).select(F.col("id").alias("candidate_id"), text("Senior (6-10)").alias("experience_level"))
    postings = spark.range(50_000).select(F.col("id").alias("seq"), text("Senior Product Manager").alias("title"), text("5+ years of work").alias("description"))
    got, moved = shuffled(spark, lambda: P.candidate_pairs(candidates, postings).filter("candidate_id + seq < 2").select("candidate_id", "seq"))
    assert sorted(map(tuple, got)) == [(0, 0), (0, 1), (1, 0)] and moved < 2_000_000


def test_texts_are_compared_without_their_tokens(spark, monkeypatch):
    """Sets of 1 to 600 words in blocks of a few texts: links as by hand, and all that is shuffled is small next to the texts."""
    from matchflow.operators import similarity as S

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    pool, rows = [word() for _ in range(4_000)], []
    for i in range(400):
        base = rng.sample(pool, rng.choice([1, 2, 5, 40, 43, 90, 200, 600]))
        if i % 10 == 9:
            old = rows[rng.randrange(len(rows))][2].split()
            keep = rng.sample(old, max(1, int(len(old) * rng.uniform(0.7, 1))))
            base = list(dict.fromkeys([*keep, *rng.sample(pool, int(len(old) * rng.uniform(0, 0.2)))]))
        rows.append((rng.choice("ppq"), i, " ".join(base)))
    monkeypatch.setattr(S, "TILE", 60)
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string")
    got, moved = shuffled(spark, lambda: S.batch_similarity(docs, "source"))
    sets = [(b, i, set(t.split())) for b, i, t in rows]
    want = [(b, i, j, round(len(x & y) / len(x | y), 6)) for b, i, x in sets for c, j, y in sets if b == c and i < j and len(x & y) / len(x | y) >= 0.7]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10
    assert moved < sum(len(t) for *_, t in rows) * 0.7


def test_parities_bound_differences_at_all_sizes():
    """close keeps every pair that is similar, whatever the widths of both."""
    import numpy as np

    from matchflow.operators import similarity as S

    rng = random.Random(7)
    sets = []
    for n in [1, 2, 3, 10, 42, 43, 60, 85, 86, 170, 171, 342, 700, 1_400] * 2:
        base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        sets += [set(base), set(base[: max(1, int(n * 0.71))]), set(base[1:] + ["x"])]
    sets = sorted(sets, key=len)
    block = lambda part: (np.array([len(s) for s in part], "int32"), b"".join(S.parities(sorted(s)) for s in part))
    alike = lambda x, y: len(x & y) / len(x | y) >= 0.7
    x, y = S.close(block(sets), None, 0.7)
    assert {(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])} <= set(zip(x, y)) and len(x) < 200
    x, y = S.close(block(sets[:50]), block(sets[30:]), 0.7)
    assert {(i, j) for i, a in enumerate(sets[30:]) for j, b in enumerate(sets[:50]) if alike(a, b)} <= set(zip(x, y))


def test_keys_of_small_documents_are_shuffled_a_few_times(spark):
    """Parts of texts are only made for documents of many texts; both kinds of documents give what all keys by all headers give."""
    from test_whole import keys_by_hand

    from matchflow.operators.keys import resolve_keys

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["acme", "North", "lead", "Data", "x", "of", "role", "42", "ab", "Globex"]) for _ in range(rng.randint(1, n)))
    headers = {d: list(dict.fromkeys(text(5) for _ in range(200 if d % 40 == 0 else rng.randint(1, 6)))) for d in range(1_500)}
    asked = {d: [text(5) for _ in range(4)] + (["", "ac"] if d % 3 else ["q", "q"]) for d in range(1_520)}
    k = spark.createDataFrame([(d, t) for d, ts in asked.items() for t in ts] + [(None, "acme"), (3, None)], "doc_id int, key string")
    h = spark.createDataFrame([(d, t, i) for d, ts in headers.items() for i, t in enumerate(ts)] + [(None, "acme", 0)], "doc_id int, header string, place int")
    got = [tuple(r) for r in resolve_keys(k, h).collect()]
    want = [(d, *found) for d, ts in asked.items() for found in keys_by_hand(ts, headers.get(d, []))] + [(None, "acme", None), (3, None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and max(map(len, headers.values())) > 64
    small = "doc_id % 40 <> 0"
    got, moved = shuffled(spark, lambda: resolve_keys(k.filter(small), h.filter(small)))
    assert len(got) > 8_000 and moved < 2_000_000
