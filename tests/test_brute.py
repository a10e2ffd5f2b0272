"""Operators against plain Python: cards of landed pages, roles, columns, and queries that SQL does not express."""

import re

from matchflow import plans
from matchflow.operators import layout as Y
from matchflow.operators import outline as O
from matchflow.operators.postings import dedupe_first
from matchflow.sources import pages as P

LINKEDIN = """<div class="x base-card"><a class="base-card__full-link" href="/jobs/1?a=1&amp;b=2"></a><h3 class="base-search-card__title"> Data <b>Lead</b> </h3>
<h4 class="base-search-card__subtitle">Acme</h4><span class="job-search-card__location">Dublin</span><time>2 days ago</time></div>
<div class="base-card"><h3>no known class</h3></div><a href="/other">Other</a>"""
JOBSIE = """<article class="job"><span class="job-title">By class</span><a href="https://x.ie/2">Link</a><span class="recruiter-name">Hire Ltd</span><span class="date">today</span></article>
<article class="job"><h3>Third</h3><h2>Second</h2><a>no address</a><a href="rel">r</a></article><div class="job-result"><h2>not read</h2></div>"""
FALLBACK = """<p><a href="/jobs/view/7">Seven</a><a href="/about">About</a><a href="http://[bad/jobs/view">Broken</a><a href="https://y.ie/jobs/view/8">Eight</a></p>"""


def cards(spark, rows, board):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, card string")
    return [tuple(r) for r in P.board_cards(df, board, "Cork").orderBy("page_id", "card").collect()]


def test_cards_of_boards(spark):
    rows = [(2**53 + 1, "https://l.com/s", LINKEDIN, "x"), (None, "https://l.com/s", None, "x"), (3, None, "", "x")]
    assert cards(spark, rows, P.BOARDS["linkedin"]) == [
        (2**53 + 1, 0, "Data Lead", "Acme", "Dublin", "2 days ago", "https://l.com/jobs/1?a=1&b=2"),
        (2**53 + 1, 1, "N/A", "N/A", "Cork", "N/A", ""),
    ]
    assert cards(spark, [(1, "https://www.jobs.ie/s", JOBSIE, None), (2, "https://www.jobs.ie/s", FALLBACK, None)], P.BOARDS["jobsie"]) == [
        (1, 0, "By class", "Hire Ltd", "Cork", "today", "https://x.ie/2"),
        (1, 1, "Second", "N/A", "Cork", "N/A", "https://www.jobs.ie/rel"),
        (2, 0, "Seven", "See listing", "Cork", "N/A", "https://www.jobs.ie/jobs/view/7"),
        (2, 2, "Eight", "See listing", "Cork", "N/A", "https://y.ie/jobs/view/8"),
    ]


def test_an_open_card_reaches_to_the_end(spark):
    got = cards(spark, [(1, "https://a.b", "<li class='jobs-item'><h2>One</h2><li class='jobs-item'><h2>Two</h2>", None)], P.BOARDS["jobsie"])
    assert [r[2] for r in got] == ["One", "Two"]


def test_roles_without_a_signal_join_the_one_before(spark):
    headers = ["Clerk", "Acme 2019", "Team", None, "Acme – Lead", "Maybe", "Lead until Present", "March of it"]
    rows = [(1, s, "experience", k, h, [f"{s}.{k}"]) for s in (1, 2) for k, h in enumerate(headers)]
    df = spark.createDataFrame(rows, "doc_id int, section_no int, kind string, role_no int, header string, bullets array<string>")
    got = {(r.section_no, r.role_no): (r.header, r.bullets) for r in O.merge_fragmented_roles(df).collect()}
    for s in (1, 2):
        assert {k: v for (n, k), v in got.items() if n == s} == {
            0: ("Clerk", [f"{s}.0"]),
            1: ("Acme 2019", [f"{s}.1", f"{s}.2", f"{s}.3"]),
            4: ("Acme – Lead", [f"{s}.4", f"{s}.5"]),
            6: ("Lead until Present", [f"{s}.6"]),
            7: ("March of it", [f"{s}.7"]),
        }
    assert O.merge_fragmented_roles(df.limit(0)).count() == 0


def test_replica_columns(spark):
    starts = {1: [30.0, 55.0, 80.0] * 5, 2: [30.0] * 10 + [300.0] * 4, 3: [30.0] * 40 + [300.0] * 5, 4: [30.0, 300.0], 5: [30.0] * 9 + [None] * 30 + [300.0] * 4, 6: [None]}
    rows = [(d, x) for d, xs in starts.items() for x in xs]
    got = {r.doc_id: (r.columns, r.compatible) for r in Y.replica_columns(spark.createDataFrame(rows, "doc_id int, x0 double")).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (1, True), 4: (1, True), 5: (1, True), 6: (1, True)}


def test_one_pass_dedupe_gives_the_same_rows(spark):
    df = spark.createDataFrame([(k, f"k{k % 7}", k * 2) for k in range(50)], "seq int, key string, v int")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(dedupe_first(df, "key", ["seq"], keyed=True)) == rows(dedupe_first(df, "key", ["seq"])) and dedupe_first(df, "key", ["seq"], keyed=True).columns == df.columns


def test_long_dashes_of_every_turn(spark, sf_dir):
    talk = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}

    def plain(text):
        t = re.sub(r"(?<!\d)\s*[–—]\s*(?!\d)", ", ", text.replace(". ", " — "))
        return re.sub(r",\s*([.!?])", r"\1", re.sub(r",\s*,", ",", t))

    got = {(r.conv_id, r.turn): r.text for r in plans.QUERIES["strip_long_dashes"](spark, sf_dir).collect()}
    assert got == {k: plain(t) for k, t in talk.items()}


def test_redacted_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}

    def plain(text):
        name = " ".join(text.split(" ")[:2]).strip(" ")
        t = re.sub(re.escape("someone@example.com"), "[EMAIL]", text, flags=re.I)
        t = re.sub(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]", t)
        t = re.sub(r"(?<!\d)(?:\+?\d[\d\-\s().]{7,}\d)(?!\d)", "[PHONE]", t)
        t = re.sub(re.escape(name), "[CANDIDATE]", t, flags=re.I | re.A)
        for part in (p for p in re.split(r"\s+", name) if len(p) >= 3):
            t = re.sub(rf"\b{re.escape(part)}\b", "[CANDIDATE]", t, flags=re.I | re.A)
        return t

    got = {r.doc_id: r.redacted for r in plans.QUERIES["redact_pii"](spark, sf_dir).collect()}
    ascii_only = {k for k, t in docs.items() if t.isascii()}
    assert set(got) == set(docs) and len(ascii_only) > 10
    assert {k: got[k] for k in ascii_only} == {k: plain(docs[k]) for k in ascii_only}


def test_embeddings_are_hashed_words_of_unit_length(spark, sf_dir):
    from pyspark.ml.feature import HashingTF

    tf, at = HashingTF(numFeatures=64, inputCol="w"), {}
    chunks = {(r.doc_id, r.section, r.idx): r.text for r in plans.QUERIES["build_chunks"](spark, sf_dir).collect()}
    got = {(r.doc_id, r.section, r.idx): r.embedding for r in plans.QUERIES["embed_chunks"](spark, sf_dir).collect()}
    assert set(got) == set(chunks)
    for key in sorted(chunks)[:40]:
        want = [0.0] * 64
        for w in re.split(r"\s", chunks[key].lower()):
            if w not in at:
                at[w] = tf.indexOf(w)
            want[at[w]] += 1
        norm = sum(v * v for v in want) ** 0.5
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(got[key], want, strict=True))


def test_applied_postings_are_skipped(spark):
    from matchflow.operators.postings import filter_out_applied

    postings = spark.createDataFrame([(1, "u", "https://X.org/a/?utm_source=y"), (2, "u", ""), (3, "v", "https://x.org/a"), (4, "u", None), (5, "u", "https://x.org/b"), (6, None, "https://x.org/a")], "seq int, user_key string, url string")
    history = spark.createDataFrame([("u", "https://x.org/a", True), ("u", "https://x.org/a", True), ("u", "https://x.org/b", None), ("v", "https://x.org/c", True)], "user_key string, url_norm string, applied boolean")
    kept, skipped = filter_out_applied(postings, history)
    assert sorted(r.seq for r in kept.collect()) == [2, 3, 4, 5, 6] and [r.seq for r in skipped.collect()] == [1]


def test_references_that_no_semicolon_closes_are_text(spark):
    html = "<article><h1>A &amp;&amp;&amp</h1> R&D &copy 1 &notit; &#38; &lt;b&gt; &amp;lt; <a href='/x?a=1&copy=2&amp;b=3'>go</a></article>"
    df = spark.createDataFrame([(1, "https://a.b/c", html)], "page_id long, url string, html string")
    assert P.extract_description(df).first().description == "A &&&amp R&D &copy 1 &notit; & <b> &lt; go"
    assert P.extract_cards(df).first().url == "https://a.b/x?a=1&copy=2&b=3"


def test_a_batch_of_pages_is_met_in_slices(spark):
    df = spark.range(0, 1000, 1, 1).selectExpr("id as page_id", "cast(null as string) as url", "concat('<main>', id, '</main>') as html")
    got = P.parsed(df, lambda batches: (pdf.assign(n=len(pdf))[["page_id", "n"]] for pdf in batches), "n int").collect()
    assert sorted(r.page_id for r in got) == list(range(1000)) and max(r.n for r in got) <= 256
