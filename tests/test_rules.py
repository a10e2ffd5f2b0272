"""Golden cases of the rules, and properties that hold for any input."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchflow.functions import guards as G
from matchflow.functions import levels as L
from matchflow.functions import structure as S
from matchflow.functions import text as X
from matchflow.operators import audit as A
from matchflow.operators import postings as P


def column(spark, values, make, schema="i int, x string"):
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_required_years(spark):
    asks = ["5+ years of experience", "Minimum 8 years needed", "At least 3 years in it", "3-7 years of work", "10 or more years", "2 to 4 years there", "no figure", "years", None]
    assert column(spark, asks, X.required_years) == [5, 8, 3, 3, 10, 2, 0, 0, 0]


@pytest.mark.parametrize(("level", "kept", "skipped"), [(0, [5], [8]), (1, [5, 7], [10]), (2, [5, 10], [12, 15]), (3, [8, 14], [18])])
def test_years_exit(spark, level, kept, skipped):
    got = column(spark, [*kept, *skipped], lambda x: L.years_exit(F.lit(level), x), "i int, x int")
    assert got == [None] * len(kept) + [25] * len(skipped)


def test_level_gap_penalty(spark):
    gaps = [1, 2, 3, 4, 5, 0, -1, -2, -3, -4, -5]
    assert column(spark, gaps, lambda g: L.level_gap_penalty(F.lit(100), g), "i int, x int") == [85, 70, 35, 35, 35, 100, 95, 88, 81, 80, 80]


def test_error_classes(spark):
    errors = ["HTTP 429", "Rate limit reached", "quota exceeded", "RESOURCE_EXHAUSTED", "Invalid API key", "connection refused", None]
    assert column(spark, errors, X.classify_error) == ["rate_limit"] * 4 + ["auth", "other", "other"]


def test_redaction(spark):
    text = "Jane Roe wrote from jane.roe@mail.org, call +44 20 7946 0958; jane again, 2020-2023."
    got = column(spark, [text, None], lambda x: X.redact_pii(x, F.lit("Jane Roe"), F.lit("me@x.org")))
    assert got == ["[CANDIDATE] wrote from [EMAIL], call [PHONE]; [CANDIDATE] again, [PHONE].", ""]


def test_skill_recovery(spark):
    df = spark.createDataFrame([(["automation workflows", "rust"], ["sql"], "built workflow automation for teams")], "missing array<string>, matched array<string>, cv string")
    row = P.split_missing(df, "missing", "matched", "cv").first()
    assert (row.missing, row.matched) == (["rust"], ["sql", "automation workflows"])


def test_urls(spark):
    urls = ["HTTPS://Ex.com/A/?utm_source=x&id=1&ref=#top", "http://x.org///", None, "", "not a url"]
    assert column(spark, urls, X.normalize_url) == ["https://ex.com/A?id=1", "http://x.org", "", "", "not a url"]


def test_urls_equal_the_parser(spark):
    from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

    track = {k.lower() for k in X.TRACKING_KEYS}

    def plain(url):
        p = urlparse(url.strip())
        kept = [(k, v) for k, v in parse_qsl(p.query) if k.lower() not in track]
        return urlunparse((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/"), "", urlencode(kept), ""))

    urls = [
        "https://Jobs.Ex.com/A/b;v=1?q=a+b&refId=3", "https://jobs.ex.com/A/b?q=a%20b", "HTTP://x.org:80/?", "jobs.Ex.com/Path?x=1", "//Host/p/", "mailto:Me@x.org", "https://x.org/a?e=%C3%A9~*(1)&b=%zz&c",
        "http:/only/path/", "https://x.org/a;p/b;q", "x?utm_Source=1&a=b%26c=d&&", "https://x.org/#frag?x=1", "https://x.org?a=1;b=2", "HTTPS://x.org/%7Eme", "http://", "",
    ]
    assert column(spark, urls, X.normalize_url) == [plain(u) for u in urls]
    assert column(spark, ["1 #", "a/ /", "x?refId=1&ref=2"], X.normalize_url) == ["1", "a", "x"]
    assert column(spark, ["x?refId=1&ref=2"], lambda u: X.normalize_url(u, compat=True)) == ["x?refId=1"]


def test_letter_precheck(spark):
    from matchflow.functions import letters

    body = "plain words of a letter that goes on " * 36
    given = [body, body + "Ninja", body + "my passion for it", body + "saved 1,250 hours", body + "saved 42 hours", "short", ""]
    got = column(spark, given, lambda x: letters.letter_precheck(x, F.lit("a cv with 42 things"), F.lit("a posting")))
    assert got == ["ok", "buzzword:ninja", "ok", "ungrounded_number:1,250", "ok", "word_count=1", "empty_inputs"]


def test_headings(spark):
    lines = ["Professional Summary:", "WORK EXPERIENCE", "Open-Source Projects", "project", "I like projects and more of them in life, truly so", "Awards", None]
    assert column(spark, lines, S.classify_heading) == ["summary", "experience", "projects", None, None, "awards", None]


def test_guards(spark):
    pairs = [
        ("Built systems for retail banks in Europe and Asia with care", "Built agentic AI systems for retail banks in Europe and Asia with care"),
        ("Shipped the MVP feature set for Acme in 2021", "Shipped the feature set for clients during the year 2021"),
        ("Cut costs by 40% for the Acme team over several quarters of work", "Cut costs for the Acme team over several long quarters of hard work"),
        ("Grew the Acme base by $5M over two years of steady work there", "Over two years of steady work, grew the base of Acme by $5M there"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, o string, r string")
    rows = df.select(G.keyword_jam("o", "r").alias("jam"), G.lost_content("o", "r").alias("lost"), G.lost_numbers("o", "r").alias("numbers")).orderBy("i").collect()
    assert [r.jam for r in rows] == [True, False, False, False]
    assert rows[1].lost == ["mvp", "acme"] and rows[2].numbers == ["40%"] and not rows[3].lost and not rows[3].numbers


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab 4%$0Z.", max_size=60), st.text(alphabet="ab 4%$0Z.", max_size=60)), min_size=1, max_size=8))
def test_an_accepted_rewrite_keeps_its_numbers(spark, pairs):
    df = spark.createDataFrame([(i, o, r) for i, (o, r) in enumerate(pairs)], "i int, original string, rewrite string")
    df = df.withColumns({"section": F.lit("experience"), "terms": F.array().cast("array<string>"), "source_text": F.lit(""), "sibling_numbers": F.array().cast("array<string>")})
    out = A.audit_rewrites(df)
    assert out.filter(F.size(G.lost_numbers("original", "accepted_text")) > 0).count() == 0
    assert out.filter("reason is not null and not (accepted_text <=> original)").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="htps:/.?#=&aA1 utm_source", max_size=40), min_size=1, max_size=20))
def test_normal_urls_stay(spark, urls):
    once = column(spark, urls, X.normalize_url)
    assert column(spark, once, X.normalize_url) == once
