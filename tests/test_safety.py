"""Nested redaction and the SQL functions."""

from pyspark.sql import functions as F

from matchflow.operators.safety import redact_struct, register_sql


def test_nested_strings_are_redacted(spark):
    df = spark.sql("select struct(array(struct('a@b.org' as mail, 87 as n)) as xs, map('k', 'call +44 20 7946 0958') as m, true as ok, cast(null as string) as none) as s")
    s = redact_struct(df, ["s"]).first().s
    assert (s.xs[0].mail, s.xs[0].n, s.m["k"], s.ok, s.none) == ("[EMAIL]", 87, "call [PHONE]", True, None)
    again = redact_struct(redact_struct(df, ["s"]), ["s"]).first().s
    assert again == s
    assert redact_struct(df, ["s"], depth=1).first().s.xs is None


def test_sql_functions(spark):
    register_sql(spark)
    row = spark.sql("select upper_median(array(1D, 2D, 3D, 4D)) a, score_tier(61) b, search_title('Lead, Data') c, user_key(' A@b ') d, doc_fingerprint('x') e").first()
    assert tuple(row)[:4] == (3.0, "amber", "Lead", "a@b")
    assert row.e == spark.range(1).select(F.substring(F.sha2(F.lit("x"), 256), 1, 16)).first()[0]
