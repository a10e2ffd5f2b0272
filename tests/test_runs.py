"""Funnels, sketches and documents with layouts against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchflow.operators import runs as R
from matchflow.operators.outline import document_quality

START = dt.datetime(2024, 1, 1)


def funnel_by_hand(rows, steps, days):
    counts = [0] * len(steps)
    for user in {u for u, _, _ in rows}:
        mine = [(t, e) for u, t, e in rows if u == user]
        start = last = None
        for k, step in enumerate(steps):
            times = [t for t, e in mine if e == step and (last is None or last <= t <= start + dt.timedelta(days=days))]
            if not times:
                break
            last = min(times)
            start = start or last
            counts[k] += 1
    return counts


@pytest.mark.parametrize("seconds", [60, 3600, 86_400])
def test_funnel_equals_brute_force(spark, monkeypatch, seconds):
    monkeypatch.setattr(R, "SLICE_SECONDS", seconds)
    rng = random.Random(seconds)
    steps = ["a", "b", "c", "d"]
    rows = [(f"u{rng.randrange(40)}", START + dt.timedelta(minutes=rng.choice([0, 1, 5, 30]) * rng.randrange(600)), rng.choice("abcdxy")) for _ in range(900)]
    df = spark.createDataFrame(rows, "distinct_id string, ts timestamp_ntz, event string")
    got = R.funnel(df, steps, days=2)
    assert [r.users for r in got.orderBy("step").collect()] == funnel_by_hand(rows, steps, 2)
    assert [r.users for r in R.funnel(df.limit(0), steps).orderBy("step").collect()] == [0, 0, 0, 0]
    with pytest.raises(ValueError, match="differ"):
        R.funnel(df, ["a", "a"])


def test_a_funnel_shuffles_its_events_once(spark):
    df = spark.createDataFrame([("u", START, "a")], "distinct_id string, ts timestamp_ntz, event string")
    plan = R.funnel(df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange hashpartitioning") == 2


def test_sketches_merge_within_their_error(spark):
    df = spark.range(200_000).select(
        F.timestamp_seconds(1_704_067_200 + F.col("id") * 7).alias("ts"),
        F.lit("view").alias("event"),
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("distinct_id"),
        (F.col("id") % 1000).cast("double").alias("value"),
    )
    daily = R.daily_sketches(df)
    for period in ("week", "month"):
        exact = {r[0]: r for r in df.groupBy(F.to_date(F.date_trunc(period, "ts"))).agg(F.countDistinct("distinct_id").alias("n"), F.count("*").alias("events")).collect()}
        found = R.merged_sketches(daily, period).collect()
        assert len(found) == len(exact)
        for r in found:
            assert abs(r.users - exact[r[0]].n) <= 0.04 * exact[r[0]].n and r.events == exact[r[0]].events
            assert abs(r.p50 - 500) <= 20 and abs(r.p90 - 900) <= 20
    assert R.merged_sketches(R.daily_sketches(df.limit(0)), "week").count() == 0


def test_layouts_lower_the_score(spark):
    text = "Summary experience skills " + "• did it • saw it • won it " * 30
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " Date of birth: x"), (4, text), (5, text), (6, text + " gender")], "doc_id int, text string")
    layout = spark.createDataFrame([(1, 1, 1, False), (2, 13, 1, False), (3, 2, 2, True), (4, 0, 1, False), (5, 1, 1, True)], "doc_id int, pages int, columns int, has_sidebar boolean")
    got = {r.doc_id: (r.score, r.status, r.warnings, r.errors) for r in document_quality(docs, layout=layout).collect()}
    assert got == {
        1: (100, "pass", [], []),
        2: (90, "warn", ["long"], []),
        3: (65, "warn", ["designer"], []),
        4: (0, "block", [], ["no_pages"]),
        5: (75, "warn", ["designer"], []),
        6: (75, "warn", ["designer"], []),
    }
