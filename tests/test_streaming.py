"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from matchflow.operators import history as H
from matchflow.operators import telemetry as T
from matchflow.plans.registry import traces
from matchflow.sources.traces import read_traces, telemetry_report, write_traces
from matchflow.streaming import jobs as J


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """Traces as JSON lines in a few files, with damaged lines among them."""
    folder = tmp_path_factory.mktemp("traces")
    t = traces(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).drop("k", "key_idx", "max_tokens_requested")
    t.repartitionByRange(3, "ts").write.mode("append").json(f"file://{folder}/a")
    (folder / "a" / "bad.json").write_text('{"agent": "x", "ts": \nnot json\n\n')
    return f"file://{folder}/a"


def drained(df, spark, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def test_bad_lines_are_dropped(spark, sf_dir, landed):
    assert read_traces(spark, landed).count() == traces(spark, sf_dir).count()


def test_payloads_are_cut(spark, tmp_path):
    df = spark.createDataFrame([("r", "a", "x" * 600, "y", 1.239)], "run_id string, agent string, prompt string, response string, duration_ms double")
    write_traces(df, f"file://{tmp_path}/t")
    row = spark.read.json(f"file://{tmp_path}/t").first()
    assert row.prompt_chars == 600 and len(row.prompt) < 560 and row.duration_ms == 1.24


def test_report(spark, sf_dir):
    report = telemetry_report(traces(spark, sf_dir))
    assert report["run"].count() == 1 and all(df.columns for df in report.values())


def test_budget(spark, landed, sf_dir):
    got = drained(J.stream_budget(J.stream_traces(spark, landed), 20), spark, "budget")
    want = T.budget_ledger(traces(spark, sf_dir), 20).select("run_id", "event_id", F.col("used").cast("long").alias("used"), "state")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_windows(spark, landed):
    got = drained(J.stream_tpm(J.stream_traces(spark, landed)), spark, "tpm", "complete")
    want = read_traces(spark, landed).groupBy(F.window("ts", "60 seconds").start.alias("window_start")).agg(F.count(F.lit(1)).alias("calls"))
    assert got.select("window_start", "calls").exceptAll(want).count() == 0 and got.count() == want.count()


def test_history(spark, tmp_path):
    kinds = "user_key string, url_norm string, title string, company string, source string, match_score int, shown_at timestamp, first_seen_at timestamp, seen_count long, applied boolean, applied_at timestamp"
    empty = spark.createDataFrame([], kinds)
    shown = spark.sql("select concat('u', id % 3) user_key, concat('p', id % 5) url_norm, concat('t', id) title, 'c' company, 's' source, cast(id as int) match_score, timestamp_seconds(id) shown_at, id seq from range(40)")
    write = J.history_writer(spark, f"file://{tmp_path}/h", empty)
    for k in range(4):
        write(shown.filter(f"seq div 10 = {k}"), k)
    write(shown.filter("seq div 10 = 3"), 3)  # run again
    got = J.history_table(spark, f"file://{tmp_path}/h", empty).drop("part")
    want = H.mark_shown(empty, shown)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    # a batch writes only the parts of its users
    write(shown.filter("user_key = 'u1' and seq > 30"), 4)
    assert spark.read.parquet(f"file://{tmp_path}/h/version=4").select("user_key").distinct().count() == 1
    again = J.history_table(spark, f"file://{tmp_path}/h", empty).drop("part")
    want = H.mark_shown(want, shown.filter("user_key = 'u1' and seq > 30"))
    assert again.exceptAll(want).count() == want.exceptAll(again).count() == 0
    # versions that two later ones follow go; the table stays
    before = J.versions_of_parts(spark, f"file://{tmp_path}/h")
    assert J.compact_history(spark, f"file://{tmp_path}/h") == sum(max(0, len(v) - 2) for v in before.values()) > 0
    assert {p: v[-2:] for p, v in before.items()} == J.versions_of_parts(spark, f"file://{tmp_path}/h")
    kept = J.history_table(spark, f"file://{tmp_path}/h", empty).drop("part")
    assert kept.exceptAll(want).count() == want.exceptAll(kept).count() == 0
    write(shown.filter("user_key = 'u1' and seq > 30"), 4)  # run again, after the compaction
    kept = J.history_table(spark, f"file://{tmp_path}/h", empty).drop("part")
    assert kept.exceptAll(want).count() == want.exceptAll(kept).count() == 0
    marks = spark.sql("select 'u1' user_key, 'p1' url_norm, true applied, timestamp_seconds(99) at union all select 'u2', 'new', false, timestamp_seconds(98)")
    J.history_writer(spark, f"file://{tmp_path}/h", empty, H.mark_applied)(marks, 5)
    marked = J.history_table(spark, f"file://{tmp_path}/h", empty).drop("part")
    want = H.mark_applied(want, marks).select(*empty.columns)
    assert marked.exceptAll(want).count() == want.exceptAll(marked).count() == 0


def test_run_cap_and_resets(spark, tmp_path):
    events = spark.sql("select concat('u', id % 3) distinct_id, id event_id, timestamp_seconds(1700000000 + id * 60) ts, id % 2 key_idx, cast(abs(50 - id * 7 % 90) * 1000 as long) remaining from range(60)")
    events.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    got = drained(J.stream_run_cap(stream, 3), spark, "cap")
    day = F.to_date("ts")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("distinct_id", day).orderBy("ts", "event_id"))
    want = events.select("distinct_id", day.cast("string").alias("day"), "event_id", nth.cast("long").alias("nth"), (nth > 3).alias("blocked"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    got = drained(J.stream_quota_reset(stream, 20000), spark, "resets")
    want = T.quota_resets(events, 20000).select("key_idx", "event_id", "before", "remaining")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 3


def test_first_postings_pass(spark, tmp_path):
    p = spark.sql("select id seq, case when id % 5 = 0 then '' else concat('https://x.org/', id % 7, '/') end url, timestamp_seconds(1700000000 + id) ts from range(70)")
    p.write.parquet(f"file://{tmp_path}/p")
    got = drained(J.stream_dedupe_postings(spark.readStream.schema(p.schema).parquet(f"file://{tmp_path}/p")), spark, "firsts")
    assert got.count() == 14 + 7 and got.filter("url <> ''").select("url_norm").distinct().count() == 7


def more(spark, folder, name, rows):
    """One more file of calls: run_id, event_id and minutes since a start."""
    df = spark.createDataFrame([(r, e, 1_700_000_000 + 60 * m) for r, e, m in rows], "run_id string, event_id long, at long")
    df.select("run_id", "event_id", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.parquet(f"file://{folder}/in/{name}")


def run_once(spark, folder, job):
    stream = spark.readStream.schema("run_id string, event_id long, ts timestamp").option("recursiveFileLookup", "true").parquet(f"file://{folder}/in")
    q = job(stream).writeStream.outputMode("append").option("checkpointLocation", f"file://{folder}/check").trigger(availableNow=True).format("parquet").start(f"file://{folder}/out")
    q.awaitTermination(120)
    q.stop()
    return spark.read.parquet(f"file://{folder}/out")


def test_budgets_go_on_after_a_restart_and_drop_late_rows(spark, tmp_path):
    job = lambda s: J.stream_budget(s, 3)
    more(spark, tmp_path, "a", [("r", 1, 0), ("r", 2, 1), ("s", 3, 5)])
    run_once(spark, tmp_path, job)
    more(spark, tmp_path, "b", [("r", 4, 300), ("r", 5, 301)])
    run_once(spark, tmp_path, job)
    # the watermark stands at 241 minutes: 200 is too late, 280 is within it
    more(spark, tmp_path, "c", [("r", 6, 200), ("r", 7, 280)])
    got = {r.event_id: (r.run_id, r.used, r.state) for r in run_once(spark, tmp_path, job).collect()}
    assert got == {1: ("r", 1, "ok"), 2: ("r", 2, "ok"), 3: ("s", 1, "ok"), 4: ("r", 3, "ok"), 5: ("r", 4, "rejected"), 7: ("r", 5, "not_run")}
    # a day later run r is forgotten, by its timer; run s had its next call before the watermark passed a day
    more(spark, tmp_path, "d", [("s", 8, 301 + 60 * 26)])
    run_once(spark, tmp_path, job)
    more(spark, tmp_path, "e", [("r", 9, 302 + 60 * 26)])
    got = {r.event_id: (r.run_id, r.used) for r in run_once(spark, tmp_path, job).collect()}
    assert got[8] == ("s", 2) and got[9] == ("r", 1)


def test_rows_come_in_order(spark, tmp_path):
    job = lambda s: J.stream_in_order(s, ["run_id"], "10 minutes")
    more(spark, tmp_path, "a", [("r", 1, 20), ("r", 2, 3), ("s", 3, 12)])
    run_once(spark, tmp_path, job)
    more(spark, tmp_path, "b", [("r", 4, 15), ("r", 5, 40), ("s", 6, 1)])  # 6 is late: the watermark is at 10
    run_once(spark, tmp_path, job)
    more(spark, tmp_path, "c", [("r", 7, 90)])
    out = run_once(spark, tmp_path, job)
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 5]
    files = sorted(out.select(F.input_file_name().alias("f"), "event_id", "ts").collect(), key=lambda r: r.ts)
    assert [r.event_id for r in files] == [2, 3, 4, 1, 5]


def test_a_bucketed_history_is_read_without_a_shuffle(spark):
    kinds = "user_key string, url_norm string, title string, company string, source string, match_score int, shown_at timestamp, first_seen_at timestamp, seen_count long, applied boolean, applied_at timestamp"
    shown = spark.sql("select concat('u', id % 7) user_key, concat('p', id % 50) url_norm, concat('t', id) title, 'c' company, 's' source, cast(id as int) match_score, timestamp_seconds(id) shown_at, id seq from range(400)")
    history = H.mark_shown(spark.createDataFrame([], kinds), shown)
    stored = J.save_bucketed(history, "history_of_tests", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = H.mark_shown(stored, shown.filter("seq % 3 = 0"))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # the batch is shuffled, by its own aggregate; the stored table is not
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        want = H.mark_shown(history, shown.filter("seq % 3 = 0"))
        assert merged.exceptAll(want).count() == want.exceptAll(merged).count() == 0
        per_key = stored.groupBy("user_key", "url_norm").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in per_key
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table history_of_tests")
