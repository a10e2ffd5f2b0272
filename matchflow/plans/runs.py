"""Run, review, history, KPI, funnel and retention queries on orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.operators import history as H
from matchflow.operators import runs as R
from matchflow.plans.registry import EVENTS, RUNS, product_events, query, runs

_R, _E = f"WITH r AS ({RUNS})", f"WITH e AS ({EVENTS})"
FUNNEL = ["signup", "view", "click", "purchase"]


@query(f"{_R}, s AS (SELECT user_id, list(score ORDER BY score) AS l FROM r GROUP BY user_id) SELECT user_id, list_max(l) AS best, l[len(l) // 2 + 1] AS median, len(list_filter(l, lambda x: x >= 60))::BIGINT AS at_threshold FROM s")
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_stats(runs(spark, sf_dir), "user_id", 60)


@query(f"{_R} SELECT status, round(avg(score), 1) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(score) AS n, sum(greatest(attempts - 1, 0))::BIGINT AS retries FROM r GROUP BY status")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.review_stats(runs(spark, sf_dir), "status")


@query(f"{_R} SELECT run_id, score, CASE WHEN score >= 60 THEN 'matched' ELSE 'skipped' END AS bucket FROM r")
def split_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_by_threshold(runs(spark, sf_dir), 60).select("run_id", "score", "bucket")


@query(f"{_R} SELECT run_id, CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'amber' ELSE 'red' END AS tier FROM r")
def score_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", R.score_tier("score").alias("tier"))


@query(f"{_R} SELECT run_id, CASE status WHEN 'F' THEN 'hard_terminal' WHEN 'O' THEN 'terminal' ELSE 'running' END AS kind FROM r")
def classify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", R.classify_status("status", ["F"], ["O"]).alias("kind"))


@query(f"{_R}, s AS (SELECT *, CASE WHEN score >= 60 THEN 'matched' ELSE 'skipped' END AS bucket FROM r) SELECT user_id, run_id, bucket, score, row_number() OVER (PARTITION BY user_id, bucket ORDER BY score DESC, run_id)::INT AS place FROM s")
def rank_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_matches(R.split_by_threshold(runs(spark, sf_dir), 60), "user_id", "run_id").select("user_id", "run_id", "bucket", "score", "place")


@query(f"{_R} SELECT user_id, run_id, score FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, run_id) = 1")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_attempt(runs(spark, sf_dir), "user_id", "run_id")


@query(
    f"""{_R}, g AS (SELECT user_id, run_id, row_number() OVER w AS round, coalesce(sum(score) OVER (PARTITION BY user_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS matches_before
    FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run_id)) SELECT user_id, run_id, round::INT AS round, matches_before, matches_before < 200 AND round <= 5 AS runs FROM g"""
)
def round_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_gate(runs(spark, sf_dir), "user_id", "run_id", "score", 200, 5).select("user_id", "run_id", "round", "matches_before", "runs")


_ATTEMPTS = """SELECT o_orderkey AS run_id, o_orderkey % 12 AS n_rewrites, o_orderkey % 31 AS n_bullets,
    CASE o_orderkey % 11 WHEN 0 THEN 'Fabricated skill' WHEN 1 THEN 'invented title' ELSE 'fine' END AS feedback, CASE o_orderkey % 13 WHEN 0 THEN 'a fabrication' END AS weaknesses,
    cast(floor(o_totalprice / 5000) AS int) AS score, CASE o_orderkey % 9 WHEN 0 THEN 'accept' ELSE 'retry' END AS verdict, o_orderkey % 3 AS attempt,
    o_orderkey % 4 = 0 AS strong_source, o_orderkey % 17 = 0 AS all_reverted, o_orderkey % 7 = 0 AS body_reverted FROM orders"""


@query(
    f"""WITH a AS ({_ATTEMPTS}), f AS (SELECT *, n_rewrites < greatest(2, n_bullets // 5) AND n_bullets >= 5 AND attempt < 2 AS few,
    contains(lower(feedback), 'fabricat') OR contains(lower(coalesce(weaknesses, '')), 'fabricat') OR contains(lower(feedback), 'invent') AS fab FROM a),
    t AS (SELECT *, CASE WHEN strong_source THEN 65 WHEN NOT (few OR fab OR all_reverted OR body_reverted) THEN 65 ELSE 72 END AS effective_threshold FROM f)
    SELECT run_id, effective_threshold, CASE WHEN NOT few AND NOT fab AND (verdict = 'accept' OR score >= effective_threshold) THEN 'accept' WHEN attempt < 2 THEN 'retry'
    WHEN score < 50 AND (all_reverted OR body_reverted) THEN 'discard' ELSE 'keep_best' END AS decision FROM t"""
)
def accept_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.plans.registry import bound

    return R.accept_gate(bound(spark, sf_dir, _ATTEMPTS, "orders")).select("run_id", "effective_threshold", "decision")


@query(f"{_E}, n AS (SELECT event_id, distinct_id, cast(cast(ts AS date) AS string) AS day, row_number() OVER (PARTITION BY distinct_id, cast(ts AS date) ORDER BY ts, event_id)::INT AS nth FROM e) SELECT *, nth > 3 AS blocked FROM n")
def daily_run_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_run_cap(product_events(spark, sf_dir), 3).select("event_id", "distinct_id", F.col("day").cast("string").alias("day"), "nth", "blocked")


@query(f"{_R} SELECT user_id, string_agg(run_id || ' ' || experience_level || ' ' || score, chr(10) ORDER BY run_id) AS digest, count(*) AS matches FROM r WHERE score >= 60 GROUP BY user_id")
def match_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", "run_id", "experience_level", "score")
    return R.match_digest(runs(spark, sf_dir).filter("score >= 60"), "user_id", "run_id", line)


@query(f"{_R}, m AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN '' ELSE 'u' || run_id % 1000 END AS url, 't' || run_id % 700 AS title, score, status FROM r) SELECT run_id, url, title FROM m WHERE score >= 60 AND coalesce(nullif(url, ''), title) NOT IN (SELECT coalesce(nullif(url, ''), title) FROM m WHERE status = 'F')")
def unsent(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("run_id") % 5 == 0, "").otherwise(F.concat(F.lit("u"), F.col("run_id") % 1000))
    m = runs(spark, sf_dir).withColumn("url", url).withColumn("title", F.concat(F.lit("t"), F.col("run_id") % 700))
    return R.unsent(m, m.filter("status = 'F'"), F.col("score") >= 60).select("run_id", "url", "title")


@query(f"{_R}, s AS (SELECT status, unnest([status, experience_level, status]) AS mode FROM r) SELECT status, mode, count(*) AS decisions FROM s GROUP BY ALL")
def decision_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array(*(F.struct(F.col(c).alias("mode")) for c in ("status", "experience_level", "status")))
    return R.decision_mix(runs(spark, sf_dir).withColumn("trace", steps), "trace", "status")


_KPI = f"""SELECT experience_level, status, status = 'F' AS completed, score % 7 AS matched, score % 30 AS scraped, score % 5 AS filtered_early, attempts - 1 AS retried, attempts * 12 AS llm_calls,
    run_id % 3 AS previewed, run_id % 2 AS sent, 1 AS attempted, run_id % 10 AS clicks, coalesce(applied, false) AS applied, run_id % 4 > 0 AS in_place, score * 3 AS seconds FROM ({RUNS}) AS r"""
_Q = lambda a, b, name: f"round({a} / nullif({b}, 0), 6) AS {name}"
_N = lambda c: f"sum({c}::BIGINT)"
_MEASURES = ", ".join(
    [
        "count(*) AS runs",
        _Q(_N("completed"), "count(*)", "completion_rate"),
        _Q(_N("matched"), _N("scraped"), "match_yield"),
        _Q(_N("retried"), _N("matched"), "retry_rate"),
        _Q(_N("filtered_early"), _N("scraped"), "early_exit_rate"),
        _Q(_N("sent"), _N("attempted"), "send_success"),
        _Q("count_if(previewed > 0 AND sent > 0)", "count_if(previewed > 0)", "preview_to_send"),
        _Q(_N("applied"), _N("matched"), "applied_rate"),
        _Q(_N("in_place"), _N("completed"), "output_fidelity"),
        _Q(f"({_N('matched')} + {_N('filtered_early')})", _N("llm_calls"), "agentic_efficiency"),
        _Q(_N("sent"), _N("clicks"), "automation_value"),
        "round(quantile_cont(llm_calls, 0.5), 4) AS llm_calls_median",
        "round(quantile_cont(llm_calls, 0.9), 4) AS llm_calls_p90",
        "round(quantile_cont(seconds, 0.5), 4) AS seconds_median",
    ]
)


def _kpi_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.plans.registry import bound

    return bound(spark, sf_dir, _KPI, "orders")


@query(f"WITH k AS ({_KPI}) SELECT {_MEASURES} FROM k")
def kpi_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.kpi_core(_kpi_runs(spark, sf_dir))


@query(f"WITH k AS ({_KPI}) SELECT experience_level, status, {_MEASURES}, grouping(experience_level, status)::INT AS level FROM k GROUP BY GROUPING SETS ((experience_level), (status), ())")
def kpi_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.kpi_core(_kpi_runs(spark, sf_dir), ["experience_level", "status"])


@query(f"{_E} SELECT cast(cast(date_trunc('week', ts) AS date) AS string) AS week, count(DISTINCT distinct_id) AS users FROM e WHERE event = 'view' GROUP BY 1")
def weekly_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weekly_active(product_events(spark, sf_dir).filter("event = 'view'")).withColumn("week", F.col("week").cast("string"))


@query(
    f"""{_E}, w AS (SELECT date_trunc('week', ts)::DATE AS week, event, count(*) AS events FROM e GROUP BY ALL)
    SELECT week::VARCHAR AS week, event, events, true AS users_close, true AS p50_close, true AS p90_close FROM w"""
)
def sketched_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks from daily sketches, beside exact counts: users within 4 %, the values at the percentiles within 2 % (and one row) of their rank."""
    e = product_events(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    both = e.join(R.merged_sketches(R.daily_sketches(e), "week", "event"), ["week", "event"])
    at = lambda p: (F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below"), F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_up_to"))
    exact = both.groupBy("week", "event", "events", "users").agg(F.countDistinct("distinct_id").alias("n"), *at("p50"), *at("p90"))
    off = 0.02 * F.col("events") + 1
    close = lambda p, q: ((F.col(f"{p}_below") <= q * F.col("events") + off) & (F.col(f"{p}_up_to") >= q * F.col("events") - off)).alias(f"{p}_close")
    return exact.select(F.col("week").cast("string").alias("week"), "event", "events", (F.abs(F.col("users") - F.col("n")) <= 1 + 0.04 * F.col("n")).alias("users_close"), close("p50", 0.5), close("p90", 0.9))


@query(
    f"{_R}, w AS (SELECT user_id, date_trunc('week', ts) AS week, count_if(applied) AS sent FROM r GROUP BY ALL) SELECT sum(sent)::BIGINT AS sent, count(*) AS user_weeks, round(sum(sent) / count(*), 6) AS throughput FROM w"
)
def weekly_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return R.weekly_throughput(r.select(F.col("user_id").alias("distinct_id"), "ts", F.coalesce("applied", F.lit(False)).alias("sent")))


_STEP = "s{k} AS (SELECT distinct_id, min(start) AS start, min(e.ts) AS last FROM s{p} JOIN e USING (distinct_id) WHERE event = '{step}' AND e.ts >= s{p}.last AND e.ts <= start + INTERVAL 7 DAY GROUP BY 1)"


@query(
    f"""{_E}, s0 AS (SELECT distinct_id, min(ts) AS start, min(ts) AS last FROM e WHERE event = 'signup' GROUP BY 1), {', '.join(_STEP.format(k=k, p=k - 1, step=s) for k, s in enumerate(FUNNEL) if k)},
    u AS ({' UNION ALL '.join(f"SELECT {k + 1} AS step, '{s}' AS event, count(*) AS users FROM s{k}" for k, s in enumerate(FUNNEL))}) SELECT *, round(users / (SELECT count(*) FROM s0), 6) AS conversion FROM u"""
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.funnel(product_events(spark, sf_dir), FUNNEL)


@query(
    f"""{_E}, c AS (SELECT distinct_id, min(ts) AS t0 FROM e WHERE event = 'signup' GROUP BY 1), z AS (SELECT *, cast(cast(date_trunc('week', t0) AS date) AS string) AS cohort FROM c), n AS (SELECT cohort, count(*) AS size FROM z GROUP BY 1),
    b AS (SELECT cohort, ((epoch_us(ts) - epoch_us(t0)) // 604800000000)::INT AS week, count(DISTINCT distinct_id) AS users FROM e JOIN z USING (distinct_id) WHERE event = 'purchase' AND ts > t0 GROUP BY ALL)
    SELECT cohort, week, users, size, round(users / size, 6) AS share FROM b JOIN n USING (cohort) WHERE week < 8"""
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retention(product_events(spark, sf_dir), "signup", "purchase").withColumn("cohort", F.col("cohort").cast("string"))


@query(f"{_E} SELECT cast(cast(ts AS date) AS string) AS day, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM e WHERE event = 'purchase' GROUP BY 1")
def daily_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_percentile(product_events(spark, sf_dir), "purchase").withColumn("day", F.col("day").cast("string"))


@query(f"{_E} SELECT cast(cast(ts AS date) AS string) AS day, count(*) AS total FROM e WHERE event = 'purchase' GROUP BY 1")
def totals_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals_per_day(product_events(spark, sf_dir), "purchase").withColumn("day", F.col("day").cast("string"))


@query(f"{_R} SELECT experience_level, count(*) AS total FROM r GROUP BY 1")
def totals_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals_by(runs(spark, sf_dir), F.col("experience_level"), "experience_level")


_HISTORY = f"""SELECT cast(user_id AS string) AS user_key, concat('u', cast(run_id % 50 AS string)) AS url_norm, max(concat('t', cast(run_id % 9 AS string))) AS title, max(experience_level) AS company, max(status) AS source,
    max(score) AS match_score, max(ts) AS shown_at, min(ts) AS first_seen_at, count(*) AS seen_count, bool_or(applied) AS applied, max(CASE WHEN applied THEN ts END) AS applied_at FROM ({RUNS}) AS r GROUP BY 1, 2"""
#: Where one table has to be both, the even runs are the history and the odd ones are shown.
_EVEN = _HISTORY.replace("AS r GROUP BY", "AS r WHERE run_id % 2 = 0 GROUP BY")
_SHOWN = f"""SELECT cast(user_id AS string) AS user_key, CASE WHEN run_id % 11 = 0 THEN '' ELSE concat('u', cast(run_id % 50 AS string)) END AS url_norm, concat('n', cast(run_id % 7 AS string)) AS title, experience_level AS company, status AS source,
    score AS match_score, ts AS shown_at, run_id AS seq FROM ({RUNS}) AS r WHERE run_id % 2 = 1"""


def _history(spark: SparkSession, sf_dir: str, sql: str = _HISTORY) -> DataFrame:
    from matchflow.plans.registry import bound

    return bound(spark, sf_dir, sql, "orders")


@query(f"WITH h AS ({_HISTORY}) SELECT user_key, count(*) AS total, coalesce(count_if(applied), 0)::BIGINT AS applied, (count(*) - coalesce(count_if(applied), 0))::BIGINT AS pending FROM h GROUP BY 1")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history_summary(_history(spark, sf_dir))


@query(f"WITH h AS ({_HISTORY}) SELECT user_key, url_norm, shown_at, row_number() OVER (PARTITION BY user_key ORDER BY shown_at DESC NULLS LAST, url_norm)::INT AS place FROM h")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.recent_history(_history(spark, sf_dir)).select("user_key", "url_norm", "shown_at", "place")


@query(
    f"""WITH h AS ({_EVEN}), s AS (SELECT * FROM ({_SHOWN}) AS x WHERE url_norm <> ''),
    b AS (SELECT user_key, url_norm, arg_max(title, seq) AS t, arg_max(company, seq) AS c, arg_max(source, seq) AS o, arg_max(match_score, seq) AS m, arg_max(shown_at, seq) AS a, count(*) AS n, min(shown_at) AS f FROM s GROUP BY ALL)
    SELECT user_key, url_norm, coalesce(t, title) AS title, coalesce(c, company) AS company, coalesce(o, source) AS source, coalesce(m, match_score) AS match_score, coalesce(a, shown_at) AS shown_at,
    coalesce(first_seen_at, f) AS first_seen_at, (coalesce(seen_count, 0) + coalesce(n, 0))::BIGINT AS seen_count, applied, applied_at FROM h FULL JOIN b USING (user_key, url_norm)"""
)
def mark_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.plans.registry import bound

    return H.mark_shown(_history(spark, sf_dir, _EVEN), bound(spark, sf_dir, _SHOWN, "orders"))


@query(
    f"""WITH h AS ({_EVEN}), m AS (SELECT user_key, url_norm, arg_max(seq % 4 = 1, shown_at) AS mark, max(CASE WHEN seq % 4 = 1 THEN shown_at END) AS at_ FROM (SELECT * FROM ({_SHOWN}) AS x WHERE url_norm <> '' QUALIFY row_number() OVER (PARTITION BY user_key, url_norm, shown_at ORDER BY seq) = 1) AS y GROUP BY ALL)
    SELECT user_key, url_norm, coalesce(mark, applied) AS applied, coalesce(at_, applied_at) AS applied_at, seen_count FROM h FULL JOIN m USING (user_key, url_norm)"""
)
def mark_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchflow.plans.registry import bound

    s = bound(spark, sf_dir, _SHOWN, "orders").filter("url_norm <> ''")
    first = s.groupBy("user_key", "url_norm", "shown_at").agg(F.min("seq").alias("seq"))
    marks = first.select("user_key", "url_norm", (F.col("seq") % 4 == 1).alias("applied"), F.col("shown_at").alias("at"))
    return H.mark_applied(_history(spark, sf_dir, _EVEN), marks).select("user_key", "url_norm", "applied", "applied_at", "seen_count")


@query(f"{_E} SELECT event_id, distinct_id, ts FROM e WHERE distinct_id NOT IN (SELECT distinct_id FROM e WHERE event = 'error' AND value > 300)")
def erase_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = product_events(spark, sf_dir)
    return H.erase_subject(e, e.filter("event = 'error' and value > 300"), "distinct_id").select("event_id", "distinct_id", "ts")


@query(f"{_E} SELECT event_id, ts FROM e WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.expire(product_events(spark, sf_dir), "2024-01-20 00:00:00").select("event_id", "ts")
