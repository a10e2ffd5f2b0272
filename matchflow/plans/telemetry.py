"""Call-trace queries on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.operators import telemetry as T
from matchflow.plans.registry import TRACES, query, traces


def _counts(keys: str, label: str, name: str, top: str = "") -> str:
    """SQL for label counts as text."""
    return f"""SELECT {keys}, array_to_string([e.l || ':' || cast(-e.n AS string) for e in {'list_slice(' if top else ''}list(struct_pack(n := -n, l := {label}) ORDER BY -n, {label}){f', 1, {top})' if top else ''}], ',') AS {name}
        FROM (SELECT {keys}, {label}, count(*) AS n FROM t GROUP BY ALL) AS c GROUP BY {keys}"""


_T = f"WITH t AS ({TRACES})"
_BY_AGENT = f"""{_T}, a AS (SELECT agent, count(*) AS calls, sum(total_tokens)::BIGINT AS tokens, sum(prompt_chars)::BIGINT AS prompt_chars, sum(response_chars)::BIGINT AS response_chars,
        round(sum(duration_ms), 2) AS duration_ms, count(error) AS errors, count_if(truncated)::BIGINT AS truncations FROM t GROUP BY agent),
    p AS ({_counts('agent', 'provider', 'providers')}), m AS ({_counts('agent', 'model', 'models')}),
    r AS (SELECT a.*, round(tokens / calls, 4) AS avg_tokens, CASE WHEN prompt_chars > 0 THEN round(response_chars / prompt_chars, 4) ELSE 0 END AS response_ratio,
        round(duration_ms / calls, 4) AS avg_latency_ms, providers, models FROM a JOIN p USING (agent) JOIN m USING (agent))"""
_WINDOWS = f"""{_T}, f AS (SELECT run_id, min(epoch_us(ts)) AS t0 FROM t GROUP BY run_id),
    w AS (SELECT t.*, t0, ((epoch_us(ts) - t0) // 1000000) // 60 AS idx FROM t JOIN f USING (run_id)),
    x AS (SELECT run_id, idx, make_timestamp(((any_value(t0) // 1000000) + idx * 60) * 1000000) AS window_start, count(*) AS calls, sum(total_tokens)::BIGINT AS tokens,
        count_if(provider LIKE 'gemini%')::BIGINT AS gemini_calls, count_if(provider LIKE 'groq%')::BIGINT AS groq_calls FROM w GROUP BY run_id, idx),
    c AS ({_counts('run_id, idx', 'agent', 'agents').replace('FROM t ', 'FROM w ')}),
    windows AS (SELECT x.*, agents FROM x JOIN c USING (run_id, idx))"""
_FLAG = "CASE WHEN gemini_calls > 5 THEN 'rpm_breach' WHEN calls > 30 THEN 'high_burst' END"
_JOBS = f"""{_T}, a AS (SELECT job_id, count(*) AS calls, sum(total_tokens)::BIGINT AS tokens, round(sum(duration_ms), 2) AS duration_ms, min(ts) AS first_ts, max(ts) AS last_ts,
        count(error) AS errors, count_if(truncated)::BIGINT AS truncations FROM t GROUP BY job_id), c AS ({_counts('job_id', 'agent', 'agents')}), j AS (SELECT a.*, agents FROM a JOIN c USING (job_id))"""
_DRIFT = """j2 AS (SELECT run_id, job_id, min(ts) AS first_ts, sum(total_tokens) AS tokens FROM t GROUP BY ALL),
    p2 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_ts, job_id) AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM j2),
    drift AS (SELECT run_id, jobs, earlier, later, jobs >= 3 AND coalesce(later > 1.3 * earlier, false) AS drifts FROM
        (SELECT run_id, max(n) AS jobs, round(avg(CASE WHEN pos <= n // 2 THEN tokens END), 4) AS earlier, round(avg(CASE WHEN pos > n // 2 THEN tokens END), 4) AS later FROM p2 GROUP BY run_id) AS h)"""
_QUOTA = f"WITH t AS (SELECT event_id, key_idx, ts, total_tokens AS used, 50000 - (k * 500) AS remaining FROM ({TRACES}) AS x)"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    return t.select("event_id", "key_idx", "ts", F.col("total_tokens").alias("used"), (F.lit(50000) - F.col("k") * 500).alias("remaining"))


@query(f"{_BY_AGENT} SELECT * FROM r")
def by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.by_agent(traces(spark, sf_dir))


@query(f"{_BY_AGENT} SELECT agent, tokens, row_number() OVER (ORDER BY tokens DESC, agent)::INT AS place FROM r")
def order_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.order_agents(T.by_agent(traces(spark, sf_dir))).select("agent", "tokens", "place")


@query(f"{_WINDOWS} SELECT * FROM windows")
def tpm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tpm_windows(traces(spark, sf_dir))


@query(f"{_WINDOWS} SELECT run_id, idx, calls, gemini_calls, {_FLAG} AS flag FROM windows")
def window_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.window_flags(T.tpm_windows(traces(spark, sf_dir))).select("run_id", "idx", "calls", "gemini_calls", "flag")


@query(f"{_JOBS} SELECT * FROM j")
def per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.per_job(traces(spark, sf_dir))


@query(f"{_JOBS} SELECT job_id, first_ts, row_number() OVER (ORDER BY first_ts, job_id)::INT AS place FROM j")
def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.order_jobs(T.per_job(traces(spark, sf_dir))).select("job_id", "first_ts", "place")


@query(f"{_T} SELECT count(*) AS calls, count(error) AS errors, count_if(truncated)::BIGINT AS truncations, sum(total_tokens)::BIGINT AS tokens, round(sum(duration_ms), 2) AS duration_ms, min(ts) AS first_ts, max(ts) AS last_ts FROM t")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.run_totals(traces(spark, sf_dir))


@query(f"{_T}, {_DRIFT} SELECT * FROM drift")
def job_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.job_drift(traces(spark, sf_dir))


@query(
    f"""{_WINDOWS}, {_DRIFT}, z AS (SELECT 'rpm_breach' AS rule, (count(*) FILTER ({_FLAG} = 'rpm_breach'))::DOUBLE AS measure, 0.0 AS limit_ FROM windows
    UNION ALL SELECT 'truncation_share', round(count_if(truncated) / count(*), 6), 0.1 FROM t
    UNION ALL SELECT 'response_ratio', max(x), 1.5 FROM (SELECT CASE WHEN sum(prompt_chars) > 0 THEN round(sum(response_chars) / sum(prompt_chars), 4) ELSE 0 END AS x FROM t GROUP BY agent) AS q
    UNION ALL SELECT 'token_drift', count_if(drifts)::DOUBLE, 0.0 FROM drift) SELECT rule, measure, measure > limit_ AS fired FROM z"""
)
def suspicions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.suspicions(traces(spark, sf_dir))


@query(f"{_T} SELECT event_id, agent, job_id, ts, response_chars, max_tokens_requested FROM t WHERE truncated")
def truncation_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.truncation_incidents(traces(spark, sf_dir))


@query(f"{_T} {_counts('job_id', 'agent', 'top_agents', '3')}")
def top_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_agents(traces(spark, sf_dir))


@query(
    f"""{_T}, u AS (SELECT *, epoch_us(ts) AS us FROM t),
    n AS (SELECT event_id, run_id, ts, us, count(*) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN 5000000 PRECEDING AND 5000000 FOLLOWING) AS concurrent FROM u),
    b AS (SELECT * FROM n WHERE concurrent > 1 ORDER BY concurrent DESC, us, event_id LIMIT 10)
    SELECT b.event_id, b.run_id, b.ts, b.concurrent, string_agg(u.agent || '(' || u.provider || ')', ',' ORDER BY u.us, u.agent || '(' || u.provider || ')') AS members
    FROM b JOIN u ON u.run_id = b.run_id AND u.us BETWEEN b.us - 5000000 AND b.us + 5000000 GROUP BY ALL"""
)
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bursts(traces(spark, sf_dir))


@query(
    f"""{_T}, l AS (SELECT event_id, run_id, agent, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id)::INT AS used, row_number() OVER (PARTITION BY run_id, agent ORDER BY ts, event_id)::INT AS agent_used FROM t)
    SELECT *, CASE WHEN used <= 100 THEN 'ok' WHEN used = 101 THEN 'rejected' ELSE 'not_run' END AS state FROM l"""
)
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.budget_ledger(traces(spark, sf_dir), 100)


@query(f"{_QUOTA}, l AS (SELECT *, lag(remaining) OVER (PARTITION BY key_idx ORDER BY ts, event_id) AS before FROM t) SELECT event_id, key_idx, ts, before, remaining FROM l WHERE remaining > before + 25000")
def quota_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quota_resets(_snapshots(spark, sf_dir), 50000)


@query(f"{_QUOTA} SELECT key_idx, ts, remaining, event_id FROM t QUALIFY row_number() OVER (PARTITION BY key_idx ORDER BY ts DESC, event_id DESC) = 1")
def latest_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_quota(_snapshots(spark, sf_dir))


@query(
    f"""{_QUOTA}, l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key_idx ORDER BY ts DESC, event_id DESC) = 1),
    s AS (SELECT 14000000::BIGINT AS pool, (SELECT sum(used)::BIGINT FROM t) AS used, count(*) AS reporting, sum(remaining)::BIGINT AS reported FROM l),
    r AS (SELECT pool, used, reporting, CASE WHEN reporting = 7 THEN least(greatest(0, pool - used), reported) ELSE greatest(0, pool - used) END AS remaining FROM s)
    SELECT *, remaining // 22000 AS runs_left, (remaining * 100) // pool AS percent FROM r"""
)
def quota_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quota_summary(_snapshots(spark, sf_dir), 7, 2_000_000)


@query(f"{_T} SELECT event_id, run_id, agent FROM t WHERE run_id = (SELECT max(run_id) FROM t)")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_run(traces(spark, sf_dir)).select("event_id", "run_id", "agent")
