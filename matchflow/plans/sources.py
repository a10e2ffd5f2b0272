"""Queries on what sources write and read: traces as JSON lines, run snapshots, reports, nested redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.operators.safety import redact_struct as redacted_struct
from matchflow.operators.written import shared_folder
from matchflow.plans.registry import TRACES, bound, query, table, traces
from matchflow.sources import traces as S

#: Turns as calls: whole texts as prompts, some of them twice as long as the cut.
_CALLS = """SELECT conv_id * 1000 + turn AS event_id, concat('r', cast(conv_id % 5 AS string)) AS run_id, role AS agent, 'local' AS provider, concat(text, CASE turn % 3 WHEN 0 THEN text ELSE '' END) AS prompt, 'ok' AS response,
    (conv_id * 7 + turn) / 16.0 AS duration_ms FROM conversations"""


@query(
    f"""WITH c AS ({_CALLS.replace('string', 'varchar')})
    SELECT event_id, run_id, agent, length(prompt)::INT AS prompt_chars, round(duration_ms, 2)::DOUBLE AS duration_ms,
    sha256(CASE WHEN length(prompt) <= 532 THEN prompt ELSE left(prompt, 250) || chr(10) || '...[' || (length(prompt) - 500) || ' chars elided]...' || chr(10) || right(prompt, 250) END) AS prompt FROM c"""
)
def traces_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls appended as JSON lines by run, a damaged line among them, and read back."""
    folder = shared_folder(spark)
    calls = bound(spark, sf_dir, _CALLS, "conversations").withColumn("duration_ms", F.col("duration_ms").cast("double"))
    S.write_traces(calls, folder)
    calls.limit(1).select(F.lit('{"agent": "cut').alias("value")).write.text(f"{folder}/run_id=r0/damaged")
    read = S.read_traces(spark, f"{folder}/run_id=*")
    run = F.regexp_extract(F.input_file_name(), "run_id=([^/]+)", 1)
    return read.select("event_id", run.alias("run_id"), "agent", "prompt_chars", "duration_ms", F.sha2("prompt", 256).alias("prompt"))


_SNAPSHOTS = """SELECT o_orderkey AS run_id, concat('Write to user@mail.example.org about ', o_orderpriority) AS note, CASE o_orderkey % 3 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('c') ELSE array() END AS matched, o_orderstatus AS status FROM orders"""


@query("SELECT o_orderkey AS run_id, 'Write to [EMAIL] about ' || o_orderpriority AS note, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS matched, o_orderstatus AS status FROM orders")
def run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bound(spark, sf_dir, _SNAPSHOTS, "orders").withColumn("matched", F.col("matched").cast("array<string>"))
    made = S.run_snapshots(runs, F.lit(None).cast("string"), F.lit(None).cast("string"), ("note",))
    return made.select("run_id", F.from_json("snapshot", "note string, matched int, status string").alias("s")).select("run_id", "s.*")


@query(
    f"""WITH t AS ({TRACES}), n AS (SELECT 'by_agent' AS name, count(DISTINCT agent) AS n_rows FROM t UNION ALL SELECT 'per_job', count(DISTINCT coalesce(job_id, '')) FROM t UNION ALL SELECT 'run', 1 UNION ALL SELECT 'truncations', count(*) FROM t WHERE truncated) SELECT * FROM n"""
)
def telemetry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows four of the report's tables have."""
    report = S.telemetry_report(traces(spark, sf_dir))
    counts = [report[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows")) for name in ("by_agent", "per_job", "run", "truncations")]
    return reduce(DataFrame.unionByName, counts)


@query("SELECT c_custkey, 'Customer#[PHONE] is [EMAIL]' AS first, 'mail [EMAIL]' AS second, c_acctbal::DOUBLE AS balance, true AS ok FROM customer")
def redact_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings inside a struct of an array of structs and a map; other values stay. The nine digits of a name look like a phone number."""
    mail = F.concat(F.lit("box"), F.lit("@mail.example.org"))
    nested = F.struct(F.array(F.struct(F.concat("c_name", F.lit(" is "), mail).alias("text"), F.col("c_acctbal").cast("double").alias("balance"))).alias("items"), F.create_map(F.lit("k"), F.concat(F.lit("mail "), mail)).alias("m"), F.lit(True).alias("ok"))
    out = redacted_struct(table(spark, sf_dir, "customer").select("c_custkey", nested.alias("s")), ["s"])
    item = F.get("s.items", F.lit(0))
    return out.select("c_custkey", item["text"].alias("first"), F.col("s.m")["k"].alias("second"), item["balance"].alias("balance"), F.col("s.ok").alias("ok"))
