"""Reading and writing call traces, snapshots and reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions.text import payload_preview, redact_pii
from matchflow.operators import telemetry as T

TRACE = (
    "event_id long, ts timestamp, run_id string, job_id string, agent string, provider string, model string, prompt_chars int, response_chars int, prompt_tokens int, completion_tokens int, "
    "total_tokens long, duration_ms double, truncated boolean, error string, metadata map<string,string>, prompt string, response string"
)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed lines under path; the run comes from the folder name where lines lack it."""
    raw = spark.read.schema(f"{TRACE}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # the corrupt column alone may not be queried; with a data column it may
    return raw.filter("_corrupt_record is null and agent is not null").drop("_corrupt_record")


def write_traces(df: DataFrame, path: str, full_payloads: bool = False) -> None:
    """Appends traces by run, long payloads cut to their ends; sizes are those of the whole texts."""
    sized = df.withColumns({"prompt_chars": F.length("prompt"), "response_chars": F.length("response"), "duration_ms": F.round("duration_ms", 2)})
    cut = sized.withColumns({c: payload_preview(c, full_payloads) for c in ("prompt", "response")})
    cut.write.mode("append").partitionBy("run_id").json(path)


def run_snapshots(runs: DataFrame, name: Column, email: Column, text_columns: tuple[str, ...]) -> DataFrame:
    """One JSON document for each run: redacted inputs, counts of list columns, and the rest as it is."""
    counted = {f.name: F.size(f.name) for f in runs.schema if f.dataType.typeName() == "array"}
    redacted = {c: redact_pii(c, name, email) for c in text_columns}
    return runs.withColumns(counted | redacted).select("run_id", F.to_json(F.struct("*")).alias("snapshot"))


def telemetry_report(traces: DataFrame) -> dict[str, DataFrame]:
    """The report's tables by name."""
    windows = T.window_flags(T.tpm_windows(traces))
    return {
        "run": T.run_totals(traces),
        "by_agent": T.order_agents(T.by_agent(traces)),
        "tpm_windows": windows,
        "per_job": T.order_jobs(T.per_job(traces)),
        "truncations": T.truncation_incidents(traces),
        "bursts": T.bursts(traces),
        "drift": T.job_drift(traces),
        "suspicions": T.suspicions(traces),
    }
