"""Reports over call traces: one row per model call, with agent, job, provider, tokens and time.

Counts by label come as text, `label:count` joined by commas, most frequent first and then by label.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def micros(ts: Column | str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def label_counts(df: DataFrame, keys: list[str], label: str, name: str, top: int | None = None) -> DataFrame:
    """keys and the label counts of each group: two partial aggregations, so no group's rows are gathered, only its labels."""
    counted = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    entries = F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("l"))))
    if top:
        entries = F.slice(entries, 1, top)
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["l"], F.lit(":"), (-e["n"]).cast("string"))), ",")
    return counted.groupBy(*keys).agg(text.alias(name))


def by_agent(traces: DataFrame) -> DataFrame:
    """Calls, tokens, characters, time, errors and truncations of each agent, with provider and model counts."""
    t = traces.withColumn("agent", F.coalesce("agent", F.lit("unknown"))).withColumn("provider", F.coalesce("provider", F.lit("unknown"))).withColumn("model", F.coalesce("model", F.lit("unknown")))
    totals = t.groupBy("agent").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce("prompt_chars", F.lit(0))).cast("long").alias("prompt_chars"),
        F.sum(F.coalesce("response_chars", F.lit(0))).cast("long").alias("response_chars"),
        F.round(F.sum(F.coalesce("duration_ms", F.lit(0.0))), 2).alias("duration_ms"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("truncated")).alias("truncations"),
    )
    ratio = F.when(F.col("prompt_chars") > 0, F.round(F.col("response_chars") / F.col("prompt_chars"), 4)).otherwise(0.0)
    rates = totals.withColumns({"avg_tokens": F.round(F.col("tokens") / F.col("calls"), 4), "response_ratio": ratio, "avg_latency_ms": F.round(F.col("duration_ms") / F.col("calls"), 4)})
    return rates.join(label_counts(t, ["agent"], "provider", "providers"), "agent").join(label_counts(t, ["agent"], "model", "models"), "agent")


def order_agents(report: DataFrame) -> DataFrame:
    """Agents by tokens, largest first, with their rank."""
    return report.withColumn("place", F.row_number().over(Window.orderBy(F.desc("tokens"), "agent")))


def tpm_windows(traces: DataFrame, window_s: int = 60) -> DataFrame:
    """Tumbling windows anchored at each run's first trace; windows without calls are absent."""
    t = traces.withColumn("us", micros())
    first = t.groupBy("run_id").agg(F.min("us").alias("t0"))
    placed = t.join(first, "run_id").withColumn("idx", F.floor(F.floor((F.col("us") - F.col("t0")) / US) / window_s))
    start = F.floor(F.col("t0") / US) + F.col("idx") * window_s
    keys = ["run_id", "idx"]
    totals = placed.groupBy(*keys).agg(
        F.timestamp_seconds(F.first(start)).cast("timestamp_ntz").alias("window_start"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("total_tokens").alias("tokens"),
        F.count_if(F.col("provider").startswith("gemini")).alias("gemini_calls"),
        F.count_if(F.col("provider").startswith("groq")).alias("groq_calls"),
    )
    return totals.join(label_counts(placed, keys, "agent", "agents"), keys)


def window_flags(windows: DataFrame, most_gemini: int = 5, most_calls: int = 30) -> DataFrame:
    return windows.withColumn("flag", F.when(F.col("gemini_calls") > most_gemini, "rpm_breach").when(F.col("calls") > most_calls, "high_burst"))


def per_job(traces: DataFrame) -> DataFrame:
    """Totals of each job, by the time of its first call."""
    t = traces.withColumn("job_id", F.coalesce("job_id", F.lit("(none)")))
    totals = t.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("total_tokens").alias("tokens"),
        F.round(F.sum("duration_ms"), 2).alias("duration_ms"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("truncated")).alias("truncations"),
    )
    return totals.join(label_counts(t, ["job_id"], "agent", "agents"), "job_id")


def running_place(df: DataFrame, name: str, keys: list[str], ts: str, tie: str, seconds: int = 3600) -> DataFrame:
    """df with the place of each row among those of its keys, by ts, then tie.

    Rows are placed within slices of time; the numbers of rows before each slice are added to that, so a
    key's rows spread over tasks and only its slices' counts meet in one.
    """
    sliced = df.withColumn("__slice", F.floor(micros(ts) / (seconds * US)))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(ts, tie)))
    mine = [*keys, "__slice"]
    offsets = counts.withColumn("__before", before).select("__before", *(F.col(k).alias(f"__k{i}") for i, k in enumerate(mine)))
    joined = placed.join(offsets, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(mine))))
    return joined.select(*df.columns, (F.col("__at") + F.col("__before")).cast("int").alias(name))


def order_jobs(jobs: DataFrame) -> DataFrame:
    return running_place(jobs, "place", [], "first_ts", "job_id")


def run_totals(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("truncated")).alias("truncations"),
        F.sum("total_tokens").alias("tokens"),
        F.round(F.sum("duration_ms"), 2).alias("duration_ms"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def job_drift(traces: DataFrame, factor: float = 1.30) -> DataFrame:
    """Mean tokens of the first and second half of each run's jobs, and whether the later half grew."""
    jobs = traces.groupBy("run_id", "job_id").agg(F.min("ts").alias("first_ts"), F.sum("total_tokens").alias("tokens"))
    w = Window.partitionBy("run_id")
    placed = jobs.withColumn("at", F.row_number().over(w.orderBy("first_ts", "job_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    early = F.col("at") <= F.floor(F.col("n") / 2)
    halves = placed.groupBy("run_id").agg(F.max("n").alias("jobs"), F.round(F.avg(F.when(early, F.col("tokens"))), 4).alias("earlier"), F.round(F.avg(F.when(~early, F.col("tokens"))), 4).alias("later"))
    return halves.withColumn("drifts", (F.col("jobs") >= 3) & F.coalesce(F.col("later") > factor * F.col("earlier"), F.lit(False)))


def suspicions(traces: DataFrame) -> DataFrame:
    """One row per rule of a run's report: what it measured and whether it fired."""
    breaches = window_flags(tpm_windows(traces)).agg(F.count_if(F.col("flag") == "rpm_breach").cast("double").alias("measure"))
    cut = traces.agg(F.round(F.count_if(F.col("truncated")) / F.count(F.lit(1)), 6).alias("measure"))
    ratio = by_agent(traces).agg(F.max("response_ratio").alias("measure"))
    drift = job_drift(traces).agg(F.count_if("drifts").cast("double").alias("measure"))
    rules = (("rpm_breach", breaches, 0.0), ("truncation_share", cut, 0.1), ("response_ratio", ratio, 1.5), ("token_drift", drift, 0.0))
    parts = [df.select(F.lit(name).alias("rule"), "measure", (F.col("measure") > limit).alias("fired")) for name, df, limit in rules]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def truncation_incidents(traces: DataFrame) -> DataFrame:
    return traces.filter("truncated").select("event_id", "agent", "job_id", "ts", "response_chars", "max_tokens_requested")


def top_agents(traces: DataFrame, key: str = "job_id", n: int = 3) -> DataFrame:
    """The n most frequent agents of each group."""
    return label_counts(traces, [key], "agent", "top_agents", n)


def bursts(traces: DataFrame, seconds: float = 5.0, top: int = 10) -> DataFrame:
    """The calls with most other calls of their run within `seconds` either way, inclusive.

    A run is cut into slices of time; calls near a border are also counted in the next slice, so a
    long run spreads over tasks.
    """
    reach, slice_us = int(seconds * US), 3600 * US
    t = traces.select("event_id", "run_id", "agent", "provider", "ts", micros().alias("us"))
    at = F.floor(F.col("us") / slice_us)
    homes = F.array_distinct(F.array(at, F.floor((F.col("us") - reach) / slice_us), F.floor((F.col("us") + reach) / slice_us)))
    seen = t.withColumn("home", at).withColumn("slice", F.explode(homes))
    near = Window.partitionBy("run_id", "slice").orderBy("us").rangeBetween(-reach, reach)
    counted = seen.withColumn("concurrent", F.count(F.lit(1)).over(near)).filter("slice = home and concurrent > 1")
    # the labels are gathered for the winners alone
    best = counted.orderBy(F.desc("concurrent"), "us", "event_id").limit(top).select("event_id", "run_id", "ts", "us", "concurrent")
    others = t.select(F.col("run_id").alias("run"), F.col("us").alias("other"), F.concat("agent", F.lit("("), "provider", F.lit(")")).alias("label"))
    joined = F.broadcast(best).join(others, (F.col("run") == F.col("run_id")) & F.col("other").between(F.col("us") - reach, F.col("us") + reach))
    labels = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("other", "label"))), lambda e: e["label"]), ",")
    return joined.groupBy("event_id", "run_id", "ts", "concurrent").agg(labels.alias("members"))


def budget_ledger(traces: DataFrame, limit: int) -> DataFrame:
    """Each call is charged to its run, then rejected if the total is over the limit; calls after the first rejected one are not run."""
    calls = traces.select("event_id", "run_id", "agent", "ts")
    used = running_place(running_place(calls, "used", ["run_id"], "ts", "event_id"), "agent_used", ["run_id", "agent"], "ts", "event_id")
    state = F.when(F.col("used") <= limit, "ok").when(F.col("used") == limit + 1, "rejected").otherwise("not_run")
    return used.select("event_id", "run_id", "agent", "used", "agent_used", state.alias("state"))


def quota_resets(snapshots: DataFrame, per_key: int) -> DataFrame:
    """Snapshots whose remaining tokens rose by more than half of a key's allowance: a daily reset."""
    sliced = snapshots.withColumn("__slice", F.floor(micros() / (3600 * US)))
    # the first snapshot of an hour follows the last one of the hours before
    last = sliced.groupBy("key_idx", "__slice").agg(F.max_by("remaining", F.struct("ts", "event_id")).alias("__last"))
    carried = last.select("key_idx", "__slice", F.lag("__last").over(Window.partitionBy("key_idx").orderBy("__slice")).alias("__carried"))
    before = F.lag("remaining").over(Window.partitionBy("key_idx", "__slice").orderBy("ts", "event_id"))
    joined = sliced.withColumn("__within", before).join(carried, ["key_idx", "__slice"])
    return joined.withColumn("before", F.coalesce("__within", "__carried")).filter(F.col("remaining") > F.col("before") + per_key / 2).select("event_id", "key_idx", "ts", "before", "remaining")


def latest_quota(snapshots: DataFrame) -> DataFrame:
    """The most recent snapshot of each key."""
    last = F.max_by(F.struct("ts", "remaining", "event_id"), F.struct("ts", "event_id"))
    return snapshots.groupBy("key_idx").agg(last.alias("s")).select("key_idx", "s.*")


def quota_summary(snapshots: DataFrame, keys: int, per_key: int, tokens_per_run: int = 22_000) -> DataFrame:
    """Pool, used and remaining tokens; reported remainders lower the estimate only once every key has reported."""
    used = snapshots.agg(F.sum("used").alias("used"))
    said = latest_quota(snapshots).agg(F.count(F.lit(1)).alias("reporting"), F.sum("remaining").alias("reported"))
    pool = F.lit(keys * per_key).cast("long")
    left = F.greatest(F.lit(0).cast("long"), pool - F.col("used"))
    left = F.when(F.col("reporting") == keys, F.least(left, F.col("reported"))).otherwise(left)
    out = used.crossJoin(said).select(pool.alias("pool"), "used", "reporting", left.alias("remaining"))
    return out.withColumn("runs_left", F.expr(f"remaining div {tokens_per_run}")).withColumn("percent", F.when(F.col("pool") > 0, F.expr("(remaining * 100) div pool")).otherwise(F.lit(0).cast("long")))


def latest_run(traces: DataFrame) -> DataFrame:
    """The traces of the last run id in alphabetical order; one scalar aggregate prunes the rest."""
    last = traces.agg(F.max("run_id").alias("run_id"))
    return traces.join(F.broadcast(last), "run_id")
