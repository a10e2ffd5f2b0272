"""Runs, reviews, budgets, and the KPI, funnel and retention reports over product events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_stats(runs: DataFrame, key: str, threshold: int) -> DataFrame:
    """Best score, upper median and number at or over the threshold; the median is found from value counts, so a large group gathers its distinct scores only."""
    scores = runs.withColumn("score", F.coalesce("score", F.lit(0)))
    counted = scores.groupBy(key, "score").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    placed = counted.withColumn("upto", F.sum("n").over(w.orderBy("score"))).withColumn("total", F.sum("n").over(w))
    middle = (F.col("upto") > F.floor(F.col("total") / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("total") / 2))
    return placed.groupBy(key).agg(
        F.max("score").alias("best"),
        F.max(F.when(middle, F.col("score"))).alias("median"),
        F.sum(F.when(F.col("score") >= threshold, F.col("n")).otherwise(0)).alias("at_threshold"),
    )


def review_stats(reviews: DataFrame, key: str) -> DataFrame:
    return reviews.groupBy(key).agg(
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.count("score").alias("n"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("retries"),
    )


def split_by_threshold(scored: DataFrame, threshold: int) -> DataFrame:
    """matched at or over the threshold, else skipped; a missing score is 0."""
    score = F.coalesce("score", F.lit(0))
    return scored.withColumn("score", score).withColumn("bucket", F.when(F.col("score") >= threshold, "matched").otherwise("skipped"))


def score_tier(score: Column | str) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 80, "green").when(score >= 60, "amber").otherwise("red")


def classify_status(status: Column | str, hard: list[str], terminal: list[str]) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status.isin(*hard), "hard_terminal").when(status.isin(*terminal), "terminal").otherwise("running")


def rank_matches(split: DataFrame, key: str, order: str) -> DataFrame:
    """Each run's matched and skipped lists by score."""
    w = Window.partitionBy(key, "bucket").orderBy(F.desc("score"), order)
    return split.withColumn("place", F.row_number().over(w))


def best_attempt(reviews: DataFrame, key: str, order: str) -> DataFrame:
    """The highest score of each key, the earliest of equal ones; an aggregate, so no group is sorted whole."""
    best = F.max_by(F.struct(order, "score"), F.struct("score", (-F.col(order)).alias("o")))
    return reviews.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def round_gate(rounds: DataFrame, key: str, order: str, matches: str, least: int, most_rounds: int) -> DataFrame:
    """Rounds that are allowed to run: while the matches so far are too few and the cap is not reached."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(matches).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rounds.withColumn("round", F.row_number().over(w)).withColumn("matches_before", before).withColumn("runs", (F.col("matches_before") < least) & (F.col("round") <= most_rounds))


def accept_gate(attempts: DataFrame, threshold: int = 72, most_retries: int = 2, accept: int = 65) -> DataFrame:
    """Accept, retry or discard each attempt.

    Columns: n_rewrites, n_bullets, feedback, weaknesses (text), score, verdict, attempt, strong_source,
    all_reverted, body_reverted.
    """
    feedback, weak = F.lower(F.coalesce("feedback", F.lit(""))), F.lower(F.coalesce("weaknesses", F.lit("")))
    few = (F.col("n_rewrites") < F.greatest(F.lit(2), F.floor(F.col("n_bullets") / 5))) & (F.col("n_bullets") >= 5) & (F.col("attempt") < most_retries)
    fabricated = feedback.contains("fabricat") | weak.contains("fabricat") | feedback.contains("invent")
    hard = few | fabricated | F.col("all_reverted") | F.col("body_reverted")
    effective = F.when(F.col("strong_source"), 65).when(~hard, max(threshold - 7, 60)).otherwise(threshold)
    accepted = ~few & ~fabricated & ((F.col("verdict") == "accept") | (F.col("score") >= effective))
    bad = (F.col("score") < max(50, accept - 15)) & (F.col("all_reverted") | F.col("body_reverted"))
    decision = F.when(accepted, "accept").when(F.col("attempt") < most_retries, "retry").when(bad, "discard").otherwise("keep_best")
    return attempts.withColumn("effective_threshold", effective).withColumn("decision", decision)


def daily_run_cap(events: DataFrame, cap: int = 3) -> DataFrame:
    """The nth run of each user and day; blocked from the cap on (0: never)."""
    w = Window.partitionBy("distinct_id", "day").orderBy("ts", "event_id")
    out = events.withColumn("day", F.to_date("ts")).withColumn("nth", F.row_number().over(w))
    return out.withColumn("blocked", (F.col("nth") > cap) if cap else F.lit(False))


def match_digest(matches: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One text per user: a line for each match in list order, and their number."""
    entries = F.sort_array(F.collect_list(F.struct(order, line.alias("line"))))
    return matches.groupBy(key).agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("digest"), F.count(F.lit(1)).alias("matches"))


def unsent(matches: DataFrame, sent: DataFrame, has_document: Column) -> DataFrame:
    """Matches with a document that were not delivered yet; the key is the url, else the title."""
    name = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("title"))
    done = sent.select(name.alias("__key")).filter("__key is not null").distinct()
    return matches.filter(has_document).withColumn("__key", name).join(done, "__key", "left_anti").drop("__key")


def decision_mix(runs: DataFrame, trace: str, key: str) -> DataFrame:
    """Routing decisions of each run by mode."""
    return runs.select(key, F.explode(trace).alias("step")).groupBy(key, F.col("step.mode").alias("mode")).agg(F.count(F.lit(1)).alias("decisions"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.round(top / F.nullif(bottom, F.lit(0)), 6)


def kpi_core(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The product ratios in one pass, overall and by each column of `by` (grouping sets).

    Columns: completed, matched, scraped, filtered_early, retried, llm_calls, previewed, sent, attempted,
    clicks, applied, in_place, seconds.
    """
    n = lambda c: F.sum(F.col(c).cast("long"))
    measures = [
        F.count(F.lit(1)).alias("runs"),
        ratio(n("completed"), F.count(F.lit(1))).alias("completion_rate"),
        ratio(n("matched"), n("scraped")).alias("match_yield"),
        ratio(n("retried"), n("matched")).alias("retry_rate"),
        ratio(n("filtered_early"), n("scraped")).alias("early_exit_rate"),
        ratio(n("sent"), n("attempted")).alias("send_success"),
        ratio(F.count_if((F.col("previewed") > 0) & (F.col("sent") > 0)), F.count_if(F.col("previewed") > 0)).alias("preview_to_send"),
        ratio(n("applied"), n("matched")).alias("applied_rate"),
        ratio(n("in_place"), n("completed")).alias("output_fidelity"),
        ratio(n("matched") + n("filtered_early"), n("llm_calls")).alias("agentic_efficiency"),
        ratio(n("sent"), n("clicks")).alias("automation_value"),
        F.round(F.percentile("llm_calls", 0.5), 4).alias("llm_calls_median"),
        F.round(F.percentile("llm_calls", 0.9), 4).alias("llm_calls_p90"),
        F.round(F.percentile("seconds", 0.5), 4).alias("seconds_median"),
    ]
    if not by:
        return runs.agg(*measures)
    sets = [[F.col(c)] for c in by] + [[]]
    level = F.expr("grouping_id()")
    return runs.groupingSets(sets, *by).agg(*measures, level.cast("int").alias("level"))


def weekly_active(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.countDistinct("distinct_id").alias("users"))


#: Length of the slices of a user's time that are summed up on their own, so that no user's events come together.
SLICE_SECONDS = 3600


def funnel(events: DataFrame, steps: list[str], days: int = 7) -> DataFrame:
    """Users that reach each step in order within the window from their first step; equal times count as in order.

    Only the steps' events are read, once. A slice of a user's time becomes what it does to a user who enters it at each
    level: when the following levels are reached. The slices of a user, at most one an hour, are then
    composed in order; where the window ends decides how many of a slice's levels count. So a user of very many events is split
    by slices, and the second shuffle carries slices, not events.
    """
    if len({*steps}) < len(steps):
        raise ValueError("the steps of a funnel differ")
    step = F.array_position(F.array(*map(F.lit, steps)), F.col("event")).cast("int") - 1
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    told = events.filter(F.col("event").isin(*steps)).select("distinct_id", at.alias("at"), step.alias("step"))
    slices = told.groupBy("distinct_id", F.floor(F.col("at") / (SLICE_SECONDS * 1_000_000)).alias("slice")).agg(F.sort_array(F.collect_set(F.struct("at", "step"))).alias("seen"))
    none = F.array().cast("array<bigint>")
    # entering at a level: the times of the next levels, as the slice's events reach them
    reached = lambda level: F.aggregate("seen", none, lambda times, e: F.when(e["step"] == F.size(times) + level, F.concat(times, F.array(e["at"]))).otherwise(times))
    effects = slices.select("distinct_id", "slice", F.array(*map(reached, range(len(steps)))).alias("effects"))
    state = F.struct(F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("start"))

    def enter(now: Column, part: Column) -> Column:
        times = F.coalesce(F.get(part["effects"], now["level"]), none)
        start = F.coalesce(now["start"], F.get(times, F.lit(0)))
        in_time = F.size(F.filter(times, lambda t: t <= start + days * 86_400_000_000))
        return F.struct((now["level"] + in_time).alias("level"), start.alias("start"))

    users = effects.groupBy("distinct_id").agg(F.sort_array(F.collect_list(F.struct("slice", "effects"))).alias("parts"))
    levels = users.select(F.aggregate("parts", state, enter)["level"].alias("level"))
    counts = levels.agg(*(F.count_if(F.col("level") > k).alias(f"__{k}") for k in range(len(steps))))
    rows = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("event"), F.col(f"__{k}").alias("users"), ratio(F.col(f"__{k}"), F.col("__0")).alias("conversion")) for k, s in enumerate(steps))))
    return counts.select(rows.alias("r")).select("r.*")


def retention(events: DataFrame, start: str, returns: str, periods: int = 8) -> DataFrame:
    """Share of each weekly cohort (first start event) with a return event in week k after it."""
    cohort = events.filter(F.col("event") == start).groupBy("distinct_id").agg(F.min("ts").alias("t0")).withColumn("cohort", F.to_date(F.date_trunc("week", "t0")))
    sizes = cohort.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    back = events.filter(F.col("event") == returns).join(cohort, "distinct_id").filter("ts > t0")
    week = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / (7 * 86400 * 1_000_000)).cast("int")
    active = back.withColumn("week", week).filter(F.col("week") < periods).groupBy("cohort", "week").agg(F.countDistinct("distinct_id").alias("users"))
    return active.join(F.broadcast(sizes), "cohort").select("cohort", "week", "users", "size", ratio(F.col("users"), F.col("size")).alias("share"))


def daily_percentile(events: DataFrame, event: str, value: str = "value") -> DataFrame:
    day = events.filter(F.col("event") == event).groupBy(F.to_date("ts").alias("day"))
    return day.agg(F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.9), 6).alias("p90"))


def totals_per_day(events: DataFrame, event: str) -> DataFrame:
    return events.filter(F.col("event") == event).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("total"))


def totals_by(events: DataFrame, prop: Column, name: str) -> DataFrame:
    return events.groupBy(prop.alias(name)).agg(F.count(F.lit(1)).alias("total"))


#: Sizes of the sketches: about 0.8 % and 0.6 % standard error.
USERS_LOG2, VALUES_K = 14, 400


def daily_sketches(events: DataFrame, value: str = "value") -> DataFrame:
    """A row for each day and event: how many there are, and mergeable sketches of their users and values.

    Each is a few KB whatever the day holds, so any period is answered from its days without reading events again.
    """
    days = events.groupBy(F.to_date("ts").alias("day"), "event")
    return days.agg(F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("distinct_id", USERS_LOG2).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double"), VALUES_K).alias("values"))


def merged_sketches(daily: DataFrame, period: str, *keys: str) -> DataFrame:
    """period (week, month, quarter or year: its first day), keys, events, users (estimated), p50 and p90 (estimated), of daily_sketches merged."""
    merged = daily.groupBy(F.to_date(F.date_trunc(period, "day")).alias(period), *keys).agg(F.sum("events").alias("events"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("values").alias("values"))
    quantile = lambda q: F.kll_sketch_get_quantile_double("values", F.lit(q))
    return merged.select(period, *keys, "events", F.hll_sketch_estimate("users").alias("users"), quantile(0.5).alias("p50"), quantile(0.9).alias("p90"))


def weekly_throughput(sent: DataFrame) -> DataFrame:
    """Applications sent per active user and week: distinct_id, ts and sent of each run; a user is active in a week with a run in it."""
    weeks = sent.groupBy("distinct_id", F.date_trunc("week", "ts").alias("week")).agg(F.sum(F.col("sent").cast("long")).alias("sent"))
    return weeks.agg(F.sum("sent").alias("sent"), F.count(F.lit(1)).alias("user_weeks"), ratio(F.sum("sent"), F.count(F.lit(1))).alias("throughput"))
