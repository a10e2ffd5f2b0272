"""A user's application history: keyed by user and normalised url, with a tri-state applied flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_summary(history: DataFrame) -> DataFrame:
    applied = F.count_if(F.col("applied") == True)  # noqa: E712
    return history.groupBy("user_key").agg(F.count(F.lit(1)).alias("total"), applied.alias("applied"), (F.count(F.lit(1)) - applied).alias("pending"))


def recent_history(history: DataFrame) -> DataFrame:
    """Each user's records by last shown, never-shown ones last."""
    w = Window.partitionBy("user_key").orderBy(F.desc_nulls_last("shown_at"), "url_norm")
    return history.withColumn("place", F.row_number().over(w))


def mark_shown(history: DataFrame, shown: DataFrame) -> DataFrame:
    """history with the shown postings merged in.

    shown: user_key, url_norm, title, company, source, match_score, shown_at and seq (order within the
    batch). The last posting of a key refreshes its record, each adds to seen_count, first_seen_at is set
    once and applied is never touched. Postings without a url or user are skipped.
    """
    batch = (
        shown.filter("coalesce(url_norm, '') <> '' and user_key is not null")
        .groupBy("user_key", "url_norm")
        .agg(F.max_by(F.struct("title", "company", "source", "match_score", "shown_at"), "seq").alias("new"), F.count(F.lit(1)).alias("times"), F.min("shown_at").alias("first"))
    )
    merged = history.join(batch, ["user_key", "url_norm"], "full_outer")
    fresh = {c: F.coalesce(F.col("new")[c], F.col(c)) for c in ("title", "company", "source", "match_score", "shown_at")}
    return merged.select(
        "user_key",
        "url_norm",
        *(v.alias(c) for c, v in fresh.items()),
        F.coalesce("first_seen_at", "first").alias("first_seen_at"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("times", F.lit(0))).cast("long").alias("seen_count"),
        "applied",
        "applied_at",
    )


def mark_applied(history: DataFrame, marks: DataFrame) -> DataFrame:
    """history with applied set from marks (user_key, url_norm, applied, at); missing records are made, applied_at moves on true only."""
    last = marks.filter("coalesce(url_norm, '') <> '' and user_key is not null").groupBy("user_key", "url_norm").agg(
        F.max_by("applied", "at").alias("mark"), F.max(F.when(F.col("applied"), F.col("at"))).alias("marked_at")
    )
    merged = history.join(last, ["user_key", "url_norm"], "full_outer")
    return merged.withColumn("applied", F.coalesce("mark", "applied")).withColumn("applied_at", F.coalesce("marked_at", "applied_at")).drop("mark", "marked_at")


def erase_subject(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without the rows of the given subjects."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def expire(df: DataFrame, now: str, days: int = 7, ts: str = "ts") -> DataFrame:
    """df without rows older than the retention period."""
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
