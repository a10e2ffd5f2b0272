"""Continuous forms of the trace, quota, posting and history operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from matchflow.functions.text import normalize_url
from matchflow.operators import history as H
from matchflow.sources.traces import TRACE

#: Parts of a history table; a batch rewrites those of its users.
PARTS = 64


def stream_traces(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New trace files as they land; malformed lines are dropped."""
    raw = spark.readStream.schema(f"{TRACE}, _corrupt_record string").option("maxFilesPerTrigger", files).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter("_corrupt_record is null").drop("_corrupt_record")


def stream_tpm(traces: DataFrame, seconds: int = 60, late: str = "2 minutes", most_gemini: int = 5, most_calls: int = 30) -> DataFrame:
    """Calls and tokens by tumbling window with its flag. Windows are anchored at the epoch: a stream has no first trace to anchor them at."""
    t = traces.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"))
    w = t.agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("tokens"), F.count_if(F.col("provider").startswith("gemini")).alias("gemini_calls"))
    flag = F.when(F.col("gemini_calls") > most_gemini, "rpm_breach").when(F.col("calls") > most_calls, "high_burst")
    return w.select(F.col("window.start").alias("window_start"), "calls", "tokens", "gemini_calls", flag.alias("flag"))


class Folded(StatefulProcessor):
    """Rows of each key through a fold with one long of state, forgotten when the watermark is `hours` past the key's last row.

    Rows come in batches of bounded size, each in the order of its times; the fold's value is a typed value state, and an
    event-time timer for each key, moved on by every batch, ends it.
    """

    def __init__(self, fold: Callable, columns: list[str], hours: int):
        self.fold, self.columns, self.hours = fold, columns, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "value long")
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        value = self.value.get()[0] if self.value.exists() else None
        last = before = self.last.get()[0] if self.last.exists() else 0
        for pdf in rows:
            if len(pdf):
                value, out = self.fold(key, pdf.sort_values(["ts", *self.columns[:1]]), value)
                last = max(last, int(pdf.ts.max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
                yield out
        self.value.update((value,))
        self.last.update((last,))
        if last != before:
            if before:
                self.handle.deleteTimer(before + self.hours * 3_600_000)
            self.handle.registerTimer(last + self.hours * 3_600_000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows held in list state until the watermark has passed them, then given in the order of their times."""

    def __init__(self, columns: list[str], kinds: str):
        self.columns, self.kinds = columns, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.kinds)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.held.appendList([tuple(r) for r in pdf[self.columns].astype(object).where(pdf[self.columns].notna(), None).itertuples(index=False)])
                self.handle.registerTimer(int(pdf.ts.max().timestamp() * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.held.get()], columns=self.columns)
        held["ts"] = pd.to_datetime(held.ts)
        done = held.ts.map(lambda t: t.timestamp() * 1000) < timerValues.getCurrentWatermarkInMs()
        if done.all():
            self.held.clear()
        else:
            self.held.put([tuple(r) for r in held[~done].itertuples(index=False)])
        yield held[done].sort_values(["ts", *[c for c in self.columns if c != "ts"][:1]])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, output: str) -> DataFrame:
    """df, which has a watermark, through a processor with state in RocksDB, so that it need not fit into memory."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "eventtime")


def _per_key(df: DataFrame, keys: list[str], columns: list[str], fold: Callable, output: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Rows of each key through a fold. Rows later than the watermark are dropped; those within it count when they come."""
    return stateful(df.withWatermark("ts", late), keys, Folded(fold, columns, hours), output)


def stream_in_order(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The rows of each key in the order of their times, however they come: a row is given once the watermark has passed it.

    Rows later than the watermark are dropped; the last rows stay held until later ones move the watermark on.
    """
    kinds = _ddl(df)
    return stateful(df.withWatermark("ts", late), keys, InOrder(df.columns, kinds), kinds)


def stream_budget(traces: DataFrame, limit: int) -> DataFrame:
    """Each call charged to its run: used so far, and ok, rejected (the first over the limit) or not_run."""

    def fold(key: tuple, rows: pd.DataFrame, used: int | None) -> tuple[int, pd.DataFrame]:
        used = used or 0
        counts = range(used + 1, used + len(rows) + 1)
        states = ["ok" if n <= limit else "rejected" if n == limit + 1 else "not_run" for n in counts]
        return used + len(rows), pd.DataFrame({"run_id": key[0], "event_id": rows.event_id.to_numpy(), "used": list(counts), "state": states})

    return _per_key(traces.select("run_id", "event_id", "ts"), ["run_id"], ["event_id"], fold, "run_id string, event_id long, used long, state string")


def stream_run_cap(events: DataFrame, cap: int = 3) -> DataFrame:
    """The nth run of each user and day, and whether the cap blocks it."""

    def fold(key: tuple, rows: pd.DataFrame, seen: int | None) -> tuple[int, pd.DataFrame]:
        seen = seen or 0
        nth = list(range(seen + 1, seen + len(rows) + 1))
        return seen + len(rows), pd.DataFrame({"distinct_id": key[0], "day": str(key[1]), "event_id": rows.event_id.to_numpy(), "nth": nth, "blocked": [bool(cap) and n > cap for n in nth]})

    days = events.select("distinct_id", F.to_date("ts").alias("day"), "event_id", "ts")
    return _per_key(days, ["distinct_id", "day"], ["event_id"], fold, "distinct_id string, day string, event_id long, nth long, blocked boolean", 48)


def stream_quota_reset(snapshots: DataFrame, per_key: int) -> DataFrame:
    """Snapshots that rose by more than half of a key's allowance since the key's last one."""

    def fold(key: tuple, rows: pd.DataFrame, last: int | None) -> tuple[int, pd.DataFrame]:
        before = rows.remaining.shift(1).astype("float")
        if last is not None:
            before.iloc[0] = last
        risen = rows.remaining > before + per_key / 2
        out = pd.DataFrame({"key_idx": key[0], "event_id": rows.event_id[risen].to_numpy(), "before": before[risen].astype("int64").to_numpy(), "remaining": rows.remaining[risen].to_numpy()})
        return int(rows.remaining.iloc[-1]), out

    return _per_key(snapshots.select("key_idx", "event_id", "ts", "remaining"), ["key_idx"], ["event_id"], fold, "key_idx long, event_id long, before long, remaining long", 72)


def stream_dedupe_postings(postings: DataFrame, late: str = "1 day") -> DataFrame:
    """The first posting of each normalised url within the watermark; postings without one all pass."""
    keyed = postings.withColumn("url_norm", normalize_url("url")).withColumn("url_norm", F.when(F.col("url_norm") == "", F.concat(F.lit("row:"), F.col("seq"))).otherwise(F.col("url_norm")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url_norm"])


def history_table(spark: SparkSession, folder: str, empty: DataFrame, before: int | None = None) -> DataFrame:
    """The history that history_writer has written (by the batches before `before`): of each part its latest version, with `part`."""
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(files):
        return empty.withColumn("part", F.lit(0))
    every = spark.read.option("basePath", folder).schema(f"{_ddl(empty)}, version int, part int").parquet(folder)
    if before is not None:
        every = every.filter(F.col("version") < before)
    # PARTS numbers at most, and the filter made of them prunes folders
    latest = every.groupBy("part").agg(F.max("version").alias("version")).collect()
    wanted = reduce(or_, ((F.col("part") == r.part) & (F.col("version") == r.version) for r in latest), F.lit(False))
    return every.filter(wanted).drop("version")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def history_writer(spark: SparkSession, folder: str, empty: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] = H.mark_shown) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges shown postings, or with merge=mark_applied marks, into a versioned table.

    Users are dealt into PARTS by hash, and a batch writes only the parts of its users, as a version named by
    the batch. A batch that is run again reads what the batches before it left and overwrites its own version.
    compact_history removes versions that two later ones of their part follow.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part = F.pmod(F.xxhash64("user_key"), F.lit(PARTS)).cast("int")
        touched = [r.part for r in batch.filter("user_key is not null").select(part.alias("part")).distinct().collect()]
        old = history_table(spark, folder, empty, batch_id).filter(F.col("part").isin(touched)).drop("part")
        new = merge(old, batch).select(*empty.columns, part.alias("part"))
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/version={batch_id}")

    return write


def versions_of_parts(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """The versions that each part has on disk, ascending; read from the folders' names."""
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found: dict[int, list[int]] = {}
    for f in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/part=*")) or ():
        path = f.getPath()
        found.setdefault(int(path.getName().split("=")[1]), []).append(int(path.getParent().getName().split("=")[1]))
    return {part: sorted(v) for part, v in found.items()}


def compact_history(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Remove versions of a part that `keep` later ones follow, and say how many: a batch that is run again still finds what it read.

    Readers of the latest version and the writer can go on meanwhile.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = [(version, part) for part, versions in versions_of_parts(spark, folder).items() for version in versions[:-keep]]
    for version, part in gone:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={version}/part={part}"), True)
    return len(gone)


def save_bucketed(df: DataFrame, name: str, keys: tuple[str, ...] = ("user_key", "url_norm"), buckets: int = PARTS) -> DataFrame:
    """df as a table bucketed and sorted by its keys, so that later joins and aggregates by these read it without a shuffle."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
