"""Streams of turn events: run marks, tallies, content addresses and sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import text as T
from millrace.functions import vocab as V
from millrace.operators.merge import names_differ


class RunMarks(StatefulProcessor):
    """Marks of a run are buffered until it ends; then one row for each marked fact goes out with the outcome.

    Input rows are (run_id, kind, fact_id, outcome, ts), kind ``served``,
    ``planted`` or ``end``. A run without an end is dropped after ``timeout_ms``.
    """

    def __init__(self, timeout_ms: int = 3_600_000):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getListState("marks", "kind string, fact_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = None
        for batch in rows:
            for kind, fact, outcome in batch[["kind", "fact_id", "outcome"]].itertuples(index=False):
                if kind == "end":
                    ended = outcome
                else:
                    self.marks.appendValue((kind, int(fact)))
        if ended is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            return
        seen = sorted(set(self.marks.get())) if self.marks.exists() else []
        self.marks.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if seen and ended != "stopped":
            yield pd.DataFrame({"run_id": key[0], "kind": [k for k, _ in seen], "fact_id": [f for _, f in seen], "outcome": ended})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.marks.clear()
        return iter(())

    def close(self) -> None:
        pass


def graded_marks(events: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """(run_id, kind, fact_id, outcome) of finished runs, from a stream of marks and ends. Needs the RocksDB state store."""
    return events.groupBy("run_id").transformWithStateInPandas(
        RunMarks(timeout_ms), "run_id string, kind string, fact_id long, outcome string", "Append", "ProcessingTime"
    )


def running_tallies(marks: DataFrame) -> DataFrame:
    """(id, uses, wins) over a stream of graded marks, in update mode."""
    served = marks.where("kind = 'served'")
    return served.groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.col("outcome") == "ok").alias("wins"))


def windowed_activity(events: DataFrame, delay: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Events (ts, event_type) per window and type, with a watermark for late ones."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "event_type", "n")
    )


def distinct_bodies(bodies: DataFrame, delay: str = "3 days") -> DataFrame:
    """The first sighting of each body (tool, body, ts) within the watermark, with its fingerprint."""
    marked = bodies.withColumn("fingerprint", F.sha1(F.concat("tool", F.lit("\u001f"), "body")))
    return marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def recent_elaborations(facts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(id_new, id_old) over a stream of facts (id, fact, created_at): a fact that says in full one of the hour before.

    A stream-stream join with a time range: the watermark and the hour bound what
    is kept. The older fact goes in under one of its tokens, so a pair comes once.
    """
    rows = facts.withWatermark("created_at", delay).withColumn("words", T.tokens(F.col("fact")))
    old = rows.where((T.cue_gap(F.col("fact")) != "") & (F.size("words") > 0)).select(
        F.col("id").alias("id_old"), F.col("fact").alias("old_fact"), F.col("created_at").alias("old_at"), F.col("words").alias("old_words"), F.array_min("words").alias("old_token")
    )
    new = rows.select(F.col("id").alias("id_new"), F.col("fact").alias("new_fact"), F.col("created_at").alias("new_at"), F.col("words").alias("new_words"), F.explode("words").alias("new_token"))
    within = F.expr(f"new_token = old_token AND old_at >= new_at - INTERVAL {V.ELABORATE_SECONDS} SECONDS AND old_at <= new_at AND id_new > id_old")
    pairs = new.join(old, within)
    fuller = (F.size("old_words") < F.size("new_words")) & (F.size(F.array_except("old_words", "new_words")) == 0)
    return pairs.where(fuller & ~names_differ(F.col("new_fact"), F.col("old_fact"))).select("id_new", "id_old")


def consolidate_every(store, new_episodes: int, run=None, name: str = "sweep"):
    """A foreachBatch function that stores episodes and sweeps once so many are newer than the last sweep.

    A sweep (``tasks.consolidate``) is named after the batch that is due and its
    commit row holds its mark, so a batch that is replayed, or killed anywhere in
    between, gives one sweep. An episode is stored once whatever its id comes with.
    With ``run`` that is called with the store in the sweep's place, before its mark.
    After a sweep the store's small files are packed.
    """
    from millrace.operators import tasks

    def batch(df: DataFrame, batch_id: int) -> None:
        known = store.table("episodes").select("id")
        store.append("episodes", df.dropDuplicates(["id"]).join(known, "id", "left_anti"))
        mark = store.table("sweeps").agg(F.max("mark")).first()[0]
        since = store.table("episodes") if mark is None else store.table("episodes").where(F.col("id") > mark)
        n, newest = since.agg(F.count(F.lit(1)), F.max("id")).first()
        if n < new_episodes:
            return
        if run is None:
            tasks.consolidate(store, f"{name}-{newest}")
        else:
            run(store)
            store.append("sweeps", df.sparkSession.createDataFrame([(newest,)], "mark long"))
        store.tidy()

    return batch
