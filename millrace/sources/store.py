"""The store: append-only Parquet tables under one folder.

A write appends events; the current state is an aggregate over them, so nothing
is updated in place and a lost executor costs a recomputation only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.functions import text as T
from millrace.functions import vocab as V
from millrace.functions.nearest import Asked
from millrace.sources.index import TokenIndex
from millrace.sources.packs import Packs
from millrace.sources.staging import staged

SCHEMAS = {
    "fact_events": (
        "event long, run_id string, op string, id long, fact string, category string, context string, cues string, "
        "folder string, lineage string, created_at timestamp, reset boolean, grafted string"
    ),
    "marks": "run_id string, kind string, fact_id long, term string",
    "outcomes": "run_id string, outcome string, seq long, ts timestamp",
    "turn_events": "seq long, run_id string, fact_id long, kind string, outcome string, ts timestamp",
    "bond_events": "term string, fact_id long, ts timestamp",
    "patterns": "seq long, op string, trigger string, resolution string, taught boolean, uses long, wins long, sweep string",
    "pattern_uses": "key string, outcome string, ts timestamp",
    "episodes": "id long, ts timestamp, request string, summary string, tools string, outcome string",
    "blobs": "handle string, fingerprint string, tool string, body string, touched_at timestamp",
    "touches": "handle string, ts timestamp",
    "tombs": "handle string, fingerprint string, tool string, touched_at timestamp, chars long, swept_at timestamp",
    "drops": "handle string, ts timestamp",
    "sweeps": "mark long, sweep string",
    "mirrors": "mirror string, upto long, filled boolean",
    "sightings": "seq long, kind string, uri string, display string, summary string, ts timestamp",
}


@dataclass(frozen=True)
class Settings:
    """What a store may switch off, and the sizes of its answers."""

    recall_limit: int = 8
    routing: bool = True
    scatter: bool = True
    reinforce: bool = True
    hold_unproven: bool = True
    proactive: bool = True
    core_limit: int = 8
    read_seconds: float = 60.0
    index_tail: int = 1000
    pack_files: int = 64


class Store:
    """Tables of one folder, with explicit schemas; missing ones are empty."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def _place(self, table: str) -> str:
        return f"{self.path}/{table}"

    def table(self, table: str) -> DataFrame:
        """A table's rows, from its packs and the files since; columns added later are null in older files. No files are an empty table."""
        return self._read(table, "rows")

    def _packs(self, table: str) -> Packs:
        return Packs(self.spark, self._place(table), f"{self.path}/packs/{table}")

    def _read(self, table: str, kind: str) -> DataFrame:
        packs = self._packs(table)
        layout = packs.layout()
        return self._rows(table, packs.places(layout, kind) if layout.packs else [self._place(table)])

    def _rows(self, table: str, places: list[str]) -> DataFrame:
        """Rows at the places; only a place that is not there is empty."""
        try:
            return self.spark.read.schema(SCHEMAS[table]).parquet(*places)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    def pack(self, table: str) -> None:
        """Take the small files of a table over into a pack; events keep their history, and a pack of them its part of the state.

        Where the state needs half of the events or more, it is read from the pack's rows: a copy would spare few.
        """
        events = table == "fact_events"
        by_event = lambda rows: rows.repartitionByRange("event").sortWithinPartitions("event")
        laid = by_event if events else lambda rows: rows.hint("rebalance")
        self._packs(table).pack(lambda places: self._rows(table, places), laid, needed_events if events else None)

    def tidy(self) -> list[str]:
        """Pack the tables that have ``pack_files`` files or more outside their packs; their names."""
        full = [t for t in SCHEMAS if len(self._packs(t).layout().tail) >= self.settings.pack_files]
        for table in full:
            self.pack(table)
        return full

    def vacuum(self, hours: float = 7 * 24) -> int:
        """Delete what packs replaced so long ago; streams and readers older than that fail."""
        return sum(self._packs(t).vacuum(hours) for t in SCHEMAS)

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the table's columns; those that they lack are null."""
        wanted = self.spark.createDataFrame([], SCHEMAS[table]).schema
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    def append(self, table: str, rows: DataFrame) -> None:
        self._shaped(table, rows).write.mode("append").option("compression", "zstd").parquet(self._place(table))

    def set_aside(self, table: str) -> str:
        """Move an unreadable table aside, under its name and the time; the next read finds it empty."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        old = hadoop.Path(self._place(table))
        new = hadoop.Path(f"{self._place(table)}.unreadable-{time.strftime('%Y%m%d-%H%M%S')}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(old, new)
        return new.toString()

    def readable(self, table: str) -> DataFrame:
        """The table, or an empty one after its unreadable files were moved aside."""
        df = self.table(table)
        try:
            df.limit(1).count()
            return df
        except Exception as broken:
            if not any(x in str(broken) for x in ("Parquet", "CORRUPT", "FAILED_READ_FILE", "not a Parquet")):
                raise
            self.set_aside(table)
            return self.table(table)

    def facts(self, ids: DataFrame | None = None) -> DataFrame:
        """The current facts of the store's events; with ``ids`` (id) those alone, aggregated from their events alone.

        Of a pack only the events that the state needs are read.
        """
        events, turns = self._read("fact_events", "state"), self.table("turn_events")
        if ids is not None:
            events = events.join(ids, "id", "left_semi")
            turns = turns.join(ids.withColumnRenamed("id", "fact_id"), "fact_id", "left_semi")
        return current_facts(events, turns)

    def index(self) -> TokenIndex:
        """The stored token index, as of its last update."""
        return TokenIndex(self.spark, self._place("token_index"))

    def merge_candidates(self, fact: str, event: int) -> DataFrame | None:
        """(id): the facts that the next event's fact may merge with, by the index; None while there is none.

        Events after the index's last one are candidates unread; past ``index_tail`` of
        them the index takes them over first. Facts of the last hour are added, as an
        elaboration shares few of the new fact's tokens.
        """
        index, events = self.index(), self.table("fact_events")
        commits = index.commits()
        upto = commits[-1].upto if commits else -1
        if event - 1 - max(upto, 0) > self.settings.index_tail:
            index.update(events)
            upto = index.commits()[-1].upto
        elif not commits:
            return None
        recent = F.col("created_at") >= F.current_timestamp() - F.expr(f"INTERVAL {V.ELABORATE_SECONDS} SECONDS")
        asked = self.spark.createDataFrame([(0, fact)], "new_id long, fact string")
        return index.merge_candidates(asked).select("id").unionByName(events.where((F.col("event") > upto) | recent).select("id")).distinct()

    def write(self, batch: DataFrame) -> DataFrame:
        """Many facts (seq, fact, category, lineage, ts, and context, cues where given) written in order: what became of each, with ids.

        Only stored facts that the token index finds for some write are read, and what
        the writes did is appended as events: a restatement writes none. ``seq`` counts
        from 0; numbers follow the highest there is, so the store has one writer.
        """
        from millrace.operators import grading, ingest

        events = self.table("fact_events")
        index = self.index()
        index.update(events)
        rows = staged(batch, "writes")
        facts = self.facts()
        earliest = rows.agg(F.min("ts")).first()[0]
        near = index.merge_candidates(rows.select(F.col("seq").alias("new_id"), "fact")).select("id")
        if earliest is not None:
            recent = F.col("created_at") >= F.lit(earliest) - F.expr(f"INTERVAL {V.ELABORATE_SECONDS} SECONDS")
            near = near.unionByName(events.where(recent).select("id"))
        near = staged(near.distinct(), "writes-near")
        done = staged(ingest.write_batch(rows, self.facts(near), grading.standing(facts)), "written")
        base = (events.agg(F.max("event")).first()[0] or 0) + 1
        done = done.withColumn("id", F.when(F.col("target_stored"), F.col("target")).otherwise(F.col("target") + base))
        given = done.where("action <> 'restated'").join(rows, "seq")
        op = F.when(F.col("action") == "inserted", "insert").otherwise("update").alias("op")
        extra = [c for c in ("context", "cues") if c in rows.columns]
        self.append(
            "fact_events",
            given.select(
                (F.col("seq") + base).alias("event"), op, "id", "fact", "category", *extra, "lineage", F.col("ts").alias("created_at"),
                (F.col("changed") | F.col("demoted")).alias("reset"), "grafted",
            ),
        )
        return done.select("seq", "id", "action", "changed", "demoted", "elaborated")

    def bonds(self) -> DataFrame:
        """D3: (term, id, weight, last): bonds of facts that are there, from their last reset on."""
        from millrace.operators import grading

        state = self._read("fact_events", "state").groupBy(F.col("id").alias("fact_id")).agg(
            F.max_by("op", "event").alias("op"), F.max(F.when(F.col("reset"), F.col("created_at"))).alias("reset_at")
        )
        kept = self.table("bond_events").join(state.where("op <> 'forget'"), "fact_id").where("reset_at IS NULL OR ts >= reset_at")
        return grading.bond_weights(kept.select("term", "fact_id", "ts"))

    def patterns(self) -> DataFrame:
        """The shortcuts: one row for each order-free key, with tallies of first writes and of uses; forgotten ones are gone."""
        from millrace.operators import tasks

        writes = self._committed_patterns().withColumn("key", T.trigger_key(F.col("trigger")))
        gone = writes.where("op = 'forget'").groupBy("key").agg(F.max("seq").alias("gone"))
        known = tasks.learn(writes.where("op IS NULL OR op <> 'forget'").join(gone, "key", "left").where("gone IS NULL OR seq > gone").drop("key"))
        used = self.table("pattern_uses").where("outcome <> 'stopped'").groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "ok").alias("won"), F.max("ts").alias("last_used")
        )
        tallied = known.join(used, "key", "left").withColumns(
            {"uses": F.col("uses") + F.coalesce("n", F.lit(0)), "wins": F.col("wins") + F.coalesce("won", F.lit(0))}
        )
        sector = T.sector_of(T.auto_folder(F.concat_ws(" ", "trigger", "resolution"), F.lit("fact")))
        return tallied.withColumns({"id": F.xxhash64("key"), "sector": sector}).drop("n", "won")

    def _committed_patterns(self) -> DataFrame:
        """Writes of patterns; those of a sweep count once its commit row is there."""
        done = self.table("sweeps").where("sweep IS NOT NULL").select("sweep").distinct()
        rows = self.table("patterns")
        return rows.where("sweep IS NULL").unionByName(rows.where("sweep IS NOT NULL").join(done, "sweep", "left_semi").select(*rows.columns))

    def mined(self) -> DataFrame:
        """(key): what sweeps promoted before, forgotten since or not."""
        return self._committed_patterns().where("op = 'mined'").select(T.trigger_key(F.col("trigger")).alias("key")).distinct()

    # ------------------------------------------------------------ held bodies

    def held(self) -> DataFrame:
        """(handle, fingerprint, tool, put_at, touched_at): the bodies that are held now; no body is read for it.

        A sweep ends a handle until the body is put again; a drop ends it for good.
        """
        from millrace.operators import ledger

        start = F.lit("1970-01-01").cast("timestamp")
        at = F.coalesce("touched_at", start)
        puts = self.table("blobs").groupBy("handle").agg(F.max_by(F.struct("fingerprint", "tool"), at).alias("e"), F.max(at).alias("put_at"))
        reads = self.table("touches").groupBy("handle").agg(F.max("ts").alias("read_at"))
        ends = self.table("tombs").groupBy("handle").agg(F.max(F.coalesce("swept_at", "touched_at", start)).alias("end_at"))
        live = puts.join(reads, "handle", "left").join(ends, "handle", "left").where("end_at IS NULL OR put_at > end_at")
        return ledger.without(live.select("handle", "e.*", "put_at", F.greatest("put_at", "read_at").alias("touched_at")), self.table("drops"))

    def graves(self) -> DataFrame:
        """The newest 2000 tombs of handles that are not held."""
        from millrace.operators import ledger

        at = F.coalesce("swept_at", "touched_at")
        last = self.table("tombs").groupBy("handle").agg(F.max_by(F.struct("fingerprint", "tool", "touched_at", "chars", "swept_at"), at).alias("e"))
        gone = last.select("handle", "e.*").join(self.held().select("handle"), "handle", "left_anti")
        return gone.orderBy(F.desc("swept_at"), F.desc(ledger.handle_number(F.col("handle")))).limit(V.TOMBS)

    def bodies(self, live: DataFrame) -> DataFrame:
        """(handle, tool, body, touched_at) of held handles (handle, put_at, touched_at)."""
        at = F.coalesce("touched_at", F.lit("1970-01-01").cast("timestamp"))
        rows = self.table("blobs").select("handle", at.alias("put_at"), "tool", "body")
        return rows.join(live.select("handle", "put_at", "touched_at"), ["handle", "put_at"]).select("handle", "tool", "body", "touched_at")

    def sizes(self, live: DataFrame) -> DataFrame:
        """(handle, touched_at, chars) of held handles (handle, put_at, touched_at); bodies are measured where they are read."""
        at = F.coalesce("touched_at", F.lit("1970-01-01").cast("timestamp"))
        rows = self.table("blobs").select("handle", at.alias("put_at"), F.length("body").cast("long").alias("chars"))
        return rows.join(live.select("handle", "put_at", "touched_at"), ["handle", "put_at"]).select("handle", "touched_at", "chars")

    def hold(self, results: DataFrame, as_of, threshold: int = 2000) -> DataFrame:
        """(seq, text, removed, handle) of tool results (seq, tool, body); folded bodies are stored.

        A body that is held already is touched, one that was swept comes back under
        its handle while its tomb is there, and others get the next numbers.
        """
        from millrace.operators import fold

        live = staged(self.held(), "held")
        done, handles = fold.fold_and_mark(results, live.select("fingerprint", "handle"), self._numbered_tombs(), threshold)
        firsts = handles.groupBy("handle").agg(F.min("seq").alias("seq"))
        fresh = firsts.join(live.select("handle"), "handle", "left_anti")
        rows = done.where("folded").select("seq", "fingerprint", "tool", "body").join(fresh, "seq")
        self.append("blobs", rows.select("handle", "fingerprint", "tool", "body", as_of.alias("touched_at")))
        self.append("touches", firsts.join(live.select("handle"), "handle", "left_semi").select("handle", as_of.alias("ts")))
        return fold.told(done, handles)

    def _numbered_tombs(self) -> DataFrame:
        """(fingerprint, handle): tombs that a body may come back to; others only keep their numbers in use."""
        used = self.table("tombs").select(F.lit(None).cast("string").alias("fingerprint"), "handle")
        dropped = self.table("blobs").select(F.lit(None).cast("string").alias("fingerprint"), "handle")
        return self.graves().select("fingerprint", "handle").unionByName(used).unionByName(dropped)

    def sweep(self, as_of, days: int = V.TTL_DAYS) -> None:
        """End what was not put or read for so many days; a tomb stays of each."""
        live = self.held()
        gone = live.where(F.col("touched_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
        sizes = self.sizes(gone).select("handle", "chars")
        self.append("tombs", gone.join(sizes, "handle", "left").withColumn("swept_at", as_of))

    def changes(self, after: int = 0) -> DataFrame:
        """(event, op, id, category, fact): what a mirror of the facts has to take over, in order of ``event``.

        ``op`` is put or remove; trust and moves do not change what is mirrored.
        """
        rows = self.table("fact_events").where(F.col("event") > after).where("op IN ('insert', 'update', 'forget')")
        op = F.when(F.col("op") == "forget", F.lit("remove")).otherwise(F.lit("put"))
        return rows.select("event", op.alias("op"), "id", "category", "fact")

    def mirror(self, put, checkpoint: str, name: str | None = None):
        """A stream of new fact events to ``put(batch, batch_id)``; its checkpoint remembers how far it got.

        A mirror with a name is filled first with the facts that are there, as batch -1.
        """
        stream = self.spark.readStream.schema(SCHEMAS["fact_events"]).parquet(self._place("fact_events"))
        changed = stream.where("op IN ('insert', 'update', 'forget')")
        if name is not None:
            changed = changed.where(F.col("event") > self._fill(put, name))
        return changed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _fill(self, put, name: str) -> int:
        """The event that a mirror's filling ends with; events after it are the stream's.

        The number is stored before the filling begins. A filling that died begins again
        with the state as of that very event, so ``put`` gets the same batch again
        and what was written meanwhile comes by the stream, once.
        """
        known = self.table("mirrors").where(F.col("mirror") == name).agg(F.max("upto").alias("upto"), F.bool_or("filled").alias("filled")).first()
        upto = known.upto
        if upto is None:
            upto = self.table("fact_events").agg(F.max("event")).first()[0]
            upto = -1 if upto is None else upto
            self.append("mirrors", self.spark.createDataFrame([(name, upto, False)], SCHEMAS["mirrors"]))
        if not known.filled:
            untold = self.spark.createDataFrame([], SCHEMAS["turn_events"])  # tallies are not mirrored
            then = current_facts(self.table("fact_events").where(F.col("event") <= upto), untold)
            put(self._shaped("fact_events", then.withColumns({"event": F.lit(upto), "op": F.lit("insert")})), -1)
            self.append("mirrors", self.spark.createDataFrame([(name, upto, True)], SCHEMAS["mirrors"]))
        return upto

    def dump(self, limit: int = 500) -> DataFrame:
        """The newest facts with the tree that they hang on and what they lack to be found by."""
        shown = self.facts().withColumns({"tree": T.tree_of(F.col("lineage")), "cue_gap": T.cue_gap(F.col("fact"))})
        return shown.orderBy(F.desc("id")).limit(limit)

    def revisions(self) -> DataFrame:
        """(id, event, fact, stored_at) of every text that a fact that is still there had."""
        events = self.table("fact_events")
        there = events.groupBy("id").agg(F.max_by("op", "event").alias("op")).where("op <> 'forget'")
        texts = events.where("op IN ('insert', 'update')").join(there.select("id"), "id", "left_semi")
        return texts.select("id", "event", "fact", F.col("created_at").alias("stored_at"))

    def counts(self) -> DataFrame:
        """One row: facts, unproven, bonds, patterns, episodes, blobs, held_chars, tombs."""
        facts = self.facts().agg(F.count(F.lit(1)).alias("facts"), F.count_if("unproven").alias("unproven"))
        blobs = self.table("blobs").agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("held_chars"))
        rest = [
            self.bonds().agg(F.count(F.lit(1)).alias("bonds")),
            self.patterns().agg(F.count(F.lit(1)).alias("patterns")),
            self.table("episodes").agg(F.count(F.lit(1)).alias("episodes")),
            self.table("tombs").agg(F.count(F.lit(1)).alias("tombs")),
            blobs,
        ]
        for one in rest:  # single rows
            facts = facts.crossJoin(one)
        return facts


def needed_events(events: DataFrame) -> DataFrame:
    """The events that ``current_facts`` takes something from: at most eleven of an id, whatever its history.

    Every value there is that of a first, last or greatest event of some kind, so the
    needed events of parts, put together, give the state of the whole.
    """
    op = F.col("op")
    kinds = [
        F.lit(True), op.isin("insert", "update"), op.isin("insert", "update", "trust"), F.col("context").isNotNull(), F.col("cues").isNotNull(),
        F.coalesce("reset", F.lit(False)), F.col("folder").isNotNull(), F.col("grafted").isNotNull(),
    ]
    last = [F.max(F.when(kind, F.col("event"))) for kind in kinds]
    latest = [F.max_by("event", F.when(kind, F.col("created_at"))) for kind in (op == "trust", F.col("reset"))]
    first = F.min(F.when(op == "insert", F.col("event")))
    picks = events.groupBy("id").agg(F.array_distinct(F.array(*last, *latest, first)).alias("picks"))
    wanted = picks.select("id", F.explode("picks").alias("event")).where("event IS NOT NULL")
    return events.join(wanted, ["id", "event"], "left_semi").select(*events.columns)


def current_facts(events: DataFrame, turns: DataFrame) -> DataFrame:
    """The current facts: the last text of each id, without forgotten ones, with folder, marks and tallies.

    Trust and moves are events without a text and leave it alone. A context or
    cues that an event does not give stay; a reset clears the cues, and tallies
    count from it on. A trusted fact is not held and hangs on the user's tree.
    """
    from millrace.operators import grading

    def last(value, condition):
        """The value at the last event with the condition."""
        return F.max_by(value, F.when(condition, F.col("event")))

    none = F.lit(None).cast("string")
    written = F.col("op").isin("insert", "update")
    trust = F.col("op") == "trust"
    cleared = F.when(F.coalesce("reset", F.lit(False)), F.coalesce("cues", F.lit(""))).otherwise(F.col("cues"))
    state = events.groupBy("id").agg(
        F.max_by("op", "event").alias("op"),
        last(F.struct("fact", "category", "created_at"), written).alias("e"),
        last(F.col("context"), F.col("context").isNotNull()).alias("context"),
        last(cleared, cleared.isNotNull()).alias("cues"),
        last(F.col("folder"), F.col("folder").isNotNull()).alias("moved"),
        last(F.col("grafted"), F.col("grafted").isNotNull()).alias("grafted"),
        last(F.when(trust, F.lit("user/hand/hand")).otherwise(F.col("lineage")), written | trust).alias("lineage"),
        F.max(F.when(trust, F.col("created_at"))).alias("trusted_at"),
        F.max(F.when(F.col("reset"), F.col("created_at"))).alias("reset_at"),
        # the folder of the first text is found where that is read, so no second text is moved
        F.min_by(F.when(F.col("op") == "insert", T.auto_folder(F.col("fact"), F.col("category"))), F.when(F.col("op") == "insert", F.col("event"))).alias("filed"),
    )
    rows = state.where("op <> 'forget' AND e IS NOT NULL")
    since = rows.select(F.col("id").alias("fact_id"), "reset_at", "trusted_at")
    turns = turns.join(since, "fact_id")
    tallies = grading.tallies(turns.where("reset_at IS NULL OR ts >= reset_at"))
    held = grading.held_flags(turns.where("trusted_at IS NULL OR ts > trusted_at"))
    rows = rows.join(tallies, "id", "left").join(held, "id", "left")
    return rows.select(
        "id", "e.*", "context", F.coalesce("cues", F.lit("")).alias("cues"),
        F.coalesce("moved", "filed", T.auto_folder(none, none)).alias("folder"), "lineage",
        F.coalesce("grafted", F.lit("")).alias("grafted"),
        F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("wins", F.lit(0)).alias("wins"), "last_used",
        F.coalesce("unproven", F.lit(False)).alias("unproven"),
    )


def cosine_backend(stored: DataFrame, asked: DataFrame, limit: int = 24, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, pos, mem_id, sim): for each asked embedding (query_id, v) the nearest stored ones (id, v).

    The asked ones are the stated query set. They are counted and dealt into
    blocks of at most ``block_bytes``, each of which is sent to the stored ones;
    every pair is compared, by products of matrices, and what these leave is
    summed and rounded as in SQL. A task keeps its best of each query, so
    what is shuffled is ``limit`` rows of each query and task. Pairs without a
    similarity (null, sizes that differ) come last, NaN first.
    """
    spark = stored.sparkSession
    size = asked.select(F.sum(F.coalesce(F.size("v"), F.lit(0)) * 8 + 32)).first()[0] or 0
    blocks = 1 if size <= block_bytes else -(-2 * size // block_bytes)  # a hash deals unevenly
    left = asked.select("query_id", F.col("v").cast("array<double>").alias("v"))
    right = stored.select("id", F.col("v").cast("array<double>").alias("v"))
    schema = StructType([StructField("query_id", left.schema["query_id"].dataType), StructField("mem_id", right.schema["id"].dataType), StructField("sim", DoubleType())])
    out = to_arrow_schema(schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("mem_id"))
    every = None
    for k in range(blocks):
        block = left.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast(Asked(block["query_id"].combine_chunks(), block["v"].combine_chunks(), limit))

        def nearest(batches, sent=sent):
            wanted = sent.value
            wanted.start()
            for b in batches:
                wanted.see(np.array(b.column(0).to_pylist(), object) if pa.types.is_string(b.column(0).type) else b.column(0).to_numpy(zero_copy_only=False), b.column(1))
            yield wanted.found(out)

        scored = right.mapInArrow(nearest, schema)
        best = scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
        every = best if every is None else every.unionByName(best)
    if every is None:
        every = spark.createDataFrame([], schema).withColumn("pos", F.lit(1))
    return every.select("query_id", "pos", "mem_id", "sim")
