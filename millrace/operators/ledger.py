"""Content-addressed bodies, handles, expiry and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.sources.staging import staged


def fingerprint(tool: Column, body: Column) -> Column:
    """The SHA-1 of tool and body, with a unit separator between."""
    return F.sha1(F.concat(tool, F.lit("\u001f"), body))


def handle_number(handle: Column) -> Column:
    return F.substring(handle, 2, 18).try_cast("long")


def high_water(*tables: DataFrame) -> DataFrame:
    """(kind, top): the highest number given to each letter over all tables with a handle."""
    every = None
    for t in tables:
        one = t.select(F.left("handle", F.lit(1)).alias("kind"), handle_number(F.col("handle")).alias("n"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("kind").agg(F.max("n").alias("top"))


def allocate(rows: DataFrame, kind: Column, order: list[Column], top: DataFrame | None = None) -> DataFrame:
    """Rows with a ``handle``: a letter (R where it is unknown) and the next number of its kind, never used again.

    Numbers follow ``order`` without gaps: rows are range-partitioned by it and
    numbered from the partitions' counts, so no task numbers a whole kind.
    """
    letter = F.when(kind.isin(*V.HANDLE_KINDS), kind).otherwise(F.lit("R"))
    found = numbered(rows.withColumn("_kind", letter), "_kind", order, "_number")
    number = F.col("_number")
    if top is not None:
        found = found.join(top.withColumnRenamed("kind", "_kind"), "_kind", "left")
        number = number + F.coalesce("top", F.lit(0))
    return found.withColumn("handle", F.concat("_kind", number.cast("string"))).drop("_kind", "_number", "top")


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Rows with their number (from 1, without gaps) within ``group`` by ``order``, which is total; null is a group.

    Rows are range-partitioned by group and order and numbered from the partitions'
    counts, so that no task numbers a whole group.
    """
    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged, "numbers")  # the boundaries come from a sample
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_in")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy("_group").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_group", "_in", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    found = ranged.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
    return found.withColumn(name, F.col("_base") + F.col("_at") - F.col("_from") + 1).drop("_at", "_part", "_group", "_in", "_from", "_base")


def put_blobs(results: DataFrame, blobs: DataFrame | None = None, tombs: DataFrame | None = None) -> DataFrame:
    """(seq, fingerprint, handle, action) of results (seq, tool, body): live, revived or new.

    Equal results share the handle of the first; a live blob (fingerprint, handle)
    wins over a tomb; new handles follow the order of first sighting.
    """
    return give_handles(results.select("seq", fingerprint(F.col("tool"), F.col("body")).alias("fingerprint")), blobs, tombs)


def give_handles(marked: DataFrame, blobs: DataFrame | None = None, tombs: DataFrame | None = None) -> DataFrame:
    """``put_blobs`` of results whose fingerprints are known (seq, fingerprint); no body is read."""
    firsts = marked.groupBy("fingerprint").agg(F.min("seq").alias("first"))
    known = firsts
    for table, name in ((blobs, "live"), (tombs, "dead")):
        if table is None:
            known = known.withColumn(name, F.lit(None).cast("string"))
        else:
            held = table.groupBy("fingerprint").agg(F.max_by("handle", handle_number(F.col("handle"))).alias(name))
            known = known.join(held, "fingerprint", "left")
    old = known.where("live IS NOT NULL OR dead IS NOT NULL").select(
        "fingerprint", F.coalesce("live", "dead").alias("handle"), F.when(F.col("live").isNotNull(), F.lit("live")).otherwise(F.lit("revived")).alias("action")
    )
    tables = [t for t in (blobs, tombs) if t is not None]
    top = high_water(*tables) if tables else None
    fresh = allocate(known.where("live IS NULL AND dead IS NULL").select("fingerprint", "first"), F.lit("R"), [F.col("first")], top)
    every = old.unionByName(fresh.select("fingerprint", "handle", F.lit("new").alias("action")))
    return marked.select("seq", "fingerprint").join(every, "fingerprint").select("seq", "fingerprint", "handle", "action")


def sweep(blobs: DataFrame, as_of: Column, days: int = V.TTL_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live, tombs, swept): blobs touched within the days stay; the newest 2000 others leave a tomb.

    ``swept`` is (kind, mark): the highest number swept of each letter.
    """
    old = F.col("touched_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    gone = blobs.where(old)
    tombs = gone.withColumn("chars", F.length("body")).drop("body").orderBy(F.desc("touched_at"), F.desc(handle_number(F.col("handle")))).limit(V.TOMBS)
    swept = gone.groupBy(F.left("handle", F.lit(1)).alias("kind")).agg(F.max(handle_number(F.col("handle"))).alias("mark"))
    return blobs.where(~old), tombs, swept


def handle_status(asked: DataFrame, blobs: DataFrame, swept: DataFrame, tombs: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Asked (conv_id, handle) with ``status``: live, expired or missing, and ``tomb`` where one is left.

    With ``grants`` (conv_id, handle), other handles are missing for a conversation.
    """
    kind, number = F.left("handle", F.lit(1)), handle_number(F.col("handle"))
    rows = asked.join(blobs.select("handle", F.lit(True).alias("live")), "handle", "left")
    rows = rows.join(swept.withColumnRenamed("kind", "_k"), kind == F.col("_k"), "left")
    rows = rows.join(tombs.select("handle", F.lit(True).alias("tomb")), "handle", "left")
    allowed = F.lit(True)
    if grants is not None:
        rows = rows.join(grants.select("conv_id", "handle", F.lit(True).alias("granted")), ["conv_id", "handle"], "left")
        allowed = F.coalesce("granted", F.lit(False))
    status = F.when(F.col("live") & allowed, F.lit("live")).when(allowed & (number <= F.col("mark")), F.lit("expired")).otherwise(F.lit("missing"))
    return rows.select("conv_id", "handle", status.alias("status"), F.coalesce("tomb", F.lit(False)).alias("tomb"))


def upsert_entities(sightings: DataFrame) -> DataFrame:
    """(kind, ident, hot, summary, first_seen, last_seen) of sightings (seq, kind, uri, display, summary, ts).

    An entity is its kind and URI, or its display where there is none; each
    sighting adds one to ``hot``; a blank summary keeps the one before.
    """
    ident = F.coalesce(F.nullif("uri", F.lit("")), F.col("display"))
    told = F.nullif("summary", F.lit(""))
    return sightings.groupBy("kind", ident.alias("ident")).agg(
        F.count(F.lit(1)).cast("double").alias("hot"),
        F.max_by(told, F.when(told.isNotNull(), F.col("seq"))).alias("summary"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def decay(entities: DataFrame, factor: float = 0.9) -> DataFrame:
    """Every ``hot`` times the factor."""
    return entities.withColumn("hot", F.col("hot") * factor)


def hot_entities(entities: DataFrame, limit: int = 12) -> DataFrame:
    """K9: the hottest entities, then the last seen, then by name; with a ``handle`` they come in its order.

    What is hot decides which are shown, the handle in what order, so that a list
    shown again changes as little as it can. The limit is the report's own.
    """
    best = entities.orderBy(F.desc("hot"), F.desc("last_seen"), F.asc("kind"), F.asc("ident")).limit(limit)
    if "handle" in entities.columns:
        best = best.orderBy(F.left("handle", F.lit(1)), handle_number(F.col("handle")))
    return best


def blob_meta(blobs: DataFrame) -> DataFrame:
    """(handle, tool, chars, touched_at) without the bodies: of a stored table only their lengths are computed."""
    return blobs.select("handle", "tool", F.length("body").alias("chars"), "touched_at")


def tomb_meta(asked: DataFrame, tombs: DataFrame) -> DataFrame:
    """Asked (handle) with what a tomb still says of it: tool, chars, touched_at; no row for other handles."""
    wanted = asked.where(F.col("handle").rlike("^[A-Z][0-9]+$")).select("handle").distinct()
    return tombs.join(wanted, "handle", "left_semi").select("handle", "tool", "chars", "touched_at")


def live_handles(blobs: DataFrame, limit: int = 12) -> DataFrame:
    """The newest held bodies (handle, tool, chars), for an answer to a handle that does not exist."""
    newest = blobs.orderBy(F.desc("touched_at"), F.desc(handle_number(F.col("handle")))).limit(max(1, limit))
    return newest.select("handle", "tool", F.length("body").alias("chars"))


def touch(blobs: DataFrame, reads: DataFrame) -> DataFrame:
    """Blobs with ``touched_at`` at their last read (handle, ts), if that is later."""
    last = reads.groupBy("handle").agg(F.max("ts").alias("_read"))
    return blobs.join(last, "handle", "left").withColumn("touched_at", F.greatest("touched_at", "_read")).drop("_read")


def without(blobs: DataFrame, drops: DataFrame) -> DataFrame:
    """Blobs less those that were dropped (handle, or null for all). Numbers given before stay used."""
    rows = blobs.join(drops.where("handle IS NOT NULL"), "handle", "left_anti")
    cleared = drops.where("handle IS NULL").agg((F.count(F.lit(1)) > 0).alias("_all"))
    return rows.crossJoin(F.broadcast(cleared)).where("NOT _all").drop("_all")  # one row


def ledger_stats(blobs: DataFrame, entities: DataFrame, since: Column | None = None) -> DataFrame:
    """One row (entities, blobs, held_chars); ``since`` bounds the blobs alone."""
    counted = blobs if since is None else blobs.where(F.col("touched_at") >= since)
    held = counted.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("held_chars"))
    return entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(F.broadcast(held))  # two single rows
