"""Registered queries over stored structures: the token index, held bodies, packs and mirrors of fact events.

Each query writes its store below the shared folder and reads it back, so the
whole loop of writes, updates and reads is what the result shows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.catalogue import _tok, facts, query, questions, table
from millrace.sources.index import TokenIndex
from millrace.sources.staging import shared_folder
from millrace.sources.store import Store


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def _fact_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as facts in two batches: all are inserted with half their text; then all but a seventh are rewritten whole or forgotten."""
    rows = facts(spark, sf_dir)
    first = rows.select((F.col("id") * 2).alias("event"), F.lit("insert").alias("op"), "id", F.expr("left(fact, length(fact) div 2)").alias("fact"))
    second = rows.where("id % 7 <> 0").select(
        (F.col("id") * 2 + 1_000_000_000_001).alias("event"),
        F.when(F.col("id") % 11 == 5, "forget").otherwise("update").alias("op"),
        "id",
        F.when(F.col("id") % 11 != 5, F.col("fact")).alias("fact"),
    )
    return first, second


def _built(spark: SparkSession, sf_dir: str) -> TokenIndex:
    index = TokenIndex(spark, fresh_folder(spark, "index"))
    for batch in _fact_events(spark, sf_dir):
        index.update(batch)
    return index


_FINAL = "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN left(text, length(text) // 2) ELSE text END AS fact FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 <> 5"


@query(
    f"WITH f AS ({_FINAL}), q AS (SELECT item_id AS query_id, unnest({_tok('text')}) AS token FROM benchmark), t AS (SELECT id, unnest({_tok('fact')}) AS token FROM f), "
    "h AS (SELECT query_id, id, count(*) AS overlap FROM q JOIN t USING (token) GROUP BY ALL) "
    "SELECT query_id, rank, id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, id DESC) AS rank FROM h) WHERE rank <= 8"
)
def recall_indexed(spark, sf_dir):
    """Top 8 of each question from the stored index, after inserts, rewrites and removals."""
    return _built(spark, sf_dir).top_overlaps(questions(spark, sf_dir), 8).select("query_id", "rank", "id", "overlap")


@query(
    f"WITH f AS ({_FINAL}), q AS (SELECT DISTINCT unnest({_tok('text')}) AS token FROM benchmark), t AS (SELECT id, unnest({_tok('fact')}) AS token FROM f) "
    "SELECT token, count(*) AS df, min(id) AS first_id, max(id) AS last_id, sum(id)::BIGINT AS ids FROM t JOIN q USING (token) GROUP BY 1"
)
def index_lookup(spark, sf_dir):
    """Postings and document frequencies of all words of the questions."""
    index = _built(spark, sf_dir)
    wanted = questions(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    found = index.postings(wanted).groupBy("token").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("id").alias("ids"))
    return found.join(index.frequencies(wanted), "token").select("token", "df", "first_id", "last_id", "ids")


def _day(n: int):
    return F.lit(f"2024-01-{n:02d}").cast("timestamp")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results of three tools."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("tool"), (F.col("doc_id") % 3).cast("string")).alias("tool"), F.col("text").alias("body")
    )


_HELD_AT = (
    "WITH f AS (SELECT tool, text, min(doc_id) AS first FROM (SELECT doc_id, 'tool' || doc_id % 3 AS tool, text FROM documents WHERE length(text) >= 2000 AND NOT regexp_matches(text, '^\\s*(ERROR|DENIED|BLOCKED|SKIPPED)')) GROUP BY 1, 2), "
    "h AS (SELECT *, row_number() OVER (ORDER BY first) AS n FROM f) "
)


def _folded_store(spark: SparkSession, sf_dir: str) -> Store:
    """Held on day 1; even handles read on day 3; swept on day 5, which ends the odd ones; all that the first tool gave comes again on day 6."""
    store = Store(spark, fresh_folder(spark, "bodies"))
    results = _results(spark, sf_dir)
    store.hold(results, _day(1))
    handles = store.held().select("handle")
    store.append("touches", handles.where(F.substring("handle", 2, 18).cast("long") % 2 == 0).select("handle", _day(3).alias("ts")))
    store.sweep(_day(5))
    return store


@query(
    _HELD_AT
    + ", s AS (SELECT *, CASE WHEN n % 2 = 1 THEN row_number() OVER (PARTITION BY n % 2 ORDER BY n DESC) END AS grave FROM h), top AS (SELECT max(n) AS top FROM h), "
    "a AS (SELECT *, CASE WHEN n % 2 = 0 THEN n WHEN grave <= 2000 THEN n ELSE top + row_number() OVER (PARTITION BY coalesce(grave > 2000, false) ORDER BY first) END AS now FROM s, top WHERE tool = 'tool0') "
    "SELECT 'R' || n AS handle, 'live' AS status, CASE WHEN tool = 'tool0' THEN '2024-01-06' ELSE '2024-01-03' END AS touched, length(text) AS chars FROM h WHERE n % 2 = 0 "
    "UNION ALL SELECT 'R' || now, 'live', '2024-01-06', length(text) FROM a WHERE n % 2 = 1 "
    "UNION ALL SELECT 'R' || n, 'expired', '2024-01-01', length(text) FROM s WHERE n % 2 = 1 AND NOT (tool = 'tool0' AND grave <= 2000)"
)
def blob_expiry(spark, sf_dir):
    """Bodies that are held, read, swept, and put again."""
    store = _folded_store(spark, sf_dir)
    store.hold(_results(spark, sf_dir).where("tool = 'tool0'"), _day(6))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("touched")
    live = store.sizes(store.held()).select("handle", F.lit("live").alias("status"), day("touched_at"), "chars")
    gone = store.table("tombs").join(live.select("handle"), "handle", "left_anti").select("handle", F.lit("expired").alias("status"), day("touched_at"), "chars")
    return live.unionByName(gone)


@query(
    _HELD_AT
    + ", d AS (SELECT doc_id AS seq, 'tool' || doc_id % 3 AS tool, text FROM documents) "
    "SELECT seq, CASE WHEN n IS NULL THEN NULL ELSE 'R' || n END AS handle, n IS NULL OR starts_with(text, '') AS readable, sha256(d.text) AS body_sha256 FROM d LEFT JOIN h USING (tool, text)"
)
def fold_hold(spark, sf_dir):
    """every result's handle, and its whole text: as it was sent, or read back by its handle."""
    store = Store(spark, fresh_folder(spark, "bodies"))
    unheld = F.col("handle").isNull()
    # results without a handle are spread by their number, and texts are hashed where they are read
    key = F.coalesce("handle", F.col("seq").cast("string")).alias("key")
    sent = store.hold(_results(spark, sf_dir), _day(1)).select("seq", "handle", key, F.when(unheld, F.sha2("text", 256)).alias("sent"))
    back = store.bodies(store.held()).select(F.col("handle").alias("key"), F.sha2("body", 256).alias("held"))
    whole = F.coalesce("held", "sent")
    return sent.join(back, "key", "left").select("seq", "handle", whole.isNotNull().alias("readable"), whole.alias("body_sha256"))


def _histories(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents as five batches of fact events: all are inserted with half their text, then rewritten (some reset), moved, trusted or forgotten, and rewritten again."""
    rows = facts(spark, sf_dir)
    number = lambda k: (F.col("id") + k * 1_000_000_000_000).alias("event")
    base = lambda k, op: [number(k), F.lit(op).alias("op"), "id", F.lit("fact").alias("category"), _day(k).alias("created_at")]
    cues = F.concat(F.lit("cue"), (F.col("id") % 5).cast("string")).alias("cues")
    return [
        rows.select(*base(1, "insert"), F.expr("left(fact, length(fact) div 2)").alias("fact"), cues),
        rows.where("id % 7 <> 0").select(*base(2, "update"), "fact", (F.col("id") % 3 == 0).alias("reset")),
        rows.where("id % 4 = 1").select(*base(3, "move"), F.lit("Elsewhere/Moved").alias("folder")),
        rows.where("id % 11 = 5").select(*base(4, "forget")).unionByName(rows.where("id % 11 = 6").select(*base(4, "trust"))),
        rows.where("id % 13 = 2 AND id % 11 <> 5").select(*base(5, "update"), F.expr("right(fact, length(fact) div 3)").alias("fact"), F.lit("said again").alias("context")),
    ]


_LAST_TEXT = (
    "CASE WHEN doc_id % 13 = 2 THEN CASE WHEN length(text) // 3 = 0 THEN '' ELSE right(text, length(text) // 3) END "
    "WHEN doc_id % 7 <> 0 THEN text ELSE left(text, length(text) // 2) END"
)
_THERE = "FROM documents WHERE doc_id % 11 <> 5"


@query(
    f"SELECT doc_id AS id, {_LAST_TEXT} AS fact, CASE WHEN doc_id % 13 = 2 THEN 'said again' END AS context, "
    "CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN '' ELSE 'cue' || doc_id % 5 END AS cues, doc_id % 4 = 1 AS moved, "
    "CASE WHEN doc_id % 11 = 6 AND doc_id % 13 <> 2 THEN 'user/hand/hand' END AS lineage, 1 + (doc_id % 7 <> 0)::BIGINT + (doc_id % 13 = 2)::BIGINT AS n_texts "
    f"{_THERE}"
)
def packed_facts(spark, sf_dir):
    """Facts and numbers of texts from packs made between five batches of events, and a batch after the last pack."""
    store = Store(spark, fresh_folder(spark, "packed"))
    for k, batch in enumerate(_histories(spark, sf_dir)):
        store.append("fact_events", batch)
        if k in (0, 2, 3):
            store.pack("fact_events")
    texts = store.revisions().groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"))
    moved = (F.col("folder") == "Elsewhere/Moved").alias("moved")
    return store.facts().join(texts, "id").select("id", "fact", "context", "cues", moved, "lineage", "n_texts")


@query(
    f"SELECT doc_id AS id, {_LAST_TEXT} AS fact, 1 + (doc_id % 13 = 2)::BIGINT AS n_puts {_THERE} "
    "UNION ALL SELECT doc_id, NULL, 2 FROM documents WHERE doc_id % 11 = 5"
)
def mirror_handover(spark, sf_dir):
    """The last text that a mirror got of each fact and how often it got it: filled while facts are written, then by the stream, twice started."""
    store = Store(spark, fresh_folder(spark, "mirrored"))
    batches = _histories(spark, sf_dir)
    for batch in batches[:2]:
        store.append("fact_events", batch)
    copy = fresh_folder(spark, "mirror")

    def put(batch: DataFrame, batch_id: int) -> None:
        if batch_id == -1:  # writes in the middle of the filling
            for late in batches[2:4]:
                store.append("fact_events", late)
        batch.select("event", "op", "id", "fact").write.mode("append").parquet(copy)

    state = fresh_folder(spark, "mirror-state")
    store.mirror(put, state, "copy").awaitTermination()
    store.append("fact_events", batches[4])
    store.mirror(put, state, "copy").awaitTermination()
    return spark.read.parquet(copy).groupBy("id").agg(F.max_by("fact", "event").alias("fact"), F.count(F.lit(1)).alias("n_puts"))
