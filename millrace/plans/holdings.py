"""Registered queries over held texts, the ledger, guards and the state of the store, with their DuckDB equivalents.

Stand-ins as in ``catalogue``, whose registry these queries join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vocab as V
from millrace.operators import fold, grading, guard, ledger, readback
from millrace.plans.catalogue import (
    ORACLES,
    _CLIP, _ENTITIES, _LINES, _MESSAGES, _PUTS, _STATS, _bare, _list, _logs, _messages, _sightings, _stats_requests, _tok, bodies,
    csv_bodies, query, table, turn_events,
)
from millrace.sources.store import current_facts

# ---------------------------------------------------------------- statistics


@query(
    _STATS
    + "SELECT handle, CASE col WHEN 'quantity' THEN 'QUANTITY' WHEN 'supplier' THEN '5' ELSE col END AS \"column\", rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY handle, col ORDER BY n DESC, value) AS rank FROM "
    "(SELECT handle, col, cell AS value, count(*) AS n FROM v WHERE ok GROUP BY ALL)) WHERE rank <= 8"
)
def stats_top_where(spark, sf_dir):
    """A8 with a row filter, a name in another case and a place."""
    wanted = _stats_requests(spark, sf_dir, ";F;")
    name = F.when(F.col("column") == "quantity", "QUANTITY").when(F.col("column") == "supplier", "5").otherwise(F.col("column"))
    return fold.column_top(csv_bodies(spark, sf_dir), wanted.withColumn("column", name)).select("handle", "column", "rank", "value", "n")


@query(
    "SELECT l_orderkey // 375 AS handle, count(*) + 2 AS scanned, count(*) + 1 AS matched, 1 AS ragged, count(DISTINCT l_linestatus) + 1 AS distinct_cells FROM lineitem GROUP BY 1 HAVING count(*) >= 199"
)
def stats_ragged(spark, sf_dir):
    """A row without the cell is ragged, one with a cell too many is read. Shorter bodies would be no tables at all."""
    texts = csv_bodies(spark, sf_dir).where(F.size(F.split("body", "\n")) >= 200).withColumn("body", F.concat("body", F.lit("\n9;9\n1;2;3;X;5;6")))
    wanted = _stats_requests(spark, sf_dir, None).where("column = 'status'")
    found = fold.column_stats(texts, wanted)
    return found.select("handle", "scanned", "matched", "ragged", F.col("distinct").alias("distinct_cells"))


@query("SELECT l_orderkey // 375 AS handle, count(*) + 1 AS scanned, count(*) FILTER (l_linestatus = 'F') AS matched FROM lineitem GROUP BY 1")
def line_count(spark, sf_dir):
    return fold.line_count(csv_bodies(spark, sf_dir), ";f;")


@query(
    "WITH l AS (SELECT event_id // 500 AS handle, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS line_no, CASE WHEN event_id % 499 = 0 THEN 'FATAL ' || event_type || ' overflow ' || event_id ELSE 'step ' || event_id || ' ok' END AS line FROM events), "
    "g AS (SELECT *, regexp_replace(line, '\\d+', '#', 'g') AS shape FROM l), c AS (SELECT handle, shape, count(*) AS n, min(line_no) AS f FROM g GROUP BY ALL), "
    "t AS (SELECT *, sum(n) OVER (PARTITION BY handle) AS total FROM c), u AS (SELECT *, n <= greatest(1, total // 100) AS rare FROM t WHERE total BETWEEN 24 AND 250000), "
    "w AS (SELECT *, sum(CASE WHEN rare THEN n ELSE 0 END) OVER (PARTITION BY handle) AS k FROM u), x AS (SELECT * FROM w WHERE rare AND k <= least(40, greatest(2, total // 50)) AND (total - k) * 2 >= total) "
    "SELECT handle, rank, line_no, n, line FROM (SELECT g.handle, g.line_no, x.n, g.line, row_number() OVER (PARTITION BY g.handle ORDER BY x.n, g.line_no) AS rank FROM g JOIN x ON g.handle = x.handle AND g.shape = x.shape AND g.line_no = x.f) WHERE rank <= 6"
)
def outlier_shapes(spark, sf_dir):
    return fold.outlier_shapes(_logs(spark, sf_dir))


# ---------------------------------------------------------------- reading back

_PAGE = (
    f"WITH l AS (SELECT * FROM ({_LINES})), t AS (SELECT handle, count(*) AS total FROM l GROUP BY 1), c AS (SELECT handle, line_no, line, sum(length(line) + 1) OVER (PARTITION BY handle ORDER BY line_no) AS spent FROM l WHERE line_no BETWEEN 2 AND 21), "
    "p AS (SELECT t.handle, total, count(c.handle) AS asked, count(*) FILTER (spent <= 1000) AS kept, string_agg(line, chr(10) ORDER BY line_no) FILTER (spent <= 1000) AS body, min_by(line, line_no) AS first_line FROM t LEFT JOIN c USING (handle) GROUP BY ALL) "
)


@query(
    _PAGE
    + "SELECT handle, 2 AS first, CASE WHEN asked > 0 THEN greatest(1 + kept, 2) END AS last, total, asked - kept AS unread, md5(CASE WHEN asked = 0 THEN handle || ' ends at line ' || total "
    + "WHEN kept = 0 THEN handle || ' line 2, part 1 of ' || ((length(first_line) + 299) // 300) || ':' || chr(10) || left(first_line, 300) || chr(10) || '[go on with part=2 of this line]' "
    + "ELSE handle || ' lines 2-' || (1 + kept) || ' of ' || total || ':' || chr(10) || body || CASE WHEN kept < asked THEN chr(10) || '[' || (asked - kept) || ' of the lines asked for did not fit; go on at start=' || (2 + kept) || ']' ELSE '' END END) AS digest FROM p"
)
def peek_pages(spark, sf_dir):
    """the second to the twenty-first line of every document, within a thousand characters."""
    every = bodies(spark, sf_dir)
    wanted = every.select("handle", *[F.lit(n).alias(c) for c, n in (("start", 2), ("count", 20), ("seen", 1), ("reached", 0), ("lost", 0))])
    return readback.pages(every, wanted, 1000).select("handle", "first", "last", "total", "unread", F.md5("text").alias("digest"))


@query(
    f"WITH h AS (SELECT handle, line_no, length(line_no || ': ' || {_CLIP.format(n=300)}) + 1 AS cost, row_number() OVER (PARTITION BY handle ORDER BY line_no) AS k FROM ({_LINES}) WHERE regexp_matches(line, 'e', 'i')), "
    "c AS (SELECT *, sum(cost) OVER (PARTITION BY handle ORDER BY line_no) AS spent FROM h WHERE k <= 5), g AS (SELECT handle, count(*) AS found, count(*) FILTER (spent <= 900 OR k = 1) AS shown FROM c GROUP BY 1) "
    "SELECT d.doc_id AS handle, coalesce(shown, 0) AS shown, coalesce(found, 0) AS found, coalesce(shown < found, false) AS size_cut, coalesce(found >= 5, false) AS hits_cut FROM documents d LEFT JOIN g ON g.handle = d.doc_id"
)
def grep_report(spark, sf_dir):
    return readback.grep_report(bodies(spark, sf_dir), "e", 5, 900).drop("text")


@query(ORACLES["grep_report"].replace("SELECT d.doc_id AS handle", "SELECT d.doc_id AS handle, NULL::INTEGER AS stopped"))
def grep_within(spark, sf_dir):
    """the report of a search with a limit of time, long enough here that every body is searched."""
    return readback.grep_within(bodies(spark, sf_dir), "e", 600, 5, 900).drop("text")


_CALLS = "SELECT user_id AS conv_id, event_type AS handle, event_id AS pos, event_id % 5 = 0 AS gone, event_id % 200 AS last_line FROM events"


@query(
    f"WITH c AS ({_CALLS}), s AS (SELECT *, count(*) FILTER (NOT gone) OVER w AS seen, coalesce(max(CASE WHEN NOT gone THEN last_line END) OVER (PARTITION BY conv_id, handle ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached, count(*) FILTER (gone) OVER w AS g FROM c WINDOW w AS (PARTITION BY conv_id, handle ORDER BY pos)), "
    "p AS (SELECT * FROM s WHERE NOT gone) SELECT conv_id, handle, pos, seen, reached, CASE WHEN g > coalesce(lag(g) OVER (PARTITION BY conv_id, handle ORDER BY pos), 0) THEN g ELSE 0 END AS lost FROM p"
)
def paging_state(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_type").alias("handle"), F.col("event_id").alias("pos"),
        F.when(F.col("event_id") % 5 == 0, "evicted").otherwise("page").alias("kind"), (F.col("event_id") % 200).alias("last_line"),
    )
    return readback.paging_state(calls)


# ---------------------------------------------------------------- formats

_QUOTE = "''"  # one quote within an SQL text
_TABLE = "SELECT p_partkey // 40 AS handle, string_agg({row}, {by} ORDER BY p_partkey) AS t FROM part GROUP BY 1"
_KINDS = (
    ("json", "'[' || t || ']'", "'{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}'", "','"),
    ("tabular", "'p_partkey | p_name | p_size' || chr(10) || t", "p_partkey || ' | ' || p_name || ' | ' || p_size", "chr(10)"),
    ("tsv", "'p_partkey p_name p_size' || chr(10) || t", "p_partkey || chr(9) || p_name || chr(9) || p_size", "chr(10)"),
    ("csv", "'p_partkey,p_name,p_size' || chr(10) || t", "p_partkey || ',' || p_name || ',' || p_size", "chr(10)"),
    (
        "python",
        f"'cols=[{_QUOTE}p_partkey{_QUOTE}, {_QUOTE}p_name{_QUOTE}, {_QUOTE}p_size{_QUOTE}]' || chr(10) || 'rows=[' || t || ']'",
        f"'(' || p_partkey || ',{_QUOTE}' || p_name || '{_QUOTE},' || p_size || ')'",
        "','",
    ),
)
_EVERY_FORMAT = " UNION ALL ".join(
    f"SELECT handle, {k} AS k, '{name}' AS format, length({text}) AS cost FROM ({_TABLE.format(row=row, by=by)})" for k, (name, text, row, by) in enumerate(_KINDS)
)


@query(
    f"WITH e AS ({_EVERY_FORMAT}), b AS (SELECT handle, min(cost) AS least, min(cost) FILTER (k = 0) AS json FROM e GROUP BY 1), p AS (SELECT e.*, row_number() OVER (PARTITION BY handle ORDER BY cost, k) AS rk FROM e) "
    "SELECT b.handle, CASE WHEN least <= json * 0.92::DOUBLE THEN p.format ELSE 'json' END AS format, CASE WHEN least <= json * 0.92::DOUBLE THEN least ELSE json END AS cost FROM b JOIN p ON p.handle = b.handle AND p.rk = 1"
)
def format_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 40").alias("handle")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("rows"))
    best = fold.choose_format(F.col("rows"), ["p_partkey", "p_name", "p_size"])
    return rows.withColumn("best", best).select("handle", "best.format", F.col("best.cost").alias("cost"))


@query(
    "SELECT o_custkey AS handle, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, o_orderkey::VARCHAR AS order_id, o_orderstatus AS status FROM orders "
    "WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)"
)
def json_rows(spark, sf_dir):
    """The orders of each customer as a JSON table, read back as rows; a single one is no table."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))))
    texts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("handle")).agg(F.to_json(rows).alias("body"))
    found = fold.parse_rows(texts)
    return found.select("handle", "row_no", F.element_at("row", "order_id").alias("order_id"), F.element_at("row", "status").alias("status"))


# ---------------------------------------------------------------- ledger

_HELD = "SELECT 'R' || doc_id AS handle, sha1('read_file' || chr(31) || text) AS fingerprint, doc_id AS n FROM documents WHERE doc_id % 5 = {k}"


@query(
    f"WITH p AS ({_PUTS}), b AS (SELECT fingerprint, max(n) AS n FROM ({_HELD.format(k=0)}) GROUP BY 1), t AS (SELECT fingerprint, max(n) AS n FROM ({_HELD.format(k=1)}) GROUP BY 1), "
    f"top AS (SELECT max(n) AS top FROM (SELECT n FROM ({_HELD.format(k=0)}) UNION ALL SELECT n FROM ({_HELD.format(k=1)}))), f AS (SELECT fingerprint, min(doc_id) AS first FROM p GROUP BY 1), "
    "k AS (SELECT f.fingerprint, first, b.n AS live, t.n AS dead FROM f LEFT JOIN b USING (fingerprint) LEFT JOIN t USING (fingerprint)), "
    "h AS (SELECT fingerprint, 'R' || coalesce(live, dead) AS handle, CASE WHEN live IS NOT NULL THEN 'live' ELSE 'revived' END AS action FROM k WHERE live IS NOT NULL OR dead IS NOT NULL UNION ALL "
    "SELECT fingerprint, 'R' || (top + row_number() OVER (ORDER BY first)), 'new' FROM k, top WHERE live IS NULL AND dead IS NULL) SELECT doc_id AS seq, fingerprint, handle, action FROM p JOIN h USING (fingerprint)"
)
def blob_revive(spark, sf_dir):
    """Results that are held, that were swept, and new ones."""
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("read_file").alias("tool"), F.col("text").alias("body"))
    held = results.select("seq", F.concat(F.lit("R"), F.col("seq").cast("string")).alias("handle"), ledger.fingerprint(F.col("tool"), F.col("body")).alias("fingerprint"))
    return ledger.put_blobs(results, held.where("seq % 5 = 0"), held.where("seq % 5 = 1"))


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as held bodies, touched at a minute that depends on the id."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("handle"), F.lit("read_file").alias("tool"), F.col("text").alias("body"),
        _minute(F.col("doc_id") % 977).alias("touched_at"),
    )


def _minute(n):
    return F.timestamp_seconds(n * 60).cast("timestamp_ntz")


_BLOBS = "SELECT 'R' || doc_id AS handle, 'read_file' AS tool, text AS body, doc_id, TIMESTAMP '1970-01-01 00:00:00' + to_minutes(doc_id % 977) AS touched_at FROM documents"


@query(f"SELECT handle, tool, length(body) AS chars, touched_at FROM ({_BLOBS})")
def blob_meta(spark, sf_dir):
    return ledger.blob_meta(_blobs(spark, sf_dir))


@query(f"SELECT handle, tool, length(body) AS chars FROM ({_BLOBS}) ORDER BY touched_at DESC, doc_id DESC LIMIT 12")
def live_handles(spark, sf_dir):
    return ledger.live_handles(_blobs(spark, sf_dir))


@query(f"SELECT handle, touched_at FROM ({_BLOBS}) WHERE doc_id % 10 <> 3")
def blob_drop(spark, sf_dir):
    """W15."""
    held = _blobs(spark, sf_dir)
    return ledger.without(held, held.where(F.col("handle").endswith("3")).select("handle")).select("handle", "touched_at")


@query(
    f"SELECT handle, CASE WHEN doc_id % 2 = 0 THEN greatest(touched_at, TIMESTAMP '1970-01-01 00:00:00' + to_minutes(doc_id % 977 + doc_id % 7 - 3)) ELSE touched_at END AS touched_at FROM ({_BLOBS})"
)
def blob_touch(spark, sf_dir):
    """Reading a body keeps it."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    reads = docs.select(F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("handle"), _minute(F.col("doc_id") % 977 + F.col("doc_id") % 7 - 3).alias("ts"))
    return ledger.touch(_blobs(spark, sf_dir), reads).select("handle", "touched_at")


_SWEPT = f"SELECT * FROM ({_BLOBS}) WHERE touched_at < TIMESTAMP '1970-01-01 07:00:00' ORDER BY touched_at DESC, doc_id DESC LIMIT 2000"


@query(f"SELECT handle, tool, length(body) AS chars FROM ({_SWEPT}) WHERE doc_id % 4 = 0")
def tomb_meta(spark, sf_dir):
    """What is left of swept bodies."""
    _, tombs, _ = ledger.sweep(_blobs(spark, sf_dir), F.lit("1970-01-04 07:00:00").cast("timestamp_ntz"))
    asked_for = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("handle"))
    return ledger.tomb_meta(asked_for, tombs).select("handle", "tool", "chars")


@query(
    f"WITH e AS ({_ENTITIES}) SELECT (SELECT count(*) FROM e) AS entities, count(*) AS blobs, coalesce(sum(length(body)), 0)::BIGINT AS held_chars FROM ({_BLOBS}) WHERE touched_at >= TIMESTAMP '1970-01-01 05:00:00'"
)
def ledger_stats(spark, sf_dir):
    since = F.lit("1970-01-01 05:00:00").cast("timestamp_ntz")
    return ledger.ledger_stats(_blobs(spark, sf_dir), ledger.upsert_entities(_sightings(spark, sf_dir)), since)


@query(
    "SELECT left(h, 1) AS kind, max(substr(h, 2)::BIGINT) AS top FROM (SELECT 'F' || c_custkey AS h FROM customer UNION ALL SELECT 'R' || o_orderkey FROM orders UNION ALL SELECT 'F' || s_suppkey * 1000 FROM supplier) GROUP BY 1"
)
def high_water(spark, sf_dir):
    """A19, U5 over three tables with handles."""

    def made(name: str, letter: str, number) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(letter), number.cast("string")).alias("handle"))

    return ledger.high_water(made("customer", "F", F.col("c_custkey")), made("orders", "R", F.col("o_orderkey")), made("supplier", "F", F.col("s_suppkey") * 1000))


@query(
    "WITH b AS (SELECT DISTINCT 'R' || user_id AS handle FROM events WHERE event_type = 'purchase'), a AS (SELECT i % 3 AS conv_id, 'R' || i AS handle, i FROM range(0, 400) r(i)) "
    "SELECT a.conv_id, a.handle, CASE WHEN a.i % 2 = 0 AND b.handle IS NOT NULL THEN 'live' ELSE 'missing' END AS status FROM a LEFT JOIN b USING (handle)"
)
def handle_grants(spark, sf_dir):
    """P10: a conversation sees what it was granted."""
    touched = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("handle")).distinct()
    wanted = spark.range(400).select((F.col("id") % 3).alias("conv_id"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("handle"), "id")
    swept = spark.createDataFrame([], "kind string, mark long")
    granted = wanted.where("id % 2 = 0").select("conv_id", "handle")
    return ledger.handle_status(wanted.select("conv_id", "handle"), touched, swept, touched.limit(0), granted).select("conv_id", "handle", "status")


@query(
    f"WITH e AS (SELECT *, 'E' || (row_number() OVER (ORDER BY kind, ident)) AS handle FROM ({_ENTITIES})), h AS (SELECT * FROM e ORDER BY hot DESC, last_seen DESC, kind, ident LIMIT 12) "
    "SELECT handle, kind, ident, row_number() OVER (ORDER BY substr(handle, 2)::BIGINT) AS pos FROM h"
)
def entity_catalogue(spark, sf_dir):
    """K9: the hottest entities in the order of their handles."""
    known = ledger.upsert_entities(_sightings(spark, sf_dir))
    named = ledger.allocate(known, F.lit("E"), [F.col("kind"), F.col("ident")])
    shown = ledger.hot_entities(named).select("handle", "kind", "ident")
    return shown.withColumn("pos", F.row_number().over(Window.orderBy(ledger.handle_number(F.col("handle")))))  # of twelve rows


# ---------------------------------------------------------------- guards


@query("SELECT name FROM (SELECT l || n AS name FROM (SELECT unnest(['P', 'Q', 'W', 'Z']) AS l), range(1, 401) r(n)) WHERE length(name) <= 2")
def alias_pool(spark, sf_dir):
    """K12 with the length as the cost."""
    return spark.createDataFrame([(n,) for n in guard.alias_pool()], "name string")


@query(
    "SELECT page_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '\\b[A-Z][0-9]{1,3}\\b'), lambda x: x <> 'P1'))), ',') AS names FROM pages"
)
def undefined_aliases(spark, sf_dir):
    """U7."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array_join(guard.undefined_aliases(F.col("html"), ["P1"]), ",").alias("names"))


@query(
    f"WITH m AS ({_MESSAGES}), s AS (SELECT *, n - 100 - length(chr(10) || '(cut here; ' || (n - 100) || ' more characters; narrow the request to see them)') AS saved FROM m WHERE role = 'tool' AND n > 200 AND back > 2), "
    "b AS (SELECT *, coalesce(sum(saved) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE saved > 0), c AS (SELECT conv_id, turn, true AS cut FROM b WHERE before < 600) "
    "SELECT m.conv_id, m.turn, md5(CASE WHEN cut IS NULL THEN content ELSE left(content, 100) || chr(10) || '(cut here; ' || (n - 100) || ' more characters; narrow the request to see them)' END) AS digest FROM m LEFT JOIN c USING (conv_id, turn)"
)
def trimmed_messages(spark, sf_dir):
    return guard.trimmed(_messages(spark, sf_dir), 600, 100).select("conv_id", "turn", F.md5("content").alias("digest"))


@query(
    f"WITH m AS ({_MESSAGES}), l AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total FROM m WHERE role = 'tool' AND name = 'fold_peek'), u AS (SELECT *, n - 120 AS saved FROM l WHERE back > 1 AND n > 120), "
    "b AS (SELECT *, coalesce(sum(saved) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u), c AS (SELECT conv_id, turn, true AS gone FROM b WHERE total - before > 300) "
    "SELECT m.conv_id, m.turn, md5(CASE WHEN gone IS NULL THEN content ELSE '[shown before] ' || left(content, 105) END) AS digest FROM m LEFT JOIN c USING (conv_id, turn)"
)
def evicted_messages(spark, sf_dir):
    return guard.evicted(_messages(spark, sf_dir), 300, 1).select("conv_id", "turn", F.md5("content").alias("digest"))


# ---------------------------------------------------------------- state of the store


def _fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the history of one fact for each user: written, rewritten, trusted, moved, now and then forgotten."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    op = (
        F.when(F.col("n") == 1, "insert").when(kind == "view", "trust").when(kind == "signup", "move")
        .when((kind == "error") & (F.col("event_id") % 29 == 0), "forget").otherwise("update")
    )
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).withColumn("op", op)
    written = F.col("op").isin("insert", "update")
    return rows.select(
        F.col("event_id").alias("event"), F.col("user_id").alias("id"), "op",
        F.when(written, F.concat(kind, F.lit(" of item "), number)).alias("fact"), F.when(written, "decision").alias("category"),
        F.when(written & (F.col("event_id") % 3 == 0), F.concat(F.lit("context "), number)).alias("context"),
        F.when(written & (F.col("event_id") % 2 == 0), F.concat(F.lit("cue"), number)).alias("cues"),
        F.when(F.col("op") == "move", F.concat(F.lit("Facts/F"), number)).alias("folder"),
        F.when(written, "model/main/d0").alias("lineage"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("op") == "update", kind == "error").alias("reset"), F.lit(None).cast("string").alias("grafted"),
    )


@query(
    "WITH e AS (SELECT event_id AS event, user_id AS id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), "
    "o AS (SELECT *, CASE WHEN n = 1 THEN 'insert' WHEN kind = 'view' THEN 'trust' WHEN kind = 'signup' THEN 'move' WHEN kind = 'error' AND event % 29 = 0 THEN 'forget' ELSE 'update' END AS op FROM e), "
    "w AS (SELECT *, op IN ('insert', 'update') AS written, op = 'update' AND kind = 'error' AS reset FROM o) "
    "SELECT id, arg_max(kind || ' of item ' || event, event) FILTER (written) AS fact, arg_max('context ' || event, event) FILTER (written AND event % 3 = 0) AS context, "
    "coalesce(arg_max(CASE WHEN event % 2 = 0 THEN 'cue' || event ELSE '' END, event) FILTER (written AND (event % 2 = 0 OR reset)), '') AS cues, "
    "coalesce(arg_max('Facts/F' || event, event) FILTER (op = 'move'), 'Decisions') AS folder, "
    "CASE WHEN arg_max(op, event) FILTER (written OR op = 'trust') = 'trust' THEN 'user/hand/hand' ELSE 'model/main/d0' END AS lineage FROM w GROUP BY id HAVING arg_max(op, event) <> 'forget'"
)
def fact_state(spark, sf_dir):
    """Trust and moves leave the text alone; a reset clears cues."""
    turns = turn_events(spark, sf_dir).limit(0)
    return current_facts(_fact_events(spark, sf_dir), turns).select("id", "fact", "context", "cues", "folder", "lineage")


# ---------------------------------------------------------------- scalars

_GAPS = {
    "REFERENT": "Note: it never names its subject; name whom or what it is about.",
    "CUES": "Note: it carries almost nothing to search on; add words a question would use.",
}


@query(
    f"WITH s AS (SELECT conv_id, turn, text, {_bare('trim(text)')} AS w FROM conversations) SELECT conv_id, turn, CASE WHEN list_contains({_list(V.PRONOUNS)}, coalesce(w[1], '')) OR "
    f"(list_contains({_list(V.DEMONSTRATIVES)}, coalesce(w[1], '')) AND (w[2] IS NULL OR list_contains({_list(V.COPULAS)}, w[2]))) THEN '{_GAPS['REFERENT']}' "
    f"WHEN len({_tok('text')}) < 2 THEN '{_GAPS['CUES']}' ELSE '' END AS note FROM s"
)
def cue_note(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cue_note(F.col("text")).alias("note"))


@query(
    "SELECT p_partkey AS id, array_to_string(list_filter(list_transform(string_split(replace(' Facts ' || chr(92) || p_name || ' /' || p_brand || '//' || p_type, chr(92), '/'), '/'), lambda p: substr(trim(p), 1, 40)), lambda p: p <> '')[1:3], '/') AS folder FROM part"
)
def clean_folder(spark, sf_dir):
    raw = F.concat(F.lit(" Facts \\"), "p_name", F.lit(" /"), "p_brand", F.lit("//"), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.clean_folder(raw).alias("folder"))


@query(
    "SELECT o_orderkey AS id, rtrim(rtrim(printf('%.6f', o_totalprice), '0'), '.') AS shown, regexp_full_match(left(o_orderpriority, 1) || o_orderkey, '[A-Z][0-9]+') AS handle, "
    "(epoch(TIMESTAMP '2030-01-01 00:00:00') - epoch(o_orderdate))::BIGINT AS age FROM orders"
)
def number_text(spark, sf_dir):
    """T19, T20, T24."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    age = T.age_seconds(stamp, F.lit("2030-01-01 00:00:00").cast("timestamp"))
    handle = T.is_handle(F.concat(F.left("o_orderpriority", F.lit(1)), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.number_text(F.col("o_totalprice")).alias("shown"), handle.alias("handle"), age.alias("age"))


def _path_sql(n: str) -> str:
    return f"(['user', 'machine', 'model', ''])[({n} % 4)::INT + 1] || '/b' || ({n} % 3) || '/d' || ({n} % 2)"


@query(
    f"WITH e AS (SELECT event_id, user_id, string_split({_path_sql('event_id')}, '/') AS a, string_split({_path_sql('user_id')}, '/') AS b FROM events) "
    "SELECT event_id AS id, CASE WHEN a[1] = '' OR b[1] = '' THEN '' WHEN a = b THEN 'stem' WHEN a[1] = b[1] AND a[2] = b[2] THEN 'branch' WHEN a[1] = b[1] THEN 'tree' ELSE 'grove' END AS kin, "
    "CASE WHEN a[1] <> '' AND (event_id % 3 <> 0 OR user_id % 2 <> 0) THEN 'user:2:1;' || a[1] || ':' || event_id % 3 || ':' || user_id % 2 ELSE 'user:2:1' END AS grafted FROM e"
)
def lineage_algebra(spark, sf_dir):
    """T23."""

    def path(column: str):
        c = F.col(column)
        tree = F.element_at(F.array(*[F.lit(t) for t in ("user", "machine", "model", "")]), (c % 4 + 1).cast("int"))
        return F.concat(tree, F.lit("/b"), (c % 3).cast("string"), F.lit("/d"), (c % 2).cast("string"))

    new, old = path("event_id"), path("user_id")
    record = grading.graft_record(F.lit("user:2:1"), F.get(F.split(new, "/"), F.lit(0)), F.col("event_id") % 3, F.col("user_id") % 2)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.kin(new, old).alias("kin"), record.alias("grafted"))
