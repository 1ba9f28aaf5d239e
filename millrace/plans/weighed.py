"""Registered queries with a caller's counter, and through the functions' SQL names, with their DuckDB equivalents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.functions import counters, surface
from millrace.functions import vocab as V
from millrace.operators import fold, guard
from millrace.plans.catalogue import _CANDIDATES, _CLIP, _LINES, _MESSAGES, _messages, bodies, csv_bodies, query, table
from millrace.plans.holdings import _KINDS, _TABLE

_PIECE = re.compile(counters.PIECE)


def _count(text: str) -> int:
    return len(_PIECE.findall(text))


def _pieces(text: str) -> str:
    """DuckDB's count of the pieces of an expression."""
    return f"len(regexp_extract_all({text}, '{counters.PIECE}'))"


# ---------------------------------------------------------------- counters

_WEIGHED = " UNION ALL ".join(
    f"SELECT handle, {k} AS k, '{name}' AS format, {_pieces(text)} AS cost FROM ({_TABLE.format(row=row, by=by)})" for k, (name, text, row, by) in enumerate(_KINDS)
)


@query(
    f"WITH e AS ({_WEIGHED}), b AS (SELECT handle, min(cost) AS least, min(cost) FILTER (k = 0) AS json FROM e GROUP BY 1), p AS (SELECT e.*, row_number() OVER (PARTITION BY handle ORDER BY cost, k) AS rk FROM e) "
    "SELECT b.handle, CASE WHEN least <= json * 0.92::DOUBLE THEN p.format ELSE 'json' END AS format, CASE WHEN least <= json * 0.92::DOUBLE THEN least ELSE json END AS cost FROM b JOIN p ON p.handle = b.handle AND p.rk = 1"
)
def format_by_pieces(spark, sf_dir):
    """The cheapest format by a Python counter, in Arrow batches."""
    rows = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 40").alias("handle")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("rows"))
    best = fold.choose_format(F.col("rows"), ["p_partkey", "p_name", "p_size"], counters.counted(_count))
    return rows.withColumn("best", best).select("handle", "best.format", F.col("best.cost").alias("cost"))


@query(
    f"WITH c AS (SELECT *, {_pieces('raw')} AS units FROM ({_CANDIDATES}) WHERE length(raw) >= 24), s AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY id, pos) AS k FROM c) "
    "SELECT raw, 'P' || row_number() OVER (ORDER BY id, pos, raw) AS alias, id AS second_id, pos AS second_pos, "
    f"greatest(0, units - 2 - floor((units + 2 + 2) * {V.LEGEND_SHARE}::DOUBLE))::BIGINT AS saved FROM s WHERE k = 2 AND units - 2 > 4 ORDER BY id, pos, raw LIMIT 60"
)
def alias_by_pieces(spark, sf_dir):
    """The book of aliases, strings weighed by a Python counter."""
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat_ws(" ", "url", "url").alias("text"))
    return guard.codebook(urls, [f"P{k}" for k in range(1, V.ALIAS_ENTRIES + 1)], counters.counted(_count), _count)


_CUT_TEXT = "left(content, 100) || chr(10) || '(cut here; ' || (n - 100) || ' more characters; narrow the request to see them)'"


@query(
    f"WITH m AS ({_MESSAGES}), s AS (SELECT *, {_pieces('content')} - {_pieces(_CUT_TEXT)} AS saved FROM m WHERE role = 'tool' AND n > 200 AND back > 2), "
    "b AS (SELECT *, coalesce(sum(saved) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE saved > 0) SELECT conv_id, turn, saved FROM b WHERE before < 60"
)
def trim_by_pieces(spark, sf_dir):
    """Messages cut until enough units are saved, by the built-in counter."""
    return guard.trim_messages(_messages(spark, sf_dir), 60, 100, cost=counters.pieces)


# ---------------------------------------------------------------- SQL names


@query(
    f"WITH h AS (SELECT handle, line_no, {_CLIP.format(n=300)} AS line FROM ({_LINES}) WHERE regexp_matches(line, 'licen[sc]e|@', 'i')), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY line_no) AS k, "
    "sum(length(line_no || ': ' || line) + 1) OVER (PARTITION BY handle ORDER BY line_no) AS spent FROM h) SELECT handle, line_no, line FROM w WHERE k <= 40 AND spent <= 8000"
)
def sql_grep(spark, sf_dir):
    """A search by its SQL name."""
    surface.register(spark)
    return spark.sql(
        "SELECT handle, hit.line_no, hit.line FROM (SELECT handle, fold_grep(body, 'licen[sc]e|@') AS hits FROM {held}) LATERAL VIEW inline(hits) hit AS line_no, line",
        held=bodies(spark, sf_dir),
    )


@query(
    f"WITH w AS (SELECT handle, line_no, line, sum(length(line) + 1) OVER (PARTITION BY handle ORDER BY line_no) AS spent FROM ({_LINES}) WHERE line_no BETWEEN 2 AND 21) "
    "SELECT handle, line_no, md5(line) AS digest FROM w WHERE spent <= 8000"
)
def sql_peek(spark, sf_dir):
    """A page by its SQL name."""
    surface.register(spark)
    return spark.sql(
        "SELECT handle, hit.line_no, md5(hit.line) AS digest FROM (SELECT handle, fold_peek(body, 2, 20) AS hits FROM {held}) LATERAL VIEW inline(hits) hit AS line_no, line",
        held=bodies(spark, sf_dir),
    )


@query("SELECT l_orderkey // 375 AS handle, l_linestatus AS status, count(*) AS n, sum(l_quantity::INT)::BIGINT AS quantity FROM lineitem GROUP BY ALL")
def sql_cells(spark, sf_dir):
    """Totals over the cells of table bodies in plain SQL."""
    surface.register(spark)
    return spark.sql(
        "WITH l AS (SELECT handle, fold_lines(body) AS lines FROM {held}), r AS (SELECT handle, line FROM l LATERAL VIEW posexplode(lines) x AS k, line WHERE k > 0), "
        "c AS (SELECT handle, fold_cells(line, ';') AS cells FROM r) "
        "SELECT handle, cells[3] AS status, count(*) AS n, sum(CAST(cells[2] AS BIGINT)) AS quantity FROM c GROUP BY handle, cells[3]",
        held=csv_bodies(spark, sf_dir),
    )
