"""The read-back functions by name in SQL.

``register`` declares them as temporary SQL functions of a session. Spark puts
their expressions in the place of the call, so a query over them is one scan with
no Python and no join::

    SELECT handle, hit.* FROM (SELECT handle, fold_grep(body, 'error') AS hits FROM bodies)
    LATERAL VIEW inline(hits) hit AS line_no, line

They give arrays, because a table function that is correlated by a body becomes a
join of the table with itself by the whole body. Their results are those of the
operators of the same name in ``operators.fold``; a null text gives null, except
for ``fact_tokens``, where it has no tokens. Patterns are not checked first.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.functions import vocab as V

_HIT = "ARRAY<STRUCT<line_no: INT, line: STRING>>"


def _text(value: str) -> str:
    """A raw SQL literal. The texts given here hold no single quote."""
    return f"r'{value}'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _within(cost: str) -> str:
    """The leading entries of ``h`` whose costs (of ``x``) together stay within the characters of one reading."""
    used = f"a.used + {cost}"
    step = f"named_struct('used', {used}, 'n', a.n + IF({used} <= {V.READ_CHARS}, 1, 0))"
    return f"slice(h, 1, aggregate(h, named_struct('used', 0, 'n', 0), (a, x) -> {step}, a -> a.n))"


_NUMBERED = "transform(fold_lines(body), (x, i) -> named_struct('line_no', i + 1, 'line', x))"
_CLIPPED = f"IF(length(x.line) > {V.GREP_CLIP}, concat(left(x.line, {V.GREP_CLIP}), '... [+', length(x.line) - {V.GREP_CLIP}, ' chars]'), x.line)"
_MATCHING = f"slice(filter({_NUMBERED}, x -> x.line RLIKE concat('(?i)', pattern)), 1, least(greatest(most, 1), {V.GREP_MAX}))"
_ASKED = f"slice({_NUMBERED}, greatest(start, 1), least(greatest(count, 1), {V.PEEK_MAX}))"
_OUTSIDE_QUOTES = r'\E(?=(?:[^"]*"[^"]*")*[^"]*$)'
_UNQUOTED = "IF(c RLIKE '^\".*\"$', replace(substring(c, 2, length(c) - 2), '\"\"', '\"'), c)"

#: Name, parameters, type and expression of each function, in the order in which they need each other.
FUNCTIONS = (
    (
        "fold_lines", "body STRING", "ARRAY<STRING>",
        _let(f"split(body, {_text(V.LINE_BREAK)}, -1)", "c", "IF(element_at(c, -1) = '', slice(c, 1, size(c) - 1), c)"),
    ),
    (
        "fold_grep", f"body STRING, pattern STRING, most INT DEFAULT {V.GREP_HITS}", _HIT,
        _let(f"transform({_MATCHING}, x -> named_struct('line_no', x.line_no, 'line', {_CLIPPED}))", "h", _within("length(concat(x.line_no, ': ', x.line)) + 1")),
    ),
    ("fold_peek", f"body STRING, start INT DEFAULT 1, count INT DEFAULT {V.PEEK_LINES}", _HIT, _let(_ASKED, "h", _within("length(x.line) + 1"))),
    (
        "fold_cells", "line STRING, delimiter STRING", "ARRAY<STRING>",
        f"IF(contains(line, '\"'), transform(split(line, concat({_text(chr(92) + 'Q')}, delimiter, {_text(_OUTSIDE_QUOTES)}), -1), c -> {_UNQUOTED}), "
        f"split(line, concat({_text(chr(92) + 'Q')}, delimiter, {_text(chr(92) + 'E')}), -1))",
    ),
    (
        "fact_tokens", "fact STRING", "ARRAY<STRING>",
        "coalesce(array_distinct(filter(regexp_extract_all(lower(fact), '[a-z0-9]+', 0), w -> length(w) > 2 AND w NOT IN ("
        + ", ".join(f"'{w}'" for w in V.STOP)
        + "))), CAST(array() AS ARRAY<STRING>))",
    ),
)


def register(spark: SparkSession) -> None:
    """Declare the functions in the session, in the place of earlier ones of the same name."""
    for name, parameters, kind, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
