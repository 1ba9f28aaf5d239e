"""Counters given by a caller, and the read-back functions by their SQL names."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import counters, surface
from millrace.functions import text as T
from millrace.operators import fold, guard
from millrace.tools import Registry

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def held(spark):
    texts = [
        "alpha\nBeta error\r\ngamma Error\n", "", None, "\n\n", "one line without an end",
        "\n".join(f"error {k} " + "x" * 400 for k in range(60)), "a b\x0berror\x85", "e" * 9000 + "\nerror",
    ]
    surface.register(spark)
    return spark.createDataFrame(list(enumerate(texts)), "handle long, body string")


def test_lines_are_the_operator_s(spark, held):
    got = spark.sql("SELECT handle, fold_lines(body) AS a FROM {held}", held=held).join(held.select("handle", T.lines_of(F.col("body")).alias("b")), "handle")
    assert got.where("NOT a <=> b").count() == 0 and got.where("a IS NULL").count() == 1


@pytest.mark.parametrize("pattern", ["error", "^$|e{3}", "no such line"])
def test_grep_is_the_operator_s(spark, held, pattern):
    text = "SELECT handle, h.line_no, h.line FROM (SELECT handle, fold_grep(body, :p, 7) AS hits FROM {held}) LATERAL VIEW inline(hits) h AS line_no, line"
    got = spark.sql(text, {"p": pattern}, held=held).collect()
    want = fold.grep(held, pattern, 7).select("handle", "line_no", "line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("start, count", [(1, 60), (2, 3), (0, 0), (50, 1000), (99, 1)])
def test_peek_is_the_operator_s(spark, held, start, count):
    text = f"SELECT handle, h.line_no, h.line FROM (SELECT handle, fold_peek(body, {start}, {count}) AS hits FROM {{held}}) LATERAL VIEW inline(hits) h AS line_no, line"
    want = fold.peek(held, start, count).select("handle", "line_no", "line").collect()
    assert sorted(map(tuple, spark.sql(text, held=held).collect())) == sorted(map(tuple, want))


def test_cells_and_tokens_are_the_operator_s(spark):
    surface.register(spark)
    lines = spark.createDataFrame([("a;b;;c",), ('a;"b;""c""";d',), ("",), (None,), ("The GPU driver, the gpu box 12 345",)], "line string")
    got = spark.sql("SELECT line, fold_cells(line, ';') AS c, fact_tokens(line) AS t FROM {lines}", lines=lines)
    wrong = got.where(~F.col("c").eqNullSafe(fold.cells(F.col("line"), F.lit(";"))) | ~F.col("t").eqNullSafe(T.tokens(F.col("line"))))
    assert wrong.count() == 0


def test_sql_names_are_one_scan(spark, held):
    found = spark.sql("SELECT handle, h.* FROM (SELECT handle, fold_grep(body, 'error') AS hits FROM {held}) LATERAL VIEW inline(hits) h AS line_no, line", held=held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_counters_agree_and_keep_nulls(spark):
    texts = spark.createDataFrame([("ab12, c",), ("",), (None,), ("é 中\t!",)], "t string")
    native, python = counters.pieces(F.col("t")), counters.counted(lambda t: len(__import__("re").findall(counters.PIECE, t)))(F.col("t"))
    assert [tuple(r) for r in texts.select(native, python).collect()] == [(4, 4), (0, 0), (None, None), (3, 3)]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_token_counter_decides_the_format(spark):
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(VOCABULARY)
    count = lambda t: len(vocabulary.encode(t, add_special_tokens=False).ids)
    rows = spark.createDataFrame([(k, f"name {k}") for k in range(12)], "n int, s string").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("rows"))
    every = rows.select(fold.encodings(F.col("rows"), ["n", "s"], counters.tokens(VOCABULARY)).alias("e")).first().e
    assert len(every) == 5 and all(e.cost == count(e.text) for e in every)
    best = rows.select(fold.choose_format(F.col("rows"), ["n", "s"], counters.tokens(VOCABULARY)).alias("c")).first().c
    assert best.cost == min(e.cost for e in every) or best.format == "json"


def test_fold_weighs_its_sample(spark):
    body = "[" + ",".join('{"id":%d,"name":"part %d of the list, long enough to fold"}' % (k, k) for k in range(60)) + "]"
    results = spark.createDataFrame([(1, "t", body)], "seq long, tool string, body string")
    # a counter to which every text costs the same leaves the sample as JSON
    flat = fold.fold(results, cost=counters.counted(lambda t: 7)).first()
    short = fold.fold(results).first()
    assert flat.folded and "(json)" in flat.text and short.folded and "(json)" not in short.text


def test_trimming_counts_in_the_caller_s_units(spark):
    texts = ["word " * 300, "x" * 1500, "word " * 300, "a", "b"]
    messages = spark.createDataFrame([(1, k, "tool", "t", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, name string, content string")
    # the second message is one piece: its cut text, with a note, costs more, so it stays
    assert [r.turn for r in guard.trim_messages(messages, 10_000, cost=counters.pieces).orderBy("turn").collect()] == [0, 2]
    assert [r.turn for r in guard.trim_messages(messages, 10, cost=counters.pieces).collect()] == [0]
    assert [r.turn for r in guard.trim_messages(messages, 10_000).orderBy("turn").collect()] == [0, 1, 2]


def test_switched_off_is_not_unknown():
    registry = Registry()
    registry.tool("look")(lambda what="": f"saw {what}")
    registry.tool("inner", internal=True)(lambda: "x")
    seen = []
    registry.guard = lambda tool, arguments: seen.append(arguments)
    assert registry.dispatch("look", {"what": "it", "_raw": "{"}) == "saw it" and seen == [{"what": "it"}]
    registry.enabled = lambda name: False
    assert "no tool" in registry.dispatch("nothing", {})
    assert "turn it on" in registry.dispatch("look", {}) and "without it" in registry.dispatch("inner", {})
