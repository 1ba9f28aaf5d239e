from millrace.llm.lines import _line_table, drop_repeated_lines


def test_repeated_rows_are_one_document(spark):
    text = "one two three four five six\nother words in this second line\none two three four five six"
    rows = [(7, text)] * 40 + [(None, text)] * 40 + [(8, "a single row of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _line_table(df, "doc_id", "text", 6).count() == 3 + 3 + 1
    found = drop_repeated_lines(df).groupBy("doc_id", "removed_lines").count().collect()
    got = {(r[0], tuple(r[1])): r[2] for r in found}
    assert got == {(7, (2,)): 40, (None, (0, 1, 2)): 40, (8, ()): 1}
