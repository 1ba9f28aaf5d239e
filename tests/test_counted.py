"""Keyword ranks counted within the rows of a task: as the joins count them, and without a row for each query and fact."""

import random

from pyspark.sql import functions as F

from millrace.functions import counted
from millrace.operators import recall


def test_counts_within_rows_are_those_of_the_joins(spark, monkeypatch):
    monkeypatch.setattr(counted, "_CELLS", 60)
    rng = random.Random(5)
    words = ["the", "of", *(f"word{i}" for i in range(30))]
    say = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    rows = [(i, None if i % 17 == 0 else say(12), None if i % 13 == 0 else say(6)) for i in range(400)]
    facts = spark.createDataFrame(rows, "id long, fact string, cues string").repartition(3)
    asked = spark.createDataFrame([(q, say(8)) for q in range(15)] + [(50, "the"), (51, None), (52, "unheard")], "query_id long, text string")
    for known in (facts, facts.drop("cues")):
        found = recall.keyword_rank(asked, known, 5)
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "Aggregate" not in plan
        got = sorted(map(tuple, found.collect()))
        monkeypatch.setattr(recall, "_best_by_row", lambda *_: None)
        assert got == sorted(map(tuple, recall.keyword_rank(asked, known, 5).collect()))
        monkeypatch.undo()


def test_repeated_and_null_ids_are_summed_as_before(spark):
    facts = spark.createDataFrame([(1, "red apple"), (1, "red pear"), (None, "red"), (2, "red apple pie")], "id long, fact string")
    asked = spark.createDataFrame([(7, "red apple")], "query_id long, text string")
    got = [(r.id, r.overlap) for r in recall.keyword_rank(asked, facts, 9).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 2), (None, 1)]
    assert recall.keyword_rank(asked.limit(0), facts.where("id = 2"), 9).count() == 0
    assert recall.keyword_rank(asked, facts.where("id = 2").limit(0), 9).count() == 0
    assert recall.keyword_rank(asked.select(F.col("query_id").cast("int").alias("query_id"), "text"), facts, 9).count() == 3
