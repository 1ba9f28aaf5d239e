import random

from pyspark.sql import functions as F

from millrace.operators import tasks


def test_frequent_words_late_in_many_sets_meet_none(spark):
    rows = [(k, [f"client{k}", f"site{k}", "invoice", "reports"], 4) for k in range(60)]
    keys = tasks.request_keys(spark.createDataFrame(rows, "id long, words array<string>, n int"))
    both = keys.alias("a").join(keys.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.own") == F.col("b.wanted")) & (F.col("a.wanted") == F.col("b.own")) & (F.col("a.id") < F.col("b.id")))
    assert both.count() == 0


def test_keys_by_size_lose_no_pair(spark):
    random.seed(5)
    words = [f"word{k}" for k in range(30)]
    sets = {k: set(random.sample(words, random.randint(2, 26))) for k in range(150)}
    expect = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    episodes = spark.createDataFrame([(k, " ".join(w)) for k, w in sets.items()], "id long, request string")
    assert {(r.a, r.b) for r in tasks.similar_requests(episodes).collect()} == expect and len(expect) > 50
