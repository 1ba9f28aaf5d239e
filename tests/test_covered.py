import random

from pyspark.sql import functions as F

from millrace.operators import tasks


def test_marks_lose_no_pair_and_prune_within_the_join(spark):
    random.seed(3)
    words = [f"word{k}" for k in range(60)]
    requests = [(k, set(random.sample(words, random.randint(0, 30)))) for k in range(80)]
    patterns = [(k, set(random.sample(words, random.randint(1, 8)))) for k in range(80)]
    expect = {(q, p, round(len(a & b) / len(b), 6)) for q, a in requests for p, b in patterns if len(a & b) / len(b) >= 0.6}
    asked = spark.createDataFrame([(q, " ".join(sorted(a))) for q, a in requests], "query_id long, text string")
    known = spark.createDataFrame([(p, " ".join(sorted(b))) for p, b in patterns], "id long, key string")
    got = [(r.query_id, r.id, round(r.covered, 6)) for r in tasks.coverage(asked, known).collect()]
    assert set(got) == expect and len(got) == len(expect) > 100


def test_marks_hold_every_word(spark):
    rows = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.col("id")), lambda k: F.xxhash64(k)).alias("w"))
    lost = rows.select(F.size(F.filter("w", lambda w: ~tasks.marked(tasks.word_marks(F.col("w")), w))).alias("n"), F.array(F.xxhash64(F.lit("a"))).alias("other"))
    assert lost.where("n > 0").count() == 0
    one = rows.limit(1).select(tasks.marked(tasks.word_marks(F.array(F.lit(8).cast("long"))), F.lit(16).cast("long")).alias("m"))
    assert not one.first().m
