import random

from pyspark.sql import functions as F

from millrace.functions.marks import differing, may_hold, word_marks
from millrace.operators import merge


def test_marks_bound_what_sets_have_alone(spark):
    random.seed(9)
    rows = [(k, random.sample(range(400), random.randint(1, 200)), random.sample(range(400), random.randint(1, 200))) for k in range(60)]
    rows += [(100 + k, a, a + b) for k, a, b in rows[:20]]
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    sets = spark.createDataFrame(rows, "k long, a array<int>, b array<int>")
    marks = sets.select("k", *[word_marks(hashed(F.col(c)), 16).alias(c) for c in "ab"])
    got = {r.k: r for r in marks.select("k", differing(F.col("a"), F.col("b")).alias("d"), may_hold(F.col("a"), F.col("b")).alias("h")).collect()}
    for k, a, b in rows:
        assert got[k].d <= len(set(a) ^ set(b)) and (got[k].h or not set(a) <= set(b))
    assert sum(got[k].h for k, _, _ in rows[:60]) < 6 and all(got[k].h for k, _, _ in rows[60:])


def test_flips_carry_no_text(spark):
    facts = spark.createDataFrame([(1, "green tea is liked daily here"), (2, "green tea is not liked daily here"), (3, "green tea is liked daily here")], "id long, fact string")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "id_new long, id_old long")
    assert {(r.id_new, r.id_old): r.polarity_flip for r in merge.polarity_flips(pairs, facts).collect()} == {(2, 1): True, (3, 1): False, (3, 2): True}
