"""Nearest vectors: every pair compared, ties, nulls and NaN as in a sort, and no row for each pair in a plan."""

import random

from pyspark.sql import functions as F

from millrace.sources.store import cosine_backend


def _plain(stored, asked, limit):
    def sim(a, b):
        if a is None or b is None or None in (*a, *b) or len(a) != len(b):
            return None
        unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
        return sum(x * y for x, y in zip(unit(a), unit(b), strict=True))

    out = []
    for q, a in asked:
        scored = [(i, sim(a, b)) for i, b in stored]
        scored = sorted(((i, None if s is None else round(s, 6)) for i, s in scored), key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
        out += [(q, k + 1, i, s) for k, (i, s) in enumerate(scored[:limit])]
    return sorted(out)


def test_every_pair_counts_and_none_is_a_row(spark):
    rng = random.Random(3)
    vector = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    same, near = vector(8), vector(8)
    stored = [(i, same if i % 5 == 0 else [x + i * 1e-9 for x in near] if i % 5 == 1 else vector(8)) for i in range(600)]
    stored += [(600, None), (601, vector(3)), (602, [1.0, None]), (603, vector(3))]
    asked = [(i, v) for i, v in stored if i % 50 == 0 or i > 599]
    rows = spark.createDataFrame(stored, "id long, v array<double>").repartition(3)
    wanted = spark.createDataFrame(asked, "query_id long, v array<double>")
    for limit, block in ((5, 32 << 20), (5, 600), (700, 32 << 20)):
        found = cosine_backend(rows, wanted, limit, block)
        assert sorted(map(tuple, found.collect())) == _plain(stored, asked, limit)
    assert "NestedLoop" not in cosine_backend(rows, wanted, 5)._jdf.queryExecution().toString()
    assert cosine_backend(rows, wanted.limit(0), 5).count() == 0 and cosine_backend(rows.limit(0), wanted, 5).count() == 0


def test_vectors_without_direction_and_names_as_ids(spark):
    stored = spark.createDataFrame([("b", [0.0, 0.0]), ("a", [1.0, 1.0]), ("c", [2.0, 2.0])], "id string, v array<float>")
    asked = stored.where("id = 'a'").select(F.col("id").alias("query_id"), "v")
    got = [(r.mem_id, str(r.sim)) for r in cosine_backend(stored, asked, 3).orderBy("pos").collect()]
    assert got == [("b", "nan"), ("a", "1.0"), ("c", "1.0")]  # DuckDB gives NaN too, and sorts it first
