import time


from pyspark.sql import functions as F

from millrace.sources.store import Store, cosine_backend
from millrace.streaming import runs


def test_store_round_trip_and_unreadable_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [(1, "insert", 1, "uses git daily"), (2, "update", 1, "uses git hourly"), (3, "insert", 2, "likes tea"), (4, "forget", 2, None)]
    events = spark.createDataFrame(rows, "event long, op string, id long, fact string").withColumn("category", F.lit("fact"))
    store.append("fact_events", events)
    got = store.facts().collect()
    assert [(r.id, r.fact, r.folder, r.uses) for r in got] == [(1, "uses git hourly", "Facts/Development", 0)]
    assert store.counts().first().facts == 1
    broken = tmp_path / "store" / "blobs"
    broken.mkdir(parents=True)
    (broken / "x.parquet").write_bytes(b"no parquet at all")
    assert store.readable("blobs").count() == 0
    assert [p.name for p in (tmp_path / "store").iterdir() if "unreadable" in p.name]


def test_cosine_backend(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, v array<double>")
    got = cosine_backend(vectors, vectors.where("id = 1").select(F.col("id").alias("query_id"), "v"), 2).orderBy("pos").collect()
    assert [(r.mem_id, r.sim) for r in got] == [(1, 1.0), (2, 0.6)]


def test_run_marks_stream(spark, tmp_path):
    rows = [("a", "served", 1, None), ("a", "planted", 2, None), ("b", "served", 3, None), ("a", "end", None, "ok"), ("b", "end", None, "stopped")]
    schema = "run_id string, kind string, fact_id long, outcome string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = runs.graded_marks(stream).writeStream.format("memory").queryName("marks").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    # timers by processing time keep the query busy, so it is stopped once the rows are there
    end = time.time() + 100
    while time.time() < end and spark.table("marks").count() < 2:
        time.sleep(1)
    query.stop()
    got = {tuple(r) for r in spark.sql("SELECT run_id, kind, fact_id, outcome FROM marks").collect()}
    assert got == {("a", "served", 1, "ok"), ("a", "planted", 2, "ok")}


def test_windowed_activity_is_a_stream(spark, tmp_path):
    spark.range(3).select(F.timestamp_seconds(F.col("id") * 90000).alias("ts"), F.lit("x").alias("event_type")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    query = runs.windowed_activity(stream).writeStream.format("memory").queryName("act").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM act").first()[0] == 3


def test_sweeps_survive_restarts_and_replays(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/sweeps")
    episodes = lambda a, b: spark.range(a, b).select("id", F.lit("asked").alias("request"), F.lit("ok").alias("outcome"))
    calls = []
    for rows in (episodes(0, 3), episodes(0, 3), episodes(3, 6), episodes(6, 8)):
        runs.consolidate_every(store, 5, lambda s: calls.append(s.table("episodes").count()))(rows, 0)  # a new function each time: a restart
    assert calls == [6] and store.table("episodes").count() == 8


def test_streams_of_tallies_bodies_and_elaborations(spark, tmp_path):
    stamp = F.timestamp_seconds(F.col("t"))
    marks = spark.createDataFrame([("r1", "served", 1, "ok"), ("r2", "served", 1, "failed"), ("r2", "planted", 2, "failed")], "run_id string, kind string, fact_id long, outcome string")
    marks.write.parquet(f"{tmp_path}/marks")
    bodies = spark.createDataFrame([("t", "a", 10), ("t", "a", 20), ("t", "b", 30)], "tool string, body string, t long").withColumn("ts", stamp)
    bodies.drop("t").write.parquet(f"{tmp_path}/bodies")
    facts = [(1, "This is deploys", 100), (2, "The nightly deploys use docker images", 1000), (3, "The weekly deploys use docker images", 9000)]
    said = spark.createDataFrame(facts, "id long, fact string, t long").withColumn("created_at", stamp).drop("t")
    said.write.parquet(f"{tmp_path}/facts")

    def collected(name, made, mode):
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
        query = made(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
        query.processAllAvailable()
        query.stop()
        return [tuple(r) for r in spark.table(name).collect()]

    assert collected("marks", runs.running_tallies, "complete") == [(1, 2, 1)]
    assert sorted(r[1] for r in collected("bodies", runs.distinct_bodies, "append")) == ["a", "b"]
    assert collected("facts", runs.recent_elaborations, "append") == [(2, 1)]
