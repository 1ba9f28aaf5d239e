"""The loops: bodies that are held, read, swept and revived; turns that become episodes, and episodes that become shortcuts."""

import time

from pyspark.sql import functions as F

from millrace.operators import tasks
from millrace.sources.store import Store
from millrace.streaming import holding, runs
from millrace.tools import Session, builtin_tools


def test_bodies_expire_as_state(spark, tmp_path):
    schema = "handle string, kind string, tool string, chars long, ts timestamp"
    day = lambda n: F.timestamp_seconds(F.lit(1_700_000_000 + int(n * 86400)))
    batches = [
        [("R1", "put", 0), ("R2", "put", 0), ("R3", "read", 0)],
        [("R1", "read", 2), ("R2", "put", 2.5), ("R2", "read", 1)],
        [("R1", "put", 4.5), ("R4", "put", 6)],  # R1 was read on day 2, so it is still held
        [("R2", "read", 7), ("R4", "read", 8)],  # R2 was touched on day 2.5
        [("R2", "put", 8), ("R9", "put", 8)],
        [("R9", "put", 8.2)],
    ]
    for rows in batches:
        df = None
        for handle, kind, at in rows:
            one = spark.createDataFrame([(handle, kind, "t", 9)], "handle string, kind string, tool string, chars long").withColumn("ts", day(at))
            df = one if df is None else df.unionByName(one)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = holding.held_stream(stream).writeStream.format("memory").queryName("held").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    by = {}
    for r in spark.table("held").orderBy("ts").collect():
        by.setdefault(r.handle, []).append((r.action, round((r.ts.timestamp() - 1_700_000_000) / 86400, 1)))
    assert sorted(by["R1"]) == sorted([("held", 0), ("touched", 2), ("touched", 4.5), ("swept", 4.5)])
    assert sorted(by["R2"]) == sorted([("held", 0), ("touched", 1), ("touched", 2.5), ("swept", 2.5), ("expired", 7), ("revived", 8)])
    assert by["R3"] == [("missing", 0)] and by["R4"] == [("held", 6), ("touched", 8)]


def test_store_holds_sweeps_and_revives(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    body = lambda word: "\n".join(f"{word} line {k} of a long body" for k in range(100))
    rows = [(1, "scan", body("a")), (2, "scan", body("b")), (3, "scan", body("a")), (4, "scan", "short"), (5, "other", body("a"))]
    results = spark.createDataFrame(rows, "seq long, tool string, body string")
    now = F.current_timestamp()
    ago = lambda days: now - F.expr(f"INTERVAL {days} DAYS")
    first = {r.seq: r.handle for r in store.hold(results, ago(9)).collect()}
    assert first == {1: "R1", 2: "R2", 3: "R1", 4: None, 5: "R3"}
    assert {r.handle for r in store.hold(results.where("seq = 2"), ago(2)).collect()} == {"R2"}  # touched
    store.sweep(now)
    assert [r.handle for r in store.held().collect()] == ["R2"] and store.graves().count() == 2
    tools = builtin_tools(store)
    assert "b line 0" in tools.dispatch("fold_peek", {"handle": "R2"})
    assert "expired" in tools.dispatch("fold_peek", {"handle": "R1"}) and "scan" in tools.dispatch("fold_peek", {"handle": "R1"})
    store.sweep(now + F.expr("INTERVAL 2 DAYS"))  # reading it counts as a touch
    assert [r.handle for r in store.held().collect()] == ["R2"]
    more = results.unionByName(spark.createDataFrame([(6, "scan", body("c"))], "seq long, tool string, body string"))
    again = {r.seq: r.handle for r in store.hold(more, now + F.expr("INTERVAL 1 SECOND")).collect()}
    assert again == {1: "R1", 2: "R2", 3: "R1", 4: None, 5: "R3", 6: "R4"}
    assert "a line 0" in tools.dispatch("fold_peek", {"handle": "R1"})


def test_turns_become_episodes_and_uses(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    tools = builtin_tools(store)
    tools.dispatch("learn_task", {"trigger": "Send the invoice report", "resolution": "use the mailer"})
    Session(store, "run1").finish("ok", "please send that invoice report now", "sent", "mailer")
    Session(store, "run2").finish("failed", "send invoice report", "bounced", "mailer")
    Session(store, "run3").finish("stopped", "send invoice report", "", "")
    known = store.patterns().first()
    assert (known.uses, known.wins) == (3, 2)
    assert [(r.id, r.outcome) for r in store.table("episodes").orderBy("id").collect()] == [(1, "ok"), (2, "failed")]
    said = tools.dispatch("recall_task", {"request": "send the invoice report"})
    assert "use the mailer" in said


def test_sweeps_learn_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [(i, f"2024-01-{1 + i % 3:02d}", "pack the weekly photos archive" if i % 2 else "weekly photos archive pack", f"sent {i}", "zip", "ok") for i in range(6)]
    episodes = spark.createDataFrame(rows, "id long, day string, request string, summary string, tools string, outcome string").withColumn("ts", F.col("day").cast("timestamp")).drop("day")
    step = runs.consolidate_every(store, 5)
    append, calls = store.append, []

    def dies(table, df):
        if table == "sweeps":
            calls.append(table)
            raise RuntimeError("killed before the commit row")
        append(table, df)

    store.append = dies
    try:
        step(episodes, 0)
    except RuntimeError:
        pass
    assert calls and store.patterns().count() == 0 and store.mined().count() == 0  # nothing of the dead sweep counts
    store.append = append
    for _ in range(2):  # the batch again, and once more
        step(episodes, 0)
    known = store.patterns().collect()
    assert [(r.key, r.uses, r.wins, r.taught) for r in known] == [("archive pack photos weekly", 6, 6, False)]
    assert known[0].resolution == "A habit of 6 good runs. Used: zip. It ended with: sent 5"
    assert store.table("sweeps").count() == 1
    builtin_tools(store).dispatch("forget_task", {"trigger": "pack weekly photos archive"})
    more = episodes.withColumn("id", F.col("id") + 10)
    step(more, 1)
    assert store.patterns().count() == 0 and store.table("sweeps").count() == 2  # promoted once, forgotten, not promoted again
    assert tasks.consolidate(store, "sweep-15") == 0
