from pyspark.sql import functions as F

from millrace.operators import fold, ledger
from millrace.plans import stored
from millrace.sources.store import Store


def test_bodies_are_measured_and_marked_without_being_moved(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/held")
    log = "\n".join(f"step {k} ok" for k in range(400))
    rows = spark.createDataFrame([(1, "t", log), (2, "t", "short"), (3, "t", log), (4, "u", log + "é"), (5, "t", None)], "seq long, tool string, body string")
    day = F.lit("2024-01-01").cast("timestamp")
    sent = {r.seq: r.handle for r in store.hold(rows, day).collect()}
    assert sent == {1: "R1", 2: None, 3: "R1", 4: "R2", 5: None}
    sizes = store.sizes(store.held())
    assert {r.handle: r.chars for r in sizes.collect()} == {"R1": len(log), "R2": len(log) + 1}
    joined = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert all("body" not in line or "length(body" in line or "Relation" in line or "Filter" in line for line in joined.splitlines())
    done, handles = fold.fold_and_mark(rows)
    assert {(r.seq, r.handle) for r in handles.collect()} == {(1, "R1"), (3, "R1"), (4, "R2")}
    whole = {r.seq: r for r in fold.fold_and_hold(rows).collect()}
    assert whole[1].body == log and whole[2].body is None and whole[2].text == "short" and whole[3].text.startswith("R1 [t: ")
    marks = done.where("folded").select("seq", "fingerprint")
    assert sorted(ledger.give_handles(marks).collect()) == sorted(ledger.put_blobs(rows.where("seq IN (1, 3, 4)")).collect())


def test_texts_read_back_by_handle_are_those_sent(spark, tmp_path):
    log = "\n".join(f"step {k} ok" for k in range(400))
    texts = [(1, log), (2, "short"), (3, None), (4, log), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    got = {r.seq: (r.readable, r.body_sha256) for r in stored.fold_hold(spark, str(tmp_path)).collect()}
    assert got == {k: (t is not None, t if t is None else hashlib.sha256(t.encode()).hexdigest()) for k, t in texts}
