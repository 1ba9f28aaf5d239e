from pyspark.sql import functions as F

from millrace.sources.store import Settings, Store, current_facts

COLUMNS = "event long, op string, id long, fact string, context string, cues string, folder string, lineage string, reset boolean, grafted string, t long"


def _events(spark):
    """Every kind of event, on facts that are rewritten, reset, moved, trusted, forgotten and grafted in all orders."""
    rows, ops = [], ("insert", "update", "move", "trust", "update", "forget", "update", "graft")
    for n in range(120):
        i, op = n % 15, ops[0] if n < 15 else ops[(n * 7 + n // 15) % 8]
        written = op in ("insert", "update")
        rows.append((
            n, op, i, f"fact {i} text {n}" if written else None, f"c{n}" if n % 5 == 0 else None, f"cue{n}" if n % 4 == 1 else None,
            f"Tree/{n}" if op == "move" else None, f"run/{n}/x" if written else None, written and n % 6 == 0, f"g{n}" if op == "graft" else None, 1000 + (n * 37) % 90,
        ))
    return spark.createDataFrame(rows, COLUMNS).withColumns({"created_at": F.timestamp_seconds("t"), "category": F.lit("fact")}).drop("t")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_packs_keep_state_and_history_and_bound_the_files(spark, tmp_path):
    plain, packed = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b", Settings(pack_files=4))
    events = _events(spark).cache()
    turns = spark.createDataFrame([(1, 3, "served", "ok", 1040), (2, 4, "planted", "failed", 1080)], "seq long, fact_id long, kind string, outcome string, t long")
    for store in (plain, packed):
        store.append("turn_events", turns.withColumn("ts", F.timestamp_seconds("t")))
    most = 0
    for k in range(12):
        part = events.where(F.col("event").between(k * 10, k * 10 + 9)).coalesce(1)
        plain.append("fact_events", part)
        packed.append("fact_events", part)
        packed.tidy()
        layout = packed._packs("fact_events").layout()
        most = max(most, len(layout.tail) + len(layout.packs))
    assert most <= 3 + 4 and packed._packs("fact_events").layout().packs
    assert _rows(packed.table("fact_events")) == _rows(plain.table("fact_events"))
    assert _rows(packed.facts()) == _rows(plain.facts()) == _rows(current_facts(events, plain.table("turn_events")))
    assert _rows(packed.revisions()) == _rows(plain.revisions())
    assert _rows(packed.changes(50)) == _rows(plain.changes(50))
    assert packed._read("fact_events", "state").count() <= packed.table("fact_events").count()
    before = _rows(packed.table("fact_events"))
    assert packed.vacuum(1) == 0
    assert packed.vacuum(0) > 0
    assert _rows(packed.table("fact_events")) == before and not packed._packs("fact_events").layout().covered == ()
    packed.append("fact_events", events.limit(0))
    packed.pack("fact_events")
    assert _rows(packed.facts()) == _rows(plain.facts())


def test_a_pack_that_dies_before_its_commit_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c")
    store.append("fact_events", _events(spark))
    before = _rows(store.facts())
    packs = store._packs("fact_events")

    def dies(rows):
        raise RuntimeError("lost")

    try:
        packs.pack(lambda places: store._rows("fact_events", places), lambda rows: rows, dies)
    except RuntimeError:
        pass
    assert store._packs("fact_events").layout().packs == () and _rows(store.facts()) == before
    (tmp_path / "c" / "packs" / "fact_events" / "commits" / "n=1").mkdir(parents=True)
    store.pack("fact_events")
    assert len(store._packs("fact_events").layout().packs) == 1 and _rows(store.facts()) == before


def test_packs_of_empty_tables_and_repeated_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/d")
    store.pack("episodes")
    assert store.table("episodes").count() == 0 and store.tidy() == []
    row = spark.createDataFrame([(None, "asked"), (7, "asked"), (7, "asked")], "id long, request string")
    store.append("episodes", row)
    store.pack("episodes")
    store.append("episodes", row)
    assert store.table("episodes").count() == 6


def test_a_filling_that_dies_is_repeated_and_the_stream_goes_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/e")
    add = lambda rows: store.append("fact_events", spark.createDataFrame(rows, "event long, op string, id long, fact string"))
    add([(1, "insert", 1, "one"), (2, "insert", 2, "two"), (3, "forget", 2, None)])
    got, tries = [], []

    def put(batch, batch_id):
        rows = [(r.op, r.id, r.fact) for r in batch.orderBy("event").collect()]
        if batch_id == -1 and not tries:
            tries.append(rows)
            add([(4, "insert", 3, "three"), (5, "update", 1, "one again")])
            raise RuntimeError("lost")
        got.extend(rows)

    try:
        store.mirror(put, f"{tmp_path}/cp", "m")
    except RuntimeError:
        pass
    store.pack("fact_events")
    store.mirror(put, f"{tmp_path}/cp", "m").awaitTermination()
    add([(6, "forget", 3, None)])
    store.mirror(put, f"{tmp_path}/cp", "m").awaitTermination()
    assert tries == [[("insert", 1, "one")]]
    assert got == [("insert", 1, "one"), ("insert", 3, "three"), ("update", 1, "one again"), ("forget", 3, None)]


def test_a_pack_keeps_a_state_of_its_own_only_where_it_spares_half(spark, tmp_path):
    import os

    plain, store = Store(spark, f"file://{tmp_path}/p"), Store(spark, f"file://{tmp_path}/q")
    kinds = "event long, op string, id long, fact string, category string, folder string"
    once = spark.createDataFrame([(n, "insert", n, f"guitar string {n}", "decision", None) for n in range(40)] + [(50, "move", 3, None, None, "Tree/Moved")], kinds)
    often = spark.createDataFrame([(100 + n, "update", n % 4, f"said {n}", "fact", None) for n in range(400)] + [(600, "update", 77, "no insert", "fact", None)], kinds)
    states = []
    for batch in (once, often):
        plain.append("fact_events", batch)
        store.append("fact_events", batch)
        store.pack("fact_events")
        packs = store._packs("fact_events").layout().packs
        states.append(["state" in os.listdir(f"{tmp_path}/q/packs/fact_events/{p}") for p in packs])
        assert _rows(store.facts()) == _rows(plain.facts()) and _rows(store.revisions()) == _rows(plain.revisions())
        assert _rows(store.bonds()) == _rows(plain.bonds())
    assert states[0] == [False] and states[1][-1] and store._read("fact_events", "state").count() < 120
    folders = {r.id: r.folder for r in store.facts().collect()}
    assert folders[3] == "Tree/Moved" and folders[5] == plain.facts().where("id = 5").first().folder and folders[77].startswith("Facts")
