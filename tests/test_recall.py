from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import grading, recall, tasks


def facts(spark):
    return spark.createDataFrame(
        [
            (1, "The deployment server runs linux", "fact", "Facts/Development", "", False),
            (2, "Blue paint for the garden door", "fact", "Facts", "colour shade", False),
            (3, "The garden shade is blue", "fact", "Facts", "", True),
            (4, "Reaper renders the garden track", "fact", "Facts/Audio & music", "", False),
        ],
        "id long, fact string, category string, folder string, cues string, unproven boolean",
    )


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_keyword_rank_orders_by_overlap_cue_and_id(spark):
    got = recall.keyword_rank(ask(spark, "blue garden shade", "of the"), facts(spark), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.overlap, r.cue) for r in got] == [(0, 3, 3, 0), (0, 2, 2, 1), (0, 4, 1, 0), (1, 4, 0, 0), (1, 3, 0, 0), (1, 2, 0, 0)]


def test_scatter_only_appends_to_recall(spark):
    asked = ask(spark, "deploy something", "blue garden")
    plain = recall.recall(asked, facts(spark), spread=False)
    full = recall.recall(asked, facts(spark))
    fused = {tuple(r) for r in plain.where("source = 'fused'").collect()}
    assert fused == {tuple(r) for r in full.where("source = 'fused'").collect()}
    assert (0, 1, "1", "scatter") in {(r.query_id, r.rank, r.key, r.source) for r in full.collect()}


def test_semantic_hits_meet_facts_by_id_or_text(spark):
    hits = spark.createDataFrame(
        [(0, 1, 99, "gone fact"), (0, 2, None, " the garden shade is BLUE "), (0, 3, None, "something else"), (0, 4, None, "ab"), (0, 5, 3, "again")],
        "query_id long, pos int, mem_id long, snippet string",
    )
    got = recall.semantic_rank(hits, facts(spark), 9).orderBy("rank").collect()
    assert [r.key for r in got] == ["3", "txt:something else"]


def test_prime_skips_what_does_not_fit(spark):
    asked = ask(spark, "blue garden paint door").withColumn("known", F.lit(""))
    got = recall.prime(asked, facts(spark), 3, 45).collect()
    assert [(r.pos, r.id) for r in got] == [(1, 2)]
    assert recall.prime(asked, facts(spark), 3, 5).count() == 0


def test_history_and_digest(spark):
    rows = spark.createDataFrame([(1, 1, "a", 10), (1, 2, "a", 11), (1, 3, "b", 12), (2, 4, None, 13)], "id long, event long, fact string, stored_at long")
    got = recall.history(rows).orderBy("id", "pos").collect()
    assert [(r.id, r.fact, r.superseded_at, r.current) for r in got] == [(1, "a", 12, False), (1, "b", None, True), (2, None, None, True)]
    assert [r.id for r in recall.core_digest(facts(spark)).collect()] == [2]


def test_tallies_and_held(spark):
    t = datetime(2024, 1, 1)
    rows = [("r1", 1, 7, "served", "ok", t), ("r1", 2, 7, "served", "ok", t), ("r2", 3, 7, "served", "failed", t), ("r3", 4, 7, "served", "stopped", t), ("r4", 5, 8, "planted", "failed", t)]
    events = spark.createDataFrame(rows, "run_id string, seq long, fact_id long, kind string, outcome string, ts timestamp")
    assert [(r.id, r.uses, r.wins) for r in grading.tallies(events).collect()] == [(7, 2, 1)]
    assert {(r.id, r.unproven) for r in grading.held_flags(events).collect()} == {(7, False), (8, True)}


def test_standing_counts_grafts_and_leaves_out_the_unproved(spark):
    rows = [("user/hand/hand", 3, 2, False, ""), ("model/a/d0", 0, 0, False, "user:1:1;x:1:1"), ("machine/scan/scan", 0, 0, True, "")]
    df = spark.createDataFrame(rows, "lineage string, uses long, wins long, unproven boolean, grafted string")
    assert {r.tree: r.standing for r in grading.standing(df).collect()} == {"user": 0.5, "machine": 0.0}
    assert {r.tree: r.taken for r in grading.orchard(df).collect()} == {"user": 1, "model": 0, "machine": 0}
    logged = spark.range(1).select(grading.graft_record(F.lit("user:1:1;user:2:1;user:3:1;user:4:1"), F.lit("model"), F.lit(5), F.lit(2)))
    assert logged.first()[0] == "user:2:1;user:3:1;user:4:1;model:5:2"


def test_clusters_and_promotions(spark):
    day = lambda k: datetime(2024, 1, k)
    rows = [(1, day(1), "open the chat app window", "ok"), (2, day(2), "open chat app", "ok"), (3, day(2), "chat app open please", "ok"), (4, day(3), "write poem", "ok"), (5, day(3), "open chat app", "failed")]
    episodes = spark.createDataFrame(rows, "id long, ts timestamp, request string, outcome string")
    assert {r.id: r.component for r in tasks.episode_clusters(episodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    got = tasks.promotions(episodes).collect()
    assert [(r.trigger, r.key, r.uses, r.newest) for r in got] == [("open chat app", "app chat open", 3, 3)]
    assert tasks.promotions(episodes, got and spark.createDataFrame([("app chat open",)], "key string")).count() == 0


def test_predict_and_hop(spark):
    patterns = spark.createDataFrame([(1, "app chat open", 2, 2, False, ""), (2, "chat", 0, 0, True, ""), (3, "music play", 9, 9, False, "")], "id long, key string, uses int, wins int, taught boolean, sector string")
    got = tasks.predict(ask(spark, "open the chat app"), patterns).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(2, 2.9), (1, 0.77)]
    edges = spark.createDataFrame([(1, 3, 5), (2, 3, 1), (1, 2, 9)], "a long, b long, weight long")
    assert [(r.id, r.weight) for r in tasks.associated(got and spark.createDataFrame([(0, 1), (0, 2)], "query_id long, id long"), edges).collect()] == [(3, 6)]


def test_facts_alike_are_ranked_as_one(spark):
    rows = [(k, f"The garden door {'is blue' if k % 3 else 'was painted'}", f"Facts/{'Work' if k % 2 else 'Development'}") for k in range(60)]
    many = spark.createDataFrame(rows, "id long, fact string, folder string")
    asked = ask(spark, "gardens painting by a client", "gardens", "blue doors", "of the")
    assert recall._alike(many, 2).count() == 8
    none = spark.createDataFrame([], "query_id long, id long")
    by_rows = {tuple(r) for r in recall.scatter(asked, many, none).select("query_id", "id", "score", "rank").collect()}
    assert {tuple(r) for r in recall.scatter(asked, many).select("query_id", "id", "score", "rank").collect()} == by_rows and by_rows
