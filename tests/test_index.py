"""The stored token index: top-k and candidates against plain counting, through rewrites, removals, merges of segments and crashes."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.sources.index import TokenIndex
from millrace.sources.store import Settings, Store
from millrace.tools import builtin_tools

EVENT = "event long, op string, id long, fact string"


def tokens(text):
    return {w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 2 and w not in V.STOP}


def best(state, text, k):
    own = tokens(text)
    found = sorted(((len(own & tokens(f)), i) for i, f in state.items() if own & tokens(f)), reverse=True)
    return [(i, n) for n, i in found[:k]]


def test_index_follows_writes(spark, tmp_path):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    say = lambda: " ".join(["common", *(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(0, 9)))])
    index = TokenIndex(spark, f"file://{tmp_path}/index", buckets=4, max_segments=3)
    state, event, log = {}, 0, []
    questions = [(q, say()) for q in range(12)] + [(50, ""), (51, "unheard words"), (52, "common")]
    asked = spark.createDataFrame(questions, "query_id long, text string")
    for batch in range(5):
        rows = []
        for _ in range(60 if batch == 0 else 25):
            event += 1
            i = rng.randint(1, 80)
            op = "forget" if i in state and rng.random() < 0.2 else "update" if i in state else "insert"
            text = None if op == "forget" or rng.random() < 0.05 else say()
            rows.append((event, op, i, text))
            state.pop(i, None)
            if op != "forget":
                state[i] = text
        rows.append((event := event + 1, "trust", rng.choice(list(state)), None))  # no change of text
        log += rows
        index.update(spark.createDataFrame(log, EVENT).repartition(3))
        assert index.update(spark.createDataFrame(log, EVENT)) == 0  # a replay changes nothing
        got = {}
        for r in index.top_overlaps(asked, 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.overlap))
        assert got == {q: best(state, t, 4) for q, t in questions if best(state, t, 4)}, batch
        df = {r.token: r.df for r in index.frequencies(asked.select(F.explode(F.split("text", " ")).alias("token"))).collect()}
        assert df == {w: n for w in {x for _, t in questions for x in t.split(" ")} if (n := sum(w in tokens(f) for f in state.values()))}
    assert len(index.commits()) <= 3 and index.commits()[0].base


def test_a_crash_leaves_unread_files(spark, tmp_path):
    index = TokenIndex(spark, f"file://{tmp_path}/index")
    index.update(spark.createDataFrame([(1, "insert", 1, "red apples")], EVENT))
    broken = spark.createDataFrame([(2, "insert", 2, "red pears")], EVENT)
    commit, index._commit = index._commit, None
    half = spark.createDataFrame([("red", 9, 2, True, 0, 0)], "token string, id long, event long, live boolean, tier int, bucket int")
    index._write("postings", 1, half, ["tier", "bucket"], ["token", "id"])  # what a crash before the commit row leaves
    index._commit = commit
    ask = spark.createDataFrame([("red",)], "token string")
    assert [r.id for r in index.postings(ask).collect()] == [1]
    index.update(broken)
    assert sorted(r.id for r in index.postings(ask).collect()) == [1, 2]


def test_readers_open_few_files(spark, tmp_path):
    index = TokenIndex(spark, f"file://{tmp_path}/index", buckets=8)
    rows = [(i, "insert", i, f"frequent rare{i % 50}") for i in range(1, 2001)]
    index.update(spark.createDataFrame(rows, EVENT))
    every = spark.read.parquet(f"file://{tmp_path}/index/postings").select(F.input_file_name().alias("f")).distinct().count()
    one = index.postings(spark.createDataFrame([("rare7",)], "token string"))
    assert one.count() == 40
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "tier" in plan.split("PartitionFilters: [")[1]
    assert every >= 8
    # the frequent token's postings, most of all, are in files of their own
    big = spark.read.parquet(f"file://{tmp_path}/index/postings").groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("token").alias("n"), F.max("token").alias("t"))
    assert big.where("t = 'frequent'").agg(F.max("n")).first()[0] == 1


def test_merge_candidates_and_remember(spark, tmp_path):
    rng = random.Random(4)
    state = {i: " ".join(rng.sample([f"w{k:02d}" for k in range(14)], rng.randint(1, 8))) for i in range(1, 300)}
    index = TokenIndex(spark, f"file://{tmp_path}/index")
    index.update(spark.createDataFrame([(i, "insert", i, t) for i, t in state.items()], EVENT))
    new = {1000 + k: " ".join(rng.sample([f"w{k:02d}" for k in range(16)], rng.randint(1, 8))) for k in range(40)}
    got = {(r.new_id, r.id) for r in index.merge_candidates(spark.createDataFrame(list(new.items()), "new_id long, fact string")).collect()}
    assert got == {(n, i) for n, t in new.items() for i, f in state.items() if len(tokens(t) & tokens(f)) >= 3 * len(tokens(t)) // 4 + 1}

    store = Store(spark, f"file://{tmp_path}/store", Settings(index_tail=2))
    tools = builtin_tools(store)
    facts = ["The deploy server runs linux", "Dave trains models on the big machine", "Coffee is kept on the third floor", "The build takes nine minutes"]
    for i, fact in enumerate(facts, 1):
        assert tools.dispatch("remember", {"fact": fact}).startswith(f"Remembered #{i}")
    assert store.index().commits()
    assert tools.dispatch("remember", {"fact": "The deploy server runs linux"}).startswith("Updated #1")
    assert tools.dispatch("remember", {"fact": "deploy server runs"}).startswith("Already held as #1")
    assert tools.dispatch("remember", {"fact": "The build takes ten minutes"}).startswith("Remembered")


def test_tasks_follow_the_postings_and_updates_move_no_text(spark, tmp_path, monkeypatch):
    from millrace.sources import index as module

    monkeypatch.setattr(module, "_READ_ROWS", 100)
    monkeypatch.setattr(module, "_FILE_ROWS", {"postings": 200, "forward": 20})
    index, plans = TokenIndex(spark, f"file://{tmp_path}/index", buckets=2), {}
    inner = module.staged
    monkeypatch.setattr(module, "staged", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().toString()) and inner(df, label))
    index.update(spark.createDataFrame([(i, "insert", i, f"always word{i % 40} other") for i in range(1, 1201)], EVENT))
    assert "Aggregate" not in plans["index-batch"]
    index.update(spark.createDataFrame([(2000 + i, "update" if i % 3 else "forget", i, f"always last{i % 7}" if i % 3 else None) for i in range(1, 601)], EVENT))
    ask = spark.createDataFrame([("always",), ("other",), ("last3",)], "token string")
    found = index.postings(ask)
    assert found.rdd.getNumPartitions() > 10  # with 100 postings a task; they were dealt to 4 tasks however many there were
    got = {r.token: r.n for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"always": 1000, "other": 600, "last3": sum(i % 7 == 3 and i % 3 > 0 for i in range(1, 601))}
    assert got == {r.token: r.df for r in index.frequencies(ask).collect()}
    files = spark.read.parquet(f"file://{tmp_path}/index/postings/seg=0").where("token = 'always'").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 3  # a frequent token is dealt to several tasks
