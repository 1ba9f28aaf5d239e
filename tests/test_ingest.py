"""Bulk writes against a standing store: equal to a plain loop over all rows, with times, lineages, standings and grafts."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.operators import ingest
from millrace.sources.store import Store

LINEAGES = ("user/hand/hand", "model/main/d0", "model/main/d1", "model/side/d0", "machine/scan/scan", "import", None)
START = 1_700_000_000


def words_of(text):
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in V.STOP}


def parts(lineage):
    p = (lineage or "").split("/")
    return p if len(p) == 3 and all(p) else None


def loop(store, writes, standings):
    """The rule, one write at a time over every row."""
    out = {}
    for seq, fact, lineage, at in writes:
        own, new_parts = words_of(fact), parts(lineage)
        for row in store:
            held, old_parts = words_of(row["fact"]), parts(row["lineage"])
            if not own or not held:
                continue
            name, other = (re.match(r"(Dave|Anna)", x) for x in (fact, row["fact"]))
            if name and other and name[0] != other[0]:
                continue
            both = new_parts and old_parts
            close = len(own & held) / len(own | held) > 0.75
            vague = row["fact"].startswith(("It ", "They ")) or len(held) < 2
            elaborates = at - row["at"] <= 3600 and held < own and vague
            restates = bool(both and new_parts[:2] == old_parts[:2] and own < held)
            if not (close or elaborates or restates):
                continue
            if restates and not close and not elaborates:
                out[seq] = (row["key"], "restated", False, False, False)
                break
            flips = lambda t: sum(w in ("not", "never") for w in t.lower().split()) % 2
            changed = flips(fact) != flips(row["fact"]) or re.findall(r"\b\d+\b", fact) != re.findall(r"\b\d+\b", row["fact"])
            grove = bool(both and new_parts[0] != old_parts[0])
            tree = lambda p: p[0] if p and p[0] in V.TREES else "import"
            a, b = standings.get(tree(new_parts)), standings.get(tree(old_parts))
            demoted = grove and a is not None and b is not None and a + 0.15 < b
            if grove and (row["uses"] or row["wins"]):
                row["grafted"] = ";".join([*filter(None, row["grafted"].split(";")), f"{old_parts[0]}:{row['uses']}:{row['wins']}"][-4:])
            row.update(fact=fact, lineage=lineage, at=at)
            if changed or demoted:
                row.update(uses=0, wins=0)
            out[seq] = (row["key"], "updated", changed, demoted, elaborates)
            break
        else:
            store.append(dict(key=("new", seq), fact=fact, lineage=lineage, at=at, uses=0, wins=0, grafted=""))
            out[seq] = (("new", seq), "inserted", False, False, False)
    return out


def say(rng):
    lead = rng.choice(["", "", "Dave ", "Anna ", "It ", "never "])
    return (lead + " ".join(rng.sample([f"word{k}" for k in range(9)], rng.randint(0, 7))) + rng.choice(["", "", " 7", " 12"])).strip()


def test_batch_equals_single_writes(spark):
    rng = random.Random(11)
    stored = [dict(key=("old", i), fact=say(rng), lineage=rng.choice(LINEAGES), at=START - rng.choice([100, 2000, 9000]), uses=rng.randint(0, 3), wins=0, grafted=rng.choice(["", "user:1:1"])) for i in range(1, 41)]
    writes = [(s, say(rng), rng.choice(LINEAGES), START + s * rng.choice([1, 30])) for s in range(200)]
    writes = [(s, f, g, max(t for _, _, _, t in writes[: s + 1])) for s, f, g, t in writes]
    standings = {"user": 0.8, "model": 0.5, "machine": 0.1}
    at = lambda c: F.timestamp_seconds(F.col(c))
    old = spark.createDataFrame([(r["key"][1], r["fact"], r["lineage"], r["at"], r["uses"], r["wins"], r["grafted"]) for r in stored], "id long, fact string, lineage string, t long, uses long, wins long, grafted string").withColumn("created_at", at("t"))
    new = spark.createDataFrame(writes, "seq long, fact string, lineage string, t long").withColumn("ts", at("t")).repartition(3)
    rows = ingest.write_batch(new, old, spark.createDataFrame(list(standings.items()), "tree string, standing double")).collect()
    got = {r.seq: (("old" if r.target_stored else "new", r.target), r.action, r.changed, r.demoted, r.elaborated) for r in rows}
    expect = loop(stored, writes, standings)
    assert got == expect and len(rows) == len(writes)
    actions = [a for _, a, *_ in expect.values()]
    assert {"inserted", "updated", "restated"} == set(actions) and any(d for *_, d, _ in expect.values()) and any(e for *_, e in expect.values())
    grafts = {r.target: r.grafted for r in sorted(rows, key=lambda r: r.seq) if r.target_stored and r.action == "updated"}
    assert {r["key"][1]: r["grafted"] for r in stored if r["key"][0] == "old" and r["key"][1] in grafts} == grafts


def test_store_writes_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    batch = lambda rows, t: spark.createDataFrame([(s, f, "fact", "user/hand/hand") for s, f in rows], "seq long, fact string, category string, lineage string").withColumn("ts", F.timestamp_seconds(F.lit(START + t)))
    first = store.write(batch([(0, "The deploy server runs linux"), (1, "Coffee is on the third floor"), (2, "deploy server runs")], 0)).collect()
    assert sorted((r.seq, r.id, r.action) for r in first) == [(0, 1, "inserted"), (1, 2, "inserted"), (2, 1, "restated")]
    second = store.write(batch([(0, "The deploy server never runs linux"), (1, "x"), (2, "Tea is on the second floor")], 5000)).collect()
    assert sorted((r.seq, r.id, r.action, r.changed) for r in second) == [(0, 1, "updated", True), (1, 4, "inserted", False), (2, 5, "inserted", False)]
    assert {r.id: r.fact for r in store.facts().collect()} == {1: "The deploy server never runs linux", 2: "Coffee is on the third floor", 4: "x", 5: "Tea is on the second floor"}
    assert store.write(batch([], 9000)).count() == 0
