"""Operators 11 to 13 against plain Python on odd rows: nulls, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import math
import random

import pytest
from millrace.llm import queries
from millrace.llm.common import totals_before
from millrace.llm.conversations import member_digests, ordered_turns, prefix_nodes, spliced, subtree_totals
from millrace.llm.filters import audit_edges, audit_orders, mark_later_copies
from millrace.llm.mixing import mix_sources
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_totals_before_cuts_groups_and_keeps_ties(spark):
    rows = [("hot", i // 7, i) for i in range(3000)] + [(None, 1, 5)] * 40 + [("a", 0, 1)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(5)
    got = totals_before(df, ["g"], [F.col("o")], {"t": F.col("v")}, "test").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.g].append((r.o, r.t, r.v))
    for g, own in by.items():
        own.sort(key=lambda x: x[:2])
        assert [t for _, t, _ in own] == [0, *itertools.accumulate(v for _, _, v in own)][:-1], g
    assert collections.Counter((r.g, r.o, r.v) for r in got) == collections.Counter(rows)
    assert totals_before(df.limit(0), ["g"], [F.col("o")], {"t": F.col("v")}, "test").count() == 0


def _targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


MIX = "doc_id long, source string, size long, quality double, key string, target string, taken int, named int"


def test_mix_meets_targets_and_prefers_quality(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        source = rng.choice(["big"] * 30 + ["é", "z", None, "", "tiny"])
        rows.append((i if i % 9 else None, source, rng.choice([None, 0, 1, 7, 90]) if i % 50 else 5000, rng.choice([1.0] * 8 + [0.1] * 8 + [None, -1.0, float("nan")]), f"{i}" if i % 11 else None, "t", 1, 2))
    rows += [(1, "z", 10, 1.0, "same", "t", 1, 2)] * 200
    df = spark.createDataFrame(rows, MIX).repartition(6)
    out = mix_sources(df, "key")
    assert out.columns == [*df.columns, "source_size", "target_", "taken_"]
    got = out.collect()
    assert collections.Counter(tuple(r)[:3] for r in got) == collections.Counter(r[:3] for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[1]] += r[2] or 0
    targets, taken = _targets(sizes, (1, 2, 3), 3), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r["target_"], targets[r.source], rel_tol=1e-9)
        assert 0 <= r["taken_"] <= 3 * (r.size or 0)
        taken[r.source] += r["taken_"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.5
    again = mix_sources(df.repartition(3), "key").collect()
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, again))
    # of the part that is sampled, documents of high quality are taken more often
    part = [r for r in got if r.source == "big" and r.size == 90]
    share = {q: sum(r["taken_"] % 90 == 0 and r["taken_"] // 90 > min(x["taken_"] for x in part) // 90 for r in part if r.quality == q) / max(1, sum(r.quality == q for r in part)) for q in (1.0, 0.1, -1.0)}
    assert share[1.0] > share[0.1] >= share[-1.0]


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mix_sources(spark.createDataFrame([], MIX), "key").count() == 0
    got = mix_sources(spark.createDataFrame([(1, None, 0, 1.0, "a", "", 0, 0), (2, "x", None, 1.0, "b", "", 0, 0)], MIX), "key").collect()
    assert [(r.source_size, r["target_"], r["taken_"]) for r in got] == [(0, 0.0, 0)] * 2


def test_later_copies(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (5, "c")] + [(i, "hot") for i in range(100, 400)]
    got = mark_later_copies(spark.createDataFrame(rows, "doc_id long, digest string"), "doc_id", "digest", "late").collect()
    assert len(got) == len(rows)
    for r in got:
        firsts = [i for i, d in rows if d == r.digest and i is not None]
        assert r.late == (bool(firsts) and (r.doc_id is None or r.doc_id > min(firsts)))


def test_audit_counts_every_edge(spark):
    rng = random.Random(5)
    rows = [("p" if i % 3 else "", *[rng.random() < q for q in (0.3, 0.6, 0.1)], rng.random() < 0.5) for i in range(300)]
    rows += [("gone", True, False, False, True)] * 4
    df = spark.createDataFrame(rows, "part string, x boolean, y boolean, z boolean, good boolean")
    got = audit_orders(audit_edges(df, "part", ["x", "y", "z"], ["good"]), "part", ["x", "y", "z"], ["good"]).collect()
    expect = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], collections.Counter()
        for order in itertools.permutations(range(3)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1 + f]]
                left = [r for r in left if not r[1 + f]]
                fails = [r for r in own if r[1 + f]]
                shapley[f] += len(gone)
                expect[part, "".join("xyz"[i] for i in order), step] = ["xyz"[f], len(left), len(gone), len(fails) - len(gone), sum(sum(r[1:4]) == 1 for r in fails), sum(r[4] for r in gone), f]
        for key, e in expect.items():
            if key[0] == part:
                e[-1] = shapley[e[-1]]
    assert {(r.part, r.filter_order, r.step): [r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.lost_good, r.shapley] for r in got} == expect
    assert audit_orders(audit_edges(df.limit(0), "part", ["x", "y"], []), "part", ["x", "y"], []).count() == 0


def test_audit_query_takes_nulls_and_long_texts(spark, tmp_path):
    docs = [(1, None, None), (None, "", None), (2, "", "en"), (3, "A " * 200_000, "en"), (3, "A " * 200_000, "en"), (4, "A " * 200_000, "en")]
    spark.createDataFrame([(i, t, lang, "clash", True) for i, t, lang in docs], "doc_id long, text string, lang string, part string, A boolean").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.part, r.filter_order, r.step): r for r in queries.op11_filter_audit(spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 600
    first = got["", "EABCD", 1]
    # the empty texts of null id and of id 2 are copies of the null text of id 1
    assert (first.kept, first.removed, got["en", "EABCD", 1].removed) == (1, 1, 2)
    assert (got["", "ABCDE", 1].good_lost, got["", "ABCDE", 1].toxic_lost, got["en", "BACDE", 1].removed) == (1, 1, 3)


def _trie(convs):
    """conv_id -> turns: node (conv_id, depth) -> all columns."""
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    ends = {k: sorted(c for c in m if len(convs[c]) == len(k)) for k, m in nodes.items()}
    return {
        (min(m), len(k)): (min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k, m in nodes.items()
    }


def test_trie_of_odd_conversations(spark):
    rng = random.Random(9)
    rows, own = [], {}
    for c in [*range(-5, 60), 10**12, 70_000]:
        length = 300 if c == 7 else rng.choice([1, 1, 2, 3, 9])
        own[c] = []
        for t in range(length):
            role, text = rng.choice([None, "user", ""]), rng.choice([None, "", "a", "bb", "x" * 50_000 if t == 2 else "é"])
            rows.append((c, None if t == 0 and c % 2 else t, role, text, "clash", 1))
            own[c].append((role or "", text or ""))
    for c in (300, 301, 302):  # one long run shared by all
        rows += [(c, t, "user", f"t{t}", "", 1) for t in range(40)]
        own[c] = [("user", f"t{t}") for t in range(40)]
    rows += [(None, 1, "user", "of nobody", "", 1)] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string, a int").repartition(5)
    head = F.pmod(F.col("conv_id"), F.lit(4))
    turns, convs = spliced(ordered_turns(df), F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(10)), head, 3)
    nodes, ends = prefix_nodes(turns, convs)
    got = subtree_totals(nodes).join(member_digests(ends), ["conv_id", "depth"], "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    rebuilt = {c: own.get(c - c % 10, [])[: c % 4] + t[c % 4 :] for c, t in own.items()}
    assert any(not t for t in rebuilt.values())
    expect = _trie(rebuilt)
    assert {(r.conv_id, r.depth): (r.up, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or empty) for r in got} == expect
    assert len(got) == len(expect)


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_source_mix", "op11_filter_audit"])
def test_queries_of_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
