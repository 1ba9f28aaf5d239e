from pyspark.sql import functions as F

from millrace.sources.store import Store
from millrace.tools import Registry, Session, builtin_tools


def test_dispatch_never_raises():
    registry = Registry(guard=lambda tool, args: "no" if args.get("x") == 13 else None)

    @registry.tool("half", "Halves.")
    def half(x: int) -> str:
        return str(10 // x)

    @registry.tool("wipe", requires_confirm=True)
    def wipe() -> str:
        return "gone"

    assert registry.dispatch("half", {"x": 5}) == "2"
    assert registry.dispatch("half", {"x": 0}).startswith("ERROR")
    assert registry.dispatch("half", {}).startswith("ERROR")
    assert registry.dispatch("nothing", {}).startswith("ERROR")
    assert registry.dispatch("half", {"x": 13}) == "BLOCKED: no"
    assert registry.dispatch("wipe", {}).startswith("DENIED")
    assert [s["function"]["name"] for s in registry.schemas()] == ["half", "wipe"]


def test_builtin_tools(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    tools = builtin_tools(store)
    assert len(tools.names()) == 9
    assert tools.dispatch("remember", {"fact": "The deploy server runs linux"}) == "Remembered #1."
    assert "#1 [fact]" in tools.dispatch("recall", {"query": "linux server"})
    blob = spark.createDataFrame([("R1", "k;v\na;1\nb;2\nc;4")], "handle string, body string").withColumn("tool", F.lit("t"))
    store.append("blobs", blob)
    assert tools.dispatch("fold_stats", {"handle": "R1", "column": "v", "op": "sum"}).startswith("sum(v) = 7 ")
    assert tools.dispatch("fold_peek", {"handle": "R2"}).startswith("ERROR")


def test_hooks_that_raise_never_leave_dispatch():
    def broken(*_):
        raise ZeroDivisionError("hook")

    registry = Registry(on_dispatch=broken)

    @registry.tool("one", requires_confirm=True)
    def one() -> str:
        return "1"

    assert registry.dispatch("one", {}).startswith("DENIED")
    registry.confirm = broken
    assert registry.dispatch("one", {}).startswith("DENIED")
    registry.confirm = lambda *_: True
    assert registry.dispatch("one", {}) == "1"
    registry.guard = broken
    assert registry.dispatch("one", {}).startswith("BLOCKED")
    registry.enabled = broken
    assert registry.dispatch("one", {}).startswith("ERROR")


def test_remember_merges_resets_and_trusts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/w")
    run = Session(store, "turn-1")
    tools = builtin_tools(store, run)
    tools.confirm = lambda *_: True
    say = lambda **a: tools.dispatch("remember", a)
    facts = lambda: {r.id: r for r in store.facts().collect()}
    assert say(fact="Alpha server deploys nightly from branch main", cues="release schedule") == "Remembered #1."
    assert say(fact="alpha server deploys") == "Already held as #1, in fuller words: Alpha server deploys nightly from branch main"
    run.finish("failed")
    assert facts()[1].unproven and facts()[1].cues == "release schedule"
    tools.dispatch("trust_memory", {"id": 1})
    assert not facts()[1].unproven and facts()[1].lineage == "user/hand/hand" and facts()[1].fact.startswith("Alpha")
    tools.dispatch("move_memory", {"id": 1, "folder": "Facts\\ Ops /x/y"})
    assert facts()[1].folder == "Facts/Ops/x"

    again = Session(store, "turn-2")
    tools = builtin_tools(store, again)
    tools.confirm = lambda *_: True
    assert "#1 [fact]" in tools.dispatch("recall", {"query": "nightly release of alpha"})
    again.finish("ok")
    assert (facts()[1].uses, facts()[1].wins) == (1, 1)
    assert {(r.term, r.id, r.weight) for r in store.bonds().collect()} == {("release", 1, 1)}
    third = builtin_tools(store, Session(store, "turn-3"))
    third.confirm = lambda *_: True
    answer = third.dispatch("remember", {"fact": "Alpha server never deploys nightly from branch main"})
    assert answer.startswith("Updated #1 (the claim changed")
    row = facts()[1]
    assert (row.uses, row.wins, row.cues, row.grafted) == (0, 0, "", "user:1:1") and store.bonds().count() == 0
    assert third.dispatch("remember", {"fact": "Quite another sentence", "replaces": 1}).startswith("Updated #1")
    assert third.dispatch("remember", {"fact": "x y z", "replaces": 99}) == "ERROR: there is no memory #99"
    assert third.dispatch("remember", {"fact": "x", "replaces": True}).startswith("ERROR")
    assert "Alpha server deploys nightly" in third.dispatch("recall", {"query": "", "history_id": 1})
    assert third.dispatch("forget", {"id": 1}) == "Forgot #1." and not facts()
    assert [r.op for r in store.changes().orderBy("event").collect()] == ["put", "put", "put", "remove"]
