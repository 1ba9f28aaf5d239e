"""Conversation prefix trie (operator 12): subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns. Prefixes are named without
gathering a conversation: every turn has a 128-bit hash of its place, role and
text, and the exclusive or of a conversation's first d hashes names its depth-d
prefix, so names are running totals (``totals_before``) and one conversation may
hold any share of all turns. Texts are hashed where they are read and never
shuffled.

Peeling: nodes hold a counter of children that have not reported; complete nodes
send their subtree's totals to their parents, summed before the shuffle, until
only the root is left. Runs of nodes with one child each would need a round for
each turn of a long conversation, so they are contracted first, by doubling the
links within a run; a round then takes one branching off the longest path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lookup, staged, totals_before


def ordered_turns(turns: DataFrame, label: str = "turns") -> DataFrame:
    """(conv_id, at, role, a, b, chars): turns numbered from 1, null numbers first, with 128 bits for role and text.

    Ties of the turn fall by role, then by the hash of the text. Null roles and
    texts become empty; rows without a conv_id belong to no conversation and go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        F.char_length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")]
    placed = totals_before(staged(hashed, label), ["conv_id"], order, {"at": F.lit(1).cast("long")}, f"{label}-order")
    return placed.select("conv_id", (F.col("at") + 1).alias("at"), "a", "b", "chars")


def spliced(turns: DataFrame, source: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt, and the table (conv_id) of all of them, those without a turn included.

    Each gets the first ``head`` turns (at most ``most``) of conversation ``source``,
    then its own turns after its first ``head``; both are functions of conv_id.
    A source that is absent gives none, a shorter one all it has.
    """
    turns = staged(turns, "turns-numbered")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = convs.select("conv_id", "n", source.alias("source"), head.alias("head"))
    lengths = convs.select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    heads = staged(heads.join(lengths, "source", "left").withColumn("given", F.least("head", F.coalesce("source_n", F.lit(0).cast("long")))), "turns-heads")
    first = turns.where(F.col("at") <= most).withColumnRenamed("conv_id", "source")
    given = heads.select("conv_id", "source", "given").join(first, "source").where("at <= given").select("conv_id", "at", "a", "b", "chars")
    table = heads.select("conv_id", "n", "head", "given")
    own = lookup(turns, table, ["conv_id"], "n", "inner").where("at > head")
    own = own.select("conv_id", (F.col("at") - F.col("head") + F.col("given")).alias("at"), "a", "b", "chars")
    return given.unionByName(own), heads.select("conv_id")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of (conv_id, at, a, b, chars) over all of ``convs``: nodes, and which node each conversation ends at.

    nodes: (conv_id, depth, up, n_convs, n_children, chars); conv_id is the smallest
    member and, with the depth, names the node; ``up`` is the parent's conv_id.
    ends: (conv_id, member).
    """
    placed = turns.select(
        "conv_id", "at", "chars", F.xxhash64("at", "a", "b").alias("a"), F.xxhash64(F.lit(1), "b", "at", "a").alias("b")
    )
    values = {"pa": F.col("a"), "pb": F.col("b")}
    paths = totals_before(staged(placed, "trie-turns"), ["conv_id"], [F.col("at")], values, "trie-order", xor=True)
    paths = staged(
        paths.select("conv_id", F.col("at").alias("depth"), "chars", "pa", "pb", F.col("pa").bitwiseXOR(F.col("a")).alias("a"), F.col("pb").bitwiseXOR(F.col("b")).alias("b")),
        "trie-paths",
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("a"), zero.alias("b"), "n_convs", zero.alias("chars"))
    named = paths.groupBy("depth", "pa", "pb", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")
    )
    named = staged(root.unionByName(named), "trie-named")
    children = named.where("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    named = staged(named.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "trie-children")
    parents = named.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("up"), "n_children")
    own = named.where("depth > 0")
    found = lookup(own, staged(parents.withColumnRenamed("n_children", "n"), "trie-parents"), ["pa", "pb"], "n", "inner")
    columns = ["conv_id", "depth", "up", "n_convs", "n_children", "chars"]
    top = named.where("depth = 0").withColumn("up", F.lit(None).cast("long"))
    nodes = staged(top.select(*columns).unionByName(found.select(*columns)), "trie-nodes")

    lengths = paths.groupBy("conv_id").agg(F.max_by(F.struct("depth", "a", "b"), "depth").alias("end"))
    ends = convs.join(lengths, "conv_id", "left").select(
        F.col("conv_id").alias("member"), F.coalesce("end.a", zero).alias("a"), F.coalesce("end.b", zero).alias("b")
    )
    ends = staged(ends, "trie-ends")
    at = named.select("a", "b", "conv_id", "depth")
    counted = staged(ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(at, ["a", "b"]), "trie-ends-at")
    return nodes, lookup(ends, counted, ["a", "b"], "n", "inner").select("conv_id", "depth", "member")


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of nodes with one child each, contracted by doubling.

    (conv_id, depth, end_id, end_depth, saved) for the nodes of runs: the node with
    no child or several below its run, and what the run's nodes from here on save.
    """
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    single = nodes.where("n_children = 1").select("conv_id", "depth", saved)
    below = nodes.where("depth > 0").select(
        F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("end_id"), F.col("depth").alias("end_depth"), (F.col("n_children") == 1).alias("open")
    )
    # a node has one parent, so no key of these joins is repeated
    links = staged(single.join(below, ["conv_id", "depth"]), "runs")
    done = links.where("NOT open").drop("open")
    links = links.where("open")
    while not links.isEmpty():
        everywhere = links.withColumn("more", F.lit(True)).unionByName(done.withColumn("more", F.lit(False)).withColumn("open", F.lit(False)))
        further = everywhere.select(
            F.col("conv_id").alias("end_id"), F.col("depth").alias("end_depth"), F.col("end_id").alias("to_id"), F.col("end_depth").alias("to_depth"), F.col("saved").alias("then"), F.col("more").alias("open")
        )
        longer = links.drop("open").join(further, ["end_id", "end_depth"])
        longer = longer.select("conv_id", "depth", F.col("to_id").alias("end_id"), F.col("to_depth").alias("end_depth"), (F.col("saved") + F.col("then")).alias("saved"), "open")
        longer = staged(longer, "runs")
        done = done.unionByName(longer.where("NOT open").drop("open"))
        links = longer.where("open")
    return done


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """``nodes`` and n_leaves (nodes without a child), saved_tokens of their subtrees, themselves included."""
    runs = staged(_runs(nodes), "runs-done")
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    knots = nodes.where("n_children <> 1").select("conv_id", "depth", "up", own, "n_children")
    # a knot's parent knot is the parent of the top of the run above it, or its own parent
    tops = runs.groupBy("end_id", "end_depth").agg(
        F.min_by("conv_id", "depth").alias("top_id"), F.min("depth").alias("top_depth"), F.min_by("saved", "depth").alias("run_saved")
    )
    tops = staged(tops, "runs-tops")
    above = nodes.select(F.col("conv_id").alias("top_id"), F.col("depth").alias("top_depth"), F.col("up").alias("top_up"))
    tops = tops.join(above, ["top_id", "top_depth"])
    tops = tops.select(F.col("end_id").alias("conv_id"), F.col("end_depth").alias("depth"), "top_up", "top_depth", "run_saved")
    zero = F.lit(0).cast("long")
    knots = knots.join(tops, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        F.when(F.col("top_depth").isNull(), F.col("up")).otherwise(F.col("top_up")).alias("up"),
        F.when(F.col("top_depth").isNull(), F.col("depth") - 1).otherwise(F.col("top_depth") - 1).alias("up_depth"),
        F.coalesce("run_saved", zero).alias("run_saved"),
        F.col("n_children").alias("remaining"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        "saved",
    )
    knots = staged(knots, "peel")
    complete, waiting = knots.where("remaining = 0"), knots.where("remaining > 0")
    finished = [complete]
    while True:
        sent = complete.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
            F.count(F.lit(1)).alias("told"), F.sum("n_leaves").alias("leaves"), F.sum(F.col("saved") + F.col("run_saved")).alias("tokens")
        )
        if waiting.isEmpty():
            break
        heard = waiting.join(sent, ["conv_id", "depth"], "left").select(
            "conv_id",
            "depth",
            "up",
            "up_depth",
            "run_saved",
            (F.col("remaining") - F.coalesce("told", zero)).alias("remaining"),
            (F.col("n_leaves") + F.coalesce("leaves", zero)).alias("n_leaves"),
            (F.col("saved") + F.coalesce("tokens", zero)).alias("saved"),
        )
        heard = staged(heard, "peel")
        complete, waiting = heard.where("remaining = 0"), heard.where("remaining > 0")
        finished.append(complete)
    totals = finished[0]
    for more in finished[1:]:
        totals = totals.unionByName(more)
    totals = totals.select("conv_id", "depth", "n_leaves", F.col("saved").alias("saved_tokens"))
    sizes = runs.groupBy("end_id", "end_depth").agg(F.count(F.lit(1)).alias("n"))
    ends = totals.select(F.col("conv_id").alias("end_id"), F.col("depth").alias("end_depth"), "n_leaves", "saved_tokens").join(sizes, ["end_id", "end_depth"])
    along = lookup(runs, staged(ends, "peel-ends"), ["end_id", "end_depth"], "n", "inner")
    along = along.select("conv_id", "depth", "n_leaves", (F.col("saved") + F.col("saved_tokens")).alias("saved_tokens"))
    return nodes.join(totals.unionByName(along), ["conv_id", "depth"])


#: Members of one node and so many consecutive ids are one piece of text.
_SPAN = 1 << 16


def member_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of each node's members, decimal, ascending, joined by commas.

    ``ends`` has one row for each member. The members of a node whose ids share all
    but 16 bits are joined first, so no list is longer than 65,536 ids; then a
    task reads a node's pieces in order and feeds them to one hash, in bounded memory.
    """
    span = F.shiftright("member", 16)
    pieces = ends.groupBy("conv_id", "depth", span.alias("span")).agg(F.array_sort(F.collect_list("member")).alias("ids"))
    pieces = pieces.select("conv_id", "depth", "span", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for conv, depth, ids in zip(*(batch[c].to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if node == (conv, depth):
                    running.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = (conv, depth), hashlib.sha256(ids.encode())
            if done:
                yield _digests(done)
        if node is not None:
            yield _digests([(*node, running.hexdigest())])

    ordered = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "span")
    return ordered.select("conv_id", "depth", "ids").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    conv, depth, hexes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(hexes, pa.string())], names=["conv_id", "depth", "ends_sha256"])
