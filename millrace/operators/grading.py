"""Grading facts by what became of the turns that used them.

Events are (run_id, seq, fact_id, kind, outcome): kind ``served`` or
``planted``; outcome ``ok``, ``failed`` or ``stopped`` of the run. Nothing is
updated in place; current values are aggregates over events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vocab as V


def tallies(events: DataFrame) -> DataFrame:
    """G1: (id, uses, wins, last_used): finished runs that a fact was served in, and those that ended well.

    A run counts once for each fact; stopped runs count for nothing.
    """
    served = events.where("kind = 'served' AND outcome <> 'stopped'")
    once = served.groupBy("fact_id", "run_id").agg(F.max(F.col("outcome") == "ok").alias("won"), F.max("ts").alias("ts"))
    return once.groupBy(F.col("fact_id").alias("id")).agg(
        F.count(F.lit(1)).alias("uses"), F.count_if("won").alias("wins"), F.max("ts").alias("last_used")
    )


def held_flags(events: DataFrame) -> DataFrame:
    """G1: (id, unproven): a good run frees what it served or planted, a bad one holds what it planted; the last counts."""
    counting = events.where("outcome = 'ok' OR (outcome = 'failed' AND kind = 'planted')")
    last = F.max_by(F.col("outcome") != "ok", F.struct("ts", "seq"))
    return counting.groupBy(F.col("fact_id").alias("id")).agg(last.alias("unproven"))


def bond_weights(events: DataFrame, cap: int = V.BOND_CAP) -> DataFrame:
    """(term, id, weight, last): good runs tie query terms to served facts; the weakest beyond the cap go.

    ``events`` has (term, fact_id, ts) for each such run. The cap is the store's
    own rule (weight, then last, then term and id); it is found by a limit, not a window.
    """
    counted = events.groupBy("term", F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("weight"), F.max("ts").alias("last"))
    return counted.orderBy(F.desc("weight"), F.desc("last"), F.asc("term"), F.asc("id")).limit(cap)


def bond_pairs(queries: DataFrame, served: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, term, id): the tokens of a query (query_id, text) that a fact it was served (query_id, id) lacks."""
    asked = queries.select("query_id", T.tokens(F.col("text")).alias("own"))
    held = facts.select("id", T.tokens(F.col("fact")).alias("words"))
    both = served.select("query_id", "id").distinct().join(asked, "query_id").join(held, "id")
    return both.select("query_id", F.explode(F.array_except("own", "words")).alias("term"), "id")


def drop_bonds(bonds: DataFrame, gone: DataFrame) -> DataFrame:
    """Bonds (term, id, ...) less those of facts (id) that are gone or were reset."""
    return bonds.join(gone.select("id"), "id", "left_anti")


def turn_marks(hits: DataFrame, queries: DataFrame, facts: DataFrame, run_id: str) -> DataFrame:
    """R1.10, G3: the marks of a recall (run_id, kind, fact_id, term): each fact served, and each bond it may earn."""
    served = hits.select("query_id", F.col("key").try_cast("long").alias("id")).where("id IS NOT NULL")
    run = F.lit(run_id).alias("run_id")
    marks = served.select(run, F.lit("served").alias("kind"), F.col("id").alias("fact_id"), F.lit(None).cast("string").alias("term")).distinct()
    bonds = bond_pairs(queries, served, facts).select(run, F.lit("bond").alias("kind"), F.col("id").alias("fact_id"), "term").distinct()
    return marks.unionByName(bonds)


def graded(marks: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn events, bond events) of marks (run_id, kind, fact_id, term) and outcomes (run_id, outcome, seq, ts).

    Stopped runs and runs without an outcome give nothing; bonds come of good runs alone.
    """
    ended = marks.join(outcomes.where("outcome <> 'stopped'"), "run_id")
    turns = ended.where("kind <> 'bond'").select("seq", "run_id", "fact_id", "kind", "outcome", "ts").distinct()
    bonds = ended.where("kind = 'bond' AND outcome = 'ok'").select("term", "fact_id", "ts").distinct()
    return turns, bonds


def grafts(record: Column) -> Column:
    """The graft log ``tree:uses:wins;...`` as an array of structs; parts that cannot be read are left out."""
    parts = F.filter(F.split(F.coalesce(record, F.lit("")), ";"), lambda p: p.rlike(rf"^({'|'.join(V.TREES)}):-?\d+:-?\d+$"))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.get(F.split(p, ":"), F.lit(0)).alias("tree"),
            F.get(F.split(p, ":"), F.lit(1)).cast("long").alias("uses"),
            F.get(F.split(p, ":"), F.lit(2)).cast("long").alias("wins"),
        ),
    )


def graft_record(record: Column, tree: Column, uses: Column, wins: Column) -> Column:
    """The log with one more owner, the last four kept; unchanged for an owner without fruit or of no known tree."""
    kept = F.transform(grafts(record), lambda g: F.concat_ws(":", g["tree"], g["uses"].cast("string"), g["wins"].cast("string")))
    entry = F.concat_ws(":", tree, uses.cast("string"), wins.cast("string"))
    longer = F.concat(kept, F.array(entry))
    tail = F.slice(longer, F.greatest(F.size(longer) - V.GRAFT_KEEP + 1, F.lit(1)), F.lit(V.GRAFT_KEEP))
    return F.when(((uses != 0) | (wins != 0)) & tree.isin(*V.TREES), F.array_join(tail, ";")).otherwise(F.coalesce(record, F.lit("")))


def tree_table(facts: DataFrame) -> DataFrame:
    """(tree, uses, wins, borne, held, facts, own, branch): each fact and each graft as one thing borne by a tree."""
    own = facts.select(
        T.tree_of(F.col("lineage")).alias("tree"),
        F.col("uses").cast("long").alias("uses"),
        F.col("wins").cast("long").alias("wins"),
        F.lit(1).alias("borne"),
        F.col("unproven").cast("int").alias("held"),
        F.lit(1).alias("own"),
        F.get(F.split("lineage", "/"), F.lit(1)).alias("branch"),
    )
    taken = facts.select(F.explode(grafts(F.col("grafted"))).alias("g")).select(
        "g.tree", "g.uses", "g.wins", F.lit(1).alias("borne"), F.lit(0).alias("held"), F.lit(0).alias("own"), F.lit(None).cast("string").alias("branch")
    )
    return own.unionByName(taken)


def _standing() -> Column:
    share = F.sum("wins") / (F.sum("uses") + 2)
    return share * ((F.sum("borne") - F.sum("held")) / F.sum("borne"))


def standing(facts: DataFrame) -> DataFrame:
    """A10: (tree, standing): the shrunk share of wins times the share not held; trees with no uses and nothing held are absent."""
    known = tree_table(facts).where("tree <> 'import'").groupBy("tree")
    graded = known.agg(_standing().alias("standing"), F.sum("uses").alias("u"), F.sum("held").alias("h"))
    return graded.where("u > 0 OR h > 0").select("tree", F.round("standing", 9).alias("standing"))


def orchard(facts: DataFrame) -> DataFrame:
    """Per tree: facts, uses, wins, held, taken, branches, standing (null where there is no evidence)."""
    rows = tree_table(facts).groupBy("tree").agg(
        F.sum("own").alias("facts"),
        F.sum("uses").alias("uses"),
        F.sum("wins").alias("wins"),
        F.sum("held").alias("held"),
        F.sum(1 - F.col("own")).alias("taken"),
        F.count_distinct("branch").alias("branches"),
        F.round(_standing(), 9).alias("s"),
    )
    graded = F.when((F.col("tree") != "import") & ((F.col("uses") > 0) | (F.col("held") > 0)), F.col("s"))
    return rows.withColumn("standing", graded).drop("s")


def last_changes(revisions: DataFrame) -> DataFrame:
    """(id, event, fact) of revisions whose text differs from the one before (null-safe): what the archive keeps."""
    order = Window.partitionBy("id").orderBy("event")
    return revisions.withColumn("before", F.lag("fact").over(order)).withColumn("n", F.row_number().over(order)).where(
        (F.col("n") > 1) & ~F.col("fact").eqNullSafe(F.col("before"))
    ).select("id", "event", F.col("before").alias("fact"))
