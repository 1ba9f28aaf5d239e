"""Filter interaction audit (operator 11): a trie of filter orders with shared prefix states.

All orders of the filters form a trie. What a prefix leaves depends only on the
set of filters in it, so the trie is walked depth first and every set's
survivors, a persisted DataFrame derived from those of the prefix that reached it
first, serve all orders through it: 2^n states instead of n! paths. At every
edge the rows that its filter really removes from the survivors are counted, in
one pass for all edges of a state; counts are combined before their shuffle.

Survivors are narrow rows (part, verdicts, tallies), read from one written table
at the root; a state is released when its edges are done, so at most n + 1 are
held at once. A lost executor's blocks are derived again from that table.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace.llm.common import SPACES, lookup, shared_dir, staged


def text_measures(text: Column) -> dict[str, Column]:
    """n_words, n_distinct, n_capitals, n_chars, has_symbol of a text (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    bare = F.btrim(whole, F.lit(" \t\n\x0b\f\r"))
    words = F.split(bare, f"[{SPACES}]+")
    none = F.lit(0).cast("long")
    return {
        "n_words": F.when(bare == "", none).otherwise(F.size(words)).cast("long"),
        "n_distinct": F.when(bare == "", none).otherwise(F.size(F.array_distinct(words))).cast("long"),
        "n_capitals": F.regexp_count(whole, F.lit("[A-Z]")).cast("long"),
        "n_chars": F.char_length(whole).cast("long"),
        "has_symbol": whole.rlike("[#$%&*|]"),
    }


def mark_later_copies(docs: DataFrame, id_col: str, digest_col: str, mark: str, label: str = "filter-copies") -> DataFrame:
    """``docs`` and a boolean column: a row of the same digest has a smaller id.

    A null id is no smaller than any, and later than every other one; rows of one
    id and text are no copies of each other. Only digests of two rows or more are
    joined, and those of very many rows by broadcast (``lookup``).
    """
    ids = docs.groupBy(digest_col).agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_n"))
    table = staged(ids.where("_n > 1"), label)
    found = lookup(docs, table, [digest_col], "_n")
    own = F.col(f"`{id_col}`")
    later = F.col("_least").isNotNull() & (own.isNull() | (own > F.col("_least")))
    return found.withColumn(mark, F.coalesce(later, F.lit(False))).drop("_least", "_n")


def audit_edges(rows: DataFrame, part: str, filters: list[str], tallies: list[str], label: str = "filter-edges") -> DataFrame:
    """(part, state, filter, removed, lost_<tally>...): what each filter removes from each state's survivors.

    ``filters`` are boolean columns, true for a row that fails; ``tallies`` are
    boolean columns whose removed rows are counted as well; ``part`` has no nulls.
    ``state`` is a bit mask of the filters applied before. Parts of which a state
    has no row left have no row there.
    """
    if not 1 <= len(filters) <= 10:
        raise ValueError("1 to 10 filters")
    spark = rows.sparkSession
    root = staged(rows.select(part, *filters, *tallies), f"{label}-rows")
    folder = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    memo: set[int] = set()
    everything = (1 << len(filters)) - 1

    # one text for all states, so that they share compiled code; a filter applied before has nothing to remove
    each = [f"count_if(`{f}`) AS removed_{i}" for i, f in enumerate(filters)]
    each += [f"count_if(`{f}` AND `{t}`) AS lost_{i}_{k}" for i, f in enumerate(filters) for k, t in enumerate(tallies)]
    counted = [F.expr(x) for x in ["count(1) AS n", *each]]

    def edges_of(state: int, survivors: DataFrame) -> None:
        counts = survivors.groupBy(part).agg(*counted).withColumn("state", F.lit(state))
        counts.write.mode("append").option("compression", "zstd").parquet(folder)

    def visit(state: int, survivors: DataFrame, release: Callable[[], object]) -> None:
        memo.add(state)
        edges_of(state, survivors)
        for i, f in enumerate(filters):
            after = state | 1 << i
            # nothing is removed from what all filters have left
            if after != state and after != everything and after not in memo:
                kept = survivors.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(after, kept, kept.unpersist)
        release()

    visit(0, root, lambda: None)
    longs = [f"removed_{i} long" for i in range(len(filters))]
    longs += [f"lost_{i}_{k} long" for i in range(len(filters)) for k in range(len(tallies))]
    counts = spark.read.schema(", ".join([f"`{part}` string", "state int", "n long", *longs])).parquet(folder)
    edges = [
        f"named_struct('filter', {i}, 'removed', removed_{i}" + "".join(f", 'lost_{t}', lost_{i}_{k}" for k, t in enumerate(tallies)) + ")"
        for i in range(len(filters))
    ]
    rows = counts.select(part, "state", "n", F.expr(f"inline(array({', '.join(edges)}))"))
    return rows.where("getbit(state, filter) = 0")


def audit_orders(edges: DataFrame, part: str, names: list[str], tallies: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included, from ``audit_edges``.

    (part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    lost_<tally>..., shapley): rows of the part left after the step and removed by
    it, rows that fail its filter but were removed before, rows that fail no other
    filter, and what its filter removes summed over all orders.
    """
    n = len(names)
    if n > 6:
        raise ValueError("over 6 filters have too many orders to list")
    steps = []
    for order in itertools.permutations(range(n)):
        spelled, state = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((spelled, step, i, names[i], state))
            state |= 1 << i
    plan = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, letter string, state int")
    size = F.bit_count("state")
    orders = F.lit(0).cast("long")  # how many orders have exactly the state's filters before this one
    for k in range(n):
        orders = F.when(size == k, F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long")).otherwise(orders)
    alone = F.col("state") + F.element_at(F.lit([1 << i for i in range(n)]), F.col("filter") + 1) == F.lit((1 << n) - 1)
    of_filter = edges.groupBy(part, "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(alone, F.col("removed"))), F.lit(0).cast("long")).alias("unique_fails"),
        F.sum(orders * F.col("removed")).alias("shapley"),
    )
    # every part has a row for each filter in state 0
    rows = of_filter.join(F.broadcast(plan), "filter").join(edges.drop("n"), [part, "state", "filter"], "left")
    zero = F.lit(0).cast("long")
    removed = F.coalesce("removed", zero)
    before = edges.groupBy(part, "state").agg(F.max("n").alias("n"))
    rows = rows.join(before, [part, "state"], "left")
    return rows.select(
        part,
        "filter_order",
        "step",
        F.col("letter").alias("filter"),
        (F.coalesce("n", zero) - removed).alias("kept"),
        removed.alias("removed"),
        (F.col("fails") - removed).alias("redundant"),
        "unique_fails",
        *[F.coalesce(f"lost_{t}", zero).alias(f"lost_{t}") for t in tallies],
        "shapley",
    )
