"""Mixing sources to target weights (operator 13): Efraimidis-Spirakis sampling. DataFrame functions only.

Every source has a budget of words, its target. Whole epochs of the source come
first; the rest of the budget is filled by weighted sampling without
replacement: every document draws an exponential key scaled by its quality, the
source is sorted by key, and documents are taken until the prefix sum of their
sizes reaches the rest. The document at that border gives its first words only.

A source is sorted over all partitions (``totals_before``), so one source may
hold any share of the rows; so are the sources themselves, whose number is not
bounded. Only sums over all sources come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hidden, lookup, staged, totals_before


def uniform(key: Column) -> Column:
    """A number above 0 and below 1 from the first 52 bits of the MD5 of a string: the same in every run."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size, one row each) and target double, budget long.

    Sources in the order of their code points, null last, get ``weights`` in turn
    and share the sum of all sizes by weight. A target stops at ``max_epochs`` times
    its source's size, and what it leaves is shared by weight among the others,
    until none is above. In the order of size by weight the sources that stop are
    the first ones, so prefix sums decide where the last of them is.
    """
    place = [F.col("source").isNull(), F.col("source")]
    ranked = totals_before(sources, [], place, {"rank": F.lit(1).cast("long")}, "mix-ranks")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = ranked.select(
        "source",
        "source_size",
        F.get(cycle, (F.col("rank") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).alias("most"),
    )
    filled = [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = {"full": F.col("most"), "spent": F.col("weight")}
    filling = staged(totals_before(weighed, [], filled, before, "mix-filling"), "mix-sources")
    size, weight = filling.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = (F.lit(size).cast("double") - F.col("full")) * F.col("weight") / (F.lit(weight).cast("double") - F.col("spent"))
    stops = F.col("most") <= share
    full, spent = filling.where(stops).agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = F.lit(size - full).cast("long"), F.lit(max(1, weight - spent)).cast("long")
    target = F.when(stops, F.col("most").cast("double")).otherwise(
        F.least(F.col("most").cast("double"), (F.col("weight") * rest).cast("double") / left.cast("double"))
    )
    return filling.select("source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("budget"))


def mix_sources(
    docs: DataFrame,
    key_col: str,
    source_col: str = "source",
    size_col: str = "size",
    quality_col: str = "quality",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
) -> DataFrame:
    """All columns of ``docs``, and source_size long, target double, taken long.

    ``taken`` is how much of the document the mix takes, repeats counted: its size
    for each whole epoch of its source, and once more (or a part, at the border) if
    the sample takes it. A source's ``taken`` adds up to its target, rounded. A null
    source is a source of its own; a null or negative size counts as 0. ``key_col``
    is a string (null: empty) that tells documents apart: equal ones draw the same
    key, and ties fall by size, so rows of one key and size are interchangeable and
    reruns agree. The quality scales the chance to be sampled; null, zero or less
    comes last. An empty table gives an empty one. ``docs`` is read twice and should
    be narrow. New columns whose names are taken get a trailing underscore.
    """
    if not weights or min(weights) < 1 or max_epochs < 1:
        raise ValueError("weights and max_epochs must be positive")
    names = {c: hidden(docs.columns, c) for c in ("source_size", "target", "taken")}
    own = [f"_c{i}" for i in range(len(docs.columns))]
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    quality = F.greatest(F.coalesce(F.nanvl(F.col(f"`{quality_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1e-12))
    drawn = -F.ln(uniform(F.coalesce(F.col(f"`{key_col}`"), F.lit("")))) / quality
    source = F.col(f"`{source_col}`")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)],
        source.isNull().alias("no_source"),
        F.coalesce(source.cast("string"), F.lit("")).alias("named"),
        size.alias("size"),
        drawn.alias("drawn"),
    )
    rows = staged(rows, "mix-rows")
    sums = rows.groupBy("no_source", "named").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = staged(sums, "mix-sizes")
    shared = source_targets(sums.select(F.when(~F.col("no_source"), F.col("named")).alias("source"), "source_size"), weights, max_epochs)
    keyed = shared.select(
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("named"), "source_size", "target", "budget"
    )
    table = staged(keyed.join(sums.drop("source_size"), ["no_source", "named"]), "mix-targets")
    order = [F.col("drawn"), F.col("size")]
    placed = totals_before(rows, ["no_source", "named"], order, {"_before": F.col("size")}, "mix-order")
    found = lookup(placed, table, ["no_source", "named"], "n", "inner")
    # a source without words has no budget
    rest = F.expr("budget % greatest(source_size, 1L)")
    once = F.least(F.col("size"), F.greatest(rest - F.col("_before"), F.lit(0).cast("long")))
    whole = F.expr("budget div greatest(source_size, 1L)")
    return found.select(
        *[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)],
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
        (F.col("size") * whole + once).cast("long").alias(names["taken"]),
    )
