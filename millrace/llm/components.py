"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return (
        both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge and is not the least of its component.

    ``edges`` has two columns of one orderable type. Self-edges and repeated
    edges are allowed; an empty table gives an empty one; edges with a null end
    are ignored. Minima are combined before each shuffle, and neighbourhoods are
    never gathered, so a hub with any number of edges is no hot spot for memory.
    Each round is written to the shared folder, which cuts the lineage; only a
    count and a checksum come to the driver.
    """
    a, b = edges.columns
    now = staged(
        edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("src > dst")
        .distinct(),
        label,
    )
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        seen = mark
        now = staged(_small_star(_large_star(now)), label)
