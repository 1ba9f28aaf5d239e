"""Sharding (operator 2): jump consistent hashing. DataFrame functions only.

A stable key and the number of shards decide the shard; there is no ring
table to store or broadcast, and with one more shard only rows for the new
shard move (about 1 in n + 1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hidden

#: The multiplier of the published jump hash's 64-bit congruential generator (fixed value).
_MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2^64, on two unsigned 32-bit halves.

    ANSI arithmetic must not overflow a signed long, so every product is of 32
    by 16 bits.
    """
    c0, c1 = _MULTIPLIER & _LOW, _MULTIPLIER >> 32
    p0 = lo * F.lit(c0 & 0xFFFF)
    p1 = lo * F.lit(c0 >> 16)
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)  # below 2^50
    carry = F.shiftright(p1, 16) + F.shiftright(low, 32)

    def product(a: Column, c: int) -> Column:
        """a * c modulo 2^32."""
        high = F.shiftleft((a * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return (a * F.lit(c & 0xFFFF)).bitwiseAND(F.lit(_LOW)) + high

    up = carry + product(lo, c1) + product(hi, c0)
    return up.bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, n_shards: int) -> Column:
    """The jump consistent hash (Lamping and Veach) of a long key: int, 0 to n_shards - 1.

    The loop runs as an aggregate over at most n_shards steps and does nothing
    once the jump has passed the last shard; the expected number of jumps is
    about ln(n_shards). A null key goes to the shard of key 0.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftright(k, 32).bitwiseAND(F.lit(_LOW)).alias("hi"),
        k.bitwiseAND(F.lit(_LOW)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next_state(s["hi"], s["lo"])
        # the state shifted right by 33 bits is the high half without its lowest bit
        step = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        taken = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), step.cast("long").alias("j"))
        return F.when(s["j"] < F.lit(n_shards), taken).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, jump, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, key_col: str, n_shards: int, order_cols: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``docs``, and shard int, grown_shard int (with one more shard), slot long.

    Slots are gapless from 0 in every shard. No task holds a whole shard: each
    shard is cut into ``parts`` by a hash of the key and order columns, rows are
    numbered within a part, and the parts' counts (n_shards * parts rows, summed
    on the map side) are added up to offsets. Rows that agree in the key and all
    order columns go to one part and are interchangeable there. New columns whose
    names are taken get a trailing underscore. Null keys count as key 0.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(16, math.ceil(4 * width / n_shards))
    shard, grown, slot = (hidden(docs.columns, c) for c in ("shard", "grown_shard", "slot"))
    part = hidden([*docs.columns, shard, grown, slot], "_part")
    base = hidden([*docs.columns, shard, grown, slot, part], "_base")
    key = F.col(f"`{key_col}`")
    order = [F.col(f"`{c}`") for c in (key_col, *order_cols)]
    dealt = docs.withColumns(
        {
            shard: jump_hash(key, n_shards),
            grown: jump_hash(key, n_shards + 1),
            part: F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"),
        }
    )
    counts = dealt.groupBy(shard, part).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(shard, part).orderBy(*order)
    numbered = dealt.withColumn(slot, F.row_number().over(within).cast("long") - 1)
    # at most n_shards * parts rows of three numbers
    joined = numbered.join(F.broadcast(offsets), [shard, part])
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], shard, grown, (F.col(slot) + F.col(base)).alias(slot))
