"""Helpers shared by the corpus operators: input tables, staged tables, lets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words in texts: space, \t, \n, \v, \f, \r (as a Java and RE2 class).
SPACES = " \\t\\n\\x0B\\f\\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``documents``, spread over all cores when its files give fewer splits than there are cores."""
    docs = read_table(spark, sf_dir, "documents").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        docs = docs.repartition(2 * cores)
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a session in one process gets a folder of this machine; on
    a cluster that is an error, since no executor could read it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts lineage: what reads the result survives the loss of any executor
    without recomputing, and sees the same rows each time even where ``df``
    depends on the order in which a shuffle delivers rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than one in so many rows, so there are fewer hot keys than this.
_HOT = 1024


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """``rows`` joined (left or inner) with ``table``, which has one row for each of its keys.

    ``weight`` is a column of the table: how many rows have the key. The keys that
    hold over 1/1024 of all those rows, fewer than 1024, are broadcast, so that the
    rows of a hot key stay in their tasks; all others are joined by shuffle. Key
    columns must not be null. ``table`` is read several times, so it should be staged.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * _HOT > total
    often = F.broadcast(table.where(hot).drop(weight))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot).drop(weight), keys, how)
    return rows.join(often, keys).unionByName(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hidden(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column of the input has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def totals_before(
    rows: DataFrame, group: list[str], order: list[Column], values: dict[str, Column], label: str, xor: bool = False
) -> DataFrame:
    """``rows`` and, for each of ``values``, its sum (or exclusive or) over the group's rows before this one.

    No task holds a whole group: rows are sorted over all partitions (a row number
    ends the order, so even equal rows are split), totals run within a partition's
    part of a group, and the parts' totals are added up. Only groups that a
    partition boundary cuts have such totals to add, at most two rows for each
    partition; these are broadcast. Null keys are a group. Values are longs.
    """
    block, row = hidden([*rows.columns, *values], "_block"), hidden([*rows.columns, *values], "_row")
    total = F.bit_xor if xor else F.sum
    laid = rows.withColumns({row: F.monotonically_increasing_id(), **values})
    keys = [F.col(f"`{c}`") for c in group]
    # written down because the boundaries come from a sample
    laid = staged(laid.repartitionByRange(*keys, *order, row).withColumn(block, F.spark_partition_id()), label)
    keys = [F.col(f"`{c}`") for c in group]
    parts = laid.groupBy(*keys, block).agg(*[total(v).alias(f"_{v}") for v in values])
    all_parts = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = all_parts.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *[k.alias(f"_group{i}") for i, k in enumerate(keys)],
        F.col(block).alias("_in"),
        F.count(F.lit(1)).over(all_parts).alias("_parts"),
        *[total(f"_{v}").over(earlier).alias(f"_{v}") for v in values],
    ).where("_parts > 1")
    here = Window.partitionBy(*keys, block).orderBy(*order, row).rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumns({v: F.coalesce(total(v).over(here), F.lit(0).cast("long")) for v in values})
    same = F.col(block) == F.col("_in")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_group{i}"))
    before = {v: F.coalesce(F.col(f"_{v}"), F.lit(0).cast("long")) for v in values}
    return local.join(F.broadcast(carried), same, "left").select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[(F.col(v).bitwiseXOR(b) if xor else F.col(v) + b).alias(v) for v, b in before.items()],
    )
