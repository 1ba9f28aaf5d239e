"""Token counts (operator 9): separator scan of flat token files without an index.

Files hold unsigned little-endian ids, each document closed by an
end-of-document id. Blocks of all files are read in parallel and searched with
one vectorised comparison; block summaries are stitched by a prefix scan per
file, so a document may begin and end in any blocks, and a file may be of any
size. Only summaries (a row for each block) are scanned; ends stay with their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm.common import let, staged
from millrace.llm.tokens import tokenizer


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_bytes: int = 2,
) -> DataFrame:
    """Tokenise whole texts into flat files below ``folder``, one for each partition.

    Returns (file, bytes, ordinal, id), a row for each document. A file is named
    after its task attempt, so a repeated task writes another one, and only files
    of this table count. ``folder`` is a URI of a store that pyarrow can write
    (file, hdfs, s3, gs). Null texts have no ids before their end; repeated rows and
    null ids are documents like any other; an empty table writes nothing of use. An
    id that does not fit in ``item_bytes`` (2 or 4) is an error, never another id.
    """
    if item_bytes not in (2, 4) or not 0 <= end_id < 1 << 8 * item_bytes:
        raise ValueError("ids have 2 or 4 bytes, and the end id fits in them")
    id_type = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = tokenizer(tokenizer_path), f"<u{item_bytes}"
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.bin"
        ids: list = []
        written = 0
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    texts = [t.as_py() for t in batch.column(1).slice(at, 256)]
                    for raw in coder.ids_of(texts):
                        every = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id))
                        if int(every.max()) >= 1 << 8 * item_bytes:
                            raise ValueError(f"id {int(every.max())} does not fit in {item_bytes} bytes")
                        flat = every.astype(kind).tobytes()
                        out.write(flat)
                        written += len(flat)
                ids.append(batch.column(0))
        n = sum(map(len, ids))
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n),
                    pa.array([written] * n, pa.int64()),
                    pa.array(np.arange(n)),
                    pa.concat_arrays(ids),
                ],
                names=["file", "bytes", "ordinal", "id"],
            )

    schema = StructType(
        [
            StructField("file", StringType()),
            StructField("bytes", LongType()),
            StructField("ordinal", LongType()),
            StructField("id", id_type),
        ]
    )
    return staged(docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(work, schema), "token-files")


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the files of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(f.getPath().getName(), f.getLen()) for f in found if f.isFile()]
    return spark.createDataFrame(rows, "file string, bytes long")


def count_tokens(
    files: DataFrame, folder: str, end_id: int, item_bytes: int = 2, block_bytes: int = 4 << 20
) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the files (file, bytes) of ``folder``.

    ``start`` is the place of its first id in the file; ``n_tokens`` leaves the end
    id out. Ids after the last end form one more document; empty documents count,
    empty files have none. A file whose size is no multiple of ``item_bytes``
    raises an error.
    """
    step = block_bytes - block_bytes % item_bytes
    blocks = files.where("bytes > 0").select(
        "file", "bytes", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step))).alias("block", "at")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, total, block, at in zip(*(c.to_pylist() for c in batch.columns)):
                if total % item_bytes:
                    raise ValueError(f"{file}: {total} bytes are no whole ids of {item_bytes}")
                with store.open_input_file(f"{path}/{file}") as source:
                    ids = np.frombuffer(source.read_at(min(step, total - at), at), dtype=f"<u{item_bytes}")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]),
                        pa.array([block], pa.int32()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([at + step >= total]),
                        pa.array([ends], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "n", "last", "ends"],
                )

    dealt = blocks.repartition("file", "block")
    found = staged(dealt.mapInArrow(work, "file string, block int, n long, last boolean, ends array<long>"), "token-ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", "n", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("end"))
    sums = sums.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "first": F.coalesce(F.sum("k").over(before), F.lit(0))})
    sums = sums.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("end") + 1).over(before), F.lit(0)))
    joined = found.join(sums.select("file", "block", "base", "first", "open"), ["file", "block"])
    top = F.col("base") + F.col("n")
    shifted = F.transform("ends", lambda e: e + F.col("base"))
    after = F.coalesce(F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1, F.col("open"))
    every = F.when(F.col("last") & (top > after), F.concat(shifted, F.array(top))).otherwise(shifted)

    def cut(e: Column) -> Column:
        """(k, start, n) for each document that ends in the block."""

        def one(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.col("open")).otherwise(F.get(e, k - 1) + 1)
            return F.struct(k.alias("k"), start.alias("start"), (end - start).alias("n_tokens"))

        return F.transform(e, one)

    documents = joined.select("file", "first", F.inline(let(every, cut)))
    return documents.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "start", "n_tokens")
