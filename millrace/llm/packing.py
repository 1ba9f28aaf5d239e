"""Packing (operator 4): bounded-space online packing of token ids into fixed windows.

Every partition keeps at most ``open_windows`` open windows. A document is cut
into full windows and a rest; the rest goes to the open window that it fits
best; when it fits none, a new window opens, and if there is no room for one the
fullest is emitted first. What is still open when a partition ends is merged:
partitions are dealt to groups of bounded size, each group packs its leftover
pieces anew (longest first, best fit) and tops up windows by cutting a piece,
so that padding remains in one window of each group at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from millrace.llm.common import hidden, staged
from millrace.llm.tokens import tokenizer

#: Texts tokenised at once, by their characters.
_CHARS = 1 << 20
_PIECE = (
    ("start", LongType()),
    ("length", LongType()),
    ("ids", BinaryType()),
    ("doc_tokens", LongType()),
    ("sequence_id", LongType()),
    ("offset", LongType()),
)


class OpenWindows:
    """At most ``most`` open windows of ``size`` tokens; pieces are placed best-fit.

    ``place`` returns the number and fill of the window that takes the piece, and
    the number of the window that was closed to make room for it, if any.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most, self.next = size, most, 0
        self._free: list[tuple[int, int]] = []  # (room, window), sorted

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int, int | None]:
        at = bisect_left(self._free, (length, -1))
        closed = None
        if at < len(self._free):
            room, window = self._free.pop(at)
        else:
            if len(self._free) == self.most:
                closed = self._free.pop(0)[1]
            room, window = self.size, self.new()
        offset = self.size - room
        if room > length:
            insort(self._free, (room - length, window))
        return window, offset, closed

    def open(self) -> set[int]:
        return {w for _, w in self._free}


def _pieces_schema(docs: DataFrame, id_col: str, extra: bool) -> StructType:
    fields = [StructField("id", docs.schema[id_col].dataType), *(StructField(n, t) for n, t in _PIECE)]
    return StructType([*fields, *([StructField("part", IntegerType())] if extra else [])])


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    separator: int = 2,
    open_windows: int = 64,
    merge_partitions: int = 8,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers; a
    document's ids are those of its whole text and ``separator`` (null or empty
    texts: the separator alone). Pieces of one sequence have offsets without gaps
    from 0; sequences hold at most ``window`` ids and are meant to be padded to
    it. Rows are independent, so repeated rows and null ids are packed like any
    other; an empty table gives an empty one; other columns are ignored.

    ``part`` numbers restart with each call. Memory for a partition is its open
    windows and one batch; for a merge group ``merge_partitions * open_windows``
    windows. The first step's result is written to the shared folder, so its
    decisions hold when executors are lost.
    """

    names = ("id", *(n for n, _ in _PIECE))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder, space = tokenizer(tokenizer_path), OpenWindows(window, open_windows)
        end = np.array([separator], dtype="<u4").tobytes()
        held: dict[int, list[tuple]] = {}
        base = part << 32

        def table(rows: list[tuple], parted: bool) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[] for _ in range(7)]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array([part if parted else None] * len(rows), pa.int32())], names=[*names, "part"]
            )

        types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            types[0] = batch.schema.field(0).type
            done: list[tuple] = []
            texts: list[str | None] = []
            ids: list = []
            chars = 0
            for row in range(batch.num_rows):
                texts.append(batch.column(1)[row].as_py())
                ids.append(batch.column(0)[row].as_py())
                chars += len(texts[-1] or "")
                if chars < _CHARS and row + 1 < batch.num_rows:
                    continue
                for doc, raw in zip(ids, coder.ids_of(texts)):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        n = min(window, total - start)
                        piece = raw[4 * start : 4 * (start + n)]
                        if n == window:
                            done.append((doc, start, n, piece, total, base + space.new(), 0))
                            continue
                        w, offset, closed = space.place(n)
                        if closed is not None:
                            done += held.pop(closed)
                        held.setdefault(w, []).append((doc, start, n, piece, total, base + w, offset))
                        if offset + n == window:
                            done += held.pop(w)
                if done:
                    yield table(done, False)
                texts, ids, chars, done = [], [], 0, []
        if held:
            yield table([p for w in held.values() for p in w], True)

    def merge(_: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        """Pack a group's leftover pieces anew; window numbers of its lowest partition are used again."""
        pieces = pieces.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        own = iter(sorted(set(pieces["sequence_id"])))
        rows = list(pieces[list(names)].itertuples(index=False, name=None))
        out: list[tuple] = []
        room, number = 0, -1
        left: list[tuple[int, int]] = sorted((r[2], k) for k, r in enumerate(rows))
        while left:
            if room == 0:
                room, number = window, next(own)
            at = bisect_left(left, (room + 1, -1)) - 1
            if at >= 0:
                n, k = left.pop(at)
                out.append((*rows[k][:5], number, window - room))
                room -= n
                continue
            n, k = left.pop(0)  # the shortest is longer than the room: cut it
            doc, start, _, ids, total = rows[k][:5]
            out.append((doc, start, room, ids[: 4 * room], total, number, window - room))
            rows[k] = (doc, start + room, n - room, ids[4 * room :], total, 0, 0)
            insort(left, (n - room, k))
            room = 0
        return pd.DataFrame(out, columns=list(names))

    packed = staged(
        docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(work, _pieces_schema(docs, id_col, True)), "packing"
    )
    closed = packed.where("part IS NULL").drop("part")
    group = F.floor(F.col("part") / merge_partitions).alias("g")
    merged = packed.where("part IS NOT NULL").groupBy(group).applyInPandas(merge, _pieces_schema(docs, id_col, False))
    return closed.unionByName(merged).withColumnRenamed("id", hidden([n for n, _ in _PIECE], id_col))
