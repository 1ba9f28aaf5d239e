"""Benchmark decontamination (operator 6): a prefix-filtered set join of item windows and documents.

1. Items are cut into windows of ``window`` consecutive words (a shorter item
   is one window). Word counts over all documents order each window's words by
   rarity. To be contained, a window needs all of its words in the document, so
   its prefix is one word: the rarest.
2. Documents are probed at the occurrences of prefix words only. The word's
   place in the window fixes where the window would start (positional bound),
   and it must end inside the text (length bound).
3. Survivors are verified exactly, word by word, over the window.

The benchmark is the stated query set. Its windows are sent to every task only
while their measured size is within ``broadcast_bytes``; beyond it they are dealt
into slices by a hash of the whole window, so that no word gathers many in one,
and the documents are probed slice by slice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from millrace.llm.common import hidden, staged

#: Lower-cases A-Z and makes every ASCII character that is no letter or digit a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _items(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, words array<binary>): each distinct window of every item that has an id and words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cut = [], []
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                if item.as_py() is None or not words:
                    continue
                own = {tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))}
                ids += [item] * len(own)
                cut += own
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py() for x in ids], batch.schema.field(0).type), pa.array(cut, pa.list_(pa.binary()))],
                names=["item_id", "words"],
            )

    schema = StructType(
        [StructField("item_id", benchmark.schema[id_col].dataType), StructField("words", ArrayType(BinaryType()))]
    )
    return benchmark.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(work, schema)


def _word_counts(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the items occurs in all documents; summed before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Vocabulary((w, k) for k, w in enumerate(sorted(shared.value)))
        total = np.zeros(len(index) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = np.fromiter(map(index.__getitem__, words_of(text.as_py())), dtype=np.int64)
                total += np.bincount(found + 1, minlength=len(total))
        hit = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[1:][hit])], names=["k", "n"])

    sums = docs.select(f"`{text_col}`").mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    order = sorted(vocabulary)
    return {order[r["k"]]: r["n"] for r in sums.collect()}  # one row for each word of the items at most


def _slices(windows: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """(buckets, first, last) of each slice: ranges of hash buckets whose measured size is at most ``most`` bytes.

    Only a bucket that is too large by itself, with one window of very many items, is a slice beyond that.
    """
    size = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w) + 48) + 48
    total = windows.select(F.sum(size)).first()[0] or 0
    if total <= most:
        return [(1, 0, 0)]
    buckets = 64 * (-(-total // most))
    sums = windows.groupBy(F.pmod(F.xxhash64("words"), F.lit(buckets)).alias("k")).agg(F.sum(size).alias("n"))
    out, first, used = [], 0, 0
    for k, n in sorted((r["k"], r["n"]) for r in sums.collect()):  # 64 rows for each slice
        if used and used + n > most:
            out.append((buckets, first, k - 1))
            first, used = k, 0
        used += n
    return [*out, (buckets, first, buckets - 1)]


class WindowIndex:
    """Windows under their rarest word, as word numbers."""

    def __init__(self, windows: dict[tuple[bytes, ...], list], counts: dict[bytes, int]):
        words = sorted({w for key in windows for w in key})
        self.number = _Vocabulary((w, k) for k, w in enumerate(words))
        self.prefix: dict[int, dict[tuple[int, int], dict[tuple[int, ...], list]]] = {}
        for key, items in windows.items():
            ids = tuple(self.number[w] for w in key)
            at = min(range(len(key)), key=lambda k: (counts.get(key[k], 0), key[k], k))
            places = self.prefix.setdefault(ids[at], {})
            places.setdefault((at, len(ids)), {})[ids] = items
        self.is_prefix = np.zeros(len(words) + 1, dtype=bool)
        self.is_prefix[list(self.prefix)] = True  # the last stays False: other words have the number -1

    def probe(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items with an occurring window."""
        hit = np.zeros(len(words), dtype=bool)
        items: set = set()
        ids = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        for p in np.flatnonzero(self.is_prefix[ids]):
            for (at, size), known in self.prefix[int(ids[p])].items():
                start = p - at
                if start < 0 or start + size > len(ids):
                    continue
                found = known.get(tuple(ids[start : start + size].tolist()))
                if found is not None:
                    hit[start : start + size] = True
                    items.update(found)
        return hit, items


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """All columns of ``docs``, and n_words long, spans array<struct<start, length>> (words), item_ids array.

    Spans are maximal runs of hit words. Null or empty texts have no words and no
    spans; items without id or words are ignored; repeated items and windows
    count once for each item id; an empty benchmark hits nothing. New columns
    whose names are taken get a trailing underscore.
    """
    spark = docs.sparkSession
    windows = staged(_items(benchmark, item_id_col, item_text_col, window), "windows")
    slices = _slices(windows, broadcast_bytes)
    names = [hidden(docs.columns, c) for c in ("n_words", "spans", "item_ids")]
    item_type = windows.schema["item_id"].dataType
    span_type = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))
    out = StructType(
        [
            *docs.schema.fields,
            StructField(names[0], LongType()),
            StructField(names[1], span_type),
            StructField(names[2], ArrayType(item_type)),
        ]
    )
    at = docs.columns.index(text_col)
    n_columns = len(docs.columns)
    probed = docs
    for k, (buckets, low, high) in enumerate(slices):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(buckets)).between(low, high))
        table: dict[tuple[bytes, ...], list] = defaultdict(list)
        for row in part.collect():
            table[tuple(map(bytes, row["words"]))].append(row["item_id"])
        counts = _word_counts(docs, text_col, {w for key in table for w in key}) if table else {}
        index = spark.sparkContext.broadcast(WindowIndex(table, counts))

        def work(batches: Iterator[pa.RecordBatch], index=index, first=k == 0) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            probe = index.value.probe
            spans_type, ids_type = to_arrow_type(span_type), to_arrow_type(ArrayType(item_type))
            for batch in batches:
                total, spans, items = [], [], []
                for row in range(batch.num_rows):
                    own = words_of(batch.column(at)[row].as_py())
                    hit, found = probe(own)
                    if not first:
                        for s in batch.column(n_columns + 1)[row].as_py():
                            hit[s["start"] : s["start"] + s["length"]] = True
                        found |= set(batch.column(n_columns + 2)[row].as_py())
                    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    total.append(len(own))
                    spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                    items.append(sorted(found))
                columns = [batch.column(i) for i in range(n_columns)]
                new = [pa.array(total, pa.int64()), pa.array(spans, spans_type), pa.array(items, ids_type)]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=out.names)

        probed = probed.mapInArrow(work, out)
        if k + 1 < len(slices):
            probed = staged(probed, "probed")  # one index in memory at a time
    return probed
