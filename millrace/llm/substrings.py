"""Suffix-array dedup (operator 5): byte strings that also start in an earlier document, removed.

All suffixes that can matter are sorted by a difference-cover algorithm to a
depth of ``length`` bytes, dealt to tasks so that equal strings meet:

1. Exact copies of a text are set apart by 128-bit hashes (all of it is removed).
   The other texts form chunks.
2. A content-defined sample of positions (the least of the 24-byte hashes in
   each ``length``-byte string) decides which task sorts a string: equal strings
   have their sample at the same place. Sample hashes that lie in one text only
   are discarded: no string around them can repeat. Chunks exchange sorted arrays
   of hashes and get back a bit for each.
3. Around every remaining sample a chunk cuts the record that holds all strings
   with that sample (equal records of a chunk once, with their least document),
   and sends it to the task of its hash.
4. That task sorts the suffixes of its records (``suffix_array``): triples at two
   of three places are sorted and named, the names are sorted by recursion, the
   remaining suffixes are merged. Adjacent suffixes are compared to ``length``
   bytes; the least document of those that agree decides.
5. The chunks turn the answers into removed spans.

Only hashes, records around shared samples and bits are shuffled; texts are
written to the shared folder once and read from there by place. A passage that a
third of all documents share is one record in each chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, staged

_GRAM = 24
_CHUNK = 2 << 20
_LAST = np.iinfo(np.int64).max
_PLACE = ("chunk", "ids", "sizes", "file", "at", "length")
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8-byte word (little endian) at each byte."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def samples(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(places, hashes, first, last): sampled positions and the range of string starts each one serves.

    ``data`` holds texts one after another. A string that starts at q has the
    leftmost of the least hashes within it as its sample.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(data)
    if n < length:
        return none
    w = _words(data)
    m = n - _GRAM + 1
    h = w[:m] * _A
    h += w[8 : m + 8] * _B
    h ^= h >> np.uint64(29)
    h += w[16 : m + 16] * _C
    h *= _D
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)  # the lowest bit is free for a flag
    width = length - _GRAM + 1
    # position in the low bits: a minimum is the leftmost of the least hashes, and says where it is;
    # their number is fixed, so the choice in a string does not depend on the size of the data
    if n >> 32:
        raise ValueError("data of 4 GB or more")
    bits = np.uint64(32)
    marked = h >> bits << bits | np.arange(m, dtype=np.uint64)
    low = _slide(marked, width, np.minimum)  # one for each string start
    valid = np.zeros(len(low), dtype=bool)
    for s, k in zip(starts.tolist(), sizes.tolist()):
        if k >= length:
            valid[s : s + k - length + 1] = True
    q = np.flatnonzero(valid)
    if not len(q):
        return none
    place = (low[q] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[edge], h[place[edge]], q[edge], q[np.r_[edge[1:], len(q)] - 1]


def records(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """One row for each sample: reach bytes before it and ``length`` from it; bytes outside its strings are 0.

    Two more bytes hold the range of its strings' starts in the row.
    """
    reach = length - _GRAM
    width = reach + length
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
    lo, hi = first - (place - reach), last - (place - reach)
    out = np.zeros((len(place), width + 2), dtype=np.uint8)
    out[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[place]
    column = np.arange(width, dtype=np.uint8)
    out[:, :width][(column < lo.astype(np.uint8)[:, None]) | (column >= (hi + length).astype(np.uint8)[:, None])] = 0
    out[:, width], out[:, width + 1] = lo, hi
    return out


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each group, group of each row) of equal rows, in an order that their contents decide.

    Rows are sorted by a 64-bit hash and compared in full with their neighbour; rows
    that share a hash by chance may make more groups, which costs nothing but work.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    words[:, :width] = rows
    key = np.zeros(n, dtype=np.uint64)
    for k in range(words.shape[1] // 8):
        key = (key ^ words[:, 8 * k : 8 * k + 8].copy().view("<u8")[:, 0]) * _A
        key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    s = rows[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    back = np.empty(n, dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _order(keys: np.ndarray) -> np.ndarray:
    """The places of the keys (not negative) in stable order; where key and place fit in one word, as one plain sort."""
    bits = max(1, len(keys) - 1).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys, from 1."""
    top = int(keys.max(initial=0)) + 1
    if top <= 1 << 24 and len(keys) > 1 << 16:
        known = np.zeros(top, dtype=bool)
        known[keys] = True
        return np.cumsum(known, dtype=np.int32)[keys].astype(np.int64)
    order = _order(keys)
    out, s = np.empty(len(keys), dtype=np.int64), keys[order]
    out[order] = np.cumsum(np.r_[True, s[1:] != s[:-1]]) if len(keys) else 0
    return out


def _paired(first: np.ndarray, second: np.ndarray, top: int) -> np.ndarray:
    """One number for each pair, in the order of the pairs; ``top`` is above every second number."""
    if (int(first.max(initial=0)) + 1) * top >= 1 << 62:
        first = _ranks(first)
    return first * top + second


def suffix_array(text: np.ndarray, depth: int, covered: int = 1) -> np.ndarray:
    """The starts of all suffixes of ``text`` (numbers from 0), sorted to ``depth`` by the difference cover {1, 2} mod 3.

    Triples at the sampled places are sorted and named; while names repeat and do
    not cover ``depth`` yet, the names are sorted as a text of their own. The other
    suffixes are sorted by their first number and the name that follows, and merged
    with either sampled class. A number stands for ``covered`` places; suffixes
    that agree to ``depth`` come next to each other, in any order. The text must
    end in zeros for ``2 * depth`` places.
    """
    n = len(text)
    t = np.concatenate([text, np.zeros(3, np.uint8)]).astype(np.int64)
    top = int(t.max()) + 1
    one, two, rest = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sampled = np.concatenate([one, two])
    name = _ranks(_paired(_paired(t[sampled], t[sampled + 1], top), t[sampled + 2], top))
    if 3 * covered < depth and int(name.max(initial=0)) < len(name):
        zero = np.zeros(1, np.int64)  # closes either class
        order = suffix_array(np.concatenate([name[: len(one)], zero, name[len(one) :], zero]), depth, 3 * covered)
        order = order[(order != len(one)) & (order != len(name) + 1)]
        order -= order > len(one)
    else:
        order = _order(name)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    top_rank = len(order) + 1
    # a suffix of the rest against class one: a number and a rank; against class two: two numbers and a rank
    # either class in the order of its ranks, so that the searches go through memory in order
    ordered = sampled[order]
    one, two = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    k = len(rest)
    near = _paired(t[rest], rank[rest + 1], top_rank)
    ones = t[one] * top_rank + rank[one + 1]
    both = np.concatenate([rest, two])
    far = _paired(_paired(t[both], t[both + 1], top), rank[both + 2], top_rank)
    far, twos = far[:k], far[k:]
    by = _order(near)
    near, rest, far = near[by], rest[by], far[by]
    place = np.empty(n, dtype=np.int64)
    place[rest] = np.arange(k) + np.searchsorted(np.sort(ones), near) + np.searchsorted(np.sort(twos), far)
    place[one] = rank[one] - 1 + np.searchsorted(near, ones, side="right")
    place[two] = rank[two] - 1 + np.searchsorted(np.sort(far), twos, side="right")
    out = np.full(n, -1)
    out[place] = np.arange(n)
    # suffixes that agree to the depth may share a place
    return out if (out >= 0).all() else _order(place)


def least_documents(rows: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, least): for each string that starts in a record, the least document with an equal string.

    The records are one text, whose suffixes are sorted; strings are the prefixes
    of neighbours that agree in ``length`` bytes.
    """
    width = 2 * length - _GRAM
    lo, hi = rows[:, width].astype(np.int64), rows[:, width + 1].astype(np.int64)
    count = hi - lo + 1
    row = np.repeat(np.arange(len(rows)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    if not len(row):
        return row, start, np.zeros(0, np.int64)
    # of a record only the bytes of its strings: count + length - 1 of them, from lo
    column = np.arange(width)
    used = (column >= lo[:, None]) & (column < (hi + length)[:, None])
    text = np.concatenate([rows[:, :width][used], np.zeros(2 * length, np.uint8)])
    begin = np.cumsum(count + length - 1) - (count + length - 1)
    at = begin[row] + start - lo[row]
    string = np.full(len(text), -1)
    string[at] = np.arange(len(row))
    order = string[suffix_array(text, length)]
    order = order[order >= 0]
    at, word = at[order], _words(text)
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for k in (*range(0, length - 7, 8), length - 8):
        own = word[at + k]
        new[1:] |= own[1:] != own[:-1]
    least = np.minimum.reduceat(docs[row[order]], np.flatnonzero(new))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = least[np.cumsum(new) - 1]
    return row, start, out


class _Chunk:
    """The texts of a chunk row, their samples, and the records around shared ones."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, length: int):
        self.ids, self.sizes, self.length = ids, sizes, length
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.cumsum(sizes) - sizes
        self.place, self.hash, self.first, self.last = samples(self.data, self.starts, sizes, length)
        self.doc = np.searchsorted(self.starts, self.place, side="right") - 1
        while len(self.doc) and (self.sizes[self.doc] == 0).any():  # empty texts share their start with the next
            self.doc = np.where(self.sizes[self.doc] == 0, self.doc - 1, self.doc)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, more): the distinct sample hashes in order, and whether each lies in more than one text."""
        order = np.lexsort((self.doc, self.hash))
        h, d = self.hash[order], self.doc[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        more = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at) if len(at) else np.zeros(0, bool)
        return h[at], more

    def keep(self, shared: np.ndarray) -> None:
        """Drop the samples whose hash is not in ``shared`` (sorted)."""
        own = _member(self.hash, shared)
        self.place, self.hash, self.first, self.last, self.doc = (
            x[own] for x in (self.place, self.hash, self.first, self.last, self.doc)
        )

    def unique_records(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, hashes, least document, record of each sample)."""
        rows = records(self.data, self.place, self.first, self.last, self.length)
        at, back = _grouped(rows)
        least = np.full(len(at), _LAST)
        np.minimum.at(least, back, self.ids[self.doc])
        return rows[at], self.hash[at], least, back


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _deal(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _chunks(docs: DataFrame, folder: str) -> DataFrame:
    """(chunk, ids, sizes, file, at, length): rows of (id, text) in chunks of some MB, whose bytes lie in files of ``folder``.

    A file is named after its task attempt, so a repeated task writes another one
    and only files of this table count. Texts are written once and read from there
    by place: no later step shuffles them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, at, size = task.partitionId() << 32, 0, 0
        ids: list[int] = []
        texts: list[bytes] = []
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        rows: list[tuple] = []
        out = None
        for batch in chain(batches, (None,)):
            for k in range(batch.num_rows if batch is not None else 1):
                text = (batch.column(1)[k].as_py() or "").encode() if batch is not None else b""
                if texts and (batch is None or size + len(text) > _CHUNK):
                    blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
                    out = out or store.open_output_stream(f"{path}/{name}")
                    out.write(blob)
                    rows.append((number, ids, [len(t) for t in texts], name, at, len(blob)))
                    number, at, ids, texts, size = number + 1, at + len(blob), [], [], 0
                if batch is not None:
                    doc = batch.column(0)[k].as_py()
                    ids.append(_LAST if doc is None else doc)
                    texts.append(text)
                    size += len(text)
        if out:
            out.close()
        if rows:
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["chunk", "ids", "sizes", "file", "at", "length"])

    schema = "chunk long, ids array<long>, sizes array<long>, file string, at long, length long"
    return docs.select("id", "text").mapInArrow(work, schema)


def _reader(folder: str) -> Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray, bytes]]:
    """A function that gives (ids, sizes, bytes) of row k of a batch of chunks."""
    store, path = pa.fs.FileSystem.from_uri(folder)

    def read(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, bytes]:
        ids, sizes, file, at, length = (batch.column(batch.schema.get_field_index(c))[k] for c in ("ids", "sizes", "file", "at", "length"))
        own = sizes.values.to_numpy(zero_copy_only=False)
        with store.open_input_file(f"{path}/{file.as_py()}") as source:
            blob = source.read_at(length.as_py(), at.as_py())
        size = int(own.sum())
        data = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        return ids.values.to_numpy(zero_copy_only=False), own, data

    return read


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, spans array<struct<start, length>>, kept binary) for every row.

    A byte is removed if a ``length``-byte string (48 to 72) of UTF-8 that covers it
    also starts in a row with a smaller id; ``spans`` are the maximal removed runs and
    ``kept`` the remaining bytes. Ids are integers; null ids count as the largest
    and come back null. Null texts are empty; repeated rows (one id) never remove
    each other's bytes; an empty table gives an empty one; other columns are ignored.
    """
    if not 48 <= length <= 72:
        raise ValueError("strings of 48 to 72 bytes are supported")
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(_LAST))).alias("id"),
        text.alias("text"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )
    groups = rows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("high > low")
    copies = staged(groups.select("h1", "h2", "low"), "repeats-copies")
    marked = rows.join(copies, ["h1", "h2"], "left")
    alone = marked.where("low IS NULL OR low = id")
    folder = f"{shared_dir(spark)}/millrace/repeats-texts-{uuid.uuid4().hex}"
    chunks = staged(_chunks(alone, folder), "repeats-chunks")
    # a chunk has about 1.2 MB of sample hashes, so parts follow the chunks: some 40 MB of hashes each
    n_chunks = chunks.count()
    hash_parts = max(width, -(-n_chunks // 32))
    record_parts = 8 * hash_parts
    # rows of chunks are small, the work on one is not: spread them evenly
    tasks = max(1, min(n_chunks, record_parts))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                h, more = _Chunk(*read(batch, k), length).distinct()
                part = _deal(h, hash_parts)
                h = h ^ (~more).astype(np.uint64)  # the lowest bit stays set where one chunk has it in more texts
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(hash_parts + 1))
                blobs = [h[order[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                used = [p for p in range(hash_parts) if blobs[p]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([batch.column(0)[k].as_py()] * len(used), pa.int64()), pa.array([blobs[p] for p in used], pa.binary())],
                    names=["part", "chunk", "hashes"],
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk, those of its hashes in this task that other texts have too."""
        chunk, blob, parts = [], [], []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            chunk += batch.column(1).to_pylist()
            blob += [np.frombuffer(b.as_py(), dtype="<u8") for b in batch.column(2)]
        if not blob:
            return
        every = np.concatenate(blob)
        flag, base = every & np.uint64(1), every | np.uint64(1)
        order = np.argsort(base, kind="stable")
        s = base[order]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        often = np.diff(np.r_[new, len(s)]) > 1
        good = s[new][often | np.logical_or.reduceat(flag[order].astype(bool), new)]
        for c, b in zip(chunk, blob):
            own = b | np.uint64(1)
            own = own[_member(own, good)]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "hashes"])

    dealt = chunks.repartition(tasks).mapInArrow(hashes, "part int, chunk long, hashes binary")
    found = dealt.repartition(hash_parts, "part").mapInArrow(shared, "chunk long, hashes binary")
    bits = staged(found.groupBy("chunk").agg(F.collect_list("hashes").alias("shared")), "repeats-shared")

    def kept(batch: pa.RecordBatch, k: int, read: Callable) -> _Chunk:
        chunk = _Chunk(*read(batch, k), length)
        lists = batch.column(batch.schema.get_field_index("shared"))[k].as_py() or []
        chunk.keep(np.sort(np.frombuffer(b"".join(lists), dtype="<u8")))
        return chunk

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                r, h, least, _ = kept(batch, k, read).unique_records()
                part = _deal(h, record_parts)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(record_parts + 1))
                used = np.flatnonzero(np.diff(at))
                own = [order[at[p] : at[p + 1]] for p in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([batch.column(0)[k].as_py()] * len(used), pa.int64()),
                        pa.array([pa.compress(r[o].tobytes(), codec="zstd", asbytes=True) for o in own], pa.binary()),
                        pa.array([least[o].tobytes() for o in own], pa.binary()),
                    ],
                    names=["part", "chunk", "rows", "least"],
                )

    row_bytes = 2 * length - _GRAM + 2

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bit for each string start of each record: an earlier document has the string."""
        groups: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, chunk, r, least in zip(*(c.to_pylist() for c in batch.columns)):
                low = np.frombuffer(least, "<i8")
                flat = pa.decompress(r, decompressed_size=len(low) * row_bytes, codec="zstd", asbytes=True)
                groups.setdefault(part, []).append((chunk, np.frombuffer(flat, np.uint8).reshape(-1, row_bytes), low))
        for part, own in groups.items():
            every = np.concatenate([r for _, r, _ in own])
            docs_ = np.concatenate([d for _, _, d in own])
            at, back = _grouped(every)
            least = np.full(len(at), _LAST)
            np.minimum.at(least, back, docs_)
            row, start, low = least_documents(every[at], least, length)
            grid = np.full((len(at), length), _LAST)
            grid[row, start] = low
            bad = np.packbits(grid[back] < docs_[:, None], axis=1)
            done = 0
            for chunk, r, _ in own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([bad[done : done + len(r)].tobytes()], pa.binary())],
                    names=["chunk", "part", "bits"],
                )
                done += len(r)

    with_bits = chunks.join(bits, "chunk").select(*_PLACE, "shared")
    sent = with_bits.repartition(tasks).mapInArrow(cut, "part int, chunk long, rows binary, least binary").repartition(record_parts, "part")
    answers = sent.mapInArrow(decide, "chunk long, part int, bits binary")
    decided = staged(
        answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("answers")), "repeats-answers"
    )
    step = -(-length // 8)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = kept(batch, k, read)
                gone = np.zeros(len(chunk.data) + 1, dtype=np.int32)
                answer = batch.column(batch.schema.get_field_index("answers"))[k].as_py()
                if len(chunk.place) and answer:
                    _, h, least, back = chunk.unique_records()
                    order = np.argsort(_deal(h, record_parts), kind="stable")
                    bits_ = np.empty((len(h), step), dtype=np.uint8)
                    bits_[order] = np.frombuffer(b"".join(a["bits"] for a in answer), np.uint8).reshape(-1, step)
                    bad = np.unpackbits(bits_, axis=1)[:, :length].astype(bool)
                    hit = bad[back] | (chunk.ids[chunk.doc] > least[back])[:, None]
                    reach = length - _GRAM
                    starts = chunk.place[:, None] - reach + np.arange(length)[None, :]
                    hit &= (starts >= chunk.first[:, None]) & (starts <= chunk.last[:, None])
                    q = starts[hit]
                    np.add.at(gone, q, 1)
                    np.add.at(gone, q + length, -1)
                gone = np.cumsum(gone)[:-1] > 0
                out: list[tuple] = []
                for doc, s, n in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.sizes.tolist()):
                    own = gone[s : s + n]
                    edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                    spans = [{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
                    out.append((doc, n, spans, chunk.data[s : s + n][~own].tobytes()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "n_bytes", "spans", "kept"])

    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    types = [pa.int64(), pa.int64(), span, pa.binary()]
    schema = "id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary"
    last = chunks.join(bits, "chunk", "left").join(decided, "chunk", "left")
    cleaned = last.select(*_PLACE, "shared", "answers").repartition(tasks).mapInArrow(finish, schema)
    size = F.octet_length("text").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("length")))
    copied = marked.where("low < id").select(
        "id",
        size.alias("n_bytes"),
        F.when(size >= length, whole).otherwise(F.slice(whole, 1, 0)).alias("spans"),
        F.when(size >= length, F.lit("")).otherwise(F.col("text")).cast("binary").alias("kept"),
    )
    return cleaned.unionByName(copied).select(F.nullif("id", F.lit(int(_LAST))).alias(id_col), "n_bytes", "spans", "kept")
