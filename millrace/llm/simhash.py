"""SimHash near-duplicates (operator 8): a distributed binary-trie self-join.

1. Each text gives a 64-bit fingerprint; equal fingerprints are merged first,
   so a group of copies of any size is one row from then on.
2. The trie of all fingerprints is joined with itself from the root down. A node
   pair is two prefixes of one depth; a fingerprint is dealt to every pair of its
   own prefix and one within the budget. Four levels are descended at a time:
   differing bits add up, and a pair beyond the budget is never made.
3. Pairs of more than ``_NODE_ROWS`` fingerprints go down further if there are
   some on both sides; so a dense part of the trie is split until it fits,
   however many documents are in it.
4. A task walks the two subtries of each pair dealt to it in the same manner, all
   node pairs of one depth at once as arrays, in blocks of bounded size.
5. Links go out as a forest, linear in the rows of a task; the forests are
   joined by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import hidden, lookup, staged
from millrace.llm.components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEED = 42
#: Levels of the trie descended at a time, fingerprints of a node pair that one task takes, and of a whole trie for one task.
_STEP = 4
_NODE_ROWS = 1 << 15
_ONE_TASK = 1 << 12
#: Rows gathered before a task walks them, node pairs handled at once, and shingle hashes unpacked at once.
_GATHER = 1 << 19
_FRONTIER = 1 << 17
_HASHES = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64 values (seed 42).

    A-Z are lower-cased; words are runs of other characters than space and
    \\t to \\r; shingles are ``shingle`` words joined by a space, repeats included.
    A text of fewer words is one shingle; without words (or null) it gives 0.
    """
    if not text:
        return 0
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        parts: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        n = len(words) - shingle + 1
    return majority_bits(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(_SEED)), dtype=np.uint64, count=n))


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bits are set where over half of the 64-bit hashes have them set."""
    flat = hashes.astype(">u8").view(np.uint8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(flat), _HASHES * 8):
        ones += np.unpackbits(flat[at : at + _HASHES * 8]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """All columns of ``docs`` but the text, and ``fingerprint`` (long, the 64 bits as they are)."""
    name = hidden(docs.columns, "fingerprint")
    keep = [c for c in docs.columns if c != text_col]
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, LongType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got.view(np.int64))], names=[*keep, name])

    return docs.select(*[f"`{c}`" for c in keep], f"`{text_col}`").mapInArrow(work, schema)


def _halves(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """The first place of each sorted range [lo, hi) whose value has ``bit`` set; the bits above are equal in a range."""
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        middle = (a + b) >> 1
        one = (values[np.minimum(middle, len(values) - 1)] >> np.uint64(bit) & np.uint64(1)).astype(bool)
        b = np.where(open_ & one, middle, b)
        a = np.where(open_ & ~one, middle + 1, a)
    return a


def trie_links(values: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs of ``values`` that differ in at most ``budget`` bits, from the subtries at ``depth``.

    ``roots`` has columns a_lo, a_hi, b_lo, b_hi and the errors so far: a node is a
    range of sorted values with one prefix; a pair of a node with itself has a = b.
    """
    stack = [(63 - depth, roots)]
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > _FRONTIER:
            stack += [(bit, pairs[:, k : k + _FRONTIER]) for k in range(0, pairs.shape[1], _FRONTIER)]
            continue
        a_lo, a_hi, b_lo, b_hi, errors = pairs
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if single.any():
            a, b = a_lo[single], b_lo[single]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            if (found := near & (a != b)).any():
                yield a[found], b[found]
        if bit < 0 or single.all():
            continue
        a_lo, a_hi, b_lo, b_hi, errors = pairs[:, ~single]
        a_mid, b_mid = _halves(values, a_lo, a_hi, bit), _halves(values, b_lo, b_hi, bit)
        own = (a_lo == b_lo) & (a_hi == b_hi)
        next_pairs = np.concatenate(
            [
                np.stack([a_lo, a_mid, b_lo, b_mid, errors]),
                np.stack([a_mid, a_hi, b_mid, b_hi, errors]),
                np.stack([a_lo, a_mid, b_mid, b_hi, errors + 1]),
                np.stack([a_mid, a_hi, b_lo, b_mid, errors + 1])[:, ~own],
            ],
            axis=1,
        )
        a_lo, a_hi, b_lo, b_hi, errors = next_pairs
        alone = (a_lo == b_lo) & (a_hi - a_lo == 1)
        go_on = (a_hi > a_lo) & (b_hi > b_lo) & (errors <= budget) & ~alone
        if go_on.any():
            stack.append((bit - 1, next_pairs[:, go_on]))


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes in ``label`` (each row's least known class mate) along the links a-b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _own(depth: int) -> Column:
    """The prefix of ``fp`` at a depth; a number of its own for each prefix."""
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _descended(entries: DataFrame, depth: int, budget: int) -> DataFrame:
    """(lo, hi, fp) of node pairs at ``depth``, dealt to the pairs ``_STEP`` levels below that the budget allows."""
    own = _own(depth)
    bits = F.shiftrightunsigned("fp", 64 - depth - _STEP).bitwiseAND(F.lit(2**_STEP - 1))
    other = F.shiftleft(F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(own), _STEP)
    errors = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
    flips = F.filter(F.array(*[F.lit(m).cast("long") for m in range(2**_STEP)]), lambda m: F.bit_count(m) + errors <= budget)
    below = entries.select("fp", _own(depth + _STEP).alias("own"), other.alias("other"), bits.alias("bits"), F.explode(flips).alias("m"))
    mate = F.col("other").bitwiseOR(F.col("bits").bitwiseXOR(F.col("m")))
    return below.select(F.least("own", mate).alias("lo"), F.greatest("own", mate).alias("hi"), "fp")


def _walked(entries: DataFrame, depth: int, budget: int) -> DataFrame:
    """(a, b): a forest of the links within the node pairs (lo, hi, fp) of one depth."""

    def links(lo: np.ndarray, hi: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        # the side of a fingerprint in its pair; the two sides of a node with itself are one
        side = (lo != hi) & ((fp >> np.uint64(64 - depth)).astype(np.int64) != lo) if 0 < depth < 64 else (lo != hi) & (fp.view(np.int64) != lo)
        order = np.lexsort((fp, side, hi, lo))
        lo, hi, fp, side = lo[order], hi[order], fp[order], side[order]
        pair = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        end = np.r_[pair[1:], len(lo)]
        cut = pair + (np.add.reduceat((~side).astype(np.int64), pair))
        twin = lo[pair] == hi[pair]
        roots = np.stack([pair, cut, np.where(twin, pair, cut), end, np.bitwise_count(lo[pair] ^ hi[pair]).astype(np.int64)])
        useful = (roots[1] > roots[0]) & (roots[3] > roots[2]) & ~(twin & (end - pair < 2))
        distinct, back = np.unique(fp, return_inverse=True)
        label = np.arange(len(distinct))
        for a, b in trie_links(fp, roots[:, useful], depth, budget):
            _forest(label, back[a], back[b])
        linked = np.flatnonzero(label != np.arange(len(label)))
        signed = distinct.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            kept = [np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns)]
            if len(kept[0]) < _GATHER:
                continue
            lo, hi, _ = kept
            # rows are sorted by pair: the last pair may go on in the next batch
            done = int(np.flatnonzero((lo != lo[-1]) | (hi != hi[-1]))[-1]) + 1 if (lo[0], hi[0]) != (lo[-1], hi[-1]) else 0
            if done:
                yield links(lo[:done], hi[:done], kept[2][:done].view(np.uint64))
                kept = [k[done:] for k in kept]
        if len(kept[0]):
            yield links(kept[0], kept[1], kept[2].view(np.uint64))

    dealt = entries.select("lo", "hi", "fp").repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    return dealt.mapInArrow(work, "a long, b long")


def link_forest(fps: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that differ in at most ``budget`` bits.

    The descent begins at the depth where a node of evenly spread fingerprints
    fits a task, and goes on wherever one does not. Fingerprints that equal each
    other in all 64 bits are one row, so every node pair fits in the end.
    """
    if not 0 <= budget < 64:
        raise ValueError("a budget is 0 to 63 bits")
    zero = F.lit(0).cast("long")
    entries = fps.select(zero.alias("lo"), zero.alias("hi"), F.col(fps.columns[0]).alias("fp"))
    n, depth, forests = fps.count(), 0, []
    while depth < 64 and (2 * n >> depth > _NODE_ROWS or (depth < _STEP and n > _ONE_TASK)):
        entries = _descended(entries, depth, budget)
        depth += _STEP
    while True:
        entries = staged(entries, "simhash-nodes")
        if depth == 64 or 2 * n <= _NODE_ROWS:
            forests.append(_walked(entries, depth, budget))
            break
        first = F.count_if(_own(depth) == F.col("lo")).alias("first")
        pairs = entries.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), first).where(F.col("n") > _NODE_ROWS)
        deep = staged(pairs.select("lo", "hi", "n", F.expr("lo = hi OR (first > 0 AND first < n)").alias("both")), "simhash-pairs")
        if deep.isEmpty():
            forests.append(_walked(entries, depth, budget))
            break
        # one row for each pair of over _NODE_ROWS entries
        forests.append(_walked(entries.join(deep, ["lo", "hi"], "left_anti"), depth, budget))
        entries = _descended(lookup(entries, deep.where("both").drop("both"), ["lo", "hi"], "n", "inner"), depth, budget)
        depth += _STEP
    every = forests[0]
    for f in forests[1:]:
        every = every.unionByName(f)
    return every


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2
) -> DataFrame:
    """(id, fingerprint long, component_id): the least id reachable over links of at most ``budget`` bits.

    Null and empty texts have fingerprint 0 and are linked like any other; a null
    id takes part but is never a component's least id unless there is no other;
    repeated rows stay. An empty table gives an empty one.
    """
    marked = staged(fingerprints(docs.select(f"`{id_col}`", f"`{text_col}`"), text_col, shingle).toDF("id", "fp"), "simhash")
    least = staged(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = connected_components(link_forest(least.select("fp"), budget), "simhash-links")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    # one row for each fingerprint, so that no hot key meets in these joins
    lowest = members.join(least.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("low"))
    linked = members.join(lowest, "root").select(F.col("node").alias("fp"), "low")
    classes = least.join(linked, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id"), "n")
    classes = staged(classes, "simhash-classes")
    return lookup(marked, classes, ["fp"], "n").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
