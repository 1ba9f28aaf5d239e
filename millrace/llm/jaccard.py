"""Near copies by SimHash and exact Jaccard similarity: operator 8 as the pipeline's near-dedup stage.

1. Texts become sets of 64-bit shingle hashes; equal sets are merged first, so a
   group of copies of any size is one set from then on.
2. Each set has a SimHash of its shingles. Operator 8's trie self-join gives
   candidates within ``bits`` bits; these join most groups by links linear in
   their number. At a similarity of 0.8 SimHashes differ in about 10 of 64 bits on
   average, which no trie join can afford, so the rest is completed exactly:
3. All shingles are put in one order, rare ones first (by counts in a fixed
   number of buckets, then by hash). Two sets of similarity 4/5 or more share one
   of their first ``n - ceil(4n/5) + 1`` shingles in any common order, so only
   these prefixes are joined; sizes and places bound the pairs. No pair is lost.
4. First each set is compared with its neighbour below each shared shingle, again
   linear. Then all pairs below a shared shingle are compared whose ends are not
   yet connected and whose parity bitmaps allow the similarity: the bits in which
   these differ are at most the shingles in which the sets differ.
5. Every candidate is verified on the whole sets, read again from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hidden, lookup, staged
from millrace.llm.components import connected_components
from millrace.llm.simhash import link_forest, majority_bits

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEED = 42
_BUCKET_BITS = 18
#: 64-bit words of a parity bitmap.
_PARITY = 8
#: 64-bit odd constants (from the golden ratio's and xxHash's primes) to mix hashes.
_MIX = np.uint64(0x9E3779B185EBCA87)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; words as in ``simhash.fingerprint``.

    A text of fewer words is one shingle; without words (or null) the set is empty.
    """
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(shingle, len(words))
    each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(_SEED)), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ each[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    out *= _FOLD
    return np.unique(out ^ out >> np.uint64(32))


def _sketch(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles (once for each text) fall in each bucket: a fixed number of counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                buckets = shingle_set(t.as_py(), shingle) >> np.uint64(64 - _BUCKET_BITS)
                np.add.at(counts, buckets.astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    found = texts.mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << _BUCKET_BITS, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """Each of 512 bits is the parity of how many shingles (distinct hashes) belong to it."""
    odd = np.bincount((shingles & np.uint64(64 * _PARITY - 1)).astype(np.int64), minlength=64 * _PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marked(rows: DataFrame, counts: np.ndarray, shingle: int) -> DataFrame:
    """(id, r1, r2, g, n, prefix, fp, parity): each row's set (128-bit hash, size, SimHash, bitmap) and its rarest shingles in order."""
    # only the order of the counts matters, so their ranks do
    ranks = np.unique(counts, return_inverse=True)[1].astype(np.int32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, sizes, prefixes, fps, parities = [], [], [], [], []
            for t in batch.column(3):
                found = shingle_set(t.as_py(), shingle)
                n = len(found)
                order = np.argsort(ranks[(found >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)], kind="stable")
                groups.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(n)
                prefixes.append(found[order[: n - (4 * n + 4) // 5 + 1]].view(np.int64))
                fps.append(majority_bits(found))
                parities.append(parity_bitmap(found))
            columns = [
                *(batch.column(k) for k in range(3)),
                pa.array(groups, pa.binary()),
                pa.array(sizes, pa.int32()),
                pa.array(prefixes, pa.list_(pa.int64())),
                pa.array(np.array(fps, dtype=np.uint64).view(np.int64)),
                pa.array(parities, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "r1", "r2", "g", "n", "prefix", "fp", "parity"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, r1 long, r2 long, g binary, n int, prefix array<long>, fp long, parity array<long>")


def _verified(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, shingle: int, label: str) -> DataFrame:
    """The pairs (a, b) of sets whose whole sets have a similarity of 4/5 or more."""
    ends = pairs.select(F.col("a").alias("g")).unionByName(pairs.select(F.col("b").alias("g"))).distinct()
    wanted = rows.join(ends.join(firsts, "g"), ["r1", "r2"]).select("g", "text").dropDuplicates(["g"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["g", "words"])

    sets = staged(wanted.mapInArrow(work, "g long, words array<long>"), f"{label}-sets")
    both = pairs.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b")
    shared = F.size(F.array_intersect("wa", "wb")).cast("long")
    return staged(both.where(shared * 9 >= (F.size("wa") + F.size("wb")).cast("long") * 4).select("a", "b"), label)


def _possible(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sets of these sizes whose first common shingle has these places can share enough."""
    return F.least(n1 - p1, n2 - p2).cast("long") * 9 >= (n1 + n2).cast("long") * 4


def simhash_candidates(sets: DataFrame, bits: int) -> DataFrame:
    """(a, b): pairs of sets (g, fp) that connect all whose SimHashes differ in at most ``bits`` bits."""
    classes = staged(sets.groupBy("fp").agg(F.min("g").alias("least"), F.count(F.lit(1)).alias("k")), "jaccard-prints")
    equal = lookup(sets.select("fp", "g"), classes, ["fp"], "k").where("g <> least").select(F.col("least").alias("a"), F.col("g").alias("b"))
    named = classes.select("fp", "least")
    near = link_forest(named.select("fp"), bits).toDF("fa", "fb")
    near = near.join(named.toDF("fa", "a"), "fa").join(named.toDF("fb", "b"), "fb")
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def distinct_sets(marked: DataFrame) -> DataFrame:
    """(name, g, copies, n, prefix, fp, parity, r): a row for each set that is not empty, with a number as its short name."""
    some = marked.where("n > 0").groupBy(F.col("g").alias("name")).agg(
        *[F.first(c).alias(c) for c in ("n", "prefix", "fp", "parity")], F.min(F.struct("r1", "r2")).alias("r"), F.count(F.lit(1)).alias("copies")
    )
    return staged(some.withColumn("g", F.monotonically_increasing_id()), "jaccard-distinct")


def jaccard_links(sets: DataFrame, rows: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(a, b): links between distinct sets that connect all of similarity 4/5 or more."""
    firsts = sets.select("g", "r.r1", "r.r2")
    keyed = sets.select("g", "n", F.posexplode("prefix").alias("p", "token"))
    below = Window.partitionBy("token")
    shared = staged(keyed.withColumn("k", F.count(F.lit(1)).over(below)).where("k > 1").drop("k"), "jaccard-shared")

    ordered = below.orderBy("n", "g")
    last = {c: F.lag(c[1:]).over(ordered) for c in ("_g", "_n", "_p")}
    next_to = shared.withColumns(last).where(F.col("_g").isNotNull() & _possible(F.col("_n"), F.col("_p"), F.col("n"), F.col("p")))
    next_to = next_to.select(F.least("_g", "g").alias("a"), F.greatest("_g", "g").alias("b"))
    pairs = staged(next_to.unionByName(simhash_candidates(sets, bits)).distinct(), "jaccard-near")
    links = _verified(pairs, rows, firsts, shingle, "jaccard-links")

    roots = connected_components(links, "jaccard-roots")
    named = shared.join(roots, shared["g"] == roots["node"], "left").select("token", "g", "n", "p", F.coalesce("root", "g").alias("c"))
    apart = named.withColumns({"low": F.min("c").over(below), "high": F.max("c").over(below)}).where("low < high").drop("low", "high")
    apart = staged(apart.join(sets.select("g", "parity"), "g"), "jaccard-apart")
    a, b = apart.alias("a"), apart.alias("b")
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.g") < F.col("b.g")) & (F.col("a.c") != F.col("b.c"))
    meet = meet & _possible(F.col("a.n"), F.col("a.p"), F.col("b.n"), F.col("b.p"))
    differ = sum((F.bit_count(F.get("a.parity", F.lit(k)).bitwiseXOR(F.get("b.parity", F.lit(k)))) for k in range(_PARITY)), F.lit(0))
    meet = meet & (differ * 9 <= F.col("a.n") + F.col("b.n"))
    rest = a.join(b, meet).select(F.col("a.g").alias("a"), F.col("b.g").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return links.unionByName(_verified(staged(rest, "jaccard-rest"), rows, firsts, shingle, "jaccard-more"))


def _row_key(docs: DataFrame, seed: int) -> Column:
    """A hash of all values of a row; nulls count, so equal keys mean equal rows."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(F.lit(seed), *every, *[c.isNull() for c in every])


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 3
) -> DataFrame:
    """``docs`` with one row of each component over links of Jaccard similarity 4/5 or more.

    The row with the least id stays (a null id only if there is no other; among
    rows of one id the least row hash); identical rows are one. Ids need not be
    unique: rows are told apart by a 128-bit hash of all their values. Texts
    without words (and null) have one and the same empty set; an empty table gives
    an empty one. ``bits`` is the budget of the SimHash join, which only decides
    how many links are found before the exact join, never the result.
    """
    key = {hidden(docs.columns, f"_r{k}"): _row_key(docs, k) for k in (1, 2)}
    keyed = docs.withColumns(key)
    r1, r2 = key
    rows = keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.col(f"`{text_col}`").alias("text"))
    counts = _sketch(rows.select("text"), shingle)
    marked = staged(_marked(rows, counts, shingle), "jaccard")
    sets = distinct_sets(marked)
    roots = connected_components(jaccard_links(sets, rows, shingle, bits), "jaccard-components")
    named = sets.select("name", "g", "copies").join(roots, F.col("g") == F.col("node"), "left")
    named = staged(named.select(F.col("name").alias("g"), F.coalesce("root", "g").alias("c"), "copies"), "jaccard-classes")
    classes = lookup(marked.select("id", "r1", "r2", "g"), named, ["g"], "copies")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "r1", "r2")
    kept = classes.groupBy(F.coalesce("c", F.lit(-1).cast("long")).alias("c")).agg(F.min(place).alias("least"))
    kept = staged(kept.select(F.col("least.r1").alias(r1), F.col("least.r2").alias(r2)), "jaccard-kept")
    return keyed.join(kept, [r1, r2], "left_semi").dropDuplicates([r1, r2]).select(*[f"`{c}`" for c in docs.columns])
