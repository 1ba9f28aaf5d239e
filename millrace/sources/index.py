"""A stored token index of facts with pruned top-k (S5, W2): inverted and forward lists in segments.

A segment holds what one batch of fact events changed: postings (token, id), the
forward list (id, tokens) and the change of each token's document frequency. A
segment counts once its commit row is there, so a crash leaves nothing but
unread files, and the next update writes the same number again. Postings are
partitioned by rarity (``tier``, powers of four of the segment's frequency; those
of under 1,024 facts are one) and by hash of the token, so a reader opens the files
of its own tokens only, and a top-k that can do without frequent tokens never opens theirs.

Top-k: a fact that shares t of a query's m tokens has one of its m - t + 1 rarest.
Counts over the rarest half give a lower bound t of the k-th best overlap; the
tokens beyond the m - t + 1 rarest bring no new candidate, and what the candidates
share of them is read from the forward list.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.recall import query_tokens, top
from millrace.sources.staging import staged

_KINDS = {
    "postings": "token string, id long, event long, live boolean, seg int, tier int, bucket int",
    "forward": "id long, event long, tokens array<string>, seg int, bucket int",
    "frequency": "token string, df long, n long, tier int, seg int, bucket int",
}
_RARE = 4  # the least tier; so few tokens have another that every task can have them
_FILE_ROWS = {"postings": 1_000_000, "forward": 50_000}
_READ_ROWS = 500_000  # postings that one task puts together
_COMMITS = "seg int, upto long, base boolean, buckets int"


class TokenIndex:
    """An index below ``path``; ``update`` brings it up to the events, readers see committed segments only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, max_segments: int = 8):
        self.spark, self.path, self.buckets, self.max_segments = spark, path.rstrip("/"), buckets, max_segments

    # ------------------------------------------------------------ segments

    def commits(self) -> list:
        """The commit rows from the last base on, oldest first; compaction keeps them few."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").orderBy("seg").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last = max((i for i, r in enumerate(rows) if r.base), default=0)
        return rows[last:]

    def _read(self, kind: str, commits: list) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], _KINDS[kind])
        places = [f"{self.path}/{kind}/seg={c.seg}" for c in commits]
        return self.spark.read.schema(_KINDS[kind]).option("basePath", f"{self.path}/{kind}").parquet(*places)

    def _bucket(self, value: str, commits: list) -> Column:
        buckets = commits[-1].buckets if commits else self.buckets
        return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")

    def _tasks(self, rows: int, most: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))

    def _write(self, kind: str, seg: int, rows: DataFrame, by: list[str], order: list[str], parts: Column | int = 1, total: int = 0) -> None:
        """``parts`` files for each folder, dealt by hash and sorted, so that a frequent token or full bucket is split; overwrites what a crash left."""
        salted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts) if isinstance(parts, int) else parts))
        laid = salted.repartition(self._tasks(total, _FILE_ROWS.get(kind, 1_000_000)), *by, "_part").sortWithinPartitions(*by, *order).drop("_part")
        laid.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{kind}/seg={seg}")

    def _commit(self, seg: int, postings: DataFrame, forward: DataFrame, frequency: DataFrame, upto: int, base: bool, buckets: int, facts: int) -> None:
        tier = F.greatest(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) / 2).cast("int"), F.lit(_RARE))
        frequency = frequency.withColumn("tier", tier).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        frequency = staged(frequency, "index-frequency")
        sizes = frequency.groupBy("tier", "bucket").agg(F.sum("n").alias("n")).groupBy("tier").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
        parts = F.lit(1)
        for r in sizes:  # a row for each tier
            parts = F.when(F.col("tier") == r.tier, max(1, -(-r.most // _FILE_ROWS["postings"]))).otherwise(parts)
        often = frequency.where(F.col("tier") > _RARE).select("token", "tier")
        placed = postings.join(F.broadcast(often), "token", "left").withColumns(
            {"tier": F.coalesce("tier", F.lit(_RARE)), "bucket": F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")}
        )
        self._write("postings", seg, placed, ["tier", "bucket"], ["token", "id"], parts, sum(r.n for r in sizes))
        self._write("frequency", seg, frequency, ["bucket"], ["token"])
        owned = forward.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        self._write("forward", seg, owned, ["bucket"], ["id"], max(1, -(-facts // (buckets * _FILE_ROWS["forward"]))), facts)
        row = self.spark.createDataFrame([(seg, upto, base, buckets)], _COMMITS).coalesce(1)
        row.write.mode("append").parquet(f"{self.path}/commits")

    def update(self, events: DataFrame) -> int:
        """Take over fact events (event, op, id, fact) after the last one taken over: how many facts they touched.

        Only writes of text count (insert, update, forget); the last one of a fact
        in the batch decides. Replaying events changes nothing. Null texts have no
        tokens. Past ``max_segments`` segments are merged into one.
        """
        commits = self.commits()
        upto = commits[-1].upto if commits else -1
        fresh = events.where((F.col("event") > upto) & F.col("op").isin("insert", "update", "forget"))
        if fresh.groupBy("id").count().where("count > 1").isEmpty():  # no text need be moved to find the last one
            batch = fresh.select("id", "event", F.struct("op", "fact").alias("e"))
        else:
            batch = fresh.groupBy("id").agg(F.max("event").alias("event"), F.max_by(F.struct("op", "fact"), "event").alias("e"))
        tokens = F.when(F.col("e.op") == "forget", F.array().cast("array<string>")).otherwise(T.tokens(F.col("e.fact")))
        batch = staged(batch.select("id", "event", tokens.alias("tokens")), "index-batch")
        touched, newest = batch.agg(F.count(F.lit(1)), F.max("event")).first()
        if not touched:
            return 0
        buckets = commits[-1].buckets if commits else self.buckets
        none = F.array().cast("array<string>")
        if commits:
            before = self.tokens_of(batch.select("id"), commits).select("id", F.col("tokens").alias("old"))
            old = F.coalesce("old", none)
            changed = batch.join(before, "id", "left").select(
                "id", "event", "tokens", F.array_except(old, "tokens").alias("gone"), F.array_except("tokens", old).alias("new")
            )
            both = staged(changed, "index-change")
            gone = both.select(F.explode("gone").alias("token"), "id", "event", F.lit(False).alias("live"))
            postings = gone.unionByName(both.select(F.explode("new").alias("token"), "id", "event", F.lit(True).alias("live")))
        else:
            both = batch
            postings = both.select(F.explode("tokens").alias("token"), "id", "event", F.lit(True).alias("live"))
        change = F.sum(F.when(F.col("live"), 1).otherwise(-1)).cast("long")
        frequency = postings.groupBy("token").agg(change.alias("df"), F.count(F.lit(1)).alias("n"))
        seg = commits[-1].seg + 1 if commits else 0
        self._commit(seg, postings, both.select("id", "event", "tokens"), frequency, newest, False, buckets, touched)
        if len(commits) + 1 > self.max_segments:
            self.compact()
        return touched

    def compact(self) -> None:
        """All segments as one, from the forward list; older ones stay until nobody reads them."""
        commits = self.commits()
        if len(commits) < 2:
            return
        forward = staged(self._current(self._read("forward", commits), commits).where(F.size("tokens") > 0), "index-merged")
        postings = forward.select(F.explode("tokens").alias("token"), "id", "event", F.lit(True).alias("live"))
        frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.count(F.lit(1)).alias("n"))
        self._commit(commits[-1].seg + 1, postings, forward, frequency, commits[-1].upto, True, self.buckets, forward.count())

    # ------------------------------------------------------------ reading

    def _current(self, rows: DataFrame, commits: list) -> DataFrame:
        if len(commits) == 1:
            return rows.select("id", "event", "tokens")
        return rows.groupBy("id").agg(F.max("event").alias("event"), F.max_by("tokens", "event").alias("tokens"))

    def _in_buckets(self, rows: DataFrame, keys: DataFrame, column: str, commits: list) -> DataFrame:
        """``rows`` of the buckets that the keys lie in: at most as many numbers as there are buckets come to the driver."""
        wanted = [r[0] for r in keys.select(self._bucket(column, commits)).distinct().collect()]
        return rows.where(F.col("bucket").isin(wanted)) if wanted else rows.limit(0)

    def tokens_of(self, ids: DataFrame, commits: list | None = None) -> DataFrame:
        """(id, event, tokens) of facts (id): the forward list."""
        commits = self.commits() if commits is None else commits
        rows = self._in_buckets(self._read("forward", commits), ids, "id", commits)
        return self._current(rows.join(ids.select("id").distinct(), "id", "left_semi"), commits)

    def frequencies(self, tokens: DataFrame, commits: list | None = None) -> DataFrame:
        """(token, df) of tokens (token) that a fact has."""
        commits = self.commits() if commits is None else commits
        rows = self._in_buckets(self._read("frequency", commits), tokens, "token", commits)
        found = rows.join(tokens.select("token").distinct(), "token", "left_semi")
        return found.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def postings(self, tokens: DataFrame, commits: list | None = None) -> DataFrame:
        """(token, id): the facts of tokens (token); files of other tokens' tiers and buckets are not opened."""
        commits = self.commits() if commits is None else commits
        tokens = tokens.select("token").distinct()
        known = self._in_buckets(self._read("frequency", commits), tokens, "token", commits).join(tokens, "token", "left_semi")
        place = F.col("tier") * 1_000_000 + F.col("bucket")
        n = F.sum(F.coalesce("n", F.abs("df"))).alias("n")
        found = known.groupBy(place.alias("place")).agg(n).collect()  # tiers times buckets at most
        wanted, total = [r.place for r in found], sum(r.n for r in found)
        rows = self._read("postings", commits)
        if not wanted:
            return rows.select("token", "id").limit(0)
        found = rows.where(place.isin(wanted)).join(tokens, "token", "left_semi")
        if len(commits) == 1:
            return found.where("live").select("token", "id")
        # by fact and in as many tasks as there are postings for, so counts of a fact's tokens need no other shuffle
        found = found.repartition(self._tasks(total, _READ_ROWS), "id")
        last = found.groupBy("token", "id").agg(F.max_by("live", "event").alias("live"))
        return last.where("live").select("token", "id")

    def top_overlaps(self, queries: DataFrame, limit: int) -> DataFrame:
        """K1 from the index: (query_id, id, overlap, rank): the facts that share most tokens with each query, newest first.

        Exactly what a full count gives. ``queries`` is (query_id, text) with distinct query_ids.
        """
        commits = self.commits()
        asked = staged(query_tokens(queries), "index-asked")
        rarest = Window.partitionBy("query_id").orderBy("df", "token")
        known = asked.join(self.frequencies(asked, commits), "token")
        known = known.select("query_id", "token", F.row_number().over(rarest).alias("p"), F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("m"))
        known = staged(known, "index-ranked")
        half = F.ceil(F.col("m") / 2)

        def counted(part: DataFrame) -> DataFrame:
            hits = self.postings(part, commits).join(part.select("query_id", "token"), "token")
            return hits.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("c"))

        def kth(counts: DataFrame, name: str) -> DataFrame:
            return top(counts, "query_id", [F.desc("c")], limit).where(F.col("rank") == limit).select("query_id", F.col("c").alias(name))

        first = staged(counted(known.where(F.col("p") <= half)), "index-first")
        bounded = known.join(kth(first, "t"), "query_id", "left").withColumn("reach", F.greatest(half, F.col("m") + 1 - F.coalesce("t", F.lit(1))))
        bounded = staged(bounded, "index-bounded")
        more = counted(bounded.where((F.col("p") > half) & (F.col("p") <= F.col("reach"))))
        counts = staged(first.unionByName(more).groupBy("query_id", "id").agg(F.sum("c").alias("c")), "index-counts")
        left = bounded.where(F.col("p") > F.col("reach")).groupBy("query_id").agg(F.collect_list("token").alias("rest"))
        open_ = counts.join(kth(counts, "t"), "query_id", "left").join(left, "query_id", "left")
        able = F.col("c") + F.coalesce(F.size("rest"), F.lit(0)) >= F.coalesce("t", F.lit(1))
        open_ = staged(open_.where(able).select("query_id", "id", "c", "rest"), "index-open")
        unsure = open_.where("rest IS NOT NULL")
        seen = self.tokens_of(unsure.select("id"), commits)
        settled = unsure.join(seen, "id").select("query_id", "id", (F.col("c") + F.size(F.array_intersect("tokens", "rest"))).alias("overlap"))
        sure = open_.where("rest IS NULL").select("query_id", "id", F.col("c").alias("overlap"))
        return top(sure.unionByName(settled), "query_id", [F.desc("overlap"), F.desc("id")], limit)

    def merge_candidates(self, incoming: DataFrame) -> DataFrame:
        """P3 narrowed: (new_id, id): the facts that share over three quarters of an incoming fact's tokens, from (new_id, fact).

        Similarity above 3/4 and restatement both need that. A fact with
        a - need + 1 of the rarest tokens missing cannot qualify, so only those are
        looked up; the rest is counted in the forward list. Elaborations share
        fewer; they are the facts of the last hour, which the caller adds.
        """
        commits = self.commits()
        asked = incoming.select(F.col("new_id").alias("query_id"), F.explode(T.tokens(F.col("fact"))).alias("token"))
        sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("a"), F.collect_list("token").alias("own"))
        asked = staged(asked, "index-asked")
        known = asked.join(self.frequencies(asked, commits), "token", "left").join(sizes, "query_id")
        rarest = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "token")
        need = F.floor(F.col("a") * 3 / 4) + 1
        prefix = known.withColumn("p", F.row_number().over(rarest)).where(F.col("p") <= F.col("a") - need + 1)
        prefix = staged(prefix.select("query_id", "token"), "index-prefix")
        found = self.postings(prefix, commits).join(prefix, "token").select("query_id", "id").distinct()
        found = staged(found, "index-found").join(sizes, "query_id")
        full = found.join(self.tokens_of(found.select("id"), commits), "id")
        shared = F.size(F.array_intersect("tokens", "own"))
        return full.where(shared >= need).select(F.col("query_id").alias("new_id"), "id")
