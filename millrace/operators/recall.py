"""Ranked retrieval of facts for many queries at once.

Facts are (id, fact) with optional category, folder, cues, uses, wins,
last_used, unproven, created_at; queries are (query_id, text). Every ranking has
a total order. Nothing is filtered by sector: it only ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.functions import text as T
from millrace.functions import vocab as V
from millrace.functions.counted import Counter, counted
from millrace.sources.staging import staged


_FEW = 20_000  # tokens of queries that are sent to all tasks


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token): the distinct scoring tokens of each query."""
    return queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def fact_tokens(facts: DataFrame, column: str = "fact") -> DataFrame:
    """(id, token): the inverted index of a text column of the facts."""
    return facts.select("id", F.explode(T.tokens(F.col(column))).alias("token"))


def top(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, with their rank; Spark prunes within each task first."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def overlaps(queries: DataFrame, facts: DataFrame, column: str = "fact", name: str = "overlap") -> DataFrame:
    """(query_id, id, name): how many tokens a query shares with each fact, where it shares any."""
    asked = query_tokens(queries)
    # files of short facts are small and have many rows, so the size of a file must not decide what is sent to the driver
    few = asked.limit(_FEW + 1).count() <= _FEW
    hits = fact_tokens(facts, column).join(F.broadcast(asked) if few else asked.hint("merge"), "token")
    return hits.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias(name))


def _best_by_row(queries: DataFrame, facts: DataFrame, limit: int) -> DataFrame | None:
    """(query_id, id, overlap, cue): of each task's facts the best ``limit`` of each query, where nothing else ranks them.

    All words of a fact are in its row, so the task that reads it counts them: no pair of
    a query and a fact is a row before that. None if the queries have no word or too
    many for that, or an id or a number that is no long, is null or comes twice.
    """
    if {facts.schema["id"].dataType, queries.schema["query_id"].dataType} != {LongType()}:
        return None
    asked = query_tokens(queries).limit(_FEW + 1).toArrow()
    ids = facts.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if not 0 < asked.num_rows <= _FEW or asked["query_id"].null_count or not ids.where("n > 1 OR id IS NULL").isEmpty():
        return None
    sent = queries.sparkSession.sparkContext.broadcast(Counter(asked, limit))
    cues = [T.tokens(F.col("cues")).alias("hints")] if "cues" in facts.columns else []
    words = facts.select("id", T.tokens(F.col("fact")).alias("words"), *cues)
    return words.mapInArrow(lambda batches: counted(batches, sent.value), "query_id long, id long, overlap long, cue long")


def _unique(rows: DataFrame, column: str) -> bool:
    """Whether no value of a column is null or there twice."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).unionByName(rows.where(F.col(column).isNull()).select(column, F.lit(0).cast("long").alias("n"))).isEmpty()


def _alike(facts: DataFrame, limit: int) -> DataFrame:
    """(id, cls, words, place): facts that have the same words and folder are one class, named by its newest id; of each the newest ``limit`` ids.

    Whatever ranks by words and folder, then by id, ranks the facts of a class alike: a query's best
    ``limit`` facts are among the newest of its best ``limit`` classes.
    """
    have = [c for c in ("folder",) if c in facts.columns]
    rows = facts.select("id", F.array_sort(T.tokens(F.col("fact"))).alias("words"), *have).where(F.size("words") > 0)
    newest = Window.partitionBy("words", *have).orderBy(F.desc("id"))
    placed = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)
    return staged(placed.withColumn("cls", F.max("id").over(Window.partitionBy("words", *have))), "facts-alike")


def _best_by_class(terms: DataFrame, queries: DataFrame, alike: DataFrame, limit: int, points: Column, share: float, first: str) -> DataFrame:
    """(query_id, id, points, bonus, score, rank): the best ``limit`` facts of each query (query_id, text) by its terms (query_id, term, weight).

    Queries with one set of terms that facts have and one routing are a class too, so classes meet
    and only the best of them become rows of queries. ``points`` is an aggregate, of that name, over the weights of
    shared terms; ``share`` is what a routed sector adds; ``first`` is the column to rank by before the bonus.
    """
    classes = alike.where("place = 1")
    index = classes.select("cls", F.explode("words").alias("term"))
    met = terms.join(index.select("term").distinct(), "term", "left_semi")
    asked = met.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    filed = "folder" in alike.columns
    routed = T.route_sectors(F.col("text")) if filed else F.array().cast("array<string>")
    asked = staged(asked.join(queries.select("query_id", routed.alias("routed")), "query_id"), "queries-terms")
    kinds = asked.groupBy("terms", "routed").agg(F.min("query_id").alias("kind"))
    kinds, asked = staged(kinds, "queries-alike"), staged(asked.join(kinds, ["terms", "routed"]).select("query_id", "kind"), "queries-kinds")
    hits = kinds.select("kind", F.inline("terms")).join(index, "term").groupBy("kind", "cls").agg(points)
    bonus = F.lit(0.0)
    if filed:
        hits = hits.join(kinds.select("kind", "routed"), "kind").join(classes.select("cls", "folder"), "cls")
        bonus = F.when(F.array_contains("routed", T.sector_of(F.col("folder"))), share).otherwise(0.0)
    hits = hits.select("kind", "cls", "points", bonus.alias("bonus"))
    hits = hits.withColumn("score", F.round(F.col("points") + F.col("bonus"), 9))
    order = [F.desc("points"), F.desc("bonus")] if first == "points" else [F.desc(first)]
    best = top(hits, "kind", [*order, F.desc("cls")], limit).drop("rank")
    found = best.hint("merge").join(alike.select("cls", "id"), "cls")
    found = top(found, "kind", [*order, F.desc("id")], limit)
    listed = found.groupBy("kind").agg(F.collect_list(F.struct("id", "points", "bonus", "score", "rank")).alias("rows"))
    return asked.join(listed, "kind").select("query_id", F.inline("rows"))


def keyword_rank(queries: DataFrame, facts: DataFrame, limit: int, as_of: Column | None = None) -> DataFrame:
    """K1: (query_id, id, overlap, cue, bonus, rank), best ``limit`` of each query.

    Order: overlap, cue hits (at most 3), bonus (routed sector and familiarity), newest id.
    A query without tokens takes the newest facts. Cues, folder and tallies count
    where the facts have them.
    """
    have = set(facts.columns)
    plain = "folder" not in have and not ({"uses", "wins", "last_used"} <= have and as_of is not None)
    hits = _best_by_row(queries, facts, limit) if plain else None
    aged = {"uses", "wins", "last_used"} <= have and as_of is not None
    if "folder" in have and "cues" not in have and not aged and _unique(facts, "id") and _unique(queries, "query_id"):
        terms = query_tokens(queries).select("query_id", F.col("token").alias("term"), F.lit(1).alias("weight"))
        rows = _best_by_class(terms, queries, _alike(facts, limit), limit, F.count(F.lit(1)).alias("points"), V.SECTOR_BONUS, "points")
        best = rows.select("query_id", "id", F.col("points").alias("overlap"), F.lit(0).cast("long").alias("cue"), "bonus", "rank")
        return _with_newest(best, queries, facts, limit)
    if hits is not None:
        pass
    elif "cues" in have:
        hits = overlaps(queries, facts)
        cues = overlaps(queries, facts, "cues", "cue")
        hits = hits.join(cues, ["query_id", "id"], "full").fillna(0, ["overlap", "cue"])
        hits = hits.withColumn("cue", F.least("cue", F.lit(3).cast("long")))
    else:
        hits = overlaps(queries, facts).withColumn("cue", F.lit(0).cast("long"))
    bonus = F.lit(0.0)
    columns = ["id"]
    if "folder" in have:
        columns.append("folder")
        routed = queries.select("query_id", T.route_sectors(F.col("text")).alias("routed"))
        hits = hits.join(routed, "query_id")
        bonus = F.when(F.array_contains("routed", T.sector_of(F.col("folder"))), V.SECTOR_BONUS).otherwise(0.0)
    if {"uses", "wins", "last_used"} <= have and as_of is not None:
        columns += ["uses", "wins", "last_used"]
        bonus = bonus + T.familiarity(F.col("uses"), F.col("wins"), F.col("last_used"), as_of)
    if len(columns) > 1:
        hits = hits.join(facts.select(*columns).hint("merge"), "id")
    hits = hits.select("query_id", "id", "overlap", "cue", F.round(bonus, 9).alias("bonus"))
    best = top(hits, "query_id", [F.desc("overlap"), F.desc("cue"), F.desc("bonus"), F.desc("id")], limit)
    return _with_newest(best, queries, facts, limit)


def _with_newest(best: DataFrame, queries: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Ranked facts of queries, and the newest ones for queries without tokens."""
    bare = queries.where(F.size(T.tokens(F.col("text"))) == 0).select("query_id")
    newest = facts.select("id").orderBy(F.desc("id")).limit(limit)
    zero = [F.lit(0).cast("long").alias(c) for c in ("overlap", "cue")]
    recent = top(bare.crossJoin(F.broadcast(newest)), "query_id", [F.desc("id")], limit)  # limit rows
    return best.unionByName(recent.select("query_id", "id", *zero, F.lit(0.0).alias("bonus"), "rank"))


def semantic_rank(hits: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """(query_id, key, rank) from a backend's hits (query_id, pos, mem_id or null, snippet).

    Hits on ids that the store does not have are dropped, and snippets of three
    characters or less; a hit without id is matched by trimmed lower-case text (the
    least id wins), else kept as loose text under ``txt:``. First occurrences count.
    """
    known = facts.select(F.col("id").alias("mem_id"), F.lit(True).alias("stored"))
    texts = facts.groupBy(F.lower(F.trim("fact")).alias("low")).agg(F.min("id").alias("text_id"))
    found = hits.withColumn("low", F.lower(F.trim("snippet"))).where(F.length(F.trim("snippet")) > 3)
    found = found.join(known, "mem_id", "left").where("mem_id IS NULL OR stored").join(texts, "low", "left")
    key = F.coalesce(F.col("mem_id").cast("string"), F.col("text_id").cast("string"), F.concat(F.lit("txt:"), "low"))
    firsts = found.select("query_id", key.alias("key"), "pos").groupBy("query_id", "key").agg(F.min("pos").alias("pos"))
    return top(firsts, "query_id", [F.asc("pos"), F.asc("key")], limit).select("query_id", "key", "rank")


def fuse(lists: list[DataFrame], limit: int, min_score: float = 0.0) -> DataFrame:
    """R1.6: reciprocal rank fusion of (query_id, key, rank) lists: (query_id, key, score, rank).

    Ties go to the better rank in the earlier list, then to the key.
    """
    every = None
    for k, ranked in enumerate(lists):
        one = ranked.select("query_id", F.col("key").cast("string").alias("key"), "rank", F.lit(k).alias("list"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("query_id", "key").agg(
        F.round(F.sum(F.lit(1.0) / (V.RRF_K + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("list", "rank")).alias("first"),
    )
    best = top(fused.where(F.col("score") >= min_score), "query_id", [F.desc("score"), F.asc("first"), F.asc("key")], limit)
    return best.select("query_id", "key", "score", "rank")


def neighbours(facts: DataFrame) -> DataFrame:
    """(word, neighbour, n): the facts that hold both words; each fact's pairs are made once."""
    words = facts.select("id", T.tokens(F.col("fact")).alias("words"))
    pair = F.explode(F.col("words")).alias("word")
    left = words.select("id", "words", pair)
    both = left.select("id", "word", F.explode("words").alias("neighbour")).where("word <> neighbour")
    return both.groupBy("word", "neighbour").agg(F.count(F.lit(1)).alias("n"))


def pellets(queries: DataFrame, facts: DataFrame, routed: bool = True) -> DataFrame:
    """R2: (query_id, term, weight): terms near a query's own, each with its strongest weight.

    Stems meet in buckets of their first four characters, each word once; neighbours are counted
    only around query words, so no pair table of the whole corpus is built, and
    facts of the same words are counted together.
    """
    asked = query_tokens(queries).withColumnRenamed("token", "word")
    sets = facts.select("id", F.array_sort(T.tokens(F.col("fact"))).alias("words")).where(F.size("words") > 0)
    index = sets.groupBy("words").agg(F.min("id").alias("id"), F.count("id").alias("facts")).select("id", "facts", F.explode("words").alias("token"))
    stored = index.select("token").distinct().where(F.length("token") >= V.STEM_MIN)
    words = asked.select("word").distinct()
    stems = (
        words.where(F.length("word") >= V.STEM_MIN)
        .withColumn("head", F.left("word", F.lit(V.STEM_MIN)))
        .join(stored.withColumn("head", F.left("token", F.lit(V.STEM_MIN))), "head")
        .where(T.same_stem(F.col("word"), F.col("token")))
        .select("word", "token")
        .join(asked, "word")
        .select("query_id", F.col("token").alias("term"), F.lit(V.PELLETS["stem"]).alias("weight"))
    )
    holding = index.hint("merge").join(words, index["token"] == words["word"]).select("id", "word")
    counted = holding.join(index.hint("merge"), "id").where("word <> token").groupBy("word", "token").agg(F.sum("facts").alias("n"))
    near = top(counted, "word", [F.desc("n"), F.asc("token")], V.NEIGHBOURS).where(F.col("n") >= V.MIN_COOCCURRENCE)
    near = asked.join(near, "word").select(
        "query_id", F.col("token").alias("term"), F.lit(V.PELLETS["neighbour"]).alias("weight")
    )
    every = stems.unionByName(near)
    if routed:
        table = F.create_map(
            *[
                x
                for name, keys in V.THEMES
                for x in (
                    F.lit(name),
                    F.array(*[F.lit(w) for w in T.routing_words(name, keys) if len(w) > 2 and w not in V.STOP]),
                )
            ]
        )
        themes = queries.select("query_id", F.explode(T.route_sectors(F.col("text"))).alias("theme"))
        sector = themes.select(
            "query_id", F.explode(F.element_at(table, F.col("theme"))).alias("term"), F.lit(V.PELLETS["sector"]).alias("weight")
        )
        every = every.unionByName(sector.join(asked.select("query_id").distinct(), "query_id", "left_semi"))
    best = every.groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    return best.join(asked.withColumnRenamed("word", "term"), ["query_id", "term"], "left_anti")


def bond_hits(queries: DataFrame, bonds: DataFrame) -> DataFrame:
    """(query_id, id, bond): the summed weight of bonds (term, id, weight) from a query's tokens, if 1 or more."""
    hits = query_tokens(queries).withColumnRenamed("token", "term").join(bonds, "term")
    return hits.groupBy("query_id", "id").agg(F.sum("weight").cast("double").alias("bond")).where(F.col("bond") >= V.BOND_MIN)


def scatter(
    queries: DataFrame,
    facts: DataFrame,
    served: DataFrame | None = None,
    bonds: DataFrame | None = None,
    as_of: Column | None = None,
    id_term: float = 0.0,
    most_served: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): up to three facts that the keywords missed.

    ``served`` (query_id, id) is left out. A fact needs pellet or bond evidence;
    sector and familiarity only order. Ids break ties; ``id_term`` (1e-6 for the
    older scoring) adds a share of the id to the score. ``most_served`` is the most that
    ``served`` has of a query, where that is known: then classes of facts and of queries meet instead of rows.
    """
    have = set(facts.columns)
    aged = {"uses", "wins", "last_used"} <= have and as_of is not None
    bounded = served is None or most_served is not None
    if bounded and bonds is None and not aged and not id_term and _unique(facts, "id") and _unique(queries, "query_id"):
        limit = V.SCATTER_FILL + (most_served or 0)
        near = pellets(queries, facts, "folder" in have)
        rows = _best_by_class(near, queries, _alike(facts, limit), limit, F.sum("weight").alias("points"), V.PELLETS["sector"], "score")
        rows = rows.select("query_id", "id", "score")
        return _filled(rows if served is None else rows.join(served.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    hits = fact_tokens(facts).withColumnRenamed("token", "term").hint("merge").join(pellets(queries, facts, "folder" in have), "term")
    score = hits.groupBy("query_id", "id").agg(F.sum("weight").alias("hit"))
    if bonds is not None:
        tied = bond_hits(queries, bonds).withColumn("bond", F.least("bond", F.lit(V.BOND_MAX)) * V.PELLETS["bond"])
        score = score.join(tied, ["query_id", "id"], "full").fillna(0.0, ["hit", "bond"]).withColumn("hit", F.col("hit") + F.col("bond"))
    if served is not None:
        score = score.join(served.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = F.col("hit")
    if "folder" in have:
        routed = queries.select("query_id", T.route_sectors(F.col("text")).alias("routed"))
        score = score.join(routed, "query_id").join(facts.select("id", "folder").hint("merge"), "id")
        order = order + F.when(F.array_contains("routed", T.sector_of(F.col("folder"))), V.PELLETS["sector"]).otherwise(0.0)
    if {"uses", "wins", "last_used"} <= have and as_of is not None:
        score = score.join(facts.select("id", "uses", "wins", "last_used").hint("merge"), "id")
        order = order + T.familiarity(F.col("uses"), F.col("wins"), F.col("last_used"), as_of) * V.PELLETS["sector"]
    score = score.select("query_id", "id", F.round(order + F.col("id") * id_term, 9).alias("score"))
    return _filled(score)


def _filled(score: DataFrame) -> DataFrame:
    """The best facts of each query that are not far below its best one."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    ranked = top(score, "query_id", [F.desc("score"), F.desc("id")], V.SCATTER_FILL).withColumn("best", best)
    return ranked.where(F.col("score") >= F.col("best") * V.SCATTER_FLOOR).drop("best")


def recall(
    queries: DataFrame,
    facts: DataFrame,
    limit: int = 0,
    semantic: DataFrame | None = None,
    bonds: DataFrame | None = None,
    as_of: Column | None = None,
    min_score: float = 0.0,
    spread: bool = True,
) -> DataFrame:
    """(query_id, rank, key, source, score) for every query, in one plan.

    Keyword and semantic lists are fused; empty places are filled by scatter; a
    query with nothing takes the newest facts of its routed sectors. ``source`` is
    fused, scatter or sector. Keys are ids as text, or ``txt:`` for loose text.
    """
    limit = max(1, int(limit)) if limit else V.RECALL_LIMIT
    fetch = V.OVER_FETCH * limit
    ranked = keyword_rank(queries, facts, fetch, as_of).select("query_id", F.col("id").cast("string").alias("key"), "rank")
    lists = [ranked] if semantic is None else [ranked, semantic_rank(semantic, facts, fetch)]
    fused = fuse(lists, limit, min_score).withColumn("source", F.lit("fused"))
    if spread:
        served = fused.where(~F.col("key").startswith("txt:")).select("query_id", F.col("key").try_cast("long").alias("id"))
        count = fused.groupBy("query_id").agg(F.max("rank").alias("base"))
        more = scatter(queries, facts, served, bonds, as_of, most_served=limit).join(count, "query_id", "left")
        more = more.withColumn("rank", F.col("rank") + F.coalesce("base", F.lit(0))).where(F.col("rank") <= limit)
        fused = fused.unionByName(
            more.select("query_id", F.col("id").cast("string").alias("key"), "score", "rank", F.lit("scatter").alias("source"))
        )
    if "folder" in facts.columns:
        empty = queries.join(fused.select("query_id"), "query_id", "left_anti")
        routed = empty.select("query_id", F.explode(T.route_sectors(F.col("text"))).alias("sector"))
        filed = facts.select("id", T.sector_of(F.col("folder")).alias("sector")).where("sector <> ''")
        newest = top(filed, "sector", [F.desc("id")], limit).drop("rank")
        last = top(routed.join(newest, "sector"), "query_id", [F.desc("id")], limit)
        fused = fused.unionByName(
            last.select("query_id", F.col("id").cast("string").alias("key"), F.lit(0.0).alias("score"), "rank", F.lit("sector").alias("source"))
        )
    return fused.select("query_id", "rank", "key", "source", "score")


def prime(requests: DataFrame, facts: DataFrame, limit: int = 3, max_chars: int = 2000) -> DataFrame:
    """(query_id, pos, id): whole facts that fit both budgets, for requests (query_id, text, known).

    A fact needs two distinct literal or cue hits, must not be held, and must not
    stand in ``known``. One that does not fit the budget is passed over.
    """
    limit = min(8, limit)
    asked = requests.where(F.size(T.tokens(F.col("text"))) >= 2)
    usable = facts.where(~F.col("unproven"))
    literal = fact_tokens(usable).withColumn("hint", F.lit(0))
    hinted = fact_tokens(usable, "cues").withColumn("hint", F.lit(1))
    hits = literal.unionByName(hinted).join(query_tokens(asked), "token").groupBy("query_id", "id").agg(
        F.count_if(F.col("hint") == 0).alias("literal"),
        F.least(F.count_if(F.col("hint") == 1), F.lit(3)).alias("hinted"),
        F.count_distinct("token").alias("n"),
    )
    joined = hits.where("n >= 2").join(usable.select("id", "category", "fact"), "id").join(asked.select("query_id", "known"), "query_id")
    joined = joined.where(~F.contains(F.coalesce("known", F.lit("")), F.col("fact")))
    cost = F.length(F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" ["), "category", F.lit("] "), "fact"))
    rows = joined.select("query_id", F.struct((-F.col("literal")).alias("l"), (-F.col("hinted")).alias("h"), (-F.col("id")).alias("i"), cost.alias("c")).alias("row")).where(cost <= max_chars)
    # of facts of one cost only the first few can be taken, whatever else is, so a query has limit x max_chars rows at most
    equal = Window.partitionBy("query_id", "row.c").orderBy("row")
    rows = rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= limit)
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(a: Column, r: Column) -> Column:
        more = r["c"] + F.when(F.size(a["ids"]) > 0, 1).otherwise(0)
        fits = (a["used"] + more <= max_chars) & (F.size(a["ids"]) < limit)
        return F.when(fits, F.struct((a["used"] + more).alias("used"), F.concat(a["ids"], F.array(-r["i"])).alias("ids"))).otherwise(a)

    chosen = listed.select("query_id", F.posexplode(F.aggregate("rows", start, step, lambda a: a["ids"])).alias("pos", "id"))
    return chosen.select("query_id", (F.col("pos") + 1).alias("pos"), "id")


def core_digest(facts: DataFrame, limit: int = 8) -> DataFrame:
    """The newest facts that are filed under no theme and not held."""
    core = facts.where(~F.col("unproven") & ~F.contains("folder", F.lit("/")))
    return core.orderBy(F.desc("id")).limit(limit)


def sector_index(facts: DataFrame) -> DataFrame:
    """The distinct sector names."""
    return facts.select(T.sector_of(F.col("folder")).alias("sector")).where("sector <> ''").distinct()


def folder_list(facts: DataFrame) -> DataFrame:
    """The distinct folders."""
    return facts.select("folder").where("folder <> ''").distinct()


def history(revisions: DataFrame, limit: int = 8) -> DataFrame:
    """(id, pos, fact, stored_at, superseded_at, current) of revisions (id, event, fact, stored_at).

    A row is a revision if its text differs from the one before; the newest
    ``limit`` are kept (1 to 50), oldest first.
    """
    limit = max(1, min(50, limit))
    order = Window.partitionBy("id").orderBy("event")
    numbered = revisions.withColumns({"before": F.lag("fact").over(order), "n": F.row_number().over(order)})
    changed = numbered.where(~F.col("fact").eqNullSafe(F.col("before")) | (F.col("n") == 1))
    numbered = changed.withColumn("superseded_at", F.lead("stored_at").over(order)).withColumn(
        "back", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("event")))
    )
    kept = numbered.where(F.col("back") <= limit)
    return kept.select(
        "id", F.row_number().over(order).alias("pos"), "fact", "stored_at", "superseded_at", (F.col("back") == 1).alias("current")
    )
