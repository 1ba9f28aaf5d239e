"""Task learning: patterns, episodes, associations and consolidation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vocab as V
from millrace.functions.marks import marked, word_marks
from millrace.operators.merge import component_labels
from millrace.operators.recall import top
from millrace.sources.staging import staged


def request_classes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes (rcls, words, routed), members (query_id, rcls)): requests (query_id, text) of equal tokens and equal sectors are one."""
    read = requests.select("query_id", F.array_sort(T.tokens(F.col("text"))).alias("words"), T.route_sectors(F.col("text")).alias("routed"))
    read = staged(read.withColumn("rcls", F.xxhash64("words", F.lit("|"), "routed")), "requests")  # no word is a bar
    classes = read.groupBy("rcls").agg(F.first("words").alias("words"), F.first("routed").alias("routed"))
    return staged(classes, "request-classes"), read.select("query_id", "rcls")


def pattern_classes(patterns: DataFrame) -> DataFrame:
    """(id, pcls, words, ...): patterns (id, key, ...) with the words of their key and a name for each set of words."""
    words = F.array_sort(F.array_distinct(F.filter(F.split("key", " "), lambda w: w != "")))
    keyed = patterns.withColumn("words", words).where(F.size("words") > 0)
    return keyed.withColumn("pcls", F.xxhash64("words"))


def covered_classes(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(rcls, pcls, c, n): request classes that hold c of a key's n words, 0.6 of them or more.

    A request that holds ``need`` words of a key holds one of its n - need + 1
    rarest, rarity being counted over the request classes; only those words are
    joined. A row of a request carries a mark of all its words, and pairs whose
    marks leave less than ``need`` in common end within the join, so what is moved
    are little more than the pairs that hold. Those are counted exactly, at the first
    word they meet in. A key of words that no request has meets none. Words are
    64-bit hashes here.
    """
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    own = asked.select("rcls", hashed(F.col("words")).alias("own"))
    own = staged(own.select("rcls", "own", word_marks(F.col("own")).alias("marks")), "request-words")  # marks are made once, not for each word
    frequency = own.select(F.explode("own").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    held = known.groupBy("pcls").agg(F.first("words").alias("words")).select("pcls", F.explode(hashed(F.col("words"))).alias("token"))
    ranked = held.join(frequency, "token", "left").groupBy("pcls").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("r"))
    keys = staged(ranked.select("pcls", F.transform("r", lambda x: x["token"]).alias("words"), F.size("r").alias("n")), "pattern-classes")
    need = F.ceil(F.col("n") * V.COVERAGE - 1e-9).cast("int")
    prefix = keys.select("pcls", "words", need.alias("need"), F.explode(F.slice("words", F.lit(1), F.col("n") - need + 1)).alias("token"))
    index = own.select("rcls", "marks", F.explode("own").alias("token"))
    met = prefix.join(index.hint("merge"), "token").where(F.size(F.filter("words", lambda w: marked(F.col("marks"), w))) >= F.col("need"))
    full = met.select("rcls", "pcls", "words", "token").join(own.select("rcls", "own").hint("merge"), "rcls")
    common = F.array_intersect("words", "own")
    first = full.where(F.get(common, F.lit(0)) == F.col("token"))
    shared = first.select("rcls", "pcls", F.size(common).alias("c"), F.size("words").alias("n"))
    return shared.where(F.col("c") / F.col("n") >= V.COVERAGE)


def coverage(requests: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, id, covered): patterns (id, key) whose tokens a request (query_id, text) covers by 0.6 or more.

    The pairs of members of the classes that meet; callers that need less than all pairs use the classes.
    """
    asked, members = request_classes(requests)
    known = pattern_classes(patterns)
    pairs = covered_classes(asked, known)
    # tables of patterns are small files of many rows, which no join may send to the driver
    full = pairs.join(members.hint("merge"), "rcls").join(known.select("id", "pcls").hint("merge"), "pcls")
    return full.select("query_id", "id", (F.col("c") / F.col("n")).alias("covered"))


def predict(requests: DataFrame, patterns: DataFrame, limit: int = 3) -> DataFrame:
    """K5: (query_id, id, score, rank): the best patterns (id, key, uses, wins, taught, sector) of each request.

    Two for a taught one, confidence times coverage, a hundredth for each of up to
    twenty uses, a quarter in a routed sector; ties go to the newer pattern.

    The score of a pattern depends on the request by the number of words covered
    and by whether its sector is routed. So the best ``limit`` patterns of each key,
    sector and such number are chosen once, before any request is joined, and only
    classes of requests are ranked; members get their class's answer.
    """
    asked, members = request_classes(requests)
    known = pattern_classes(patterns)
    least = F.ceil(F.size("words") * V.COVERAGE - 1e-9).cast("int")
    each = known.withColumn("n", F.size("words")).select(
        "*", F.explode(F.sequence(least, F.size("words"))).alias("c")
    ).withColumn("in_route", F.explode(F.array(F.lit(False), F.lit(True))))
    score = (
        F.when(F.col("taught"), 2.0).otherwise(0.0)
        + T.confidence(F.col("uses"), F.col("wins"), F.col("taught")) * (F.col("c") / F.col("n"))
        + F.least("uses", F.lit(20)) / F.lit(100.0)
        + F.when(F.col("in_route"), 0.25).otherwise(0.0)
    )
    group = Window.partitionBy("pcls", "sector", "c", "in_route").orderBy(F.desc("score"), F.desc("id"))
    scored = each.select("pcls", "sector", "c", "in_route", "id", F.round(score, 9).alias("score"))
    best = staged(scored.withColumn("place", F.row_number().over(group)).where(F.col("place") <= limit).drop("place"), "pattern-best")
    pairs = covered_classes(asked, known).join(asked.select("rcls", "routed").hint("merge"), "rcls")
    hits = pairs.join(best.hint("merge"), ["pcls", "c"]).where(F.col("in_route") == F.coalesce(F.array_contains("routed", F.col("sector")), F.lit(False)))
    answers = top(hits.select("rcls", "id", "score"), "rcls", [F.desc("score"), F.desc("id")], limit)
    return members.join(answers.hint("merge"), "rcls").select("query_id", "id", "score", "rank")


def associated(seeds: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, id, weight, rank): neighbours of each query's seeds over undirected edges (a, b, weight), seeds left out."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight")
    )
    hop = seeds.select("query_id", "id").join(both, "id").groupBy("query_id", F.col("other").alias("id")).agg(F.sum("weight").alias("weight"))
    fresh = hop.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return top(fresh, "query_id", [F.desc("weight"), F.asc("id")], limit)


def predict_with_related(requests: DataFrame, patterns: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, id, related, rank): the best patterns, then those tied to them that are not among them."""
    hits = predict(requests, patterns, limit).select("query_id", "id", "rank")
    more = associated(hits.select("query_id", "id"), edges).join(patterns.select("id"), "id", "left_semi")
    base = hits.groupBy("query_id").agg(F.max("rank").alias("base"))
    after = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    more = more.join(base, "query_id").select("query_id", "id", F.lit(True).alias("related"), (F.col("base") + after).alias("rank"))
    return hits.select("query_id", "id", F.lit(False).alias("related"), "rank").unionByName(more)


def reinforce_patterns(requests: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tallies (id, uses, wins, last_used), edges (a, b, weight)) of requests (query_id, text, outcome, ts).

    Every pattern that a request covers is used, and wins if it ended well; every
    pair that one request covers gains one. Stopped requests count for nothing.
    """
    ended = requests.where("outcome <> 'stopped'")
    asked, members = request_classes(ended)
    known = pattern_classes(patterns)
    pairs = staged(covered_classes(asked, known), "pattern-fired")
    # requests are summed by class, and classes by key, before a pattern is named
    grown = members.join(ended.select("query_id", "outcome", "ts"), "query_id").groupBy("rcls").agg(
        F.count(F.lit(1)).alias("uses"), F.count_if(F.col("outcome") == "ok").alias("wins"), F.max("ts").alias("last_used")
    )
    keyed = pairs.join(grown, "rcls").groupBy("pcls").agg(F.sum("uses").alias("uses"), F.sum("wins").alias("wins"), F.max("last_used").alias("last_used"))
    tallied = known.select("id", "pcls").join(keyed, "pcls").select("id", "uses", "wins", "last_used")
    fired = pairs.join(members, "rcls").join(known.select("id", "pcls"), "pcls").select("query_id", "id")
    return tallied, cofire_edges(fired.withColumnRenamed("query_id", "turn"))


def similar_episode(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """(query_id, id, overlap): of the newest 300 good episodes the one that shares most tokens, two at least; ties go to the newest."""
    recent = episodes.where("outcome = 'ok'").orderBy(F.desc("id")).limit(V.RECENT_EPISODES)
    index = recent.select("id", F.explode(T.tokens(F.col("request"))).alias("token"))
    asked = requests.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    hits = index.join(asked, "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("overlap")).where("overlap >= 2")
    return top(hits, "query_id", [F.desc("overlap"), F.desc("id")], 1).drop("rank")


def cofire_edges(firings: DataFrame) -> DataFrame:
    """(a, b, weight): how often two patterns fired in one turn (turn, id), a < b.

    Turns are requests with a few patterns each; pairs are made within a turn only.
    """
    once = firings.select("turn", "id").distinct()
    pairs = once.toDF("turn", "a").join(once.toDF("turn", "b"), "turn").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def _size_class(n: Column) -> Column:
    """Sizes up to eight each for itself, larger ones in steps of a quarter: never falls as the size grows."""
    return F.when(n <= 8, n).otherwise(8 + F.floor(F.log(n / 8) / math.log(1.25) + 1e-9)).cast("int")


def request_keys(sets: DataFrame) -> DataFrame:
    """(id, n, p, w, own, wanted): under which words and classes of sizes the sets (id, words rarest first, n) look for partners.

    The first common word must leave enough for an overlap of a third of both
    sizes, so a place has partners up to a size, and a frequent word late in many
    sets meets none of them.
    """
    prefix = F.slice("words", F.lit(1), F.col("n") - F.ceil(F.col("n") / 2).cast("int") + 1)
    keyed = sets.select("id", "n", F.posexplode(F.transform(prefix, lambda w: F.xxhash64(w))).alias("p", "w"))
    most = F.least(F.col("n") * 2, (F.col("n") - F.col("p")) * 3 - F.col("n"))
    half = F.ceil(F.col("n") / 2).cast("int")
    partners = F.explode(F.sequence(_size_class(half), _size_class(most))).alias("wanted")
    return keyed.where(most >= half).select("id", "n", "p", "w", _size_class(F.col("n")).alias("own"), partners)


def similar_requests(episodes: DataFrame) -> DataFrame:
    """(a, b): good episodes with Jaccard similarity of 1/2 or more, a < b, by prefix filter, size and place bounds."""
    usable = episodes.select("id", T.tokens(F.col("request")).alias("words")).where(F.size("words") >= 2)
    index = usable.select("id", F.explode("words").alias("w"))
    frequency = index.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    sets = index.join(frequency, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    sets = sets.select("id", F.transform("r", lambda x: x["w"]).alias("words"), F.size("r").alias("n"))
    sets = staged(sets, "request-sets")
    keyed = request_keys(sets)
    a, b = keyed.alias("a"), keyed.alias("b")
    left = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p"))
    near = (F.col("a.w") == F.col("b.w")) & (F.col("a.own") == F.col("b.wanted")) & (F.col("a.wanted") == F.col("b.own"))
    near = near & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") * 2 >= F.greatest("a.n", "b.n"))
    near = near & (left * 3 >= F.col("a.n") + F.col("b.n"))
    pairs = staged(a.join(b, near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "request-pairs")
    own = sets.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    full = pairs.join(own.toDF("a", "wa"), "a").join(own.toDF("b", "wb"), "b")
    return full.where(T.jaccard(F.col("wa"), F.col("wb")) >= V.SIMILARITY).select("a", "b")


def episode_clusters(episodes: DataFrame) -> DataFrame:
    """(id, component) of single-link clusters of good episodes (id, request, outcome); singletons are their own.

    Episodes with one and the same token set are joined as one, named by the
    least id, however many they are; every episode gets its set's component.
    """
    words = F.array_sort(T.tokens(F.col("request"))).alias("words")
    usable = episodes.where("outcome = 'ok'").select("id", "request", words).where(F.size("words") >= 2)
    sets = usable.groupBy("words").agg(F.min("id").alias("least"), F.min_by("request", "id").alias("request"))
    labels = component_labels(similar_requests(sets.select(F.col("least").alias("id"), "request")))
    classes = sets.join(labels, F.col("least") == F.col("id"), "left").select("words", F.coalesce("component", "least").alias("component"))
    return usable.join(classes, "words").select("id", "component")


def promotions(episodes: DataFrame, mined: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """(trigger, key, resolution, uses, wins, newest): habits of three members and two days or more, at most three a sweep.

    The trigger is the shortest request (tokens, then length, then id); keys of one
    token, keys promoted before and triggers that a pattern covers are left out.
    Clusters are taken in the order of their first episode. All members ended well,
    so all are wins; the resolution tells how often, with which tools and how the
    newest of them ended (``tools`` and ``summary``, where episodes have them).
    """
    blank = {c: F.lit("") for c in ("summary", "tools") if c not in episodes.columns}
    members = episodes.withColumns(blank).join(episode_clusters(episodes), "id")
    n_tokens = F.size(T.tokens(F.col("request")))
    clusters = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("uses"),
        F.count_distinct(F.to_date("ts")).alias("days"),
        F.min_by("request", F.struct(n_tokens, F.length("request"), "id")).alias("request"),
        F.max("id").alias("newest"),
        F.max_by(F.struct(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("summary", "tools")]), "id").alias("last"),
    )
    told = F.concat(
        F.lit("A habit of "), F.col("uses").cast("string"), F.lit(" good runs."),
        F.when(F.col("last.tools") != "", F.concat(F.lit(" Used: "), "last.tools", F.lit("."))).otherwise(""),
        F.when(F.col("last.summary") != "", F.concat(F.lit(" It ended with: "), "last.summary")).otherwise(""),
    )
    clusters = clusters.withColumn("resolution", F.left(told, F.lit(300)))
    kept = clusters.where((F.col("uses") >= V.MIN_MEMBERS) & (F.col("days") >= V.MIN_DAYS))
    named = kept.select("component", T.trigger_display(F.col("request")).alias("trigger"), T.trigger_key(F.col("request")).alias("key"), "resolution", "uses", "newest")
    named = named.where(F.size(F.split("key", " ")) >= 2)
    if mined is not None:
        named = named.join(mined.select("key"), "key", "left_anti")
    if patterns is not None:
        asked, members = request_classes(named.select(F.col("component").alias("query_id"), F.col("trigger").alias("text")))
        covered = members.join(covered_classes(asked, pattern_classes(patterns)), "rcls", "left_semi")
        named = named.join(covered.select(F.col("query_id").alias("component")), "component", "left_anti")
    return named.orderBy("component").limit(V.PROMOTIONS).select("trigger", "key", "resolution", "uses", F.col("uses").alias("wins"), "newest")


def consolidate(store, sweep: str) -> int:
    """One sweep over the store's newest 500 episodes, under a name: how many habits became shortcuts.

    Its writes carry the name and count once the commit row of the sweep is there,
    so a sweep that died is as if it never was, and one that is asked for again does
    nothing. Shortcuts start with the tally of their cluster; what was promoted
    before is not promoted again, even if it was forgotten.
    """
    if not store.table("sweeps").where(F.col("sweep") == sweep).isEmpty():
        return 0
    episodes = store.table("episodes").orderBy(F.desc("id")).limit(V.EPISODES)
    found = staged(promotions(staged(episodes, "sweep-episodes"), store.mined(), store.patterns()), "promoted")
    seq = (store.table("patterns").agg(F.max("seq")).first()[0] or 0) + 1
    order = Window.orderBy("key")  # three rows
    rows = found.select(
        (F.row_number().over(order) - 1 + seq).alias("seq"), F.lit("mined").alias("op"), "trigger", "resolution", F.lit(False).alias("taught"), "uses", "wins", F.lit(sweep).alias("sweep")
    )
    store.append("patterns", rows)
    newest = episodes.agg(F.max("id")).first()[0]
    store.append("sweeps", store.spark.createDataFrame([(newest, sweep)], "mark long, sweep string").coalesce(1))
    return found.count()


def pattern_list(patterns: DataFrame, limit: int = 200) -> DataFrame:
    """Patterns with their confidence to two places, strongest first: taught, confidence, last use, then the id."""
    shown = patterns.withColumn("confidence", F.round(T.confidence(F.col("uses"), F.col("wins"), F.col("taught")), 2))
    order = [F.desc("taught"), F.desc("confidence"), F.desc_nulls_last("last_used"), F.desc("id")]
    return shown.orderBy(*order).limit(limit)


def episode_list(episodes: DataFrame, limit: int = 50) -> DataFrame:
    """The newest episodes."""
    return episodes.orderBy(F.desc("id")).limit(limit)


def episode_rows(turns: DataFrame) -> DataFrame:
    """Turns (id, ts, request, summary, tools, outcome) as episodes, their texts cut to 500, 400 and 200 characters."""
    cut = {c: F.left(F.coalesce(c, F.lit("")), F.lit(n)) for c, n in (("request", 500), ("summary", 400), ("tools", 200))}
    return turns.withColumns(cut)


def forget_patterns(patterns: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, edges) less the forgotten ones (id) and every edge that touches one."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").join(ids.withColumnRenamed("id", "b"), "b", "left_anti")
    return patterns.join(ids, "id", "left_anti"), left.select("a", "b", "weight")


def learn(writes: DataFrame) -> DataFrame:
    """(key, trigger, resolution, taught, uses, wins) from writes (seq, trigger, resolution, taught).

    One row for each order-free key: the latest text, taught once and for all; the
    first write sets the tally: its own ``uses`` and ``wins`` where it has them (a
    promoted habit), else one use, and one win if taught.
    """
    writes = writes.withColumns({c: F.lit(None).cast("long") for c in ("uses", "wins") if c not in writes.columns})
    keyed = writes.withColumn("key", T.trigger_key(F.col("trigger"))).where("key <> ''")
    return keyed.groupBy("key").agg(
        F.max_by(T.trigger_display(F.col("trigger")), "seq").alias("trigger"),
        F.max_by("resolution", "seq").alias("resolution"),
        F.max("taught").alias("taught"),
        F.min_by(F.coalesce("uses", F.lit(1).cast("long")), "seq").alias("uses"),
        F.min_by(F.coalesce("wins", F.col("taught").cast("long")), "seq").alias("wins"),
    )


def ring_buffer(log: DataFrame, group: str, order: str, keep: int = V.EPISODES) -> DataFrame:
    """The newest ``keep`` rows of each group."""
    window = Window.partitionBy(group).orderBy(F.desc(order))
    return log.withColumn("back", F.row_number().over(window)).where(F.col("back") <= keep).drop("back")


def preload(patterns: DataFrame, limit: int = 8) -> DataFrame:
    """The strongest patterns: two for taught and the confidence, then the last use, then the id."""
    strength = F.when(F.col("taught"), 2.0).otherwise(0.0) + T.confidence(F.col("uses"), F.col("wins"), F.col("taught"))
    ranked = patterns.withColumn("strength", F.round(strength, 9))
    return ranked.orderBy(F.desc("strength"), F.desc_nulls_last("last_used"), F.desc("id")).limit(limit)
