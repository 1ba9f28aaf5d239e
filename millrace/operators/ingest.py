"""Bulk writes by the full rule against a standing store (W1b): similarity, restatement, elaboration, kin, standing and grafts.

A stored fact changes only if a write of the batch meets it, so the facts that
matter are those which some write may merge with; the store finds them by its token
index. They and the batch form a graph of token classes, and every connected
component is replayed in the order of its writes by itself, all in parallel.
What decides a pair (tokens, leading name, claim, cue gap) is computed by built-in
expressions once for each row; the replay compares, and keeps the order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vocab as V
from millrace.operators.merge import component_labels, contained_classes, similar_classes, token_classes
from millrace.sources.staging import staged

_RESULT = "seq long, target long, target_stored boolean, action string, changed boolean, demoted boolean, elaborated boolean, grafted string"


def _kin(new: str | None, old: str | None) -> str:
    a, b = (new or "").split("/"), (old or "").split("/")
    if len(a) != 3 or len(b) != 3 or "" in a or "" in b:
        return ""
    shared = next((k for k in range(3) if a[k] != b[k]), 3)
    return ("grove", "tree", "branch", "stem")[shared]


def _tree(lineage: str | None) -> str:
    head = (lineage or "").split("/")[0]
    return head if head in V.TREES else "import"


def _grafted(record: str | None, tree: str, uses: int, wins: int) -> str:
    if tree not in V.TREES or not (uses or wins):
        return record or ""
    return ";".join([*[p for p in (record or "").split(";") if p], f"{tree}:{uses}:{wins}"][-V.GRAFT_KEEP :])


class _Replay:
    """One component: stored rows and writes in order. Stored rows come before new ones, each in the order of its number."""

    def __init__(self, standings: dict[str, float]):
        self.standings = standings

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        near = {c: list(n) for c, n in zip(rows["cls"], rows["near"]) if n is not None}
        words = {c: frozenset(w) for c, w in zip(rows["cls"], rows["words"])}
        present: dict[tuple, dict] = {}  # (is new, number) -> the row as it stands
        of_class: dict[int, set] = {}
        out = []
        for row in sorted(rows.to_dict("records"), key=lambda r: (not r["stored"], r["number"])):
            place = (not row["stored"], row["number"])
            if row["stored"]:
                present[place] = row
                of_class.setdefault(row["cls"], set()).add(place)
                continue
            around = sorted(p for c in (row["cls"], *near.get(row["cls"], ())) for p in of_class.get(c, ()))
            met = next(((p, *m) for p in around if (m := self.meets(row, present[p], words))), None)
            if met is None:
                out.append((row["number"], row["number"], False, "inserted", False, False, False, ""))
                present[place] = row | {"uses": 0, "wins": 0, "grafted": ""}
                of_class.setdefault(row["cls"], set()).add(place)
                continue
            place, kept, elaborated = met
            old = present[place]
            if kept:
                out.append((row["number"], place[1], not place[0], "restated", False, False, False, old["grafted"]))
                continue
            kin, own, theirs = _kin(row["lineage"], old["lineage"]), _tree(row["lineage"]), _tree(old["lineage"])
            changed = row["claim"] != old["claim"]
            known = own in self.standings and theirs in self.standings
            demoted = kin == "grove" and known and self.standings[own] + V.TREE_MARGIN < self.standings[theirs]
            record = _grafted(old["grafted"], theirs, old["uses"], old["wins"]) if kin == "grove" else old["grafted"] or ""
            tally = {"uses": 0, "wins": 0} if changed or demoted else {"uses": old["uses"], "wins": old["wins"]}
            out.append((row["number"], place[1], not place[0], "updated", changed, demoted, elaborated, record))
            of_class[old["cls"]].discard(place)
            of_class.setdefault(row["cls"], set()).add(place)
            present[place] = row | tally | {"grafted": record}
        return pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    @staticmethod
    def meets(new: dict, old: dict, words: dict) -> tuple[bool, bool] | None:
        """Whether the write merges with the row: (only restates it, elaborates it); None if it does not."""
        if new["name"] and old["name"] and new["name"] != old["name"]:
            return None
        a, b = words[new["cls"]], words[old["cls"]]
        close = len(a & b) / len(a | b) > V.MERGE_JACCARD
        timed = not (pd.isna(new["at"]) or pd.isna(old["at"]))
        elaborated = bool(timed and new["at"] - old["at"] <= V.ELABORATE_SECONDS and b < a and old["gap"])
        restated = a < b and _kin(new["lineage"], old["lineage"]) in ("stem", "branch")
        return (restated and not elaborated and not close, elaborated) if close or elaborated or restated else None


def write_batch(batch: DataFrame, stored: DataFrame, standings: DataFrame) -> DataFrame:
    """What writes (seq, fact, lineage, ts) do to a store (id, fact, lineage, created_at, uses, wins, grafted), in order of seq.

    (seq, target, target_stored, action, changed, demoted, elaborated, grafted): the
    write was inserted (target is its own seq), updated a row, or restates one and
    changes nothing; targets are ids of stored rows, or the seq of the write that
    inserted the row. Later writes see earlier ones. ``standings`` (tree, standing, a
    row for each of the few trees) holds for the whole batch. Texts without tokens
    are inserted; null lineages are no kin; null times elaborate nothing. ``stored``
    may be narrowed to facts that some write can meet. seq and id are unique.
    """
    columns = {"uses": "long", "wins": "long", "grafted": "string"}
    old = stored.select(
        (F.col("id") * 2).alias("id"), F.lit(True).alias("stored"), F.col("id").alias("number"), "fact", "lineage",
        F.unix_timestamp("created_at").alias("at"), *[F.col(c).cast(k).alias(c) for c, k in columns.items()],
    )
    new = batch.select(
        (F.col("seq") * 2 + 1).alias("id"), F.lit(False).alias("stored"), F.col("seq").alias("number"), "fact", "lineage",
        F.unix_timestamp("ts").alias("at"), F.lit(0).cast("long").alias("uses"), F.lit(0).cast("long").alias("wins"), F.lit("").alias("grafted"),
    )
    fact = F.col("fact")
    every = staged(old.unionByName(new), "ingest-rows")
    known = token_classes(every.select("id", "fact"))
    pairs = similar_classes(known.sets).select("a", "b").unionByName(contained_classes(known.sets).toDF("a", "b"))
    pairs = staged(pairs.distinct(), "ingest-pairs")
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("cls")).agg(F.collect_set("b").alias("near"))
    labels = component_labels(pairs).withColumnRenamed("id", "cls")
    sizes = known.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    classes = sizes.join(labels, "cls", "left").join(near, "cls", "left").join(known.sets.select("cls", F.col("tokens").alias("words")), "cls")
    classes = staged(classes.where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "cls")), "ingest-classes")
    facing = every.join(known.members, "id", "left").join(classes, "cls", "left")
    alone = facing.where("component IS NULL AND NOT stored").select(
        F.col("number").alias("seq"), F.col("number").alias("target"), F.lit(False).alias("target_stored"), F.lit("inserted").alias("action"),
        *[F.lit(False).alias(c) for c in ("changed", "demoted", "elaborated")], F.lit("").alias("grafted"),
    )
    met = facing.where("component IS NOT NULL").select(
        "component", "stored", "number", "cls", "words", "near", "lineage", "at", "uses", "wins", "grafted",
        T.named_subject(fact).alias("name"),
        F.concat_ws(" ", T.polarity(fact).cast("string"), F.array_join(T.numbers(fact), " ")).alias("claim"),
        (T.cue_gap(fact) != "").alias("gap"),
    )
    trees = {r["tree"]: r["standing"] for r in standings.collect() if r["standing"] is not None}
    replay = _Replay(trees)
    return alone.unionByName(met.groupBy("component").applyInPandas(lambda rows: replay.run(rows), _RESULT))
