"""Line dedup (operator 10): repeated runs of lines by prefix doubling. DataFrame functions only.

Every document is a sequence of line ids. Round k names the prefix of 2^k lines
of each suffix by its rank among all such prefixes (a range-partitioned sort),
from the ranks of its two halves, so sorting by name is the suffix array cut at
2^k lines, and suffixes with one name form an interval whose longest common
prefix has at least 2^k lines. Suffixes alone in their interval are discarded
before the next round, which keeps the rounds small.

A run of ``min_words`` words or more that starts at an earlier place too is a
later copy, and its lines are deleted. What decides is the interval of suffixes
whose longest common prefix reaches ``min_words``: two ranks of one level,
overlapping, name such a prefix, and all places of an interval but the first are
later copies. Every maximal repeated run is the union of the prefixes that just
reach ``min_words``, going forward from a line or back from it, so doubling stops
at that length; runs of removed lines that touch are one maximal run.

Keys that hold a large share of all rows (a very common line) are joined without
a shuffle of their rows (``lookup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hidden, let, lookup, staged
from millrace.llm.quality import n_words

#: Splits a text before each line with a word: blank lines stay with the line before them.
_LINE = r"\n(?=[ \t\x0B\f\r]*[^ \t\n\x0B\f\r])"
_BLANK = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    """The lines of a text, each with the blank lines that follow it; "\\n" joins them again."""
    return F.split(text, _LINE, -1)


def _reach(counts: Column, least: int) -> Column:
    """How many of the first counts sum up to ``least`` or more; null if all do not."""
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
    end = F.aggregate(
        counts,
        start,
        lambda a, x: F.when(a["s"] >= least, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))),
    )
    return let(end, lambda e: F.when(e["s"] >= least, e["n"]))


def _once(texts: DataFrame) -> DataFrame:
    """``texts`` with one row for each (id, h); only texts that are repeated are shuffled."""
    repeated = texts.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = staged(repeated.select(F.col("id").alias("r_id"), F.col("h").alias("r_h")), "lines-repeated")
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))
    return texts.join(repeated, same, "left_anti").unionByName(texts.join(repeated, same, "left_semi").dropDuplicates(["id", "h"]))


def _line_table(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, h, at, a, b, ahead, back): line ``at`` of text h with its 128-bit id and its two windows' lengths."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def rows(lines: Column) -> Column:
        bare = F.transform(lines, lambda x: F.btrim(x, F.lit(_BLANK)))
        counts = F.transform(lines, n_words)

        def each(b: Column, n: Column) -> Column:
            return F.transform(
                b,
                lambda x, i: F.struct(
                    i.alias("at"),
                    F.xxhash64(x).alias("a"),
                    F.xxhash64(F.lit(1), x).alias("b"),
                    _reach(F.slice(n, i + 1, F.lit(least)), least).alias("ahead"),
                    _reach(
                        F.reverse(F.slice(n, F.greatest(i + 2 - least, F.lit(1)), F.least(i + 1, F.lit(least)))), least
                    ).alias("back"),
                ),
            )

        return let(bare, lambda b: let(counts, lambda n: F.filter(each(b, n), lambda r: F.get(b, r["at"]) != "")))

    texts = _once(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")))
    return texts.select("id", "h", F.inline(let(lines_of(F.col("text")), rows)))


def _ranked(places: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, name, n): a name for each key that occurs n times, twice or more, in the order of the keys.

    Counts are combined before the shuffle; the sort is range-partitioned, and
    written down because its boundaries come from a sample.
    """
    twice = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = twice.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def _named(windows: DataFrame, level: DataFrame, at: str, name: str) -> DataFrame:
    """``windows`` whose line ``at`` has a name on this level, and that name."""
    names = level.select(*(F.col(c).alias(f"r_{c}") for c in ("id", "h", "at")), F.col("name").alias(name))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")) & (F.col(at) == F.col("r_at"))
    return windows.join(names, same).drop("r_id", "r_h", "r_at")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, h, gone): for each text (id and hash) with later copies, the numbers of their lines."""
    lines = staged(_line_table(docs, id_col, text_col, min_words), "lines")
    first = lines.select("id", "h", "at", "a", "b")
    names = lookup(first, _ranked(first, ["a", "b"], "line-ranks"), ["a", "b"], "n", "inner").select("id", "h", "at", "name")
    levels = [staged(names, "line-names")]
    while 2 ** len(levels) <= min_words:
        step = 2 ** (len(levels) - 1)
        later = Window.partitionBy("id", "h").orderBy("at").rangeBetween(step, step)
        halves = levels[-1].withColumn("next", F.first("name").over(later)).where("next IS NOT NULL")
        halves = staged(halves.withColumnRenamed("name", "own"), "line-halves")
        names = lookup(halves, _ranked(halves, ["own", "next"], "line-ranks"), ["own", "next"], "n", "inner")
        levels.append(staged(names.select("id", "h", "at", "name"), "line-names"))

    ahead = lines.where("ahead IS NOT NULL").select("id", "h", F.col("at").alias("start"), F.col("ahead").alias("size"))
    back = lines.where("back IS NOT NULL").select(
        "id", "h", (F.col("at") - F.col("back") + 1).alias("start"), F.col("back").alias("size")
    )
    windows = ahead.unionByName(back)
    named = None
    for k, level in enumerate(levels):
        sized = windows.where(F.col("size").between(2**k, 2 ** (k + 1) - 1))
        ends = sized.withColumn("last", (F.col("start") + F.col("size") - 2**k).cast("int"))
        got = _named(_named(ends, level, "start", "n1"), level, "last", "n2")
        named = got if named is None else named.unionByName(got)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "start").alias("place")
    named = staged(named.select("size", "n1", "n2", place), "line-windows")
    # each class is an interval of the suffix array whose common prefix reaches min_words
    classes = named.groupBy("size", "n1", "n2").agg(
        F.min("place").alias("origin"), F.max("place").alias("end"), F.count(F.lit(1)).alias("n")
    )
    classes = staged(classes.where("end > origin").drop("end"), "line-classes")
    copies = lookup(named, classes, ["size", "n1", "n2"], "n", "inner").where("place > origin")
    gone = F.explode(F.sequence(F.col("place.start"), F.col("place.start") + F.col("size") - 1)).alias("at")
    return (
        copies.select("place.id", "place.h", gone)
        .groupBy("id", "h")
        .agg(F.array_sort(F.collect_set("at")).alias("gone"))
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6
) -> DataFrame:
    """All columns of ``docs``, and clean_text string, removed_lines array<int>.

    A line (with a word) is removed if it lies in a run of consecutive lines with
    ``min_words`` words or more in total that also starts at an earlier place;
    places are ordered by id (null ids last), hash of the text and line number.
    Lines are compared without the blanks around them; blank lines between do
    not count and go with the line before them. Rows with the same id and text
    are one document: each keeps the same lines. A null text has no lines and
    stays null; an empty table gives an empty one. ``removed_lines`` numbers the
    lines with words (and a blank beginning as line 0) from 0. New columns whose
    names are taken get a trailing underscore.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    clean, removed = (hidden(docs.columns, c) for c in ("clean_text", "removed_lines"))
    gone = repeated_lines(docs, id_col, text_col, min_words)
    own_id, own_h, lost = (hidden([*docs.columns, clean, removed], c) for c in ("_gone_id", "_gone_h", "_gone"))
    gone = gone.toDF(own_id, own_h, lost)
    text = F.col(f"`{text_col}`")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    joined = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (key == F.col(own_h)), "left")
    kept = F.filter(lines_of(text), lambda _, i: ~F.array_contains(lost, i))
    return joined.select(
        *[docs[f"`{c}`"] for c in docs.columns],
        F.when(F.col(lost).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(clean),
        F.coalesce(lost, F.array().cast("array<int>")).alias(removed),
    )
