"""Quality rules (operator 1): lines first, then documents. DataFrame functions only.

Every line is judged by punctuation, navigation, symbol, shouting and
boilerplate rules; lines that fail are removed, and a document that loses too
large a part of its words, or fails the base counts, is rejected.

One pass over the rows, no shuffle: everything is a function of one text, so
the plan is a scan and a projection at any size, and skew cannot arise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hidden, let

_GAP = r"[ \t\n\x0B\f\r]+"
_BLANK = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"

BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "click here",
    "read more",
    "sign up for our newsletter",
    "subscribe to our",
    "share this article",
    "follow us on",
    "back to top",
    "skip to content",
    "lorem ipsum",
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    A line fails if it has a separator character (``|``, ``»``, ``›``, ``•``) for
    every ``words_per_separator`` words or more often (navigation), a symbol for
    every ``words_per_symbol`` words or more often, more capital than small
    letters and at least ``min_capitals`` of them (shouting), at least
    ``min_open_words`` words but no sentence mark anywhere (punctuation), or a
    boilerplate phrase and at most ``max_boilerplate_words`` words.

    A document fails at the base below ``min_words`` words or above
    ``max_repeat_percent`` % words in repeated 3-word windows, and is rejected
    when its failing lines hold more than ``max_loss_percent`` % of its words.
    """

    words_per_separator: int = 4
    words_per_symbol: int = 4
    min_capitals: int = 20
    min_open_words: int = 3
    max_boilerplate_words: int = 25
    min_words: int = 50
    max_repeat_percent: int = 50
    max_loss_percent: int = 50


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order, as an array."""
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def n_words(line: Column) -> Column:
    """The number of words of one line."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _GAP)))


def _without_match(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` lie in matches of ``pattern``."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the same text.

    The windows' 64-bit hashes are sorted, so equal ones become neighbours. Few
    repeated values are looked up in the windows in order; where there are many,
    (hash, position) pairs are sorted instead, so no text costs quadratic time.
    The covered words are the union of the intervals [p, p + 3).
    """

    def spread(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def looked_up(hashes: Column, twice: Column) -> Column:
        found = F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i))
        return spread(F.array_compact(found))

    def sorted_pairs(hashes: Column) -> Column:
        def covered(s: Column) -> Column:
            equal = F.filter(
                s,
                lambda x, i: (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True)
                | (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True),
            )
            return spread(F.sort_array(F.transform(equal, lambda x: x["p"])))

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return let(F.sort_array(pairs), covered)

    def count(hashes: Column) -> Column:
        def chosen(twice: Column) -> Column:
            few = F.size(twice)
            return (
                F.when(few == 0, F.lit(0).cast("long"))
                .when(few <= 32, looked_up(hashes, twice))
                .otherwise(sorted_pairs(hashes))
            )

        twice = let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (h == F.get(s, i + 1)).eqNullSafe(True)))
        return let(twice, chosen)

    def windows(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(F.slice(every, F.lit(1), F.size(w) - 2), count)

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(windows(w)))


def line_fails(line: Column, rules: QualityRules = QualityRules()) -> Column:
    """True for a line with words that breaks a rule; lines without words never fail."""

    def judged(n: Column) -> Column:
        separators = _without(line, "|»›•")
        symbols = _without(line, _SYMBOLS)
        capitals = _without_match(line, r"\p{Lu}+")
        phrase = F.lower(line)
        boilerplate = F.lit(False)
        for p in BOILERPLATE:
            boilerplate = boilerplate | F.contains(phrase, F.lit(p))
        # each conjunction begins with its cheapest test, which decides for most lines
        navigation = let(separators, lambda k: (k > 0) & (k * rules.words_per_separator >= n))
        noise = let(symbols, lambda k: (k > 0) & (k * rules.words_per_symbol >= n))
        shouting = let(capitals, lambda k: (k >= rules.min_capitals) & (k > _without_match(line, r"\p{Ll}+")))
        unmarked = (n >= rules.min_open_words) & ~line.rlike("[.!?…。！？:;]")
        return (n > 0) & (navigation | noise | shouting | unmarked | ((n <= rules.max_boilerplate_words) & boilerplate))

    return let(n_words(line), judged)


def apply_quality_rules(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """All columns of ``docs`` and a struct ``quality``.

    The struct holds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lost_words, clean_text and kept. A null text
    has no words: zero counts, base_failed, not kept, clean_text null. Rows are
    independent, so repeated rows and ties need no rule; an empty table gives an
    empty one. If ``docs`` has a column ``quality``, the new one is ``quality_``
    (and so on until it is free).
    """
    name = hidden(docs.columns, "quality")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def judged(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        seen = F.filter(lines, lambda line: F.btrim(line, F.lit(_BLANK)) != "")
        flagged = F.transform(
            lines,
            lambda line: F.struct(line.alias("line"), line_fails(line, rules).alias("fails")),
        )

        def counted(w: Column, s: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                _without(t, _SYMBOLS).cast("long").alias("n_symbols"),
                (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
            )

        def parted(f: Column) -> Column:
            bad = F.filter(f, lambda x: x["fails"])
            good = F.transform(F.filter(f, lambda x: ~x["fails"]), lambda x: x["line"])
            return F.struct(
                F.aggregate(
                    bad, F.lit(0).cast("long"), lambda a, x: a + n_words(x["line"])
                ).alias("lost_words"),
                F.array_join(good, "\n").alias("clean_text"),
            )

        base = let(words_of(t), lambda w: let(seen, lambda s: counted(w, s)))
        return F.struct(base.alias("base"), let(flagged, parted).alias("lines"))

    def verdict(q: Column) -> Column:
        base, lines = q["base"], q["lines"]
        failed = (base["n_words"] < rules.min_words) | (
            base["n_repeat_words"] * 100 > base["n_words"] * rules.max_repeat_percent
        )
        lost = lines["lost_words"] * 100 > base["n_words"] * rules.max_loss_percent
        return F.struct(
            *(base[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed.alias("base_failed"),
            lines["lost_words"].alias("lost_words"),
            F.when(F.col(f"`{text_col}`").isNotNull(), lines["clean_text"]).alias("clean_text"),
            (~failed & ~lost).alias("kept"),
        )

    return docs.withColumn(name, let(let(text, judged), verdict))
