"""Toxicity (operator 3): weak supervision by a generative label model, then a linear classifier.

1. Lexicons are induced from a bounded sample of labelled rows: words and word
   beginnings that are much more frequent in toxic documents.
2. Many voters look for these lexicons, for a fixed one and for patterns. The
   votes of all learning documents are counted by their combination (a bit mask).
3. A generative model is fitted by expectation maximisation to the votes of the
   unlabelled documents; labelled ones anchor it. In either class it has a rate
   for each voter (its accuracy) and a tree of dependences between voters, with
   conditional rates along its edges (their correlations). Each round is one pass
   over the counted votes; only sums over pairs of voters come to the driver.
4. A logistic regression on the lexicon's terms is trained on the posterior labels
   of a bounded sample of documents, most of them unlabelled, and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hidden, staged

#: Insults known beforehand, for one of the voters.
INSULTS = (
    "idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown",
    "imbecile", "filth", "vermin", "dumb", "freak", "creep", "jerk", "bastard",
)
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = range(3, 9)
_INSULT = "|".join(INSULTS)
#: Pattern voters over lower-cased texts; each is looked for only where a text has one of the words.
_PATTERNS = (
    (frozenset(INSULTS), re.compile(rf"\b(?:you|he|she|they|that|this|the) (?:\w+ )?(?:{_INSULT})\b")),
    (frozenset(INSULTS), re.compile(rf"\b(?:{_INSULT})s? (?:and|like|who|\w+ing) ")),
    (frozenset(("hate", "despise", "loathe")), re.compile(r"\b(?:hate|despise|loathe)s? (?:you|him|her|them|those|these|the)\b")),
    (frozenset(("kill", "hurt", "destroy")), re.compile(r"\b(?:will|should|going to|gonna) (?:kill|hurt|destroy)\b")),
    (frozenset(("shut", "lost", "away")), re.compile(r"\b(?:shut up|get lost|go away)\b")),
    (None, re.compile(r"!{2,}")),
)
_MEMO = 200_000


@dataclass(frozen=True)
class ToxicityParams:
    """Sizes of the model; none of them limits which documents are voted on or scored.

    ``max_labelled``: at most so many labelled rows are learned from (those with the
    least hash of their id). ``sample``: about so many unlabelled documents, chosen
    by a hash of id and text, train the classifier with them. ``min_toxic``: in so
    many toxic documents a term must occur to be considered; ``terms``: so many
    terms, the strongest, enter the classifier. ``voters``: the strongest
    ``voter_terms`` of them are dealt to so many lexicon voters. ``anchor``: the
    share of labelled rows in the evidence of the label model, at any number of
    unlabelled ones; ``label_accuracy``: how far a label is trusted.
    """

    max_labelled: int = 16_000
    sample: int = 16_000
    min_toxic: int = 4
    terms: int = 3_000
    voters: int = 24
    voter_terms: int = 480
    anchor: float = 0.5
    label_accuracy: float = 0.95
    rounds: int = 8


def terms_of(text: str | None) -> set[str]:
    """The distinct lower-cased words of a text and, marked by a hyphen, their beginnings."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:k] + "-" for w in words for k in _BEGINNINGS if len(w) >= k}


class TermIndex:
    """Numbers of the known terms of a text; the terms of a word are remembered for a bounded number of words."""

    def __init__(self, terms: list[str]):
        self.number = {t: k for k, t in enumerate(terms)}
        self._memo: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        number = self.number
        found = [number[t] for t in (word, *(word[:k] + "-" for k in _BEGINNINGS if len(word) >= k)) if t in number]
        if len(self._memo) < _MEMO:
            self._memo[word] = tuple(found)
        return tuple(found)

    def of_words(self, words: set[str]) -> np.ndarray:
        out: set[int] = set()
        memo = self._memo
        for w in words:
            got = memo.get(w)
            out.update(self._word(w) if got is None else got)
        return np.array(sorted(out), dtype=np.int32)

    def of(self, text: str | None) -> np.ndarray:
        return self.of_words(set(_WORD.findall(text.lower())) if text else set())


class Voters:
    """The bit mask of voters that hit a text: the patterns first, then the lexicons."""

    def __init__(self, terms: list[str], voter_of: np.ndarray):
        self.index, self.voter_of = TermIndex(terms), voter_of

    def vote(self, text: str | None) -> tuple[int, np.ndarray]:
        """(mask, terms) of a text."""
        if not text:
            return 0, np.zeros(0, dtype=np.int32)
        low = text.lower()
        words = set(_WORD.findall(low))
        found = self.index.of_words(words)
        mask = sum(1 << k for k, (need, p) in enumerate(_PATTERNS) if (need is None or need & words) and p.search(low))
        for v in set(self.voter_of[found].tolist()):
            if v >= 0:
                mask |= 1 << (len(_PATTERNS) + v)
        return mask, found


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n) & 1).astype(float)


@dataclass(frozen=True)
class LabelModel:
    """P(votes, class): a prior, and in each class a tree of voters with the rate of a vote given its parent's.

    ``parent`` of a root is -1; ``rate[c, i, v]`` is P(voter i hits | class c, its
    parent's vote v), equal for both v at a root.
    """

    prior: float
    parent: np.ndarray
    rate: np.ndarray

    def logit(self, masks: np.ndarray) -> np.ndarray:
        """The log odds of the toxic class for each mask."""
        n = len(self.parent)
        x = _bits(masks, n).astype(int)
        above = np.where(self.parent >= 0, x[:, np.maximum(self.parent, 0)], 0)
        out = np.full(len(masks), np.log(self.prior / (1 - self.prior)))
        for c, sign in ((1, 1), (0, -1)):
            hit = self.rate[c, np.arange(n), above]
            out += sign * np.log(np.where(x == 1, hit, 1 - hit)).sum(axis=1)
        return out


def vote_sums(masks: np.ndarray, weight: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
    """(2, n + 1, n + 1): for each class, the expected counts of pairs of votes; the last row counts single votes, its end all."""
    x = np.concatenate([_bits(masks, n), np.ones((len(masks), 1))], axis=1)
    return np.stack([(x * (weight * p)[:, None]).T @ x for p in (1 - toxic, toxic)])


def dependence_tree(sums: np.ndarray) -> np.ndarray:
    """The parent of each voter in the tree of largest mutual information within the classes (-1: a root)."""
    n = sums.shape[1] - 1
    score = np.zeros((n, n))
    for s in sums:
        total = s[-1, -1] + 4
        both = s[:n, :n] + 1
        one = np.diag(s)[:n] + 2
        a, b = one[:, None], one[None, :]
        cells = (both, a - both, b - both, total - a - b + both)  # both hit, one hits, the other, none
        for cell, product in zip(cells, (a * b, a * (total - b), (total - a) * b, (total - a) * (total - b))):
            cell = np.maximum(cell, 1e-9)
            score += cell * np.log(np.maximum(cell * total / product, 1e-12))
    np.fill_diagonal(score, -np.inf)
    parent = np.full(n, -1)
    if n < 2:
        return parent
    best, nearest = score[0].copy(), np.zeros(n, dtype=int)
    inside = np.zeros(n, dtype=bool)
    inside[0] = True
    for _ in range(n - 1):
        at = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[at], inside[at] = nearest[at], True
        closer = ~inside & (score[at] > best)
        best[closer], nearest[closer] = score[at][closer], at
    return parent


def model_of(sums: np.ndarray, parent: np.ndarray | None = None) -> LabelModel:
    """The model with these expected counts, smoothed by one vote for each rate."""
    n = sums.shape[1] - 1
    parent = dependence_tree(sums) if parent is None else parent
    rate = np.zeros((2, n, 2))
    for c, s in enumerate(sums):
        total = s[-1, -1]
        for i in range(n):
            j = parent[i]
            alone = (s[i, i] + 0.5) / (total + 1)
            if j < 0:
                rate[c, i] = alone
            else:
                # an edge of few votes leans on the voter's own rate
                rate[c, i, 1] = (s[i, j] + 4 * alone) / (s[j, j] + 4)
                rate[c, i, 0] = (s[i, i] - s[i, j] + 4 * alone) / (total - s[j, j] + 4)
    prior = float(np.clip((sums[1, -1, -1] + 1) / (sums[:, -1, -1].sum() + 2), 1e-4, 0.5))
    return LabelModel(prior, parent, np.clip(rate, 1e-5, 1 - 1e-5))


def fit_label_model(
    known: np.ndarray, unlabelled: Callable[[LabelModel], np.ndarray], anchor: float, rounds: int
) -> LabelModel:
    """Expectation maximisation from the sums of labelled rows and a function for those of unlabelled ones.

    ``known`` gives the first model and keeps the share ``anchor`` of the evidence in
    every round; the tree is chosen once, after the first pass over all votes.
    """
    model, parent = model_of(known), None
    for _ in range(rounds):
        seen = unlabelled(model)
        total, own = seen[:, -1, -1].sum(), known[:, -1, -1].sum()
        if total <= 0 or own <= 0:
            break
        every = seen + known * (total / own * anchor / (1 - anchor))
        # as many as there are rows, so that smoothing keeps its place
        every *= (total + own) / every[:, -1, -1].sum()
        parent = dependence_tree(every) if parent is None else parent
        new = model_of(every, parent)
        done = abs(new.prior - model.prior) < 1e-5 and np.abs(new.rate - model.rate).max() < 1e-4
        model = new
        if done:
            break
    return model


def fit_linear(rows: list[np.ndarray], target: np.ndarray, n_terms: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularised logistic regression on presence of terms, with soft targets."""
    if not rows:
        return np.zeros(n_terms), 0.0
    sizes = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), sizes)
    term = np.concatenate(rows)
    w, b = np.zeros(n_terms), 0.0
    g2, b2 = np.full(n_terms, 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(at, weights=w[term], minlength=len(rows)) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(term, weights=e[at], minlength=n_terms) + 0.5 * w
        g2 += g * g
        b2 += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * e.sum() / np.sqrt(b2)
    return w, b


def _counted(docs: DataFrame, known: list[str] | None) -> DataFrame:
    """(term, n): documents of ``docs`` (column text) with a term; summed in each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None if known is None else TermIndex(known)
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0):
                if index is None:
                    count.update(terms_of(text.as_py()))
                else:
                    count.update(known[k] for k in index.of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: str = "true",
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    params: ToxicityParams = ToxicityParams(),
) -> DataFrame:
    """All columns of ``docs`` and ``score`` double (0 to 1; ``score_`` and so on if the name is taken).

    ``labels`` has ids and 0/1 labels; ``learn_from`` is a SQL condition on the
    columns of ``docs`` and ``labels`` that have the id. Only texts are inputs of
    a score. A null or empty text has no terms and gets the intercept's score;
    null labels or ids are not learned from; repeated labels count as repeated
    rows; an empty table gives an empty one. Without any toxic label every text has
    one and the same low score.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").alias("text")
    chosen = (
        labels.where(learn_from)
        .where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
        .select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(params.max_labelled)
    )
    # at most max_labelled rows of an id and a label
    chosen = staged(chosen, "toxic-labels")
    named = docs.select(F.col(f"`{id_col}`").alias("_own"), text)
    sample = staged(named.join(F.broadcast(chosen), F.col("_own") == F.col("_id")).select("text", "label"), "toxic-sample")
    n1, n0 = (sample.where(F.col("label") == k).count() for k in (1, 0))

    toxic = _counted(sample.where("label = 1"), None).where(F.col("n") >= params.min_toxic)
    frequent = {r["term"]: r["n"] for r in toxic.collect()}  # terms of at most max_labelled rows
    clean = {r["term"]: r["n"] for r in _counted(sample.where("label = 0"), sorted(frequent)).collect()} if frequent else {}
    odds = {
        t: np.log((n + 0.5) / (n1 + 1)) - np.log((clean.get(t, 0) + 0.5) / (n0 + 1)) for t, n in frequent.items()
    }
    weight = {t: odds[t] * np.sqrt(frequent[t]) for t in odds}
    terms = sorted((t for t in odds if odds[t] > 1), key=lambda t: (-weight[t], t))[: params.terms]
    terms += [w for w in INSULTS if w not in terms]
    voter_of = np.full(len(terms), -1)
    for k, t in enumerate([t for t in terms if odds.get(t, 0) > 2][: params.voter_terms]):
        voter_of[terms.index(t)] = k % params.voters
    for k, t in enumerate(terms):
        if t in INSULTS:
            voter_of[k] = params.voters
    n_voters = len(_PATTERNS) + params.voters + 1

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms, voter_of)
        for batch in batches:
            count = Counter(voters.vote(t.as_py())[0] for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64())], names=["mask", "n"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms, voter_of)
        for batch in batches:
            got = [voters.vote(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in got], pa.int64()), batch.column(1), pa.array([f.tolist() for _, f in got], pa.list_(pa.int32()))],
                names=["mask", "label", "terms"],
            )

    open_rows = docs.where(learn_from).join(F.broadcast(chosen.select(F.col("_id").alias(id_col)).distinct()), id_col, "left_anti")
    votes = open_rows.select(text).mapInArrow(vote, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n"))
    votes = staged(votes, "toxic-votes")
    n_open = votes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def sums_of(model: LabelModel) -> np.ndarray:
        """The expected counts of all unlabelled documents: one pass over the counted votes."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, n_voters + 1, n_voters + 1))
            for batch in batches:
                masks, n = (c.to_numpy() for c in batch.columns)
                p = 1 / (1 + np.exp(-np.clip(model.logit(masks), -30, 30)))
                total += vote_sums(masks, n.astype(float), p, n_voters)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

        out = np.zeros(2 * (n_voters + 1) ** 2)
        for r in votes.mapInArrow(work, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
            out[r["cell"]] = r["s"]
        return out.reshape(2, n_voters + 1, n_voters + 1)

    part = min(1.0, params.sample / max(1, n_open))
    hashed = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(1 << 30))
    drawn = open_rows.where(hashed < int(part * (1 << 30))).select(text, F.lit(-1).alias("label"))
    train = sample.select("text", "label").unionByName(drawn).mapInArrow(featured, "mask long, label int, terms array<int>")
    fitted = train.collect()  # max_labelled and about sample rows of known terms
    weights, intercept = np.zeros(len(terms)), 0.0
    masks, known = (np.array([r[c] for r in fitted], dtype=np.int64) for c in ("mask", "label"))
    if n1:
        trust = params.label_accuracy
        gold = np.where(known == 1, trust, 1 - trust)
        model = fit_label_model(
            vote_sums(masks[known >= 0], np.ones(int((known >= 0).sum())), gold[known >= 0], n_voters), sums_of, params.anchor, params.rounds
        )
        # a label is one more vote, of known accuracy
        logit = model.logit(masks) + np.where(known < 0, 0.0, np.log(gold / (1 - gold)))
        target = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        weights, intercept = fit_linear([np.array(r["terms"], dtype=int) for r in fitted], target, len(terms))
    elif len(known):
        intercept = float(np.log(0.5 / (len(known) + 0.5)))
    at = docs.columns.index(text_col)
    name = hidden(docs.columns, "score")
    names = [*docs.columns, name]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex(terms)
        for batch in batches:
            z = np.array([weights[index.of(t.as_py())].sum() + intercept for t in batch.column(at)])
            out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{schema}, `{name}` double")
