"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents carry a label here; everything else is text
that may be either. With the class prior p, the risk of a classifier is
p * loss(toxic as toxic) + max(0, loss(unlabelled as clean) - p * loss(toxic
as clean)): the second term is the risk on clean text, corrected by what toxic
text adds to the unlabelled, and may not fall below zero. When it does, the
step climbs it instead.

Inputs of a classifier are the presence of words and of words' beginnings (as
compounds share a stem). They are picked by a distributed count over all
documents outside the held-out fold: terms whose share among the confirmed
exceeds the one among the unlabelled by far more than chance. The classifiers
are fitted on a bounded draw; several, over different draws, are averaged.

Terms are counted in the tasks and summed by term. Only terms that the
confirmed texts alone could make striking are summed over the unlabelled ones:
a bitmap of a fixed size says which may be, and a join settles it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from classmeter.llm.common import each, held_out, saved
from classmeter.llm.quality import agreed, labelled

# Documents that a model is fitted on, at most, and terms it looks at.
MAX_TOXIC, MAX_UNLABELLED, MAX_TERMS = 5_000, 10_000, 1_000
# Lengths of the beginnings that are terms.
STEMS = (3, 4, 5, 6)
# Likelihood ratio (twice its logarithm, of Poisson counts) by which a term must be more frequent among the toxic.
ODD = 30.0
# What a unit of a term's weight costs while terms are picked.
COST = 5e-4
# Bits of the bitmap of terms; words that a task counts, or remembers, before it lets go of them; words counted together.
BITS, COUNTED, REMEMBERED, TOGETHER = 1 << 20, 300_000, 300_000, 200_000
_WORD = re.compile(r"\w+")


def terms_of(text: str | None) -> set[str]:
    """The different words of a text in lower case, the beginnings of longer ones, marked
    by a star, and by two stars those that several different words share."""
    words = set(_WORD.findall((text or "").lower()))
    stems = [w[:n] for w in words for n in STEMS if len(w) > n]
    once: set[str] = set()
    again = {x for x in stems if x in once or once.add(x)}
    return words | {x + "*" for x in once} | {x + "**" for x in again}


_NOTHING: tuple[bool, tuple] = (False, ())


class Terms:
    """`terms_of`, but only those that `wanted` holds for. What a word adds is remembered."""

    def __init__(self, wanted: Callable[[str], bool]):
        self._wanted = wanted
        self._words: dict[str, tuple[bool, tuple]] = {}

    def _look(self, word: str) -> tuple[bool, tuple]:
        stems = [(word[:n], self._wanted(word[:n] + "*"), self._wanted(word[:n] + "**")) for n in STEMS if len(word) > n]
        if len(self._words) >= REMEMBERED:
            self._words.clear()
        known = (self._wanted(word), tuple(s for s in stems if s[1] or s[2]))
        self._words[word] = known = _NOTHING if known == _NOTHING else known
        return known

    def of(self, text: str | None) -> set[str]:
        found: set[str] = set()
        once: set[str] = set()
        words = self._words
        for word in set(_WORD.findall((text or "").lower())):
            known = words.get(word) or self._look(word)
            if known is _NOTHING:
                continue
            if known[0]:
                found.add(word)
            for stem, first, again in known[1]:
                if first:
                    found.add(stem + "*")
                if again:
                    if stem in once:
                        found.add(stem + "**")
                    once.add(stem)
        return found


class TermCounter:
    """In how many texts each of their terms (see `terms_of`) is.

    Words and stems get numbers, so that the stems of many texts are counted
    together: pairs of text and stem are sorted, and those met twice or more are
    the stems that several words share.
    """

    def __init__(self) -> None:
        self._words: dict[str, int] = {}
        self._stems: dict[str, int] = {}
        self._flat, self._ends = array("q"), array("q", [0])  # the stems of all words, and where a word's end
        self._met, self._sizes = array("q"), array("q")  # words of the texts, and how many each text has
        self._counts = [np.zeros(0, np.int64) for _ in range(3)]  # of words, stems, and stems met again
        self.texts = 0

    def __len__(self) -> int:
        return len(self._words)

    def add(self, text: str | None) -> None:
        words, before = self._words, len(self._met)
        for word in set(_WORD.findall((text or "").lower())):
            at = words.get(word)
            if at is None:
                at = words[word] = len(words)
                for n in STEMS:
                    if len(word) > n:
                        self._flat.append(self._stems.setdefault(word[:n], len(self._stems)))
                self._ends.append(len(self._flat))
            self._met.append(at)
        self._sizes.append(len(self._met) - before)
        self.texts += 1
        if len(self._met) >= TOGETHER:
            self._count()

    def _count(self) -> None:
        flat, ends, met, sizes = (np.array(a, np.int64) for a in (self._flat, self._ends, self._met, self._sizes))
        self._met, self._sizes = array("q"), array("q")
        n = (ends[1:] - ends[:-1])[met]
        place = np.arange(n.sum()) + np.repeat(ends[met] - (np.cumsum(n) - n), n)
        all_ = max(1, len(self._stems))
        pair, times = np.unique(np.repeat(np.repeat(np.arange(len(sizes)), sizes), n) * all_ + flat[place], return_counts=True)
        stem = pair % all_
        for i, (found, size) in enumerate(((met, len(self._words)), (stem, len(self._stems)), (stem[times > 1], len(self._stems)))):
            new = np.bincount(found, minlength=size)
            new[: len(self._counts[i])] += self._counts[i]
            self._counts[i] = new

    def counts(self) -> Iterator[tuple[str, int]]:
        self._count()
        for names, counts, mark in zip((self._words, self._stems, self._stems), self._counts, ("", "*", "**")):
            yield from ((name + mark, n) for name, n in zip(names, counts.tolist()) if n)


def _bit(term: str) -> int:
    return zlib.crc32(term.encode()) % BITS


def term_counts(texts: DataFrame, bitmap: bytes | None = None) -> DataFrame:
    """(term, n): in how many rows of `texts` (text) each term is; the null term counts all rows.

    With a bitmap, only terms whose bit is set are given.
    """

    def rows(counter: TermCounter) -> pa.RecordBatch:
        found = [(None, counter.texts)]
        found += [(t, n) for t, n in counter.counts() if bitmap is None or bitmap[_bit(t) >> 3] >> (_bit(t) & 7) & 1]
        terms, counts = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter()
        for batch in each(batches):
            for text in batch.column(0):
                counter.add(text.as_py())
                if len(counter) > COUNTED:
                    yield rows(counter)
                    counter = TermCounter()
        yield rows(counter)

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def _bitmap(terms: DataFrame) -> bytes:
    """The bits of the terms; its size does not depend on their number."""
    bits = terms.select(F.pmod(F.crc32("term"), F.lit(BITS)).cast("int").alias("bit"))
    words = bits.groupBy(F.expr("bit div 32").alias("at")).agg(F.expr("bit_or(shiftleft(1L, bit % 32))").alias("bits"))
    out = np.zeros(BITS // 32, "<u4")
    for r in words.collect():  # at most BITS / 32 rows
        out[r.at] = r.bits
    return out.tobytes()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Classifier:
    """Averaged logistic classifiers over the presence of terms."""

    weights: dict[str, float]
    base: float

    def terms(self) -> Terms:
        return Terms(self.weights.__contains__)

    def score(self, text: str | None, terms: Terms | None = None) -> float:
        found = (terms or self.terms()).of(text)
        return float(_sigmoid(np.array(self.base + sum(self.weights[w] for w in sorted(found)))))


def fit_nnpu(
    x: np.ndarray, toxic: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, least: float = 0.0
) -> np.ndarray:
    """Weights (the last is the base) that minimise the corrected risk, by Adam steps over all rows.

    A row of `x` is a set of terms; `toxic` and `unlabelled` say how many
    documents of each kind have it. The loss is the logistic one; its slope for
    a target of +1 is sigmoid(f) - 1, for -1 sigmoid(f). A term can only speak
    for toxicity, and `least` is what a unit of its weight costs: negative
    weights are set to 0.
    """
    x = np.c_[x, np.ones(len(x), x.dtype)]
    p, u = prior * toxic / toxic.sum(), unlabelled / unlabelled.sum()
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        f = x @ w.astype(x.dtype)
        high = _sigmoid(f)
        clean = float((u - p) @ np.logaddexp(0, f))
        slope = x.T @ (u * high - p if clean >= 0 else (p - u) * high).astype(x.dtype)
        slope[:-1] += least
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    max_toxic: int = MAX_TOXIC,
    max_unlabelled: int = MAX_UNLABELLED,
    max_terms: int = MAX_TERMS,
    classifiers: int = 3,
) -> Classifier:
    """A classifier from `labels` (doc_id, toxic) and unlabelled text, none of it held out.

    `prior` is the share of toxic documents; by default the one among the labels
    outside the held-out fold; labels that contradict each other are left out.
    Terms are counted over all rows. `max_toxic` and `max_unlabelled` ids, the
    first in the order of a hash, are fitted on; rows with the same terms are
    one, and at most as many different ones as both together are taken, the most
    frequent first. Without toxic examples every text scores 0; the same if no
    term tells them apart.
    """
    known = agreed(labels, "toxic")
    share = known.agg(F.avg("y")).first()[0]
    if not share:
        return Classifier({}, -40.0)
    prior = min(max(share if prior is None else prior, 1e-3), 0.9)
    known = saved(known.where("y = 1"), "toxic-ids")
    outside = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = saved(term_counts(outside.join(known, "doc_id")), "toxic-terms")
    n_p, n_u = (frame.first() for frame in (toxic.where("term is null"), outside.agg(F.count(F.lit(1)).alias("n"))))
    n_p, n_u = (n_p.n or 0) if n_p else 0, n_u.n
    if not n_p:
        return Classifier({}, -40.0)

    def striking(u: Column) -> tuple[Column, Column]:
        by_chance = (u + 1) / (n_u + 1) * n_p
        odd = 2 * (F.col("p") * F.ln(F.col("p") / by_chance) - F.col("p") + by_chance)
        return (F.col("p") > by_chance) & (odd >= ODD), odd

    may_be, _ = striking(F.col("p"))  # confirmed texts are among all, and more texts with a term only make it less striking
    terms_ = toxic.where("term is not null").withColumnRenamed("n", "p").where(may_be)
    counts = saved(term_counts(outside, _bitmap(terms_)), "unlabelled-terms").withColumnRenamed("n", "u")
    is_, odd = striking(F.coalesce("u", F.lit(0)))
    picked = terms_.join(counts, "term", "left").where(is_).select("term", odd.alias("odd"))
    terms = sorted(r.term for r in picked.orderBy(F.desc("odd"), "term").limit(max_terms).collect())
    if not terms:
        return Classifier({}, -40.0)

    confirmed = labelled(docs, known, max_toxic).select(F.lit(True).alias("toxic"), "text")
    drawn = outside.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled)
    drawn = outside.join(F.broadcast(drawn), "doc_id")  # at most max_unlabelled ids
    column = {t: i for i, t in enumerate(terms)}
    wanted = set(terms)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def terms_in(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Terms(wanted.__contains__).of
        for batch in each(batches):
            yield pa.array([sorted(of(x.as_py())) for x in batch], pa.list_(pa.string()))

    both = confirmed.unionByName(drawn.select(F.lit(False).alias("toxic"), "text"))
    held = both.select("toxic", terms_in(F.col("text").cast("string")).alias("terms"))
    held = held.groupBy("toxic", "terms").agg(F.count(F.lit(1)).alias("n"))  # copies of a document are one row
    held = held.orderBy(F.desc("n"), "toxic", "terms").limit(max_toxic + max_unlabelled)
    sets = {(r.toxic, tuple(sorted(column[t] for t in r.terms))): r.n for r in held.collect()}
    different = sorted({places for _, places in sets})
    x = np.zeros((len(different), len(terms)), np.float32)
    for i, places in enumerate(different):
        x[i, places] = 1
    n = {kind: np.array([sets.get((kind, places), 0) for places in different], float) for kind in (True, False)}
    fitted = []
    for seed in range(classifiers):
        rng = np.random.default_rng(seed)
        drawn = [rng.multinomial(int(c.sum()), c / c.sum()).astype(float) for c in (n[True], n[False])]
        used = np.flatnonzero(fit_nnpu(x, *drawn, prior, least=COST)[:-1] > 0.05)
        again = fit_nnpu(x[:, used], *drawn, prior, least=COST / 20)  # the cost picks terms, but makes their weights too small
        fitted.append(np.zeros(len(terms) + 1))
        fitted[-1][[*used, -1]] = again
    weights = np.mean(fitted, axis=0)
    return Classifier(dict(zip(terms, weights[:-1].tolist())), float(weights[-1]))


def score(model: Classifier, text: Column) -> Column:
    """How likely a text is toxic, 0 to 1; null and empty texts have no words and score lowest."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = model.terms()
        for batch in each(batches):
            yield pa.array([model.score(x.as_py(), terms) for x in batch], pa.float64())

    return of(text)
