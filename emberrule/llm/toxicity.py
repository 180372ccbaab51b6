"""A toxicity classifier that is regularised by counterfactuals.

A logistic regression over the words of a text and the words' beginnings. Besides its labels it learns from copies of labelled sentences in
which one identity term is swapped for another of its kind: a change of score between the two is penalised, so that
naming a group doesn't make a text toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, text_of

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
#: Labelled documents that training reads at most, and features in the model at most, those of the strongest difference.
SAMPLE, VOCABULARY = 20_000, 3_000
#: Standard deviations by which a feature's share of toxic documents must differ from the overall one.
SIGNIFICANT = 2.5
#: Lengths of the beginnings of words that are features too, so that inflected and compound words count.
BEGINNINGS = (4, 5, 7)
#: The score from which a text counts as toxic.
THRESHOLD = 0.5
#: The weight of the counterfactuals' penalty and of the weights' squares.
SWAP_PENALTY, RIDGE = 10.0, 3e-4
#: How much more a toxic document counts in training, being rarer.
TOXIC_WEIGHT = 2.0
# English identity terms by kind; the first of each kind is a neutral word.
IDENTITY = (
    ("people", "women", "men", "girls", "boys", "woman", "man", "transgender", "nonbinary"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics"),
    ("believer", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic"),
    ("person", "black", "white", "asian", "latino", "african", "arab", "indigenous", "european", "american"),
    ("adults", "gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("visitors", "immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("neighbours", "elderly", "young", "disabled", "blind", "deaf", "poor", "rich"),
)


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Known(dict):
    """The model's features of each word, the most recent few hundred thousand words remembered."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = tuple(self.vocabulary[f] for f in features_of(word) if f in self.vocabulary)
        return found

    def of(self, text: str) -> set[int]:
        return set().union(*map(self.__getitem__, set(WORDS.findall(text.lower()))))


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str, words: Known | None = None) -> float:
        known = (words or Known(self.vocabulary)).of(text)
        z = self.bias + float(self.weights[sorted(known)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def swaps(words: set[str], sentence: list[str]) -> Iterator[tuple[str, str]]:
    """The swaps of identity terms in a sentence: each term for the neutral one and for the next of its kind."""
    for kind in IDENTITY:
        for i, term in enumerate(kind):
            if term in words and term in sentence:
                for other in {kind[0], kind[(i + 1) % len(kind)]} - {term}:
                    yield term, other


Swap = tuple[tuple[int, ...], tuple[int, ...]]


def train(rows: list[tuple[Sequence[int], int]], swapped: Counter[Swap], size: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with momentum on log loss + ridge + penalty on score changes of counterfactuals.

    ``swapped``: how often a swap of features occurs, those that go and those that come; there are no more kinds than identity terms allow.
    """
    y = np.array([t for _, t in rows], float)
    counts = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    lengths = np.array([len(x) for x, _ in rows])
    at = np.concatenate([np.asarray(x, np.int32) for x, _ in rows]) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    w, bias = np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    step, v, vb = 0.3, np.zeros(size), 0.0
    pairs = sorted(swapped)
    times = np.array([swapped[p] for p in pairs], float)
    flat = [(i, n, sign) for n, p in enumerate(pairs) for sign, side in ((1.0, p[0]), (-1.0, p[1])) for i in side]
    where, pair, sign = (np.array([f[k] for f in flat], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    seen = np.bincount(at, minlength=size) / len(y)
    widest = max((len(a) + len(b) for a, b in pairs), default=0)
    touched = np.bincount(where, times[pair], size)
    rate = 1 / (0.25 * seen * max(1.0, np.sqrt(lengths.mean() or 1)) + RIDGE + widest * SWAP_PENALTY * touched / len(y) + 0.002)
    for _ in range(steps):
        z = bias + np.bincount(row, w[at], len(y))
        error = counts * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(at, error[row], size) / len(y) + RIDGE * w
        if len(where):
            change = SWAP_PENALTY * times * np.bincount(pair, sign * w[where], len(pairs)) / len(y)
            g += np.bincount(where, sign * change[pair], size)
        v = 0.9 * v - step * rate * g
        vb = 0.9 * vb - step * error.mean()
        w, bias = w + v, bias + vb
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """Learn from at most ``sample`` labelled documents, those of least hash of their id, whole texts each.

    The bound is on labelled rows; the driver gets a few numbers for each. Features are the identity terms and the at most
    ``vocabulary`` words and beginnings in three documents or more whose share of toxic ones differs most from the
    overall share. All swaps of the sample count. Labels that are null, of documents that
    don't exist or without text teach nothing; without both labels every text scores alike.
    """
    spark: SparkSession = docs.sparkSession
    given = labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic").distinct()
    chosen = sorted(hash_sample(given, F.xxhash64("doc_id"), given.count(), sample).collect())[:sample]
    chosen = spark.createDataFrame(chosen, given.schema)  # at most ``sample`` pairs of numbers
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, bad = Counter(), Counter()
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                found = {f for w in set(WORDS.findall(text.lower())) for f in features_of(w)}
                n.update(found)
                if toxic:
                    bad.update(found)
            yield pd.DataFrame({"word": list(n), "n": list(n.values()), "bad": [bad[w] for w in n]}).astype({"word": object})

    total, bad_total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr("int(toxic <> 0)")), F.lit(0))).first()
    if not total or bad_total in (0, total):
        return Model({}, np.zeros(0), float(np.log((bad_total + 1) / (total - bad_total + 1))))
    share = bad_total / total
    words = rows.mapInPandas(count, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    z = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = words.filter((F.col("n") >= 3) & (z >= SIGNIFICANT)).orderBy(z.desc(), "word").limit(vocabulary).select("word").collect()
    terms = [t for kind in IDENTITY for t in kind]
    index = {w: i for i, w in enumerate(dict.fromkeys([r["word"] for r in best] + terms))}
    sent = spark.sparkContext.broadcast(index)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_known = Known(sent.value)
        for b in batches:
            xs, swapped = [], []
            for text in b["text"]:
                words = set(WORDS.findall(text.lower()))
                xs.append(np.array(sorted(words_known.of(text)), ">i4").tobytes())
                pairs: set[tuple[str, str]] = set()
                if not words.isdisjoint(terms):
                    for sentence in SENTENCES.split(text.lower()):
                        pairs.update(swaps(words, WORDS.findall(sentence)))
                swapped.append([list(words_known[w]) for p in sorted(pairs) for w in p])
            yield pd.DataFrame({"x": xs, "toxic": b["toxic"], "swapped": swapped})

    got = rows.mapInPandas(features, "x binary, toxic int, swapped array<array<int>>").collect()  # at most ``sample`` short lists
    got.sort(key=lambda r: (r["x"], r["toxic"]))  # the same sums whatever order the rows come in
    swapped = Counter((tuple(a), tuple(b)) for r in got for a, b in zip(r["swapped"][::2], r["swapped"][1::2], strict=True))
    weights, bias = train([(np.frombuffer(r["x"], ">i4"), int(r["toxic"] != 0)) for r in got], swapped, len(index))
    return Model(index, weights, bias)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score from 0 to 1 of a text: whole texts, null and empty ones too."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Known(sent.value.vocabulary)
        for texts in batches:
            yield pd.Series([sent.value.score(t, words) for t in texts], dtype=float)

    return score(text_of(text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Only labels whose crc32(doc_id) mod 5 isn't 0 are learnt from; the score depends on the text alone. Equal texts
    score alike. A null id is held out as false. No rows give no rows. Other columns are ignored.
    """
    model = fit(docs, labels.filter(~held_out()))
    scored = docs.select("doc_id", score_of(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
