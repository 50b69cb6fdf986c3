"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from frameprobe.llm.arrays import mix64
from frameprobe.llm.tables import map_texts, settled, short_batches

#: Hash buckets for subwords, size of their vectors, and lengths of character n-grams.
BUCKETS, SIZE, GRAMS = 1 << 16, 4, (3, 4, 5)

#: Words averaged at a time, and words from one stretch to the next; a text is as toxic as its most toxic stretch.
STRETCH, STEP = 32, 8

#: The labelled sample: rows of class 1 at most, twice as many of class 0; and rows of each class in the first steps.
SAMPLE_ROWS, FIRST_ROWS = 1_500, 600

#: Weight of the bag without words in training.
EMPTY_SHARE = 0.05

#: Entries of a worker's cache of word scores; a full cache is emptied.
CACHE_WORDS = 400_000

_word = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, with marks for its ends; index of the word."""
    marked = [f"<{w}>" for w in found]
    sizes = np.array([len(w) for w in marked], np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    total, buckets, owners = len(points), [], []
    run = np.zeros(total, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        run = run[:total - n + 1] * np.uint64(0x100000001B3) + points[n - 1:]
        if n in GRAMS:
            inside = np.flatnonzero(of[:total - n + 1] == of[n - 1:])
            buckets.append(mix64(run[inside] + np.uint64(n)))
            owners.append(of[inside])
    places = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.zeros(len(sizes), np.uint64)
    np.add.at(whole, of, mix64(points * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64)))
    buckets.append(mix64(whole))
    owners.append(np.arange(len(sizes)))
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


class Bags:
    """Bags of words, each word a bag of subwords, as index arrays."""

    def __init__(self, bags: list[list[str]]):
        names: dict[str, int] = {}
        self.word = np.array([names.setdefault(w, len(names)) for bag in bags for w in bag], np.int64)
        self.bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        self.length = np.maximum(np.bincount(self.bag, minlength=len(bags)), STRETCH // 2)
        self.part, self.of = subwords(list(names))
        self.parts = np.maximum(np.bincount(self.of, minlength=len(names)), 1)

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """Mean over the words of a bag of the mean over the subwords of a word, a row each dimension."""
        out = []
        for v in vectors:
            by_word = np.bincount(self.of, v[self.part], len(self.parts)) / self.parts
            out.append(np.bincount(self.bag, by_word[self.word], len(self.length)) / self.length)
        return np.array(out)

    def back(self, gradient: np.ndarray) -> np.ndarray:
        """Gradient of the vectors from that of the means."""
        out = []
        for g in gradient:
            by_word = np.bincount(self.word, (g / self.length)[self.bag], len(self.parts)) / self.parts
            out.append(np.bincount(self.part, by_word[self.of], BUCKETS))
        return np.array(out)


class Model:
    """Vectors of subwords and a two-class softmax on their mean, trained together.

    Steps follow the momentum of the gradient, scaled by its largest entry, so that subwords
    which matter in many texts move and those of a single text hardly do.
    """

    RATE, GAIN = (0.7, 0.05, 0.05), 30.0

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.values = [rng.normal(0, 0.01, (SIZE, BUCKETS)), rng.normal(0, 1, (SIZE, 2)), np.zeros(2)]
        self.moves = [np.zeros_like(v) for v in self.values]

    def fit(self, bags: Bags, labels: np.ndarray, steps: int, weight: np.ndarray) -> float:
        target = np.stack([1 - labels, labels], axis=1)
        loss = 0.0
        for _ in range(steps):
            mean = self.GAIN * bags.means(self.values[0])
            logit = mean.T @ self.values[1] + self.values[2]
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss = float(-(np.log((p * target).sum(axis=1) + 1e-12) * weight).sum())
            error = (p - target) * weight[:, None]
            gradients = [bags.back(self.GAIN * self.values[1] @ error.T), mean @ error, error.sum(axis=0)]
            for i, g in enumerate(gradients):
                self.moves[i] = 0.8 * self.moves[i] + 0.2 * g / (np.abs(g).max() + 1e-12) * min(1.0, 2 * loss)
                self.values[i] -= self.RATE[i] * self.moves[i]
        return loss

    def scores(self) -> tuple[np.ndarray, float]:
        """What each subword adds to the log odds of class 1, and their constant."""
        vectors, matrix, constant = self.values
        return self.GAIN * (matrix[:, 1] - matrix[:, 0]) @ vectors, float(constant[1] - constant[0])


class Scorer:
    """Log odds of whole texts from the scores of subwords; words are scored once."""

    def __init__(self, scores: np.ndarray, constant: float):
        self.scores, self.constant, self.known = scores, constant, {}

    def learn(self, texts: list[list[str]]) -> None:
        """Scores the words of some texts that are not known yet."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        part, of = subwords(new)
        sums = np.bincount(of, self.scores[part], len(new)) / np.maximum(np.bincount(of, minlength=len(new)), 1)
        self.known.update(zip(new, sums.tolist()))

    def stretches(self, found: list[str]) -> np.ndarray:
        """Log odds of each stretch of learnt words (see ``starts``); one without words if there are none."""
        if not found:
            return np.array([self.constant])
        scores = np.fromiter(map(self.known.__getitem__, found), np.float64, len(found))
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        first = starts(len(found))
        last = np.minimum(first + STRETCH, len(found))
        return (sums[last] - sums[first]) / np.maximum(last - first, STRETCH // 2) + self.constant


def starts(n: int) -> np.ndarray:
    """First words of the stretches of ``n`` words: every STEP words, the last stretch at the end of the text."""
    end = max(0, n - STRETCH)
    return np.append(np.arange(0, end, STEP), end)


def highest(scorer: Scorer, found: list[str], n: int) -> list[list[str]]:
    """The words of the ``n`` highest stretches that do not overlap."""
    first, chosen = starts(len(found)), []
    for i in np.argsort(-scorer.stretches(found), kind="stable"):
        if all(abs(first[i] - k) >= STRETCH for k in chosen):
            chosen.append(first[i])
            if len(chosen) == n:
                break
    return [found[k:k + STRETCH] for k in chosen]


def _bags(texts: DataFrame, function) -> list[tuple[list[str], int]]:
    """(words, toxic) of the bags that ``function`` makes from the words of some texts and their labels
    in tasks, a list for each text, in the order of ``place``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                some = batch.slice(first, 200)
                place, toxic = some.column(0).to_pylist(), some.column(2).to_pylist()
                found = [words(t) for t in some.column(1).to_pylist()]
                rows = [(p, y, k, bag) for p, y, bags in zip(place, toxic, function(found, toxic)) for k, bag in enumerate(bags)]
                arrays = zip(*rows) if rows else [[]] * 4
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(arrays, kinds)], names=["place", "toxic", "k", "bag"])

    made = texts.select("place", "text", "toxic").mapInArrow(run, "place long, toxic int, k int, bag array<string>")
    return [(r["bag"], r["toxic"]) for r in sorted(made.collect(), key=lambda r: (r["place"], r["toxic"], r["k"], r["bag"]))]


def trained(texts: DataFrame, first: int = 25, rounds: int = 6, steps: int = 10) -> tuple[np.ndarray, float]:
    """Scores of subwords and a constant from labelled texts (place, text, toxic).

    The first steps take the distinct words of a text as one bag, for the first FIRST_ROWS texts of
    each class by place. Each round after that scores all stretches with the model so far, in
    tasks, and trains on the highest one of every text of class 1 and the highest two of the others
    that do not overlap, because a label holds for some stretch of its text. A bag without
    words stands beside them as class 0: nothing in it is toxic, and short texts lean on it. With
    one class only, every score is that class.
    """
    places = {k: sorted(r["place"] for r in texts.where(F.col("toxic") == k).select("place").collect()) for k in (0, 1)}
    if not (places[0] and places[1]):
        return np.zeros(BUCKETS), (20.0 if places[1] else -20.0)

    def balanced(y: np.ndarray) -> np.ndarray:
        return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    model = Model()
    last = {k: p[min(len(p), FIRST_ROWS) - 1] for k, p in places.items()}
    some = texts.where(F.col("place") <= F.when(F.col("toxic") == 1, last[1]).otherwise(last[0]))
    bags, labels = zip(*_bags(some, lambda found, _: [[sorted(set(f))] for f in found]))
    labels = np.array(labels, float)
    model.fit(Bags(list(bags)), labels, first, balanced(labels))
    for _ in range(rounds):
        weights = texts.sparkSession.sparkContext.broadcast(model.scores())

        def chosen(found, toxic, weights=weights):
            scorer = _scorer(weights)
            scorer.learn(found)
            return [highest(scorer, f, 1 if y else 2) for f, y in zip(found, toxic)]

        bags, labels = zip(*_bags(texts, chosen))
        weights.unpersist()
        share = np.append(np.full(len(labels), (1 - EMPTY_SHARE) / len(labels)), EMPTY_SHARE)
        model.fit(Bags([*bags, []]), np.array([*labels, 0], float), steps, share)
    return model.scores()


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts of class 1 and twice as many of class 0, by a hash of the id: the
    distinct rows of place (that hash), text and toxic, texts whole."""
    usable = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("doc_id")
    chosen = usable.where("toxic = 0").orderBy(order, "doc_id").limit(2 * rows).unionByName(
        usable.where("toxic = 1").orderBy(order, "doc_id").limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = settled(texts.select(order.alias("place"), "text", F.col("toxic").cast("int").alias("toxic")).distinct())
    if texts.count() > 3 * rows:  # ids that repeat with other texts
        texts = settled(texts.orderBy("place", "text").limit(3 * rows))
    return texts


def scored(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without text, with held_out, score and predicted.

    ``score`` is the probability of class 1 of the most toxic stretch of the whole text; a null or
    empty text scores the constant alone. Only labels of rows that are not held out are read, and
    only the text makes the score. A null doc_id is never held out. Repeated rows score alike.
    """
    short_batches(docs.sparkSession)
    scores, constant = trained(sample(docs, labels, **settings))
    weights = docs.sparkSession.sparkContext.broadcast((scores, constant))

    def run(column: pa.Array) -> list:
        scorer = _scorer(weights)
        odds = []
        for first in range(0, len(column), 200):
            texts = [words(t) for t in column.slice(first, 200).to_pylist()]
            scorer.learn(texts)
            odds += [scorer.stretches(t).max() for t in texts]
        return [1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -700, 700)))]

    made = map_texts(docs.drop("score", "held_out", "predicted"), "text", [StructField("score", DoubleType())], run, drop=True)
    return made.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_scorers: dict[int, Scorer] = {}


def _scorer(weights) -> Scorer:
    """One scorer, with its cache, for all batches of a worker."""
    name = id(weights.value[0])
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(*weights.value)
    return _scorers[name]
