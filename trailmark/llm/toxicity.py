"""A toxicity classifier whose scores do not move when identity terms are swapped.

A logistic regression on words and their beginnings. For each training text that names a group, a second one is made
with each identity term swapped for another of its kind; the loss adds the squared difference of the two scores (before
the logistic function). A term that merely occurs more often in toxic texts thus gains no weight of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import give_back, giving_back, stored

#: Labelled rows that the classifier is fitted on, at most; more are sampled by a hash of their id.
TRAINING_ROWS = 20_000
#: Features that enter the fit, at most: those that go with toxic labels most.
FEATURES = 4096
#: Rows from which a score is called toxic.
THRESHOLD = 0.3
_PREFIXES = (3, 4, 5, 6, 7, 8)
_LEAST_ROWS, _LEAST_RATIO = 4, 4.0
_L1, _L2, _SWAP = 5e-5, 1e-5, 4.0
_STEPS = 400
_KNOWN = 300_000

# Identity terms by kind. Within a kind any may stand for any other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian", "turkish"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
)

_EDGE = re.compile(r"^\W+|\W+$")


def word_of(token: str) -> str:
    """A token without the marks around it."""
    return token if token.isalnum() else _EDGE.sub("", token)


def features_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *[f"{word[:n]}*" for n in _PREFIXES if len(word) > n]] if word else []


def swapped(words: set[str], seed: int, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> set[str] | None:
    """Words with identity terms replaced by others of their kind; None if there are none."""
    out, found = set(words), False
    for kind in terms:
        named = words.intersection(kind)
        if named:
            found = True
            step = 1 + seed % (len(kind) - 1)
            out -= named
            out |= {kind[(kind.index(w) + step) % len(kind)] for w in named}
    return out if found else None


def _words(text: str | None) -> set[str]:
    return {word_of(t) for t in set((text or "").lower().split())} - {""}


def _features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other rows of the task have each feature."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for f in _features(_words(text)):
                counts.setdefault(f, [0, 0])[label] += 1
    if counts:
        names = list(counts)
        yield pa.RecordBatch.from_pydict(
            {"feature": names, "others": [counts[f][0] for f in names], "toxic": [counts[f][1] for f in names]}
        )


def _examples(index: dict[str, int], terms: tuple[tuple[str, ...], ...]) -> Callable:
    """Chosen features of each training row, and of its counterfactual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = lambda words: [index[f] for f in _features(words) if f in index]
        for batch in batches:
            own, other = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = _words(text)
                swap = swapped(words, zlib.crc32(str(doc_id).encode()), terms)
                own.append(chosen(words))
                other.append(None if swap is None else chosen(swap))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(own, lists), pa.array(other, lists)], names=["toxic", "own", "other"]
            )

    return run


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        """Scores texts; a token's weights are looked up once and remembered."""
        known: dict[str, tuple[tuple[str, float], ...]] = {}

        def of(token: str) -> tuple[tuple[str, float], ...]:
            if len(known) > _KNOWN:
                known.clear()
            hits = known[token] = tuple((f, self.weights[f]) for f in features_of(word_of(token)) if f in self.weights)
            return hits

        def score(texts: list[str | None]) -> np.ndarray:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                hits: dict[str, float] = {}
                for token in set((text or "").lower().split()):
                    found = known.get(token)
                    if found is None:
                        found = of(token)
                    if found:
                        hits.update(found)
                out[i] = self.bias + sum(hits[f] for f in sorted(hits))
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

        return score


class _Rows:
    """A sparse matrix of ones, or of differences of two such."""

    def __init__(self, columns: list[np.ndarray], width: int, signs: list[np.ndarray] | None = None) -> None:
        self.n, self.width = len(columns), width
        self.row = np.repeat(np.arange(self.n), [len(c) for c in columns])
        self.column = np.concatenate(columns).astype(np.int64) if columns else np.empty(0, np.int64)
        self.sign = np.concatenate(signs) if signs else np.ones(len(self.column))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.column], self.n)

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.sign * v[self.row], self.width)


def fitted(own: list[list[int]], other: list[list[int] | None], labels: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the logistic loss, the swap penalty and L1 and L2 terms (proximal gradient)."""
    x = _Rows([np.array(o, np.int64) for o in own], width)
    pairs = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(own, other) if b is not None]
    d = _Rows([np.r_[a, b] for a, b in pairs], width, [np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs])
    if not len(labels):
        return np.zeros(width), 0.0
    n, base = len(labels), (labels.sum() + 0.5) / (len(labels) + 1)
    w, bias = np.zeros(width), float(np.log(base / (1 - base)))
    probe = np.ones(width) / np.sqrt(max(width, 1))
    for _ in range(20):  # largest curvature, for the step
        curve = x.transposed_times(x.times(probe)) / (4 * n) + 2 * _SWAP / n * d.transposed_times(d.times(probe))
        size = float(np.linalg.norm(curve))
        probe = curve / size if size else probe
    step, ahead, momentum = 1 / (1.5 * size + 0.25 + 2 * _L2), w.copy(), 1.0
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead) + bias, -30, 30)))
        slope = x.transposed_times(p - labels) / n + 2 * _SWAP / n * d.transposed_times(d.times(ahead)) + 2 * _L2 * ahead
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * _L1, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
        bias -= float(np.mean(p - labels))
    return w, bias


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS
) -> Classifier:
    """Fit on documents that ``labels`` (``doc_id``, ``toxic`` 0 or 1) covers: ``rows`` of them at most, by hash of id.

    Labels that are null, or whose id is null or unknown, are left out; of several labels for an id the larger counts.
    Without labels, or with one class only, the classifier scores all texts alike. The ids of the sample (bounded by
    ``rows``) are broadcast, so texts are not shuffled; the driver sees at most ``FEATURES`` counts and, of each
    sampled row, the numbers of its chosen features.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(rows + rows // 10)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id"))
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    toxic_rows, other_rows = totals.toxic, totals.n - totals.toxic
    counts = sample.mapInArrow(giving_back(_counted), "feature string, others long, toxic long").groupBy("feature").agg(
        F.sum("others").alias("others"), F.sum("toxic").alias("toxic")
    )
    ratio = ((F.col("toxic") + 0.5) / (toxic_rows + 1)) / ((F.col("others") + 0.5) / (other_rows + 1))
    best = (
        counts.filter((F.col("toxic") >= _LEAST_ROWS) & (ratio >= _LEAST_RATIO))
        .orderBy(F.desc(F.col("toxic") * F.log(ratio)), "feature")
        .limit(FEATURES)
    )
    names = [r.feature for r in best.collect()]
    index = {f: i for i, f in enumerate(names)}
    table = sample.mapInArrow(giving_back(_examples(index, terms)), "toxic int, own array<int>, other array<int>").toPandas()
    own = [list(x) for x in table["own"]]
    other = [None if x is None else list(x) for x in table["other"]]
    order = sorted(range(len(own)), key=lambda i: (table["toxic"][i], sorted(own[i])))  # the same sums in every run
    take = lambda values: [values[i] for i in order]
    weights, bias = fitted(take(own), take(other), np.array(take(table["toxic"].tolist()), float), len(names))
    return Classifier({f: float(weights[i]) for f, i in index.items() if weights[i]}, bias)


def with_scores(docs: DataFrame, classifier: Classifier, column: str = "score") -> DataFrame:
    """Columns of ``docs`` and the score of ``text`` (0 to 1), which alone decides. Null and empty texts score alike."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, texts = model.value.scorer(), None
        for texts in parts:
            yield pd.Series(of(texts.tolist()))
        of = texts = None
        give_back()

    return docs.withColumn(column, score(F.col("text").cast("string")))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are kept for testing."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score by a classifier that has not seen the held-out labels."""
    classifier = fit(docs, labels.filter(~held_out()))
    return with_scores(docs.select("doc_id", "text"), classifier).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
