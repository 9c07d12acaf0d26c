"""Toxicity scores by non-negative positive-unlabelled learning of a linear classifier in numpy.

``fit`` learns from all confirmed toxic documents and from all other text as unlabelled, through the risk
estimator that corrects the unlabelled part for the class prior and never lets it fall below zero; ``score``
applies the model to every document.  Probabilities come from that risk and the prior alone: documents that
are labelled clean count as unlabelled ones, apart from their share in the prior.

* Labels are taken only from rows outside the held-out quarter (crc32 of doc_id as text, mod 4, is 2);
  so are the texts of the unlabelled part.  Several labels of one document: toxic if any says so.
* Null labels and label rows without a document count for nothing; a null doc_id is not held out and unlabelled.
* A null or empty text has no features and gets the score of the intercept.
* Without any confirmed toxic document, every score is the class prior; an empty table gives no row.
* Repeated rows count and are scored each; other columns are not read.  Very long texts: memory is the text's words.

Features: how often words, and words with a given beginning of ``PREFIXES`` bytes, occur; those are used that
at least a hundredth of the confirmed documents hold, and that are there ``LIFT`` times as frequent as in all
text, beyond ``SIGMAS`` standard deviations.

Scale: nothing is sampled.  Texts are read once for the features of the confirmed documents, once for their
frequency in all, once to store the few features that each document has; every step of the optimiser reads those
and sums one row a feature and task.  Sums are of whole numbers, so the model does not depend on how the input is
split.  The model goes to every executor, and nothing is shuffled to score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, staged, utf8
from .decontaminate import words_of

BROADCAST = 1_000_000  # ids of confirmed documents that are sent to every executor at most
SHARE = 100  # one in so many confirmed documents holds a feature, and three of them
LIFT, SIGMAS = 1.5, 4.0
PREFIXES = (4, 5, 6, 7, 8)
PER, SHORT = 200, 20  # occurrences are counted by so many words; short texts count as longer by so many
STEPS = 40  # evaluations of the risk
DECAY = 1e-3
THRESHOLD = 0.3
_REMEMBERED = 200_000
_FIXED = 1 << 32  # sums are of whole numbers of this part
_ROWS = 4096  # documents in a stored row of features


def held_out(doc_id: str | Column) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings, which end with a star."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Weights by feature; ``numbers`` is each feature's place."""

    numbers: dict[bytes, int]
    weights: np.ndarray
    bias: float
    _seen: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def places(self, word: bytes) -> tuple[int, ...]:
        """The numbers of the word's features."""
        at = self._seen.get(word)
        if at is None:
            if len(self._seen) > _REMEMBERED:
                self._seen.clear()
            at = self._seen[word] = tuple(self.numbers[f] for f in features_of(word) if f in self.numbers)
        return at

    def values(self, text: bytes) -> dict[int, float]:
        """Squared logarithm of 1 plus how often each feature occurs in ``PER`` words: one occurrence weighs little."""
        out: dict[int, float] = {}
        words = words_of(text)
        for word, n in Counter(words).items():
            for k in self.places(word):
                out[k] = out.get(k, 0) + n
        scale = PER / (len(words) + SHORT)
        return {k: math.log1p(n * scale) ** 2 for k, n in out.items()}

    def score(self, text: bytes) -> float:
        z = self.bias + sum(self.weights[k] * x for k, x in self.values(text).items())
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


@dataclass
class Sums:
    """What the risk needs of a set of documents, with the intercept's feature last: of each feature the sum of
    probability times value over the unlabelled and the confirmed ones, and of both the loss as negative ones."""

    unlabelled: np.ndarray
    confirmed: np.ndarray
    loss_unlabelled: float
    loss_confirmed: float


def sums_of(sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, confirmed: np.ndarray, w: np.ndarray, b: float) -> Sums:
    """sizes: features of each document; columns, values: theirs, one document after another.

    A confirmed document is also one of the unlabelled, which are drawn from all.  What each document adds is
    rounded to fixed point, so that sums do not depend on their order.
    """
    rows, n, width = np.repeat(np.arange(len(sizes)), sizes), len(sizes), len(w)
    z = np.bincount(rows, w[columns] * values, minlength=n) + b
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = np.logaddexp(0, z)

    def of(weight: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, np.round((weight * p)[rows] * values * _FIXED), minlength=width), np.round(weight * p * _FIXED).sum()) / _FIXED

    mark, loss = confirmed.astype(float), np.round(loss * _FIXED)
    return Sums(of(np.ones(n)), of(mark), float(loss.sum()) / _FIXED, float(loss @ mark) / _FIXED)


def nonnegative_risk(s: Sums, total: np.ndarray, n_p: int, n_u: int, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of logistic loss (Kiryo et al. 2017) and its gradient, intercept last.

    Risk: prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]); total: the sum of values over the confirmed.
    """
    as_positive = s.loss_confirmed - float(w @ total[:-1] + b * total[-1])  # l(z) = l(-z) - z
    negative = s.loss_unlabelled / n_u - prior * s.loss_confirmed / n_p
    gradient = prior * (s.confirmed - total) / n_p
    if negative > 0:
        gradient = gradient + s.unlabelled / n_u - prior * s.confirmed / n_p
    gradient[:-1] += DECAY * w
    return prior * as_positive / n_p + max(0.0, negative) + DECAY / 2 * float(w @ w), gradient


def minimise(risk: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, evaluations: int = STEPS, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps, quartered until the risk falls; ends where it hardly does, or after so many evaluations."""
    value, g = risk(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    left, length = evaluations - 1, 1.0 / max(1.0, float(np.abs(g).sum()))
    while left and np.abs(g).max() > 1e-6:
        d, coefficients = -g, []
        for s, y in reversed(pairs):
            c = (s @ d) / (s @ y)
            coefficients.append(c)
            d = d - c * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), c in zip(pairs, reversed(coefficients), strict=True):
            d = d + s * (c - (y @ d) / (s @ y))
        step, slope = (1.0 if pairs else length), float(g @ d)
        while left:
            left -= 1
            near = x + step * d
            found, gradient = risk(near)
            if found <= value + 1e-4 * step * slope:
                break
            step /= 4
        else:
            return x
        s, y = near - x, gradient - g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        elif pairs:
            pairs = []
        if value - found < 1e-4 * abs(value):
            return near
        x, value, g = near, found, gradient
    return x


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents that hold it), for each batch."""
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0):
            found.update({f for w in set(words_of(text.as_py())) for f in features_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["feature", "p"])


def _frequencies(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(feature's number, documents that hold it), for each task; the last number counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.numbers)
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for text in batch.column(0):
                held = set().union(*map(model.places, set(words_of(text.as_py()))))
                total[np.fromiter(held, np.int64, len(held))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["k", "u"])

    return run


STORED = "documents long, confirmed_without long, without long, sizes binary, columns binary, row_values binary, confirmed binary"


def _stored_batches(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The features of the documents that have any, many documents a row; the others are counted."""
    names = [c.split()[0] for c in STORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                marks = np.array(part.column(1).to_pylist(), bool)
                found = [model.values(t.as_py()) for t in part.column(0)]
                sizes = np.array(list(map(len, found)), np.int32)
                has = sizes > 0
                columns = np.array([k for x in found for k in x], np.int32)
                values = np.array([v for x in found for v in x.values()], np.float32)
                row = [int(has.sum()), int((marks & ~has).sum()), int((~has).sum()), *(x.tobytes() for x in (sizes[has], columns, values, marks[has]))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if k < 3 else pa.binary()) for k, x in enumerate(row)], names)

    return run


def _sum_batches(w: np.ndarray, b: float, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a sum and task, in fixed point; ``first``: the sums of the values of confirmed documents instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * len(w) + 4, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                sizes, columns, values, marks = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in zip(range(3, 7), (np.int32, np.int32, np.float32, bool), strict=True))
                values = values.astype(float)
                if first:
                    chosen = np.repeat(marks, sizes)
                    found = np.concatenate([np.bincount(columns[chosen], np.round(values[chosen] * _FIXED), minlength=len(w)) / _FIXED, [marks.sum()], np.zeros(len(w) + 3)])
                else:
                    s = sums_of(sizes, columns, values, marks, w, b)
                    found = np.concatenate([s.unlabelled, s.confirmed, [s.loss_unlabelled, s.loss_confirmed]])
                total += np.round(found * _FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    return run


def _added(stored: DataFrame, w: np.ndarray, b: float, first: bool = False) -> np.ndarray:
    rows = stored.mapInArrow(_sum_batches(w, b, first), "k long, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros(2 * len(w) + 4)
    for r in rows:  # two a feature
        out[r.k] = int(r.v) / _FIXED
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from all documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    prior = min(max(n_toxic / n if n else 0.0, 0.001), 0.5)
    without = Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    toxic, _ = bounded(known.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")), BROADCAST)
    rows = docs.where(~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    confirmed = staged(rows.join(toxic, "doc_id", "left_semi").select("text"), "toxic")
    n_p = confirmed.count()
    if not n_p:
        return without
    counts = confirmed.mapInArrow(_feature_counts, "feature binary, p long").groupBy("feature").agg(F.sum("p").alias("p"))
    held = sorted((bytes(r.feature), r.p) for r in counts.where(F.col("p") >= max(3, n_p // SHARE)).collect())  # SHARE times a document's features at most
    model = Model({f: k for k, (f, _) in enumerate(held)}, np.zeros(len(held)), 0.0)
    found = rows.select("text").mapInArrow(_frequencies(model), "k long, u long").groupBy("k").agg(F.sum("u").alias("u")).collect()
    u = np.zeros(len(held) + 1)
    for r in found:
        u[r.k] = r.u
    n_u = int(u[-1])
    p, u = np.array([x for _, x in held], float), u[:-1]
    z = (p / n_p - u / n_u) / np.sqrt((p + u + 1) / (n_p + n_u) * (1 / n_p + 1 / n_u))
    used = np.flatnonzero((z > SIGMAS) & (p / n_p > LIFT * u / n_u))
    model = Model({held[k][0]: j for j, k in enumerate(used.tolist())}, np.zeros(len(used)), without.bias)
    marked = rows.join(toxic.withColumn("confirmed", F.lit(True)), "doc_id", "left").select("text", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    stored = staged(marked.mapInArrow(_stored_batches(model), STORED), "features")
    bare_p, bare = stored.agg(F.sum("confirmed_without"), F.sum("without")).first()
    stored = stored.where("documents > 0")
    total = _added(stored, model.weights, 0.0, True)[: len(used) + 1]
    total[-1] += bare_p

    def risk(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], float(x[-1])
        found = _added(stored, w, b)
        s = Sums(found[: len(x)], found[len(x) : 2 * len(x)], found[-2], found[-1])
        alone = 1 / (1 + math.exp(-b))  # of the documents without features
        s.unlabelled[-1] += bare * alone
        s.confirmed[-1] += bare_p * alone
        loss = float(np.logaddexp(0, b))
        s.loss_unlabelled, s.loss_confirmed = s.loss_unlabelled + bare * loss, s.loss_confirmed + bare_p * loss
        return nonnegative_risk(s, total, n_p, n_u, prior, w, b)

    x = minimise(risk, np.append(model.weights, model.bias))
    model.weights, model.bias = x[:-1], float(x[-1])
    return model


def _score_batches(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), utf8("text").alias("text"))
    scored = rows.mapInArrow(_score_batches(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns and rows as they are, that score under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([model.score(str(t.as_py() or "").encode()) < threshold for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
