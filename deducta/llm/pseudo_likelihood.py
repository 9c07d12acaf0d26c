"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Each token, masked, is predicted from the ``SIDE`` tokens on both sides of it.  Tokens are the ids of a public
tokenizer.  The softmax is factored by classes: each of the ``OWN`` tokens that are most frequent in the corpus is a
class of its own, the others share the rest of the BASE * BASE classes by their rank and are told apart by
their share of the class.  A class is predicted as two digits, the second given the first, so that a token costs
2 * BASE outputs; the probabilities of all tokens add up to one.  A document's score is the sum of the
conditional log-probabilities of its tokens.

* A null or empty text has no tokens: score 0, mean null.  Repeated rows train and score each.
* Beyond a document's ends stands a class of its own.
* A null doc_id keeps its row; other columns are not read.  An empty table gives no row.
* A very long text is tokenized and scored whole, in some 20 bytes of memory for each of its own.

Training starts from the tokens' counts in the whole corpus and is data-parallel over every document.  Documents are dealt by a hash of doc_id and text to shards of
about ``SHARD_BYTES``, and ordered by it there, so the result does not depend on how the input is split.  In each of
``ROUNDS`` rounds every shard starts from the same parameters and learns from one position in ``ROUNDS`` (another in
each round, so that all rounds together learn from every position once); the mean of the shards' parameters, in fixed
point and weighted by positions, starts the next round.

Scale: the ids are shuffled and stored once, 16 bits each, and read for each round and for the scores.  A task adds
up its shards and sends one parameter set; the driver gets one set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, utf8
from .packing import _tokenizer

BASE = 37
CLASSES = BASE * BASE
OWN = 1200
SIDE = 2
HIDDEN = 16
ROUNDS = 2
BATCH = 2048
RATE = 0.1
SHARD_BYTES = 1 << 23
MOST_TASKS = 1 << 16
_FIXED = 1 << 24
_SHIFTS = tuple(j for j in range(-SIDE, SIDE + 1) if j)
SHARDS = "shard long, doc_ids array<long>, starts binary, sizes binary, ids binary"


_DIGITS = np.kron(np.eye(2, dtype=np.float32), np.ones((BASE, 1), np.float32))  # adds up the outputs of each digit
_LARGEST = np.float32(60)  # of an output, whose exponential must not overflow


@dataclass
class Network:
    """Context tables by place, hidden bias, and for the two digits weights side by side and biases.

    Fixed by the corpus's counts: the class of every id, and the logarithm of its share of the class.
    """

    classes: np.ndarray
    shares: np.ndarray
    tables: np.ndarray  # places * (1 + CLASSES) x HIDDEN; the first of a place stands beyond a document's ends
    bias: np.ndarray
    weights: np.ndarray  # HIDDEN x 2 * BASE
    first: np.ndarray  # BASE
    second: np.ndarray  # BASE (the first digit) x BASE

    @classmethod
    def new(cls, counts: np.ndarray, seed: int = 11) -> Network:
        """Without context, every token has its share of the corpus; counts: of every id, none of them zero."""
        order = np.argsort(-counts, kind="stable")
        rank = np.arange(len(counts))
        of_rank = np.minimum(rank, OWN + np.maximum(rank - OWN, 0) * (CLASSES - OWN) // max(1, len(counts) - OWN))
        classes = np.empty(len(counts), np.int16)
        classes[order] = of_rank
        mass = np.bincount(classes, counts, minlength=CLASSES)
        shares = np.log(counts / mass[classes]).astype(np.float32)
        by = np.maximum(mass, 1e-9).reshape(BASE, BASE)
        first, second = np.log(by.sum(axis=1) / by.sum()), np.log(by / by.sum(axis=1, keepdims=True))
        r = np.random.default_rng(seed)
        small = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        return cls(classes, shares, small(len(_SHIFTS) * (1 + CLASSES), HIDDEN), small(HIDDEN), small(HIDDEN, 2 * BASE), first.astype(np.float32), second.astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        """What is trained."""
        return [self.tables, self.bias, self.weights, self.first, self.second]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def copy(self) -> Network:
        return Network(self.classes, self.shares, *(x.copy() for x in self.parts()))

    def of(self, flat: np.ndarray) -> Network:
        """The same network with other trained parts."""
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].astype(np.float32).reshape(x.shape))
            at += x.size
        return Network(self.classes, self.shares, *out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """context: a row of table rows for each place around the tokens."""
        x = self.tables.take(context[0], axis=0, mode="clip")  # no row is beyond the table; unlike the default, not buffered
        for c in context[1:]:
            x += self.tables.take(c, axis=0, mode="clip")
        x += self.bias
        return np.tanh(x, out=x)

    def outputs(self, h: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The exponentials of both digits' outputs, their sums by digit, and the columns of the true digits."""
        columns = np.empty((2, len(classes)), np.int64)
        np.divmod(classes, BASE, out=(columns[0], columns[1]))
        z = h @ self.weights
        z += np.concatenate([np.broadcast_to(self.first, (BASE, BASE)), self.second], axis=1).take(columns[0], axis=0, mode="clip")
        columns[1] += BASE
        with np.errstate(over="ignore"):
            out = np.exp(z)
        sums = out @ _DIGITS
        if not np.isfinite(sums).all():  # outputs of over 88: cut them
            out = np.exp(np.minimum(z, _LARGEST, out=z), out=z)
            sums = out @ _DIGITS
        return out, sums, columns

    def log_probability(self, tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
        z, sums, columns = self.outputs(self.hidden(context), self.classes[tokens])
        columns += np.arange(len(tokens)) * z.shape[1]
        ratio = z.take(columns).astype(float)
        ratio /= sums.T
        return np.log(np.maximum(ratio[0] * ratio[1], 1e-300)) + self.shares[tokens]


class Learner:
    """Adagrad on mini-batches of masked positions."""

    def __init__(self, network: Network):
        self.net = network
        self.square = [np.full(x.shape, 1e-2, np.float32) for x in network.parts()]

    def _move(self, k: int, gradient: np.ndarray, at: object = slice(None)) -> None:
        part, square = self.net.parts()[k], self.square[k]
        moved = square[at] + gradient * gradient
        square[at] = moved
        part[at] -= np.float32(RATE) * gradient / np.sqrt(moved)

    def _scatter(self, k: int, at: np.ndarray, d: np.ndarray) -> None:
        """Add up the rows of ``d`` (repeated as often as it takes) by the row of the part that they belong to."""
        order = np.argsort(at, kind="stable")  # 16-bit numbers: a radix sort
        names = at[order]
        begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        self._move(k, np.add.reduceat(d.take(order, axis=0, mode="wrap"), begin, axis=0), names[begin])

    def learn(self, classes: np.ndarray, context: np.ndarray) -> None:
        net, n = self.net, len(classes)
        h = net.hidden(context)
        z, sums, columns = net.outputs(h, classes)
        each = np.float32(1) / np.float32(n)
        z *= (each / sums) @ _DIGITS.T
        z.reshape(-1)[columns + np.arange(n) * z.shape[1]] -= each
        back = (z @ net.weights.T) * (1 - h * h)
        one = np.ones(n, np.float32)
        self._move(2, h.T @ z)
        self._move(3, (one @ z)[:BASE])
        self._move(4, (columns[0] == np.arange(BASE)[:, None]).astype(np.float32) @ z[:, BASE:])  # no gradient, no move
        self._move(1, one @ back)
        self._scatter(0, context.ravel(), back)


def _padded(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more than the classes of the documents' ids, with zeros around each document, and the places of the ids."""
    begin = SIDE + np.cumsum(counts + SIDE) - (counts + SIDE)
    places = np.arange(len(classes)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    line = np.zeros(len(classes) + SIDE * (len(counts) + 1), np.int16)
    line[places] = classes + np.int16(1)
    return line, places


def _around(line: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The table rows of what stands around the places: a row for each place of ``_SHIFTS``."""
    return np.stack([line[places + j] + np.int16(k * (1 + CLASSES)) for k, j in enumerate(_SHIFTS)])


def _token_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's ids, and the hash of the text by which its positions are dealt to the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(3).to_pylist()
                ids = pa.array(tokenizer.ids(texts), pa.binary())
                starts = pa.array([xxhash.xxh3_64_intdigest(t) % ROUNDS for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], starts, ids], ["shard", "place", "doc_id", "start", "ids"])

    return run


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, as one row a shard."""
    names = [c.split()[0] for c in SHARDS.split(", ")]
    held: tuple[list, list, list] = ([], [], [])
    before = None

    def row() -> pa.RecordBatch:
        sizes = np.array([len(x) // 2 for x in held[2]], np.int64)
        values = [before, held[0], np.array(held[1], np.int8).tobytes(), sizes.tobytes(), b"".join(held[2])]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3), strict=True)], names)

    for batch in batches:
        for shard, *rest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if shard != before and held[0]:
                yield row()
                held = ([], [], [])
            before = shard
            for x, v in zip(held, (*rest[:2], rest[2].as_py()), strict=True):
                x.append(v)
    if held[0]:
        yield row()


def shards(docs: DataFrame, path: str) -> DataFrame:
    """The stored shards of token ids: what each holds and in which order depends on the documents alone."""
    size = docs.select(F.sum(F.octet_length(utf8("text")).cast("long"))).first()[0] or 0
    n = 1 + size // SHARD_BYTES
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.pmod(key, F.lit(n)).alias("shard"), key.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    rows = rows.mapInArrow(_token_batches(path), "shard long, place long, doc_id long, start int, ids binary")
    return staged(rows.repartition(min(n, MOST_TASKS), "shard").sortWithinPartitions("shard", "place").mapInArrow(_shard_batches, SHARDS), "token-shards")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ListScalar, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            starts, sizes, ids = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ((2, np.int8), (3, np.int64), (4, "<u2")))
            yield batch.column(1)[r], starts, sizes, ids


def _pieces(sizes: np.ndarray, most: int = 1 << 16) -> Iterator[slice]:
    """Runs of documents with about so many ids."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most)))
        yield slice(at, end)
        at = end


def train_shard(network: Network, turn: int, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[Network, int]:
    """The network after one position in ``ROUNDS`` of a shard, and how many those are."""
    learner = Learner(network.copy())
    held: list[np.ndarray] = []
    waiting = seen = 0
    ends = np.cumsum(sizes)
    for part in _pieces(sizes):
        count = sizes[part]
        own = network.classes[ids[ends[part.start] - count[0] : ends[part.stop - 1]]]
        line, places = _padded(own, count)
        first = np.repeat(np.cumsum(count) - count, count)
        chosen = np.flatnonzero((np.arange(len(own)) - first + np.repeat(starts[part], count) + turn) % ROUNDS == 0)
        at = places[chosen]
        held.append(np.concatenate([own[chosen][None], _around(line, at)]))
        waiting += len(chosen)
        if waiting < BATCH:
            continue
        rows = np.concatenate(held, axis=1)
        for k in range(0, waiting - BATCH + 1, BATCH):
            learner.learn(rows[0, k : k + BATCH], rows[1:, k : k + BATCH])
            seen += BATCH
        held, waiting = [rows[:, waiting // BATCH * BATCH :]], waiting % BATCH
    if waiting:
        rows = np.concatenate(held, axis=1)
        learner.learn(rows[0], rows[1:])
        seen += waiting
    return learner.net, seen


def _train_batches(network: Network, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(network.flat())
        total = np.zeros(size + 1, np.int64)
        for _, starts, sizes, ids in _unpacked(batches):
            net, seen = train_shard(network, turn, starts, sizes, ids)
            total += np.append(np.round(net.flat().astype(np.float64) * _FIXED).astype(np.int64) * seen, seen)
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["k", "v"])

    return run


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for *_, ids in _unpacked(batches):
        total += np.bincount(ids, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "v"])


def start(stored: DataFrame) -> Network:
    """The first network, from the counts of all ids in the whole corpus, one added to each."""
    counts = np.ones(1 << 16)
    for r in stored.mapInArrow(_count_batches, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row an id
        counts[r.k] += r.v
    return Network.new(counts)


def train(stored: DataFrame) -> Network:
    """The network after all rounds over all stored shards; the first one if there are no tokens."""
    network = start(stored)
    for turn in range(ROUNDS):
        sums = stored.mapInArrow(_train_batches(network, turn), "k long, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        found = {r.k: int(r.v) for r in sums.collect()}  # one row a parameter
        size = len(network.flat())
        if not found.get(size):
            continue
        network = network.of(np.array([found[k] / (found[size] * _FIXED) for k in range(size)]))
    return network


def log_probabilities(network: Network, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of every id, given those around it in its document."""
    line, places = _padded(network.classes[ids], sizes)
    out = np.zeros(len(ids))
    for at in range(0, len(ids), BATCH):
        p = places[at : at + BATCH]
        out[at : at + len(p)] = network.log_probability(ids[at : at + BATCH], _around(line, p))
    return out


def _score_batches(network: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, _, sizes, ids in _unpacked(batches):
            ends = np.cumsum(sizes)
            for part in _pieces(sizes):
                count = sizes[part]
                logs = log_probabilities(network, count, ids[ends[part.start] - count[0] : ends[part.stop - 1]])
                begin = np.cumsum(count) - count
                scores = [float(logs[a : a + n].sum()) for a, n in zip(begin.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values.slice(part.start, len(count)), pa.array(count), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])

    return run


def score(stored: DataFrame, network: Network) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every document of the stored shards."""
    scored = stored.mapInArrow(_score_batches(network), "doc_id long, n_tokens long, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0)))
