"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of every training token; ``search`` intersects offset-adjusted
posting lists from the rarest term on and returns phrase and proximity matches; ``contamination``
counts what benchmark windows hit in every document.

* Words: maximal runs of characters other than ASCII non-alphanumerics, after lower-casing A-Z.
* A null or empty text has no words: its document is in the index with none, and is clean.
* An item without words matches nothing; one of fewer words than the window is one window.
* Repeated documents are separate rows; repeated windows count for each of their items.
* A null item_id joins no list of items, but its windows hit.  Other columns are not read.

Scale: the index is partitioned by document: a row is the index of a run of whole documents of about
``SHARD_BYTES`` text, built where the documents are read, so nothing is shuffled and a term that
occurs everywhere is as spread as its documents.  The benchmark is sent out in blocks of at most
``BLOCK_WORDS`` words, one search of the stored index each; the driver holds two of them, however large it is.
A very long text is a shard of its own, some 30 bytes of memory a word; the postings of the rarest terms are
followed ``SLICE`` at a time, so words that are everywhere cost time, not memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, staged, utf8

WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_WORDS = 200_000
SLICE = 1 << 18  # postings followed at a time

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c if c >= 128 or c in _KEPT else 32 for c in range(256))
INDEX = "shard long, doc_ids binary, doc_nulls binary, doc_words binary, terms binary, ends binary, gaps binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _index_row(ids: list[int | None], texts: list[bytes]) -> tuple[bytes, ...]:
    """Postings of one run of documents: for each term, the gaps between its positions."""
    words, counts = [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        words += w
    number = dict.fromkeys(words)
    for k, w in enumerate(number):
        number[w] = k
    terms = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    places = np.argsort(terms, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(terms, minlength=len(number))).astype(np.int32)
    gaps = np.diff(places, prepend=np.int32(0)).astype(np.int32)
    nulls = np.array([i is None for i in ids], bool)
    return (np.array([i or 0 for i in ids], np.int64).tobytes(), nulls.tobytes(), np.array(counts, np.int32).tobytes(), b" ".join(number), ends.tobytes(), gaps.tobytes())


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = rows = 0
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([first | rows], pa.int64()), *(pa.array([x], pa.binary()) for x in _index_row(ids, texts))], names)

    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            texts.append(t.as_py())
            ids.append(i.as_py())
            size += len(texts[-1])
            if size >= SHARD_BYTES:
                yield row()
                ids, texts, size, rows = [], [], 0, rows + 1
    if ids:
        yield row()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all documents."""
    return staged(docs.select(F.col("doc_id").cast("long"), utf8("text")).mapInArrow(_index_batches, INDEX), "postings")


@dataclass
class Shard:
    """One row of the index, unpacked."""

    number: int
    ids: list[int | None]
    words: np.ndarray  # a document
    starts: np.ndarray  # first position of each document, and the end
    terms: dict[bytes, int]
    first: np.ndarray  # where each term's list begins, and the end
    keys: np.ndarray  # term << 32 | position, sorted

    @classmethod
    def of(cls, number: int, doc_ids: bytes, doc_nulls: bytes, doc_words: bytes, terms: bytes, ends: bytes, gaps: bytes) -> Shard:
        words = np.frombuffer(doc_words, np.int32).astype(np.int64)
        first = np.concatenate([[0], np.frombuffer(ends, np.int32).astype(np.int64)])
        places = np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int64)
        keys = (np.repeat(np.arange(len(first) - 1), np.diff(first)) << 32) | places
        ids = [None if null else i for i, null in zip(np.frombuffer(doc_ids, np.int64).tolist(), np.frombuffer(doc_nulls, bool).tolist(), strict=True)]
        return cls(number, ids, words, np.concatenate([[0], np.cumsum(words)]), {t: k for k, t in enumerate(terms.split())}, first, keys)

    def matches(self, vocabulary: list[bytes], phrases: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every match of phrases of one length, given as rows of vocabulary numbers.

        slop 0: the words stand one after another.  Otherwise the phrase's rarest word stands there
        and each other word within slop positions of its place in the phrase, in the same document.
        """
        none = np.zeros(0, np.int64)
        if not len(phrases) or not len(self.keys):
            return none, none
        known = np.fromiter((self.terms.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
        term = known[phrases]
        which = np.flatnonzero((term >= 0).all(axis=1))
        if not len(which):
            return none, none
        term = term[which]
        sizes = np.diff(self.first)[term]
        order = np.argsort(sizes, axis=1, kind="stable")
        rarest = np.take_along_axis(term, order[:, :1], 1)[:, 0]
        ends = np.cumsum(np.take_along_axis(sizes, order[:, :1], 1)[:, 0])
        found = [(none, none)]
        for low in range(0, int(ends[-1]), SLICE):  # so many postings of the rarest terms at a time, wherever a list is cut
            place = np.arange(low, min(low + SLICE, int(ends[-1])))
            row = np.searchsorted(ends, place, "right")
            at = self.first[rarest[row] + 1] - (ends[row] - place)
            row, start = self._follow(term, order, row, self.keys[at] & 0xFFFFFFFF, slop)
            found.append((which[row], start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _follow(self, term: np.ndarray, order: np.ndarray, row: np.ndarray, anchor: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places where a phrase's rarest word stands, those with all other words: (row of ``term``, start)."""
        length = term.shape[1]
        start = anchor - order[row, 0]
        doc = np.searchsorted(self.starts, anchor, "right") - 1
        if not slop:
            ok = (start >= self.starts[doc]) & (start + length <= self.starts[doc + 1])
            row, start, doc = row[ok], start[ok], doc[ok]
        for k in range(1, length):
            if not len(row):
                break
            offset = order[row, k]
            low = np.maximum(start + offset - slop, self.starts[doc])
            high = np.minimum(start + offset + slop, self.starts[doc + 1] - 1)
            want = term[row, offset] << 32
            found = np.searchsorted(self.keys, want | low)
            ok = (found < len(self.keys)) & (low <= high)
            ok &= self.keys[np.minimum(found, len(self.keys) - 1)] <= (want | np.maximum(high, 0))
            row, start, doc = row[ok], start[ok], doc[ok]
        return row, start


def _phrases(texts: list[tuple[object, bytes]], window: int) -> tuple[list[bytes], dict[int, np.ndarray], dict[int, list[list[object]]]]:
    """Vocabulary, distinct windows by length, and the items of each."""
    number: dict[bytes, int] = {}
    owners: dict[int, dict[tuple[int, ...], list[object]]] = {}
    for item, text in texts:
        w = [number.setdefault(x, len(number)) for x in words_of(text)]
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            owners.setdefault(size, {}).setdefault(tuple(w[k : k + size]), []).append(item)
    rows = {n: np.array(list(x), np.int64).reshape(-1, n) for n, x in owners.items()}
    return list(number), rows, {n: list(x.values()) for n, x in owners.items()}


def _blocks(items: DataFrame, window: int) -> Iterator[tuple]:
    """The benchmark, some items at a time; a longer item's windows go out in several blocks."""
    held: list[tuple[object, bytes]] = []
    size = 0
    for item, text in items.toLocalIterator():
        words = words_of(bytes(text))
        step = max(1, BLOCK_WORDS - window) if window < len(words) else len(words) + 1
        for k in range(0, max(1, len(words) - window + 1), step):
            piece = words[k : k + step + window - 1]
            held.append((item, b" ".join(piece)))
            size += len(piece)
            if size >= BLOCK_WORDS:
                yield _phrases(held, window)
                held, size = [], 0
    yield _phrases(held, window)  # the last, or that of an empty benchmark


def _searching(per_shard: Callable[[Shard], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield per_shard(Shard.of(*(batch.column(c)[r].as_py() for c in range(batch.num_columns))))

    return run


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase_id, doc_id, start): every match of the whole phrases (phrase_id string, text).

    start counts words; with slop it is where the phrase would begin by its rarest word's place.
    """
    schema = "phrase_id string, doc_id long, start long"

    def searched(block: tuple) -> DataFrame:
        vocabulary, rows, owners = block

        def find(s: Shard) -> pa.RecordBatch:
            found = []
            for n, table in rows.items():
                which, start = s.matches(vocabulary, table, slop)
                doc = np.clip(np.searchsorted(s.starts, np.maximum(start, 0), "right") - 1, 0, len(s.ids) - 1)
                found += [(p, s.ids[d], int(x - s.starts[d])) for w, d, x in zip(which.tolist(), doc.tolist(), start.tolist(), strict=True) for p in owners[n][w]]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["phrase_id", "doc_id", "start"])

        return index.mapInArrow(_searching(find), schema)

    blocks = _blocks(phrases.select(F.col("phrase_id").cast("string"), utf8("text")), 1 << 30)
    first, others = _first(blocks)
    return searched(first) if others is None else appended(map(searched, others), "matches", schema)


def _hits(s: Shard, vocabulary: list[bytes], rows: dict[int, np.ndarray], owners: dict[int, list[list[object]]]) -> tuple[np.ndarray, list[set]]:
    """Which positions are hit, and the items of each document."""
    edge = np.zeros(int(s.starts[-1]) + 1, np.int64)
    items: list[set] = [set() for _ in s.ids]
    for n, table in rows.items():
        which, start = s.matches(vocabulary, table)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n, -1)
        doc = np.searchsorted(s.starts, start, "right") - 1
        for w, d in zip(which.tolist(), doc.tolist(), strict=True):
            items[d].update(str(i) for i in owners[n][w] if i is not None)
    return np.cumsum(edge)[:-1] > 0, items


def _report(ids: list, counts: list[int], hit: list[int], items: list[set]) -> pa.RecordBatch:
    lists = [sorted(x) for x in items]
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
    columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(list(map(len, lists)), pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "shard long, place int, hits array<int>, items array<string>"
WORDS = "shard long, place int, doc_id long, n_words long"


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [len({p for x in h or () for p in x}) for h in b.column(2).to_pylist()]
        yield _report(b.column(0).to_pylist(), b.column(1).to_pylist(), counts, [{i for x in found or () for i in x} for found in b.column(3).to_pylist()])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of the index."""
    for b in batches:
        for r in range(b.num_rows):
            number, ids, nulls, words = (b.column(c)[r].as_py() for c in range(4))
            n = np.frombuffer(words, np.int32).astype(np.int64)
            doc_ids = pa.array(np.frombuffer(ids, np.int64), pa.int64(), mask=np.frombuffer(nulls, bool))
            columns = [pa.array(np.full(len(n), number)), pa.array(np.arange(len(n), dtype=np.int32)), doc_ids, pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "place", "doc_id", "n_words"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: its words, those that benchmark windows hit, and the items.

    A benchmark of one block is answered in the search itself.  Of a larger one, the driver holds a block at a
    time: each search stores the hits of the documents that have any, which are then put together.
    """
    index = build_index(docs)

    def hits(block: tuple) -> DataFrame:
        def part(s: Shard) -> pa.RecordBatch:
            hit, found = _hits(s, *block)
            rows = [(s.number, d, np.flatnonzero(hit[s.starts[d] : s.starts[d + 1]]).tolist(), sorted(found[d])) for d in range(len(s.ids)) if hit[s.starts[d] : s.starts[d + 1]].any()]
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, types, strict=True)], [c.split()[0] for c in HITS.split(", ")])

        return index.mapInArrow(_searching(part), HITS)

    first, others = _first(_blocks(items.select(F.col("item_id").cast("string"), utf8("text")), window))
    if others is None:

        def whole(s: Shard) -> pa.RecordBatch:
            hit, found = _hits(s, *first)
            sums = np.concatenate([[0], np.cumsum(hit)])[s.starts]
            return _report(s.ids, s.words.tolist(), np.diff(sums).tolist(), found)

        return index.mapInArrow(_searching(whole), REPORT)
    found = appended(map(hits, others), "hits", HITS)
    merged = found.groupBy("shard", "place").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))  # no more than its words a block
    words = index.select("shard", "doc_ids", "doc_nulls", "doc_words").mapInArrow(_word_batches, WORDS)
    return words.join(merged, ["shard", "place"], "left").select("doc_id", "n_words", "hits", "items").mapInArrow(_merge_batches, REPORT)


def _first(blocks: Iterator[tuple]) -> tuple[tuple, Iterator[tuple] | None]:
    """The first block, and all blocks where there are more."""
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain((first, second), blocks)
