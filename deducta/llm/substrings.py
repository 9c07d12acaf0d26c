"""Substring deduplication on a compacted de Bruijn graph of words.

Every window of ``k`` words is an edge of the graph between two runs of k - 1 words.  Windows that
follow one another and share the occurrence of their smallest inner m-gram (their minimiser) form
one path, and only paths are shuffled, to the bucket of their minimiser: equal windows have equal
minimisers and so meet.  A bucket with a single distinct path does not branch: its later occurrences
repeat as a whole.  The first occurrences of the paths of a branching bucket are expanded, by a join
with their source coordinates, into single edges, which are compared by 128 bits of hash.  A first
occurrence of a window always lies in the first occurrence of its path, so nothing is lost.

What repeats has two coordinates, its own and its source's.  Pieces that meet end to start at both are compacted
to one long span; the words at its source are digested, joined to the span and compared with the words of the
span itself before any of them is removed.  Words that differ under equal hashes raise an error.

* A null or empty text has no words.  Words are runs of characters other than \\x20 and \\x09-\\x0D.
* Order: a smaller doc_id first (null after all others, by a hash of the text), then the earlier start; ids are
  under 2^62.  Rows with equal doc_id and text are one document: they share a result and do not repeat one
  another.  Different texts under one doc_id are ordered by a hash of the text.
* A text of fewer than k words has no window and stays.  Other columns are not read.
* A very long text costs some 300 bytes of memory a word; a word's place has 40 bits.

Scale: texts are shuffled once, into a table in buckets of documents that the three joins with coordinates read in
place.  Equal paths of one batch are compared word by word and reduced to the first before the shuffle.  Minimisers
that a sixteenth of the texts shows to be frequent are not used as buckets: their windows are edges from the start,
spread by their own hash.  Reducers stream over sorted rows and hold one row; a document's spans are as many as its
words at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, join_counted, partitions, staged, utf8

WINDOW = 20
INNER = 6
BATCH_BYTES = 1 << 21
_PLACE = 40  # bits of a word's place; the rest of its column tells texts under one doc_id apart
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers
PATHS = "bucket long, path long, doc long, place long, n int"
SAMPLE = 16  # one document in so many is looked at for frequent minimisers
FREQUENT = 1024  # distinct paths of a batch around one minimiser, added up over the sample
MOST_FREQUENT = 100_000


@lru_cache(maxsize=4)
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))

    return powers(factor), powers(pow(factor, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Runs:
    """Hashes of runs of consecutive words, each in constant time."""

    def __init__(self, words: list[bytes], factor: int):
        n = len(words)
        size = max(1 << max(n, 1).bit_length(), 1 << 16)
        up, self.down = _powers(factor, size)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _last_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the last of the smallest of the next ``width`` values is."""
    at = np.arange(len(values))

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] <= values[a], b, a)

    done = 1
    while done * 2 <= width:
        at = join(at[: len(at) - done], at[done:])
        done *= 2
    rest = width - done
    return join(at[: len(at) - rest], at[rest:]) if rest else at


class _Words:
    """The words of some texts in one line, and what follows from them for windows of ``k`` words."""

    def __init__(self, texts: list[bytes], k: int):
        self.words: list[bytes] = []
        counts = []
        for t in texts:
            w = t.split()
            counts.append(len(w))
            self.words += w
        self.k, self.counts = k, np.array(counts, np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.runs = [_Runs(self.words, _FACTORS[0])]

    def paths(self, inner: int) -> tuple[np.ndarray, ...]:
        """(bucket, path, text number, first window in the line, windows) of every path, in order."""
        words, k, runs = len(self.words), self.k, self.runs[0]
        none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int32))
        if words < k:
            return none
        grams = np.arange(words - inner + 1)
        rank = runs.of(grams, grams + inner)
        least = _last_smallest(rank, k - inner + 1)  # for each window
        text = np.repeat(np.arange(len(self.counts)), self.counts)[: words - k + 1]
        start = np.flatnonzero(np.arange(len(text)) + k <= (self.begins + self.counts)[text])
        if not len(start):
            return none
        text, pick = text[start], least[start]
        new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])]))
        size = np.diff(np.append(new, len(start)))
        first = start[new]
        return rank[pick[new]], runs.of(first, first + size + k - 1), text[new], first, size.astype(np.int32)

    def edges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window."""
        if len(self.runs) == 1:
            self.runs.append(_Runs(self.words, _FACTORS[1]))
        return tuple(r.of(at, at + self.k) for r in self.runs)

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether n windows from a on have the words of those from b on."""
        size = n + self.k - 1
        return self.words[a : a + size] == self.words[b : b + size]


def _spread_out(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of the given size."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Documents, tags and texts of about ``BATCH_BYTES`` at a time."""
    docs, tags, texts, size = [], [], [], 0
    for batch in batches:
        for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            docs.append(doc)
            tags.append(tag)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield docs, tags, texts
                docs, tags, texts, size = [], [], [], 0
    if docs:
        yield docs, tags, texts


def _as_batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, types[t]) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _frequent_batches(k: int, inner: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(minimiser, distinct paths of a batch around it), where there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _texts(batches):
            bucket, path, *_ = _Words(texts, k).paths(inner)
            pairs = np.unique(np.stack([bucket, path]), axis=1)
            names, counts = np.unique(pairs[0], return_counts=True)
            many = counts > 2
            yield pa.RecordBatch.from_arrays([pa.array(names[many].view(np.int64)), pa.array(counts[many])], ["bucket", "n"])

    return run


def _path_batches(k: int, inner: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(docs: list[int], tags: list[int], texts: list[bytes]) -> pa.RecordBatch:
        line = _Words(texts, k)
        bucket, path, text, first, n = line.paths(inner)
        if len(frequent) and len(bucket):
            edge = frequent[np.minimum(np.searchsorted(frequent, bucket), len(frequent) - 1)] == bucket
            at = _spread_out(first[edge], n[edge].astype(np.int64))
            single = (*line.edges(at), np.repeat(text[edge], n[edge]), at, np.ones(len(at), np.int32))
            bucket, path, text, first, n = (np.concatenate([x[~edge], y]) for x, y in zip((bucket, path, text, first, n), single, strict=True))
        doc, tag = (np.array(x, np.int64)[text] if len(text) else np.zeros(0, np.int64) for x in (docs, tags))
        place = tag << _PLACE | first - (line.begins[text] if len(text) else 0)
        order = np.lexsort((place, doc, path, bucket))
        same = (bucket[order][1:] == bucket[order][:-1]) & (path[order][1:] == path[order][:-1])
        head = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))] if len(order) else order
        moved = (doc[order] != doc[head]) | (place[order] != place[head])
        later, source = order[moved], head[moved]
        sure = np.array([line.same(a, b, m) for a, b, m in zip(first[later].tolist(), first[source].tolist(), n[later].tolist(), strict=True)], bool)
        # a later copy in this batch repeats for sure: it goes anywhere, as n < 0, but not to the hot bucket
        later = later[sure]
        bucket, n = bucket.copy(), n.copy()
        bucket[later] = _mix(doc[later].astype(np.uint64) ^ place[later].astype(np.uint64))
        n[later] *= -1
        return _as_batch([bucket, path, doc, place, n], PATHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            yield emit(*part)

    return run


SPANS = "doc long, place long, n int, open boolean, source long, source_place long"


def _spans_batch(doc: np.ndarray, place: np.ndarray, n: np.ndarray, open_: bool, source: np.ndarray | None = None, source_place: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    columns = [pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32()), pa.array(np.full(len(doc), open_)), *(none if x is None else pa.array(x, pa.int64()) for x in (source, source_place))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SPANS.split(", ")])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, path, doc, place): later occurrences with their source, which is none where the words
    were compared already, and first ones of branching buckets (open).

    Rows of equal (doc, place) are one document's and do not repeat one another.
    """
    before: tuple[int, int] | None = None  # bucket and path of the last row
    first: tuple[int, int] = (0, 0)  # where its path occurs first
    waiting: tuple[int, int, int] | None = None  # the first path of a bucket, until a second comes

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, path, doc, place, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        sent = n < 0
        yield _spans_batch(doc[sent], place[sent], -n[sent], False)
        bucket, path, doc, place, n = (x[~sent] for x in (bucket, path, doc, place, n))
        if not len(bucket):
            continue
        held = before or (0, 0)
        new_bucket = np.concatenate([[before is None or bucket[0] != held[0]], bucket[1:] != bucket[:-1]])
        new_path = new_bucket | np.concatenate([[before is None or path[0] != held[1]], path[1:] != path[:-1]])
        at = np.maximum.accumulate(np.where(new_path, np.arange(len(path)), -1))
        source = np.where(at >= 0, doc[np.maximum(at, 0)], first[0])
        source_place = np.where(at >= 0, place[np.maximum(at, 0)], first[1])
        later = ~new_path & ((doc != source) | (place != source_place))
        yield _spans_batch(doc[later], place[later], n[later], False, source[later], source_place[later])
        heads = np.flatnonzero(new_path)
        # a path is open if it is not the first of its bucket, or if another follows the first
        second = ~new_bucket[heads]
        open_ = heads[second | np.concatenate([second[1:], [False]])]
        yield _spans_batch(doc[open_], place[open_], n[open_], True)
        if waiting is not None and len(heads):
            if second[0]:
                yield _spans_batch(*(np.array([x]) for x in waiting), True)
            waiting = None
        if len(heads) and not second[-1]:
            h = heads[-1]
            waiting = (int(doc[h]), int(place[h]), int(n[h]))
        before = (int(bucket[-1]), int(path[-1]))
        first = (int(source[-1]), int(source_place[-1]))


def _compare(rows: DataFrame) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "path", "doc", "place").mapInArrow(_repeats, SPANS)


def _edge_batches(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The single windows of the open paths of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes = _lists(batch, 3), _lists(batch, 4)
            parts = []
            for r, (doc, tag, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                at = np.unique(_spread_out(starts[r], sizes[r]))
                parts.append((*_Words([text.as_py()], k).edges(at), np.full(len(at), doc), tag << _PLACE | at, np.ones(len(at), np.int32)))
            if parts:
                yield _as_batch([np.concatenate(c) for c in zip(*parts, strict=True)], PATHS)

    return run


def _lists(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """A list column as an array for each row; null is empty."""
    x = batch.column(column)
    values = x.values.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = x.offsets.to_numpy().tolist()
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(ends[:-1], ends[1:], x.is_valid().to_pylist(), strict=True)]


def _sources(docs: DataFrame) -> DataFrame:
    """The texts in buckets of (doc, tag); documents without an id are numbered by a hash, after all others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    unnamed = F.shiftrightunsigned(F.xxhash64(text, F.lit(1)), 2).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("doc"),
        F.shiftrightunsigned(F.xxhash64(text), _PLACE + 1).alias("tag"),
        utf8("text").alias("text"),
    )
    return bucketed(rows, "texts", "doc", "tag")


def _apart(place: str, out: str, tag: str) -> list[Column]:
    """A place and its text's tag, as two columns."""
    return [F.shiftright(place, _PLACE).alias(tag), F.col(place).bitwiseAND(F.lit((1 << _PLACE) - 1)).alias(out)]


def _lists_of(spans: DataFrame, *columns: str) -> DataFrame:
    """The rows of each document, as lists in one order: no more than its words."""
    n = min(partitions(spans.sparkSession), 100_000)  # as many as the buckets of the texts
    grouped = spans.repartition(n, "doc", "tag").groupBy("doc", "tag").agg(F.collect_list(F.struct(*columns)).alias("x"))
    return grouped.select("doc", "tag", *(F.col(f"x.{c}").alias(c) for c in columns))


def frequent_minimisers(texts: DataFrame, k: int, inner: int) -> np.ndarray:
    some = texts.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(SAMPLE)) == 0).select("doc", "tag", "text")
    counts = some.mapInArrow(_frequent_batches(k, inner), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "bucket").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.bucket for r in rows], np.int64).view(np.uint64))


def repeated_windows(texts: DataFrame, k: int = WINDOW, inner: int = INNER) -> DataFrame:
    """(doc, place, n, source, source_place): runs of n windows that start earlier at the source; places also hold tags.

    The source is null where the words were compared when the texts were read together.
    """
    read = _path_batches(k, inner, frequent_minimisers(texts, k, inner))
    found = staged(_compare(texts.select("doc", "tag", "text").mapInArrow(read, PATHS)), "paths")
    asked = _lists_of(found.where("open").select("doc", *_apart("place", "s", "tag"), "n"), "s", "n")
    edges = texts.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "s", "n").mapInArrow(_edge_batches(k), PATHS)
    single = _compare(edges).where("NOT open")
    return found.where("NOT open").unionByName(single).drop("open")


def compacted(windows: DataFrame) -> DataFrame:
    """(doc, tag, s, n, source, source_tag, source_s): pieces that meet or overlap at both coordinates, as one span."""
    n = min(partitions(windows.sparkSession), 100_000)
    pieces = windows.select("doc", *_apart("place", "s", "tag"), "n", "source", *_apart("source_place", "source_s", "source_tag"))
    chain = ["doc", "tag", "source", "source_tag", "shift"]
    pieces = pieces.withColumn("shift", F.col("s") - F.col("source_s")).repartition(n, "doc", "tag")
    ordered = Window.partitionBy(*chain).orderBy("s")
    reach = F.max(F.col("s") + F.col("n")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    turned = pieces.withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    numbered = turned.withColumn("chain", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*chain, "chain").agg(F.min("s").alias("s"), F.max(F.col("s") + F.col("n")).alias("e"), F.min("source_s").alias("source_s"))
    return staged(spans.select("doc", "tag", "s", (F.col("e") - F.col("s")).alias("n"), "source", "source_tag", "source_s"), "spans")


def _digest(words: list[bytes], start: int, windows: int, k: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[start : start + windows + k - 1]))


def _digest_batches(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The digest of the words at each asked place of each text."""
    names = ["source", "source_tag", "source_s", "n", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes = _lists(batch, 3), _lists(batch, 4)
            counts = [len(x) for x in starts]
            digests = []
            for r, text in enumerate(batch.column(2)):
                words = text.as_py().split()
                digests += [_digest(words, s, n, k) for s, n in zip(starts[r].tolist(), sizes[r].tolist(), strict=True)]
            columns = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in (0, 1)]
            columns += [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.binary())], names)

    return run


def sourced(spans: DataFrame, texts: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc, tag, s, n, digest): the spans with a digest of the words at their source; null where none is needed."""
    at = ["source", "source_tag", "source_s", "n"]
    wanted = spans.where("source IS NOT NULL").groupBy(*at).agg(F.count(F.lit(1)).alias("rows"))
    lists = _lists_of(wanted.select(F.col("source").alias("doc"), F.col("source_tag").alias("tag"), F.col("source_s").alias("s"), "n"), "s", "n")
    read = texts.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "s", "n")
    digests = read.mapInArrow(_digest_batches(k), "source long, source_tag long, source_s long, n long, digest binary").dropDuplicates(at)
    counted = staged(digests.join(wanted, at).withColumnsRenamed({"n": "windows", "rows": "n"}), "digests")
    return join_counted(spans.withColumnRenamed("n", "windows"), counted, [*at[:3], "windows"]).select("doc", "tag", "s", F.col("windows").alias("n"), "digest", "source")


def _cover(words: list[bytes], starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes + k - 1, -1)
    return np.cumsum(edge)[:-1] > 0


KEPT = "doc_id long, n_words long, n_removed long, kept binary, spans array<array<long>>"


def _kept_batches(k: int, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes, sources = _lists(batch, 2), _lists(batch, 3), batch.column(4)
            n, removed, kept, spans = [], [], [], []
            for r, text in enumerate(batch.column(1)):
                words = text.as_py().split()
                for s, size, want in zip(starts[r].tolist(), sizes[r].tolist(), sources[r].as_py() or (), strict=True):
                    if want and _digest(words, s, size, k) != want:
                        raise ValueError(f"words {s} to {s + size + k - 2} of document {batch.column(0)[r].as_py()} are not those of their source")
                lost = _cover(words, starts[r], sizes[r], k)
                left = b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x] if len(starts[r]) else words)
                n.append(len(words))
                removed.append(int(lost.sum()))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                if not digest:
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).reshape(-1, 2)
                    spans.append(turns.tolist())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def _placed(docs: DataFrame, k: int, inner: int) -> DataFrame:
    texts = _sources(docs)
    spans = sourced(compacted(repeated_windows(texts, k, inner)), texts, k)
    # a span that has a source must have its digest; words that were compared already have an empty one
    due = F.when(F.col("source").isNull(), F.lit(b"")).otherwise(F.coalesce("digest", F.lit(b"missing")))
    lists = _lists_of(spans.select("doc", "tag", "s", "n", due.alias("digest")), "s", "n", "digest")
    return texts.join(lists, ["doc", "tag"], "left").select("doc_id", "text", "s", "n", "digest")


def remove_repeats(docs: DataFrame, k: int = WINDOW, inner: int = INNER) -> DataFrame:
    """(doc_id, n_words, n_removed, text, spans): the words that stay, and [from, to) of those removed."""
    rows = _placed(docs, k, inner).mapInArrow(_kept_batches(k, False), KEPT)
    return rows.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("text"), "spans")


def removal_digests(docs: DataFrame, k: int = WINDOW, inner: int = INNER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of what ``remove_repeats`` keeps."""
    return _placed(docs, k, inner).mapInArrow(_kept_batches(k, True), "doc_id long, n_words long, n_removed long, kept_sha256 string")
