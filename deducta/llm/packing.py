"""Lexical retrieval packing: neighbours found by BM25 fill each seed document's window.

``tokenize`` stores documents as chunks of token ids with each chunk's document frequencies; the
frequencies of all chunks give the BM25 weights.  ``route`` brings lexically related documents together:
they are ordered by three weighted min-hashes of their distinct ids, the weight of an id being the square of its
BM25 inverse document frequency, so two documents stand next to one another with a probability that grows
with the weighted share of ids that they have in common.  A shard is a run of about ``SHARD_TOKENS`` ids in
that order.  ``pack`` builds each shard's inverted index and fills windows greedily: a seed, then the
unused documents of the shard that its terms retrieve, best first.  Retrieval covers the shard, not the corpus;
the order decides which of the corpus's neighbours a shard holds.

* A document is its token ids and then the end id, so a null or empty text is the end id alone.
* Windows of a long document that it fills alone are sequences of their own; its rest is packed.
* A neighbour that fits whole is preferred, in order of score, ties by place in the shard; when none
  of the best fits, the best is cut, so that every window is full.  What is left at a shard's
  end goes into sequences of power-of-two lengths.  No sequence is padded.
* Repeated rows are packed each; a null doc_id keeps its row; other columns are not read.
* An empty table gives no piece.

Scale: the ids are shuffled once, 16 bits each, into ranges of min-hashes and, where a min-hash is that of many
documents (copies), of places, so no task gets a hot group whole.  Of the frequencies, a task sends at most one
row for each id of the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, utf8

WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 20
BEST = 64
K1, B = 1.2, 0.75
SHARDS_A_TASK = 4
MOST_TASKS = 1 << 16
CHUNKS = "chunk long, doc_ids array<long>, sizes binary, ids binary, terms binary, found binary"
ROUTED = "key long, place long, doc_id long, ids binary"

_PLAIN = re.compile("[a-zà-öø-ÿœ]+")
#: A stop or comma after anything but a Latin letter, a digit or white space: there a run of signs goes on.
_SIGNS = re.compile(rb"[.,](?:(?<=[^A-Za-z0-9\s\x80-\xff][.,])|(?<=[\x80-\xff][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,]))")
_END = b"\xff"  # in no UTF-8 text
_CACHED = 1_000_000  # words whose ids a worker remembers


class WordTokenizer(dict):
    """Ids of texts under a tokenizer that drops white space, lower-cases and never joins words.

    White-space-separated words are tokenized alone and remembered, without a stop or comma at their
    end where that is a token boundary.  A new word of plain letters is merged from its bytes and an
    end mark by the rank of the merged token.  That is the tokenizer's own merging wherever every token
    is what its own text is merged to, since inside a token the merges run as if it stood alone; the
    tests check that of every token.  All other new words go through the tokenizer itself.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        if max(self.model.get_vocab(with_added_tokens=True).values()) >= 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        unit = {c: bytes([b]) for b, c in _byte_letters().items()}
        end = "</w>"
        spelled = {t: b"".join(unit[c] for c in t.removesuffix(end)) + _END * t.endswith(end) for t in vocabulary if all(c in unit for c in t.removesuffix(end))}
        # what closes a word comes before any merge, and then tokens by their number, as they were made
        order = sorted(spelled, key=lambda t: (len(t.removesuffix(end)) > 1, vocabulary[t]))
        ranks: dict[bytes, int] = {}
        self.pieces: list[bytes] = []
        for t in order:
            ranks[spelled[t]] = len(ranks)
            self.pieces.append(np.array([vocabulary[t]], "<u2").tobytes())
        for b in range(256):  # the rest of the bytes must have ranks, though no plain word has them
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = len(ranks)
                self.pieces.append(b"")
        # not part of tiktoken's interface: where it is missing, every word goes through the tokenizer itself
        core = getattr(tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
        self.merge = getattr(core, "encode_single_piece", None)

    def _encode(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if self.merge and (word.isalpha() or _PLAIN.fullmatch(word.decode())):
            pieces = self.pieces
            out = b"".join([pieces[r] for r in self.merge(word + _END)])
        else:
            out = self._encode(word.decode())
        self[word] = out
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each UTF-8 text."""
        if len(self) > _CACHED:
            self.clear()
        get, out = self.__getitem__, []
        for t in texts:
            if not _SIGNS.search(t):
                t = t.replace(b".", b" .").replace(b",", b" ,")
            # lowering A-Z first keeps the cache small, but must not spell a special token
            out.append(b"".join(map(get, (t if b"<|" in t else t.lower()).split())))
        return out


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is one, else those after U+00FF in order."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _frequencies(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a shard, sorted by term: (term, document, how often)."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    keys, counts = np.unique(ids.astype(np.int64) << 32 | doc, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, counts


def _number(n: int, bits: int) -> int:
    if n >> bits:
        raise OverflowError(f"{n} does not fit in {bits} bits")
    return n


def _chunk_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        task = TaskContext.get()
        number = _number(task.partitionId() if task else 0, 22) << 20
        held: list[tuple[int | None, bytes]] = []
        total = 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(x) // 2 for _, x in held], np.int64)
            raw = b"".join(x for _, x in held)
            term = _frequencies(np.frombuffer(raw, "<u2"), sizes)[0]
            terms, found = np.unique(term, return_counts=True)
            values = [_number(number, 42), [i for i, _ in held], sizes.tobytes(), raw, terms.astype(np.int32).tobytes(), found.astype(np.int32).tobytes()]
            types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        end = np.array([END], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.ids(texts), strict=True):
                    held.append((doc_id, ids + end))
                    total += len(ids) // 2 + 1
                    if total >= SHARD_TOKENS:
                        yield row()
                        held, total, number = [], 0, number + 1
        if held:
            yield row()

    return run


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """The stored chunks of token ids."""
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(_chunk_batches(path), CHUNKS), "tokens")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << 16) + 2, np.int64)
    for batch in batches:
        for r in range(batch.num_rows):
            total[np.frombuffer(batch.column(2)[r].as_py(), np.int32)] += np.frombuffer(batch.column(3)[r].as_py(), np.int32)
            sizes = np.frombuffer(batch.column(1)[r].as_py(), np.int64)
            total[-2] += len(sizes)
            total[-1] += sizes.sum()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])


def statistics(chunks: DataFrame) -> tuple[np.ndarray, int, int]:
    """(documents that hold each id, documents, ids) over all chunks."""
    counts = chunks.select("chunk", "sizes", "terms", "found").mapInArrow(_count_batches, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.zeros((1 << 16) + 2, np.int64)
    for r in counts.collect():  # at most one row for each id of the vocabulary
        total[r.term] = r.n
    return total[:-2], int(total[-2]), int(total[-1])


def _idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - frequency + 0.5) / (frequency + 0.5))


def min_hash_ranks(frequency: np.ndarray, documents: int) -> list[np.ndarray]:
    """For each of three min-hashes, the rank of every id: the smallest of a document is its hash.

    Exponential variates at the rate of an id's weight: it is the smallest of a set with a probability in
    proportion to its weight, and two sets with the same variates agree as their weights overlap.
    """
    r = np.random.default_rng(5)
    weight = np.maximum(_idf(frequency, documents), 1e-9) ** 2
    return [np.argsort(np.argsort(r.exponential(size=len(weight)) / weight)).astype(np.uint16) for _ in range(3)]


def _route_batches(ranks: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in ROUTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, doc_ids, raw = batch.column(0)[r].as_py(), batch.column(1)[r].values, batch.column(3)[r].as_buffer()
                sizes = np.frombuffer(batch.column(2)[r].as_py(), np.int64)
                ids, ends = np.frombuffer(raw, "<u2"), np.cumsum(sizes)
                key = np.zeros(len(sizes), np.int64)
                for rank in ranks:
                    key = key << 16 | np.minimum.reduceat(rank[ids], ends - sizes)
                offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
                rows = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), raw])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(chunk << 21 | np.arange(len(sizes))), doc_ids, rows], names)

    return run


def route(chunks: DataFrame, frequency: np.ndarray, documents: int, ids: int) -> DataFrame:
    """(key, place, doc_id, ids) of every document, in the order of the min-hashes inside and across partitions."""
    rows = chunks.select("chunk", "doc_ids", "sizes", "ids").mapInArrow(_route_batches(min_hash_ranks(frequency, documents)), ROUTED)
    n = min(MOST_TASKS, 1 + ids // (SHARDS_A_TASK * SHARD_TOKENS))
    return rows.repartitionByRange(n, "key", "place").sortWithinPartitions("key", "place")


class Index:
    """A shard's inverted index, with the BM25 weight of every posting."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, frequency: np.ndarray, documents: int, mean: float):
        term, self.doc, count = _frequencies(ids, sizes)
        self.terms, begin = np.unique(term, return_index=True)
        self.begin = np.append(begin, len(term))
        idf = _idf(frequency, documents)
        norm = K1 * (1 - B + B * sizes / mean)
        self.weight = idf[term] * count * (K1 + 1) / (count + norm[self.doc])
        order = np.argsort(self.doc, kind="stable")
        self.own = np.searchsorted(self.terms, term[order])  # the terms of each document
        self.of = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(sizes)))])
        # terms of an eighth of the documents or more as full rows: at most eight times the postings
        found = np.diff(self.begin)
        full = np.flatnonzero(found * 8 >= len(sizes))
        self.row = np.full(len(self.terms), -1)
        self.row[full] = np.arange(len(full))
        at = np.flatnonzero(np.repeat(self.row >= 0, found))
        self.full = np.zeros((len(full), len(sizes)))
        self.full[np.repeat(np.arange(len(full)), found[full]), self.doc[at]] = self.weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's distinct terms."""
        terms = self.own[self.of[seed] : self.of[seed + 1]]
        row = self.row[terms]
        terms = terms[row < 0]
        first, n = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[at], self.weight[at], minlength=len(self.of) - 1) + self.full[row[row >= 0]].sum(axis=0)


def fill(index: Index, sizes: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every id of the shard once."""
    done = sizes // window * window
    out = [[(d, s, window)] for d in np.flatnonzero(done).tolist() for s in range(0, int(done[d]), window)]
    start, left = done.tolist(), (sizes - done).tolist()
    unused = np.array(left) > 0
    mean = max(1.0, float(sizes.mean())) if len(sizes) else 1.0
    row: list[tuple[int, int, int]] = []
    for seed in range(len(left)):
        while unused[seed]:
            row, room = [(seed, start[seed], left[seed])], window - left[seed]
            unused[seed] = False
            scores = np.where(unused, index.scores(seed), -1.0) if room else None
            while room:
                many = min(max(BEST, int(room / mean)), len(scores))
                best = np.argpartition(-scores, many - 1)[:many]
                best = best[np.lexsort((best, -scores[best]))]
                best = [d for d in best.tolist() if unused[d]]
                if not best:
                    break
                before = room
                for d in best:
                    if left[d] <= room:
                        row.append((d, start[d], left[d]))
                        room -= left[d]
                        unused[d], scores[d] = False, -1.0
                if room == before:
                    d = best[0]
                    row.append((d, start[d], room))
                    start[d], left[d], room = start[d] + room, left[d] - room, 0
            if room:
                break
            out.append(row)
            row = []
        if row:
            break
    return out + _powers(row)


def _powers(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """What is left at the end, cut into sequences of power-of-two lengths."""
    out: list[list[tuple[int, int, int]]] = []
    total = sum(n for _, _, n in row)
    size, part = (1 << total.bit_length()) >> 1, []
    room = size
    for d, s, n in row:
        while n:
            take = min(n, room)
            part.append((d, s, take))
            s, n, room = s + take, n - take, room - take
            if not room:
                out.append(part)
                total -= size
                size, part = (1 << total.bit_length()) >> 1, []
                room = size
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_batches(frequency: np.ndarray, documents: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in PIECES.split(", ")]

    def packed(shard: int, doc_ids: list[int | None], held: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // 2 for x in held], np.int64)
        ids = np.frombuffer(b"".join(held), "<u2")
        first = np.cumsum(sizes) - sizes
        rows = []
        for k, sequence in enumerate(fill(Index(ids, sizes, frequency, documents, mean), sizes)):
            offset = 0
            for d, s, n in sequence:
                at = int(first[d]) + s
                rows.append((doc_ids[d], s, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), int(sizes[d]), shard << 21 | _number(k, 21), offset))
                offset += n
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = _number(task.partitionId() if task else 0, 17) << 25
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        total = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                held.append(ids.as_py())
                total += len(held[-1]) // 2
                if total >= SHARD_TOKENS:
                    yield packed(_number(shard, 42), doc_ids, held)
                    doc_ids, held, total, shard = [], [], 0, shard + 1
        if held:
            yield packed(_number(shard, 42), doc_ids, held)

    return run


def pack(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    chunks = tokenize(docs, path)
    frequency, documents, ids = statistics(chunks)
    mean = max(ids / max(documents, 1), 1.0)
    return route(chunks, frequency, documents, ids).select("doc_id", "ids").mapInArrow(_pack_batches(frequency, documents, mean), PIECES)
