"""Near-duplicate detection by SimHash with bit-sliced distance counting.

``fingerprints`` makes 64-bit SimHashes of word shingles; ``links`` finds every pair of
distinct fingerprints within the radius; ``components`` names each connected group by its
smallest document.  ``near_copies`` groups documents by exact resemblance of wider shingles instead.

* Null and empty texts have no words: fingerprint zero, linked like any other.
* Texts of fewer than three words hash their whole word sequence; very long ones are hashed ``SLICE`` bytes at
  a time, so memory is the text and some ten times a slice.
* Repeated rows: equal fingerprints are one node, so a group of copies of any size costs one row.
* A null doc_id keeps its row; it names no component, and its component is that of its fingerprint.
* Other columns of the input are not read, whatever their names.

Scale: only distinct fingerprints are compared.  A pair within distance 3 differs in at most 3 of
5 bit blocks and so agrees on some 2 of them: ten tables keyed by two blocks hold every pair.  A
bucket over ``BUCKET`` rows is dealt out as pairs of sub-blocks, so no task gets an unbounded group
and no pair is lost.  Inside a bucket, bit planes are compared diagonal by diagonal, and only a
spanning forest of its links leaves the task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint, join_counted, partitions, staged, utf8

RADIUS = 3
BUCKET = 2048
WIDTHS = (13, 13, 13, 13, 12)
SLICE = 1 << 20  # bytes of a text that are hashed at a time
MANY = 1_000_000  # large buckets that are sent to every executor at most
ALONE = 200_000  # links that one task unites at most; beyond that, in rounds of shuffles
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hash_runs(words: list[bytes], size: int, seed: int) -> np.ndarray:
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], seed) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def shingle_parts(text: bytes, size: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words of the A-Z-lowered text, ``SLICE`` bytes of it at a time; one hash of a shorter sequence."""
    held: list[bytes] = []
    at, cut_before = 0, False
    while at < len(text):
        space = _SPACE.search(text, at + SLICE)  # a word that is longer is taken whole
        end = space.start() if space else len(text)
        held += text[at:end].lower().split()  # bytes: lowers A-Z alone, splits at \x20 and \x09-\x0D alone
        at = end
        if at < len(text) and len(held) > size:
            yield _hash_runs(held, size, seed)
            held, cut_before = held[len(held) - size + 1 :], True
    if held and (not cut_before or len(held) >= size):
        yield _hash_runs(held, size, seed)


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> np.ndarray:
    """All parts of ``shingle_parts``."""
    return np.concatenate([np.zeros(0, np.uint64), *shingle_parts(text, size, seed)])


def simhash(parts: Iterator[np.ndarray]) -> int:
    """Bit b is 1 if it is set in over half the hashes; zero of none."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(shingle_parts(t.as_buffer().to_pybytes())) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _masks() -> list[int]:
    at, blocks = 0, []
    for width in WIDTHS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(blocks, len(WIDTHS) - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(prints: np.ndarray) -> np.ndarray:
    """Vertical layout: row b holds bit b of 64 fingerprints a word."""
    n = len(prints)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    words = -(-n // 64)
    out = np.zeros((64, words * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def _pack(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def close_pairs(prints: np.ndarray, last: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j <= last[i], within the radius (at most 3), one diagonal j - i at a time.

    A carry-save counter of two bit words and an overflow word counts 64 distances at once; a
    word of comparisons is abandoned as soon as all of its distances have passed the radius.
    """
    n = len(prints)
    if n < 2:
        return
    planes = _planes(prints)
    rows = np.arange(n)
    padded = np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)
    most = int((last - rows).max(initial=0))
    for d in range(1, most + 1):
        valid = _pack(last - rows >= d)
        at = np.flatnonzero(valid)
        q, r = divmod(d, 64)
        alive = valid[at]
        ones, twos, over = (np.zeros(len(at), np.uint64) for _ in range(3))
        for p in range(0, 64, 8):
            low = padded[p : p + 8, np.minimum(at + q, padded.shape[1] - 1)]
            if r:
                high = padded[p : p + 8, np.minimum(at + q + 1, padded.shape[1] - 1)]
                low = (low >> np.uint64(r)) | (high << np.uint64(64 - r))
            for x in padded[p : p + 8, at] ^ low:
                carry = ones & x
                ones = ones ^ x
                over = over | (twos & carry)
                twos = twos ^ carry
            if radius < 3:
                far = twos & ones if radius == 2 else twos if radius == 1 else twos | ones
                left = alive & ~(over | far)
            else:
                left = alive & ~over
            keep = np.flatnonzero(left)
            if len(keep) < len(at):
                at, alive, ones, twos, over = at[keep], alive[keep], ones[keep], twos[keep], over[keep]
                left = left[keep]
            if not len(at):
                break
        if len(at):
            bits = np.unpackbits(left.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
            word, bit = np.nonzero(bits)
            i = at[word] * 64 + bit
            yield i, i + d


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of n rows."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        open_ = root[i] != root[j]
        for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        while (root[root] != root).any():
            root = root[root]
    return out


def _bucket_links(prints: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Links inside each of the consecutive groups of the given sizes."""
    ends = np.cumsum(sizes)
    a, b = [], []
    for least, most in ((2, 4), (5, 32), (33, 256), (257, 1 << 60)):
        chosen = np.flatnonzero((sizes >= least) & (sizes <= most))
        if not len(chosen):
            continue
        size = sizes[chosen]
        rows = np.repeat(ends[chosen] - np.cumsum(size), size) + np.arange(size.sum())
        last = np.repeat(np.cumsum(size) - 1, size)
        for i, j in _forest(close_pairs(prints[rows], last), len(rows)):
            a.append(int(names[rows[i]]))
            b.append(int(names[rows[j]]))
    return a, b


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; a bucket that the end of a batch cuts waits for the next batch."""
    held: tuple[np.ndarray, ...] | None = None

    def links(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, prints, names = part
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        a, b = _bucket_links(prints.view(np.uint64), names, np.diff(np.append(edges, len(key))))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        new = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        part = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        if len(part[0]) < 50_000:
            held = part
            continue
        earlier = np.flatnonzero(part[0] != part[0][-1])
        cut = int(earlier[-1]) + 1 if len(earlier) else 0
        if cut:
            yield links(tuple(x[:cut] for x in part))
        held = tuple(x[cut:] for x in part)
    if held is not None and len(held[0]):
        yield links(held)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect what all pairs of ``nodes`` (fp, node) within the radius connect."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(_masks())]))
    rows = nodes.select("fp", "node", keys.alias("k")).select("fp", "node", "k.t", "k.key")
    large = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    large, _ = bounded(large, MANY)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BUCKET).cast("int")
    dealt = (
        rows.join(large, ["t", "key"], "left")
        .withColumn("g", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("fp", "node", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    )
    n = max(partitions(nodes.sparkSession), 1)
    return (
        dealt.repartition(n, "bucket")
        .sortWithinPartitions("bucket", "fp")
        .select("bucket", "fp", "node")
        .mapInArrow(_link_batches, "a long, b long")
        .distinct()
    )


def _united_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links at once: (node, component) of every node that is not the smallest of its component."""
    held = [[batch.column(k).to_numpy() for k in (0, 1)] for batch in batches]
    if not held:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
    nodes, at = np.unique(ends, return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(x):
        u, v = root[x], root[y]
        apart = u != v
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[k]) for k in (other, root[other])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component), stored: the smallest node reachable, by alternating large and small stars.

    Up to ``ALONE`` links meet in one task.  Beyond that, each round is min-aggregations and joins; what they yield is
    checkpointed into the shared folder, so that nothing is derived twice.  The number of rounds grows with the
    logarithm of the longest chain.  A round costs some ten shuffles, each with a task and files for every
    partition, however few the links are.
    """

    def star(sym: DataFrame) -> DataFrame:
        least = checkpoint(sym.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        return join_counted(sym, least.select("a", "n", F.least("a", "m").alias("m")), "a")

    def marks(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = marks(e)
    if before[0] <= ALONE:
        return checkpoint(e.coalesce(1).mapInArrow(_united_batches, "node long, component long"))
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = checkpoint(star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = star(large)
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = checkpoint(small.where("a != b").distinct())
        after = marks(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    prints = checkpoint(fingerprints(docs))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    named = nodes.where("node IS NOT NULL")
    groups = components(links(named))
    of = named.join(groups, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return join_counted(prints, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies: wide fingerprints, then whole sets

COPY_WORDS = 5
COPY_BITS = 256
COPY_RADIUS = 104
SPREAD = 16  # one text in so many is looked at for common shingles
COMMON = 4  # as often among those: common
MOST_COMMON = 100_000
NODES = 1_000_000  # text hashes that are sent to every executor, or remembered by a task, at most
TOGETHER = 64  # rows of a bucket that is compared together with others
HELD = 1 << 22  # shingles that a task holds for a bucket, about


def shingle_set(text: bytes, size: int = COPY_WORDS) -> np.ndarray:
    """The distinct shingle hashes in order; texts without words share one element."""
    found = np.unique(shingle_hashes(text, size))
    return found if len(found) else np.zeros(1, np.uint64)


def wide_print(found: np.ndarray) -> np.ndarray:
    """SimHash of ``COPY_BITS`` bits: those of every hash and of further mixes of it; a bit is 1 if it is set in over half."""
    ones = np.zeros(COPY_BITS, np.int64)
    for at in range(0, len(found), 4096):
        x = found[at : at + 4096]
        streams = np.empty((len(x), COPY_BITS // 64), "<u8")
        for k in range(streams.shape[1]):
            streams[:, k] = x
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        bits = np.unpackbits(streams.view(np.uint8), axis=1, bitorder="little")
        ones += (np.ones(len(bits), np.float32) @ bits.astype(np.float32)).astype(np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _near_words(differ: Callable[[int, np.ndarray], np.ndarray], alive: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 pairs and their flags, where those within the radius are left.

    ``differ`` gives eight planes of differing bits at a time for the words that are left.  Carry-save counters begin so
    that they overflow beyond the radius; a word is abandoned when all of its pairs have overflown.
    """
    k = max(3, radius.bit_length())
    cells = np.arange(len(alive))
    count = [np.full(len(alive), np.uint64((1 << 64) - 1) * np.uint64(((1 << k) - 1 - radius) >> j & 1)) for j in range(k)]
    for p in range(0, bits, 8):
        x = differ(p, cells)
        ones, a = _adder(count[0], x[0], x[1])
        ones, b = _adder(ones, x[2], x[3])
        ones, c = _adder(ones, x[4], x[5])
        ones, d = _adder(ones, x[6], x[7])
        twos, e = _adder(count[1], a, b)
        twos, f = _adder(twos, c, d)
        fours, carry = _adder(count[2], e, f)
        count[:3] = ones, twos, fours
        for j in range(3, k):
            count[j], carry = count[j] ^ carry, count[j] & carry
        alive = alive & ~carry
        keep = np.flatnonzero(alive)
        if 4 * len(keep) < 3 * len(alive):
            cells, alive, count = cells[keep], alive[keep], [c[keep] for c in count]
        if not len(alive):
            break
    return cells, alive


def _wide_planes(prints: np.ndarray) -> np.ndarray:
    """Row b holds bit b of 64 fingerprints a word."""
    return np.concatenate([_planes(np.ascontiguousarray(prints[:, k])) for k in range(prints.shape[1])])


def wide_close_pairs(prints: np.ndarray, last: np.ndarray, radius: int = COPY_RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``close_pairs`` for fingerprints of several words, a row each, and any radius."""
    rows = np.arange(len(prints))
    planes = np.concatenate([_wide_planes(prints), np.zeros((64 * prints.shape[1], 1), np.uint64)], axis=1)
    for d in range(1, int((last - rows).max(initial=0)) + 1):
        valid = _pack(last - rows >= d)
        at = np.flatnonzero(valid)
        q, r = divmod(d, 64)
        low, high = (np.minimum(at + q + k, planes.shape[1] - 1) for k in (0, 1))

        def differ(p: int, cells: np.ndarray) -> np.ndarray:
            x = planes[p : p + 8, low[cells]]  # noqa: B023
            if r:  # noqa: B023
                x = (x >> np.uint64(r)) | (planes[p : p + 8, high[cells]] << np.uint64(64 - r))  # noqa: B023
            return x ^ planes[p : p + 8, at[cells]]  # noqa: B023

        cells, left = _near_words(differ, valid[at], len(planes), radius)
        word, bit = np.nonzero(np.unpackbits(left.view(np.uint8).reshape(len(left), 8), axis=1, bitorder="little"))
        i = at[cells[word]] * 64 + bit
        yield i, i + d


def wide_close_to(some: np.ndarray, prints: np.ndarray, radius: int = COPY_RADIUS) -> np.ndarray:
    """Which of ``prints`` (columns) are within the radius of each of ``some`` (rows)."""
    planes = _wide_planes(prints)
    words = planes.shape[1]
    own = np.unpackbits(np.ascontiguousarray(some).astype("<u8").view(np.uint8), axis=1, bitorder="little").T.astype(np.uint64) * np.uint64((1 << 64) - 1)
    cells, left = _near_words(lambda p, c: planes[p : p + 8, c % words] ^ own[p : p + 8, c // words], np.tile(_pack(np.ones(len(prints), bool)), len(some)), len(planes), radius)
    flags = np.zeros(words * len(some), np.uint64)
    flags[cells] = left
    return np.unpackbits(flags.view(np.uint8).reshape(len(some), words * 8), axis=1, bitorder="little")[:, : len(prints)].astype(bool)


class _Seen:
    """Which texts a task has linked, so that it sends no link twice; forgets when it knows too many."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def new(self, a: int, b: int) -> bool:
        if len(self.up) >= NODES:
            self.up.clear()
        x, y = self._top(a), self._top(b)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(node, text) once a node and task, as far as nodes are remembered."""
    seen: set[int] = set()
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if node not in seen:
                if len(seen) >= NODES:
                    seen.clear()
                seen.add(node)
                yield node, text.as_buffer().to_pybytes()


def _once_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with another node (first column) than the task's earlier ones, as far as nodes are remembered."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for node in batch.column(0).to_pylist():
            if len(seen) >= NODES:
                seen.clear()
            keep.append(node not in seen)
            seen.add(node)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for _, text in _distinct_texts(batches):
        held.append(shingle_set(text))
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["s"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["s"])


def _print_batches(common: np.ndarray, counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each set's size, fingerprint, and first elements: a fifth of it and one more, common shingles last, by how often they occur."""
    types = {"node": pa.int64(), "n": pa.int64(), "print": pa.binary(), "firsts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, bytes]] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.values(), strict=True)], list(types))

        for node, text in _distinct_texts(batches):
            found = ordered = shingle_set(text)
            if len(common):
                place = np.minimum(np.searchsorted(common, found), len(common) - 1)
                ordered = found[np.argsort(np.where(common[place] == found, counts[place], 0), kind="stable")]
            held.append((node, len(found), wide_print(found).tobytes(), ordered[: len(found) // 5 + 1].tobytes()))
            if len(held) == 256:
                yield rows()
                held = []
        if held:
            yield rows()

    return run


def _first_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            firsts = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            columns = [np.concatenate(firsts), np.repeat(part.column(0).to_numpy(), [len(x) for x in firsts])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle and node: those whose shingle other nodes have too."""
    held: tuple[np.ndarray, ...] | None = None

    def shared(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        s, node = part
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])])
        s, node = s[new], node[new]
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s)))
        many = np.repeat(sizes > 1, sizes)
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (s, node)], ["key", "node"])

    for batch in batches:
        new = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        part = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        if not len(part[0]):
            continue
        cut = int(np.searchsorted(part[0], part[0][-1]))
        if cut:
            yield shared(tuple(x[:cut] for x in part))
        held = tuple(x[cut:] for x in part)
    if held is not None and len(held[0]):
        yield shared(held)


def _like_sizes(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, role and node: a forest of the links whose sizes and fingerprints allow the similarity.

    What one component ``c`` holds is taken as linked.  A bucket that the end of a batch cuts waits for the next batch.
    """
    held: tuple[np.ndarray, ...] | None = None
    seen = _Seen()

    def large(role: np.ndarray, node: np.ndarray, n: np.ndarray, c: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        label = np.unique(c, return_inverse=True)[1]
        left = np.flatnonzero(role <= 0)
        some = left[:1]  # first all with one, then those that are still apart from it
        while len(some) and (label != label[0]).any():
            near = wide_close_to(prints[some], prints)
            for u, row in zip(some.tolist(), near, strict=True):
                for j in np.flatnonzero(row & (label != label[u]) & _like_sizes(n, n[u])).tolist():
                    if label[j] != label[u]:
                        yield int(node[u]), int(node[j])
                        label[label == label[j]] = label[u]
            left = left[len(some) :]
            if len(some) == 1:
                most = np.bincount(label).argmax()
                left = left[label[left] != most] if label[some[0]] == most else left
            some = left[:TOGETHER]

    def links(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        bucket, role, node, n, c, prints = part
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(begin, len(bucket)))
        found: list[tuple[int, int]] = []
        for least, most in ((2, 4), (5, 16), (17, TOGETHER)):
            chosen = np.flatnonzero((sizes >= least) & (sizes <= most))
            if not len(chosen):
                continue
            size = sizes[chosen]
            rows = np.repeat(begin[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
            pairs = wide_close_pairs(prints[rows], np.repeat(np.cumsum(size) - 1, size))
            alike = ((i[keep], j[keep]) for i, j in pairs for keep in [_like_sizes(n[rows[i]], n[rows[j]]) & (c[rows[i]] != c[rows[j]])])
            found += [(int(node[rows[i]]), int(node[rows[j]])) for i, j in _forest(alike, len(rows))]
        for k in np.flatnonzero(sizes > TOGETHER).tolist():
            found += large(*(x[begin[k] : begin[k] + sizes[k]] for x in part[1:]))
        found = [x for x in found if seen.new(*x)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        words = b"".join(batch.column(5).to_pylist())
        new = (*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)), np.frombuffer(words, "<u8").reshape(batch.num_rows, -1))
        part = new if held is None or not len(held[0]) else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        cut = int(np.flatnonzero(np.diff(part[0]))[-1]) + 1 if len(part[0]) and part[0][0] != part[0][-1] else 0
        if cut and len(part[0]) >= 16_384:
            yield links(tuple(x[:cut] for x in part))
            part = tuple(x[cut:] for x in part)
        held = part
    if held is not None and len(held[0]):
        yield links(held)


def _decided(rows: list[tuple[int, int, int]], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A forest of the links of a Jaccard similarity of at least 0.8 between (role, node, component) with these sets.

    Rows with a positive role are only met by others; what one component holds is taken as linked.
    """
    n = np.array([len(x) for x in sets])
    label = np.unique([c for *_, c in rows], return_inverse=True)[1]
    prints = np.stack([wide_print(x) for x in sets]) if len(rows) > 8 else None
    done = np.zeros(len(rows), bool)
    for u, (role, node, _) in enumerate(rows):
        if role > 0 or (label == label[0]).all():
            break
        near = (label != label[u]) & ~done & _like_sizes(n, n[u])
        if prints is not None:
            near &= np.bitwise_count(prints ^ prints[u]).sum(axis=1, dtype=np.int64) <= COPY_RADIUS
        done[u] = True
        at = np.flatnonzero(near)
        if not len(at):
            continue
        others = np.concatenate([sets[j] for j in at])
        place = np.minimum(np.searchsorted(sets[u], others), n[u] - 1)
        both = np.add.reduceat(sets[u][place] == others, np.cumsum(n[at]) - n[at], dtype=np.int64)
        for j in at[9 * both >= 4 * (n[at] + n[u])].tolist():
            if label[j] != label[u]:
                yield node, rows[j][1]
                label[label == label[j]] = label[u]


def _alike_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and role, with their texts: a forest of each bucket's links."""
    before: int | None = None
    rows: list[tuple[int, int, int]] = []
    sets: list[np.ndarray] = []
    seen: set[int] = set()

    def links() -> pa.RecordBatch:
        found = list(_decided(rows, sets)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for bucket, role, node, c, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            if bucket != before:
                yield links()
                before, rows, sets, seen = bucket, [], [], set()
            if node not in seen:
                seen.add(node)
                rows.append((role, node, c))
                sets.append(shingle_set(text.as_buffer().to_pybytes()))
    yield links()


def _forests(rows: DataFrame, weights: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links that connect what all links inside the groups of ``rows`` (key, node, ...) connect.

    ``weights`` (key, g, lead) tells into how many blocks a group that is too large for a task is dealt, and a node
    that goes into each of them; ``decide`` takes rows with a bucket, a role and a component c.  What then still is
    apart from the largest component of such a group is met with the whole group, a block with a block at a time.
    """
    weights, n = bounded(weights, MANY)
    own = F.pmod(F.xxhash64("node"), F.coalesce("g", F.lit(1))).cast("int")
    blocks = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(own))
    first = rows.join(weights, "key", "left").withColumn("c", F.col("node")).withColumn("role", F.when(F.col("node") == F.col("lead"), -1).otherwise(0)).withColumn("block", F.explode(blocks))
    found = checkpoint(decide(first.withColumn("bucket", F.xxhash64("key", "block"))))
    if not n:
        return found
    of = components(found)
    within = rows.join(weights, "key").join(of, "node", "left").withColumn("c", F.coalesce("component", "node"))
    sums = within.select("key", "node", "c").distinct().groupBy("key", "c").agg(F.count(F.lit(1)).alias("rows"))
    sums = sums.groupBy("key").agg(F.max_by("c", F.struct("rows", "c")).alias("main"), (F.sum("rows") - F.max("rows")).alias("others")).where("others > 0")
    sums, n = bounded(sums.select("key", "main", F.ceil(F.col("others") / BUCKET).cast("int").alias("h")), MANY)
    if not n:
        return found
    open_ = within.join(sums, "key").withColumn("own_g", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("own_h", F.pmod(F.xxhash64("node"), F.col("h")).cast("int"))
    apart = open_.where("c != main").withColumn("role", F.lit(0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("bucket", F.xxhash64("key", "own_h", "block"))
    every = open_.withColumn("role", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("bucket", F.xxhash64("key", "block", "own_g"))
    return found.unionByName(checkpoint(decide(apart.unionByName(every))))


def _in_buckets(rows: DataFrame, *columns: str) -> DataFrame:
    n = max(partitions(rows.sparkSession), 1)
    return rows.select("bucket", "role", *columns).repartition(n, "bucket").sortWithinPartitions("bucket", "role", "node")


def candidates(firsts: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all texts with a first shingle in common and fingerprints within the radius.

    firsts: key (shingle) and node; prints: node, n and print, one row a node.
    """
    n = max(partitions(firsts.sparkSession), 1)
    shared = checkpoint(firsts.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_shared_batches, "key long, node long"))
    large = shared.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("lead")).where(F.col("rows") > BUCKET)
    large = large.select("key", F.ceil(F.col("rows") / BUCKET).cast("int").alias("g"), "lead")
    return _forests(shared.join(prints, "node"), large, lambda rows: _in_buckets(rows, "node", "n", "c", "print").mapInArrow(_candidate_batches, "a long, b long"))


def alike(groups: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that connect the texts of a group (node, component) whose Jaccard similarity is at least 0.8, by whole sets."""
    keys = groups.select("node", F.col("component").alias("key"))
    keys = keys.unionByName(keys.select(F.col("key").alias("node"), "key").distinct())
    keys, _ = bounded(keys, NODES)
    large = prints.join(keys, "node").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    g = F.ceil(F.greatest(F.col("rows") / BUCKET, F.col("n") / HELD)).cast("int")
    large = large.select("key", g.alias("g"), F.col("key").alias("lead")).where("g > 1")
    rows = texts.join(keys, "node").select("node", "key", "text").mapInArrow(_once_batches, "node long, key long, text binary")
    return _forests(rows, large, lambda rows: _in_buckets(rows, "node", "c", "text").mapInArrow(_alike_batches, "a long, b long"))


def text_hash(column: str = "text") -> Column:
    """The name of a text among near copies; null counts as the empty text."""
    return F.xxhash64(utf8(column))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component_id, component_text) for every document.

    Texts are linked where the Jaccard similarity of their sets of five-word shingles is at least 0.8;
    a group is named by its smallest (doc_id, text hash), a null doc_id after all others.  Candidates are found by
    SimHash: fingerprints of ``COPY_BITS`` bits, compared by bit planes.  No block of bits must agree at
    such a similarity, so buckets hold the texts that share a first shingle instead: under one order of all
    shingles, the first fifth of each set of such a pair, and one more, have an element in common.  Common shingles
    come last in that order, which only saves work.  Such texts differ in some 15 % of the bits (at most 19 %, for the
    smallest sets); that one of a pair is beyond ``COPY_RADIUS`` has a chance of less than 1e-14.  Only forests of the
    candidate links go out; each of their components is then decided by whole sets.
    """
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("node"))
    texts = docs.select(text_hash().alias("node"), utf8("text").alias("text"))
    some = texts.where(F.pmod("node", F.lit(SPREAD)) == 0).mapInArrow(_shingle_batches, "s long").groupBy("s").count()
    frequent = some.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON).collect()
    common, counts = np.array([r.s for r in frequent], np.int64).view(np.uint64), np.array([r["count"] for r in frequent], np.int64)
    order = np.argsort(common)
    printed = staged(texts.mapInArrow(_print_batches(common[order], counts[order]), "node long, n long, print binary, firsts binary"), "prints")
    prints = printed.select("node", "n", "print").dropDuplicates(["node"])
    firsts = printed.select("node", "firsts").mapInArrow(_first_batches, "key long, node long")
    groups = components(candidates(firsts, prints))
    of = components(alike(groups, prints, texts))

    last = (1 << 63) - 1  # a null doc_id comes after all others
    least = names.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(last))).alias("doc_id"), F.count(F.lit(1)).alias("n"))
    least = checkpoint(least.join(of, "node", "left").select("node", "doc_id", "n", F.coalesce("component", "node").alias("c")))
    heads = least.groupBy("c").agg(F.min(F.struct("doc_id", "node")).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = join_counted(least.select("node", "c", F.col("n").alias("rows")), heads, "c").select("node", F.col("rows").alias("n"), "head")
    found = join_counted(names, heads, "node")
    return found.select("doc_id", F.col("node").alias("text_hash"), F.nullif("head.doc_id", F.lit(last)).alias("component_id"), F.col("head.node").alias("component_text"))
