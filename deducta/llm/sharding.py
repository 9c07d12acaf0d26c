"""Minimax contiguous sharding of atomic groups by bytes, in DataFrame operations alone.

Documents with equal texts form one atomic group (null counts as the empty text).  Groups stand in
the order of their texts' SHA-256, and the smallest capacity at which a greedy scan fits them into
the given number of shards is found by search.  The cuts keep that capacity, which makes the largest shard
as small as it can be, but do not lie where the greedy scan ended: they lie as near to equal shares as the
capacity allows, since the scan fills the first shards and leaves the last ones short or empty.

* Size of a document: UTF-8 bytes of its text plus 8; a group of any size stays whole.
* Repeated rows are separate documents of one group; a null doc_id keeps its row.
* An empty table gives an empty result; fewer groups than shards leave shards empty.
* Other columns of the input are not read, whatever their names.

Scale: one narrow row a document is shuffled, pre-aggregated to groups.  The order is that of a
digest, so running sums need only 4,096 cell totals (a fixed number) besides a window inside a cell,
and a document finds its shard by comparing its digest with the cut digests: no join, no hot key.
The driver searches over at most ``SUMS`` running sums a pass, looked up more finely around the cuts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions, staged

SHARDS = 24
CELL_DIGITS = 3  # hexadecimal digits of the digest that name a cell
SUMS = 32_768  # running sums fetched in one pass at most
BINS = 256  # parts of a shard that are numbered on their own


class _Sums:
    """Running sums of the ordered groups, as finely as they are known yet.

    ``known`` are true running sums in order; ``solid[i]`` says that no group ends between
    known[i] and known[i + 1].  The rest stays in a stored table, by cell.
    """

    def __init__(self, groups: DataFrame):
        spark = groups.sparkSession
        cell = F.conv(F.substring("key", 1, CELL_DIGITS), 16, 10).cast("int")
        inside = Window.partitionBy("cell").orderBy("key")
        summed = groups.withColumn("cell", cell).repartitionByRange(partitions(spark), "cell").withColumn("reach", F.sum("bytes").over(inside))
        self.spark, self.table = spark, staged(summed.select("cell", "key", "reach", "bytes"), "groups")
        cells = self.table.groupBy("cell").agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
        self.cells = [r.cell for r in cells]
        self.base = [0, *accumulate(r.s for r in cells)]
        self.total, self.largest = self.base[-1], max((r.m for r in cells), default=0)
        self.known, self.solid = list(self.base), [r.n == 1 for r in cells]

    def sure(self, x: int) -> int:
        """The largest known running sum up to x."""
        return self.known[bisect_right(self.known, x) - 1]

    def hoped(self, x: int) -> int:
        """No running sum up to x is larger."""
        at = bisect_right(self.known, x) - 1
        return self.known[at] if at == len(self.solid) or self.solid[at] else x

    def _ask(self, wanted: list[tuple[int, int, int]], condition: Column, by: list[Column], *answers: Column) -> list:
        """Aggregates over the rows of each wanted (cell index, low, high) that meet the condition."""
        rows = [F.struct(F.lit(j).alias("j"), F.lit(self.cells[c]).alias("cell"), F.lit(x).cast("long").alias("low"), F.lit(y).cast("long").alias("high")) for j, (c, x, y) in enumerate(wanted)]
        targets = self.spark.range(1).select(F.inline(F.array(*rows)))
        near = self.table.where(F.col("cell").isin(sorted({self.cells[c] for c, _, _ in wanted})))
        return near.join(F.broadcast(targets), "cell").where(condition).groupBy("j", *by).agg(*answers).collect()

    def refine(self, gaps: list[int]) -> None:
        """Learn the running sums inside these gaps, evenly where there are too many."""
        parts = max(2, SUMS // len(gaps))
        wanted = []
        for g in gaps:
            c = bisect_right(self.base, self.known[g]) - 1
            wanted.append((c, self.known[g] - self.base[c], self.known[g + 1] - self.base[c]))
        inside = (F.col("reach") > F.col("low")) & (F.col("reach") <= F.col("high"))
        part = F.floor((F.col("reach") - F.col("low") - 1) * parts / (F.col("high") - F.col("low"))).alias("part")
        found = self._ask(wanted, inside, [part], F.min("reach").alias("first"), F.max("reach").alias("last"), F.count(F.lit(1)).alias("n"))
        solid = dict(zip(self.known[1:], self.solid, strict=True))
        for r in found:  # no group ends between a part's first sum and the last one of the part before
            base = self.base[wanted[r.j][0]]
            solid[base + r.last] = r.n == 2
            solid[base + r.first] = True
        self.known = [0, *sorted(solid)]
        self.solid = [solid[x] for x in self.known[1:]]

    def keys(self, sums: list[int]) -> list[str]:
        """The last key of each running sum."""
        at = [bisect_left(self.base, x) - 1 for x in sums]
        wanted = [(c, 0, x - self.base[c]) for c, x in zip(at, sums, strict=True)]
        found = {r.j: r.key for r in self._ask(wanted, F.col("reach") == F.col("high"), [], F.max("key").alias("key"))}
        return [found[j] for j in range(len(sums))]


def _greedy(reach: Callable[[int], int], capacity: int, shards: int) -> list[int]:
    at, out = 0, []
    for _ in range(shards):
        at = reach(at + capacity)
        out.append(at)
    return out


def _search(reach: Callable[[int], int], low: int, high: int, total: int, shards: int) -> int:
    """The least capacity from low to high at which greedy filling reaches the end; high does."""
    while low < high:
        middle = (low + high) // 2
        if _greedy(reach, middle, shards)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def smallest_capacity(sums: _Sums, shards: int) -> int:
    """The least capacity at which greedy filling needs no more than the shards.

    Binary search over what is known gives a capacity that surely fits and one under which nothing
    can; while they differ, the running sums between their cuts are looked up more finely.
    """
    low, high = max(-(-sums.total // shards), sums.largest), sums.total
    while True:
        high = _search(sums.sure, low, high, sums.total, shards)
        low = _search(sums.hoped, low, high, sums.total, shards)
        if low == high:
            return low
        gaps: set[int] = set()
        for near, far in zip(_greedy(sums.sure, low, shards), _greedy(sums.hoped, high, shards), strict=True):
            first, last = bisect_right(sums.known, near) - 1, bisect_left(sums.known, far)
            gaps.update(g for g in range(first, min(last, len(sums.solid))) if not sums.solid[g])
        sums.refine(sorted(gaps))


def cuts(sums: _Sums, shards: int) -> list[int]:
    """Running sums at which the shards end: none over the smallest capacity, else near equal."""
    capacity = smallest_capacity(sums, shards)
    latest = [sums.total]  # from the end: the first cut after which the rest still fits
    for _ in range(shards - 1):
        latest.append(sums.known[bisect_left(sums.known, max(0, latest[-1] - capacity))])
    at, out = 0, []
    for k in range(shards):
        even = sums.sure(at + -(-(sums.total - at) // (shards - k)))
        if even == at < sums.total:
            even = sums.known[bisect_right(sums.known, at)]
        at = min(max(even, latest[shards - 1 - k]), sums.sure(at + capacity))
        out.append(at)
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        )
    )
    sums = _Sums(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    ends = sorted({x for x in cuts(sums, shards) if x < sums.total}) if sums.total else []
    number = F.lit(0)
    for key in sums.keys(ends) if ends else []:
        number = number + (F.col("key") > key).cast("int")
    placed = rows.withColumn("shard", number.cast("int")).withColumn("bin", F.pmod(F.xxhash64("doc_id", "key"), F.lit(BINS)).cast("int"))
    counts = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin")
    starts = counts.select("shard", "bin", (F.sum("n").over(before) - F.col("n")).alias("first"))  # at most shards x BINS rows
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "key")
    return (
        placed.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "bin"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

