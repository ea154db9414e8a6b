"""Links between 64-bit values that differ in a few bits: exact, by blocks of equal bits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage

WIDTH, ALL = 64, (1 << 64) - 1
#: Values of a block that meet each other without further blocks; of a block that a task takes; pairs kept at once.
PLAIN, TASK, PAIRS = 512, 400_000, 2_000_000


def bands(fixed: int, distance: int) -> list[int]:
    """The bits outside `fixed`, in distance + 1 masks: values that differ in no more bits agree in one of them."""
    free = [i for i in range(WIDTH) if not fixed >> i & 1]
    k = distance + 1
    return [sum(1 << i for i in free[len(free) * j // k : len(free) * (j + 1) // k]) for j in range(k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Trees:
    """values: distinct. root: the least index that each is linked with, through values within the distance."""

    def __init__(self, values, distance: int) -> None:
        import numpy as np

        self.values, self.distance, self.root = values, distance, np.arange(len(values))
        self.kept, self.n = [], 0

    def settle(self, at, block, fixed: int) -> None:
        """at: indices, block: their blocks' numbers, ascending; those of a block agree in the bits of `fixed`. A block of more than PLAIN values is cut by each of its bands, all blocks of a level together, if that leaves less than half of its pairs to compare; others meet themselves."""
        import numpy as np

        sizes = np.diff(np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]))
        alike = WIDTH - fixed.bit_count() <= self.distance  # no more bits are left than may differ
        large = (sizes > PLAIN) & (not alike)
        finer, own = [], np.flatnonzero(np.repeat(large, sizes))
        if large.any():
            number = np.repeat(np.arange(len(sizes)), sizes)[own]
            left = np.zeros(len(sizes))
            for band in bands(fixed, self.distance):
                order = np.lexsort((self.values[at[own]] & np.uint64(band), number))
                n, k = number[order], (self.values[at[own]] & np.uint64(band))[order]
                starts = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (k[1:] != k[:-1])])
                left += np.bincount(n[starts], np.diff(np.r_[starts, len(n)]).astype(float) ** 2, len(sizes))
                finer.append((band, own[order], starts))
            large &= left < 0.5 * sizes.astype(float) ** 2
        plain = ~np.repeat(large, sizes)
        self._meet(at[plain], sizes[~large], alike)
        if not large.any():
            return
        cut = ~plain
        for band, rows, starts in finer:
            new = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
            kept = cut[rows]
            self.settle(at[rows[kept]], new[kept], fixed | band)

    def _meet(self, at, sizes, alike: bool) -> None:
        """Neighbours of a block at growing steps, the largest blocks first, so that a step takes those that are long enough."""
        import numpy as np

        if not len(sizes) or sizes.max() < 2:
            return
        block = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.empty(len(sizes), np.int64)
        by = np.argsort(-sizes, kind="stable")
        rank[by] = np.arange(len(sizes))
        block = rank[block]
        order = np.argsort(block, kind="stable")
        at, block, ends = at[order], block[order], np.cumsum(sizes[by])
        v, falling = self.values[at], sizes[by]
        for step in range(1, 2 if alike else int(falling[0])):
            end = ends[np.searchsorted(-falling, -step, "left") - 1]
            same = block[step:end] == block[: end - step]
            x = np.flatnonzero(same if alike else same & (np.bitwise_count(v[step:end] ^ v[: end - step]) <= self.distance))
            a, b = at[x], at[x + step]
            apart = self.root[a] != self.root[b]
            self.kept.append((a[apart], b[apart]))
            self.n += int(apart.sum())
            if self.n > PAIRS:
                self.join()

    def join(self) -> None:
        """Joins the trees of the pairs that were kept; each is named by its least member."""
        import numpy as np

        if not self.n:
            return
        a, b = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        self.kept, self.n, root = [], 0, self.root
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low < high
            if not apart.any():
                self.root = root
                return
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while not np.array_equal(up := root[root], root):
                root = up


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one mask in turn, whole blocks, about TASK at a time; batches come sorted by mask, key and part."""
    import numpy as np

    held, n = [], 0
    for batch in batches:
        mask, key, part = (batch[c].to_numpy(zero_copy_only=False) for c in ("mask", "key", "part"))
        starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]).tolist() if len(mask) else []
        for a, b in zip(starts, [*starts[1:], len(mask)], strict=True):
            at = (int(mask[a]), int(key[a]), int(part[a]))
            if held and held[-1][0] != at and (n > TASK or held[-1][0][0] != at[0]):
                yield held[-1][0][0], pa.concat_tables([pa.table({"key": x["key"], "part": x["part"], "v": x["v"]}) for _, x in held])
                held, n = [], 0
            held.append((at, batch.slice(a, b - a)))
            n += b - a
    if held:
        yield held[-1][0][0], pa.concat_tables([pa.table({"key": x["key"], "part": x["part"], "v": x["v"]}) for _, x in held])


def _linked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each value with the least one of its tree."""
        import numpy as np

        for mask, rows in _blocks(batches):
            key, part, v = (rows[c].to_numpy() for c in ("key", "part", "v"))
            order = np.argsort(v, kind="stable")
            key, part, v = key[order], part[order], v[order]
            trees = _Trees(v.view(np.uint64), distance)
            by = np.lexsort((part, key))
            new = (key[by][1:] != key[by][:-1]) | (part[by][1:] != part[by][:-1])
            trees.settle(by, np.cumsum(np.r_[False, new]), mask & ALL)
            trees.join()
            own = np.flatnonzero(trees.root != np.arange(len(v)))
            yield pa.record_batch({"a": v[trees.root[own]], "b": v[own]})

    return run


def links(values: DataFrame, distance: int, task: int = TASK) -> DataFrame:
    """values: v (bigint), distinct. (a, b): links that connect all values that differ in `distance` bits at most, directly or by chains of such values; as many as values and blocks, not pairs.

    Values are dealt into blocks by each of distance + 1 bands of bits; a task cuts its blocks further in the same way. A block too full for a task is dealt in parts, each of which meets every other."""
    rows = values.select("v", F.explode(F.array(*[F.lit(_signed(m)) for m in bands(0, distance)])).alias("mask")).withColumn("key", F.col("v").bitwiseAND(F.col("mask")))
    full = cut_lineage(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > task).select("mask", "key", F.ceil(F.col("n") / task).alias("parts")))
    fit = rows.withColumn("part", F.lit(-1).cast("bigint"))
    if full.head(1):
        fit = fit.join(full, ["mask", "key"], "left_anti")
        own = F.pmod(F.xxhash64("v"), F.col("parts"))
        crowded = rows.join(full, ["mask", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        part = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")  # two parts, or one alone, which the pairs take along
        fit = fit.select("mask", "key", "part", "v").unionByName(crowded.where("own <> other or parts = 1").select("mask", "key", part.alias("part"), "v"))
    return fit.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part").mapInArrow(_linked(distance), "a bigint, b bigint")
