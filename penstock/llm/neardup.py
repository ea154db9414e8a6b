"""Near-duplicate groups by an LSH forest of MinHash signatures, with every link confirmed on full shingle sets.

1. Each text becomes its set of k-word shingles, an exact fingerprint of the set and a signature of TREES * DEPTH minima.
   Texts with equal sets are one node from here on, so copies cost nothing further.
2. Each tree sorts all nodes by its own DEPTH minima. Nodes with a common prefix of LEAST_DEPTH (a region) are candidates;
   a sketch of the signature drops those far below the threshold. What is left joins nodes into families (connected
   components). A crowded region is first thinned by leaders and split at longer prefixes; then the nodes of crowded regions,
   and of those cut by a partition, meet block against block as far as they are still in different components.
3. The full sets of a family meet in one task and are searched breadth first: intersections are counted exactly, and every
   node reached is linked. A family with more shingles than a task may hold is dealt into several bounded pieces, in several
   orders, each with the family's most central nodes, and the pieces' results are joined by a second component search. Where
   that leaves the family in several components, their nodes meet block against block, so no link between them is missed.

Defined results: a null or wordless text has no shingles and is linked with nothing; a text with fewer than k words is one
shingle, its whole sequence; equal sets are linked whatever their texts; rows that share an id are nodes of their own, and
the least id of a component names it (null only if all are null); a very long text is one set, read whole; an empty table
gives an empty result; other columns are ignored, or kept by `distinct_texts`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slices, thrifty, written
from .graph import components
from .textkit import mix, shingles, word_hashes

TREES, DEPTH, LEAST_DEPTH = 10, 8, 2
_K = TREES * DEPTH
#: Regions up to so many nodes are compared in full at once; larger ones first give up the nodes close to their leaders.
CROWD, LEADERS = 64, 8
#: Rows of a region that a task holds at once, and of a block of a crowded one.
REGION, REGION_BLOCK = 20_000, 4_000
#: Shingles of a family, or of a piece of one, that a task holds at once; copies of central nodes; orders of dealing.
BLOCK_SHINGLES, HUBS, ORDERS = 4_000_000, 32, 3
#: Sets that a task holds at once.
BLOCK_SETS = 10_000
#: Family members and rows that go, up to this number, are broadcast to the texts (a few words each), and open regions to the forest; more are joined by shuffling.
BROADCAST_MEMBERS = 500_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, _K, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, _K, dtype=np.uint64).astype(np.uint32)
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """Link two texts if 100 * |intersection| >= percent * |union| of their sets of k-word shingles."""

    words: int
    percent: int

    @property
    def sketch_matches(self) -> float:
        """Matching minima of the sketch below which a pair is dropped: four deviations under the threshold."""
        t = self.percent / 100
        return _K * max(0.2, t - 4 * (t * (1 - t) / _K) ** 0.5)


def signature(s: np.ndarray) -> np.ndarray:
    """_K minima of a non-empty set of 64-bit hashes."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 2048):
        x = np.multiply.outer(_A, h[k : k + 2048])
        x += _B[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    b = np.add.reduce(mix(s + np.uint64(0x9E3779B97F4A7C15)))
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """id, n_shingles, f1, f2, sig, t1, t2 of every row; t1 and t2 tell texts apart."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, 1):
                _, _, _, first, h = word_hashes(s.column(1))
                sets = shingles(h, first, rule.words)
                marks = [fingerprint(x) if len(x) else (0, 0) for x in sets]
                sigs = [signature(x).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(sigs, pa.binary()), s.column(2), s.column(3)], names=["id", "n_shingles", "f1", "f2", "sig", "t1", "t2"]
                )

    return docs.select("id", "text", "t1", "t2").mapInArrow(thrifty(part), "id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig binary, t1 bigint, t2 bigint")


def _text_marks(text: str) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def _forest(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: tree, key, node, sketch."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, _K)
            sketch = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
            for t in range(TREES):
                keys = np.ascontiguousarray(sig[:, t * DEPTH : (t + 1) * DEPTH]).astype(">u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), batch.column(0), sketch], names=["tree", "key", "node", "sketch"])

    return nodes.select("node", "sig").mapInArrow(thrifty(part), "tree int, key binary, node bigint, sketch binary")


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def _region(keys: np.ndarray, sketch: np.ndarray, depth: int, least: float, u: _Union, at: np.ndarray) -> None:
    """Joins the candidates among rows `at` (sorted, with a common prefix of `depth`)."""
    if len(at) <= CROWD:
        s = sketch[at]
        same = (s[:, None, :] == s[None, :, :]).sum(axis=2) >= least if len(at) > 2 else np.array([[True, (s[0] == s[-1]).sum() >= least]])
        for i, j in zip(*np.nonzero(same), strict=True):
            if i < j:
                u.join(int(at[i]), int(at[j]))
        return
    near = (sketch[at[1:]] == sketch[at[:-1]]).sum(axis=1) >= least  # neighbours have the longest common prefixes
    for i in np.flatnonzero(near).tolist():
        u.join(int(at[i]), int(at[i + 1]))
    for _ in range(LEADERS if depth < DEPTH else len(at)):
        if not len(at):
            return
        close = (sketch[at] == sketch[at[0]]).sum(axis=1) >= least
        close[0] = True
        for i in at[close].tolist():
            u.join(int(at[0]), i)
        at = at[~close]
    if len(at) > 1 and depth < DEPTH:
        cuts = np.flatnonzero(keys[at[1:], depth] != keys[at[:-1], depth]) + 1
        for part in np.split(at, cuts):
            if len(part) > 1:
                _region(keys, sketch, depth + 1, least, u, part)


def _candidates(forest: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): each node with the first node of its candidates, region by region. Without a and b: tree and prefix of regions that were crowded or may go on in another partition."""
    least = rule.sketch_matches

    def regions(tree: np.ndarray, keys: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(tree), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (keys[1:, :LEAST_DEPTH] != keys[:-1, :LEAST_DEPTH]).any(axis=1)
        starts = np.append(np.flatnonzero(new), len(tree))
        u, touched = _Union(len(tree)), []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 1:
                _region(keys, sketch, LEAST_DEPTH, least, u, np.arange(a, b))
                touched.extend(range(a, b))
        pairs = [(i, r) for i in touched if (r := u.find(i)) != i]
        if pairs:
            i, r = np.array(pairs).T
            yield rows_of(a=pa.array(node[i]), b=pa.array(node[r]), tree=pa.nulls(len(i), pa.int32()), prefix=pa.nulls(len(i), pa.binary()))
        crowded = starts[:-1][np.diff(starts) > CROWD]
        if len(crowded):
            yield opened(tree[crowded], keys[crowded])

    def rows_of(**columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def opened(tree: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(tree), pa.int64())
        prefix = [x.tobytes() for x in np.ascontiguousarray(keys[:, :LEAST_DEPTH]).astype(">u4")]
        return rows_of(a=none, b=none, tree=pa.array(tree, pa.int32()), prefix=pa.array(prefix, pa.binary()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield from regions(*(np.concatenate(x) for x in zip(*rows, strict=True)))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree = batch.column(0).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, DEPTH).astype(np.uint32)
            sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, _K)
            held.append((tree, keys, batch.column(2).to_numpy(), sketch))
            if last is None:
                yield opened(tree[:1], keys[:1])
            last = tree[-1:], keys[-1:]
            same = (tree == tree[-1]) & (keys[:, :LEAST_DEPTH] == keys[-1, :LEAST_DEPTH]).all(axis=1)
            tail = int(np.argmax(same))  # the last region may go on in the next batch
            if tail or sum(len(x[0]) for x in held) >= REGION:
                rest = tuple(x[tail:] for x in held[-1]) if tail else None
                if tail:
                    held[-1] = tuple(x[:tail] for x in held[-1])
                yield from flush(held)
                held = [rest] if rest else []
        yield from flush(held)
        if last is not None:
            yield opened(*last)

    dealt = forest.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return dealt.mapInArrow(thrifty(part), "a bigint, b bigint, tree int, prefix binary")


def _met(rows: DataFrame, least: float) -> DataFrame:
    """rows: tree, prefix, block, main, root, sketch. (a, b): roots with candidates among each other in a block; main rows are compared with the others alone."""

    def block(table: pa.Table) -> pa.Table:
        main = table.column("main").to_numpy()
        order = np.argsort(main, kind="stable")
        names, root = np.unique(table.column("root").to_numpy()[order], return_inverse=True)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, _K)[order]
        u = _Union(len(names))
        for i in range(int((~main).sum())):
            near = (sketch[i + 1 :] == sketch[i]).sum(axis=1, dtype=np.uint8) >= least
            for r in np.unique(root[i + 1 :][near]).tolist():
                u.join(int(root[i]), r)
        pairs = np.array([(i, r) for i in range(len(names)) if (r := u.find(i)) != i], np.int64).reshape(-1, 2)
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    return rows.groupBy("tree", "prefix", "block").applyInArrow(block, "a bigint, b bigint")


def _families(nodes: DataFrame, rule: Rule, region_block: int = REGION_BLOCK) -> DataFrame:
    """(node, root) under all candidates: every two nodes of a region whose sketches agree enough are in one family."""
    found = written(_candidates(_forest(nodes), rule), "candidates")
    near = written(components(found.where("a is not null").select("a", "b")), "families")
    regions = written(found.where("a is null").select("tree", "prefix").distinct(), "regions")
    small = regions.count() <= BROADCAST_MEMBERS  # else the forest is shuffled once more
    forest = _forest(nodes).withColumn("prefix", F.substring("key", 1, 4 * LEAST_DEPTH))
    rows = written(forest.join(F.broadcast(regions) if small else regions, ["tree", "prefix"]).select("tree", "prefix", "node", "sketch"), "region-rows").join(near, "node", "left")
    rows = written(rows.select("tree", "prefix", "node", "sketch", F.coalesce("root", "node").alias("root"), F.lit(1).alias("w")), "open-regions")
    more = written(_met(_blocks(rows, ["tree", "prefix"], region_block), rule.sketch_matches), "late-candidates")
    if not more.head(1):
        return near
    return components(near.selectExpr("node as a", "root as b").unionByName(more))


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the index of the first set of its component under exact links, searched breadth first, so that what is connected already isn't compared again."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1  # a shingle of one text alone is in no intersection
    shared = counts[inverse] > 1
    rows, cols = owner[shared], column[inverse[shared]]
    width = int((counts > 1).sum())
    if m * width <= 40_000_000:
        matrix = np.zeros((m, width), np.float32)
        matrix[rows, cols] = 1

        def common(x: int, with_: np.ndarray) -> np.ndarray:
            return np.rint(matrix[with_] @ matrix[x]).astype(np.int64)
    else:
        first = np.searchsorted(rows, np.arange(m + 1))
        mark = np.zeros(width, bool)

        def common(x: int, with_: np.ndarray) -> np.ndarray:
            mine = cols[first[x] : first[x + 1]]
            mark[mine] = True
            n = np.concatenate([[0], np.cumsum(mark[cols])])
            mark[mine] = False
            return n[first[with_ + 1]] - n[first[with_]]

    root, left = list(range(m)), np.arange(m)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        start = queue[0]
        while queue and len(left):
            x = queue.pop()
            able = 100 * np.minimum(size[left], size[x]) >= percent * np.maximum(size[left], size[x])
            near = left[able]
            if not len(near):
                continue
            both = common(x, near)
            hit = near[100 * both >= percent * (size[near] + size[x] - both)]
            for i in hit.tolist():
                root[i] = start
            queue.extend(hit.tolist())
            left = left[~np.isin(left, hit)]
    return root


def _confirmed(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """members: node, id, t1, t2, f1, f2, family, piece. (a, b): each node with the first node that full sets link it to in its piece. A text is found by id and marks, since ids may be shared or missing."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                root = linked([sets[n] for n in nodes], rule.percent)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[i] for i in root], pa.int64())], names=["a", "b"])

        def once(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Without the repeats of a row, which follow each other."""
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
                new[1:] = (x[:, 1:] != x[:, :-1]).any(axis=0)
            return batch if new.all() else batch.filter(pa.array(new))

        for batch in batches:
            for s in slices(once(batch), 5):
                _, _, _, first, h = word_hashes(s.column(5))
                found = shingles(h, first, rule.words)
                for family, piece, node, f1, f2, x in zip(*(s.column(i).to_pylist() for i in range(5)), found, strict=True):
                    if (family, piece) != key:
                        yield from flush()
                        key, nodes, sets = (family, piece), [], {}
                    if node not in sets and len(x) and fingerprint(x) == (f1, f2):  # marks may agree by chance
                        nodes.append(node)
                        sets[node] = x
        yield from flush()

    rows = _texts_of(docs, members)
    dealt = rows.select("family", "piece", "node", "f1", "f2", "text").repartition("family", "piece").sortWithinPartitions("family", "piece", "node")
    return dealt.mapInArrow(thrifty(part), "a bigint, b bigint")


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members with their whole texts: a row for each row that a member stands for."""
    small = members.count() <= BROADCAST_MEMBERS
    return docs.join(F.broadcast(members) if small else members, ["id", "t1", "t2"])


def _load(n: str, limit: int):
    """What a set of n shingles costs its task: many small sets cost by their number, for each is compared with the others."""
    return F.greatest(F.col(n), F.lit(limit // BLOCK_SETS))


def _dealt(members: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """members with their piece, and whether any family had to be cut. Families beyond the limit are dealt ORDERS times: by one minimum, which near texts mostly share, and where that leaves too much together, by hash; their most central nodes go to every piece."""
    total = members.groupBy("family").agg(F.sum(_load("n", limit)).alias("t"))
    large = written(total.where(F.col("t") > limit), "large-families")
    if not large.head(1):
        return members.withColumn("piece", F.lit(0)), False
    small = members.join(large, "family", "left_anti").withColumn("piece", F.lit(0))
    big = members.join(large, "family")
    word = lambda k: F.substring("sig", F.lit(4 * k + 1), F.lit(4))
    parts = (F.ceil(F.lit(2.0) * F.col("t") / limit)).cast("long")
    runs = None
    for k in range(ORDERS):
        x = big.withColumn("coarse", F.xxhash64(word(k * DEPTH))).withColumn("order", F.lit(k))
        runs = x if runs is None else runs.unionByName(x)
    load = runs.groupBy("family", "order", "coarse").agg(F.sum(_load("n", limit)).alias("load"))
    runs = runs.join(load, ["family", "order", "coarse"])
    fine = F.when(F.col("load") > limit / 2, F.pmod(F.xxhash64("node", "order"), parts)).otherwise(F.pmod("coarse", parts))
    runs = runs.withColumn("piece", (F.col("order") * parts + fine).cast("int"))
    # Central: agreement with the most frequent value of each place of the signature, counted for the large families alone.
    places = big.select("family", F.explode(F.sequence(F.lit(0), F.lit(_K - 1))).alias("k"), "sig").select("family", "k", F.substring("sig", F.col("k") * 4 + 1, F.lit(4)).alias("v"))
    modes = places.groupBy("family", "k", "v").count().groupBy("family", "k").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    consensus = modes.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("c"))  # _K entries
    agree = F.aggregate(F.transform("c", lambda x: (F.substring("sig", x["k"] * 4 + 1, F.lit(4)) == x["v"]).cast("int")), F.lit(0), lambda a, x: a + x)
    ranked = big.join(consensus, "family").select("family", "node", agree.alias("agree"))
    hubs = _top(ranked).join(members, ["family", "node"]).join(large, "family").select(*members.columns, F.explode(F.sequence(F.lit(0), (ORDERS * parts - 1).cast("int"))).alias("piece"))
    cols = [*members.columns, "piece"]
    return small.select(*cols).unionByName(runs.select(*cols)).unionByName(hubs.select(*cols)).dropDuplicates(["node", "piece"]), True


def _top(ranked: DataFrame) -> DataFrame:
    """The HUBS nodes of each family that agree most: first of each of 64 salted parts, then of their winners."""
    first = Window.partitionBy("family", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy(F.desc("agree"), "node")
    some = ranked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= HUBS).drop("r")
    return some.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("agree"), "node"))).where(F.col("r") <= HUBS).select("family", "node")


def _blocks(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    """rows: group, node, root, w and others. Adds `main` and `block` and repeats rows so that any two of a group with different roots share a block of about `limit` by w. Rows of a group's largest root (main) needn't meet each other; groups with one root are left out."""
    sizes = rows.groupBy(*group, "root").agg(F.sum("w").alias("w"), F.count("*").alias("k"))
    shape = sizes.groupBy(*group).agg(F.max_by("root", F.struct("w", "root")).alias("top"), F.max("w").alias("most"), F.sum("w").alias("all"), F.sum("k").alias("k"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda w: F.least(F.ceil(F.lit(2.0) * w / limit).cast("long"), F.col("k"))
    shape = shape.select(*group, "top", parts(F.col("most")).alias("mains"), parts(F.col("all") - F.col("most")).alias("rests"))
    x = rows.join(shape, group).withColumn("main", F.col("root") == F.col("top"))
    x = x.withColumn("own", F.when(F.col("main"), F.col("rests") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rests"))))
    last = F.when(F.col("main"), F.col("rests") - 1).otherwise(F.col("rests") + F.col("mains") - 1)
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).where("own <> other")
    return x.withColumn("block", F.least("own", "other") * (F.col("rests") + F.col("mains")) + F.greatest("own", "other")).select(*rows.columns, "main", "block")


def _completed(docs: DataFrame, members: DataFrame, found: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """found, with the links that the dealings missed: where a cut family is still in several components, every two nodes of different components meet on full sets."""
    near = components(found).withColumnRenamed("root", "linked_to")
    cut = members.groupBy("family").agg(F.max("piece").alias("most")).where("most > 0").select("family")
    rows = members.join(cut, "family", "left_semi").select("node", "id", "t1", "t2", "f1", "f2", "n", "family").dropDuplicates(["node"]).join(near, "node", "left")
    rows = written(rows.select("node", "id", "t1", "t2", "f1", "f2", _load("n", limit).alias("w"), "family", F.coalesce("linked_to", "node").alias("root")), "cut-families")
    met = _blocks(rows, ["family"], limit).select("node", "id", "t1", "t2", "f1", "f2", "family", F.col("block").alias("piece"))
    return found.unionByName(written(_confirmed(docs, met, rule), "late-links"))


def groups(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, root, equal for the rows of a component (null: no shingles), and the marks t1 and t2 of its text."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text")).select("*", *_text_marks("text"))
    rows = written(_sets(plain, rule), "shingle-sets")
    nodes = rows.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min(F.struct("id", "t1", "t2")).alias("one"), F.min(F.when(F.col("id") != _NO_ID, F.col("id"))).alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes.select("f1", "f2", "one.*", "least", "n", "sig", F.monotonically_increasing_id().alias("node")), "nodes")
    families = _families(nodes, rule).withColumnRenamed("root", "family")
    members, cut = _dealt(nodes.select("node", "id", "t1", "t2", "f1", "f2", "n", "sig").join(families, "node"), block_shingles)
    found = written(_confirmed(plain, members.select("node", "id", "t1", "t2", "f1", "f2", "family", "piece"), rule), "links")
    if cut:
        found = _completed(plain, members, found, rule, block_shingles)
    roots = components(found) if cut else found.selectExpr("a as node", "b as root")
    named = nodes.select("node", "f1", "f2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "roots")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("f1", "f2", "root", "component_id")
    own = F.when(F.col("id") != _NO_ID, F.col("id"))
    out = rows.select(own.alias("doc_id"), "n_shingles", "f1", "f2", "t1", "t2").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root", "t1", "t2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: near-duplicate components of all documents."""
    out = groups(documents(spark, sf_dir), Rule(3, 85))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def distinct_texts(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """docs without the near copies: of each component one row stays, with the least id (null last), then the least mark of its text. Of rows that agree in id and text any one stays. Rows without words all stay. Ids needn't be unique: rows are told apart by id and text."""
    plain = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))).select("*", *[m.alias(f"_{m_}") for m, m_ in zip(_text_marks("text"), ("t1", "t2"), strict=True)])
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    rows = groups(docs, rule).where("root is not null").withColumn("key", key)
    counts = written(rows.groupBy("root", "key").agg(F.count("*").alias("n")), "texts")
    least = counts.groupBy("root").agg(F.min("key").alias("least"))
    again = F.col("key") == F.col("least")
    verdict = counts.join(least, "root").where(~again | (F.col("n") > 1)).select(F.coalesce(F.col("key.doc_id"), F.lit(_NO_ID)).alias("_id"), F.col("key.t1").alias("_t1"), F.col("key.t2").alias("_t2"), again.alias("_again"))
    keys = ["_id", "_t1", "_t2"]
    copies = written(verdict, "copies")
    small = copies.count() <= BROADCAST_MEMBERS  # else whole texts are shuffled once
    whole = plain.join(F.broadcast(copies) if small else copies, keys, "left")
    once = whole.where("_again").dropDuplicates(keys)  # a row for each repeated row that stays
    return whole.where("_again is null").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
