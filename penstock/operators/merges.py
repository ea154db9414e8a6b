"""Names that mean the same: an exact cosine join of vectors by pivots and bounded blocks, and the clusters it links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, cut_lineage

#: Vectors that choose the cells, drawn by hash; and vectors of a block of either side.
PIVOTS, BLOCK = 128, 2_048
SLACK = 1e-7  # radians, for rounding


def trigram_vector(name: Column, size: int = 64) -> Column:
    """Counts of a name's letter trigrams (with a blank at both ends) in `size` buckets, by their code points."""
    t = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    code = lambda i: F.ascii(F.substring(t, i, F.lit(1)))
    places = F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1)))
    buckets = F.transform(places, lambda i: F.pmod(code(i) * 961 + code(i + 1) * 31 + code(i + 2), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.size(F.filter(buckets, lambda x: x == b)).cast("double"))


def _matrix(column: pa.Array):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _angle(cos):
    import numpy as np

    return np.arccos(np.clip(cos, -1.0, 1.0))


def _placed(u: DataFrame, pivots, theta: float | None, radii: dict | None) -> DataFrame:
    """Without radii: the cell of each vector's nearest pivot and its angle to it. With radii, {unit: [(cell, radius)]}: the later cells that may hold a vector within theta."""
    import numpy as np

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angle(_matrix(batch.column("e")) @ pivots.T)
            own = angle.argmin(axis=1)
            if radii is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(angle[np.arange(len(own)), own])], names=[*batch.schema.names, "cell", "angle"])
                continue
            reach = np.zeros(angle.shape, bool)
            units = batch.column("unit").to_pylist()
            for unit in set(units):
                cells = np.array([c for c, _ in radii.get(unit, [])], int)
                radius = np.array([r for _, r in radii.get(unit, [])])
                rows = np.flatnonzero([x == unit for x in units])
                reach[np.ix_(rows, cells)] = angle[np.ix_(rows, cells)] <= theta + radius + SLACK
            reach &= np.arange(len(pivots))[None, :] >= own[:, None]
            row, cell = np.nonzero(reach)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "visits"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in u.schema.fields)
    return u.mapInArrow(part, fields + (", cell int, angle double" if radii is None else ", visits int"))


def _linked(hit) -> list[tuple[int, int]]:
    """Edges that connect what a boolean matrix (rows x columns) connects; columns are numbered after the rows. As many as rows and columns at most."""
    import numpy as np

    n, m = hit.shape
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    sub = hit[np.ix_(rows, cols)]
    label = np.arange(len(rows))
    while True:
        by_col = np.where(sub, label[:, None], n).min(axis=0, initial=n)
        new = np.where(sub, by_col[None, :], n).min(axis=1, initial=n)
        if (new == label).all():
            break
        label = new
    out = [(int(rows[a]), int(rows[r])) for r, a in enumerate(label.tolist()) if a != r]
    return out + [(int(rows[a]), n + int(c)) for c, a in zip(cols.tolist(), by_col.tolist(), strict=True)]


def cosine_links(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vectors: id, unit, e (normalised). (a, b): edges that connect whatever pairs of a unit with a cosine of the threshold or more connect; no pair is lost and pairs are not listed.

    Vectors lie in the cells of their nearest pivots. By the triangle inequality of angles one needs to visit only cells whose pivot is no further than the threshold's angle and the cell's radius. A cell and its visitors meet in blocks of both sides, whatever the size of either."""
    import numpy as np

    theta = math.acos(max(-1.0, min(1.0, threshold)))
    some = vectors.select("e", F.xxhash64("e").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(pivots).collect()  # bounded
    if not some:
        return vectors.sparkSession.createDataFrame([], "a bigint, b bigint")
    centres = np.array([r.e for r in some], np.float64)
    placed = cut_lineage(_placed(vectors.select("id", "unit", "e"), centres, None, None))
    cells = cut_lineage(placed.groupBy("unit", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")))
    radii: dict = {}
    for r in cells.select("unit", "cell", "radius").collect():  # pivots times units: a unit is one of a fixed list
        radii.setdefault(r.unit, []).append((r.cell, r.radius))
    visits = cut_lineage(_placed(placed.select("id", "unit", "e"), centres, theta, radii))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    counts = visits.groupBy("unit", "visits").agg(F.count("*").alias("v")).join(cells.select("unit", F.col("cell").alias("visits"), "n"), ["unit", "visits"])
    shape = counts.select("unit", F.col("visits").alias("cell"), parts("n").alias("homes"), parts("v").alias("guests"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shape = F.broadcast(shape)  # a row for each pivot and unit
    home = placed.select("id", "unit", "e", "cell").join(shape, ["unit", "cell"]).withColumn("home", F.pmod(F.xxhash64("id"), F.col("homes")).cast("int")).withColumn("guest", every("guests"))
    guest = visits.withColumnRenamed("visits", "cell").join(shape, ["unit", "cell"]).withColumn("guest", F.pmod(F.xxhash64("id", F.lit(1)), F.col("guests")).cast("int")).withColumn("home", every("homes"))
    cols = ["unit", "cell", "home", "guest", "kind", "id", "e"]
    met = home.withColumn("kind", F.lit(0)).select(*cols).unionByName(guest.withColumn("kind", F.lit(1)).select(*cols))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []
        at = np.zeros((0, 1))

        def links(them, e) -> Iterator[pa.RecordBatch]:
            if len(at) and len(e):
                hit = at @ e.T >= threshold - 1e-12
                both = [*ids, *them]
                edges = [(both[a], both[b]) for a, b in _linked(hit) if both[a] != both[b]]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            kinds, them, e = batch.column("kind").to_pylist(), batch.column("id").to_pylist(), _matrix(batch.column("e"))
            a = 0
            for b in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]] + [len(keys)]:
                if a == b:
                    continue
                if keys[a] != key:
                    key, ids, rows = keys[a], [], []
                    at = np.zeros((0, e.shape[1]))
                if kinds[a] == 0:
                    ids += them[a:b]
                    rows.append(e[a:b])
                    at = np.concatenate(rows)
                else:
                    yield from links(them[a:b], e[a:b])
                a = b

    order = ["unit", "cell", "home", "guest"]
    return cut_lineage(met.repartition(*order).sortWithinPartitions(*order, "kind").select(*cols).mapInArrow(part, "a bigint, b bigint").distinct())


def name_merges(names: DataFrame, threshold: float = 0.92, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """names: id, unit, name, n, embedding. Clusters of two or more names of a unit that chains of vectors with a cosine of the threshold or more connect, with the canonical name (most rows, shortest, first). A vector of zeros, or none, is like nothing; a null unit is the empty one."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    named = names.withColumn("unit", F.coalesce("unit", F.lit("")))
    u = cut_lineage(named.withColumn("e", F.when(norm > 0, F.transform(v, lambda x: x / norm))).where("e is not null").select("id", "unit", "e"))
    first = u.groupBy("unit", "e").agg(F.min("id").alias("a"))  # equal vectors are one
    same = u.join(first, ["unit", "e"]).where("id <> a").select("a", F.col("id").alias("b"))
    edges = cosine_links(first.withColumnRenamed("a", "id"), threshold, pivots, block).unionByName(same)
    roots = components(named.select(F.col("id").alias("node")), edges)
    c = cut_lineage(named.join(roots, F.col("id") == F.col("node")).select("root", "id", "name", "n"))
    best = c.groupBy("root").agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), F.col("name"))).alias("canonical"), F.count("*").alias("members"))
    return c.join(best.where("members > 1"), "root").select("id", "name", "canonical", "root")
