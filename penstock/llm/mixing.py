"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). The cell weights are raked until the weighted token shares of every
source, language and topic meet their targets; each document is then drawn with a probability proportional to its cell's
weight, scaled so that the largest is one: expected shares then meet the targets, as far as the bound `most` on weights
allows (`shares` tells how far). The draw is a hash of the row, so a rerun draws the same documents.

Topics are spherical k-means over all documents: each pass adds up the vectors of every centre within its tasks and sends
one row for each centre and task. Every group that occurs has a target and cells of its own, however many there are. The
raking itself keeps one factor for each group. Up to CELLS cells it works on the cells as sparse numpy arrays, beyond that
on a written table by grouped sums and joins, with the same result.

Targets are shares by dimension and group. Default targets temper the shares found: share ** temper, renormalised. A group
that occurs but isn't named by given targets has a share of the target for `other`, in proportion to its tokens (none
without such a target).

Defined results: a null dimension is a group of its own; a null or wordless text has no tokens and is drawn like its cell,
or always where its cell has none; a target for a group without tokens is spread over the others; a very long text is
counted whole; rows that agree in id and text are drawn together; an empty table gives an empty result; `sample` keeps other
columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, slices, thrifty, written
from .textkit import word_hashes

TOPICS, _DIM = 8, 64
#: Cells that are raked in numpy and broadcast to the documents; more stay in tables.
CELLS = 200_000
#: No cell's weight exceeds so many times the mean over tokens, so that no source is drained of nearly all its documents.
MOST = 3.0
TEMPER = 0.8
OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a unit vector of square-rooted hashed word counts for each text, words of each text)."""
    _, _, _, first, h = word_hashes(texts)
    n = len(first) - 1
    n_words = np.diff(first)
    x = np.bincount(np.repeat(np.arange(n) * _DIM, n_words) + (h & np.uint64(_DIM - 1)).astype(np.int64), minlength=n * _DIM).reshape(n, _DIM).astype(np.float64)
    x = np.sqrt(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), n_words


def bags(docs: DataFrame) -> DataFrame:
    """u (the row's draw, 0 to 1), source, lang, n_tokens and x, the text's vector (_DIM 32-bit floats), of every row; and doc_id."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, 0):
                x, n = _bags(s.column(0))
                vectors = pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(s.column(i) for i in range(1, 5)), pa.array(n, pa.int64()), vectors], names=["doc_id", "u", "source", "lang", "n_tokens", "x"])

    own = docs.select("text", F.col("doc_id").cast("bigint"), drawn_at().alias("u"), F.col("source").cast("string"), F.col("lang").cast("string"))
    return own.mapInArrow(thrifty(part), "doc_id bigint, u double, source string, lang string, n_tokens bigint, x binary")


def drawn_at(seed: int = 11) -> Column:
    """Where in [0, 1) a row is drawn, by its id and text."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _vectors(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), "<f4").reshape(batch.num_rows, _DIM).astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The topic of each vector. centres: the mean, then a unit vector for each topic."""
    return np.argmax(np.round((x - centres[0]) @ centres[1:].T, 9), axis=1)


def topic_centres(bagged: DataFrame, topics: int = TOPICS, rounds: int = 6) -> np.ndarray:
    """The mean, then the centres, of spherical k-means over all vectors with tokens. bagged: a written table. It starts from fixed random directions; a centre without vectors keeps its direction. Sums are rounded, so that the order in which tasks are added up plays no part."""
    spark = bagged.sparkSession
    some = bagged.where("n_tokens > 0").select("x")

    def sums(centres: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(centres)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = 1 if shared.value is None else topics
            total, n = np.zeros((k, _DIM)), np.zeros(k, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _vectors(batch)
                    of = np.zeros(len(x), np.int64) if shared.value is None else nearest(x, shared.value)
                    y = x if shared.value is None else x - shared.value[0]
                    y = y / (1 if shared.value is None else np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9))
                    np.add.at(total, of, y)
                    n += np.bincount(of, minlength=k)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array([v.tolist() for v in np.rint(total[at] * 2**20).astype(np.int64)], pa.list_(pa.int64()))], names=["k", "n", "s"])

        rows = some.mapInArrow(part, "k int, n bigint, s array<bigint>")
        added = rows.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("s", i + 1)).alias(f"s{i}") for i in range(_DIM)]).collect()  # a row for each centre
        total, n = np.zeros((topics, _DIM)), np.zeros(topics)
        for r in added:
            total[r.k], n[r.k] = np.array(r[2:], np.float64) / 2**20, r.n
        return total, n

    total, n = sums(None)
    c = np.random.default_rng(7).standard_normal((topics, _DIM))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    centres = np.vstack([total[0] / max(n[0], 1), c])
    for _ in range(rounds if n[0] else 0):
        total, n = sums(centres)
        centres[1:][n > 0] = total[n > 0] / np.maximum(np.linalg.norm(total[n > 0], axis=1, keepdims=True), 1e-9)
    return centres


def with_topics(bagged: DataFrame, centres: np.ndarray) -> DataFrame:
    """bagged with the topic in place of the vector."""
    shared = bagged.sparkSession.sparkContext.broadcast(centres)

    def topic(x: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([x], names=["x"])
        return pa.array([f"t{k}" for k in nearest(_vectors(batch), shared.value).tolist()] if len(x) else [], pa.string())

    topic.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return bagged.withColumn("topic", F.arrow_udf(topic, "string")("x")).drop("x")


def _targets(cells: DataFrame, dim: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """g (null-safe group of the dimension), tokens, target; targets of groups with tokens add up to one."""
    found = cells.groupBy(F.col(dim).alias("g")).agg(F.sum("n").alias("tokens")).where("tokens > 0")
    if given is None:
        raw = found.withColumn("t", F.pow(F.col("tokens").cast("double"), F.lit(temper)))
    else:
        named = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items() if k != OTHER] or [], "g string, t double")
        raw = found.join(F.broadcast(named), "g", "left")
        rest = raw.where("t is null").agg(F.sum("tokens")).first()[0] or 0
        raw = raw.withColumn("t", F.coalesce("t", F.lit(float(given.get(OTHER, 0.0))) * F.col("tokens") / F.lit(float(max(rest, 1)))))
    raw = written(raw, "raw-targets")
    total = raw.agg(F.sum("t")).first()[0] or 0.0
    return written(raw.select("g", "tokens", (F.col("t") / total if total else F.lit(0.0)).alias("target")), "targets")


def rake(n: np.ndarray, groups: list[np.ndarray], goals: list[np.ndarray], most: float = MOST, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Weights for cells with n tokens, the i-th in groups[d][i] of dimension d, so that the weighted shares are goals[d]. No weight exceeds `most` times the mean over tokens: where that bound binds, the shares come as near to the goals as it lets them. A weight is the lesser of `most` and the product of its groups' factors."""
    factors = [np.ones(len(g)) for g in goals]
    w, total = np.ones(len(n)), float(n.sum())
    if not total:
        return w
    for _ in range(rounds):
        old = w
        for d, g in enumerate(goals):
            share = np.bincount(groups[d], w * n, len(g)) / total
            f = np.divide(g, share, out=np.ones_like(g), where=share > 0)
            factors[d] = np.minimum(factors[d] * f, _FACTOR)
            w = np.minimum(reduce(np.multiply, (x[i] for x, i in zip(factors, groups, strict=True))), most)
        if np.abs(w - old).max() < tolerance:
            break
    return w


#: Bound on a factor that grows in vain because `most` holds its cells back.
_FACTOR = 1e9


def _rake_table(cells: DataFrame, targets: list[DataFrame], most: float, rounds: int, tolerance: float) -> DataFrame:
    """rake() by grouped sums and joins: cells with the column w."""
    x = written(cells.where("n > 0").select("*", *[F.lit(1.0).alias(f"f{d}") for d in range(len(DIMENSIONS))], F.least(F.lit(1.0), F.lit(most)).alias("w")), "raked")
    total = float(x.agg(F.sum("n")).first()[0] or 0)
    for _ in range(rounds if total else 0):
        old = x.select(*DIMENSIONS, F.col("w").alias("w0"))
        for d, (dim, goal) in enumerate(zip(DIMENSIONS, targets, strict=True)):
            share = x.groupBy(F.col(dim).alias("g")).agg((F.sum(F.col("w") * F.col("n")) / total).alias("share")).where("share > 0")
            factor = share.join(goal, share["g"].eqNullSafe(goal["g"])).select(share["g"].alias("g"), (F.col("target") / F.col("share")).alias("f"))
            x = x.join(factor, x[dim].eqNullSafe(factor["g"]), "left").drop("g").withColumn(f"f{d}", F.least(F.col(f"f{d}") * F.coalesce("f", F.lit(1.0)), F.lit(_FACTOR))).drop("f")
            x = written(x.withColumn("w", F.least(reduce(lambda a, b: a * b, [F.col(f"f{i}") for i in range(len(DIMENSIONS))]), F.lit(most))), "raked")
        moved = _with(x, old, "w0").agg(F.max(F.abs(F.col("w") - F.col("w0")))).first()[0]
        if moved is None or moved < tolerance:
            break
    return x.select(*DIMENSIONS, "n", "w")


def _with(rows: DataFrame, cells: DataFrame, column: str, small: bool = False) -> DataFrame:
    """rows with a column of their cell; null groups are groups."""
    other = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], column)
    same = reduce(lambda a, b: a & b, [rows[d].eqNullSafe(other[f"_{d}"]) for d in DIMENSIONS])
    return rows.join(F.broadcast(other) if small else other, same, "left").drop(*[f"_{d}" for d in DIMENSIONS])


@dataclass
class Mix:
    cells: DataFrame  # source, lang, topic, n (tokens), w (weight), probability; a written table
    targets: list[DataFrame]  # of each dimension: g, tokens, target
    small: bool  # whether the cells may be broadcast


def fit(counted: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, most: float = MOST, cells_in_memory: int = CELLS, rounds: int = 500, tolerance: float = 1e-9) -> Mix:
    """counted: source, lang, topic, n_tokens; one read. targets: shares by dimension and group."""
    spark = counted.sparkSession
    cells = written(counted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), "cells")
    small = cells.count() <= cells_in_memory
    goals = [_targets(cells, d, (targets or {}).get(d), temper) for d in DIMENSIONS]
    if small:
        found = sorted(cells.where("n > 0").collect(), key=lambda r: [(r[d] is None, r[d] or "") for d in DIMENSIONS])
        names = [{r.g: (i, r.target) for i, r in enumerate(g.collect())} for g in goals]  # no more than there are cells
        n = np.array([r.n for r in found], np.float64)
        groups = [np.array([names[d][r[d]][0] for r in found], np.int64) for d in range(len(DIMENSIONS))]
        shares = [np.array([x[1] for x in m.values()], np.float64) for m in names]
        w = rake(n, groups, shares, most, rounds, tolerance)
        raked = spark.createDataFrame([(*[r[d] for d in DIMENSIONS], int(r.n), float(x)) for r, x in zip(found, w, strict=True)], "source string, lang string, topic string, n bigint, w double")
    else:
        raked = _rake_table(cells, goals, most, rounds, tolerance)
    raked = written(raked, "weights")
    top = raked.agg(F.max("w")).first()[0] or 1.0
    return Mix(written(raked.withColumn("probability", F.least(F.col("w") / top, F.lit(1.0))), "mixture"), goals, small)


def shares(mix: Mix) -> DataFrame:
    """Per dimension and group: tokens, the target and the share that the weights reach."""
    total = mix.cells.agg(F.sum(F.col("w") * F.col("n"))).first()[0] or 1.0
    out = []
    for dim, goal in zip(DIMENSIONS, mix.targets, strict=True):
        got = mix.cells.groupBy(F.col(dim).alias("g2")).agg((F.sum(F.col("w") * F.col("n")) / total).alias("reached"))
        out.append(goal.join(got, goal["g"].eqNullSafe(got["g2"])).select(F.lit(dim).alias("dimension"), F.col("g").alias("group"), "tokens", "target", "reached"))
    return reduce(DataFrame.unionByName, out)


def with_probability(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows (source, lang, topic) with the probability of their cell; 1 where it has no tokens."""
    return _with(rows, mix.cells, "probability", mix.small).withColumn("probability", F.coalesce("probability", F.lit(1.0)))


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, most: float = MOST) -> tuple[DataFrame, Mix]:
    """(doc_id, u, source, lang, n_tokens, topic, probability of every row; the mix)."""
    bagged = written(bags(docs), "bags")
    counted = with_topics(bagged, topic_centres(bagged))
    mix = fit(counted, targets, most=most)
    return with_probability(counted, mix), mix


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: cell, probability and draw of every document."""
    out, _ = mixture(documents(spark, sf_dir))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", (F.col("u") < F.col("probability")).alias("sampled"))


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, most: float = MOST) -> DataFrame:
    """The drawn rows of docs (doc_id, text, source, lang, ...)."""
    bagged = written(bags(docs), "bags")
    centres = topic_centres(bagged)
    mix = fit(with_topics(bagged, centres), targets, most=most)
    shared = spark.sparkContext.broadcast(centres)

    def topic(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        out = [nearest(_bags(s.column(0))[0].astype("<f4").astype(np.float64), shared.value) for s in slices(batch, 0)]
        give_back(caches=True)
        return pa.array([f"t{k}" for x in out for k in x.tolist()], pa.string())

    topic.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), drawn_at().alias("u"), F.col("source").cast("string"), F.col("lang").cast("string"), F.arrow_udf(topic, "string")("text").alias("topic"))
    return with_probability(own, mix).where("u < probability").select("row.*")
