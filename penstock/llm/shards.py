"""Sharding by histogram sort, with DataFrame functions only.

The sort key of a row is (hash of its text, hash of its id and row number), so equal texts are neighbours. The driver holds
a few candidate boundaries; each pass counts the exact bytes below every candidate across all partitions and narrows the
candidates around the byte targets, until each boundary is within the tolerance or no key lies between two candidates. Then
the rows are exchanged once, by range over (shard, key). A group of equal texts is cut only where its own bytes exceed the
tolerance around a target, first by the hash of the text, then inside it by the hash of the row, so a hot group fills several
shards, even one whose rows agree in id and text.

Defined results: a null text has no bytes, crc32 0 and the size 16; a very long text is one row of its size, and its shard
is larger by what it exceeds the mean; ids may be null or repeat; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_MIN, _MAX = -(1 << 63), (1 << 63) - 1
#: Candidate cells of an interval in one pass.
CELL_BITS = 10


@dataclass
class _Interval:
    """Rows with lo <= (key or row hash) < hi; in the dimension of row hashes key is the one hash of a text that they share. below: exact bytes before."""

    lo: int
    hi: int
    below: int
    key: int | None = None
    targets: list[int] = field(default_factory=list)

    @property
    def shift(self) -> int:
        return max(0, (self.hi - self.lo - 1).bit_length() - CELL_BITS)

    def inside(self) -> Column:
        v = F.col("_id" if self.key is not None else "_key")
        c = (v >= F.lit(self.lo)) & ((v < F.lit(self.hi)) if self.hi <= _MAX else F.lit(True))
        return c if self.key is None else c & (F.col("_key") == F.lit(self.key))

    def cell(self) -> Column:
        v = F.col("_id" if self.key is not None else "_key")
        return F.shiftright(v, self.shift) - F.lit(self.lo >> self.shift)


def _row_key(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.monotonically_increasing_id()).alias("_id")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, crc32 of the text, and the sort key; no text. The key holds a row number, so write it before reading it twice."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        _row_key(id_col),
    )


def splitters(rows: DataFrame, n_shards: int, tolerance: float = 0.005) -> list[tuple[int, int]]:
    """Boundaries (key, row hash): rows at or above the k-th boundary belong to shard k + 1 or later."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // n_shards for k in range(1, n_shards)]
    slack = tolerance * total / n_shards
    found: dict[int, tuple[int, int]] = {}
    active = [_Interval(_MIN, _MAX + 1, 0, None, targets)] if total else []
    while active:
        which = F.lit(None).cast("int")
        cell = F.lit(None).cast("long")
        for i, x in reversed(list(enumerate(active))):
            which = F.when(x.inside(), i).otherwise(which)
            cell = F.when(x.inside(), x.cell()).otherwise(cell)
        counted = (
            rows.select(which.alias("i"), cell.alias("cell"), "size", "_key", "_id")
            .where("i is not null")
            .groupBy("i", "cell")
            .agg(F.sum("size").alias("b"), F.min("_key").alias("k0"), F.max("_key").alias("k1"), F.min("_id").alias("d0"), F.max("_id").alias("d1"))
            .orderBy("i", "cell")
            .collect()
        )
        narrowed: dict[tuple, _Interval] = {}
        for i, x in enumerate(active):
            cells = [c for c in counted if c["i"] == i]
            at, below = 0, x.below
            for t in x.targets:
                while at < len(cells) and below + cells[at]["b"] <= t:
                    below += cells[at]["b"]
                    at += 1
                if at == len(cells):
                    found[t] = (x.hi, _MIN) if x.key is None else (x.key, x.hi)
                    continue
                c = cells[at]
                one_key = c["k0"] == c["k1"]
                start = (c["k0"], _MIN) if x.key is None else (x.key, c["d0"])
                end = (c["k1"] + 1, _MIN) if x.key is None else (x.key, c["d1"] + 1)
                early, late = t - below, below + c["b"] - t
                if min(early, late) <= slack or one_key and c["d0"] == c["d1"]:
                    found[t] = start if early <= late else end
                    continue
                if one_key:
                    lo, hi, key = c["d0"], c["d1"] + 1, c["k0"]
                else:
                    lo, hi, key = c["k0"], c["k1"] + 1, None
                narrowed.setdefault((key, lo), _Interval(lo, hi, below, key)).targets.append(t)
        active = list(narrowed.values())
    return [found[t] for t in targets] if total else []


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """The shard of a row with _key and _id: how many boundaries lie at or below it."""
    n = F.lit(0)
    for k, d in bounds:
        if k > _MAX:
            continue
        past = F.col("_key") > F.lit(k)
        if d == _MIN:
            past = F.col("_key") >= F.lit(k)
        elif d <= _MAX:
            past = past | ((F.col("_key") == F.lit(k)) & (F.col("_id") >= F.lit(d)))
        n = n + past.cast("int")
    return n


def assign(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within the shard, in key order) of every row."""
    rows = written(keyed(docs, id_col, text_col), "shard-keys")
    bounds = splitters(rows, n_shards, tolerance)
    dealt = (
        rows.withColumn("shard", shard_of(bounds))
        .repartitionByRange("shard", "_key", "_id")
        .sortWithinPartitions("shard", "_key", "_id")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33).cast("int"))
    )
    dealt = written(dealt, "shard-rows")
    #: One row for each partition and shard in it: as many as partitions and shards together at most.
    runs = dealt.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return dealt.join(F.broadcast(runs), ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first") + F.col("_base")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int]]:
    """All columns of docs in folders shard=0, shard=1, ... below path, each sorted by key; returns the boundaries."""
    rows = written(keyed(docs, id_col, text_col), "shard-keys")
    bounds = splitters(rows, n_shards, tolerance)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("_key"), _row_key(id_col))
    whole.withColumn("shard", shard_of(bounds)).repartitionByRange("shard", "_key", "_id").sortWithinPartitions("shard", "_key", "_id").select("row.*", "shard").write.partitionBy("shard").parquet(path)
    return bounds


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document in one of 40 shards of nearly equal bytes."""
    from .common import documents

    out = assign(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
