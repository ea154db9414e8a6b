"""Packing documents into windows of tokens: best-fit decreasing over the histogram of lengths.

A document longer than a window is first cut into full windows. The remainders are placed longest first, each into the
open window with the least room that still holds it; a segment tree over remaining capacities finds that window. Only
lengths decide, so the driver places the histogram (as many rows as a window has tokens) and gets a short list of runs
"the q-th remainder of length L goes to window w at offset o"; executors look their remainders up in it by rank. The
result is exactly that of placing one remainder after another, at a cost that doesn't grow with the number of documents.

Defined results: a null or empty text is the end id alone; rows that share an id are separate documents; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import documents, give_back, slices, written

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _part int, _rank bigint"


class RoomTree:
    """How many windows are open at each remaining capacity; finds the least capacity that is at least x."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, room: int) -> int | None:
        i = room + self.size
        if self.count[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces to a window, first window, offset) in order of length and rank, and the number of windows. Piece q of a run is in window + (q - first) // k at offset + (q - first) % k * length."""
    tree, open_, runs, windows = RoomTree(capacity), {}, [], 0

    def put(first: int, n: int, room: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                n = -(-left // (room // length))
                first, windows = windows, windows + n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            k = room // length
            used = min(n, -(-left // k))
            put(first + used, n - used, room)
            placed = min(left, used * k)
            runs.append((length, rank, k, first, capacity - room))
            full = placed // k
            put(first, full, room - k * length)
            put(first + full, used - full, room - placed % k * length)
            left, rank = left - placed, rank + placed
    return sorted(runs), windows


def pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each full window and each remainder, ranked by length within its partition; with_ids keeps the ids as 32-bit little-endian bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            for s in slices(batch, 1):
                ids, off = enc.encode(s.column(1))
                raw = ids.astype("<u4")
                n = np.diff(off)
                k = -(-n // window)  # pieces of each document
                doc = np.repeat(np.arange(len(n)), k)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * window
                length = np.minimum(n[doc] - start, window)
                at = off[doc] + start
                cut = [raw[a:b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(doc), np.int64)
                lens, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank[order] = np.arange(len(doc)) - np.repeat(first, many) + np.repeat(seen[lens], many)
                seen[lens] += many
                cols = [s.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[doc]), pa.array(np.full(len(doc), me, np.int32)), pa.array(rank)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_rank"]
                if with_ids:
                    cols.append(pa.array([x.tobytes() for x in cut], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()  # the encoder stays for the stage's next task

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` as text").mapInArrow(part, PIECES + (", ids binary" if with_ids else ""))


def place(cut: DataFrame, window: int = 1024) -> DataFrame:
    """pieces() with sequence_id and offset in place of the ranks. cut is read twice, so it has to be a written table."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length
    full = total.pop(window, 0)
    runs, _ = best_fit(total, window)
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table, full))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, full = shared.value
        code = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() + batch.column("_before").to_numpy()
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            rest = np.flatnonzero(length < window)
            if len(rest):
                r = runs[np.searchsorted(code, length[rest] << 40 | rank[rest], "right") - 1]
                q = rank[rest] - r[:, 1]
                sequence[rest] = full + r[:, 3] + q // r[:, 2]
                offset[rest] = r[:, 4] + q % r[:, 2] * r[:, 0]
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("_part", "_rank", "_before")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    kept = [f for f in cut.schema.fields if f.name not in ("_part", "_rank")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    return cut.join(base, ["length", "_part"]).select(*cut.columns, "_before").mapInArrow(part, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    return place(written(pieces(docs, tokenizer, window, end_id, id_col, text_col, with_ids), "pieces"), window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document packed into sequences of 1024 tokens."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
