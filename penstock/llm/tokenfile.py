"""Token ids in files of fixed-width bit packing.

Every id takes the fewest bits that hold the vocabulary. A file is a header, blocks of BLOCK ids, the table of documents
(id and first token of each) and the offsets of the blocks, so that a block, and with it any token range, is found by one
seek and unpacked as a whole with numpy. Documents are dealt out by range of id and written in ascending order, one file
for a partition; a manifest row for each file gives its place in the whole stream.

Defined results: a null or empty text is the end id alone; a null id sorts first and is stored as null; rows that share
an id are separate documents, side by side in order of a hash of the text, then of the text, so a hot id spreads over several
files; a very long text is encoded whole and spans blocks; an empty table gives no files and an empty result; an id that
doesn't fit the width is an error; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import encoder
from .common import documents, scratch, slices, written
from .sharedfs import create, reader, task_name

MAGIC = b"PKID"
BLOCK = 1 << 16
_HEAD = struct.Struct("<4sHHI")  # magic, version, width, ids in a block
_FOOT = struct.Struct("<QQQQ4s")  # ids, documents, place of the documents' table, place of the block offsets, magic
#: An id that stands for null in a file.
_NULL = -(1 << 63)


def width_for(vocabulary: int) -> int:
    """Bits of one id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids below 2 ** width, width bits each: 32 ids fill width words, and one numpy operation handles one of the 32 places in all groups."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit {width} bits")
    n = -(-len(ids) // 32)
    x = np.zeros((n, 32), np.uint64)
    x.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, width + 1), np.uint32)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        v = x[:, k] << np.uint64(shift)
        out[:, word] |= v.astype(np.uint32)
        if shift + width > 32:
            out[:, word + 1] |= (v >> np.uint64(32)).astype(np.uint32)
    return np.ascontiguousarray(out[:, :width]).astype("<u4").tobytes()


def unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of a packed block."""
    w = np.frombuffer(raw, "<u4").reshape(-1, width).astype(np.uint64)
    w = np.concatenate([w, np.zeros((len(w), 1), np.uint64)], axis=1)
    out = np.empty((len(w), 32), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        v = w[:, word] >> np.uint64(shift)
        if shift + width > 32:
            v |= w[:, word + 1] << np.uint64(32 - shift)
        out[:, k] = v & mask
    return out.reshape(-1)[:n]


class Writer:
    """Appends documents' ids to one file, a block at a time."""

    def __init__(self, uri: str, width: int):
        self.width, self.out = width, create(uri)
        self.out.write(_HEAD.pack(MAGIC, 1, width, BLOCK))
        self.at = _HEAD.size
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.buffer = np.zeros(0, np.uint32)
        self.n = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.starts.append(offsets[:-1] + self.n)
        self.n += len(ids)
        self.buffer = np.concatenate([self.buffer, ids]) if len(self.buffer) else ids
        whole = len(self.buffer) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(self.buffer[k : k + BLOCK])
        self.buffer = self.buffer[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if len(self.buffer):
            self._block(self.buffer)
        docs = np.concatenate([*self.docs, np.zeros(0, np.int64)]).astype("<i8")
        starts = np.concatenate([*self.starts, np.zeros(0, np.int64)]).astype("<i8")
        place = self.at
        self.out.write(docs.tobytes())
        self.out.write(starts.tobytes())
        self.out.write(np.asarray(self.offsets, "<u8").tobytes())
        self.out.write(_FOOT.pack(self.n, len(docs), place, place + 16 * len(docs), MAGIC))
        self.out.close()


class TokenFile:
    """Random access to one file. Documents first to last (all by default) are known by number; only their rows of the tables are read."""

    def __init__(self, uri: str, first: int = 0, last: int | None = None):
        self.f = reader(uri)
        size = self.f.size()
        self.n, self.n_docs, docs, self.blocks, magic = _FOOT.unpack(self.f.read_at(_FOOT.size, size - _FOOT.size))
        head, _, self.width, self.block = _HEAD.unpack(self.f.read_at(_HEAD.size, 0))
        if head != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.n_blocks = (size - _FOOT.size - self.blocks) // 8
        self.end = docs
        self.first, self.last = first, self.n_docs if last is None else min(last, self.n_docs)
        self.doc_ids = self._table("<i8", docs, self.first, self.last)
        self.starts = self._table("<i8", docs + 8 * self.n_docs, self.first, min(self.last + 1, self.n_docs))
        if self.last == self.n_docs:
            self.starts = np.append(self.starts, self.n)

    def _table(self, kind: str, at: int, a: int, b: int) -> np.ndarray:
        """Entries a to b of a table of 8-byte numbers."""
        return np.frombuffer(self.f.read_at(8 * (b - a), at + 8 * a), kind) if b > a else np.zeros(0, kind)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them, read in one piece."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        b0, b1 = start // self.block, (stop - 1) // self.block + 1
        offsets = self._table("<u8", self.blocks, b0, min(b1 + 1, self.n_blocks))
        at = int(offsets[0])
        end = int(offsets[b1 - b0]) if b1 < self.n_blocks else int(self.end)
        # Full blocks take a whole number of words, so neighbouring blocks unpack as one.
        ids = unpack(self.f.read_at(end - at, at), self.width, min(self.n, b1 * self.block) - b0 * self.block)
        return ids[start - b0 * self.block : stop - b0 * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k - self.first]), int(self.starts[k + 1 - self.first]))


def vocabulary_of(tokenizer: str) -> int:
    """One more than the largest id of a tokenizer."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below path, with ids as wide as the tokenizer's vocabulary needs. The manifest: path, part, n_docs, n_ids, and start, the ids in all files before."""
    width = width_for(max(vocabulary_of(tokenizer), end_id + 1))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, w, n_docs = f"{path}/{task_name()}.ids", None, 0
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            for s in slices(batch, 1):
                w = w or Writer(name, width)
                ids, off = enc.encode(s.column(1))
                w.add(s.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False), ids, off)
                n_docs += s.num_rows
        if w:
            w.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "part": [TaskContext.get().partitionId()], "n_docs": [n_docs], "n_ids": [w.n]}, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    spark = docs.sparkSession
    dealt = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` as text", f"xxhash64(`{text_col}`) as _tie")
    dealt = dealt.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    files = written(dealt.mapInArrow(part, "path string, part int, n_docs bigint, n_ids bigint"), "token-manifest")
    rows, at, out = files.orderBy("part").collect(), 0, []  # a row for each partition
    for r in rows:
        out.append((r.path, r.part, r.n_docs, r.n_ids, at))
        at += r.n_ids
    return spark.createDataFrame(out, "path string, part int, n_docs bigint, n_ids bigint, start bigint")


def read(manifest: DataFrame, docs_in_task: int = 20_000) -> DataFrame:
    """Per document, read back from the files: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    spec = manifest.selectExpr("path", "start", f"explode(sequence(0L, n_docs - 1, {docs_in_task}L)) as first")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(path, first, first + docs_in_task)
                k, last = 0, len(f.doc_ids)
                while k < last:  # about a megabyte of ids at once, or one document
                    to = max(k + 1, min(last, int(np.searchsorted(f.starts, f.starts[k] + (1 << 20), "right")) - 1))
                    base = int(f.starts[k])
                    ids = f.tokens(base, int(f.starts[to])).astype("<u4")
                    crc = [zlib.crc32(ids[a - base : b - base]) for a, b in zip(f.starts[k:to].tolist(), f.starts[k + 1 : to + 1].tolist(), strict=True)]
                    doc = f.doc_ids[k:to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == _NULL), pa.array(f.starts[k:to] + start), pa.array(np.diff(f.starts[k : to + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )
                    k = to

    return spec.repartition("path", "first").mapInArrow(part, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the ids of every document, written and read back."""
    import public_tokenizers

    files = write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-files"))
    return read(files)
