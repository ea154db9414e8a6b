"""Media columns: payloads in tar shards under the name of their digest; rows carry digest, shard, offset and length.

A payload is the UTF-8 text, padded with zeros to a multiple of 64 bytes, as the samples of an 8-bit grey PNG image 64
samples wide (lossless, compressed; an own text chunk keeps the unpadded length). Each task writes one tar shard and
stores equal payloads once in it; over all shards the index keeps one place for each digest, so equal texts lead to the
same bytes. A pass that reads only the head of each object fills the metadata columns; another reads whole objects by
offset and length, decodes them, checks the digest and computes the feature.

Defined results: a null text counts as empty, and an empty text is 64 zeros; equal texts share one object and all values;
repeated rows and null ids are kept as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, slices, written
from .sharedfs import create, reader, task_name
from .textkit import utf8

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The head holds the signature, the image header and the length chunk.
HEAD = 8 + 25 + 12 + len(b"bytes\x00") + 20
_INDEX = "digest string, shard string, offset bigint, length bigint"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def to_png(raw: bytes) -> bytes:
    """The stored form of an unpadded payload."""
    rows = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row has filter 0 in front
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\x00" + b"%020d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def head_of(data: bytes) -> tuple[int, int, int]:
    """(width, height, unpadded bytes) from the first HEAD bytes."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    width, height = struct.unpack(">II", data[16:24])
    at = 8 + 25 + 8 + len(b"bytes\x00")
    return width, height, int(data[at : at + 20])


def from_png(data: bytes) -> bytes:
    """The padded payload of a stored object."""
    width, height, _ = head_of(data)
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return np.ascontiguousarray(rows[:, 1:]).tobytes()


def feature_of(payload: bytes) -> str:
    """64 bits in hex: which columns of the image are brighter than the image."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    column = x.mean(axis=0, dtype=np.float64)
    return np.packbits(column > column.mean()).tobytes().hex()


class TarShard:
    """Writes members one after another and knows where their bytes lie."""

    def __init__(self, uri: str):
        self.out, self.at = create(uri), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        start = self.at + len(head)
        self.at = start + len(data) + -len(data) % 512
        return start

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the shards. (rows: doc_id, digest; index: one place for each digest), both written tables. The digest is the SHA-256 of the padded payload."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, seen = f"{path}/{task_name()}.tar", None, set()
        for batch in batches:
            for s in slices(batch, 1):
                buf, off = utf8(s.column(1))
                raw = buf.tobytes()
                digests, where, size = [], [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    text = raw[a:b]
                    d = hashlib.sha256(padded(text)).digest()
                    at = length = None
                    if d not in seen:
                        shard = shard or TarShard(name)
                        data = to_png(text)
                        at, length = shard.add(f"{d.hex()}.png", data), len(data)
                        seen.add(d)
                    digests.append(d.hex())
                    where.append(at)
                    size.append(length)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(digests, pa.string()), pa.array([name] * len(digests), pa.string()), pa.array(where, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    rows = written(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` as text").mapInArrow(part, "doc_id bigint, " + _INDEX), "media-rows")
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    index = written(rows.where("offset is not null").groupBy("digest").agg(place).select("digest", "p.*"), "media-index")
    return rows.select("doc_id", "digest"), index


def _ranges(index: DataFrame, columns: str, schema: pa.Schema, head: int | None, make) -> DataFrame:
    """make(digest, bytes) of each object of the index, read by offset and length, in order of place, up to `head` bytes of each."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != name:
                    name, f = shard, reader(shard)
                out.append(make(digest, f.read_at(min(length, head or length), offset), length))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return index.select("digest", "shard", "offset", "length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(part, columns)


def metadata(index: DataFrame) -> DataFrame:
    """digest, width, height, n_bytes, media_bytes, from the heads alone."""
    kind = pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64())])

    def make(digest: str, data: bytes, length: int) -> dict:
        w, h, n = head_of(data)
        return {"digest": digest, "width": w, "height": h, "n_bytes": n, "media_bytes": length}

    return _ranges(index, "digest string, width int, height bigint, n_bytes bigint, media_bytes bigint", kind, HEAD, make)


def contents(index: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_sha256, feature, from the stored bytes."""
    kind = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def make(digest: str, data: bytes, length: int) -> dict:
        payload = from_png(data)
        found = hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"object {digest} holds {found}")
        return {"digest": digest, "payload_bytes": len(payload), "payload_sha256": found, "tail_crc32": zlib.crc32(payload[-64:]), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature_of(payload)}

    return _ranges(index, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string", kind, None, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's payload, stored and read back."""
    rows, index = store(documents(spark, sf_dir), scratch(spark, "media"))
    objects = metadata(index).join(contents(index), "digest")
    out = rows.join(objects, "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
