"""What the corpus operators share: the shared folder, written tables, and byte-bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at once; a longer single text is taken whole.
SLICE_BYTES = 1 << 20
_own: dict[str, str] = {}
#: What a worker keeps from task to task of one stage, until a kernel of another stage starts in it.
CACHES: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and everything runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="penstock-"))
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/penstock/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and reread: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, col: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text in column `col` each."""
    import numpy as np

    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(lengths(batch.column(col)))
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(texts: pa.Array):
    """Bytes of each text; null: 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")


def give_back(caches: bool = False) -> None:
    """Returns to the system what a worker's allocators hold unused, and with `caches` what other kernels keep. Workers live on between stages, and a kernel's leavings would stay beside the next one's needs."""
    import ctypes

    if caches:
        for kept in CACHES:
            kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def thrifty(part):
    """part, a kernel for mapInArrow, in a worker that holds no leavings while and after it runs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(caches=True)
        yield from part(batches)
        give_back()

    return kernel


def mod_of_id(id_col: str, m: int):
    """crc32 of the decimal text of an id, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m
