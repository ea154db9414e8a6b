"""The one string similarity that built-ins lack: difflib's ratio, Arrow-batched and memoised within a batch."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in seen:
            seen[x, y] = 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
        out.append(seen[x, y])
    return pa.array(out, pa.float64())


_ratio.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
seq_ratio = F.arrow_udf(_ratio, DoubleType())
