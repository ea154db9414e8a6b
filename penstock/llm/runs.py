"""Periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q and a length of max(12, 2q) or more that no neighbouring word
extends. The words of some documents are named exactly (a dictionary, by document), then blocks of 2, 4, 8 ... words by pairs
of names, so that equal names mean equal blocks; a block that occurs once in its document has no name and is not looked at
again. For every period q the places 0, q, 2q ... of a document are a grid that every run with that period meets: where the
words at i and i + q agree, the run is extended to both sides by the longest common extension, in descending levels of names.
All in numpy, for many documents at once, without hashes of spans and without sorting suffixes.

Defined results: a null or wordless text has no words, no run and the digests of nothing; a null id counts as the empty text
where its crc32 is taken; a row is judged alone, so ties, repeated rows and other columns play no part; an empty table stays
empty. A very long text is taken whole, in one piece: its task needs about 40 bytes a word and level of names that repeat,
and periods are tried in bounded portions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices
from .textkit import utf8, words

LEAST = 12  # words of the shortest run
#: Grid places looked at at once.
PORTION = 1 << 20


def levels(name: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 2**k words, k = 0, 1 ...; -1: occurs once in its document, or reaches beyond it. name: equal for equal words of one document; start, end: of each word's document."""
    _, first, count = np.unique(name, return_inverse=True, return_counts=True)
    level = np.where(count[first] > 1, first, -1).astype(np.int32)
    out = [level]
    span = 1
    live = np.flatnonzero(level >= 0)
    while True:
        at = live[live + span < end[live]]
        at = at[level[at + span] >= 0]
        if not len(at):
            return out
        pair = level[at].astype(np.int64) << 32 | level[at + span]
        _, number, count = np.unique(pair, return_inverse=True, return_counts=True)
        again = count[number] > 1
        live = at[again]
        if not len(live):
            return out
        level = np.full(len(name), -1, np.int32)
        level[live] = number[again]
        out.append(level)
        span *= 2


def _agree(level: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a = level[i]
    return (a >= 0) & (a == level[j])


def extended(named: list[np.ndarray], i: np.ndarray, j: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i and j on agree, and how many before them (i < j, of one document that spans [start, end))."""
    fwd, back = i.copy(), i.copy()
    gap = j - i
    for k in range(len(named) - 1, -1, -1):
        span = 1 << k
        ok = np.flatnonzero(fwd + gap + span <= end)
        ok = ok[_agree(named[k], fwd[ok], fwd[ok] + gap[ok])]
        fwd[ok] += span
        ok = np.flatnonzero(back - span >= start)
        ok = ok[_agree(named[k], back[ok] - span, back[ok] - span + gap[ok])]
        back[ok] -= span
    return fwd - i, i - back


def grids(first: np.ndarray, portion: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all grid places with a partner in the document, for every period up to half of its words. first: the number of words before each document."""
    n = np.diff(first)
    top = int(n.max(initial=0)) // 2
    q = 1
    order = np.argsort(-n, kind="stable")
    ascending = -n[order]
    while q <= top:
        docs = order[: np.searchsorted(ascending, -2 * q, "right")]  # with 2q words or more
        # The periods q .. q + some - 1 of these documents hold about n / q places each.
        some = max(1, min(q, top - q + 1, int(portion // max(1, n[docs].sum() // q + len(docs)))))
        d, p = np.repeat(docs, some), np.tile(np.arange(q, q + some), len(docs))
        fit = 2 * p <= n[d]
        d, p = d[fit], p[fit]
        places = (n[d] - 1) // p  # i = 0, p, ... with i + p inside
        for a, b in _portions(places, portion):
            k = places[a:b]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            period = np.repeat(p[a:b], k)
            yield np.repeat(d[a:b], k), at * period, period
        q += some


def _portions(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def found(name: np.ndarray, first: np.ndarray, portion: int = PORTION) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period; starts count from the document's first word."""
    n = np.diff(first)
    start, end = np.repeat(first[:-1], n), np.repeat(first[1:], n)
    named = levels(name, start, end)
    none = np.zeros((0, 4), np.int64)
    runs = [none]
    for d, at, period in grids(first, portion):
        i = first[d] + at
        hit = np.flatnonzero(_agree(named[0], i, i + period))
        if not len(hit):
            continue
        d, i, period = d[hit], i[hit], period[hit]
        fwd, back = extended(named, i, i + period, first[d], first[d + 1])
        length = fwd + back + period
        ok = length >= np.maximum(LEAST, 2 * period)
        if ok.any():
            runs.append(_distinct(np.stack([d[ok], (i - back)[ok] - first[d[ok]], length[ok], period[ok]], axis=1)))
    out = _distinct(np.concatenate(runs))
    # Rows go by document, start, length and period: of those with one stretch the first has its smallest period.
    same = np.zeros(len(out), bool)
    same[1:] = (out[1:, :3] == out[:-1, :3]).all(axis=1)
    out = out[~same]
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]).any(axis=1)
    return x[keep]


def kept_words(first: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Per word, whether no run contains it after the run's first period."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(edge, first[doc] + start + period, 1)
    np.add.at(edge, first[doc] + start + length, -1)
    return np.cumsum(edge)[:-1] == 0


def planted(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which word stands at each place after periods are planted by the contract of the query: where h % 10 is 0, the words from a on become those of one period p. h: unsigned crc32 of each id."""
    source = np.arange(first[-1])
    for d in np.flatnonzero((h % 10 == 0) & (np.diff(first) > 0)).tolist():
        n, g = int(first[d + 1] - first[d]), int(h[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return source


def dictionary(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words as an Arrow column, and an exact number of each."""
    size = e - s
    off = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(s - off[:-1], size) + np.arange(off[-1])]
    column = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    return column, column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


RESULT = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed string"


def analysed(texts: pa.Array, h: np.ndarray | None = None, portion: int = PORTION) -> list[pa.Array]:
    """The columns of RESULT for some texts; h: crc32 of the ids, where periods are to be planted."""
    buf, off = utf8(texts)
    s, e, first = words(buf, off)
    column, word = dictionary(buf, s, e)
    if h is not None:
        source = planted(first, h)
        column, word = column.take(pa.array(source)), word[source]
    n_docs = len(first) - 1
    of = np.repeat(np.arange(n_docs), np.diff(first))
    doc, start, length, period = found(of << 32 | word, first, portion)
    keep = kept_words(first, doc, start, length, period)
    left = np.concatenate([[0], np.cumsum(keep)])[first]
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), column.filter(pa.array(keep)))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    number = np.searchsorted(doc, np.arange(n_docs + 1))
    lines = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
    best = np.full(n_docs, -1)
    by = np.lexsort((period, start, -length, doc))
    some = np.flatnonzero(np.diff(number))
    best[some] = by[number[some]]
    none = best < 0
    pick = lambda x: pa.array(np.where(none, 0, x[np.maximum(best, 0)] if len(x) else 0), pa.int64(), mask=none)
    digests = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(number[:-1].tolist(), number[1:].tolist(), strict=True)]
    milli = 1000 * length // np.maximum(period, 1)
    return [pa.array(np.diff(number), pa.int64()), pick(start), pick(length), pick(period), pick(milli), pa.array(digests, pa.string()), collapsed]


def analyse(rows: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """Every row's id_col (where given) with the columns of RESULT: its number of runs, the longest one (of those, the first, then that of the smallest period), a digest of all, and the text without repetitions. With id_col, periods are planted by it first."""
    key = "" if id_col is None else f"{rows.schema[id_col].dataType.simpleString()}"
    cols = [text_col] if id_col is None else [text_col, id_col]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, 0):
                h = None if id_col is None else np.array([zlib.crc32(("" if d is None else str(d)).encode()) for d in s.column(1).to_pylist()], np.int64)
                out = analysed(s.column(0), h)
                ids = [] if id_col is None else [s.column(1)]
                yield pa.RecordBatch.from_arrays([*ids, *out], names=[*(["id"] if ids else []), *RESULT_NAMES])

    return rows.select(*[f"`{c}`" for c in cols]).mapInArrow(part, (f"id {key}, " if key else "") + RESULT)


RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the periodic runs of every document."""
    out = analyse(documents(spark, sf_dir), id_col="doc_id")
    return out.selectExpr("id as doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "sha2(cast(collapsed as binary), 256) as collapsed_sha256")
