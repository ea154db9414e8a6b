"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from penstock.llm import runs

WORD = r"[^\x20\x09-\x0D]+"


def brute(w):
    """(start, length, period) of all runs, by start and period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain(d, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(("" if d is None else str(d)).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (d, len(found), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        w = []
        while len(w) < rng.choice([0, 5, 30, 200]):
            p = [rng.choice(letters) * rng.randint(1, 2) for _ in range(rng.randint(1, 9))]
            w += p * rng.randint(1, 8) + [rng.choice(letters) for _ in range(rng.randint(0, 3))]
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out + [None, "", " \n", "x", "é " * 11, "é " * 12, "no\x00break here " * 6]


@pytest.mark.parametrize("portion", [runs.PORTION, 37])
@pytest.mark.parametrize("seed", range(4))
def test_runs_by_brute_force(seed, portion):
    ts = texts(seed)
    ids = list(range(1000 * seed, 1000 * seed + len(ts)))
    out = runs.analysed(pa.array(ts, pa.string()), np.array([zlib.crc32(str(d).encode()) for d in ids]), portion)
    got = [(d, *r[:6], hashlib.sha256(r[6].encode()).hexdigest()) for d, r in zip(ids, zip(*(c.to_pylist() for c in out), strict=True), strict=True)]
    assert got == [plain(d, t) for d, t in zip(ids, ts, strict=True)]


def test_fibonacci_word_has_many_runs():
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    out = runs.analysed(pa.array([" ".join(b)]))
    assert out[0][0].as_py() == len(brute(b)) > 20


def test_levels_stop_where_nothing_repeats():
    word = np.arange(1000) % 500
    assert [int((x >= 0).sum()) for x in runs.levels(word, np.zeros(1000, int), np.full(1000, 1000))[:2]] == [1000, 998]
    assert len(runs.levels(np.arange(1000), np.zeros(1000, int), np.full(1000, 1000))) == 1


def test_a_very_long_text():
    w = ["w%d" % (i % 700) for i in range(30_000)] + ["end"] + ["x"] * 40_000
    out = [c[0].as_py() for c in runs.analysed(pa.array([" ".join(w)]))]
    assert out[:5] == [2, 30_001, 40_000, 1, 40_000_000]
    assert out[6] == " ".join([*w[:700], "end", "x"])


def test_odd_rows(spark):
    rows = [(d, t, "a", "b", 1) for d, t in [(None, "a b " * 40), (None, None), (7, "a b " * 40), (7, "a b " * 40), (31, "x y z " * 9 + "w")]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, period string, n_runs int")
    out = runs.analyse(df, id_col="doc_id").collect()
    got = sorted(((r.id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in out), key=str)
    assert got == sorted((plain(r[0], r[1]) for r in rows), key=str)
    assert runs.analyse(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 20_000}
    got = {r.doc_id: tuple(r[c] for c in ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]) for r in runs.query(spark, sf).collect()}
    assert len(got) == len(docs)
    assert [got[d] for d in sorted(short)] == [plain(d, short[d]) for d in sorted(short)]
