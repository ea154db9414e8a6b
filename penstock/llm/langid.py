"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its byte trigrams and four-grams (A-Z folded, word ends included), hashed into
BUCKETS rows; a linear layer and a softmax follow. The model is fitted on a bounded sample, the first texts of each language
in the order of a hash; the texts that follow set the temperature and the score below which a prediction is rejected. Whole
texts are read everywhere. Inputs of a prediction are the text's bytes and nothing else. Any number of languages can be
learned; the driver holds the sample's grams and one bias and DIM weights a language.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; where nothing can be learned every
text is `und`; ties between languages go to the first in order of name; rows are judged alone, so repeated rows agree and
other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, give_back, mod_of_id, slices, thrifty, written
from .textkit import LOWER, SEPARATOR, utf8

BUCKETS = 1 << 15
DIM = 16
#: Distinct texts to fit on and to calibrate on, about, over all languages; each language fits on one at least.
SAMPLE, CALIBRATION = 2400, 2400

#: No prediction with a higher calibrated score is rejected.
MOST_REJECTED = 0.4

_FOLD = LOWER.copy()
_FOLD[SEPARATOR] = 0x20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigram around each byte and of the four-gram from its predecessor on; nothing reaches over the ends of a text but a blank."""
    cur = _FOLD[buf]
    prev, nxt = np.empty_like(cur), np.empty_like(cur)
    if len(cur):
        full = off[:-1] < off[1:]
        prev[1:], nxt[:-1] = cur[:-1], cur[1:]
        prev[off[:-1][full]] = 0x20
        nxt[off[1:][full] - 1] = 0x20
    after = np.zeros_like(cur)
    if len(cur):
        after[:-1] = nxt[1:]
        after[off[1:][full] - 1] = 0
    h = prev.astype(np.uint32) * np.uint32(0x9E3779B1) + cur.astype(np.uint32) * np.uint32(0x85EBCA6B) + nxt.astype(np.uint32) * np.uint32(0xC2B2AE35)
    g = h + after.astype(np.uint32) * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out = []
    for x in (h, g):
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out.append(x >> shift)
    return out[0], out[1]


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    out = n[off[1:]] > n[off[:-1]]
    for k in np.flatnonzero(~out & (off[1:] > off[:-1])).tolist():
        out[k] = any(c.isalpha() for c in buf[off[k] : off[k + 1]].tobytes().decode("utf-8"))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS rows: embeddings, or with few languages embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    linear: np.ndarray | None = None  # where the table holds embeddings

    def logits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        a, b = grams(buf, off)
        out = np.zeros((len(off) - 1, self.table.shape[1]))
        full = np.flatnonzero(off[:-1] < off[1:])
        if len(full):
            for k in range(out.shape[1]):
                col = np.ascontiguousarray(self.table[:, k])
                out[full, k] = np.add.reduceat(col[a] + col[b], off[:-1][full], dtype=np.float64)
            out[full] /= 2.0 * (off[1:] - off[:-1])[full, None]
        return (out if self.linear is None else out @ self.linear) + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        buf, off = utf8(texts)
        n = len(off) - 1
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        z = self.logits(buf, off) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(n), best]
        known = has_letter(buf, off)
        score[~known] = 0
        return [self.languages[i] if k else "und" for i, k in zip(best.tolist(), known.tolist(), strict=True)], score, ~known | (score < self.reject_below)


def _sampled(docs: DataFrame, fit: int, calibrate: int, lang_col: str) -> DataFrame:
    """text, lang and whether the row calibrates: about `fit` distinct texts to fit on and `calibrate` others, as many of each language, the first ones in the order of a hash. A language with few texts fits on them; each with a text has one at least."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length("text") > 0)).select(F.col(lang_col).alias("lang"), "text", F.xxhash64("text", F.lit(1)).alias("u"), F.xxhash64("text", F.lit(2)).alias("v"))
    each = written(known.select("lang", "u", "v").distinct(), "texts-of-languages")
    counts = each.groupBy("lang").agg(F.count("*").alias("n"))
    languages = max(counts.count(), 1)
    to_fit, all_of = -(-fit // languages), -(-fit // languages) - (-calibrate // languages)
    # Eight times what is needed and a hundred pass, whatever the language's size, so that ranking is bounded.
    low = F.pmod("u", F.lit(1 << 30)) / (1 << 30) < (8.0 * all_of + 100) / F.col("n")
    some = each.join(F.broadcast(counts), "lang").where(low)  # counts: a row for each language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "v"))
    chosen = written(some.select("lang", "u", "v", rank.alias("r")).where(F.col("r") <= all_of), "drawn")
    keys = ["lang", "u", "v", "r"]
    return written(known.join(F.broadcast(chosen), keys[:3]).groupBy(*keys).agg(F.first("text").alias("text")).select("text", "lang", (F.col("r") > to_fit).alias("calibrates")), "sampled-texts")


def _bags(sample: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, weights that sum to 1) of each sampled text; bounded by the sample."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, 0):
                buf, off = utf8(s.column(0))
                a, b = grams(buf, off)
                keys, counts = [], []
                for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    k, c = np.unique(np.concatenate([a[i:j], b[i:j]]), return_counts=True)
                    keys.append(k.astype("<u2").tobytes())
                    counts.append(c.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([s.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "k", "c"])

    rows = sample.select("text", "lang").mapInArrow(thrifty(part), "lang string, k binary, c binary").collect()
    out = []
    for r in sorted(rows, key=lambda r: (r.lang, bytes(r.k), bytes(r.c))):
        c = np.frombuffer(r.c, "<u4").astype(np.float32)
        if len(c):
            out.append((r.lang, np.frombuffer(r.k, "<u2"), c / c.sum()))
    return out


def _batch(bags, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    idx, w = np.concatenate([bags[i][1] for i in rows]).astype(np.int64), np.concatenate([bags[i][2] for i in rows])
    return idx, w, np.repeat(np.arange(len(rows)), [len(bags[i][1]) for i in rows])


def train(docs: DataFrame, lang_col: str = "lang", epochs: int = 6, rate: float = 0.5, seed: int = 5, fit: int = SAMPLE, calibrate: int = CALIBRATION) -> Model:
    """docs: text and the language column; only rows that may be learned from. fit, calibrate: about how many texts to fit and to calibrate on."""
    sample = _sampled(docs, fit, calibrate, lang_col)
    bags = _bags(sample.where("not calibrates"))
    names = sorted({b[0] for b in bags})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    lin, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    lin += rng.standard_normal(lin.shape).astype(np.float32) * 0.1
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[b[0]] for b in bags])
    seen_e, seen_l, seen_b = np.full(BUCKETS, 1e-6, np.float32), 1e-6, 1e-6  # AdaGrad sums
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            idx, w, seg = _batch(bags, rows)
            x = np.zeros((len(rows), DIM), np.float32)
            np.add.at(x, seg, emb[idx] * w[:, None])
            z = x @ lin + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            gx, gl, gb = p @ lin.T, x.T @ p, p.sum(axis=0)
            ge = np.zeros((BUCKETS, DIM), np.float32)
            np.add.at(ge, idx, w[:, None] * gx[seg])
            seen_e += (ge * ge).mean(axis=1)
            seen_l += float((gl * gl).mean())
            seen_b += float((gb * gb).mean())
            emb -= rate * ge / np.sqrt(seen_e)[:, None]
            lin -= rate * 0.2 * gl / np.sqrt(seen_l)
            bias -= rate * 0.05 * gb / np.sqrt(seen_b)
    few = len(names) <= DIM
    model = Model(names, emb @ lin if few else emb, bias.astype(np.float64), linear=None if few else lin)
    del bags, seen_e, emb  # the driver holds one sample at a time
    return _calibrated(model, _bags(sample.where("calibrates")))


def _calibrated(model: Model, bags) -> Model:
    """The temperature with the least log loss on texts not fitted on, and the rejection score: of the right predictions there, no more than one in a thousand may fall below it, and it is MOST_REJECTED at most, so that a text in two languages, which each get about half, is kept."""
    bags = [b for b in bags if b[0] in model.languages]
    if len(bags) < 20:
        return model
    z = np.array([(model.table[k] * w[:, None]).sum(axis=0) for _, k, w in bags], np.float64)
    z = (z if model.linear is None else z @ model.linear) + model.bias
    y = np.array([model.languages.index(b[0]) for b in bags])

    def probs(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    model.temperature = min(np.geomspace(0.02, 20, 80).tolist(), key=lambda t: -np.log(probs(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = probs(model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.reject_below = min(MOST_REJECTED, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return model


def predictor(spark: SparkSession, model: Model):
    """A column function of the text: struct of lang_pred, score, rejected."""
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        give_back(caches=True)
        parts = [shared.value.predict(s.column(0)) for s in slices(batch, 0)]
        give_back()
        langs = [x for p in parts for x in p[0]]
        cat = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(cat(1, float)), pa.array(cat(2, bool))], names=["lang_pred", "score", "rejected"])

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, "lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the language of every document, learned from two thirds of them."""
    docs = documents(spark, sf_dir)
    held = mod_of_id("doc_id", 3) == 1
    model = train(docs.where(~held))
    out = docs.select("doc_id", held.alias("held_out"), predictor(spark, model)(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
