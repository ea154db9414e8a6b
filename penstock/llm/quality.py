"""A quality classifier with hierarchical empirical Bayes.

A logistic model over the shape of a text (shares of symbols, capitals, repeats and so on), fitted on a bounded sample of
labelled documents, gives each document its own evidence. Grouped aggregation adds up that evidence by host and by path
within a host. A host's posterior mean is shrunk toward the global mean, a path's toward its host, each with a strength
estimated from the spread between groups, so sparse sites fall back on their prior. The score of a document combines its own
log odds with the log odds of its path relative to the global ones; its own evidence is left out of its path's and its host's
posterior. Labels that contradict each other for one id count as bad.

Defined results: a null or wordless text has score 0 and is rejected; a null host or path is the empty name; without labels
of both kinds nothing is rejected for its text but wordless ones; rows that agree have equal scores; an empty table gives an
empty result; a very long text is read whole, and its shares saturate like a short one's; other columns are ignored, or kept
by `judge`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, slices, table, thrifty, written
from .textkit import SEPARATOR, mix, span_hash, utf8, words

#: Labelled documents to fit on, at most about.
SAMPLE = 12_000
#: Up to so many hosts or paths go to every task; more are joined by shuffling, where AQE splits hot keys.
BROADCAST_GROUPS = 100_000
_WORDLESS = -30.0

_KINDS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!", ".,;:?\"'()-"], 1):
    _KINDS[[ord(c) for c in _chars]] = _k
_KINDS[SEPARATOR] = 6
FEATURES = 11


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document."""
    key = mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, at = np.unique(key, return_index=True)
    return np.bincount(doc[at], minlength=n)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each text, words of each text)."""
    buf, off = utf8(texts)
    n = len(off) - 1
    kinds = np.bincount(np.repeat(np.arange(n) * 8, np.diff(off)) + _KINDS[buf], minlength=8 * n).reshape(n, 8)
    s, e, first = words(buf, off)
    h = span_hash(buf, s, e)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    again = np.zeros(n)
    if len(h) > 1:
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    cuts = np.unique(np.concatenate([off, np.flatnonzero(buf == 10) + 1]))
    a, b = cuts[:-1], cuts[1:]
    b = b - (buf[b - 1] == 10) if len(b) else b
    a, b = a[b > a], b[b > a]
    line_doc = np.searchsorted(off, a, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    w, c, ln = np.maximum(n_words, 1), np.maximum(np.diff(off) - kinds[:, 6], 1), np.maximum(lines, 1)
    distinct = _distinct(h, doc, n)
    x = np.stack(
        [
            np.minimum(kinds[:, 3] / w, 1), np.minimum(3 * kinds[:, 1] / c, 1), np.minimum(kinds[:, 4] / w, 1), np.minimum(2 * again / w, 1),
            np.maximum(lines - _distinct(span_hash(buf, a, b), line_doc, n), 0) / ln * np.minimum(1, lines / 8), 1 - distinct / w, (1 - distinct / w) / np.log(w + 10),
            np.log1p(n_words) / 8, np.minimum(c / w / 10, 2), kinds[:, 2] / c, np.minimum(kinds[:, 5] / w, 1),
        ],
        axis=1,
    )
    return x, n_words


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias; all zero: nothing was learned

    def logits(self, texts: pa.Array) -> np.ndarray:
        x, n_words = features(texts)
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1] if self.weights.any() else np.full(len(x), 3.0)
        return np.where(n_words > 0, np.clip(z, -12, 12), _WORDLESS)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Logistic regression by Newton steps on labelled documents drawn by hash of the id. The features of the sample, a few numbers a document, go to the driver; texts don't."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    drawn = known.where(u < min(1.0, sample / max(n, 1))).groupBy("doc_id").agg(F.min("y").alias("y")).limit(2 * sample)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, 0):
                x, n_words = features(s.column(0))
                keep = pa.array(n_words > 0)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), s.column(1)], names=["x", "y"]).filter(keep)

    text = docs.where("text is not null").select(F.col(id_col).alias("doc_id"), "text")
    # drawn is bounded by its limit: ids and labels only.
    rows = text.join(F.broadcast(drawn), "doc_id").select("text", "y").limit(4 * sample).mapInArrow(thrifty(part), "x array<double>, y int").collect()
    zero = Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    y = np.array([r.y for r in rows], float)
    if len(set(y.tolist())) < 2:
        return zero
    x = np.array([r.x for r in rows])
    order = np.lexsort([*x.T, y])  # sums don't depend on the order of arrival
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w)


def evidence(spark: SparkSession, model: Model):
    """A column function of the text: the document's own log odds of being good."""
    shared = spark.sparkContext.broadcast(model)

    def logit(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        give_back(caches=True)
        out = np.concatenate([shared.value.logits(s.column(0)) for s in slices(batch, 0)] or [np.zeros(0)])
        give_back()
        return pa.array(out, pa.float64())

    logit.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(logit, "double")


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(q / (1 - q))


def _strength(groups: int, parents: int, rows: int, effective: float, within: float, between: float, mean: float) -> float:
    """Prior observations of a beta prior whose variance is that between the groups of a parent (nested analysis of variance)."""
    if groups <= parents or rows <= groups:
        return 1e3
    inside = within / (rows - groups)
    spread = (between - (groups - parents) * inside) / max(effective, 1e-9)
    return 1e4 if spread <= 0 else float(np.clip(mean * (1 - mean) / spread - 1, 2.0, 1e4))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """scored: host, path, logit. (per host and path: n and q, hn and hq, the rows and the sums of evidence of path and host, the prior strengths k_host and k_path, and the host's posterior mean; the global mean). Sums are taken before anything is shuffled. Hosts vary around the global mean, paths around their host's."""
    q = _sigmoid(F.col("logit"))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(q).alias("q"), F.sum(q * q).alias("q2")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("q").alias("hq"), F.sum("q2").alias("hq2")), "hosts")
    total = hosts.agg(F.sum("hn"), F.sum("hq")).first()
    mean = total[1] / total[0] if total[0] else 0.5

    def strength(groups: DataFrame, n: str, s: str, s2: str, parent_n: Column, parent_mean: Column, parents: Column) -> float:
        r = groups.agg(
            F.count("*"), parents, F.sum(n), F.sum(F.col(n) - F.col(n) * F.col(n) / parent_n),
            F.sum(F.col(s2) - F.col(s) * F.col(s) / F.col(n)), F.sum(F.col(n) * (F.col(s) / F.col(n) - parent_mean) ** 2),
        ).first()
        return _strength(*(x or 0 for x in r), mean)

    k_host = strength(hosts, "hn", "hq", "hq2", F.lit(float(total[0] or 1)), F.lit(mean), F.lit(1))
    both = paths.join(hosts, "host")
    k_path = strength(both, "n", "q", "q2", F.col("hn"), F.col("hq") / F.col("hn"), F.count_distinct("host"))
    host = (F.col("hq") + k_host * mean) / (F.col("hn") + k_host)
    out = both.select("host", "path", "n", "q", "hn", "hq", F.lit(k_host).alias("k_host"), F.lit(k_path).alias("k_path"), host.alias("host_posterior"))
    return written(out, "posteriors"), mean


def judge(scored: DataFrame, paths: DataFrame, mean: float, threshold: float = 0.5) -> DataFrame:
    """scored with host_posterior, path_posterior, score and kept. A document's own evidence is left out of both posteriors."""
    n = paths.count()
    own = _sigmoid(F.col("logit"))
    host = (F.col("hq") - own + F.col("k_host") * mean) / (F.col("hn") - 1 + F.col("k_host"))
    site = (F.col("q") - own + F.col("k_path") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("k_path"))
    score = F.when(F.col("logit") <= _WORDLESS, 0.0).otherwise(_sigmoid(F.col("logit") + _logit(F.col("path_posterior")) - _logit(F.lit(mean))))
    joined = scored.join(F.broadcast(paths) if n <= BROADCAST_GROUPS else paths, ["host", "path"])
    joined = joined.withColumn("host_posterior", host).withColumn("path_posterior", site)
    return joined.withColumn("score", score).withColumn("kept", F.col("score") >= threshold).drop("n", "q", "hn", "hq", "k_host", "k_path")


def sites(docs: DataFrame, host: str = "source", section: str = "lang") -> DataFrame:
    """docs with host and path; the path is a section of the host."""
    h = F.coalesce(F.col(host), F.lit(""))
    return docs.withColumn("host", h).withColumn("path", F.concat_ws("/", h, F.coalesce(F.col(section), F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: score and verdict of every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = written(sites(docs).select("doc_id", "host", "path", evidence(spark, model)(F.col("text")).alias("logit")), "evidence")
    paths, mean = posteriors(scored)
    return judge(scored, paths, mean).select("doc_id", "host", "path", F.col("logit").alias("doc_logit"), "host_posterior", "path_posterior", "score", "kept")


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, lang, ...) without the rejected rows. The site table is joined to the texts where they lie; the texts are not shuffled unless there are very many sites."""
    model = train(docs, labels)
    columns = docs.columns
    own = sites(docs.select(F.struct(*columns).alias("row"), "text", "source", "lang")).withColumn("logit", evidence(spark, model)(F.col("text"))).select("row", "host", "path", "logit")
    paths, mean = posteriors(own.select("host", "path", "logit"))
    return judge(own, paths, mean).where("kept").select("row.*")
