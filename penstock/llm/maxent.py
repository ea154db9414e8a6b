"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (A-Z folded) and one end for each text. A token is predicted in three factors:

1. Its class: the 96 most frequent tokens are classes of their own, every other token belongs to one of 32 classes by its
   last bytes. P(class | the two classes before) is a softmax over 16 x 8, with weights of hashed features: a bias, the
   bigram, the trigram and the skip bigram that leaves one token out. The counts of (context, class) are its sufficient
   statistics, a bounded table; shards by context take gradient steps on their parts, and after each round their weights are
   averaged feature by feature, by how often each saw the feature.
2. The target within its class: each of the HEAD most frequent tokens, or one of up to 16,384 hashed groups of the others.
   Features are pairs (token before, target) of all tokens, hashed to 64 bits, that occur at least twice in training and
   clearly more often than factor 1 expects. Their number grows with the corpus. With features f the probability of a target is that of factor 1, times its share of its
   class, times exp(weight) and divided by the sum of the same over all targets, so it stays a distribution. A context's
   weights depend on that context alone, so the tasks that hold its counts take the gradient steps (with an L1 penalty).
   The targets of a context that is more frequent than PART tokens fall into parts by hash, each normalised by itself, so
   no context's pairs outgrow a task.
3. The token within a hashed group: its smoothed share. An unseen token is one more type of its group.

The features of factor 2 are too many for one machine, so they are exchanged in batches: each batch of texts sends the
sorted distinct hashes of its pairs and rare tokens, cut into ranges of hashes, with their counts in training. A range adds
up the counts, trains its contexts and answers each batch with the weights of just the pairs it sent and what it needs to
normalise them. The batch, met again with its answers, is scored with sparse numpy arrays.

Counts cover all training texts. Tokens are told apart by 64-bit hashes.

Defined results: a null or wordless text is the end alone; a null id counts as the empty text when texts are dealt into
training and held out; repeated rows are scored one by one; a very long text is a batch of its own; without training texts N
and V are 0, nothing is known and every token has the same base probability; an empty table gives an empty result; other
columns are ignored. Texts are read several times: a table that gives other rows or another order each time is an error,
write it first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, mod_of_id, slices, thrifty, written
from .textkit import mix, utf8, word_hashes

SYMBOLS, SURFACES, CLASSES = 128, 32, 16
#: Targets that are tokens of their own at most, and hashed groups of a class at most (by bits).
HEAD, GROUP_BITS = (1 << 18) - (1 << 14), 9
_TARGET_BITS = 18
BUCKETS = 1 << 12
ROUNDS, STEPS, SHARDS = 4, 40, 4
#: The end of a text, as a token.
END = np.uint64(0x0123456789ABCDEF)
_BITS = SYMBOLS.bit_length() - 1
#: Words of a partition whose counts are held before they are passed on.
_HELD = 1_000_000
#: Edges of contexts, once for each class before, that the normalisers of a batch take at once; a context has SYMBOLS at most.
_EDGES = 1 << 18
#: Text of a batch; pairs of a range, about; occurrences of a context beyond which its targets fall into parts.
BATCH_BYTES, RANGE_PAIRS, PART = 4 << 20, 1_500_000, 1 << 22
#: A pair is a feature from so many occurrences on, if the likelihood gains so much by it (nats); its weight is the maximum-likelihood one under this L1 penalty.
LEAST, GAIN, PENALTY = 2, 4.0, 0.75


@dataclass
class Tokens:
    """The tokens of some texts: hashes, surface class of each, texts' first tokens (one more entry at the end)."""

    h: np.ndarray
    surface: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    buf, _, e, first, h = word_hashes(texts)
    last = buf[e - 1].astype(np.uint64)
    before = buf[np.maximum(e - 2, 0)].astype(np.uint64)
    surface = (mix(last * np.uint64(257) + before) % np.uint64(SURFACES)).astype(np.uint8)
    ends = first[1:]
    return Tokens(np.insert(h, ends, END), np.insert(surface, ends, 0), first + np.arange(len(first)))


@dataclass
class Head:
    """The most frequent tokens, sorted by hash: count, and symbol (own, or of the surface class)."""

    h: np.ndarray
    c: np.ndarray
    symbol: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token or 0, whether it is there)."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def symbols(self, t: Tokens) -> np.ndarray:
        """Symbol of each token; only tokens with a symbol of their own need to be found."""
        own = self.symbol < SYMBOLS - SURFACES
        h, s = self.h[own], self.symbol[own]
        out = (t.surface + (SYMBOLS - SURFACES)).astype(np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, t.h), len(h) - 1)
            hit = h[at] == t.h
            out[hit] = s[at[hit]]
        return out


def contexts(symbols: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """(symbol two before, symbol before) of each token as one number; before a text stand ends."""
    s1, s2 = np.full(len(symbols), end), np.full(len(symbols), end)
    s1[1:] = symbols[:-1]
    s2[2:] = symbols[:-2]
    starts = first[:-1]
    s1[starts] = end
    s2[starts] = end
    second = starts + 1
    second = second[second < first[1:]]
    s2[second] = end
    return s2 << _BITS | s1


def feature_ids(context: np.ndarray) -> np.ndarray:
    """Buckets of the features of each context: bias, bigram, skip bigram, trigram."""
    c = context.astype(np.uint64)
    s2, s1 = c >> np.uint64(_BITS), c & np.uint64(SYMBOLS - 1)
    h = [mix(s1 + np.uint64(0x1000)), mix(s2 + np.uint64(0x2000)), mix(c + np.uint64(0x100000))]
    return np.stack([np.zeros(len(c), np.int64), *[1 + (x % np.uint64(BUCKETS - 1)).astype(np.int64) for x in h]], axis=1)


#: Class of a symbol: own symbols by frequency in runs, surface classes by number.
CLASS_OF = np.arange(SYMBOLS) * CLASSES // SYMBOLS
_PER = SYMBOLS // CLASSES


def log_probabilities(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log P(symbol | context), a row for each context. weights: BUCKETS x (CLASSES + SYMBOLS)."""
    z = weights[feature_ids(context)].sum(axis=1, dtype=np.float64)
    a, b = z[:, :CLASSES], z[:, CLASSES:].reshape(-1, CLASSES, _PER)
    soft = lambda x: x - (np.log(np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)) + x.max(axis=-1, keepdims=True))
    return (soft(a)[:, :, None] + soft(b)).reshape(-1, SYMBOLS)


def gradient_steps(weights: np.ndarray, context: np.ndarray, counts: np.ndarray, steps: int, rate: float = 0.3, ridge: float = 1e-6) -> np.ndarray:
    """AdaGrad steps on one shard: counts[i, s] times symbol s followed context[i]."""
    w = weights.astype(np.float64)
    f = feature_ids(context)
    total = counts.sum()
    by_class = counts.reshape(-1, CLASSES, _PER).sum(axis=2)
    n = by_class.sum(axis=1)
    seen = np.full((BUCKETS, 1), 1e-10)
    runs = []  # of each feature: contexts in order of bucket, first of each bucket, buckets
    for k in range(f.shape[1]):
        order = np.argsort(f[:, k], kind="stable")
        own, first = np.unique(f[order, k], return_index=True)
        runs.append((order, first, own))
    for _ in range(steps):
        z = w[f].sum(axis=1)
        a, b = z[:, :CLASSES], z[:, CLASSES:].reshape(-1, CLASSES, _PER)
        pa_ = np.exp(a - a.max(axis=1, keepdims=True))
        pa_ /= pa_.sum(axis=1, keepdims=True)
        pb = np.exp(b - b.max(axis=2, keepdims=True))
        pb /= pb.sum(axis=2, keepdims=True)
        g = np.concatenate([n[:, None] * pa_ - by_class, (by_class[:, :, None] * pb).reshape(-1, SYMBOLS) - counts], axis=1) / total
        grad = np.zeros_like(w)
        for order, first, own in runs:
            grad[own] += np.add.reduceat(g[order], first, axis=0)
        grad += ridge * w
        seen += (grad * grad).mean(axis=1, keepdims=True)
        w -= rate * grad / np.sqrt(seen)
    return w


def _vocabulary(training: DataFrame) -> DataFrame:
    """h, c of every distinct token, and its surface class. Counts are added up within tasks first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            return u, s[at], np.bincount(back, c).astype(np.int64)

        def out(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["h", "surface", "c"])

        for batch in batches:
            for s in slices(batch, 0):
                t = tokens(s.column(0))
                h, at, c = np.unique(t.h, return_index=True, return_counts=True)
                held.append((h, t.surface[at], c))
                if sum(len(x[0]) for x in held) > _HELD:
                    held = [added()]
                    if len(held[0][0]) > _HELD // 2:
                        yield out(held.pop())
        if held:
            yield out(added())

    return training.select("text").mapInArrow(thrifty(part), "h bigint, surface int, c bigint").groupBy("h").agg(F.min("surface").alias("surface"), F.sum("c").alias("c"))


def _statistics(training: DataFrame, head, end: int) -> DataFrame:
    """context, symbol, n: at most SYMBOLS ** 3 rows, counted within tasks first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for s in slices(batch, 0):
                t = tokens(s.column(0))
                y = head.value.symbols(t)
                code, c = np.unique(contexts(y, t.first, end) << _BITS | y, return_counts=True)
                n[code] += c
        code = np.flatnonzero(n)
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array((code >> _BITS).astype(np.int32)), pa.array((code & (SYMBOLS - 1)).astype(np.int32)), pa.array(n[code])], names=["context", "symbol", "n"])

    return training.select("text").mapInArrow(thrifty(part), "context int, symbol int, n bigint").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def _round(shared):
    def steps(table: pa.Table) -> pa.Table:
        context, symbol, n = (table.column(c).to_numpy() for c in ("context", "symbol", "n"))
        own, at = np.unique(context, return_inverse=True)
        counts = np.zeros((len(own), SYMBOLS))
        np.add.at(counts, (at, symbol), n)
        w = gradient_steps(shared.value, own, counts, STEPS)
        seen = np.zeros(BUCKETS)
        np.add.at(seen, feature_ids(own).reshape(-1), np.repeat(counts.sum(axis=1), 4))
        k = np.flatnonzero(seen)
        shard = np.full(len(k), table.column("shard")[0].as_py(), np.int32)
        return pa.table({"shard": shard, "k": k.astype(np.int32), "n": seen[k], "w": pa.array([r.astype("<f4").tobytes() for r in w[k]], pa.binary())})

    return steps


def _train(stats: DataFrame, rounds: int = ROUNDS, shards: int = SHARDS) -> np.ndarray:
    """Weights of factor 1. stats: a written table. The shard is a function of the context, so the result doesn't depend on the cluster. A round's answer has a row for each feature that a shard saw; features and shards are bounded."""
    spark = stats.sparkSession
    width = CLASSES + SYMBOLS
    dealt = stats.withColumn("shard", F.pmod(F.xxhash64("context"), F.lit(shards)).cast("int")).repartition(8 * shards, "shard")
    weights = np.zeros((BUCKETS, width), np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        rows = dealt.groupBy("shard").applyInArrow(_round(shared), "shard int, k int, n double, w binary").toArrow().sort_by([("k", "ascending"), ("shard", "ascending")])
        k, n = rows.column("k").to_numpy(), rows.column("n").to_numpy()
        if not len(k):
            return weights
        w = np.frombuffer(b"".join(rows.column("w").to_pylist()), "<f4").reshape(-1, width)
        total, mass = np.zeros((BUCKETS, width)), np.zeros(BUCKETS)
        np.add.at(total, k, w * n[:, None])
        np.add.at(mass, k, n)
        weights = np.where(mass[:, None] > 0, total / np.maximum(mass, 1)[:, None], weights).astype(np.float32)
    return weights


@dataclass
class Model:
    """What every task needs. Targets: head tokens by place, then the hashed groups. p: P(class | two classes before). levels: how many bits of parts the contexts of each head token have; q_parts: by that number, the share of each class's targets in each part."""

    head: Head
    end: int
    group_bits: int
    sigma: np.ndarray  # class of each target
    q: np.ndarray  # its share of the class
    mass: np.ndarray  # of each hashed group
    levels: np.ndarray
    q_parts: dict[int, np.ndarray]
    range_bits: int
    p: np.ndarray | None = None
    p1: np.ndarray | None = None  # P(class | class before)

    @property
    def first_group(self) -> int:
        return len(self.head.h)

    def hot(self, names: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bits of parts, part, its place in `names`) of the contexts in parts among ascending `names`."""
        for k in np.flatnonzero(self.levels).tolist():
            level = int(self.levels[k])
            part = np.arange(1 << level)
            ctx = self.context_hash(np.full(len(part), self.head.h[k]), np.full(len(part), level), part) >> np.uint64(25) << np.uint64(7) | np.uint64(self.head.symbol[k])
            at = np.minimum(np.searchsorted(names, ctx), max(len(names) - 1, 0))
            for i in np.flatnonzero(names[at] == ctx).tolist():
                yield level, int(part[i]), at[i]

    @staticmethod
    def context_hash(before: np.ndarray, level: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mix(before + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def seen(self, t: Tokens) -> Seen:
        u, back = np.unique(t.h, return_inverse=True)
        at, hit = self.head.find(u)
        at, hit = at[back], hit[back]
        group = t.surface.astype(np.int64) << self.group_bits | (mix(t.h) & np.uint64((1 << self.group_bits) - 1)).astype(np.int64)
        y = np.where(hit, at, self.first_group + group)
        before = np.empty_like(t.h)
        before[1:] = t.h[:-1]
        before[t.first[:-1]] = END
        context = contexts(self.sigma[y], t.first, self.end)
        level = np.zeros(len(y), np.int64)
        if self.levels.any():
            place, known = self.head.find(before)
            level = np.where(known, self.levels[place], 0)
        part = part_of(y, level)
        ctx = self.context_hash(before, level, part)
        key = (ctx >> np.uint64(25)) << np.uint64(25) | (context & (SYMBOLS - 1)).astype(np.uint64) << np.uint64(_TARGET_BITS) | y.astype(np.uint64)
        return Seen(y, hit, at, context, key, level, part)


@dataclass
class Seen:
    """Of each token: target, whether and where it is in the head, classes before, key of the pair, parts of the context (bits) and the target's."""

    y: np.ndarray
    hit: np.ndarray
    at: np.ndarray
    context: np.ndarray
    key: np.ndarray
    level: np.ndarray
    part: np.ndarray


def part_of(y: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Part of a target in a context with 2 ** level parts."""
    return (mix(y.astype(np.uint64) + np.uint64(0xA5A5)) & ((np.uint64(1) << level.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def pair_weights(ctx: np.ndarray, n: np.ndarray, base: np.ndarray, total: np.ndarray, steps: int = 12) -> np.ndarray:
    """Weights of features. ctx: number of each feature's context, ascending; n: its count; base: its probability without features; total: count of each context. Newton steps on the log likelihood less PENALTY * weight, whose curvature within a context is a diagonal less an outer product."""
    goal = np.maximum(n - PENALTY, 1e-9)
    w = np.maximum(np.log(goal / (total[ctx] * base)), 0.0)
    for _ in range(steps):
        tilted = base * np.exp(w)
        z = 1.0 + np.bincount(ctx, tilted - base, len(total))
        p = tilted / z[ctx]
        slope = goal - total[ctx] * p
        free = (w > 0) | (slope > 0)
        rest = np.maximum(1.0 - np.bincount(ctx, p * free, len(total)), 1e-6)
        together = np.bincount(ctx, slope * free, len(total)) / (np.maximum(total, 1) * rest)
        w = np.where(free, np.maximum(w + np.clip(slope / (total[ctx] * p) + together[ctx], -2.0, 2.0), 0.0), 0.0)
    return w


def worthwhile(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Pairs that the likelihood gains by, counted n times where `expected` are expected."""
    return (n > expected) & (n * np.log(n / expected) - (n - expected) >= GAIN)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 4).T).tobytes(), codec="zstd", asbytes=True)


def _from_planes(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(_opened(raw, "u1", 4 * n).reshape(4, n).T).view(kind).reshape(-1)


def _packed(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers as compressed differences, byte by byte of all."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _opened(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, np.dtype(kind).itemsize * n, codec="zstd", asbytes=True), kind)


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges that hold some of the ascending keys, first key of each and the end)."""
    r = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    at = np.flatnonzero(np.diff(r, prepend=r[:1] + np.uint64(1))) if len(r) else np.zeros(0, np.int64)
    return r[at].astype(np.int64), np.append(at, len(keys))


def _batches(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(number of the batch, batch of doc_id, held_out, text) -> record batches. The number is a function of the partition, the place in it and the content."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 20
        for batch in batches:
            for s in slices(batch, 2, BATCH_BYTES):
                buf, off = utf8(s.column(2))
                mark = hashlib.blake2b(buf, digest_size=8)
                mark.update(off)
                mark.update(np.asarray(s.column(0).fill_null(-1)))
                mark.update(k.to_bytes(8, "little"))
                k += 1
                yield from make(int.from_bytes(mark.digest(), "little", signed=True), s)

    return docs.mapInArrow(thrifty(part), schema)


_SENT = "batch bigint, kind int, range bigint, n int, keys binary, counts binary"
_ANSWERED = "batch bigint, kind int, range bigint, n int, values binary, contexts int, edges int, at binary, class binary, g binary"
PAIRS, WORDS = 0, 1


def _sent(docs: DataFrame, shared) -> DataFrame:
    """The pairs and the rare tokens of every batch, a row for each range that holds some: keys, and how often they occur in training."""
    names = [c.split()[0] for c in _SENT.split(", ")]

    def make(number: int, s: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        t = tokens(s.column(2))
        x = model.seen(t)
        learned = np.repeat(~s.column(1).to_numpy(zero_copy_only=False), np.diff(t.first))
        rows: list[tuple] = []
        for kind, key, use in ((PAIRS, x.key, learned), (WORDS, t.h[~x.hit], learned[~x.hit])):
            u, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, use, len(u)).astype("<u4")
            r, at = _ranges(u, model.range_bits)
            rows += [(number, kind, k, b - a, _packed(u[a:b]), _small(n[a:b])) for k, a, b in zip(r.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    return _batches(docs, make, _SENT)


def _answered(sent: DataFrame, shared) -> DataFrame:
    """For each row of _sent what its batch needs: for rare tokens their counts, for pairs the weights, and for the contexts that have features, by class, what these add to the class's mass."""

    def answer(table: pa.Table) -> pa.Table:
        give_back()  # of the range before
        model = shared.value
        kind = table.column("kind")[0].as_py()
        sizes = table.column("n").to_pylist()
        keys = [_unpacked(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
        counts = np.concatenate([_opened(c, "<u4", n) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        u, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, counts, len(u)).astype(np.int64)
        none = [b""] * len(sizes)
        out = {"batch": table.column("batch"), "kind": table.column("kind"), "range": table.column("range"), "n": table.column("n")}
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        mine = [back[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if kind == WORDS:
            values = [_small(n[i].astype("<u4")) for i in mine]
            zero = np.zeros(len(sizes), np.int32)
            return pa.table({**out, "values": pa.array(values, pa.binary()), "contexts": zero, "edges": zero, "at": pa.array(none, pa.binary()), "class": pa.array(none, pa.binary()), "g": pa.array(none, pa.binary())})
        names, ctx = np.unique(u >> np.uint64(_TARGET_BITS), return_inverse=True)
        total = np.bincount(ctx, n, len(names))
        y = (u & np.uint64((1 << _TARGET_BITS) - 1)).astype(np.int64)
        before = (names & np.uint64(SYMBOLS - 1)).astype(np.int64)
        f = np.flatnonzero(n >= LEAST)
        share = np.ones(len(names))
        for level, part, at in model.hot(names):
            share[at] = model.p1[before[at]] @ model.q_parts[level][part]
        base = np.maximum(model.p1[before[ctx[f]], model.sigma[y[f]]] * model.q[y[f]] / share[ctx[f]], 1e-300)
        use = worthwhile(n[f], total[ctx[f]] * base)
        f, base = f[use], base[use]
        weight = np.zeros(len(u), "<f2")
        weight[f] = pair_weights(ctx[f], n[f].astype(float), base, total)
        f = f[weight[f] > 0]
        # One entry for each context and class with features.
        edge, which = np.unique(ctx[f] * SYMBOLS + model.sigma[y[f]], return_inverse=True)
        g = np.bincount(which, model.q[y[f]] * np.expm1(weight[f].astype(np.float64)), len(edge))
        edge_ctx, first = edge // SYMBOLS, np.searchsorted(edge // SYMBOLS, np.arange(len(names) + 1))
        values, contexts_, edges, at_, class_, g_ = [], [], [], [], [], []
        for i in mine:
            own = np.unique(ctx[i])
            size = first[own + 1] - first[own]
            e = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            values.append(_small(weight[i]))
            contexts_.append(len(own))
            edges.append(len(e))
            at_.append(_planes(np.diff(np.searchsorted(own, edge_ctx[e]), prepend=0).astype("<u4")))
            class_.append(_small((edge[e] % SYMBOLS).astype(np.uint8)))
            g_.append(_planes(g[e].astype("<f4").view("<u4") & np.uint32(0xFFFFFF00)))  # 16 bits of mantissa
        blobs = lambda x: pa.array(x, pa.binary())
        return pa.table({**out, "values": blobs(values), "contexts": np.array(contexts_, np.int32), "edges": np.array(edges, np.int32), "at": blobs(at_), "class": blobs(class_), "g": blobs(g_)})

    return sent.groupBy("kind", "range").applyInArrow(answer, _ANSWERED)


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _added(p: np.ndarray, dense: np.ndarray, ctx: np.ndarray, first: np.ndarray, edge_class: np.ndarray, edge_g: np.ndarray, held: int = _EDGES) -> np.ndarray:
    """For each pair of classes before (dense) and context (ctx) the sum over the context's edges of P(class | classes before) * g. A context's edges are met once for each pair, so they are taken in portions of about `held`."""
    size = first[ctx + 1] - first[ctx]
    ends, out, a = np.cumsum(size), np.zeros(len(ctx)), 0
    while a < len(ctx):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + held, "right")))
        n = size[a:b]
        own = np.repeat(np.arange(b - a), n)
        e = np.repeat(first[ctx[a:b]] - (np.cumsum(n) - n), n) + np.arange(len(own))
        out[a:b] = np.bincount(own, p[dense[a:b][own], edge_class[e]] * edge_g[e], b - a)
        a = b
    return out


def _score(model: Model, space: float, s: pa.RecordBatch, answers: pa.Table) -> pa.Table:
    """The scores of one batch."""
    t = tokens(s.column(2))
    x = model.seen(t)
    rows = {(r["kind"], r["range"]): r for r in answers.to_pylist()}

    def expected(kind: int, keys: np.ndarray) -> list[dict]:
        r, at = _ranges(keys, model.range_bits)
        found = [rows[kind, k] for k in r.tolist()]
        if [f["n"] for f in found] != np.diff(at).tolist():
            raise RuntimeError("the texts have changed between two readings")
        return found

    u, back = np.unique(t.h[~x.hit], return_inverse=True)
    counts = np.concatenate([_opened(r["values"], "<u4", r["n"]) for r in expected(WORDS, u)] or [np.zeros(0, "<u4")])[back].astype(float)
    pairs, back = np.unique(x.key, return_inverse=True)
    found = expected(PAIRS, pairs)
    weight = np.concatenate([_opened(r["values"], "<f2", r["n"]) for r in found]).astype(float)[back]
    _, ctx = np.unique(pairs >> np.uint64(_TARGET_BITS), return_inverse=True)
    before = np.cumsum([0] + [r["contexts"] for r in found])
    edge_ctx = np.concatenate([np.cumsum(_from_planes(r["at"], "<u4", r["edges"]), dtype=np.int64) + b for r, b in zip(found, before[:-1].tolist(), strict=True)])
    edge_class = np.concatenate([_opened(r["class"], "u1", r["edges"]) for r in found])
    edge_g = np.concatenate([_from_planes(r["g"], "<f4", r["edges"]) for r in found]).astype(float)
    first = np.searchsorted(edge_ctx, np.arange(int(before[-1]) + 1))
    # Normalisers, one for each context and class before it that occur together.
    code, which = np.unique(ctx[back] << _BITS | x.context >> _BITS, return_inverse=True)
    one = np.zeros(len(code), np.int64)
    one[which] = np.arange(len(which))
    c, dense = code >> _BITS, x.context[one]
    added = _added(model.p, dense, c, first, edge_class, edge_g)
    share = np.ones(len(code))
    for k in np.flatnonzero(x.level[one]).tolist():
        share[k] = model.p[dense[k]].astype(float) @ model.q_parts[int(x.level[one[k]])][x.part[one[k]]]
    z = (1.0 + added / share)[which]
    lp = np.log10(model.p[x.context, model.sigma[x.y]].astype(float) * model.q[x.y] / z) + weight / np.log(10)
    c = np.zeros(len(x.y))
    c[x.hit] = model.head.c[x.at[x.hit]]
    c[~x.hit] = counts
    lp[~x.hit] += np.log10((counts + 0.5) / model.mass[x.y[~x.hit] - model.first_group])
    add = lambda v: np.add.reduceat(v, t.first[:-1])  # noqa: E731  every text has a token
    return pa.table({"doc_id": s.column(0), "held_out": s.column(1), "n_tokens": np.diff(t.first), "n_known": add((c > 0).astype(np.int64)), "base_score": add(np.log10((c + 0.5) / space)), "score": add(lp)})


def _model(vocabulary: DataFrame, head_size: int, part: int, range_pairs: int) -> tuple[Model, int, int]:
    """(targets and their shares, N, V)."""
    big = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(big[0]), int(big[1])
    top = vocabulary.orderBy(F.desc("c"), "h").limit(head_size).toArrow()
    h, c, surface = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy(), top.column("surface").to_numpy()
    symbol = surface.astype(np.int64) + (SYMBOLS - SURFACES)
    own = SYMBOLS - SURFACES
    symbol[:own] = np.arange(min(own, len(symbol)))
    end = int(np.flatnonzero(h == END)[0]) if (h == END).any() else own
    if own <= end < len(h):  # the end has a class of its own whatever its count
        symbol[end], symbol[own - 1] = own - 1, surface[own - 1] + own
    end = int(symbol[end]) if len(symbol) and (h == END).any() else own - 1
    order = np.argsort(h)
    head = Head(h[order], c[order], symbol[order])
    group_bits = min(GROUP_BITS, max(0, (v // (SURFACES * 64)).bit_length()))
    groups = SURFACES << group_bits
    mass = np.full(groups, 0.5)  # one unseen type
    # A row for each of at most SURFACES << GROUP_BITS groups; the head's tokens are taken out again.
    mixed = vocabulary.select("h", "c", "surface").mapInArrow(_grouped(group_bits), "g int, c double").groupBy("g").agg(F.sum("c").alias("c"))
    for r in mixed.collect():
        mass[r.g] += r.c
    mine = surface[order].astype(np.int64) << group_bits | (mix(head.h) & np.uint64((1 << group_bits) - 1)).astype(np.int64)
    np.subtract.at(mass, mine, head.c + 0.5)
    mass = np.maximum(mass, 0.5)
    sigma = np.concatenate([head.symbol, (np.arange(groups) >> group_bits) + own])
    weight = np.concatenate([head.c + 0.5, mass])
    whole = np.bincount(sigma, weight, SYMBOLS)
    q = weight / whole[sigma]
    levels = np.array([max(0, (int(x) - 1).bit_length() - (part - 1).bit_length()) if x > part else 0 for x in head.c.tolist()], np.int64)
    q_parts = {}
    for level in sorted(set(levels[levels > 0].tolist())):
        of = part_of(np.arange(len(sigma)), np.full(len(sigma), level))
        q_parts[level] = np.bincount(of << _BITS | sigma, q, SYMBOLS << level).reshape(1 << level, SYMBOLS)
    range_bits = max(0, (max(n, 1) * 5 // 4 // range_pairs).bit_length())
    return Model(head, end, group_bits, sigma, q, mass, levels, q_parts, range_bits), n, v


def _grouped(bits: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SURFACES << bits)
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            g = batch.column("surface").to_numpy().astype(np.int64) << bits | (mix(h.copy()) & np.uint64((1 << bits) - 1)).astype(np.int64)
            total += np.bincount(g, batch.column("c").to_numpy() + 0.5, len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["g", "c"])

    return part


def _class_marginal(stats: DataFrame, p: np.ndarray) -> np.ndarray:
    """P(class | class before) over the contexts seen in training. stats: at most SYMBOLS ** 2 contexts."""
    seen = np.full(SYMBOLS**2, 1e-3)
    for r in stats.groupBy("context").agg(F.sum("n").alias("n")).collect():
        seen[r.context] += r.n
    out = np.zeros((SYMBOLS, SYMBOLS))
    np.add.at(out, np.arange(SYMBOLS**2) & (SYMBOLS - 1), p * seen[:, None])
    return out / out.sum(axis=1, keepdims=True)


def fitted(docs: DataFrame, held_out, head_size: int = HEAD, part: int = PART, range_pairs: int = RANGE_PAIRS) -> tuple[Model, int, int]:
    """(factor 1 and the targets, N, V) of the texts that may be learned from."""
    training = docs.where(~held_out)
    vocabulary = written(_vocabulary(training), "vocabulary")
    model, n, v = _model(vocabulary, head_size, part, range_pairs)
    stats = written(_statistics(training, docs.sparkSession.sparkContext.broadcast(model.head), model.end), "statistics")
    weights = _train(stats)
    p = np.exp(np.concatenate([log_probabilities(weights, x) for x in np.split(np.arange(SYMBOLS**2), 16)]))
    model.p, model.p1 = p.astype(np.float32), _class_marginal(stats, p)
    return model, n, v


def scored(docs: DataFrame, held_out, head_size: int = HEAD, part: int = PART, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """docs: doc_id, text. held_out: a column, true for texts that aren't learned from. Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    model, n, v = fitted(docs, held_out, head_size, part, range_pairs)
    shared, space = spark.sparkContext.broadcast(model), n + 0.5 * (v + 1)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")

    def whole(number: int, s: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, s.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(s)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "rows"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for raw in texts.column("rows").to_pylist():
            for s in pa.ipc.open_stream(raw):
                out.append(_score(shared.value, space, s, answers))
        give_back()
        return pa.concat_tables(out) if out else pa.table({c.split()[0]: [] for c in _SCORES.split(", ")})

    texts = _batches(own, whole, "batch bigint, rows binary").groupBy("batch")
    rows = texts.cogroup(_answered(_sent(own, shared), shared).groupBy("batch")).applyInArrow(score, _SCORES)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document scored by the model of four fifths of them."""
    return scored(documents(spark, sf_dir), mod_of_id("doc_id", 5) == 1)
