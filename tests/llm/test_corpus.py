"""The other corpus operators on small tables with odd rows: nulls, empties, ties, repeats, clashing columns, no rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.llm import langid, ledger, maxent, media, mixing, quality, shards
from penstock.llm.common import mod_of_id, scratch

WORD = r"[^\x20\x09-\x0D]+"
ODD = [(None, "no id", None, None), (900, None, "en", "s1"), (901, "", "de", "s1"), (902, " \n\t", None, "s2"), (903, "!!! 123 ...", "en", None), (904, "one", "en", "s1"), (905, "very long " * 4000, "en", "s1"), (905, "very long " * 4000, "en", "s1")]


def texts(n=240, seed=3):
    rng = random.Random(seed)
    stems = {"en": ["the", "of", "thing", "with", "other", "and"], "de": ["der", "schön", "nicht", "über", "ich", "und"], "fr": ["le", "être", "que", "où", "dans", "une"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(stems))
        w = [rng.choice(stems[lang]) + (rng.choice(["", "a", "ed", "xy"]) + str(rng.randint(0, 9)) * (rng.random() < 0.1)) for _ in range(rng.randint(12, 60))]
        if i % 5 == 0:
            w = [x.upper() + "!!" for x in w]
        out.append((i, " ".join(w) + ("\nsame line\nsame line" if i % 7 == 0 else ""), lang, f"s{i % 3}"))
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, "x", "y") for r in texts()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint, shard string, digest string").repartition(4)


def folded(t):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("head", [100, maxent.HEAD])
def test_base_scores(docs, head):
    out = maxent.scored(docs, mod_of_id("doc_id", 5) == 1, head).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    rows = [(d, folded(t) + [None]) for d, t, _, _ in texts()]
    count = collections.Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    want = sorted((d is None, d or 0, held(d), len(ws), sum(count[w] > 0 for w in ws), round(base(ws), 3)) for d, ws in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in out) == want
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert all(r.train_tokens == n for r in out)


@pytest.mark.parametrize(("part", "pairs"), [(maxent.PART, maxent.RANGE_PAIRS), (300, 700)])
def test_scores_by_brute_force(docs, part, pairs):
    """Every token's probability by a sum over all targets, in one process; contexts in parts and pairs in many ranges change nothing but the parts."""
    held = mod_of_id("doc_id", 5) == 1
    model, n, v = maxent.fitted(docs, held, 60, part, pairs)
    rows = docs.select("doc_id", "text", held.alias("held")).collect()
    seen = [(r, maxent.tokens(maxent.pa.array([r.text], maxent.pa.string())), None) for r in rows]
    seen = [(r, t, model.seen(t)) for r, t, _ in seen]
    counts, words = collections.Counter(), collections.Counter()
    for r, t, x in seen:
        if not r.held:
            counts.update(x.key.tolist())
            words.update(t.h.tolist())
    context = collections.defaultdict(dict)
    for key, c in counts.items():
        context[key >> 18][key & (1 << 18) - 1] = c
    all_y = np.arange(len(model.sigma))
    tilts = {}
    want = []
    for r, t, x in seen:
        total = 0.0
        for i in range(len(x.y)):
            ctx, y = int(x.key[i]) >> 18, int(x.y[i])
            inside = maxent.part_of(all_y, np.full(len(all_y), x.level[i])) == x.part[i]
            if ctx not in tilts:
                f = {k: c for k, c in context.get(ctx, {}).items() if c >= 2}
                tilt = np.zeros(len(all_y))
                if f:
                    base = model.p1[ctx & 127, model.sigma] * model.q * inside
                    base /= base.sum()
                    total_n = sum(context[ctx].values())
                    k = np.array([a for a in sorted(f) if maxent.worthwhile(np.array([f[a]]), np.array([total_n * base[a]]))[0]], int)
                    tilt[k] = maxent.pair_weights(np.zeros(len(k), int), np.array([float(f[a]) for a in k]), base[k], np.array([total_n])).astype(np.float16)
                tilts[ctx] = tilt
            p = model.p[x.context[i]].astype(float)[model.sigma] * model.q
            own = p * np.exp(tilts[ctx]) * inside
            assert 0 < p[inside].sum() <= 1 + 1e-5
            total += math.log10(own[y] / own.sum() * p[inside].sum())
            if not x.hit[i]:
                total += math.log10((words[int(t.h[i])] + 0.5) / model.mass[y - model.first_group])
        want.append((r.doc_id is None, r.doc_id or 0, len(x.y), round(total, 2)))
    out = maxent.scored(docs, held, 60, part, pairs).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in out)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) <= 0.02 + 1e-4 * abs(b[3])
    assert (model.levels.max() > 0) == (part == 300) and (model.range_bits > 0) == (part == 300)


def test_scores_do_not_depend_on_the_partitions(spark, docs):
    held = mod_of_id("doc_id", 5) == 1
    a, b = (sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in maxent.scored(x, held).collect()) for x in (docs, docs.repartition(1)))
    assert a == b


def test_pair_weights_meet_their_optimum():
    """At the optimum the expected count of a feature is its count less the penalty."""
    rng = np.random.default_rng(5)
    ctx = np.sort(rng.integers(0, 30, 200))
    n = rng.integers(2, 40, 200).astype(float)
    base = rng.random(200) / 1000
    total = np.bincount(ctx, n, 30) + rng.integers(1, 60, 30)
    w = maxent.pair_weights(ctx, n, base, total)
    p = base * np.exp(w) / (1 + np.bincount(ctx, base * np.expm1(w), 30))[ctx]
    assert np.allclose(total[ctx] * p, n - maxent.PENALTY, rtol=1e-3)


def test_model_is_a_distribution():
    rng = np.random.default_rng(0)
    p = np.exp(maxent.log_probabilities(rng.standard_normal((maxent.BUCKETS, maxent.CLASSES + maxent.SYMBOLS)), np.arange(50)))
    assert np.allclose(p.sum(axis=1), 1)


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(1)
    context = np.arange(40)
    counts = rng.poisson(0.5, (40, maxent.SYMBOLS)).astype(float)
    w = np.zeros((maxent.BUCKETS, maxent.CLASSES + maxent.SYMBOLS))
    loss = lambda w: -(counts * maxent.log_probabilities(w, context)).sum()
    assert loss(maxent.gradient_steps(w, context, counts, 30)) < loss(w)


def test_ledger(docs):
    out = ledger.ledger(docs)
    got = {(r.doc_id, r.n_words): r for r in out.collect()}
    for d, t, _, _ in texts():
        w = re.findall(WORD, t or "")
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        r = got[d, len(w)]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert bool(r.fail_bits & 1) == (len(w) < 10)
    mask = ledger.POLICIES["v2"]
    rows = {r.rule: r for r in ledger.ablations(out, mask).collect()}
    bits = [r.fail_bits & mask for r in out.collect()]
    for rule in ledger.RULES:
        assert rows[rule.name].failed == sum(b >> rule.bit & 1 for b in bits)
        assert rows[rule.name].failed_alone == sum(b == 1 << rule.bit for b in bits)
    with pytest.raises(ValueError):
        ledger.ledger(docs, (ledger.Rule(0, "a", "true"), ledger.Rule(0, "b", "true")))


def test_repeats_are_told_by_whole_hashes(spark):
    """Hashes that differ only in the bits that the packing cuts, between and beside true repeats."""
    a, b, c = 5, 5 - (1 << 63), 5 + (1 << 62)
    rows = [[a, b, a], [a, b, c, 9, 9], [b, a, 7, b, c, a, 8], [a, b, c, 1, 2, 3, 4, 5 << 1], [3, 3, 3], [1, 2], []]
    out = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, h array<bigint>").select("i", ledger._repeat_words(F.col("h")).alias("n")).collect()
    for r in out:
        n = collections.Counter(rows[r.i])
        assert r.n == len({j for i, x in enumerate(rows[r.i]) if n[x] > 1 for j in range(i, i + 5)})


def test_shards(spark, docs):
    hot = spark.createDataFrame([(10_000 + i, "hot text") for i in range(700)], "doc_id bigint, text string")
    ties = spark.createDataFrame([(20_000, "one row many times")] * 900, "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(hot).unionByName(ties)
    n = both.count()
    for k in (1, 4, 9):
        rows = shards.assign(both, k).collect()
        size, slots = collections.Counter(), collections.defaultdict(list)
        for r in rows:
            size[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert len(rows) == n and all(sorted(x) == list(range(len(x))) for x in slots.values())
        mean = sum(size.values()) / k
        largest = max(r.size for r in rows)
        assert all(abs(sum(size[i] for i in range(m)) - m * mean) <= 0.01 * mean + largest for m in range(1, k + 1))
        placed = {(r.text_crc32, r.shard) for r in rows}
        assert len(placed) <= len({t for t, _ in placed}) + 3 * k  # equal texts are cut at boundaries alone
    text = {r.doc_id: r for r in rows}
    assert text[904].text_crc32 == zlib.crc32(b"one") and text[900].size == 16 and text[900].text_crc32 == 0
    path = scratch(spark, "s")
    shards.write_shards(docs.drop("shard"), path, 3)
    assert spark.read.parquet(path).count() == docs.count()


def test_languages(spark, docs):
    model = langid.train(docs)
    out = docs.select("doc_id", "lang", langid.predictor(spark, model)(F.col("text")).alias("p")).select("doc_id", "lang", "p.*").collect()
    sure = [r for r in out if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang_pred == r.lang for r in sure) / len(sure) > 0.97
    by = {r.doc_id: r for r in out}
    assert all((by[d].lang_pred, by[d].score, by[d].rejected) == ("und", 0.0, True) for d in (900, 901, 902, 903))
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.train(docs.where("false"))
    assert {r.p.lang_pred for r in docs.select(langid.predictor(spark, nothing)(F.col("text")).alias("p")).collect()} == {"und"}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 240, 2)] + [(None, 1), (7777, None)], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality.keep(spark, docs, labels).collect()}
    good = {i for i in range(240) if i % 5}
    assert len(kept & good) >= 0.97 * len(good) and not kept & ({i for i in range(0, 240, 5)} | {900, 901, 902})
    assert quality.keep(spark, docs.where("false"), labels).count() == 0
    assert quality.keep(spark, docs, labels.where("false")).count() == docs.count() - 3


def test_posteriors_shrink(spark):
    rows = [("big", "big/a", 3.0)] * 200 + [("bad", "bad/a", -3.0)] * 200 + [("tiny", "tiny/a", -3.0)]
    paths, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, logit double"))
    p = {r.host: r.host_posterior for r in paths.collect()}
    assert p["bad"] < p["tiny"] < mean < p["big"]


def test_posteriors_by_brute_force(spark):
    """Means, strengths by nested analysis of variance, and scores, in plain Python."""
    rng = random.Random(8)
    rows = [(i, f"h{i % 7}", f"h{i % 7}/{i % 3}", rng.gauss(i % 7 - 3 + (i % 3) / 2, 1.5)) for i in range(300)] + [(900, "lone", "lone/", 2.0), (901, "h1", "h1/0", quality._WORDLESS)]
    scored = spark.createDataFrame(rows, "doc_id bigint, host string, path string, logit double").repartition(3)
    paths, mean = quality.posteriors(scored)
    got = {r.doc_id: r for r in quality.judge(scored, paths, mean).collect()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    own = {d: sig(z) for d, _, _, z in rows}
    m = sum(own.values()) / len(own)
    by_host, by_path = collections.defaultdict(list), collections.defaultdict(list)
    for d, h, p, _ in rows:
        by_host[h].append(own[d])
        by_path[h, p].append(own[d])
    avg = lambda x: sum(x) / len(x)

    def strength(groups, parent):
        n, k, parents = sum(map(len, groups.values())), len(groups), {parent(g)[0] for g in groups}
        inside = sum((x - avg(v)) ** 2 for v in groups.values() for x in v) / (n - k)
        between = sum(len(v) * (avg(v) - avg(parent(g)[1])) ** 2 for g, v in groups.items())
        effective = sum(len(v) - len(v) ** 2 / len(parent(g)[1]) for g, v in groups.items())
        spread = (between - (k - len(parents)) * inside) / effective
        return 1e4 if spread <= 0 else min(max(m * (1 - m) / spread - 1, 2.0), 1e4)

    kh = strength(by_host, lambda g: ("", list(own.values())))
    kp = strength(by_path, lambda g: (g[0], by_host[g[0]]))
    for d, h, p, z in rows:
        host = (sum(by_host[h]) - own[d] + kh * m) / (len(by_host[h]) - 1 + kh)
        site = (sum(by_path[h, p]) - own[d] + kp * host) / (len(by_path[h, p]) - 1 + kp)
        score = 0.0 if z <= quality._WORDLESS else sig(z + logit(site) - logit(m))
        assert abs(got[d].score - score) < 1e-6 and abs(got[d].host_posterior - host) < 1e-6 and got[d].kept == (score >= 0.5)


def test_rake():
    rng = np.random.default_rng(0)
    cells = rng.integers(1, 100, (3, 4, 2)).astype(float)
    goals = [np.array([0.3, 0.3, 0.4]), np.array([0.2, 0.3, 0.3, 0.2]), np.array([0.5, 0.5])]
    groups = [x.reshape(-1) for x in np.indices(cells.shape)]
    x = (mixing.rake(cells.reshape(-1), groups, goals, most=50) * cells.reshape(-1)).reshape(cells.shape)
    for axis, t in enumerate(goals):
        s = x.sum(axis=tuple(a for a in range(3) if a != axis))
        assert np.allclose(s / s.sum(), t, atol=1e-6)
    assert mixing.rake(cells.reshape(-1), groups, goals, most=1.2).max() <= 1.2


def test_mixture(spark, docs):
    out = mixing.sample(spark, docs)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert mixing.sample(spark, docs.where("false")).count() == 0
    again = mixing.mixture(docs)[0].where("u < probability")
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r.doc_id or -1 for r in again.collect())
    cells = spark.createDataFrame([("a", "x", "t0", 300), ("a", "y", "t0", 100), ("b", "x", "t0", 100), ("b", "y", "t0", 300)], "source string, lang string, topic string, n_tokens bigint")
    mix = mixing.fit(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"t0": 1.0}})
    kept = mixing.with_probability(cells, mix).withColumn("k", F.col("probability") * F.col("n_tokens"))
    total = kept.agg(F.sum("k")).first()[0]
    assert abs(kept.where("lang = 'x'").agg(F.sum("k")).first()[0] / total - 0.6) < 1e-6
    rows = {(r.dimension, r.group): r for r in mixing.shares(mix).collect()}
    assert abs(rows["lang", "x"].reached - 0.6) < 1e-6 and rows["source", "b"].target == 0.5


def test_every_group_is_raked(spark):
    """A hundred sources with a null among them, by numpy and by tables: the same weights, and tempered shares in the tail too."""
    rng = random.Random(4)
    rows = [(None if i == 0 else f"s{i}", rng.choice(["x", "y", None]), f"t{rng.randint(0, 2)}", rng.randint(0, 400)) for i in range(100) for _ in range(4)]
    counted = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens bigint")
    few = mixing.fit(counted, most=50.0, rounds=4)
    many = mixing.fit(counted, most=50.0, rounds=4, cells_in_memory=0)
    assert few.small and not many.small
    weights = lambda m: {(r.source, r.lang, r.topic): r.w for r in m.cells.collect()}
    a, b = weights(few), weights(many)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    tokens = collections.Counter()
    for s, _, _, n in rows:
        tokens[s] += n
    total = sum(n**mixing.TEMPER for n in tokens.values())
    exact = mixing.fit(counted, most=50.0)
    got = {r.group: r for r in mixing.shares(exact).where("dimension = 'source'").collect()}
    assert len(got) == sum(n > 0 for n in tokens.values())
    assert all(abs(r.reached - tokens[g] ** mixing.TEMPER / total) < 1e-4 for g, r in got.items())


def test_topics_by_all_documents(spark):
    """Three kinds of text, one of them rare, against k-means in one process from the same start."""
    kinds = [["alpha", "beta", "gamma"], ["uno", "dos", "tres"], ["red", "green", "blue"]]
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(kinds[min(2, i % 40 // 19)]) for _ in range(40)), "en", "s") for i in range(400)] + [(1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)
    bagged = mixing.written(mixing.bags(docs), "b")
    centres = mixing.topic_centres(bagged, topics=4, rounds=3)
    x = np.stack([np.frombuffer(r.x, "<f4") for r in bagged.where("n_tokens > 0").collect()]).astype(float)
    c = np.random.default_rng(7).standard_normal((4, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    want = np.vstack([x.mean(axis=0), c])
    for _ in range(3):
        y = x - want[0]
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        of = mixing.nearest(x, want)
        for k in range(4):
            if (of == k).any():
                want[k + 1] = y[of == k].sum(axis=0) / np.linalg.norm(y[of == k].sum(axis=0))
    assert np.allclose(centres, want, atol=1e-4)


def test_many_languages(spark):
    """Three hundred languages of a word each: every one can be learned and predicted."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    stems = [word() for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join([stems[i % 300]] * (5 + i // 300)), f"l{i % 300:03d}") for i in range(3000)], "doc_id bigint, text string, lang string")
    model = langid.train(docs, epochs=12)
    assert len(model.languages) == 300 and model.linear is not None
    out = docs.select("lang", langid.predictor(spark, model)(F.col("text")).alias("p")).where("p.lang_pred = lang").select("lang").distinct().count()
    assert out > 250


@pytest.mark.parametrize(("languages", "each"), [(60, 1), (1200, 6)])
def test_no_language_is_lost(spark, languages, each):
    """One text each, and more languages than a sample's share gives one to; beside a language of one text in thousands of copies."""
    rows = [(i, f"w{i % languages} " * 3 + f"x{i // languages}", f"l{i % languages:04d}") for i in range(languages * each)]
    rows += [(None, "one and the same", "copies")] * 3000 + [(None, f"another text {i}", "copies") for i in range(2)] + [(1, "", "empty"), (2, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    sample = langid._sampled(docs, 50, 50, "lang").collect()
    assert {r.lang for r in sample if not r.calibrates} == {r[2] for r in rows} - {"empty", None}
    assert len({(r.lang, r.text) for r in sample}) == len(sample) <= 2 * (languages + 1)
    if each == 1:
        assert len(langid.train(docs, epochs=1).languages) == languages + 1


def test_predictions_by_brute_force(docs):
    """Logits and scores gram by gram, in plain Python."""
    model = langid.train(docs)
    some = ["Der schöne Tag!", "of the THING", "é", "a", "1"] + [t for _, t, _, _ in texts()[:20]]
    langs, score, _ = model.predict(langid.pa.array(some))
    for t, lang, p in zip(some, langs, score, strict=True):
        if not any(c.isalpha() for c in t):
            assert (lang, p) == ("und", 0)
            continue
        raw = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in t.encode())
        n, z = len(raw), np.zeros(len(model.languages))
        at = lambda i: raw[i] if 0 <= i < n else 0x20
        for i in range(n):
            after = at(i + 2) if i + 1 < n else 0
            h = (at(i - 1) * 0x9E3779B1 + raw[i] * 0x85EBCA6B + at(i + 1) * 0xC2B2AE35) % 2**32
            for x in (h, (h + after * 0x27D4EB2F + 0x165667B1) % 2**32):
                x ^= x >> 15
                x = x * 0x2C1B3C6D % 2**32
                z += model.table[x >> (32 - 15)] / (2 * n)
        z = (z + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert lang == model.languages[int(z.argmax())] and abs(p - e.max() / e.sum()) < 1e-4


def test_media(spark, docs):
    rows, index = media.store(docs, scratch(spark, "m"))
    one = {r.digest: r for r in media.metadata(index).join(media.contents(index), "digest").collect()}
    got = sorted((r.doc_id is None, r.doc_id or 0, r.digest) for r in rows.collect())
    want = []
    for d, t, _, _ in texts():
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        digest = hashlib.sha256(pad).hexdigest()
        want.append((d is None, d or 0, digest))
        o = one[digest]
        assert (o.n_bytes, o.payload_bytes, o.tail_crc32, o.width, o.height) == (len(raw), len(pad), zlib.crc32(pad[-64:]), 64, len(pad) // 64)
        assert (o.media_bytes, o.media_sha256) == (len(media.to_png(raw)), hashlib.sha256(media.to_png(raw)).hexdigest())
    assert got == sorted(want)
    import tarfile

    shard = index.first().shard.removeprefix("file://")
    with tarfile.open(shard) as t:
        for m in t:
            data = t.extractfile(m).read()
            assert hashlib.sha256(media.from_png(data)).hexdigest() + ".png" == m.name


@pytest.mark.parametrize("run", [lambda d: maxent.scored(d, mod_of_id("doc_id", 5) == 1), ledger.ledger, lambda d: shards.assign(d, 4), lambda d: media.store(d, scratch(d.sparkSession, "e"))[0]])
def test_empty(docs, run):
    assert run(docs.where("false")).count() == 0
