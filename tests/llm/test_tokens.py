"""Token files, packing and the BPE kernel against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from penstock.llm import bpe, packing, textkit, tokenfile  # noqa: E402
from penstock.llm.common import scratch  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: A word whose complement has the same polynomial hash modulo a power of two, whatever the base.
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ROWS = [(3, "a b's  c\n\n d"), (1, None), (2, ""), (None, "no id"), (5, "word " * 3000), (4, "ties"), (6, "ties"), (6, "ties"), (7, "中文 𝔸 ́ '' 're x"), (8, "<|endoftext|> tail "), (9, "a <|endoftext|> b"), (10, "x" * 3000 + " y " + "z" * 65), (11, MORSE), (12, MORSE.translate(str.maketrans("ab", "ba")))]


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id bigint, text string, start string, _part int").repartition(3)


def test_kernel_equals_library():
    t = Tokenizer.from_file(PATH)
    e = bpe.Encoder(PATH, slots=1 << 12)
    rng = random.Random(7)
    alphabet = ["'s", "'re", "'", "  ", " ", "\n", "\t", "a", "b", "é", "1", ".", "!", "S", "ll", "ve", " '", "中", " ", "😀", "́", "٠"]
    for _ in range(20):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(200)]
        ids, off = e.encode(pa.array(texts))
        for k, x in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 31])
def test_pack_round_trip(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 4567).astype(np.uint32)
    raw = tokenfile.pack(x, width)
    assert (tokenfile.unpack(raw, width, len(x)) == x).all() and len(raw) == -(-len(x) // 32) * 4 * width


def test_pack_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        tokenfile.pack(np.array([1, 65536, 5]), 16)
    assert tokenfile.vocabulary_of(PATH) == 1 + max(Tokenizer.from_file(PATH).get_vocab().values())


def test_no_structured_collisions():
    flipped = MORSE.translate(str.maketrans("ab", "ba"))
    _, _, _, _, h = textkit.word_hashes(pa.array([f"{MORSE} {flipped} {MORSE}", MORSE]))
    assert h[0] == h[2] == h[3] != h[1]
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 200))) for _ in range(3000)]
    _, _, _, _, h = textkit.word_hashes(pa.array([" ".join(words)]))
    assert len(set(words)) == len(set(h.tolist()))


def test_files_round_trip(spark, docs):
    files = tokenfile.write(docs, PATH, scratch(spark, "t"))
    got = sorted(tuple(r) for r in tokenfile.read(files, 2).fillna(-1, ["doc_id"]).collect())
    want, at = [], 0
    for i, t in sorted(((-1 if i is None else i), t) for i, t in [(i, t or "") for i, t in ROWS]):
        ids = ids_of(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    f = tokenfile.TokenFile(files.orderBy("part").first().path)
    assert f.tokens(1, 3).tolist() == np.concatenate([f.document(k) for k in range(f.n_docs)])[1:3].tolist()


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert tokenfile.read(tokenfile.write(none, PATH, scratch(spark, "t"))).count() == 0
    assert packing.pack(none, PATH).count() == 0


def check_packing(rows, texts, window):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for i, t in texts:
        ids = ids_of(t)
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])


def test_packing_covers_every_id_once(spark, docs):
    rows = packing.pack(docs, PATH, 64, with_ids=True).collect()
    check_packing(rows, ROWS, 64)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in ROWS)
    assert all(len(r.ids) == 4 * r.length for r in rows)


def test_best_fit_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(1, 63): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        runs, n = packing.best_fit(counts, 64)
        rooms: list[int] = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [(r, i) for i, r in enumerate(rooms) if r >= length]
                if fit:
                    rooms[min(fit)[1]] -= length
                else:
                    rooms.append(64 - length)
        fill = [0] * n
        for k, (length, first, per, window, offset) in enumerate(runs):
            last = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
            for q in range(first, last):
                fill[window + (q - first) // per] += length
        assert sorted(64 - x for x in fill) == sorted(rooms)
