"""What the corpus kernels hold while they work and leave behind, measured in one process."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from penstock.llm import bpe, common, maxent


def test_encoder_grows_with_what_it_keeps():
    """A few pieces cost a small table; growing, and emptying at the full size, change no ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(400)) for _ in range(250)]
    enc = bpe.Encoder(path)
    enc.encode(pa.array(["a few words", "and a few more"]))
    assert sum(x.nbytes for x in vars(enc).values() if isinstance(x, np.ndarray)) < 4 << 20
    few = enc.slots
    small = bpe.Encoder(path, slots=1 << 14)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        want = [i for t in some for i in [*enc.library.encode(t, add_special_tokens=False).ids, 0]]
        assert enc.encode(pa.array(some))[0].tolist() == want
        assert small.encode(pa.array(some))[0].tolist() == want
    assert few < enc.slots < 1 << 22 and enc.n <= enc.slots * 2 // 5
    kept = np.count_nonzero(enc.keys)
    assert kept > 0.95 * enc.n
    assert small.slots == 1 << 14


def test_other_kernels_let_go_of_the_encoder():
    """A worker that turns to a kernel without tokens no longer holds the encoder of the stage before."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = bpe.encoder(path)
    common.give_back()
    assert bpe.encoder(path) is first
    assert list(common.thrifty(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not bpe._encoders


def test_new_pieces_go_to_the_library_in_portions():
    """The library's answers for all new pieces of a slice never stand together."""
    enc, asked = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    library = enc.library

    class Watched:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    enc.library = Watched()
    text = " ".join(f"w{i}" for i in range(30_000))
    assert enc.encode(pa.array([text]))[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert sum(asked) > 10_000 and max(asked) <= 4096


def test_normalisers_in_portions():
    """The edges of contexts, met once for each class before, never stand together; the sums are those of a plain loop."""
    rng = np.random.default_rng(3)
    contexts, edges = 200, 100
    first = np.arange(contexts + 1) * edges
    edge_class, edge_g = rng.integers(0, maxent.SYMBOLS, contexts * edges).astype(np.uint8), rng.random(contexts * edges)
    p = rng.random((maxent.SYMBOLS**2, maxent.SYMBOLS)).astype(np.float32)
    ctx, dense = np.repeat(np.arange(contexts), 120), rng.integers(0, maxent.SYMBOLS**2, contexts * 120)
    tracemalloc.start()
    got = maxent._added(p, dense, ctx, first, edge_class, edge_g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # all at once: 2.4 million edges, 41 to 65 bytes each
    for k in rng.integers(0, len(ctx), 300).tolist():
        e = slice(first[ctx[k]], first[ctx[k] + 1])
        assert abs(got[k] - float((p[dense[k], edge_class[e]] * edge_g[e]).sum())) < 1e-9
    none = np.zeros(0, np.int64)
    assert not len(maxent._added(p, none, none, first, edge_class, edge_g))
