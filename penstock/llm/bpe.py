"""Byte-level BPE ids for whole Arrow columns, by the tokenizers library, with every distinct piece of text encoded once.

The library splits a text into pieces by the pattern of its byte-level pre-tokenizer and encodes each piece alone. Here
the pieces are found for a whole buffer at once in numpy, looked up by hash in a bounded table, and only pieces not seen
before go to the library. A text with characters whose class may differ between Unicode versions goes to the library whole,
and so does one with the string of an added token, which the library takes out before it looks for pieces. Pieces beyond
LONG bytes are encoded each time; shorter ones are told apart by a hash of 64 bits.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from .common import CACHES
from .textkit import span_hash, utf8

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: The white space of the pattern, and the ranges of code points whose class all Unicode versions in use agree on.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_STABLE = [(0x0000, 0x052F), (0x2000, 0x206F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
#: Bytes of a piece beyond which it isn't kept in the table.
LONG = 64
#: Ids that the table may hold.
ARENA = 1 << 24
#: Slots that a table starts with; their number is a power of two.
_FEW = 1 << 16
#: New pieces that go to the library at once.
_PORTION = 4096
_SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")

_classes: np.ndarray | None = None
_encoders: dict = {}
CACHES.append(_encoders)


def _class_table() -> np.ndarray:
    """Class of every code point; bit 7: not stable."""
    global _classes
    if _classes is None:
        t = np.full(0x110000, 0x80, np.uint8)
        for a, b in _STABLE:
            t[a : b + 1] = [{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(a, b + 1)]
        t[[c for c in _WHITE if t[c] < 0x80]] = _SPACE
        _classes = t
    return _classes


def encoder(path: str, end_id: int | None = 0) -> Encoder:
    """One encoder for each process, so its table outlives a task; kernels that encode nothing let go of it."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each piece, first piece of each text, texts to leave to the library)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64), np.zeros(len(off) - 1, bool)
    if buf.max() < 0x80:
        at, cps = None, buf
        doc = off
    else:
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        doc = np.searchsorted(at, off)
    cls = _class_table()[cps]
    odd = np.zeros(len(doc) - 1, bool)
    if (cls & 0x80).any():
        odd[np.unique(np.searchsorted(doc, np.flatnonzero(cls & 0x80), "right") - 1)] = True
        cls = cls & 0x7F
    n = len(cps)
    opens = np.zeros(n + 1, bool)
    opens[doc] = True
    opens = opens[:n]
    space = cls == _SPACE
    start = opens.copy()
    start[1:] |= cls[1:] != cls[:-1]
    # The last of a run of white space before something else is a piece of its own, or the blank in front of that piece.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:]
    start |= last
    blank = last & (cps == 0x20)
    follows = np.zeros(n, bool)
    follows[1:] = blank[:-1]
    start &= ~follows
    quotes = np.flatnonzero(cps == 0x27)
    if len(quotes):
        ends = doc[np.searchsorted(doc, quotes, "right")]
        for q, end in zip(quotes.tolist(), ends.tolist(), strict=True):
            if not opens[q] and (cls[q - 1] == _OTHER or cps[q - 1] == 0x20):
                continue
            tail = "".join(map(chr, cps[q + 1 : min(q + 3, end)].tolist()))
            size = next((len(x) for x in _SUFFIXES if tail.startswith(x)), 0)
            if size:
                start[q], start[q + 1] = True, False
                if q + 1 + size < end:
                    start[q + 1 + size] = True
    s = np.flatnonzero(start)
    return (s if at is None else at[s]), np.searchsorted(s, doc), odd


class Encoder:
    """slots: size of the table at most. It starts with _FEW and grows when two fifths full; at its full size, or when it holds ARENA ids, it is emptied instead, so its memory doesn't grow with the vocabulary."""

    def __init__(self, path: str, end_id: int | None = 0, slots: int = 1 << 22):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.library.get_added_tokens_decoder().values() if x.content]
        self.end_id = end_id
        self.most = slots
        self.clear()

    def clear(self) -> None:
        self.slots = min(_FEW, self.most)
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.arena = np.zeros(1 << 18, np.uint32)
        self.n, self.used = 0, 0
        self._add([[self.end_id]] if self.end_id is not None else [[]])

    def _add(self, lists: list[list[int]]) -> np.ndarray:
        """Entries for lists of ids."""
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        while self.n + len(lists) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.arena):
            self.arena = np.resize(self.arena, 2 * len(self.arena))
        at = np.arange(self.n, self.n + len(lists))
        self.size[at] = sizes
        self.first[at] = self.used + np.cumsum(sizes) - sizes
        self.arena[self.used : self.used + len(ids)] = ids
        self.n += len(lists)
        self.used += len(ids)
        return at

    def _slots(self, h: np.ndarray):
        mask = np.uint64(self.slots - 1)
        for shift in (0, 20, 42):
            yield ((h >> np.uint64(shift)) & mask).astype(np.int64)

    def _put(self, new: np.ndarray, made: np.ndarray) -> None:
        """Entries under distinct hashes; what finds no free slot is left out."""
        rest = np.arange(len(new))
        for slot in self._slots(new):
            sl = slot[rest]
            free = self.keys[sl] == 0
            sl, took = sl[free], rest[free]
            sl, one = np.unique(sl, return_index=True)
            took = took[one]
            self.keys[sl] = new[took]
            self.entry[sl] = made[took]
            left = np.ones(len(new), bool)
            left[took] = False
            rest = rest[left[rest]]
            if not len(rest):
                break

    def _grow(self) -> None:
        full = np.flatnonzero(self.keys)
        keys, entry = self.keys[full], self.entry[full]
        while self.slots < self.most and self.n > self.slots // 5:
            self.slots *= 2
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self._put(keys, entry)

    def _entries(self, h: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        out[e - s > LONG] = 0
        open_ = None
        for slot in self._slots(h):
            if open_ is None:
                hit = (self.keys[slot] == h) & (out < 0)
                out[hit] = self.entry[slot[hit]]
            else:
                sl = slot[open_]
                hit = self.keys[sl] == h[open_]
                out[open_[hit]] = self.entry[sl[hit]]
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                return out
        new, which, back = np.unique(h[open_], return_index=True, return_inverse=True)
        at = open_[which]
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
        # In portions: the library's answer holds far more of a piece than its ids.
        ids = [x.ids for k in range(0, len(texts), _PORTION) for x in self.library.encode_batch_fast(texts[k : k + _PORTION], add_special_tokens=False)]
        made = self._add(ids)
        out[open_] = made[back]
        if self.slots < self.most and self.n > self.slots * 2 // 5:
            self._grow()
        self._put(new, made)
        return out

    def _with_added(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts with the string of an added token."""
        out, raw = np.zeros(len(off) - 1, bool), buf.tobytes()
        for x in self.added:
            at = raw.find(x)
            while at >= 0:
                out[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(x, at + 1)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with end_id behind it; offsets). A null text is empty."""
        buf, off = utf8(texts)
        if self.used > ARENA or self.n > self.slots * 2 // 5:
            if self.used > ARENA or self.slots >= self.most:
                self.clear()
            else:
                self._grow()
        s, first, odd = pieces(buf, off)
        e = np.append(s[1:], len(buf)) if len(s) else s
        odd |= self._with_added(buf, off)
        ent = self._entries(span_hash(buf, s, e), buf, s, e) if len(s) else np.zeros(0, np.int64)
        long = np.flatnonzero(e - s > LONG)
        if len(long):
            spans = [buf[a:b].tobytes().decode("utf-8") for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)]
            ent[long] = self._add([x.ids for x in self.library.encode_batch_fast(spans, add_special_tokens=False)])
        if odd.any():  # their pieces give way to one entry that the library made
            drop = np.zeros(len(ent), bool)
            for d in np.flatnonzero(odd).tolist():
                text = buf[off[d] : off[d + 1]].tobytes().decode("utf-8")
                drop[first[d] + 1 : first[d + 1]] = True
                ent[first[d]] = self._add([self.library.encode(text, add_special_tokens=False).ids])[0]
            before = np.concatenate([[0], np.cumsum(~drop)])
            ent, first = ent[~drop], before[first]
        ent = np.insert(ent, first[1:], 0)
        first = first + np.arange(len(first))
        size = self.size[ent].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.arena[np.repeat(self.first[ent] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[first]
