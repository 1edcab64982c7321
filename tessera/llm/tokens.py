"""Byte-level BPE ids of whole texts, with a bounded memo of word pieces.

The library splits a text by a fixed pattern and merges each piece on its own, so
equal pieces always get equal ids. A batch of texts is split with numpy over its
byte buffer, equal pieces are found by a hash and compared byte by byte, and only pieces that the
worker hasn't met are given to the library. Texts with characters outside
ASCII and the Latin-1 letters, or with an apostrophe (the pattern has rules for
these), are encoded by the library directly, and so are, as a whole, texts that hold the
content of an added token such as <|endoftext|>, which the library takes as that token.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

LETTER, DIGIT, SPACE, BLANK, OTHER, ODD = range(6)
MEMO_ENTRIES = 1_000_000
LONGEST_PIECE = 4096
SPLIT_BYTES = 2 << 20
_SAFE = re.compile(rb"[A-Za-z](?= [A-Za-z])")


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[ord("0"):ord("9") + 1] = DIGIT
    for a, b in (("A", "Z"), ("a", "z")):
        t[ord(a):ord(b) + 1] = LETTER
    t[9:14] = BLANK
    t[32] = SPACE
    t[ord("'")] = ODD
    t[128:] = ODD
    t[0xC3] = LETTER  # with one of the next, a letter of Latin-1
    t[0x80:0xC0] = LETTER
    t[0x97] = t[0xB7] = ODD  # multiplication and division signs
    return t


_CLASS = _classes()
_POW = np.cumprod(np.append(np.uint64(1), np.full(LONGEST_PIECE - 1, 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)


def piece_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start of each piece that the library's pattern would split off."""
    cls = _CLASS[data]
    blank = (cls == SPACE) | (cls == BLANK)
    first = np.zeros(len(data) + 1, bool)
    first[doc_starts] = True
    follows = np.zeros(len(data), bool)  # a character that isn't blank follows in the same text
    follows[:-1] = ~blank[1:] & ~first[1:-1]
    start = np.empty(len(data), bool)
    start[0] = True
    start[1:] = np.where(blank[1:], ~blank[:-1] | follows[1:],
                         np.where(blank[:-1], cls[:-1] != SPACE, cls[1:] != cls[:-1]))
    start |= first[:-1]
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by one tokenizer file; one per Python worker and file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        added = sorted((t.content.encode() for t in self.lib.get_added_tokens_decoder().values()), key=len)
        self.added = re.compile(b"|".join(map(re.escape, reversed(added))) or rb"(?!)")
        self._clear()

    def _clear(self):
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 16, np.int64)

    def _direct(self, text: bytes) -> np.ndarray:
        return np.array(self.lib.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[bytes]):
        """Ask the library for the ids of ``words`` and keep them.

        A space and letters after it stay one piece when such words follow each
        other, so these go in as texts of many words; the rest one by one.
        """
        joint = [w for w in words if w[0] == 32 and len(w) > 1 and _CLASS[w[1]] == LETTER]
        other = [w for w in words if not (w[0] == 32 and len(w) > 1 and _CLASS[w[1]] == LETTER)]
        if self.added.search(b"".join(joint)):  # words side by side would be an added token
            joint, other = [], words
        runs = [b"".join(joint[i:i + 1000]).decode() for i in range(0, len(joint), 1000)]
        found, sizes = [], []
        for e in self.lib.encode_batch(runs, add_special_tokens=False):
            found.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64)))
        for e in self.lib.encode_batch_fast([w.decode() for w in other], add_special_tokens=False):
            found.append(np.array(e.ids, np.uint32))
            sizes.append([len(found[-1])])
        ids, sizes = np.concatenate(found), np.concatenate(sizes)
        k = len(self.memo)
        begin = int(self.off[k])
        if begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        while k + len(sizes) >= len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        self.ids[begin:begin + len(ids)] = ids
        self.off[k + 1:k + 1 + len(sizes)] = begin + np.cumsum(sizes)
        self.memo.update(zip(joint + other, range(k, k + len(sizes))))

    def _parts(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each part; all parts in plain characters."""
        sizes = np.array([len(p) for p in parts])
        if not sizes.sum():
            return [np.empty(0, np.uint32) for _ in parts]
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        begin = np.cumsum(sizes) - sizes
        start = piece_starts(data, begin[sizes > 0])
        size = np.diff(np.append(start, len(data)))
        if size.max() > LONGEST_PIECE:
            return [self._direct(p) for p in parts]
        place = np.arange(len(data)) - np.repeat(start, size)
        value = data.astype(np.uint64) + np.uint64(1)
        _, index, inverse = np.unique(np.add.reduceat(value * _POW[place], start), return_index=True, return_inverse=True)
        if (size != size[index][inverse]).any() or (data != data[np.repeat(start[index][inverse], size) + place]).any():
            return [self._direct(p) for p in parts]  # unlike pieces with one hash
        if len(self.memo) + len(index) > MEMO_ENTRIES:
            self._clear()
        words = [raw[a:b] for a, b in zip(start[index].tolist(), (start + size)[index].tolist())]
        if new := [w for w in words if w not in self.memo]:
            self._learn(new)
        known = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))[inverse]
        count = self.off[known + 1] - self.off[known]
        ends = np.cumsum(count)
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.off[known] - ends + count, count)]
        until = np.append(0, ends)[np.searchsorted(start, begin + sizes)]
        return np.split(flat, until[:-1])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of each text; null counts as empty. Whole texts, of any length."""
        parts, owner, odd = [], [], {}
        for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
            t = t or b""
            cuts, whole = [0], bool(self.added.search(t))
            while not whole and len(t) - cuts[-1] > SPLIT_BYTES and (m := _SAFE.search(t, cuts[-1] + SPLIT_BYTES - 1)):
                cuts.append(m.end())
            for a, b in zip(cuts, [*cuts[1:], len(t)]):
                p = t[a:b] if len(cuts) > 1 else t
                if whole or (_CLASS[np.frombuffer(p, np.uint8)] == ODD).any():
                    odd[len(owner)] = self._direct(p)
                    p = b""
                owner.append(i)
                parts.append(p)
        got: list[np.ndarray] = []
        block, size = [], 0
        for p in parts:
            block.append(p)
            size += len(p)
            if size >= SPLIT_BYTES:
                got += self._parts(block)
                block, size = [], 0
        if block:
            got += self._parts(block)
        out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for k, (i, ids) in enumerate(zip(owner, got)):
            out[i].append(odd.get(k, ids))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]
