"""Token ids of whole texts, fast enough for a corpus.

The tokenizer's rules never join characters across white space or across a
change between letters, digits and other characters (apart from contractions),
so a text's ids are its units' ids in order. Units are found for a whole batch
in NumPy, and only units that a worker has not met are given to the tokenizers
library. Units are looked up by a hash and then compared in full; a text with a
unit whose hash is another unit's goes to the library as it is, as do texts with
characters for which the above does not hold and texts with a unit of more than
``LONG`` letters, which are seldom met again. What a worker remembers is bounded by
its bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Characters below this are handled here: they are composed, and lower-casing them does not depend on neighbours.
LIMIT = 0x250
#: Letters of a unit that is remembered, at most.
LONG = 256
#: Bytes of units that a worker remembers before it starts anew: letters, ids and what finds them.
KNOWN = 48 << 20
#: Bytes that a unit takes besides its ids and, if it is longer than two words, its letters; arrays have room to grow.
UNIT = 160
#: Units that wait to be merged into the sorted ones.
RECENT = 1 << 16
#: Characters that are handled together.
BATCH = 1 << 19


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character: class (0 space, 1 letter, 2 digit, 3 other), lower case, and whether the library has to see the text."""
    kind, low, odd = np.zeros(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.uint16), np.zeros(LIMIT, bool)
    import unicodedata

    for i in range(LIMIT):
        c = chr(i)
        group = unicodedata.category(c)[0]
        kind[i] = 0 if c in " \t\n\r\x0b\x0c" else 1 if group == "L" else 2 if group == "N" else 3
        odd[i] = len(c.lower()) != 1 or (c.isspace() and kind[i]) or unicodedata.normalize("NFC", c) != c
        low[i] = i if odd[i] else ord(c.lower())
        odd[i] |= low[i] >= LIMIT
    return kind, low, odd


#: Odd multipliers that spread a unit's words over its hash.
SPREAD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Units:
    """Runs ``first`` to ``last`` of ``letters`` (8 or 16 bits each), read a word of 8 bytes at a time."""

    def __init__(self, letters: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.letters, self.first, self.last, self.size = letters, first, last, last - first
        self.per = 8 // letters.itemsize
        padded = np.concatenate((letters, np.zeros(self.per, letters.dtype))).view(np.uint8)
        self.words = np.lib.stride_tricks.as_strided(padded, (len(letters), 8), (letters.itemsize, 1)).copy().view(np.uint64)[:, 0]
        self.mask = np.array([(1 << 8 * letters.itemsize * k) - 1 for k in range(1, self.per + 1)], np.uint64)

    def _word(self, at: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
        """Letters k to k + per of the units, read from ``at``."""
        return self.words[at + k] & self.mask[np.minimum(self.size[unit] - k, self.per) - 1]

    def hashes(self) -> np.ndarray:
        live = np.arange(len(self.first))
        h = self._word(self.first, live, 0) * SPREAD + self.size.astype(np.uint64)
        h ^= h >> np.uint64(29)
        for k in range(self.per, int(self.size.max(initial=0)), self.per):
            live = live[self.size[live] > k]
            x = (h[live] + self._word(self.first[live], live, k)) * STEP
            h[live] = x ^ (x >> np.uint64(31))
        return h * STEP

    def told(self, which: np.ndarray) -> np.ndarray:
        """First and second word and length of some units: all of a unit of up to two words."""
        out = np.zeros((3, len(which)), np.uint64)
        out[0] = self._word(self.first[which], which, 0)
        more = which[self.size[which] > self.per]
        out[1, self.size[which] > self.per] = self._word(self.first[more], more, self.per)
        out[2] = self.size[which] * 2 + (self.letters.itemsize - 1)
        return out

    def differ(self, like: np.ndarray) -> np.ndarray:
        """Which units are not spelt as the unit of number ``like``."""
        there = self.first[like]
        out = self.size != self.size[like]
        live = np.flatnonzero(~out & (self.first != there))
        for k in range(0, int(self.size[live].max(initial=0)), self.per):
            live = live[self.size[live] > k]
            if len(live) < 16 and k >= 64:  # some long units: whole
                for i in live.tolist():
                    n = self.size[i]
                    out[i] |= not np.array_equal(self.letters[self.first[i] : self.first[i] + n], self.letters[there[i] : there[i] + n])
                break
            out[live] |= self._word(self.first[live], live, k) != self._word(there[live], live, k)
        return out


class Store:
    """Units by hash in sorted runs, with what tells them apart and their ids. Up to two words of letters are held, of longer units the letters as well."""

    def __init__(self):
        none = np.zeros(0, np.uint64)
        self.runs = [(none, np.zeros(0, np.int64)), (none, np.zeros(0, np.int64))]
        self.n, self.used, self.bytes = 0, 0, 0
        self.told = np.zeros((3, 1 << 14), np.uint64)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.long: dict[int, str] = {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the units that have the sorted ``keys``; -1 for none."""
        out = np.full(len(keys), -1)
        for held, number in self.runs:
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[at] == keys
                out[hit] = number[at[hit]]
        return out

    def add(self, keys: np.ndarray, told: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Remembers new units; their numbers."""
        number = np.arange(self.n, self.n + len(keys))
        sizes = np.array([len(x) for x in ids], np.int64)
        ends = self.used + np.cumsum(sizes)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(keys) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
            self.told = np.concatenate((self.told, np.zeros_like(self.told)), axis=1)
        self.flat[self.used : ends[-1]] = [i for x in ids for i in x]
        self.starts[number], self.sizes[number] = ends - sizes, sizes
        self.told[:, number] = told
        self.n, self.used = self.n + len(keys), int(ends[-1])
        self.bytes += UNIT * len(keys) + 8 * int(sizes.sum())
        self.runs[1] = self._merged(self.runs[1], (keys, number))
        if len(self.runs[1][0]) > RECENT:
            self.runs = [self._merged(*self.runs), (keys[:0], number[:0])]
        return number

    def keep_letters(self, number: int, unit: str) -> None:
        self.long[number] = unit
        self.bytes += UNIT + len(unit) * (1 if unit.isascii() else 2)

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate((a[0], b[0]))
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate((a[1], b[1]))[order]


class Encoder:
    """ids() as ``encode(text, add_special_tokens=False).ids`` for many texts."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.kind, self.low, self.odd = _classes()
        # Byte-level vocabularies write a byte as its Latin-1 character if that is visible, else as the next free one from 256.
        hidden = [b for b in range(256) if b < 33 or 126 < b < 161 or b == 173]
        self.stand_in = {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.store = Store()

    def _plain(self, text: str) -> bool:
        points = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
        return not len(points) or bool(points.max() < LIMIT and not self.odd[points].any())

    def _unit_ids(self, unit: str) -> list[int]:
        if not unit.isalpha():
            return self.library.encode(unit, add_special_tokens=False).ids
        # One word: the model alone, on the characters that stand for its bytes.
        if not unit.isascii():
            unit = unit.encode().decode("latin-1").translate(self.stand_in)
        return [t.id for t in self.library.model.tokenize(unit)]

    def _batch(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts, together shorter than BATCH; None for those that the library has to see whole."""
        text = " ".join(texts) + " "
        points = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
        if points.max() >= LIMIT or self.odd[points].any():
            plain = [k for k, t in enumerate(texts) if self._plain(t)]
            out: list[np.ndarray | None] = [None] * len(texts)
            for k, x in zip(plain, self._batch([texts[k] for k in plain]) if plain else [], strict=True):
                out[k] = x
            return out
        doc_end = np.cumsum([len(t) + 1 for t in texts])
        kind, low = self.kind[points], self.low[points]
        edge = np.concatenate(([True], kind[1:] != kind[:-1]))
        # A contraction may take letters along: words with an apostrophe stay whole.
        quotes = np.flatnonzero(points == 39)
        if len(quotes):
            space = np.flatnonzero(kind == 0)
            at = np.unique(np.searchsorted(space, quotes))
            start, stop = np.where(at > 0, space[at - 1] + 1, 0), space[at]
            n = stop - start - 1
            edge[np.repeat(start + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())] = False
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(points))
        solid = kind[first] != 0
        first, last = first[solid], last[solid]
        if not len(first):
            return [np.zeros(0, np.uint32) for _ in texts]
        long = last - first > LONG
        if long.any():
            seldom = set(np.searchsorted(doc_end, first[long], side="right").tolist())
            rest = [k for k in range(len(texts)) if k not in seldom]
            out = [None] * len(texts)
            for k, x in zip(rest, self._batch([texts[k] for k in rest]) if rest else [], strict=True):
                out[k] = x
            return out
        units = Units(low.astype(np.uint8) if low.max() < 256 else low, first, last)
        keys, where, back = np.unique(units.hashes(), return_index=True, return_inverse=True)
        if self.store.bytes > KNOWN:
            self.store = Store()
        store, text = self.store, low.tobytes().decode("utf-16-le")
        told = units.told(where)
        at = store.find(keys)
        wrong = (at >= 0) & (store.told[:, at] != told).any(axis=0)
        lo, hi, long = first[where], last[where], units.size[where] > 2 * units.per
        for k in np.flatnonzero(long & (at >= 0) & ~wrong).tolist():
            wrong[k] = store.long[int(at[k])] != text[lo[k] : hi[k]]
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = store.add(keys[fresh], told[:, fresh], [self._unit_ids(text[i:j]) for i, j in zip(lo[fresh].tolist(), hi[fresh].tolist(), strict=True)])
            for k in fresh[long[fresh]].tolist():
                store.keep_letters(int(at[k]), text[lo[k] : hi[k]])
        other = wrong[back] | units.differ(where[back])
        unit = at[back]
        sizes = store.sizes[unit]
        ends = np.cumsum(sizes)
        ids = store.flat[np.repeat(store.starts[unit] - (ends - sizes), sizes) + np.arange(ends[-1])]
        cut = np.concatenate(([0], ends))[np.searchsorted(first, doc_end)]
        out = np.split(ids, cut[:-1])
        for k in np.unique(np.searchsorted(doc_end, first[other], side="right")).tolist():
            out[k] = None
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for k, x in zip(held, self._batch([texts[k] for k in held]), strict=True):
                    out[k] = x
            held, size = [], 0

        for k, text in enumerate(texts):
            if len(text) >= BATCH or "<|" in text:
                continue
            if size + len(text) + 1 > BATCH:
                flush()
            held.append(k)
            size += len(text) + 1
        flush()
        return [self._whole(t) if x is None else x for t, x in zip(texts, out, strict=True)]


@cache
def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder of a vocabulary file of the public tokenizers, by name."""
    return Encoder(public_tokenizers.path(vocabulary))
