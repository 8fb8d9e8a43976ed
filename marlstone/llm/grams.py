"""Byte n-grams of words, hashed and summed with numpy, for models whose word scores are sums over n-grams.

Texts are lower-cased UTF-8. Word bytes are a-z, optionally digits, and all bytes from 0x80; every other byte
ends a word. An n-gram lies in one word with the space on either side, so prefixes and suffixes differ from middles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes taken at once; longer texts are cut after a space, or at this length where there is none.
BLOCK = 1 << 18
_MULTIPLIER = 0x01000193
_SPREAD = np.uint32(2654435769)


def byte_classes(digits: bool) -> np.ndarray:
    """For each byte itself where it is of a word (A-Z as a-z), else a space."""
    table = np.full(256, 32, dtype=np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    for low, up in zip(range(97, 123), range(65, 91)):
        table[low] = table[up] = low
    if digits:
        table[48:58] = np.arange(48, 58)
    return table


class Grams:
    """n-grams of one block: the words' starts and ends, and for each n the words and buckets of its n-grams."""

    def __init__(self, raw: bytes, sizes: Sequence[int], bits: int, classes: np.ndarray, whole_words: bool = False):
        self.bytes = a = classes[np.frombuffer(b" " + raw + b" " * (max(sizes) + 1), dtype=np.uint8)]
        letter = a != 32
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.n_words = len(self.starts)
        number = np.cumsum(begins, dtype=np.int32) - 1
        upto = len(a) - max(sizes)
        wide = a.astype(np.uint32)
        # The first space at or after each place, to tell n-grams that reach past their word.
        space = np.where(letter, len(a), np.arange(len(a)))
        space = np.minimum.accumulate(space[::-1])[::-1]
        hashed, power, done = np.zeros(upto, dtype=np.uint32), 1, 0
        self.words, self.buckets = [], []
        for n in sorted(sizes):
            for k in range(done, n):
                hashed = hashed + wide[k : k + upto] * np.uint32(power)
                power = power * _MULTIPLIER & 0xFFFFFFFF
            done = n
            # Pairs begin at the last letter too; longer n-grams reach past the space after it.
            begun = letter[1 : upto + 1] if n > 2 else letter[1 : upto + 1] | letter[:upto]
            at = np.flatnonzero(begun & (space[1 : upto + 1] >= np.arange(n - 1, upto + n - 1)))
            self.words.append(number[at + 1])
            self.buckets.append(((hashed[at] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * _SPREAD >> np.uint32(32 - bits)).astype(np.int32))
        if whole_words and self.n_words:
            powers = _POWERS[np.minimum(np.arange(len(a), dtype=np.int64) - self.starts[np.maximum(number, 0)], len(_POWERS) - 1)]
            sums = np.add.reduceat(np.where(letter, wide * powers, np.uint32(0)), self.starts, dtype=np.uint32)
            self.words.append(np.arange(self.n_words, dtype=np.int32))
            self.buckets.append(((sums ^ np.uint32(0x5BD1E995)) * _SPREAD >> np.uint32(32 - bits)).astype(np.int32))

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each word and column of ``table``, the sum over the word's n-grams."""
        out = np.zeros((self.n_words, table.shape[1]))
        for words, buckets in zip(self.words, self.buckets):
            values = table[buckets]
            for c in range(table.shape[1]):
                out[:, c] += np.bincount(words, weights=values[:, c], minlength=self.n_words)
        return out

    def counts(self) -> np.ndarray:
        """Number of each word's n-grams."""
        return sum((np.bincount(w, minlength=self.n_words) for w in self.words), np.zeros(self.n_words, dtype=np.int64))


_POWERS = np.cumprod(np.full(64, 0x85EBCA6B, dtype=np.uint32), dtype=np.uint32)


def blocks(texts: Sequence[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts joined to blocks: the bytes, and (number of the text, start, end) of each part in them."""
    held, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > BLOCK:
                end = text.rfind(b" ", at, at + BLOCK) + 1 or at + BLOCK
            piece = text[at:end]
            if size and size + len(piece) > BLOCK:
                yield b" ".join(held), parts
                held, parts, size = [], [], 0
            parts.append((i, size, size + len(piece)))
            held.append(piece)
            size += len(piece) + 1
            at = end
            if at >= len(text):
                break
    if held:
        yield b" ".join(held), parts


def per_text(texts: Sequence[bytes], columns: int, of_block) -> list[np.ndarray]:
    """of_block(Grams-ready bytes) gives (starts, values) of a block's words; their values by text, in order."""
    gathered: list[list[np.ndarray]] = [[] for _ in texts]
    for raw, parts in blocks(texts):
        starts, values = of_block(raw)
        cuts = np.searchsorted(starts, [p[1] for p in parts] + [len(raw) + 1])
        for (i, _, _), low, high in zip(parts, cuts[:-1], cuts[1:]):
            if high > low:
                gathered[i].append(values[low:high])
    return [g[0] if len(g) == 1 else np.concatenate(g) if g else np.zeros((0, columns)) for g in gathered]
