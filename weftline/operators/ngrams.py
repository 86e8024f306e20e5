"""N-grams of texts by numpy: a helper of ``phrases`` that works on one Arrow batch.

Texts are lines of words, words apart by blanks and tabs, and each text ends its last
line. Words and n-grams have hashes, made of bytes in whole arrays; a string is made
only of n-grams that are sent on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Of two independent hashes: an odd factor a byte, and a number for each byte; separators have none.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
NUMBERS = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, (2, 256), np.uint64)
NUMBERS[:, [9, 10, 32]] = 0
#: Hashes that n-grams are looked up by have so many bits and 32 more.
PART_BITS = 10
POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(which: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The factor's powers and their inverses modulo 2 ** 64."""
    if not POWERS or len(POWERS[0][0]) < many:
        size = max(many, 1 << 16)
        POWERS[:] = [tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (int(x), pow(int(x), -1, 1 << 64))) for x in FACTORS]
    return POWERS[which][0][:many], POWERS[which][1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Piece:
    """Some words: their bytes, where each begins and ends, its line and its place in the batch. The first ``old``
    were in the piece before."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    line: np.ndarray
    place: np.ndarray
    old: int

    def grams(self, longest: int, hashes: int = 1):
        """(n, where its first word is, hashes) of all n-grams of 1 to ``longest`` words that have a new word."""
        word = []
        for k in range(hashes):
            power, inverse = powers(k, len(self.data))
            word.append(mixed(np.add.reduceat(NUMBERS[k][self.data] * power, self.begins) * inverse[self.begins]) if len(self.begins) else np.zeros(0, np.uint64))
        made = word
        for n in range(1, longest + 1):
            if n > 1:
                made = [mixed(g[:-1] * np.uint64(0xBF58476D1CE4E5B9) + w[n - 1:]) for g, w in zip(made, word)]
            at = np.nonzero(self.line[: len(made[0])] == self.line[n - 1:])[0]
            at = at[np.searchsorted(at, self.old - n + 1):]
            yield n, at, [g[at] for g in made]
            if len(made[0]) < 2:
                return


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def pieces(data: np.ndarray, longest: int, piece: int):
    """All words, about ``piece`` bytes of new ones at a time."""
    begin, done, old = 0, 0, 0
    while done < len(data):
        end = done + piece
        while end < len(data) and not (hit := data[end:end + 4096] <= 32).any():
            end += 4096
        end = min(len(data), end + int(np.argmax(hit)) + 1) if end < len(data) else len(data)
        some = data[begin:end]
        blank = (some == 32) | (some == 9)
        keep = np.nonzero(~(blank & np.concatenate([[True], blank[:-1]])))[0]  # words are one blank apart
        own = some[keep]
        own[own == 9] = 32
        word = own > 32
        begins = np.nonzero(word & ~np.concatenate([[False], word[:-1]]))[0]
        ends = np.nonzero(word & ~np.concatenate([word[1:], [False]]))[0] + 1
        place = keep[begins] + begin
        yield Piece(own, begins, ends, np.cumsum(own == 10)[begins], place, old)
        old, done = min(longest - 1, len(begins)), end
        begin = int(place[-old]) if old else end


def strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of some bytes as strings."""
    at = np.concatenate([[0], np.cumsum(ends - begins)])
    if at[-1] >= 1 << 31:
        raise ValueError("over 2 GB of strings at a time")
    taken = data[np.repeat(begins - at[:-1], np.diff(at)) + np.arange(at[-1])]
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes()))


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each begins, how long each is) of stretches of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.nonzero(new)[0]
    return first, np.diff(np.append(first, len(new)))


def short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(32 - PART_BITS)


def passing(held: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have a bit in a filter (bytes, a power of two of them)."""
    if held is None:
        return np.ones(len(hashes), bool)
    bit = short(hashes) & np.uint64(8 * len(held) - 1)
    return (held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
