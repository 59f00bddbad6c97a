"""Vectorised work on the UTF-8 bytes of many texts at once: words, lines, rolling hashes.

Everything here takes one buffer with the texts one after another and their offsets, so that
the cost of a call is shared by all texts of a slice and no Python object is made for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_GOLDEN = 0x9E3779B97F4A7C15
#: Hashes are polynomials modulo the prime 2**31 - 1 in two bases each, drawn once and kept.
_M = (1 << 31) - 1
_BASES = (0x2E7F3A15, 0x51C96D0B, 0x1B873593, 0x6C62272E)


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: White space that ends a word: [\x20\x09-\x0D].
SPACE = table(b" \t\n\x0b\x0c\r")
#: What a term of letters and digits consists of (bytes of other scripts count as letters).
TERM = table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo _M; x is used up."""
    m, shift = np.uint64(_M), np.uint64(31)
    for _ in range(2):
        high = x >> shift
        x &= m
        x += high
    np.subtract(x, m, out=x, where=x >= m)
    return x


class _Powers:
    held: dict[int, np.ndarray] = {}

    @classmethod
    def get(cls, base: int, n: int) -> np.ndarray:
        """The first n powers of base."""
        a = cls.held.get(base, np.ones(1, np.uint32))
        while len(a) < n:
            a = np.concatenate([a, _mod(a.astype(np.uint64) * np.uint64(pow(base, len(a), _M))).astype(np.uint32)])
        cls.held[base] = a
        return a[:n]


def forget_powers() -> None:
    """Give up the tables of powers, which are as long as the longest text so far."""
    _Powers.held.clear()


class Rolling:
    """Hash of any range of a sequence in constant time.

    Two polynomials modulo a prime in fixed bases, 62 bits together: two given sequences of n values have equal
    hashes for (n / 2**31)**2 of all bases at most, whatever pattern they have. Another seed (0 or 1) has other bases."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        n = len(values)
        self.sums, self.down = [], []
        for k, base in enumerate(_BASES[2 * seed : 2 * seed + 2]):
            if values.dtype == np.uint8:
                v = values.astype(np.uint64) + np.uint64(1)
            else:
                v = values >> np.uint64(33) if k else values & np.uint64(_M)
            v *= _Powers.get(base, n)
            high = v >> np.uint64(31)
            v &= np.uint64(_M)
            v += high
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(v, out=sums[1:])
            self.sums.append(_mod(sums).astype(np.uint32))
            self.down.append(_Powers.get(pow(base, -1, _M), n + 1))

    def _hash(self, starts, ends, size) -> np.ndarray:
        both = [_mod((s[ends] + np.uint64(_M) - s[starts]) * d[starts]) for s, d in zip(self.sums, self.down)]
        return mix64((both[0] << np.uint64(31) | both[1]) + size)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._hash(starts, ends, (ends - starts).astype(np.uint64) * np.uint64(_GOLDEN))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of that size, by its start."""
        n = len(self.sums[0]) - size
        return self._hash(slice(0, n), slice(size, None), np.uint64(size * _GOLDEN & 0xFFFFFFFFFFFFFFFF)) if n > 0 else np.zeros(0, np.uint64)


def tokens(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the maximal runs of bytes with inside true; runs end with their text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tokens(data, offs, ~SPACE[data])


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(start, end, text index) of the \n-split lines, empty ones too."""
    nl = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], nl + 1]))
    ends = np.sort(np.concatenate([nl, offs[1:]]))
    per = np.searchsorted(nl, offs[1:]) - np.searchsorted(nl, offs[:-1])
    return starts, ends, np.repeat(np.arange(len(offs) - 1), per + 1)


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def within(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Hashes made distinct by group, for counting within each text."""
    return mix64(hashes ^ mix64(group.astype(np.uint64) + np.uint64(0x51ED27)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not the first of its kind), by position."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def window_starts(doc: np.ndarray, size: int) -> np.ndarray:
    """Positions i of a sequence of tokens with token i + size - 1 still in the same text."""
    n = len(doc) - size + 1
    return np.flatnonzero(doc[:n] == doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of that size from one of the starts."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + size, -1)
    return np.cumsum(d[:-1]) > 0
