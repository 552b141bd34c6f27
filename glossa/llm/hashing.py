"""Names of words and strings computed over whole arrays of bytes."""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 20
M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * M)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of texts: maximal runs of bytes other than ASCII white space, with A-Z lower-cased.

    A word's name is a polynomial of its bytes over 64 bits, mixed; two words of one name are taken as one.
    ``between`` marks other bytes that words are parted by; the line feed must be one of them.
    """

    def __init__(self, between: np.ndarray = WHITE):
        self.between, self.up, self.down = between, powers(BASE, 0), powers(BASE, 0)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(names of all words, words of each text)."""
        buf = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        n = len(buf)
        if n > len(self.up):
            self.up, self.down = powers(BASE, 2 * n), powers(BASE_INVERSE, 2 * n)
        white = np.ones(n + 2, bool)
        white[1:-1] = self.between[buf]
        edges = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[buf] * self.up[:n], out=sums[1:])
        names = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * M)
        at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return names, np.diff(np.searchsorted(starts, at), prepend=0)


def chunks(batches, limit: int = CHUNK_BYTES):
    """(ids, texts in UTF-8) of about ``limit`` bytes out of Arrow batches of (id, text); null texts are empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            some = batch.slice(start, 256)
            for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                t = t.encode() if isinstance(t, str) else t or b""
                if ids and size + len(t) > limit:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
    if ids:
        yield ids, texts
