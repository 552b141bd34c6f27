"""Blocks of documents and packed payloads, for joins of word tables without a row a word.

A block is some megabytes of text. Its distinct words (or other keys) are sent to hash parts, one compressed
payload a block and part; a part answers each payload in its own order. At any size a payload holds one key
at least, so there are never more payloads than keys.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 8 << 20
PART_BYTES = 8 << 20


def n_parts(n_bytes: int, part_bytes: int = PART_BYTES) -> int:
    return max(1, -(-n_bytes // part_bytes))


def pack(a: np.ndarray, level: int = 3) -> bytes:
    """Compress an array of integers, the bytes of one significance together."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_strings(words: list[bytes]) -> bytes:
    lens = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    body = zstandard.ZstdCompressor(level=6).compress(b"".join(words))
    return np.uint32(len(lens)).tobytes() + lens + body


def unpack_strings(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data[:4], np.uint32)[0]) + 4
    ends = np.cumsum(unpack(data[4:n], np.uint32), dtype=np.int64).tolist()
    body = zstandard.ZstdDecompressor().decompress(data[n:])
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one after the other."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.concatenate(([0], np.cumsum(lens)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lens)


def blocks(batches, limit: int = BLOCK_BYTES):
    """(ids, texts) of blocks of about ``limit`` bytes out of Arrow batches of (id, text); null texts are empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            some = batch.slice(start, 256)
            for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1]) + 8
                if size >= limit:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def trim() -> None:
    """Give freed memory back, as workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Compress sorted 64-bit keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def parts_of(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of sorted keys: parts are equal ranges of the 64-bit integers."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]


ASKED = "part int, block long, keys binary, a binary, b binary"
ANSWERED = "part int, block long, a binary, b binary, n_keys long, sum_a long, sum_b long"


def asked(block: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int, first: int = 0):
    """Rows of ASKED for a block's sorted distinct keys and two counts of each."""
    for p, i, j in parts_of(keys, parts):
        yield {"part": first + p, "block": block, "keys": pack_sorted(keys[i:j]), "a": pack(a[i:j].astype(np.uint32)), "b": pack(b[i:j].astype(np.uint32))}


def pack_counts(a: np.ndarray) -> bytes:
    """Counts in the narrowest of the unsigned widths up to 64 bits that holds them all; the first byte is the width."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + pack(a.astype(kind))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"u{data[0]}").astype(np.int64)


def _totals(table):
    part, block = table.column("part").to_pylist(), table.column("block").to_pylist()
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    every, of = np.unique(np.concatenate(keys), return_inverse=True)
    n = len(every)
    del keys, every
    out = [{"part": p, "block": k, "n_keys": 0, "sum_a": 0, "sum_b": 0} for p, k in zip(part, block, strict=True)]
    seen = np.zeros(n, bool)
    for c in "ab":
        own = np.concatenate([unpack(x, np.uint32) for x in table.column(c).to_pylist()])
        total = np.bincount(of, weights=own, minlength=n).astype(np.int64)
        del own
        seen |= total > 0
        out[0][f"sum_{c}"] = int(total.sum())
        for r, i, j in zip(out, [0, *ends[:-1]], ends, strict=True):
            r[c] = pack_counts(total[of[i:j]])
        del total
    out[0]["n_keys"] = int(seen.sum())
    del of, seen
    trim()
    kinds = [("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n_keys", pa.int64()), ("sum_a", pa.int64()), ("sum_b", pa.int64())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def totals(requests, parts: int):
    """Answers ANSWERED to rows of ASKED: each key's counts summed over all blocks, in the order asked.

    A part is a range of keys, of which every block has about the same share, as keys are hashes. Its first
    answer has the part's number of keys with a count and the sums of counts.
    """
    return requests.repartition(min(parts, 20_000), "part").groupBy("part").applyInArrow(_totals, ANSWERED)
