"""Text turned into numpy arrays inside tasks: words, their hashes, shingle sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables["up"], _tables["down"] = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    if n <= BLOCK:
        return _tables["up"], _tables["down"]
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _block_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one block, none of which is cut."""
    a = np.frombuffer(data, np.uint8)
    edge = np.empty(len(a) + 2, bool)
    edge[0] = edge[-1] = False
    np.logical_not(_IS_SPACE[a], out=edge[1:-1])
    change = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = change[0::2], change[1::2]
    up, down = _power_tables(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def batch_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts (A-Z lower-cased) and the offsets of each text.

    Texts are joined by line feeds and hashed in blocks cut at white space, so
    memory follows the block and the number of words, however long one text is.
    """
    data = b"\n".join(texts).translate(_LOWER)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = at + BLOCK
        if to < len(data):
            m = _SPACE.search(data, to)
            to = m.start() if m else len(data)
        else:
            to = len(data)
        h, s = _block_hashes(data[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return words, np.concatenate([[0], np.searchsorted(begin, ends)])


_ROLES = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    h = np.full(n - k + 1, _U(k))
    for i in range(k):
        h += words[i : n - k + 1 + i] * _ROLES[i]
    return np.unique(mix(h))


def texts_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to about ``limit`` bytes."""
    for b in batches:
        sizes = np.fromiter((len(x) for x in texts_of(b.column(text))), np.int64, b.num_rows)
        at, total = 0, np.cumsum(sizes)
        while at < b.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to
