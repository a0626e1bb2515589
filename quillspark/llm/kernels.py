"""Vectorised text kernels shared by the Arrow-based operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so no Python object is made
per word. A chunk holds whole documents and about ``CHUNK_BYTES`` bytes; one longer document is a
chunk of its own, of which only masks and word positions are held as a whole: hashes of its spans and
sums over its bytes are taken in windows of CHUNK_BYTES.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _BASE), ("i", _INV)):
            a = np.full(size, base & (2**64 - 1), U64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"], _POW["i"]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets from 0) for runs of whole documents."""
    buf, offs = string_buffer(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs without ASCII white space; words of document d are first[d]:first[d+1]."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~_WS[buf]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    start[cut] = ink[cut]
    end[cut - 1] = ink[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pre, inv) with hash of [a, b) = mix((pre[b] - pre[a]) * inv[a])."""
    p, inv = _powers(len(buf) + 1)
    pre = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[: len(buf)], out=pre[1:])
    return pre, inv


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, independent of where it stands. Long buffers are hashed in windows."""
    if len(buf) <= CHUNK_BYTES:
        pre, inv = prefix_hashes(buf)
        return mix((pre[ends] - pre[starts]) * inv[starts])
    out, carry, mask = np.zeros(len(starts), U64), U64(0), (1 << 64) - 1
    by_start, by_end = (np.argsort(x, kind="stable") if len(x) and (np.diff(x) < 0).any() else np.arange(len(x)) for x in (starts, ends))
    sorted_starts, sorted_ends = starts[by_start], ends[by_end]
    head, back = np.zeros(len(starts), U64), np.zeros(len(starts), U64)
    for lo in range(0, len(buf) + 1, CHUNK_BYTES):
        pre, inv = prefix_hashes(buf[lo : lo + CHUNK_BYTES])
        pre = pre * U64(pow(_BASE, lo, 1 << 64)) + carry
        hi = lo + CHUNK_BYTES
        i = by_start[slice(*np.searchsorted(sorted_starts, [lo, hi]))]
        head[i], back[i] = pre[starts[i] - lo], inv[starts[i] - lo] * U64(pow(_INV & mask, lo, 1 << 64))
        i = by_end[slice(*np.searchsorted(sorted_ends, [lo, hi]))]
        out[i] = pre[ends[i] - lo]
        carry = pre[-1] if hi <= len(buf) else carry
    return mix((out - head) * back)


def doc_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each k-word window, its position among the words, and (first) per document. Documents of fewer words have none."""
    n = len(h)
    per = np.maximum(0, np.diff(first) - k + 1)
    at = np.zeros(len(first), np.int64)
    np.cumsum(per, out=at[1:])
    pos = np.arange(at[-1]) - np.repeat(at[:-1], per) + np.repeat(first[:-1], per)
    if not n or not len(pos):
        return np.zeros(0, U64), pos, at
    out = np.zeros(len(pos), U64)
    for j in range(k):
        out = out * U64(0xD1342543DE82EF95) + h[pos + j]
    return mix(out), pos, at


def count(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of true bytes of each document, without an array of running sums."""
    out, some = np.zeros(len(offs) - 1, np.int64), np.flatnonzero(np.diff(offs) > 0)
    if len(some):
        out[some] = np.add.reduceat(mask[: offs[-1]], offs[some], dtype=np.int64)
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d+1]] for each d."""
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def dup_flags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does the same hash stand elsewhere in its document; is it there before this one."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = mix(h ^ mix(doc.astype(U64) + U64(0x51ED27)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    again, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    later[order[1:]] = same
    return again, later
