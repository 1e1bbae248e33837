"""Byte functions that Catalyst has no expression for, as Arrow UDFs over NumPy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def entropy_of(b: bytes) -> float:
    n = np.bincount(np.frombuffer(b, np.uint8))
    p = n[n > 0] / max(1, len(b))
    return float(-(p * np.log2(p)).sum()) + 0.0


def _layout(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, bytes and validity of a binary array."""
    if not len(a):
        return np.zeros(1, np.int32), np.empty(0, np.uint8), np.empty(0, bool)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    data = np.empty(0, np.uint8) if a.buffers()[2] is None else np.frombuffer(a.buffers()[2], np.uint8)
    return offsets, data, np.asarray(a.is_valid())


def by_length(a: pa.Array):
    """(rows, matrix of their bytes) for each length of a binary array's values; nulls in none."""
    offsets, data, there = _layout(a)
    size = np.diff(offsets)
    for n in np.unique(size[there]).tolist():
        rows = np.flatnonzero(there & (size == n))
        step = max(1, (1 << 20) // max(n, 1))  # bounded memory for any batch: indices take eight times the bytes
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield some, data[offsets[some][:, None] + np.arange(n)]


def entropies(m: np.ndarray) -> np.ndarray:
    """Shannon entropy of each row of a byte matrix."""
    out, n = np.zeros(len(m)), max(1, m.shape[1])
    for lo in range(0, len(m), 4096):
        part = m[lo : lo + 4096]
        count = np.bincount((np.arange(len(part))[:, None] * 256 + part).ravel(), minlength=256 * len(part)).reshape(-1, 256) / n
        out[lo : lo + len(part)] = -(count * np.log2(np.where(count > 0, count, 1.0))).sum(1) + 0.0
    return out


def words64(m: np.ndarray) -> np.ndarray:
    """A byte matrix as 64-bit words, rows padded with zeros."""
    pad = -m.shape[1] % 8
    return np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad))) if pad else m).view(np.uint64)


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits, and 8 for each byte that only one has."""
    n = min(len(a), len(b))
    x = np.frombuffer(a[:n], np.uint8) ^ np.frombuffer(b[:n], np.uint8)
    return int(np.bitwise_count(x).sum()) + 8 * (max(len(a), len(b)) - n)


def xor(a: bytes, b: bytes) -> bytes:
    """a XOR b, as long as a; what b does not reach is copied."""
    n = min(len(a), len(b))
    return (np.frombuffer(a[:n], np.uint8) ^ np.frombuffer(b[:n], np.uint8)).tobytes() + a[n:]


EQUAL, REPLACE, INSERT, DELETE = range(4)
_RUNS = re.compile(rb"\x00{1,255}|\x01{1,255}|\x02{1,255}|\x03{1,255}")


def edit_script(original: bytes, pattern: bytes) -> bytes:
    """Runs of [op, length <= 255, data of replaced and inserted bytes] that turn pattern into original.

    Costs: insertion and deletion 1, replacement 2; ties prefer equal, replace, insert, delete.
    """
    n, m = len(original), len(pattern)
    # rows of longest common subsequences as whole numbers: bit j is 0 where the length grows from j to j + 1
    at: dict[int, int] = {}
    for j, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << j
    every = (1 << m) - 1
    v, rows = every, [every]
    for c in original if m else b"":
        u = v & at.get(c, 0)
        v = (v + u | v - u) & every
        rows.append(v)
    ops, i, j, length = bytearray(), n, m, m - v.bit_count()
    while i and j:
        if original[i - 1] == pattern[j - 1]:
            ops.append(EQUAL)
            i, j, length = i - 1, j - 1, length - 1
            continue
        above = rows[i - 1] & (1 << j) - 1
        up = j - above.bit_count()
        if length == up - 1 + (above >> j - 1):
            ops.append(REPLACE)
            i, j = i - 1, j - 1
        elif length == up:
            ops.append(INSERT)
            i -= 1
        else:
            ops.append(DELETE)
            j -= 1
    ops += bytes([INSERT]) * i + bytes([DELETE]) * j
    ops.reverse()
    out, i = bytearray(), 0
    for run in _RUNS.findall(ops):
        op, k = run[0], len(run)
        out += bytes([op, k])
        if op in (REPLACE, INSERT):
            out += original[i : i + k]
        if op != DELETE:
            i += k
    return bytes(out)


def apply_script(pattern: bytes, script: bytes) -> bytes:
    out, at, i = bytearray(), 0, 0
    while i + 1 < len(script):
        op, n = script[i], script[i + 1]
        i += 2
        if op == EQUAL:
            out += pattern[at : at + n]
        if op in (REPLACE, INSERT):
            out += script[i : i + n]
            i += n
        if op != INSERT:
            at += n
    return bytes(out)


def polynomial_seed(b: bytes) -> int | None:
    """The lowest seed whose polynomial gives ``b``: a from the second difference, which must be even."""
    v = np.frombuffer(b, np.uint8).astype(np.int64)
    if not len(v):
        return None
    c, a, d = int(v[0]), 0, 0
    if len(v) > 2:
        second = int(v[2] - 2 * v[1] + v[0]) % 256
        if second % 2:
            return None
        a = second // 2
    if len(v) > 1:
        d = int(v[1] - c - a) % 256
    x = np.arange(len(v))
    return a | d << 8 | c << 16 if np.array_equal((a * x * x + d * x + c) % 256, v) else None


def fnv1a(b: bytes, h: int = 0xCBF29CE484222325) -> int:
    for x in b:
        h = ((h ^ x) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


_GEAR: np.ndarray | None = None


def gear() -> np.ndarray:
    """The gear table: xxh64 with seed 0 of each byte value."""
    global _GEAR
    if _GEAR is None:
        import xxhash

        _GEAR = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)
    return _GEAR


def _greedy(n: int, candidates: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of chunks: the first candidate at least ``least`` after the last cut, else ``most`` after it."""
    ends, start = [], 0
    while start < n:
        k = np.searchsorted(candidates, start + least)
        end = int(candidates[k]) if k < len(candidates) else n
        start = min(end, start + most, n)
        ends.append(start)
    return ends


def fastcdc_ends(b: bytes, target: int) -> list[int]:
    """Gear-hash chunks: cut where the low bits of a rolling gear hash vanish, between target / 4 and 4 x target."""
    least, most, mask = max(1, target // 4), 4 * target, np.uint64(target - 1)
    if len(b) <= least:
        return [len(b)] if b else []
    width = max(1, (target - 1).bit_length())
    g = gear()[np.frombuffer(b, np.uint8)]
    h = np.zeros(len(b), np.uint64)
    for k in range(min(width, len(b))):  # only the last ``width`` bytes reach the tested bits
        h[k:] += g[: len(b) - k] << np.uint64(k)
    return _greedy(len(b), np.flatnonzero((h & mask) == 0) + 1, least, most)


PRIME = np.uint64(1099511628211)


def cdc_ends(b: bytes, target: int) -> list[int]:
    """Polynomial rolling-hash chunks over 8 bytes: cut where hash mod target is 0, between target / 4 and 2 x target."""
    least, most = target // 4, 2 * target
    if len(b) <= max(least, 8):
        return [len(b)] if b else []
    v, h = np.frombuffer(b, np.uint8).astype(np.uint64), np.zeros(len(b), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(7, -1, -1):
            h[7:] = h[7:] * PRIME + v[7 - k : len(b) - k]
    cut = np.flatnonzero(h % np.uint64(target) == 0) + 1
    return _greedy(len(b), cut[cut >= 8], max(least, 8), most)


def delimited_ends(b: bytes, delimiter: int, least: int, most: int) -> list[int]:
    """Chunks that end after a delimiter once ``least`` long, or at ``most``."""
    return _greedy(len(b), np.flatnonzero(np.frombuffer(b, np.uint8) == delimiter) + 1, least, most)


def contextual_ends(b: bytes, kind: str, chunk: int) -> list[int]:
    """Delimiter chunks by content type: ``}`` or ``,`` for JSON, else a new line; fixed for binary kinds."""
    most = 8 * chunk
    if kind in ("UNKNOWN", "ELF", "ZIP", "PNG"):
        return [*range(most, len(b), most), len(b)] if b else []
    mark = b"\n" if kind not in ("JSON", "JSONL") else (b"}" if b"}" in b else b",")
    return delimited_ends(b, mark[0], 32, most)


def scalar(f, kind: pa.DataType, name: str):
    """An Arrow UDF of one or two binary columns; null where any argument is."""

    def of(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], kind)

    def of2(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    return lambda *cols: F.arrow_udf(of2 if len(cols) == 2 else of, name)(*cols)


def compress(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=19).compress(b)


def decompress(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(b)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def xxh64(b: bytes) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(b))


def shannon_entropy(column):
    """Bits a byte, of all rows of a length at once; null for null."""

    def of(a: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        for rows, m in by_length(a):
            out[rows] = entropies(m)
        return pa.array(out, pa.float64(), mask=np.asarray(a.is_null()))

    return F.arrow_udf(of, "double")(column)


def _paired(f, kind: pa.DataType, name: str, slow):
    """An Arrow UDF of two binary columns: rows of equal lengths at once by ``f``, others by ``slow``."""

    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        out: list = [None] * len(a)
        (at, x, there), (bt, y, also) = _layout(a), _layout(b)
        both, size = there & also, np.diff(at)
        alike = both & (size == np.diff(bt))
        for n in np.unique(size[alike]).tolist():
            rows = np.flatnonzero(alike & (size == n))
            step = max(1, (1 << 20) // max(n, 1))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                for r, v in zip(some.tolist(), f(x[at[some][:, None] + np.arange(n)], y[bt[some][:, None] + np.arange(n)])):
                    out[r] = v
        for r in np.flatnonzero(both & ~alike).tolist():
            out[r] = slow(a[r].as_py(), b[r].as_py())
        return pa.array(out, kind)

    return lambda x, y: F.arrow_udf(of, name)(x, y)


hamming_bits = _paired(lambda x, y: np.bitwise_count(words64(x) ^ words64(y)).sum(1, dtype=np.int64).tolist(), pa.int64(), "long", hamming)
xor_bytes = _paired(lambda x, y: [r.tobytes() for r in x ^ y], pa.binary(), "binary", xor)
diff_bytes = scalar(edit_script, pa.binary(), "binary")
patch_bytes = scalar(apply_script, pa.binary(), "binary")
find_polynomial = scalar(polynomial_seed, pa.int64(), "long")


def fnv1a_64(column):
    """FNV-1a of each value; a place of all values at once as long as many are that long."""

    def of(a: pa.Array) -> pa.Array:
        offsets, data, there = _layout(a)
        start, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        h, live, k = np.full(len(a), 0xCBF29CE484222325, np.uint64), len(a), 0
        size = size[order]
        while live and size[live - 1] <= k:
            live -= 1
        while live >= 64:
            rows = order[:live]
            h[rows] = (h[rows] ^ data[start[rows] + k]) * np.uint64(0x100000001B3)
            k += 1
            while live and size[live - 1] <= k:
                live -= 1
        for r, n in zip(order[:live].tolist(), size[:live].tolist()):
            h[r] = fnv1a(data[start[r] + k : start[r] + n].tobytes(), int(h[r]))
        return pa.array(h.view(np.int64), pa.int64(), mask=~there)

    return F.arrow_udf(of, "long")(column)


xxh64_seed0 = scalar(xxh64, pa.int64(), "long")
zstd_compress = scalar(compress, pa.binary(), "binary")
zstd_decompress = scalar(decompress, pa.binary(), "binary")


def low_polynomial(column):
    """The seed of a value's polynomial, searched for only up to an entropy of 3."""

    def of(a: pa.Array) -> pa.Array:
        out: list = [None] * len(a)
        for rows, m in by_length(a):
            for k in np.flatnonzero(entropies(m) <= 3.0).tolist():
                out[rows[k]] = polynomial_seed(m[k].tobytes())
        return pa.array(out, pa.int64())

    return F.arrow_udf(of, "long")(column)
