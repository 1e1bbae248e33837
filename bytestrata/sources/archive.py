"""Binary layouts: archive headers of versions 1 to 9, chunk tables, codebooks, mutations."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np

# Magics, sizes and caps of the binary formats.
MAGIC, MUTATION_MAGIC = b"CROM", b"CMUT"
V1_SIZE, V2_SIZE, V4_SIZE, V5_SIZE, V6_SIZE, V8_SIZE = 50, 68, 80, 112, 137, 141
MOST_DICTIONARY = 32 << 20
LITERAL_ID, PATCH_FLAG = (1 << 64) - 1, 1 << 60


@dataclass
class Header:
    version: int
    encrypted: bool = False
    passthrough: bool = False
    salt: bytes = bytes(16)
    original_hash: bytes = bytes(32)
    original_size: int = 0
    chunk_count: int = 0
    chunk_size: int = 0
    codebook_hashes: list[bytes] = field(default_factory=lambda: [bytes(8)] * 3)
    merkle_root: bytes = bytes(32)
    convergent: bool = False
    dictionary: bytes = b""


def header_size(version: int) -> int:
    """Bytes of a header without its dictionary; ValueError for an unknown version."""
    if version not in range(1, 10):
        raise ValueError(f"unsupported version {version}")
    return {1: V1_SIZE, 2: V2_SIZE, 3: V2_SIZE, 4: V4_SIZE, 5: V5_SIZE, 6: V6_SIZE, 7: V6_SIZE}.get(version, V8_SIZE)


def parse_header(data: bytes) -> Header:
    """ValueError for a wrong magic, an unknown version, a truncated header or an oversized dictionary."""
    if data[:4] != MAGIC or len(data) < V1_SIZE:
        raise ValueError("not an archive header")
    (version,) = struct.unpack_from("<H", data, 4)
    size = header_size(version)
    if len(data) < size:
        raise ValueError(f"header of version {version} needs {size} bytes, not {len(data)}")
    if version == 1:
        digest, length, count = struct.unpack_from("<32sQI", data, 6)
        return Header(1, original_hash=digest, original_size=length, chunk_count=count)
    enc, raw, salt, digest, length, count = struct.unpack_from("<BB16s32sQI", data, 6)
    out = Header(version, enc == 1, version > 2 and raw == 1, salt, digest, length, count)
    if version > 3:
        out.chunk_size, first = struct.unpack_from("<I8s", data, 68)
        out.codebook_hashes = [first, bytes(8), bytes(8)]
    if version > 4:
        out.merkle_root = data[80:112]
    if version > 5:
        flag, *out.codebook_hashes = struct.unpack_from("<B8s8s8s", data, 112)
        out.convergent = flag == 1
    if version > 7:
        (extra,) = struct.unpack_from("<I", data, 137)
        if extra > MOST_DICTIONARY or len(data) < size + extra:
            raise ValueError(f"dictionary of {extra} bytes is oversized or truncated")
        out.dictionary = data[size : size + extra]
    return out


def write_header(h: Header) -> bytes:
    out = bytearray(header_size(h.version))
    struct.pack_into("<4sH", out, 0, MAGIC, h.version)
    if h.version == 1:
        struct.pack_into("<32sQI", out, 6, h.original_hash, h.original_size, h.chunk_count)
        return bytes(out)
    struct.pack_into("<BB16s32sQI", out, 6, h.encrypted, h.passthrough and h.version > 2, h.salt, h.original_hash, h.original_size, h.chunk_count)
    if h.version > 3:
        struct.pack_into("<I8s", out, 68, h.chunk_size, h.codebook_hashes[0])
    if h.version > 4:
        out[80:112] = h.merkle_root
    if h.version > 5:
        struct.pack_into("<B8s8s8s", out, 112, h.convergent, *h.codebook_hashes)
    if h.version > 7:
        struct.pack_into("<I", out, 137, len(h.dictionary))
        out += h.dictionary
    return bytes(out)


def _entry(version: int) -> np.dtype:
    return np.dtype([("codebook_id", "<u8"), ("delta_offset", "<u8"), ("delta_size", "<u4"), ("original_size", "<u4")] + ([("codebook_index", "u1")] if version > 6 else []))


def parse_chunk_table(data: bytes, count: int, version: int) -> np.ndarray:
    kind = _entry(version)
    if len(data) < count * kind.itemsize:
        raise ValueError(f"{count} chunk entries need {count * kind.itemsize} bytes, not {len(data)}")
    return np.frombuffer(data, kind, count)


def write_chunk_table(rows: list[tuple], version: int) -> bytes:
    return np.array(rows, _entry(version)).tobytes()


def parse_mutation(data: bytes) -> tuple[int, int]:
    """Timestamp and payload size."""
    if len(data) < 16 or data[:4] != MUTATION_MAGIC:
        raise ValueError("not a mutation header")
    return struct.unpack_from("<qI", data, 4)


def write_mutation(timestamp: int, size: int) -> bytes:
    return struct.pack("<4sqI", MUTATION_MAGIC, timestamp, size)


# ---- codebooks ----
# The codebook's file suffix, its header's magic and sizes, and the chunk indexes that stand for no codebook.
CODEBOOK_SUFFIX, CODEBOOK_MAGIC, CODEBOOK_HEADER = ".cromdb", b"CROMDB", 512
LITERAL_INDEX, MICRO_INDEX, FRACTAL_INDEX = 255, 254, 253
CHUNKS_PER_BLOCK = 131_072


def write_codebook(patterns: list[bytes]) -> bytes:
    """A codebook file of patterns in the order of their ids; ValueError for none or unequal lengths."""
    if not patterns or len({len(p) for p in patterns}) > 1 or not patterns[0]:
        raise ValueError("a codebook needs patterns of one length")
    data = b"".join(patterns)
    head = struct.pack("<6sHHQQ32s", CODEBOOK_MAGIC, 1, len(patterns[0]), len(patterns), CODEBOOK_HEADER, hashlib.sha256(data).digest())
    return head.ljust(CODEBOOK_HEADER, b"\0") + data


def parse_codebook(data: bytes, verify: bool = True) -> tuple[bytes, list[bytes]]:
    """Build hash and patterns; ValueError for a wrong header, a truncated file or, on ``verify``, another hash."""
    if len(data) < CODEBOOK_HEADER:
        raise ValueError(f"a codebook header needs {CODEBOOK_HEADER} bytes, not {len(data)}")
    magic, version, size, count, start, digest = struct.unpack_from("<6sHHQQ32s", data)
    if magic != CODEBOOK_MAGIC or version != 1:
        raise ValueError(f"not a codebook of version 1: {magic!r}, {version}")
    if not size or start < CODEBOOK_HEADER or len(data) < start + size * count:
        raise ValueError(f"{count} codewords of {size} bytes from {start} do not fit into {len(data)} bytes")
    body = data[start : start + size * count]
    if verify and hashlib.sha256(body).digest() != digest:
        raise ValueError("the codebook's hash is another")
    return digest, [body[i : i + size] for i in range(0, len(body), size)]


# ---- manifests ----
_MANIFEST, _MANIFEST_ENTRY = struct.Struct("<H32sQI"), np.dtype([("codebook_id", "<u8"), ("delta_hash", "<u8"), ("chunk_size", "<u4")])


def write_manifest(digest: bytes, size: int, entries: np.ndarray) -> bytes:
    """Binary manifest of entries (``codebook_id``, ``delta_hash``, ``chunk_size``)."""
    return _MANIFEST.pack(1, digest, size, len(entries)) + np.asarray(entries, _MANIFEST_ENTRY).tobytes()


def parse_manifest(data: bytes) -> tuple[int, bytes, int, np.ndarray]:
    """Version, hash and size of the original, and entries; ValueError where it is truncated."""
    if len(data) < _MANIFEST.size:
        raise ValueError(f"a manifest needs {_MANIFEST.size} bytes, not {len(data)}")
    version, digest, size, count = _MANIFEST.unpack_from(data)
    if len(data) < _MANIFEST.size + count * _MANIFEST_ENTRY.itemsize:
        raise ValueError(f"{count} manifest entries are truncated")
    return version, digest, size, np.frombuffer(data, _MANIFEST_ENTRY, count, _MANIFEST.size)


# ---- whole archives ----
def merkle(leaves: list[bytes]) -> bytes:
    """Root of a Merkle tree: an odd level repeats its last node, a single leaf is hashed with itself."""
    level = [hashlib.sha256(x + y).digest() for x, y in zip(leaves[::2], [*leaves[1::2], leaves[-1]])]
    return merkle(level) if len(level) > 1 else level[0]


def write_archive(header: Header, table: bytes, blocks: list[bytes]) -> bytes:
    """Header, sizes of the blocks, chunk table, blocks."""
    return write_header(header) + np.array([len(b) for b in blocks], "<u4").tobytes() + table + b"".join(blocks)


def parse_archive(data: bytes) -> tuple[Header, np.ndarray, list[tuple[int, int]], bytes]:
    """Header, chunk table, (offset, size) of each block, and the content of a passthrough archive.

    A header without chunks is a passthrough. ValueError for a truncated table or block.
    """
    h = parse_header(data)
    at = header_size(h.version) + len(h.dictionary)
    if h.passthrough or not h.chunk_count:
        return h, np.empty(0, _entry(h.version)), [], data[at:]
    if h.encrypted:
        raise ValueError("the chunk table is encrypted")
    count = -(-h.chunk_count // CHUNKS_PER_BLOCK) if h.version > 1 else 0
    if len(data) < at + 4 * count:
        raise ValueError("the block table is truncated")
    sizes = np.frombuffer(data, "<u4", count, at).astype(np.int64)
    at += 4 * count
    table = parse_chunk_table(data[at:], h.chunk_count, h.version)
    at += table.nbytes
    ends = at + np.cumsum(sizes)
    if count and ends[-1] > len(data):
        raise ValueError("a block is truncated")
    return h, table, list(zip((ends - sizes).tolist(), sizes.tolist())), b""
