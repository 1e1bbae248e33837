"""Archives: objects packed into their binary form, stored, read again and unpacked.

An object's chunks make blocks of a fixed number of chunks; each block is compressed by itself,
so the unit of work is a block. An archive is one value of at most 2 GB.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow, native
from ..session import ship
from ..sources import archive
from . import chunking, packing

HEAD = 65_536
ENTRY = "object_id {kind}, chunk_idx int, codebook_index int, codebook_id bigint, encoding string, size int, delta_offset bigint, delta_size int, residual binary"


def passthrough(content: Column, mode: str = "archive") -> Column:
    """Whether an object is stored as it is: compressed, of low entropy (but in edge mode), or small."""
    head = F.substring(content, 1, HEAD)
    e = arrow.shannon_entropy(head)
    small = F.octet_length(content) < 256
    return small if mode == "edge" else small | native.bypasses(head, e) | (e < 1.0)


def _kind(df: DataFrame) -> str:
    return df.schema["object_id"].dataType.simpleString()


def _block(t: pa.Table, at: int) -> tuple[bytes, bytes, int]:
    """Table and compressed pool of a block's entries, and the residual bytes after it; ``at``: those before it."""
    col = lambda c: t.column(c).combine_chunks()
    encoding = np.array(col("encoding").to_pylist())
    rows = np.zeros(len(t), archive._entry(7))
    ids = col("codebook_id").fill_null(0).to_numpy().astype(np.uint64)
    rows["codebook_id"] = np.where(encoding == "literal", np.uint64(archive.LITERAL_ID), np.where(encoding == "patch", ids | np.uint64(archive.PATCH_FLAG), ids))
    index = col("codebook_index").fill_null(archive.LITERAL_INDEX).to_numpy()
    rows["codebook_index"] = np.where(encoding == "fractal", archive.FRACTAL_INDEX, index)
    rows["delta_size"] = col("delta_size").to_numpy()
    ends = at + np.cumsum(rows["delta_size"], dtype=np.int64)
    rows["delta_offset"] = ends - rows["delta_size"]
    rows["original_size"] = col("size").to_numpy()
    return rows.tobytes(), arrow.compress(b"".join(col("residual").to_pylist())), int(ends[-1])


_PACKED = "object_id {kind}, archive binary, passthrough boolean, original bigint"
_NEEDED = ["codebook_index", "codebook_id", "encoding", "size", "delta_size", "residual"]


def _archive(content: bytes, some: list[tuple[bytes, bytes, int]], options: packing.PackOptions) -> tuple[bytes, bool]:
    """An object's archive from its blocks (table, pool, chunks), none if it passes through; whether it does."""
    import hashlib

    h = archive.Header(7, passthrough=not some, original_hash=hashlib.sha256(content).digest(), original_size=len(content), chunk_size=options.chunk_size)
    if some:
        h.chunk_count = sum(n for _, _, n in some)
        h.merkle_root = archive.merkle([hashlib.sha256(p).digest() for _, p, _ in some])
        data = archive.write_archive(h, b"".join(t for t, _, _ in some), [p for _, p, _ in some])
        if options.mode == "edge" or not len(data) > len(content) > archive.V8_SIZE:
            return data, False
        h = archive.Header(7, passthrough=True, original_hash=h.original_hash, original_size=h.original_size, chunk_size=h.chunk_size, merkle_root=h.merkle_root)
    return archive.write_header(h) + content, True


def pack(objects: DataFrame, books, options: packing.PackOptions = packing.PackOptions()) -> DataFrame:
    """``object_id``, ``archive``, ``passthrough``, ``original``, ``packed`` for every object (``object_id``, ``content``).

    Objects that are small, compressed or of low entropy pass through; one whose archive would be
    larger than itself does so afterwards (not in edge mode). Null content: an empty object.
    Nothing is shuffled: an object's chunks follow each other in its task, which closes its archive
    when the next object begins, so that objects with one id stay apart too.
    """
    ship(objects.sparkSession)
    kind = _kind(objects)
    o = objects.select("object_id", F.coalesce("content", F.unhex(F.lit(""))).alias("content"))
    o = o.withColumn("passthrough", passthrough(F.col("content"), options.mode))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1)
            for k in range(len(batch)):  # one at a time: an archive may have 2 GB
                content = contents[k].as_py()
                data, flag = _archive(content, [], options)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([data], pa.binary()), pa.array([flag]), pa.array([len(content)], pa.int64())], ["object_id", "archive", "passthrough", "original"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ident, parts, content, wait, have, at = None, None, [], [], [], 0, 0

        def close() -> None:
            """The waiting entries become a block."""
            nonlocal wait, have, at
            if have:
                table, pool, at = _block(pa.Table.from_batches(wait), at)
                parts.append((table, pool, have))
                wait, have = [], 0

        def done() -> pa.RecordBatch:
            close()
            whole = b"".join(content)
            data, flag = _archive(whole, parts, options)
            return pa.RecordBatch.from_arrays([ident, pa.array([data], pa.binary()), pa.array([flag]), pa.array([len(whole)], pa.int64())], ["object_id", "archive", "passthrough", "original"])

        for batch in batches:
            rows = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(rows)]
            for lo, hi in zip([0, *ends], ends):
                if lo == hi:
                    continue
                if row != rows[lo]:
                    if row is not None:
                        yield done()
                    row, ident, parts, content, wait, have, at = rows[lo], batch.column(1).slice(lo, 1), [], [], [], 0, 0
                content.append(b"".join(batch.column(2).slice(lo, hi - lo).to_pylist()))
                while lo < hi:
                    n = min(hi - lo, archive.CHUNKS_PER_BLOCK - have)
                    wait.append(batch.slice(lo, n).select(_NEEDED))
                    have, lo = have + n, lo + n
                    if have == archive.CHUNKS_PER_BLOCK:
                        close()
        if row is not None:
            yield done()

    cols = _PACKED.format(kind=kind)
    chunks = chunking.fixed(o.where("not passthrough").select(F.monotonically_increasing_id().alias("_row"), "object_id", "content"), options.chunk_size)
    entries = packing.route(chunks, books, options).select("_row", "object_id", "data", *_NEEDED)
    out = o.where("passthrough").select("object_id", "content").mapInArrow(stored, cols).unionByName(entries.mapInArrow(built, cols))
    return out.select("object_id", "archive", "passthrough", "original", F.octet_length("archive").cast("long").alias("packed"))


HEADER = "version int, passthrough boolean, original_hash binary, original_size bigint, chunk_count bigint, chunk_size bigint, merkle_root binary, error string"


def metadata(archives: DataFrame) -> DataFrame:
    """``object_id`` and its header's fields; ``error`` says why a header could not be read."""
    ship(archives.sparkSession)

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in HEADER.split(', '))}>")
    def read(data: pa.Array) -> pa.Array:
        out = []
        for d in data:
            try:
                h = archive.parse_header(d.as_py() or b"")
                out.append({"version": h.version, "passthrough": h.passthrough or not h.chunk_count, "original_hash": h.original_hash, "original_size": h.original_size, "chunk_count": h.chunk_count, "chunk_size": h.chunk_size, "merkle_root": h.merkle_root})
            except ValueError as e:
                out.append({"error": str(e)})
        kinds = [("version", pa.int32()), ("passthrough", pa.bool_()), ("original_hash", pa.binary()), ("original_size", pa.int64()), ("chunk_count", pa.int64()), ("chunk_size", pa.int64()), ("merkle_root", pa.binary()), ("error", pa.string())]
        return pa.array(out, pa.struct(kinds))

    return archives.select("object_id", read("archive").alias("h")).select("object_id", "h.*")


def entry_batches(object_id: pa.Array, data: bytes) -> Iterator[pa.RecordBatch]:
    """Chunk entries of an archive, a block at a time; a passthrough archive is one literal."""
    h, table, places, content = archive.parse_archive(data)
    names = ["object_id", "chunk_idx", "codebook_index", "codebook_id", "encoding", "size", "delta_offset", "delta_size", "residual"]
    if not len(table):
        one = [object_id, pa.array([0], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array(["literal"]), pa.array([len(content)], pa.int32()), pa.array([0], pa.int64()), pa.array([len(content)], pa.int32()), pa.array([content], pa.binary())]
        yield pa.RecordBatch.from_arrays(one, names)
        return
    for k, (at, size) in enumerate(places):
        rows = table[k * archive.CHUNKS_PER_BLOCK : (k + 1) * archive.CHUNKS_PER_BLOCK]
        pool = arrow.decompress(data[at : at + size])
        index = rows["codebook_index"].astype(np.int32) if "codebook_index" in rows.dtype.names else np.zeros(len(rows), np.int32)
        literal, fractal = rows["codebook_id"] == archive.LITERAL_ID, index == archive.FRACTAL_INDEX
        patch = ~literal & (rows["codebook_id"] & np.uint64(archive.PATCH_FLAG) > 0)
        ids = (rows["codebook_id"] & np.uint64(archive.PATCH_FLAG - 1)).astype(np.int64)
        lo = (rows["delta_offset"] - rows["delta_offset"][0]).astype(np.int64)
        if len(rows) and lo[-1] + rows["delta_size"][-1] > len(pool):
            raise ValueError("a residual reaches beyond its block")
        residual = pa.array([pool[a : a + n] for a, n in zip(lo.tolist(), rows["delta_size"].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([object_id] * len(rows)) if len(rows) else object_id[:0], pa.array(np.arange(len(rows), dtype=np.int32) + k * archive.CHUNKS_PER_BLOCK),
                pa.array(index, mask=literal | fractal), pa.array(ids, mask=literal), pa.array(np.select([literal, fractal, patch], ["literal", "fractal", "patch"], "xor").tolist(), pa.string()),
                pa.array(rows["original_size"].astype(np.int32)), pa.array(rows["delta_offset"].astype(np.int64)), pa.array(rows["delta_size"].astype(np.int32)), residual,
            ],
            names,
        )


def read(archives: DataFrame) -> DataFrame:
    """Chunk entries of archives (``object_id``, ``archive``). A truncated or foreign archive fails the job."""
    ship(archives.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from entry_batches(batch.column(0).slice(i, 1), batch.column(1)[i].as_py())

    return archives.select("object_id", "archive").mapInArrow(of, ENTRY.format(kind=_kind(archives)))


def block_offsets(archives: DataFrame) -> DataFrame:
    """``object_id``, ``block_id``, ``offset``, ``size`` of every compressed block in its archive."""
    ship(archives.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                places = archive.parse_archive(batch.column(1)[i].as_py())[2]
                if places:
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(places))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(places)), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*places))], ["object_id", "block_id", "offset", "size"])

    return archives.select("object_id", "archive").mapInArrow(of, f"object_id {_kind(archives)}, block_id int, offset bigint, size bigint")


def unpack(archives: DataFrame, books) -> DataFrame:
    """``object_id``, ``content`` of archives; objects without bytes come back empty."""
    out = packing.decode(read(archives), books)
    return chunking.reassemble(out.select("object_id", "chunk_idx", F.col("decoded").alias("data")))


def pool_entropy(archives: DataFrame) -> DataFrame:
    """``object_id``, ``entropy`` and ``randomness`` (percent) of the compressed blocks."""
    ship(archives.sparkSession)

    @F.arrow_udf("binary")
    def pool(data: pa.Array) -> pa.Array:
        out = []
        for d in data:
            d = d.as_py()
            places = archive.parse_archive(d)[2]
            out.append(d[places[0][0] :] if places else None)
        return pa.array(out, pa.binary())

    out = archives.select("object_id", arrow.shannon_entropy(pool("archive")).alias("entropy")).where("entropy is not null")
    return out.select("object_id", F.round("entropy", 6).alias("entropy"), F.round(F.col("entropy") / 8 * 100, 6).alias("randomness"))


def export(archives: DataFrame, folder: str, suffix: str = ".bin") -> DataFrame:
    """Writes each archive to a file of its own in ``folder`` (a path or URI that every worker can write), named by
    the last part of its ``object_id``; returns ``path`` and ``bytes``. A file written twice is the same."""
    ship(archives.sparkSession)
    root = folder if "://" in folder else os.path.abspath(folder)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        for batch in batches:
            paths = [f"{base}/{str(i.as_py()).rsplit('/', 1)[-1]}{suffix}" for i in batch.column(0)]
            data = [d.as_py() or b"" for d in batch.column(1)]
            for path, d in zip(paths, data):
                with system.open_output_stream(path) as out:
                    out.write(d)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([len(d) for d in data], pa.int64())], ["path", "bytes"])

    return archives.select(F.col("object_id").cast("string"), "archive").mapInArrow(of, "path string, bytes bigint")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``object_id`` (path) and ``archive`` of archive files, to be read by ``read``, ``metadata`` and the others."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("object_id"), F.col("content").alias("archive"))


# ---- codebook files ----
def codebook_bytes(book: DataFrame) -> bytes:
    """The file of a codebook, whose size is bounded where it is trained."""
    from .search import _collected

    return archive.write_codebook([p for _, p in _collected(book)])


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes bytes by Hadoop's file systems, so that a path may be on any of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    try:
        out.write(data)
    finally:
        out.close()


def codebook_of(spark: SparkSession, data: bytes, index: int = 0) -> DataFrame:
    """A codebook from a file's bytes: ``codebook_index``, ``codebook_id``, ``pattern``, ``bucket``, ``build_hash``."""
    digest, patterns = archive.parse_codebook(data)
    rows = [(index, i, p, digest.hex()) for i, p in enumerate(patterns)]
    df = spark.createDataFrame(rows, "codebook_index int, codebook_id long, pattern binary, build_hash string")
    return df.withColumn("bucket", native.lsh_bucket(F.col("pattern")))


def read_codebook(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    """A codebook file, read by Spark's binary files."""
    return codebook_of(spark, bytes(spark.read.format("binaryFile").load(path).first()["content"]), index)


def swap(current: DataFrame, peer: DataFrame) -> DataFrame:
    """The peer's codebook in place of the current one, but the current one where both have one build hash."""
    same = current.select("build_hash").distinct().join(peer.select("build_hash").distinct(), "build_hash", "left_semi").count() > 0
    return current if same else peer


def accepted(objects: DataFrame, candidate: bytes, peer: str, trusted: DataFrame, *, most: int = 32 << 20, ratio: float = 0.95) -> tuple[bool, str]:
    """Whether a peer's codebook file may be used, and why not: the peer must be trusted (``peer`` of
    ``trusted``), the file within ``most`` bytes and readable, and the sample's archives no larger
    than ``ratio`` of the sample."""
    spark = objects.sparkSession
    if trusted.where(F.col("peer") == peer).isEmpty():
        return False, "not trusted"
    if len(candidate) > most:
        return False, "too large"
    try:
        book = codebook_of(spark, candidate)
    except ValueError as e:
        return False, str(e)
    size = pack(objects, book, packing.PackOptions(chunk_size=64)).agg(F.sum("packed").alias("p"), F.sum("original").alias("o")).first()
    got = size["p"] / max(1, size["o"] or 0)
    return got <= ratio, f"ratio {got:.3f}"

