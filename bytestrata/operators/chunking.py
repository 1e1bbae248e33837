"""Chunkers: objects (``object_id``, ``content``) to rows (``chunk_idx``, ``offset``, ``size``, ``data``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, native
from ..session import ship

BLOCK = 16 << 20


def _rows(df: DataFrame, bounds: Column) -> DataFrame:
    """Rows from an array of (offset, size); other columns of ``df`` but ``content`` stay.

    The bytes are cut before the array is dealt out: no row after that carries the whole content,
    which a Python UDF on the rows would else queue once for each chunk.
    """
    keep = [c for c in df.columns if c != "content"]
    piece = lambda b: F.struct(b["offset"].cast("long").alias("offset"), b["size"].cast("int").alias("size"), F.substring("content", b["offset"].cast("int") + 1, b["size"].cast("int")).alias("data"))
    out = df.select(*keep, F.posexplode(F.transform(bounds, piece)).alias("chunk_idx", "_b"))
    return out.select(*keep, "chunk_idx", F.col("_b.offset").alias("offset"), F.col("_b.size").alias("size"), F.expr(f"cast(_b.offset div {BLOCK} as int)").alias("block_id"), F.col("_b.data").alias("data"))


def fixed(df: DataFrame, size: int = 128) -> DataFrame:
    """Chunks of ``size`` bytes (128 where it is not positive); the last may be shorter, empty content has none."""
    size = size if size > 0 else 128
    n = F.octet_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return _rows(df, F.transform(starts, lambda i: F.struct((i * size).alias("offset"), F.least(F.lit(size), n - i * size).alias("size"))))


def _udf(ends):
    def bounds(contents: pa.Array) -> pa.Array:
        out = []
        for b in contents.to_pylist():
            at = [0, *ends(b or b"")]
            out.append([{"offset": x, "size": y - x} for x, y in zip(at, at[1:])])
        return pa.array(out, pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int32())])))

    return F.arrow_udf(bounds, "array<struct<offset:bigint,size:int>>")


def fastcdc(df: DataFrame, target: int = 128) -> DataFrame:
    ship(df.sparkSession)
    return _rows(df, _udf(lambda b: arrow.fastcdc_ends(b, target))("content"))


def cdc(df: DataFrame, target: int = 128) -> DataFrame:
    ship(df.sparkSession)
    return _rows(df, _udf(lambda b: arrow.cdc_ends(b, target))("content"))


def delimited(df: DataFrame, delimiter: bytes = b"\n", most: int = 1024) -> DataFrame:
    """Chunks that end after ``delimiter``, cut at ``most`` bytes."""
    ship(df.sparkSession)
    return _rows(df, _udf(lambda b: arrow.delimited_ends(b, delimiter[0], 1, most))("content"))


def contextual(df: DataFrame, size: int = 128) -> DataFrame:
    """Chunks by the content's type."""
    ship(df.sparkSession)

    def bounds(contents: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for b, k in zip(contents.to_pylist(), kinds.to_pylist()):
            at = [0, *arrow.contextual_ends(b or b"", k, size)]
            out.append([{"offset": x, "size": y - x} for x, y in zip(at, at[1:])])
        return pa.array(out, pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int32())])))

    kind = native.content_type(F.substring("content", 1, 8192))
    return _rows(df, F.arrow_udf(bounds, "array<struct<offset:bigint,size:int>>")("content", kind))


def reassemble(chunks: DataFrame, key: str = "object_id") -> DataFrame:
    """``key`` and ``content``: its chunks in order."""
    return chunks.groupBy(key).agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY chunk_idx)").alias("content"))


CHUNKERS = {"fixed": fixed, "fastcdc": fastcdc, "cdc": cdc, "delimited": delimited, "contextual": contextual}


def register(spark) -> None:
    """SQL names: ``bytestrata_chunks(content, size)`` as a table function; ``bytestrata_entropy``,
    ``bytestrata_fnv1a`` and ``bytestrata_xxh64`` of bytes."""
    ship(spark)

    @F.udtf(returnType="chunk_idx int, offset long, size int, data binary")
    class Chunks:
        def eval(self, content: bytes, size: int):
            for k, at in enumerate(range(0, len(content or b""), size)):
                part = content[at : at + size]
                yield k, at, len(part), part

    spark.udtf.register("bytestrata_chunks", Chunks)
    for name, f, kind in (("entropy", arrow.entropy_of, "double"), ("fnv1a", lambda b: arrow._signed(arrow.fnv1a(b)), "long"), ("xxh64", arrow.xxh64, "long")):
        spark.udf.register(f"bytestrata_{name}", lambda b, f=f: None if b is None else f(bytes(b)), kind)
