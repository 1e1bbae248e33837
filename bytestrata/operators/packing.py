"""Routing of chunks to encodings, residuals, offsets, and decoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow, native
from ..session import ship
from . import search


@dataclass(frozen=True)
class PackOptions:
    """``mode``: archive (lossless), edge (codeword only), stream (only noise is literal) or bytes (no fractal, no patch)."""

    mode: str = "archive"
    chunk_size: int = 128
    literal_entropy: float = 3.0
    stream_entropy: float = 7.8
    least_similarity: float = 0.20
    patch_similarity: float = 0.80
    patch_noise: float = 0.95
    method: str = "lsh"
    stop: float = 0.05  # share of differing bits at which no further codebook is asked


def route(chunks: DataFrame, books, options: PackOptions = PackOptions()) -> DataFrame:
    """Chunk entries: ``chunks`` with ``encoding``, match columns, ``entropy``, ``similarity``, ``residual``, ``delta_size``.

    Nothing is shuffled and rows keep their order: each batch matches its distinct chunks once,
    and a row stands by itself. A chunk without a codeword is a literal.
    """
    ship(chunks.sparkSession)
    o = options
    # UDFs that do not need each other share one Python worker: two for a task, whatever the mode
    known = chunks.select("*", arrow.shannon_entropy("data").alias("entropy"), arrow.low_polynomial("data").alias("seed"), search.matched(chunks.sparkSession, books, o.method, o.stop)("data").alias("match"))
    known = known.select(*chunks.columns, "entropy", "seed", "match.*")
    known = known.withColumn("similarity", native.similarity(F.col("distance"), F.octet_length("data")))
    noisy = native.bypasses(F.col("data"), F.col("entropy"))
    if o.mode == "stream":
        literal, fractal = (F.col("entropy") > o.stream_entropy) | F.col("pattern").isNull(), F.lit(False)
    else:
        literal = F.col("pattern").isNull()
        if o.mode != "edge":
            literal = literal | (F.col("entropy") > o.literal_entropy) | noisy | (F.col("similarity") < o.least_similarity)
        fractal = F.col("seed").isNotNull() if o.mode in ("archive", "edge") else F.lit(False)
    known = known.withColumn("encoding", F.when(fractal, "fractal").when(literal, "literal").otherwise("xor"))
    xor = F.when(F.col("encoding") == "xor", F.col("data"))  # a null argument costs no work, a WHEN around the call would
    script = F.lit(None).cast("binary")
    if o.mode == "archive":
        close = F.col("similarity") >= F.when(F.col("entropy") > 6, o.patch_noise).otherwise(o.patch_similarity)
        script = arrow.diff_bytes(F.when((F.col("encoding") == "xor") & close, F.col("data")), F.col("pattern"))
    known = known.select("*", arrow.xor_bytes(xor, F.col("pattern")).alias("x"), script.alias("p"))
    if o.mode == "archive":
        patched = F.col("p").isNotNull() & (F.octet_length("p") < F.octet_length("x")) & (F.octet_length("p") <= 256)
        known = known.withColumn("encoding", F.when(patched, "patch").otherwise(F.col("encoding")))
    nothing = F.unhex(F.lit(""))
    residual = F.when(F.col("encoding") == "literal", F.col("data")).when(F.col("encoding") == "patch", F.col("p")).when(F.col("encoding") == "xor", nothing if o.mode == "edge" else F.col("x")).otherwise(nothing)
    used = F.col("encoding").isin("xor", "patch")
    known = known.select(
        *chunks.columns, "encoding", "entropy", F.when(F.col("encoding") == "literal", F.lit(0.0)).when(F.col("encoding") == "fractal", F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
        F.when(used, F.col("codebook_index")).alias("codebook_index"), F.when(used, F.col("codebook_id")).when(F.col("encoding") == "fractal", F.col("seed")).alias("codebook_id"),
        F.when(used, F.col("distance")).alias("distance"), residual.alias("residual"),
    )
    return known.withColumn("delta_size", F.octet_length("residual"))


def offsets(entries: DataFrame, key: str = "object_id") -> DataFrame:
    """``delta_offset``: the residual bytes of an object before a chunk."""
    w = Window.partitionBy(key).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("delta_offset", (F.sum("delta_size").over(w) - F.col("delta_size")).cast("long"))


def decode(entries: DataFrame, books, jitter: int = 0, seed: int = 0) -> DataFrame:
    """``entries`` with ``decoded``. A codeword is looked up by codebook and id; without a residual
    it stands for its chunk. ``jitter`` shifts codeword ids by up to that many, seeded."""
    ship(entries.sparkSession)
    books = books if isinstance(books, list) else [books]
    book = None
    for k, b in enumerate(books):
        part = b.select(F.lit(k).alias("codebook_index"), F.col("codebook_id").alias("_id"), "pattern")
        book = part if book is None else book.unionByName(part)
    moved = F.col("codebook_id")
    if jitter:
        shift = F.pmod(F.xxhash64("codebook_id", "chunk_idx", F.lit(seed)), F.lit(2 * jitter + 1)) - jitter
        size = book.groupBy("codebook_index").agg(F.count("*").alias("_n"))
        entries = entries.join(F.broadcast(size), "codebook_index", "left")
        moved = F.when(F.col("_n").isNotNull(), F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col("codebook_id") + shift))).otherwise(moved)
    out = entries.withColumn("_id", F.when(F.col("encoding").isin("xor", "patch"), moved)).join(book, ["codebook_index", "_id"], "left")
    plain = F.when(F.col("encoding") == "literal", F.col("residual")).when(F.col("encoding") == "fractal", F.unhex(native.polynomial(F.col("codebook_id"), F.col("size"))))
    plain = plain.when(F.col("encoding") == "patch", arrow.patch_bytes(F.when(F.col("encoding") == "patch", F.col("pattern")), F.col("residual")))
    plain = plain.when(F.col("delta_size") == 0, F.substring("pattern", F.lit(1), F.col("size"))).otherwise(arrow.xor_bytes("residual", "pattern"))
    return out.withColumn("decoded", plain).drop("_id", "pattern", *(["_n"] if jitter else []))


def metrics(entries: DataFrame, *by: str) -> DataFrame:
    """Counts by encoding, sizes, mean similarity and the three hit rates."""
    kind = lambda k: F.sum((F.col("encoding") == k).cast("long")).alias("patches" if k == "patch" else f"{k}s")
    matched = F.col("encoding").isin("xor", "patch")
    rate = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return entries.groupBy(*by).agg(
        F.count("*").alias("chunks"), kind("literal"), kind("fractal"), kind("xor"), kind("patch"), F.sum(F.col("size").cast("long")).alias("bytes"),
        F.sum(F.col("delta_size").cast("long")).alias("residual_bytes"), F.round(F.avg("similarity"), 6).alias("avg_similarity"),
        rate(matched & (F.col("similarity") >= 0.5), "hit_rate_ge50"), rate(matched & (F.col("similarity") >= 0.95), "hit_rate_ge95"),
    )
