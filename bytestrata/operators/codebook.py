"""Codebook training: pattern frequencies, elite selection, merges, augmentation, byte-pair vocabularies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native

SEED_BOOST = 100


def frequencies(chunks: DataFrame, size: int = 128) -> DataFrame:
    """``data``, ``count`` of the full-size chunks."""
    return chunks.where(F.col("size") == size).groupBy("data").agg(F.count("*").alias("count"))


def weighted(*tables: tuple[DataFrame, int]) -> DataFrame:
    """Sum of counts over (frequencies, weight) tables."""
    out = None
    for table, weight in tables:
        part = table.select("data", (F.col("count") * weight).alias("count"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("data").agg(F.sum("count").alias("count"))


def elite(table: DataFrame, most: int = 8192, per_bucket: int = 64) -> DataFrame:
    """The ``most`` most frequent patterns, at most ``per_bucket`` in a bucket; ties by bytes.

    The cap is applied in the global order, so a rank in each bucket and a global limit are
    exact; the limit keeps only ``most`` rows of each task.
    """
    rank = Window.partitionBy("bucket").orderBy(F.desc("count"), "data")
    out = table.withColumn("bucket", native.lsh_bucket(F.col("data"))).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_bucket)
    return out.orderBy(F.desc("count"), "data").limit(most).drop("rank")


def codebook(selected: DataFrame, index: int = 0) -> DataFrame:
    """Patterns laid out by bucket: ``codebook_index``, ``codebook_id`` from 0, ``pattern``, ``bucket``.

    ``selected`` has at most the codebook's size, so one sorted partition holds it."""
    order = Window.orderBy("bucket", F.desc("count"), "data")
    return selected.select(F.lit(index).alias("codebook_index"), (F.row_number().over(order) - 1).cast("long").alias("codebook_id"), F.col("data").alias("pattern"), "bucket", "count")


def train(chunks: DataFrame, size: int = 128, most: int = 8192, per_bucket: int = 64, augment_: bool = False) -> DataFrame:
    table = frequencies(chunks, size)
    return codebook(elite(augment(table, most // 2) if augment_ else table, most, per_bucket))


def incremental(table: DataFrame, old: DataFrame) -> DataFrame:
    """Counts where every old pattern weighs ``SEED_BOOST``."""
    return weighted((table, 1), (old.select(F.col("pattern").alias("data"), F.lit(1).alias("count")), SEED_BOOST))


def transfer(base: DataFrame, table: DataFrame, most: int = 8192, per_bucket: int = 64) -> DataFrame:
    """The base patterns first, then new elites that the base lacks, ``most`` in all."""
    new = elite(table, most, per_bucket).join(base.select(F.col("pattern").alias("data")), "data", "left_anti")
    both = base.select(F.col("pattern").alias("data"), F.lit(0).alias("source"), F.col("codebook_id").alias("rank"), F.lit(0).cast("long").alias("count"))
    both = both.unionByName(new.select("data", F.lit(1).alias("source"), (-F.col("count")).alias("rank"), "count"))
    return both.orderBy("source", "rank", "data").limit(most).select("data", "source", "count")


def augment(table: DataFrame, most: int) -> DataFrame:
    """Counts with shifted and rotated variants, at half the count, of the ``most`` most frequent patterns."""
    top = table.where("count > 1").orderBy(F.desc("count"), "data").limit(most)
    n = F.octet_length("data")
    zero = F.unhex(F.lit("00"))
    variants = F.array(F.concat(F.expr("substring(data, 2)"), zero), F.concat(zero, F.substring("data", F.lit(1), n - 1)), F.concat(F.expr("substring(data, 2)"), F.substring("data", 1, 1)))
    made = top.select(F.explode(variants).alias("data"), F.expr("count div 2").alias("count"))
    return weighted((table, 1), (made, 1))


def pair_counts(objects: DataFrame) -> DataFrame:
    """Adjacent byte pairs ``a``, ``b`` and their ``count``, overlapping ones included."""
    h = F.hex("content")
    n = F.octet_length("content")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(h, i * 2 - 1, F.lit(4)))
    out = objects.where(n > 1).select(F.explode(pairs).alias("p"))
    return out.groupBy(F.conv(F.substring("p", 1, 2), 16, 10).cast("int").alias("a"), F.conv(F.substring("p", 3, 2), 16, 10).cast("int").alias("b")).agg(F.count("*").alias("count"))


def bpe(objects: DataFrame, vocabulary: int = 300, longest: int = 128, most_bytes: int = 50 << 20) -> list[tuple[int, bytes, int]]:
    """(token id, bytes, frequency) of a byte-pair vocabulary, 256 bytes first.

    The corpus of a vocabulary is bounded: whole objects in order of their ids, to ``most_bytes``;
    it comes to the driver as one array of tokens. Each round merges the most frequent pair of
    neighbours within an object (overlaps counted, ties by bytes) from left to right, until no
    pair occurs twice or the vocabulary is full. Tokens have at most ``longest`` bytes.
    """
    w = Window.orderBy("object_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = objects.select("object_id", F.octet_length("content").cast("long").alias("n")).where("n > 0")
    # objects are shorter than the corpus: one that begins within it is among its ``most_bytes`` smallest ids
    some = sizes.orderBy("object_id").limit(most_bytes).withColumn("end", F.sum("n").over(w)).where(F.col("end") <= most_bytes).select("object_id")
    parts = objects.join(some, "object_id", "left_semi").orderBy("object_id").select("content").toLocalIterator()
    stream = [x for r in parts for x in (np.frombuffer(r["content"], np.uint8).astype(np.int32), np.array([-1], np.int32))]
    tokens = np.concatenate(stream) if stream else np.empty(0, np.int32)
    out = [(i, bytes([i]), 0) for i in range(256)]
    while len(out) < vocabulary:
        size = np.array([len(b) for _, b, _ in out])
        pairs = (tokens[:-1] >= 0) & (tokens[1:] >= 0)
        pairs &= size[tokens[:-1]] + size[tokens[1:]] <= longest
        keys, counts = np.unique(tokens[:-1][pairs].astype(np.int64) * len(out) + tokens[1:][pairs], return_counts=True)
        if not len(keys) or counts.max() < 2:
            break
        best = keys[counts == counts.max()]
        a, b = min(((int(k) // len(out), int(k) % len(out)) for k in best), key=lambda p: (out[p[0]][1], out[p[1]][1]))
        at = np.flatnonzero((tokens[:-1] == a) & (tokens[1:] == b))
        if a == b:  # a run of one token merges by twos from its left
            first = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
        tokens[at] = len(out)
        tokens = np.delete(tokens, at + 1)
        out.append((len(out), out[a][1] + out[b][1], int(counts.max())))
    return out


def overlap(base: DataFrame, table: DataFrame) -> DataFrame:
    """How many patterns of a codebook occur in frequencies: ``present``, ``patterns``."""
    return base.join(table.select(F.col("data").alias("pattern"), F.lit(1).alias("there")), "pattern", "left").agg(F.count("there").alias("present"), F.count("*").alias("patterns"))


def counters(chunks: DataFrame, book: DataFrame, size: int = 128) -> DataFrame:
    """What a training saw and chose: ``bytes``, ``chunks``, ``full_chunks``, ``unique_patterns``, ``codewords``."""
    seen = chunks.groupBy("data").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    full = F.col("size") == size
    seen = seen.agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("chunks"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("full_chunks"), F.sum(full.cast("long")).alias("unique_patterns"))
    return seen.join(F.broadcast(book.agg(F.count("*").alias("codewords"))))
