"""Best-fit-decreasing sharding of indivisible groups.

Groups (equal texts) are summed in a distributed aggregation; each is an item. Items, sorted by
size, enter the tightest bin that still holds them, found in a balanced search tree of remaining
capacities; the capacity is the smallest at which they fit the shards.

Items of equal size follow each other, and a bin that took one stays the tightest until it can
take no more. So only the number of items of each size is needed to know how many of them each
bin takes. Sizes count with ``DIGITS`` significant bits (rounded up; below 2^DIGITS exactly),
so that the driver holds at most 2^(DIGITS - 1) sizes for each power of two, whatever the input.
Groups of a size are numbered on the workers, and take their shard from the ranges of numbers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import cut, numbered, written

DIGITS = 12


class CapacityTree:
    """A treap of (remaining capacity, bin): logarithmic insert and tightest fit."""

    def __init__(self, seed: int = 0):
        self.root, self.rng = None, random.Random(seed)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return [node[0], node[1], node[2], a], b
        a, b = self._split(node[2], key)
        return a, [node[0], node[1], b, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def add(self, left: int, bin_: int) -> None:
        a, b = self._split(self.root, (left, bin_))
        self.root = self._merge(self._merge(a, [(left, bin_), self.rng.random(), None, None]), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least capacity of at least ``size``; ties: the first bin."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        node = b
        while node[2] is not None:
            node = node[2]
        low, rest = self._split(b, (node[0][0], node[0][1] + 1))
        self.root = self._merge(a, rest)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """A bin from 0 for each size; None if more than ``most`` bins or an item above ``capacity``.

    Equal sizes keep their order. No sizes: an empty list.
    """
    out, tree, bins = [0] * len(sizes), CapacityTree(), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i] > capacity:
            return None
        found = tree.take(sizes[i])
        if found is None:
            if bins == most:
                return None
            found, bins = (capacity, bins), bins + 1
        tree.add(found[0] - sizes[i], found[1])
        out[i] = found[1]
    return out


def best_fit_counts(sizes: list[tuple[int, int]], capacity: int, most: int) -> list[tuple[int, int, int, int]] | None:
    """``best_fit_decreasing`` of (size, count) pairs: (size, first, last + 1, bin) for runs of the items of a
    size, numbered from 0; None if more than ``most`` bins or an item above ``capacity``."""
    out, tree, bins = [], CapacityTree(), 0
    for size, count in sorted(sizes, reverse=True):
        at = 0
        if size > capacity:
            return None
        while at < count:
            found = tree.take(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            n = min(count - at, found[0] // size)
            out.append((size, at, at + n, found[1]))
            tree.add(found[0] - n * size, found[1])
            at += n
    return out


def fit_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """``best_fit_counts`` at the smallest capacity for which best fit needs no more than ``shards`` bins."""
    if not sizes:
        return []
    largest, total = max(s for s, _ in sizes), sum(s * n for s, n in sizes)
    low, high = max(largest, -(-total // shards)), largest + -(-total // shards)
    best = best_fit_counts(sizes, high, shards)
    while low < high:
        mid = (low + high) // 2
        if (found := best_fit_counts(sizes, mid, shards)) is None:
            low = mid + 1
        else:
            best, high = found, mid
    return best


def rounded(size: str, digits: int = DIGITS) -> Column:
    """The size with ``digits`` significant bits, rounded up."""
    step = f"shiftleft(1L, greatest(0, length(bin({size})) - {digits}))"
    return F.expr(f"(({size} + {step} - 1) div {step}) * {step}")


def _counted(df: DataFrame, by: str) -> DataFrame:
    """``df``, cut, with ``_pid`` and ``_idx``: a number from 0 for each value of ``by`` in a task."""
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.LongType()), T.StructField("_idx", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, used = TaskContext.get().partitionId(), {}
        for batch in batches:
            at = batch.column(by).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            values, first, n = np.unique(at[order], return_index=True, return_counts=True)
            idx = np.empty(len(at), np.int64)
            idx[order] = np.arange(len(at)) - np.repeat(first, n) + np.repeat([used.get(v, 0) for v in values.tolist()], n)
            for v, k in zip(values.tolist(), n.tolist()):
                used[v] = used.get(v, 0) + k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), pid)), pa.array(idx)], schema.names)

    return cut(df.mapInArrow(count, schema))


def shard(docs: DataFrame, *, shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for every row.

    Needs ``doc_id`` and ``text`` and ignores other columns. ``size``: UTF-8 bytes + 1.
    Equal texts share a shard, so a group above an even share makes its shard larger than
    the others. Null and empty texts are one group, of size 1 each and crc32 0. Null
    doc_id: sharded like any other. Repeated rows: each gets its own slot. Ties: groups of one
    size are alike, whichever comes first. Very long texts: only their bytes are counted and
    hashed. Empty table: no rows. ``law`` is always ``bytes``, and ``grown_shard`` null.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("grp")))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes")).withColumn("class", rounded("bytes"))
    groups = numbered(_counted(groups, "class"), "_pid", "_idx", "class", "_at").select("grp", "bytes", "class", "_at")
    counts = groups.groupBy("class").agg(F.count("*").alias("n")).collect()  # at most 2^(DIGITS - 1) for each power of two
    plan = spark.createDataFrame(fit_shards([(r["class"], r["n"]) for r in counts], shards), "class long, lo long, hi long, shard int")
    placed = written(groups.join(F.broadcast(plan), ["class"]).where("_at >= lo and _at < hi").select("grp", "bytes", "shard"))
    # a group may hold a third of all rows: the large ones, at most 256 x shards, are dealt over sixteen tasks each
    total = placed.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * F.lit(256 * shards) >= F.lit(total)
    own = F.broadcast(placed.where(large).select("grp", F.lit(True).alias("own")))
    salts = F.when(large, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0)))
    rows = rows.join(own, "grp", "left").withColumn("salt", F.when(F.col("own"), F.floor(F.rand(7) * 16).cast("int")).otherwise(F.lit(0)))
    rows = rows.join(placed.select("grp", "shard", F.explode(salts).alias("salt")), ["grp", "salt"]).select("doc_id", "size", "text_crc32", "shard")
    out = numbered(_counted(rows, "shard"), "_pid", "_idx", "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
