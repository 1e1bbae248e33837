"""Nearest-codeword joins. A codebook is bounded by its training limit, so it is broadcast as one byte matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow
from ..session import ship, shuffles_dropped

MOST_CODEWORDS = 1 << 16
MATCH = "struct<codebook_index:int,codebook_id:bigint,distance:bigint,pattern:binary>"
MOST_BYTES = 256 << 20


class Matcher:
    """Argmin of the Hamming distance over codewords, by bucket or over all; ties: the lowest id.

    Codewords of one length make a group; a chunk's best is the least over groups.
    """

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.groups = []
        for n in sorted({len(p) for _, p in rows}):
            at = [k for k, (_, p) in enumerate(rows) if len(p) == n]
            self.groups.append((np.array(at), np.frombuffer(bytearray(b"".join(rows[k][1] for k in at)), np.uint8).reshape(len(at), n)))
        self.bucket = np.array([int.from_bytes(p[:2], "little") if len(p) > 1 else 0 for _, p in rows], np.int64)
        self.known = set(self.bucket.tolist())

    def _least(self, m: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword and distance for each row of a byte matrix, among the codewords of a mask."""
        best, code = np.full(len(m), np.iinfo(np.int64).max), np.full(len(m), -1)
        for at, patterns in self.groups:
            here = among[at]
            if not here.any():
                continue
            at, patterns = at[here], patterns[here]
            n, more = min(m.shape[1], patterns.shape[1]), 8 * abs(m.shape[1] - patterns.shape[1])
            x, y = arrow.words64(m[:, :n]), arrow.words64(patterns[:, :n])
            for lo in range(0, len(m), step := max(1, (1 << 19) // max(1, y.size))):
                d = np.bitwise_count(x[lo : lo + step, None, :] ^ y[None]).sum(2, dtype=np.int64) + more
                k = d.argmin(1)
                d, k, rows = d[np.arange(len(k)), k], at[k], slice(lo, lo + len(k))
                better = (d < best[rows]) | ((d == best[rows]) & (k < code[rows]))
                best[rows], code[rows] = np.where(better, d, best[rows]), np.where(better, k, code[rows])
        return code, best

    def best(self, m: np.ndarray, lsh: bool) -> tuple[np.ndarray, np.ndarray]:
        """Codeword number and distance for each row of a byte matrix; no codewords: -1."""
        every = np.ones(len(self.ids), bool)
        if not lsh or not len(m) or not len(self.ids):
            return self._least(m, every)
        code, d = np.empty(len(m), np.int64), np.empty(len(m), np.int64)
        bucket = m[:, 0].astype(np.int64) + 256 * m[:, 1].astype(np.int64) if m.shape[1] > 1 else np.zeros(len(m), np.int64)
        noise = arrow.entropies(m) > 7.5  # not worth a search
        code[noise], d[noise] = 0, 8 * m.shape[1]
        for b in np.unique(bucket[~noise]).tolist():
            if b in self.known:
                rows = np.flatnonzero(~noise & (bucket == b))
                code[rows], d[rows] = self._least(m[rows], self.bucket == b)
        rows = np.flatnonzero(~noise & ~np.isin(bucket, self.bucket))
        code[rows], d[rows] = self._least(m[rows], every)
        return code, d


def _collected(book: DataFrame) -> list[tuple[int, bytes]]:
    rows = book.select("codebook_id", "pattern").limit(MOST_CODEWORDS + 1).collect()
    if len(rows) > MOST_CODEWORDS:
        raise ValueError(f"a codebook has at most {MOST_CODEWORDS} codewords")
    if sum(len(r["pattern"]) for r in rows) > MOST_BYTES:
        raise ValueError(f"a codebook has at most {MOST_BYTES} bytes")
    return sorted((r["codebook_id"], bytes(r["pattern"])) for r in rows)


def kept(book: DataFrame) -> DataFrame:
    """``book``, trained once: its rows (at most ``MOST_CODEWORDS``) as a local table."""
    with shuffles_dropped(book.sparkSession):  # training shuffles every chunk
        _checked = book.limit(MOST_CODEWORDS + 1).collect()
    if len(_checked) > MOST_CODEWORDS:
        raise ValueError(f"a codebook has at most {MOST_CODEWORDS} codewords")
    return book.sparkSession.createDataFrame(_checked, book.schema)


def matched(spark: SparkSession, books: DataFrame | list[DataFrame], method: str = "lsh", stop: float | None = None):
    """The Arrow UDF of ``nearest_codeword``, for queries that call it beside others."""
    books = books if isinstance(books, list) else [books]
    shared = spark.sparkContext.broadcast([_collected(b) for b in books])
    limit, lsh = 0.5 if stop is None else stop, method != "linear"

    @F.arrow_udf(MATCH)
    def match(data: pa.Array) -> pa.Array:
        coded = data.dictionary_encode()
        data, again = coded.dictionary, coded.indices
        tier, ids, best, pattern = np.full(len(data), -1, np.int32), np.zeros(len(data), np.int64), np.full(len(data), np.iinfo(np.int64).max), [None] * len(data)
        sizes = np.zeros(len(data), np.int64)
        tables = [(Matcher(rows), [p for _, p in rows]) for rows in shared.value]
        for rows, m in arrow.by_length(data):
            sizes[rows] = m.shape[1]
            for t, (matcher, patterns) in enumerate(tables):
                open_ = np.flatnonzero((tier[rows] < 0) | (best[rows] > limit * 8 * m.shape[1]))
                if not len(open_) or not len(patterns):
                    continue
                code, d = matcher.best(m[open_], lsh)
                better = d < best[rows[open_]]
                at = rows[open_][better]
                tier[at], ids[at], best[at] = t, matcher.ids[code[better]], d[better]
                for r, k in zip(at.tolist(), code[better].tolist()):
                    pattern[r] = patterns[k]
        none = tier < 0
        fields = [pa.array(tier, pa.int32(), mask=none), pa.array(ids, pa.int64(), mask=none), pa.array(best, pa.int64(), mask=none), pa.array(pattern, pa.binary())]
        return pa.StructArray.from_arrays(fields, ["codebook_index", "codebook_id", "distance", "pattern"], mask=pa.array(none)).take(again)

    return match


def nearest_codeword(chunks: DataFrame, books: DataFrame | list[DataFrame], method: str = "lsh", stop: float | None = None) -> DataFrame:
    """``chunks`` with ``match``: codebook_index, codebook_id, distance, pattern; null where no codebook has a codeword.

    ``method``: ``lsh`` (codewords with the same first two bytes, all where there are none),
    ``linear`` (all), or ``tiered`` (the codebooks in order; the first whose distance is at
    most ``stop`` of the bits, one half by default, else the least distance). A chunk that a batch
    repeats is matched once.
    """
    ship(chunks.sparkSession)
    return chunks.withColumn("match", matched(chunks.sparkSession, books, method, stop)("data"))


def restrict(book: DataFrame, allowed: DataFrame) -> DataFrame:
    """The codewords whose ids ``allowed`` has."""
    return book.join(allowed.select("codebook_id").distinct(), "codebook_id", "left_semi")


def most_used(matched: DataFrame, most: int = 256, weight: str | None = None) -> DataFrame:
    """The ``most`` most used codeword ids, ties by id. A row counts once, or ``weight`` times."""
    used = matched.groupBy(F.col("match.codebook_id").alias("codebook_id")).agg((F.sum(weight) if weight else F.count("*")).alias("used"))
    return used.orderBy(F.desc("used"), "codebook_id").limit(most)
