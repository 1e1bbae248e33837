"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): all thresholds share one weight vector, and the
expected severity is the sum of P(grade > k). Features are the presence of words and of
their first 4 and 5 letters, hashed; those with a significantly higher rate in flagged
training rows are kept, at the value of their log rate ratio, so long texts of neutral words
add nothing. The fit is follow-the-regularised-leader with elastic-net penalties.

Where labels only flag a document as toxic, the grades of a flagged one come from the
training rows themselves: 1, or 2 if the share of its words whose rate among toxic rows is
at least ten times the rate among others is above the median of the flagged rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import blocks, written
from .ftrl import FTRL

_WORD = re.compile(r"[^\W\d_]+")
_BLOCK = 1 << 20


class _Slots(dict):
    """Word to the slots of its features."""

    def __init__(self, bits: int):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> tuple[int, ...]:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        low = 64 - self.bits
        self[word] = out = tuple(xxhash.xxh64_intdigest(x) >> low for x in {f"w{word}", f"4{word[:4]}", f"5{word[:5]}"})
        return out


def features(text: str | None, memo: _Slots) -> np.ndarray:
    """Sorted slots present in a text; none for a null or a text without letters."""
    found: set[int] = set()
    for part in blocks(text or "", _BLOCK):
        for word in set(_WORD.findall(part.lower())):
            found.update(memo[word])
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass
class SeverityModel:
    slots: np.ndarray  # those with a weight, sorted
    values: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades; empty: nothing was learned
    bits: int
    cutoff: float = 0.5  # of p_toxic, between 0.05 and 0.5: the best F1 on the training rows

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.slots] = self.values
        return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def telling(count: list[np.ndarray], n: list[int], least: float = 11.0) -> np.ndarray:
    """The value of each feature from its document counts among ``n`` other and flagged rows: its log rate
    ratio, where it is more frequent in at least three flagged ones by a chi-square of ``least``, else 0."""
    n0, n1 = max(1, n[0]), max(1, n[1])
    both = count[0] + count[1]
    due = np.maximum(both * n1 / (n0 + n1), 1e-9)
    chi2 = (count[1] - due) ** 2 * (1 / due + 1 / np.maximum(both - due, 1e-9))
    ratio = np.log((count[1] + 0.5) / (n1 + 1)) - np.log((count[0] + 0.5) / (n0 + 1))
    return np.where((chi2 >= least) & (count[1] >= 3) & (ratio > 0), ratio, 0.0)


def likelihood(theta: np.ndarray, score: float, grade: int) -> tuple[float, float, np.ndarray]:
    """P(grade) and the gradients of its logarithm: by the score, and by each threshold."""
    f = _sigmoid(np.concatenate([[-np.inf], theta, [np.inf]]) - score)
    lo, hi = f[grade], f[grade + 1]
    d_lo, d_hi = lo * (1 - lo), hi * (1 - hi)
    p = max(hi - lo, 1e-9)
    d_theta = np.zeros(len(theta))
    if grade < len(theta):
        d_theta[grade] += d_hi / p
    if grade:
        d_theta[grade - 1] -= d_lo / p
    return p, (d_lo - d_hi) / p, d_theta


def fit(rows: list[tuple[int, np.ndarray]], value: np.ndarray, grades: int, *, bits: int, epochs: int = 8, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 0.01) -> SeverityModel:
    """Weights and ordered thresholds from (grade, features) rows and the features' values."""
    y = np.array([g for g, _ in rows])
    share = np.array([(y <= k).mean() for k in range(grades - 1)])
    theta = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    gap = np.log(np.maximum(np.diff(theta), 1e-2))  # thresholds stay ordered: a first one and exponents of gaps
    first, ftrl, rng = theta[0], FTRL((1 << bits,), alpha=alpha, beta=beta, l1=l1, l2=l2), np.random.default_rng(0)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            g, at = rows[i]
            w, x = ftrl.weights(at), value[at]
            _, d_score, d_theta = likelihood(first + np.concatenate([[0], np.cumsum(np.exp(gap))]), w @ x, g)
            ftrl.step(at, -x * d_score, w)
            rate = 0.05 / (1 + epoch)
            first += rate * np.clip(d_theta.sum(), -1, 1)
            gap += rate * np.clip(np.exp(gap) * np.cumsum(d_theta[::-1])[::-1][1:], -1, 1)
    w = ftrl.weights() * value
    theta = first + np.concatenate([[0], np.cumsum(np.exp(gap))])
    p = _sigmoid(np.array([w[at].sum() for _, at in rows]) - theta[0])
    limits = np.unique(np.clip(np.quantile(p[y > 0], np.linspace(0, 0.2, 41)), 0.05, 0.5))
    score = [2 * (p[y > 0] >= c).sum() / max(1, (p >= c).sum() + (y > 0).sum()) for c in limits]
    at = np.flatnonzero(w)
    return SeverityModel(at, w[at], theta, bits, float(limits[int(np.argmax(score))]))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, bits: int = 20, **options) -> SeverityModel:
    """Fits on at most ``sample`` labelled documents, half of them flagged where there are as many.

    A first pass over them counts features, which picks the telling ones; only those of a row,
    and the share of its features that mark flagged rows, come to the driver.
    """
    ship(docs.sparkSession)
    flag = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad"))
    ranked = written(flag.select(F.col("doc_id").alias("id"), "bad", F.xxhash64("doc_id").alias("k")))
    # the lowest hashes of each kind: every task hands on at most as many
    least = [ranked.where(F.col("bad") == bad).orderBy("k", "id").limit(sample // 2) for bad in (False, True)]
    some = F.broadcast(least[0].unionByName(least[1]))  # at most ``sample`` rows
    chosen = written(docs.select(F.col("doc_id").alias("id"), "text").join(some, "id").select("k", "bad", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, n, rows = _Slots(bits), [np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)], [0, 0]
        for batch in batches:
            for bad, t in zip(batch.column("bad").to_pylist(), batch.column("text")):
                n[bad][features(t.as_py(), memo)] += 1
                rows[bad] += 1
        for bad in (0, 1):
            at = np.flatnonzero(n[bad])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, bad, np.int32)), pa.array(np.append(at, -1)), pa.array(np.append(n[bad][at], rows[bad]))], ["bad", "at", "n"])

    counted = chosen.mapInArrow(count, "bad int, at long, n long").groupBy("bad", "at").agg(F.sum("n").alias("n")).toArrow()  # at most 2 x (2^bits + 1) rows
    counts, rows_of = [np.zeros(1 << bits), np.zeros(1 << bits)], [0, 0]
    kinds, slots, ns = (counted[c].to_numpy() for c in ("bad", "at", "n"))
    for bad in (0, 1):
        counts[bad][slots[(kinds == bad) & (slots >= 0)]] = ns[(kinds == bad) & (slots >= 0)]
        rows_of[bad] = int(ns[(kinds == bad) & (slots < 0)].sum())
    if not all(rows_of):
        return SeverityModel(np.empty(0, np.int64), np.empty(0), np.empty(0), bits)
    value = telling(counts, rows_of)
    marked = (counts[1] / rows_of[1] >= 10 * counts[0] / rows_of[0]) & (counts[1] >= 3)
    at_value = np.flatnonzero(value)
    shared = docs.sparkSession.sparkContext.broadcast((at_value, np.packbits(marked)))  # 2^bits / 8 bytes, and the telling slots

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, slots = _Slots(bits), shared.value[0]
        mark = np.unpackbits(shared.value[1]).astype(bool)
        for batch in batches:
            found = [features(t.as_py(), memo) for t in batch.column("text")]
            share = [float(mark[at].mean()) if len(at) else 0.0 for at in found]
            told = [np.intersect1d(at, slots, assume_unique=True).astype(np.int32) for at in found]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("bad"), pa.array(share, pa.float64()), pa.array(told, pa.list_(pa.int32()))], ["k", "bad", "share", "at"])

    got = chosen.mapInArrow(vectors, "k long, bad boolean, share double, at array<int>").toArrow()
    rows = sorted(zip(got["k"].to_pylist(), got["bad"].to_pylist(), got["share"].to_pylist(), got["at"].to_numpy()), key=lambda r: (r[0], len(r[3]), r[2]))
    middle = np.median([share for _, bad, share, _ in rows if bad])
    graded = [((2 if share > middle else 1) if bad else 0, np.asarray(at, np.int64)) for _, bad, share, at in rows]
    return fit(graded, value, 3, bits=bits, **options)


def severity_udf(spark, model: SeverityModel):
    ship(spark)
    shared = spark.sparkContext.broadcast(vars(model))

    @F.arrow_udf("severity double, p_toxic double, grade int")
    def severity(texts: pa.Array) -> pa.Array:
        m = SeverityModel(**shared.value)
        w, memo, out = m.dense(), _Slots(m.bits), []
        for t in texts:
            at = features(t.as_py(), memo)
            above = _sigmoid(w[at].sum() - m.thresholds) if len(at) else np.zeros(len(m.thresholds))
            p = -np.diff(np.concatenate([[1.0], above, [0.0]]))
            out.append((float(above.sum()), float(above[0]) if len(above) else 0.0, int(p.argmax())))
        return pa.StructArray.from_arrays([pa.array([r[j] for r in out], ty) for j, ty in enumerate((pa.float64(), pa.float64(), pa.int32()))], ["severity", "p_toxic", "grade"])

    return severity


def toxicity(docs: DataFrame, labels: DataFrame, *, cutoff: float | None = None, **options) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade, 0 to 2), ``p_toxic``, ``grade``, ``toxic`` for every row.

    Needs ``doc_id``, ``text`` of ``docs`` and ``doc_id``, ``toxic`` of ``labels``; other columns
    are ignored. Null text or text without letters: severity 0. Null doc_id: scored, not learned
    from. Null labels: ignored; several for a document: the highest counts. Repeated rows: scored
    alike. Ties between grades: the lower one. Very long texts: read whole, in blocks
    that split no word. Labels of one kind only or none: all scores 0.
    Empty table: no rows.
    """
    model = train(docs, labels, **options)
    out = docs.select("doc_id", severity_udf(docs.sparkSession, model)(F.col("text").cast("string")).alias("s"))
    return out.select("doc_id", "s.severity", "s.p_toxic", "s.grade", (F.col("s.p_toxic") >= (model.cutoff if cutoff is None else cutoff)).alias("toxic"))
