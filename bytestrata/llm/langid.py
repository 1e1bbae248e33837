"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every labelled training document. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of them
(``sample`` rows in all, an equal share for each language), and a temperature, fitted on a
fifth of that sample which the weights do not see, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import blocks
from .ftrl import FTRL

UND = "und"
_BLOCK = 1 << 18
_LETTER: np.ndarray | None = None
_ROW = "at array<int>, tf array<int>"


def letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str | None, bits: int, most: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash slots and counts of the 1- to ``most``-grams of letters, words set apart by one
    blank; None without letters. Works in blocks, so memory is bounded for any length."""
    total = None
    for part in blocks(text or "", _BLOCK):
        cp = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
        cp = np.where(letters()[cp], cp, np.uint32(32))
        cp = np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]])
        cp = cp[~((cp == 32) & np.concatenate([[False], cp[:-1] == 32]))]
        if len(cp) < 3:
            continue
        h, hashes = np.zeros(len(cp), np.uint32), []
        for k in range(most):
            m = len(cp) - k
            if m < 1:
                break
            h = (h[:m] + cp[k:] + np.uint32(k * 7919 + 1)) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            hashes.append(h >> np.uint32(32 - bits) if k else h[cp != 32] >> np.uint32(32 - bits))
        counts = np.bincount(np.concatenate(hashes), minlength=1 << bits)
        total = counts if total is None else total + counts
    if total is None:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # slots x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = (1 + np.log(tf)) * self.idf[at]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def probabilities(self, at: np.ndarray, tf: np.ndarray, temperature: float | None = None) -> np.ndarray:
        s = (self.vector(at, tf) @ self.weights[at] + self.bias) / (temperature or self.temperature)
        e = np.exp(s - s.max())
        return e / e.sum()


def _frequencies(docs: DataFrame, bits: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (x := ngrams(text.as_py(), bits)) is not None:
                    df[x[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["at", "df"])

    return docs.select("text").mapInArrow(count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))


def train(docs: DataFrame, *, sample: int = 3000, most_langs: int = 512, bits: int = 15, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> LanguageModel:
    """A model from ``text`` and ``lang``. Rows without a language or without letters teach
    nothing; without any other row the model has no language and answers ``und``.

    The sample has an equal share of distinct texts for each language, so copies count once in
    it; ``most_langs`` bounds the classes to the most frequent languages (ties by name).
    """
    ship(docs.sparkSession)
    docs = docs.where("lang is not null").select("lang", "text", F.xxhash64("text").alias("k"))
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("k").alias("texts")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    langs = sorted(r["lang"] for r in counts)
    found = {r["at"]: r["df"] for r in _frequencies(docs, bits).collect()}  # at most 2^bits + 1 rows
    n = found.pop(-1, 0)
    df = np.zeros(1 << bits)
    df[list(found)] = list(found.values())
    model = LanguageModel(langs, np.zeros((1 << bits, len(langs))), np.zeros(len(langs)), np.log((1 + n) / (1 + df)) + 1, 1.0, bits)
    if not langs or not n:
        model.langs = []
        return model
    each = max(1, sample // len(langs))
    kind = docs.schema["lang"].dataType.simpleString()
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 3 * each / max(1, r["texts"]))) for r in counts], f"lang {kind}, rate double")
    keys = docs.select("lang", "k").join(F.broadcast(rates), "lang").where(F.pmod("k", F.lit(1_000_003)) < F.col("rate") * 1_000_003).select("lang", "k").distinct()
    keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).where(F.col("r") <= each).select("lang", "k")
    some = docs.join(F.broadcast(keys), ["lang", "k"]).groupBy("lang", "k").agg(F.min("text").alias("text"))  # at most ``sample``

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang.as_py(), k.as_py(), *x) for lang, text, k in zip(*(batch.column(c) for c in ("lang", "text", "k"))) if (x := ngrams(text.as_py(), bits)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[j].astype(np.int32) for r in rows], pa.list_(pa.int32())) for j in (2, 3))], ["lang", "k", "at", "tf"])

    rows = some.mapInArrow(vectors, f"lang {kind}, k long, {_ROW}").toArrow()
    rows = zip(*(rows.column(c).to_numpy() for c in ("k", "lang", "at", "tf")))
    rows = sorted(rows, key=lambda r: (r[0], r[1]))  # at most ``sample``
    held, taught = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    ftrl = FTRL((len(df) + 1, len(langs)), alpha=alpha, beta=beta, l1=l1, l2=l2)
    rng, at_lang = np.random.default_rng(0), {x: i for i, x in enumerate(langs)}
    for _ in range(epochs):
        for i in rng.permutation(len(taught)):
            _, lang, at, tf = taught[i]
            at, x = np.append(at, len(df)), np.append(model.vector(at, tf), 1.0)
            w = ftrl.weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[at_lang[lang]] -= 1
            ftrl.step(at, x[:, None] * p, w)
    w = ftrl.weights()
    model.weights, model.bias = w[:-1], w[-1]

    def loss(t: float) -> float:
        return -sum(np.log(max(model.probabilities(at, tf, t)[at_lang[lang]], 1e-12)) for _, lang, at, tf in held)

    if held:
        model.temperature = float(min(np.geomspace(0.25, 5, 41), key=loss))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> Column:
    """A struct column: ``lang_pred``, ``score`` from ``text`` of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # slots x languages floats, fixed by the model

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        m, langs, scores = LanguageModel(**shared.value), [], []
        for t in texts:
            x = ngrams(t.as_py(), m.bits) if m.langs else None
            p = m.probabilities(*x) if x is not None else None
            langs.append(UND if p is None else m.langs[int(p.argmax())])
            scores.append(0.0 if p is None else float(p.max()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(F.col("text").cast("string"))


def language_id(docs: DataFrame, *, folds: int = 5, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row.

    Needs ``doc_id``, ``text``, ``lang``; other columns are ignored. Learns from rows with a
    language whose crc32(doc_id as text) mod ``folds`` is not 0; predictions read the text
    only. Null text or text without letters: ``und`` with score 0. Null doc_id: not held out,
    not learned from. Null lang: predicted only. Repeated rows: predicted alike. Ties: the
    first language in order. No labelled rows: all ``und``. Empty table: no rows.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    docs = docs.select("doc_id", "text", "lang", F.coalesce(rest == 0, F.lit(False)).alias("held_out"))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")), **options)
    out = docs.select("doc_id", "held_out", identify(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
