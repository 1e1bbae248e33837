"""The linear models against plain formulas: n-grams, FTRL, TF-IDF, ordinal gradients, calibration."""

import math
import random

import numpy as np
import pytest

from bytestrata.llm import langid, toxicity
from bytestrata.llm.common import blocks
from bytestrata.llm.ftrl import FTRL

from .test_operators import labels, prose


def test_blocks_split_no_word():
    rng = random.Random(51)
    text = "".join(rng.choice(["word", "längeres", " ", "\n", "9", "_", "'", "x" * 40]) for _ in range(400))
    for size in (1, 7, 50, 10_000):
        parts = list(blocks(text, size))
        assert "".join(parts) == text and all(not (a[-1].isalpha() and b[0].isalpha()) for a, b in zip(parts, parts[1:]))
    assert list(blocks("", 5)) == [] and list(blocks("a" * 30, 4)) == ["a" * 30]


def test_long_texts_have_the_features_of_the_whole(monkeypatch):
    text = prose(random.Random(52), 3000) + " 12 Übung\nénd"
    whole, words = langid.ngrams(text, 15), toxicity.features(text, toxicity._Slots(20))
    monkeypatch.setattr(langid, "_BLOCK", 37)
    monkeypatch.setattr(toxicity, "_BLOCK", 37)
    cut = langid.ngrams(text, 15)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(toxicity.features(text, toxicity._Slots(20)), words)
    # blocks only repeat the blank between two of them
    assert np.abs(whole[1] - cut[1]).max() <= 2 * sum(1 for _ in blocks(text, 37))


def test_ftrl_follows_the_plain_update():
    rng = np.random.default_rng(53)
    model, a, b, l1, l2 = FTRL((5,), alpha=0.3, beta=0.7, l1=0.2, l2=0.1), 0.3, 0.7, 0.2, 0.1
    z, n = [0.0] * 5, [0.0] * 5

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(200):
        at = rng.choice(5, 3, replace=False)
        g, w = rng.normal(size=3), model.weights(at)
        assert w == pytest.approx([weight(i) for i in at])
        model.step(at, g, w)
        for i, gi, wi in zip(at, g, w):
            sigma = (math.sqrt(n[i] + gi * gi) - math.sqrt(n[i])) / a
            z[i], n[i] = z[i] + gi - sigma * wi, n[i] + gi * gi
    assert model.weights() == pytest.approx([weight(i) for i in range(5)])


def test_ordinal_gradients_are_those_of_the_likelihood():
    rng, step = np.random.default_rng(54), 1e-6
    for _ in range(50):
        theta, score = np.sort(rng.normal(size=3)) + np.arange(3) * 0.1, rng.normal()
        total = 0.0
        for g in range(4):
            p, d_score, d_theta = toxicity.likelihood(theta, score, g)
            total += p
            log = lambda t, s: math.log(toxicity.likelihood(t, s, g)[0])  # noqa: B023, E731
            assert d_score == pytest.approx((log(theta, score + step) - log(theta, score - step)) / 2 / step, abs=1e-4)
            for k in range(3):
                move = np.eye(3)[k] * step
                assert d_theta[k] == pytest.approx((log(theta + move, score) - log(theta - move, score)) / 2 / step, abs=1e-4)
        assert total == pytest.approx(1)


def test_idf_and_temperature(spark):
    rng = random.Random(55)
    docs = [(prose(rng, 12, ["the", "and"] if i % 2 else ["der", "und"]), "en" if i % 2 else "de") for i in range(120)] + [("!!", "en"), (None, "de"), ("x", None)]
    model = langid.train(spark.createDataFrame(docs, "text string, lang string").repartition(3))
    seen = [langid.ngrams(t, 15) for t, k in docs if k]
    df = np.zeros(1 << 15)
    for x in seen:
        if x is not None:
            df[x[0]] += 1
    n = sum(x is not None for x in seen)
    assert model.langs == ["de", "en"] and model.idf == pytest.approx(np.log((1 + n) / (1 + df)) + 1) and 0.25 <= model.temperature <= 5
    at, tf = seen[0]
    assert np.linalg.norm(model.vector(at, tf)) == pytest.approx(1) and model.probabilities(at, tf).sum() == pytest.approx(1)


def test_copies_count_once_in_the_sample(spark):
    """Twenty thousand copies of one text leave room for the others of their language."""
    rng = random.Random(56)
    docs = [("zz yy xx", "en")] * 20_000 + [(prose(rng, 8, ["the", "with"]), "en") for _ in range(300)] + [(prose(rng, 8, ["der", "mit"]), "de") for _ in range(300)]
    model = langid.train(spark.createDataFrame(docs, "text string, lang string").repartition(4), sample=200)
    assert [model.langs[int(model.probabilities(*langid.ngrams(t, 15)).argmax())] for t in ("thea withb thec", "derc mita derb")] == ["en", "de"]
    assert langid.train(spark.createDataFrame(docs, "text string, lang string"), most_langs=1).langs == ["en"]


def test_severity_model_picks_flagged_words(spark):
    rng = random.Random(57)
    docs = [(i, prose(rng, 30) + (" vile rotten" if i % 4 == 0 else "")) for i in range(400)]
    marks = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, None, None), (None, 1, 1)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels(spark, marks), sample=150)
    memo = toxicity._Slots(20)
    assert set(memo["vile"]) & set(model.slots.tolist()) and not set(memo["alphaa"]) & set(model.slots.tolist())
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
