"""The robust estimates against the same method in NumPy, and rejections on planted outliers."""

import random

import numpy as np
import pytest

from bytestrata.llm import quality

from .test_operators import prose

KIND = "doc_id long, text string, lang string, source string"


def coordinates(r):
    n = max(r.n_words, 1)
    return [np.log(n), np.log(max(r.word_chars, 1) / n), np.sqrt(r.n_symbols / n), np.sqrt(r.n_dup_lines / np.sqrt(n))]


def factor(s):
    low = np.zeros((4, 4))
    for j in range(4):
        for i in range(j, 4):
            v = (max(s[i, i], quality.FLOOR[i] ** 2) if i == j else s[i, j]) - low[i, :j] @ low[j, :j]
            low[i, j] = np.sqrt(max(v, quality.FLOOR[i] ** 2 / 10)) if i == j else v / low[j, j]
    return low, 2 * np.log(np.diag(low)).sum()


def squares(x, m, low):
    return (np.linalg.solve(low, (x - m).T) ** 2).sum(0)


def determinant(x, share=0.75, tolerance=1e-6):
    """Location and Cholesky factor of least determinant from the two starts, by plain steps."""
    h, found = int(np.ceil(share * len(x))), []
    q = [np.sort(x, 0)[max(int(np.ceil(p * len(x))) - 1, 0)] for p in (0.25, 0.5, 0.75)]
    for m, s in ((q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)), (x.mean(0), np.cov(x.T, bias=True).reshape(4, 4))):
        low, det = factor(s)[0], np.inf
        while True:
            d = squares(x, m, low)
            edge = np.sort(d)[h - 1]
            w = np.where(d < edge, 1.0, 0.0)
            w[d == edge] = (h - w.sum()) / (d == edge).sum()
            m2 = w @ x / h
            s2 = ((x * w[:, None]).T @ x / h - np.outer(m2, m2)) * quality.consistency(share)
            low2, det2 = factor(s2)
            if not det2 < det - tolerance:
                break
            m, low, det = m2, low2, det2
        found.append((det, len(found), m, low))
    return min(found, key=lambda f: f[:2])[2:]


def test_constants():
    assert quality.consistency(0.75) == pytest.approx(1 / 0.673, rel=2e-3) and quality.CUTOFF == pytest.approx(28.473, abs=1e-3)
    assert quality._chi_square(quality.quantile(0.3), 4) == pytest.approx(0.3) and quality.quantile(0.95) == pytest.approx(9.4877, abs=1e-3)


def test_estimates_match_numpy(spark):
    rng = random.Random(31)
    size = {("en", "s0"): 300, ("en", "s1"): 60, ("de", "s0"): 39, ("de", None): 30, ("fr", "s9"): 5, (None, "s0"): 1}
    docs = []
    for (lang, source), n in size.items():
        for _ in range(n):
            t = prose(rng, int(rng.lognormvariate(5, 0.6)) + 25)
            if rng.random() < 0.1:
                t = " ".join(w + rng.choice(["#", "$$", ""]) for w in t.split())
            if rng.random() < 0.1:
                t += "\nthe same line\nthe same line"
            docs.append((len(docs), t, lang, source))
    docs += [(9000 + i, "short", "xx", "s0") for i in range(3)]
    out = quality.quality_rules(spark.createDataFrame(docs, KIND).repartition(5)).collect()
    rows = [r for r in out if not r.base_failed]
    x, group = np.array([coordinates(r) for r in rows]), [docs[r.doc_id][2:] for r in rows]
    count = lambda keep: np.array([keep(g) for g in group])
    for lang, source in size:
        own, lang_rows = count(lambda g: g == (lang, source)), count(lambda g: g[0] == lang)
        sample = x[own] if own.sum() >= 40 else x[lang_rows] if lang_rows.sum() >= 40 else x
        want = squares(x[own], *determinant(sample))
        got = np.array([r.distance for r, o in zip(rows, own) if o])
        assert np.allclose(got, want, rtol=1e-6), (lang, source)
        assert [r.kept for r, o in zip(rows, own) if o] == (want <= quality.CUTOFF).tolist()
    assert all(r.distance is None and not r.kept for r in out if r.doc_id >= 9000)


def test_ties_and_equal_rows(spark):
    text = prose(random.Random(1), 50)
    docs = [(i, text, "en", "s") for i in range(50)] + [(100, "#$ " * 60 + prose(random.Random(2), 30), "en", "s")]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(docs, KIND)).collect()}
    assert all(out[i].kept and out[i].distance == pytest.approx(0, abs=1e-9) for i in range(50)) and not out[100].kept
