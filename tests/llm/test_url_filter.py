"""The template tree against the same method on plain lists, and few bad pages on many hosts."""

import math
import random

import pytest

from bytestrata.llm import url_filter


def slow_tree(rows, share, strength=2.0):
    """{(host, segs): (template, labelled, good)} for rows (host, segs, labelled, good)."""
    a, b = strength * share, strength * (1 - share)
    beta = lambda g, l: math.lgamma(g + a) + math.lgamma(l - g + b) - math.lgamma(l + a + b)  # noqa: E731, E741
    out = {}

    def grow(host, name, at, mine):
        ended = [r for r in mine if len(r[1]) == at]
        for r in ended:
            out[host, r[1]] = name
        mine = [r for r in mine if len(r[1]) > at]
        if not mine:
            return
        lo, hi = min(r[1][at:] for r in mine), max(r[1][at:] for r in mine)
        if lo == hi:
            out[host, mine[0][1]] = name + "".join(f"/{s}" for s in lo)
            return
        same = next(i for i in range(max(len(lo), len(hi))) if lo[i : i + 1] != hi[i : i + 1])
        name, at = name + "".join(f"/{s}" for s in lo[:same]), at + same
        if not sum(r[2] for r in mine):
            for r in mine:
                out[host, r[1]] = name + ("/**" if len(r[1]) > at else "")
            return
        for r in mine:
            if len(r[1]) == at:
                out[host, r[1]] = name
        mine = [r for r in mine if len(r[1]) > at]
        bins, none = {}, []
        for seg in {r[1][at] for r in mine}:
            l, g = (sum(r[k] for r in mine if r[1][at] == seg) for k in (2, 3))  # noqa: E741
            if not l:
                none.append(seg)
                continue
            x = bins.setdefault(min(url_filter.LEVELS - 1, int(url_filter.LEVELS * (g + a) / (l + strength))), [0, 0, []])
            x[0], x[1] = x[0] + l, x[1] + g
            x[2].append(seg)
        groups = [bins[k] for k in sorted(bins)]
        for _ in range(3):
            merged = []
            for x in groups:
                if merged and beta(merged[-1][1] + x[1], merged[-1][0] + x[0]) + beta(0, 0) >= beta(merged[-1][1], merged[-1][0]) + beta(x[1], x[0]):
                    y = merged.pop()
                    x = [y[0] + x[0], y[1] + x[1], y[2] + x[2]]
                merged.append(x)
            groups = merged
        if none and len(groups) == 1:
            groups[0][2].extend(none)
        elif none:
            groups.append([0, 0, none])
        wide = sum(len(x[2]) > 1 for x in groups)
        for k, x in enumerate(groups):
            step = x[2][0] if len(x[2]) == 1 else "*" if wide == 1 else f"*{k + 1}"
            grow(host, f"{name}/{step}", at + 1, [r for r in mine if r[1][at] in x[2]])

    for host in {r[0] for r in rows}:
        grow(host, "", 0, [r for r in rows if r[0] == host])
    total = {}
    for r in rows:
        t = total.setdefault((r[0], out[r[0], r[1]]), [0, 0])
        t[0], t[1] = t[0] + r[2], t[1] + r[3]
    return {k: (v, *total[k[0], v]) for k, v in out.items()}


def test_tree_matches_plain_lists(spark):
    rng = random.Random(41)
    rows = {}
    for host in ("a.net", "b.net", "c.net"):
        for _ in range(60 if host != "c.net" else 4):
            segs = tuple(rng.choice("pqrstuvw"[: 2 + 2 * i]) for i in range(rng.randint(0, 5)))
            bad = segs[:1] == ("q",) and host == "a.net" or segs[1:2] == ("r",)
            n = rng.choice([0, 0, 1, 3, 12])
            rows[host, segs] = (n, sum(rng.random() < (0.1 if bad else 0.9) for _ in range(n)))
    rows["a.net", ("z",) * 30] = (2, 2)
    rows["a.net", ("z",) * 29 + ("y",)] = (9, 0)
    rows = [(*k, *v) for k, v in rows.items()]
    df = spark.createDataFrame([(h, list(s), n, n, g) for h, s, n, g in rows], "host string, segs array<string>, pages long, labelled long, good long")
    for share in (0.6, 0.95):
        got = {(r.host, tuple(r.segs)): (r.template, r.t_labelled, r.t_good) for r in url_filter.template_tree(df, share).collect()}
        assert got == slow_tree(rows, share)
        assert len({v[0] for v in got.values()}) > 3


def test_few_bad_pages_on_many_hosts(spark):
    """Two labelled bad pages a host under one path; other hosts have none labelled."""
    pages, marks = [], []
    for h in range(40):
        for k in range(8):
            i, spam = len(pages), k % 2
            pages.append((i, f"https://h{'abcdefghij'[h % 10]}{'xyzw'[h // 10]}.example.net/{'promo' if spam else 'wiki'}/{'abc'[k % 3]}/{i}"))
            if k < 4 and h < 30:
                marks.append((i, int(not spam), 0))
    pages += [(5000, "https://new.example.net/promo/a/77777"), (5001, "https://new.example.net/wiki/b/77778"), (5002, "https://new.example.net/other")]
    out = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert {i for i, v in out.items() if v == "block"} == {i for i, u in pages if "/promo/" in u}


def test_log_gamma(spark):
    xs = [0.02, 0.5, 1.0, 3.3, 40.0, 1e4]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{url_filter._log_gamma('x')} AS y").collect()
    assert all(r.y == pytest.approx(math.lgamma(r.x), abs=1e-7) for r in got)
