"""Decontamination against a plain comparison of every text with every item, and on planted items."""

import random

from bytestrata.llm import decontam

from .test_operators import prose

NAMES = ["Tom", "Ann", "Jim", "Eve", "Mary Jane Watson", "Carl", "Lena", "Ravi", "Mei Lin", "Oscar"]
SHORT = ["Who wrote Hamlet", "Name the capital of Peru"]


def slow_verdict(text, item, window=8, coverage=0.5, verbatim=0.8):
    """Coverage and whether slots differ, or None, from lists of words only."""
    plain = lambda t: [c.lower() for w in t.split() if (c := w.strip(decontam._EDGE))]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    n = min(window, len(plain(item)))
    mine, theirs = grams(plain(item), n), set(grams(plain(text), n))
    share = sum(g in theirs for g in mine) / len(mine) if mine else 0.0
    if share == 1.0:
        return 1.0, False
    (a, av), (b, bv) = decontam.canonical(item), decontam.canonical(text)
    n = min(window, len(a))
    telling = [i for i in range(len(a) - n + 1) if n and sum(w[0] != "\x00" for w in a[i : i + n]) >= 2]
    lines = {}
    for i in telling:
        for j in range(len(b) - n + 1):
            if a[i : i + n] == b[j : j + n]:
                lines.setdefault(j - i, []).append(i)
    covered, changed = set(), False
    possible = {i for at in lines.values() for i in at}
    for shift in sorted(lines, key=lambda s: (-len(lines[s]), s)):
        if possible <= covered:
            break
        to, ok, other = {}, True, False
        for i in sorted({k for p in lines[shift] for k in range(p, p + n)}, key=lambda k: (k in (0, len(a) - 1), k)):
            if a[i][0] == "\x00":
                x, y = av[i], bv[i + shift]
                z = to.get((a[i], x), x)
                if i == 0 and y.endswith(" " + z) or i == len(a) - 1 and y.startswith(z + " "):
                    y = z
                ok &= to.setdefault((a[i], x), y) == y
                other |= x != y
        if ok:
            covered |= set(lines[shift])
            changed |= other
    literals = {k for p in covered for k in range(p, p + n) if a[k][0] != "\x00"}
    t = len(covered) / len(telling) if telling else -1.0
    if len(literals) < min(4, sum(w[0] != "\x00" for w in a)):
        t = -1.0
    if t >= coverage and t >= share:
        return t, changed
    return (share, False) if share >= verbatim else (t, changed) if t >= coverage else None


def problem(rng):
    """A template with slots, and a function that fills it."""
    verbs, things = ["buys", "has", "finds", "sells", "paints"], ["balls", "books", "coins", "lamps", "ropes"]
    x, y, extra = rng.choice(things), rng.choice(verbs), prose(rng, rng.randint(3, 9))
    kinds = [
        lambda p, q, m, n: f"{p} {y} {m} red {x}. {q} {y} {n} {extra} more than {p}. How many {x} does {q} have?",
        lambda p, q, m, n: f"In the old {extra} shop a man named {p} {y} {m} km of {x} for {n} dollars and gives {m} to {q}",
        lambda p, q, m, n: f"{p}, {q}: {m} + {n} , {n} x {m} , {m} / {n} gives which {x} {y}?",
        lambda p, q, m, n: f"{q} saw {p} near {extra}. {p} then {y} {n} {x} and {m} {x} of {q}.",
    ]
    return rng.choice(kinds)


def test_every_pair_as_by_plain_comparison(spark):
    rng = random.Random(21)
    items, texts = [*SHORT, "", "one", "Mary", "12 30 7", None, "la la la la la la la la la la"], [None, "", "  ", "la " * 300]
    for _ in range(30):
        make = problem(rng)
        item = make(*rng.sample(NAMES, 2), rng.randint(2, 90), rng.randint(2, 90))
        items.append(item)
        same = make(*rng.sample(NAMES, 2), rng.choice(["forty", 41]), rng.randint(91, 99))
        words = item.split()
        partial, broken = " ".join(words[: rng.randint(1, len(words))]), [w if rng.random() < 0.9 else prose(rng, 1) for w in words]
        for t in (item, same, partial, " ".join(broken), item.lower(), item.replace("and", ", and")):
            texts.append(f"{prose(rng, rng.randint(0, 30))} {t} {prose(rng, rng.randint(0, 30))}")
    texts += [" ".join(rng.sample(texts[4:], 3)) for _ in range(10)] + texts[4:8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (900, items[-1])], "item_id long, text string")
    out = {r.row.doc_id: [(m.item_id, round(m.coverage, 9), m.reparameterised) for m in r.matches] for r in decontam.contamination(docs, bench).collect()}
    for k, t in enumerate(texts):
        want = [(i, round(v[0], 9), v[1]) for i, x in [*enumerate(items), (900, items[-1])] if t is not None and x and (v := slow_verdict(t, x))]
        assert out[k] == sorted(want), (t, out[k], want)


def test_planted_items_are_found_and_clean_text_is_not(spark):
    rng = random.Random(22)
    items, docs = list(SHORT), []
    before = ["", "As asked before: ", "Question 3. ", "\nQ: ", "He said Ben ", "we read that "]
    planted = {}
    for k in range(80):
        make = problem(rng)
        args = (*rng.sample(NAMES, 2), rng.randint(2, 90), rng.randint(2, 90))
        items.append(make(*args))
        verbatim = rng.random() < 0.4
        if not verbatim:
            args = (*rng.sample(NAMES, 2), rng.choice([rng.randint(100, 900), "forty", "twenty two"]), rng.randint(1000, 9000))
        planted[k] = (len(items) - 1, verbatim)
        docs.append((k, f"{prose(rng, rng.randint(0, 40))} {rng.choice(before)}{make(*args)} {prose(rng, rng.randint(0, 40))}"))
    docs += [(200, f"I ask: {SHORT[0]}? nobody knows"), (201, "Who wrote Faust"), (202, SHORT[1].lower())]
    planted |= {200: (0, True), 201: (0, False), 202: (1, True)}
    docs += [(1000 + i, prose(rng, 60) + " " + rng.choice(NAMES) + f" has {i} " + prose(rng, 20)) for i in range(200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = {r.row.doc_id: {m.item_id for m in r.matches} for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    exact = [i in out[k] for k, (i, v) in planted.items() if v]
    other = [i in out[k] for k, (i, v) in planted.items() if not v]
    assert all(exact) and sum(other) >= 0.95 * len(other), [(docs[k], items[i]) for k, (i, v) in planted.items() if i not in out[k] and k < 200]
    assert not any(out[k] for k in out if k >= 1000)


def test_forms_follow_from_the_word_alone():
    line = "Which river flows through the old city centre"
    inside = decontam.canonical("As asked before: " + line)[0]
    assert inside[-8:] == decontam.canonical(line)[0]
    assert decontam.canonical("Mary Jane Watson's cat ate forty two figs")[0] == [decontam.NAME, "cat", "ate", decontam.NUM, "figs"]
    assert decontam.canonical("Tom, Ann")[0] == [decontam.NAME] * 2 and decontam.canonical("km 5 km")[0] == ["km", decontam.NUM, decontam.UNIT]


def test_many_equal_texts_and_a_shuffled_join(spark, monkeypatch):
    rng = random.Random(23)
    item = problem(rng)("Tom", "Eve", 12, 40)
    docs = spark.createDataFrame([(i, item if i % 3 else prose(rng, 50)) for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (None, item)], "item_id long, text string")
    want = {i: [None, 1] if i % 3 else [] for i in range(300)}
    for most in (decontam.MOST_BROADCAST, -1):
        monkeypatch.setattr(decontam, "MOST_BROADCAST", most)
        assert {r.row.doc_id: [m.item_id for m in r.matches] for r in decontam.contamination(docs, bench, bits=10).collect()} == want
