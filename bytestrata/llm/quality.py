"""Quality rules: fixed limits, then robust multivariate outliers. DataFrame functions only.

Each text gives a vector of transformed statistics. For every (lang, source) the location and
scatter of most texts are estimated by minimum covariance determinant: from two starts (median
and quartiles; mean and covariance), concentration steps refit both on the ``share`` of rows
with the smallest Mahalanobis distances until the determinant stops falling, and the smaller
determinant wins. A text whose distance to its group exceeds a chi-square limit is rejected.
A group of few passing rows borrows the estimate of its language, and that of all texts where
the language has few too.

A step is two aggregations with map-side sums: a quantile of the distances (exact up to
``ACCURACY`` rows a group, within 1 / ``ACCURACY`` of the rank beyond), then sums and products of
the rows below it, and of those on it with the weight that makes up the subset's exact size. No
group's rows meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join, words_sql, written

ACCURACY = 10_000
#: Least standard deviation of a coordinate: what clean texts may differ by in any case.
FLOOR = (0.35, 0.10, 0.12, 0.12)
P = len(FLOOR)


def _chi_square(x: float, degrees: int) -> float:
    """P(chi-square <= x) for even ``degrees``."""
    term = total = 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, degrees: int = P) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, degrees) < p else (low, mid)
    return high


def consistency(share: float, degrees: int = P) -> float:
    """What the covariance of the inner ``share`` of a normal sample is multiplied by."""
    return share / _chi_square(quantile(share, degrees), degrees + 2)


#: The upper 1e-5 quantile of the chi-square distribution.
CUTOFF = quantile(1 - 1e-5)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: str, window: int = 8) -> str:
    """SQL for the number of words in ``window``-word windows found twice or more.

    Words are hashed once, windows from those hashes, and compared in a hash set first; only
    texts where some repeat sort them with their places, so the cost is n log n for any text.
    """
    n = f"size({words})"
    each = ", ".join(f"get(v, i + {j})" for j in range(window))
    hashes = f"transform(array(transform({words}, w -> xxhash64(w))), v -> transform(sequence(0, {n} - {window}), i -> xxhash64({each})))[0]"
    places = f"""transform(array(array_sort(transform(w, (h, i) -> struct(h, i)))), s ->
        array_sort(transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h or x.h <=> get(s, i + 1).h), x -> x.i)))[0]"""
    covered = f"transform(array({places}), p -> aggregate(transform(p, (x, i) -> least({window}, coalesce(get(p, i + 1), x + {window}) - x)), 0, (a, x) -> a + x))[0]"
    return f"if({n} <= {window}, 0, transform(array({hashes}), w -> if(size(array_distinct(w)) = size(w), 0, {covered}))[0])"


def statistics(text: str) -> str:
    """SQL for a struct of ``STATS`` (long). The word array is bound once for all of them."""
    t = f"coalesce({text}, '')"
    return rf"""transform(array({words_sql(text)}), w0 -> named_struct(
        'n_words', cast(size(w0) as long),
        'word_chars', cast(char_length(translate({t}, ' \t\n\u000b\u000c\r', '')) as long),
        'n_symbols', cast(char_length({t}) - char_length(translate({t}, '#*$%&|<>', '')) as long),
        'n_dup_lines', transform(array(filter(split({t}, '\n'), l -> translate(l, ' \t\u000b\u000c\r', '') <> '')), l -> cast(size(l) - size(array_distinct(l)) as long))[0],
        'n_repeat_words', cast({repeated_words('w0')} as long)))"""


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), its group and its statistics.

    They come out of a generator of one row, through which no later filter is pushed, so
    they are computed once.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = out.select("row", F.col("row.lang").cast("string").alias("lang"), F.col("row.source").cast("string").alias("source"), F.explode(F.expr(statistics("row.text"))).alias("s"))
    out = out.select("row", "lang", "source", *[f"s.{c}" for c in STATS])
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(n.cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.sqrt(n.cast("double"))),
    ]


def _upper(i: int, j: int) -> str:
    return f"s{min(i, j)}{max(i, j)}"


_CELLS = [(i, j) for i in range(P) for j in range(i, P)]


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds the inverse Cholesky steps of the scatter s.. as l.. and its log determinant.

    A variance is at least the floor's square, and what the others leave of it at least a tenth
    of that, so the scatter is always positive definite.
    """
    for j in range(P):
        for i in range(j, P):
            v = F.greatest(F.col(_upper(i, i)), F.lit(FLOOR[i] ** 2)) if i == j else F.col(_upper(i, j))
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOOR[i] ** 2 / 10))) if i == j else v / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00")))


def _distance(x: str = "x") -> Column:
    z: list[Column] = []
    for i in range(P):
        v = F.col(f"{x}{i}") - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


_PARAMS = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for j in range(P) for i in range(j, P)]


_SUMS = ["n", *[f"t{i}" for i in range(P)], *[f"t{i}{j}" for i, j in _CELLS]]


def _moments() -> list[Column]:
    return [F.sum(f"x{i}").alias(f"t{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"t{i}{j}") for i, j in _CELLS] + [F.count("*").alias("n")]


def _shape(df: DataFrame, factor: float) -> DataFrame:
    """Location m.. and scatter s.. from sums, with the scatter multiplied by ``factor``."""
    df = df.select("*", *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(P)])
    return df.select("*", *[((F.col(f"t{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor).alias(_upper(i, j)) for i, j in _CELLS])


def _ids(lang: str = "lang", source: str = "source") -> list[Column]:
    """Keys of a row's group, of its language and of all rows."""
    mark = lambda c: [F.col(c).isNull(), F.col(c)]
    return [F.xxhash64(F.lit(0), *mark(lang), *mark(source)).alias("g0"), F.xxhash64(F.lit(1), *mark(lang)).alias("g1"), F.xxhash64(F.lit(2)).alias("g2")]


def fit(stats: DataFrame, *, least: int = 40, share: float = 0.75, tolerance: float = 1e-6) -> DataFrame:
    """Location and inverse scatter for each (lang, source) with a passing row, by its key ``g0``.

    Groups of at least ``least`` passing rows have their own estimate; the rows of smaller ones
    take that of their language, or of all rows where the language has fewer too.
    """
    x = written(stats.where(~F.col("base_failed")).select(*_ids(), *[v.alias(f"x{i}") for i, v in enumerate(vector())]))
    groups = x.groupBy("g0", "g1", "g2").agg(F.count("*").alias("n0"))
    langs = groups.groupBy("g1").agg(F.sum("n0").alias("n1"))
    own = F.when(F.col("n0") >= least, F.col("g0")).when(F.col("n1") >= least, F.col("g1")).otherwise(F.col("g2"))
    chosen = written(groups.join(langs, "g1").select("g0", own.alias("gid")))
    rows = x.select(F.explode(F.array("g0", "g1", "g2")).alias("gid"), *[f"x{i}" for i in range(P)])
    rows = written(spread_join(rows, written(chosen.select("gid").distinct()), ["gid"]))
    med = rows.groupBy("gid").agg(*[F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), ACCURACY).alias(f"q{i}") for i in range(P)], *_moments())
    robust = med.select("gid", F.col("n").alias("all"), F.lit(0).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)], *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(_upper(i, j)) for i, j in _CELLS])
    plain = _shape(med.withColumn("all", F.col("n")), 1.0).withColumn("start", F.lit(1)).select(*robust.columns)
    cols = ["gid", "start", "all", "logdet", "done", *_PARAMS]
    now = _cholesky(robust.unionByName(plain)).withColumns({"logdet": F.lit(float("inf")), "done": F.lit(False)})
    now = written(now.select(*cols))
    while not now.where("not done").isEmpty():
        d = spread_join(rows, now.where("not done"), ["gid"]).withColumn("d", _distance())
        edge = written(d.groupBy("gid", "start").agg(F.percentile_approx("d", share, ACCURACY).alias("edge")))
        d = spread_join(d, edge, ["gid", "start"]).where("d <= edge")
        sums = d.groupBy("gid", "start", "all", (F.col("d") == F.col("edge")).alias("tie")).agg(*_moments())
        # the subset has ceil(share * all) rows: those below the edge, and of those on it what is missing
        sums = sums.groupBy("gid", "start", "all").agg(*[F.struct(F.coalesce(F.sum(F.when(~F.col("tie"), F.col(c))), F.lit(0.0)).alias("below"), F.coalesce(F.sum(F.when(F.col("tie"), F.col(c))), F.lit(0.0)).alias("on")).alias(c) for c in _SUMS])
        weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ceil(F.col("all") * share) - F.col("n.below")) / F.greatest(F.col("n.on"), F.lit(1.0))))
        sums = sums.withColumn("weight", weight)
        new = _cholesky(_shape(sums.select("gid", "start", "all", *[(F.col(f"{c}.below") + F.col("weight") * F.col(f"{c}.on")).alias(c) for c in _SUMS]), consistency(share)))
        new = new.select("gid", "start", F.struct("logdet", *_PARAMS).alias("new"))
        both = now.join(new, ["gid", "start"], "left")
        better = F.col("new").isNotNull() & (F.col("new.logdet") < F.col("logdet") - tolerance)
        now = written(both.select("gid", "start", "all", F.when(better, F.col("new.logdet")).otherwise(F.col("logdet")).alias("logdet"), (~better).alias("done"), *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in _PARAMS]))
    best = now.groupBy("gid").agg(F.min(F.struct("logdet", "start", *_PARAMS)).alias("b"))
    return written(chosen.join(best, "gid").select("g0", *[f"b.{c}" for c in _PARAMS]))


def judged(rows: DataFrame, model: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``rows`` with ``distance`` (null only where no row of the table has an estimate) and ``kept``."""
    cols = rows.columns
    x = rows.select("*", _ids()[0], *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    x = spread_join(x, model, ["g0"], "left").withColumn("distance", _distance())
    return x.select(*cols, "distance", (~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cutoff))).alias("kept"))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``distance`` and ``kept`` for every row.

    Needs ``doc_id``, ``text``, ``lang``, ``source``; other columns are ignored. Null, empty or
    blank text: no words, base_failed. Null lang or source: a group like any other. Every row
    that passes the fixed limits has a distance, in a small group to the estimate of its language
    or of all texts; rows of a group without a passing row have none. Repeated rows: each counts
    and gets the same verdict. Ties on the edge of a subset share the weight that is left; a
    distance equal to the limit is kept. Very long texts: counted whole. Null doc_id: judged like
    any other. Empty table: no rows.
    """
    rows = measured(docs.select("doc_id", "text", "lang", "source"))
    rows = cut(rows.select(F.col("row.doc_id").alias("doc_id"), "lang", "source", *STATS, "base_failed"))
    return judged(rows, fit(rows, **options)).drop("lang", "source")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns as they are.

    Null and very long texts, nulls in other columns, ties, repeated rows and an empty table as
    there; other columns are carried whatever their names.
    """
    rows = measured(docs)
    model = fit(rows.drop("row"), **options)
    return judged(rows, model).where("kept").select("row.*")
