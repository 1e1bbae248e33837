"""Cross-site boilerplate lines by distinct-site spread. DataFrame functions only.

A line is boilerplate where it occurs on at least ``min_sites`` sites (``source``). Lines
seen fewer times than that are out at once. HyperLogLog sketches of the others, one per line
hash and merged by aggregation, estimate their spread; a line whose estimate is near the
limit gets an exact distinct count.

Boilerplate frames a document's own text, from which it is removed. A document without a
line of its own has nothing to frame: it is a copy, left whole for near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

LG_K, NEAR = 12, 0.2
_BLANK = r"translate({}, ' \t\u000b\u000c\r', '') = ''"


def _keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: text key (``k1``, ``k2``), ``site`` (a hash), its place ``i`` and hash ``h``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(*_keys(text), F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("site"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return out.where(~F.expr(_BLANK.format("line"))).select("k1", "k2", "site", "i", F.xxhash64("line").alias("h"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """The hashes ``h`` of lines that occur on at least ``min_sites`` sites.

    A line's occurrences meet only as partial counts, sketches or distinct sites of a task.
    """
    seen = lines.where("site is not null")
    often = seen.groupBy("h").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = written(often.where((F.col("n") >= min_sites) & ((F.col("a") < F.col("b")) | F.lit(min_sites <= 1))).select("h"))
    sketch = spread_join(seen.select("h", "site"), often, ["h"]).groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("s"))
    spread = written(sketch.select("h", F.hll_sketch_estimate("s").alias("sites")))
    near = F.col("sites").between(min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1)
    exact = spread_join(seen.select("h", "site"), spread.where(near).select("h"), ["h"]).distinct().groupBy("h").agg(F.count("*").alias("sites"))
    return spread.where(~near).unionByName(exact).where(F.col("sites") >= min_sites).select("h")


def strip_boilerplate(docs: DataFrame, *, site: str = "source", min_sites: int = 8) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` without boilerplate, ``n_lines``, ``n_removed``.

    Needs ``text`` and ``site``; other columns are carried in ``row`` whatever their names.
    ``n_lines`` counts lines with a word; blank lines are never removed. Null text stays null,
    with no lines; empty text stays empty. A document whose lines with a word are all boilerplate
    stays as it is. Null site: the row counts for no site, but its lines are removed like others.
    Repeated rows: counted once for their site, changed alike. A spread of exactly ``min_sites``
    is boilerplate. Very long texts: all their lines count. Decisions follow from a text alone,
    so equal texts change alike. Empty table: no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    lines = written(_lines(rows.select(text.alias("text"), F.col(f"row.`{site}`").cast("string").alias("site"))), "zstd")
    wide = written(boilerplate(lines, min_sites))
    # one row for each text that has such a line; copies of a text collapse before the shuffle
    hits = spread_join(lines.select("h", "k1", "k2", "i"), wide, ["h"]).groupBy("k1", "k2").agg(F.collect_set("i").alias("at"))
    out = spread_join(rows.select("row", *_keys(F.coalesce(text, F.lit("")))), written(hits), ["k1", "k2"], "left")
    blank = _BLANK.format("l")
    # a generator of one row, so that the lines are split and counted once
    found = F.explode(F.expr(rf"transform(array(split(coalesce(cast(row.text as string), ''), '\n')), ls -> named_struct('ls', ls, 'n', size(filter(ls, l -> not ({blank})))))")).alias("x")
    out = out.select("row", "at", found).select("row", "at", "x.*", (F.col("at").isNotNull() & (F.size("at") < F.col("n"))).alias("go"))
    kept = F.expr(r"array_join(transform(array_except(sequence(0, size(ls) - 1), at), i -> ls[i]), '\n')")
    return out.select("row", F.when(F.col("go"), kept).otherwise(text).alias("text"), F.col("n").cast("long").alias("n_lines"), F.when(F.col("go"), F.size("at")).otherwise(0).cast("long").alias("n_removed"))


def without_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, ``text`` without boilerplate lines. A column ``n_chars``, if
    there is one, is counted anew where the text changed. Null, empty and very long texts, nulls
    in other columns, ties, repeated rows and an empty table as in ``strip_boilerplate``."""
    out = strip_boilerplate(docs, **options)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            cols.append(F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)
