"""URL filter by a path-template tree with smoothed labelled purity. DataFrame functions only.

Paths are split into segments; what is lexically variable (numbers, dates, hex, ids with
digits) becomes a typed wildcard at once, so pages aggregate to far fewer templates before
anything meets. From the root down, each host's tree is then generalised: where paths part,
branches whose labelled purity is alike merge into a wildcard, nearest first, as long as a
Beta-Binomial model finds one share of good pages likelier than two.
A template's purity is smoothed towards that of the same paths over all hosts, which a tree
without hosts gives and which is smoothed itself towards the share over all pages: a branch
with few labelled pages on a host borrows from the others. A purity below the limit blocks.
Fixed rules come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LEVELS = 64  # branches of a node whose smoothed purities fall in the same 64th are alike at once
_CLUSTER = "array<struct<l:double,g:double,n:bigint,seg:string,bins:array<int>,lb:double>>"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equal lengths, the longer host. Null where none fits."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        verdict, name = F.when(fits, F.lit(kind)).otherwise(verdict), F.when(fits, F.lit(rule)).otherwise(name)
    return name, verdict


def segments(path: Column) -> Column:
    """Segments with lexically variable ones as typed wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9]+$"), F.lit("<num>"))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), F.lit("<date>"))
        .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("<hex>"))
        .when(s.rlike(r"[0-9]"), F.regexp_replace(s, r"[0-9]+", "<n>"))
        .otherwise(s),
    )


def _log_gamma(x: str) -> str:
    """SQL: Stirling's series six places up (relative error below 1e-9), and back by the product."""
    z, back = f"({x} + 6)", " * ".join(f"({x} + {k})" for k in range(6))
    return f"(({z} - 0.5) * ln({z}) - {z} + 0.9189385332046727 + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) - ln({back}))"


def _log_beta(g: str, l: str, a: float, b: float) -> str:  # noqa: E741
    """SQL: log B(g + a, l - g + b), with one copy of the series."""
    lists = f"array({g} + {a!r}D, {l} - {g} + {b!r}D, {l} + {a + b!r}D)"
    return f"transform(array(transform({lists}, y -> {_log_gamma('y')})), v -> v[0] + v[1] - v[2])[0]"


def _merged(clusters: str, a: float, b: float) -> str:
    """SQL: neighbours of an array of clusters, sorted by purity, merged where one share explains both better."""
    none = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    both = "named_struct('l', p.l + x.l, 'g', p.g + x.g, 'n', p.n + x.n, 'seg', least(p.seg, x.seg), 'bins', concat(p.bins, x.bins), 'lb', {})".format(_log_beta("(p.g + x.g)", "(p.l + x.l)", a, b))
    step = f"if(m.lb + {none!r}D >= p.lb + x.lb, concat(slice(acc, 1, size(acc) - 1), array(m)), concat(acc, array(x)))"
    return f"aggregate({clusters}, cast(array() as {_CLUSTER}), (acc, x) -> if(size(acc) = 0, array(x), transform(array(element_at(acc, -1)), p -> transform(array({both}), m -> {step})[0])[0]))"


def template_tree(templates: DataFrame, share: float, *, strength: float = 2.0) -> DataFrame:
    """``host``, ``segs``, ``template``, and the counts ``t_pages``, ``t_labelled``, ``t_good`` of that template.

    ``templates``: a row for each (``host``, ``segs``) with ``pages``, ``labelled``, ``good``. A round
    takes each node past the segments that all its paths share, to where they part. Branches whose
    purity (smoothed to ``share`` with ``strength`` pages) falls into one of ``LEVELS`` steps merge,
    then neighbouring steps in three passes, by the ratio of Beta-Binomial likelihoods. Branches
    without a labelled page join the others where those are all alike, else they make a branch of
    their own. A merged branch is ``*``, or ``*1``, ``*2``, ... by purity where several stay apart. A node with one path
    keeps it to the end; a node without labelled pages ends in ``**``. Rounds end when no node
    parts: as many as a path has partings, whatever its length; there is no limit of depth or
    of branches.
    """
    share = min(max(share, 0.01), 0.99)
    a, b = strength * share, strength * (1 - share)
    rows = templates.select(*templates.columns, F.lit("").alias("template"), F.lit(0).alias("at"), (F.size("segs") > 0).alias("open"))
    done = None
    while True:
        rows = written(rows)
        closed = rows.where("not open").drop("open", "at")
        done = closed if done is None else done.unionByName(closed)
        now = rows.where("open").withColumn("rest", F.expr("slice(segs, at + 1, size(segs))"))
        if rows.where("open").isEmpty():
            break
        node = now.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("labelled").alias("nl"))
        shared = F.expr("coalesce(array_position(transform(sequence(0, least(size(lo), size(hi))), i -> not (get(lo, i) <=> get(hi, i))), true), 1) - 1").cast("int")
        node = written(node.select("host", "template", "nl", (F.col("lo") == F.col("hi")).alias("single"), F.when(F.col("lo") == F.col("hi"), F.size("lo")).otherwise(shared).alias("same")))
        now = spread_join(now.drop("rest"), node, ["host", "template"])
        path = F.expr("concat(template, array_join(transform(slice(segs, at + 1, same), s -> concat('/', s)), ''))")
        ends = F.col("single") | (F.col("nl") == 0) | (F.col("at") + F.col("same") >= F.size("segs"))
        tail = F.when(~F.col("single") & (F.col("nl") == 0) & (F.col("at") + F.col("same") < F.size("segs")), F.concat(path, F.lit("/**"))).otherwise(path)
        now = written(now.select(*templates.columns, tail.alias("template"), (F.col("at") + F.col("same")).alias("at"), (~ends).alias("open")).withColumn("seg", F.when(F.col("open"), F.get("segs", F.col("at")))))
        branch = now.where("open").groupBy("host", "template", "seg").agg(F.sum("labelled").cast("double").alias("l"), F.sum("good").cast("double").alias("g"))
        branch = branch.withColumn("bin", F.expr(f"if(l = 0, -1, cast(least({LEVELS - 1}, floor({LEVELS} * (g + {a!r}D) / (l + {float(strength)}D))) as int))"))
        steps = branch.groupBy("host", "template", "bin").agg(F.sum("l").alias("l"), F.sum("g").alias("g"), F.count("*").alias("n"), F.min("seg").alias("seg"))
        steps = steps.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("bin", "l", "g", "n", "seg"))).alias("c"))  # at most LEVELS
        steps = steps.select("host", "template", F.expr(f"cast(transform(c, x -> named_struct('l', x.l, 'g', x.g, 'n', x.n, 'seg', x.seg, 'bins', array(x.bin), 'lb', {_log_beta('x.g', 'x.l', a, b)})) as {_CLUSTER})").alias("c"))
        steps = steps.select("host", "template", F.filter("c", lambda x: x["l"] > 0).alias("c"), F.filter("c", lambda x: x["l"] == 0).alias("none"))
        for _ in range(3):
            steps = steps.withColumn("c", F.expr(_merged("c", a, b)))
        alone = "if(size(c) = 1 and size(none) = 1, array(named_struct('l', c[0].l, 'g', c[0].g, 'n', c[0].n + none[0].n, 'seg', least(c[0].seg, none[0].seg), 'bins', concat(c[0].bins, none[0].bins), 'lb', 0D)), concat(c, none))"
        steps = steps.withColumn("c", F.expr(alone))
        steps = steps.select("host", "template", F.size(F.filter("c", lambda x: x["n"] > 1)).alias("wide"), F.posexplode("c").alias("rank", "x"))
        name = F.when(F.col("x.n") == 1, F.col("x.seg")).when(F.col("wide") == 1, F.lit("*")).otherwise(F.concat(F.lit("*"), F.col("rank") + 1))
        steps = steps.select("host", "template", name.alias("name"), F.explode("x.bins").alias("bin"))
        names = written(branch.join(steps, ["host", "template", "bin"]).select("host", "template", "seg", "name"))
        kept = now.where("not open").drop("seg", "at", "open")
        done = done.unionByName(kept.select(*done.columns))
        now = spread_join(now.where("open"), names, ["host", "template", "seg"])
        rows = now.select(*templates.columns, F.concat("template", F.lit("/"), "name").alias("template"), (F.col("at") + 1).alias("at"), (F.size("segs") > F.col("at") + 1).alias("open"))
    done = written(done)
    total = written(done.groupBy("host", "template").agg(*[F.sum(c).alias(f"t_{c}") for c in ("pages", "labelled", "good")]))
    return spread_join(done.select("host", "segs", "template"), total, ["host", "template"])


def url_filter(pages: DataFrame, labels: DataFrame, *, rules=RULES, least_purity: float = 0.5, prior: float = 10.0, **options) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` for every row.

    Needs ``page_id``, ``url`` of ``pages`` and ``doc_id``, ``quality``, ``toxic`` of ``labels``; other
    columns are ignored. A page's label is that of the document whose id is the first whole
    number among its path's segments; it is good with quality above 0 and not toxic. A template's
    purity over all hosts is smoothed towards the share over all pages with the weight of
    ``prior`` pages, and its purity on a host towards that with the same weight; without a labelled
    page on the host or over all hosts a template has no purity and allows.

    Null url or url without ``://``: empty host and path, template of the root. Null page_id:
    judged like any other. Null or missing labels: not counted; several for a document: the
    worst counts. Repeated pages: each counts. Equal purity and limit: allowed. Without labels
    every page that no rule blocks is allowed. Very long urls: read whole. Empty table: no rows.
    """
    host, path = host_path(F.col("url").cast("string"))
    base = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:[./]|$)", 1)
    base = base.select("*", name.alias("rule"), verdict.alias("fixed"), segments(F.col("path")).alias("segs"), F.when(number != "", number.cast("long")).alias("doc"))
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min(F.when((F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) <= 0), 1).otherwise(0)).alias("ok"))
    named = base.where("doc is not null").groupBy("host", "segs", "doc").agg(F.count("*").alias("n")).join(label, "doc")
    known = named.groupBy("host", "segs").agg(F.sum("n").alias("labelled"), F.sum(F.col("n") * F.col("ok")).alias("good"))
    templates = written(base.groupBy("host", "segs").agg(F.count("*").alias("pages")).join(known, ["host", "segs"], "left").na.fill(0, ["labelled", "good"]))
    total = templates.agg(F.sum("labelled"), F.sum("good")).first()
    share = total[1] / total[0] if total[0] else 1.0
    anywhere = templates.groupBy(F.lit("").alias("host"), "segs").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "good")])
    smooth = lambda to: (F.col("t_good") + prior * to) / (F.col("t_labelled") + prior)
    anywhere = written(template_tree(anywhere, share, **options).select("segs", F.when(F.col("t_labelled") > 0, smooth(F.lit(share))).alias("over_hosts")))
    tree = template_tree(templates, share, **options)
    purity = F.when((F.col("t_labelled") > 0) | F.col("over_hosts").isNotNull(), smooth(F.coalesce("over_hosts", F.lit(share))))
    tree = written(spread_join(tree, anywhere, ["segs"]).select("host", "segs", "template", purity.alias("purity")))
    out = spread_join(base, tree, ["host", "segs"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.coalesce("purity", F.lit(1.0)) >= least_purity, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
