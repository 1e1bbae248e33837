"""Benchmark decontamination by template canonicalisation.

Each word becomes a literal or a typed placeholder (number, name, unit), decided from the
word itself and not from its place in a sentence; a run of names or of numbers is one slot.
Hashes of the windows of such templates, and of the plain words, are joined with those of
the benchmark. An item that shares its template must also fill its slots consistently, each
benchmark value by one document value, so a question with other numbers or names is found
and chance agreement of its frame is not; an item's plain words find it in any context.

The join needs few windows: an item is found where a certain share of its windows occurs, so
some one of its rarest windows must occur. Only those are joined. A Bloom filter of fixed
size lets the workers drop windows that no item has before they leave Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import ship
from .common import written
from .near_dedup import mix

# Words that are units when they follow a number, number words, and words
# that are no names when they begin with a capital.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg t lb lbs oz gram grams kilogram "
    "kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec min h hr second seconds minute minutes hour hours day days "
    "week weeks month months year years percent % $ € £ dollar dollars euro euros cent cents degree degrees °c °f kb mb gb tb w kw v mph kmh km/h".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
PLAIN = frozenset(
    "a an the this that these those it its he she they we you i his her their our your my him them us me who whom whose which what when where why how if then than "
    "and or but nor so yet as at by for from in into of off on onto out over to up with without after before between under during while until since because there "
    "here is are was were be been has have had do does did can could will would shall should may might must let not no yes all any both each every some many much "
    "more most other another such only also however now later suppose given find calculate compute assume consider".split()
)
_EDGE = "\"'`.,;:!?()[]{}<>*#~_|«»“”‘’„…¿¡"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ°"
NUM, NAME, UNIT = "\x00num", "\x00name", "\x00unit"
_LIT, _NUM, _NAME, _UNIT, _GLUED = 1, 2, 3, 4, 5
_U = np.uint64
#: The factor of rolling hashes, salts of the two readings, placeholder hashes by kind.
_STEP, _TEMPLATE, _WORDS = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_SLOT = np.array([0, 0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
MATCH = "array<struct<item_id:bigint,coverage:double,reparameterised:boolean>>"
#: So many rows of benchmark windows (some 60 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def is_number(core: str) -> bool:
    return any(c.isdigit() for c in core) and all(c.isdigit() or c in ".,:/%+-$€£" for c in core)


def _kind(core: str) -> tuple[int, str]:
    """Kind and slot value of a word without its edges."""
    low = core.lower()
    if core[0].isdigit() or core[-1].isdigit() or core[0] in "+-$€£":
        digits = core.rstrip(_LETTERS)
        if is_number(digits) and (digits == core or core[len(digits) :].lower() in UNITS):
            return (_NUM if digits == core else _GLUED), digits
    if low in UNITS:
        return _UNIT, low
    if all(x in NUMBERS for x in low.split("-")):
        return _NUM, low
    base = core[:-2] if low[-2:] in ("'s", "’s") else core
    if base[:1].isupper() and base != base.upper() and base.lower() not in PLAIN:
        return _NAME, base.lower()
    return _LIT, low


class Lexer(dict):
    """Word to its code; what a word is follows from the word alone, so it is worked out once."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.kind, self.hash, self.opens, self.ends = np.empty(0, np.uint8), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool)
        self.core: list[str] = []
        self.new: list[tuple] = []

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            core, opens, ends = word, False, False
        else:
            core = word.strip(_EDGE)
            opens, ends = not core or word[0] != core[0], not core or word[-1] != core[-1]
        low = core.lower()
        if core.isalpha() and core == low:  # most words
            kind = _UNIT if low in UNITS else _NUM if low in NUMBERS else _LIT
        else:
            kind = _kind(core)[0] if core else 0
        self.new.append((kind, xxh64_intdigest(low), opens, ends))
        self.core.append(core)
        self[word] = k = len(self.core) - 1
        return k

    def value(self, k: int) -> str:
        return _kind(self.core[k])[1]

    def unit(self, k: int) -> str:
        """The unit of a word that is one or that ends in one."""
        core, (kind, value) = self.core[k], _kind(self.core[k])
        return core[len(value) :].lower() if kind == _GLUED else value

    def read(self, text: str | None) -> Reading:
        if len(self) > self.most:
            self.reset()
        words = (text or "").split()
        code = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            end, start = len(self.core), len(self.core) - len(self.new)
            if end > len(self.kind):
                self.kind, self.hash, self.opens, self.ends = (np.concatenate([x, np.zeros(end, x.dtype)]) for x in (self.kind, self.hash, self.opens, self.ends))
            for x, y in zip((self.kind, self.hash, self.opens, self.ends), zip(*self.new)):
                x[start:end] = y
            self.new = []
        return Reading(self, code)


class Reading:
    """The tokens of a text: ``plain`` word hashes, and the template's hashes, literals and slot values."""

    def __init__(self, lexer: Lexer, code: np.ndarray):
        self.lexer = lexer
        kind = lexer.kind[code]
        at = np.flatnonzero(kind)
        code, kind = code[at], kind[at]
        self.plain = lexer.hash[code]
        apart = np.ones(len(code), bool)  # whether something stands between a word and the one before
        if len(code):
            apart[1:] = (np.diff(at) > 1) | lexer.ends[code[:-1]] | lexer.opens[code[1:]]
        if len(glued := np.flatnonzero(kind == _GLUED)):
            code, apart = np.insert(code, glued + 1, code[glued]), np.insert(apart, glued + 1, False)
            kind = np.insert(kind, glued + 1, _UNIT)
            kind[kind == _GLUED] = _NUM
        before = np.concatenate([np.zeros(min(1, len(kind)), np.uint8), kind[:-1]])
        kind = np.where((kind == _UNIT) & ((before != _NUM) | apart), _LIT, kind)
        joined = ((kind == _NAME) | (kind == _NUM)) & (kind == before) & ~apart
        self.first = np.flatnonzero(~joined)
        self.last = np.append(self.first[1:], len(kind))[: len(self.first)]
        self.code, self.kinds = code, kind
        self.kind = kind[self.first]
        self.literal = self.kind == _LIT
        self.template = np.where(self.literal, lexer.hash[code[self.first]], _SLOT[np.where(self.literal, 0, self.kind)])

    def value(self, i: int) -> str:
        """What the token says, in small letters."""
        run = range(self.first[i], self.last[i])
        if self.kind[i] == _UNIT:
            return self.lexer.unit(self.code[run[0]])
        return " ".join(self.lexer.value(self.code[j]) for j in run)


def canonical(text: str | None) -> tuple[list[str], list[str]]:
    """Canonical words and what they stand for; words of punctuation only vanish."""
    r = Lexer().read(text)
    raw = [r.value(i) for i in range(len(r.kind))]
    return [{_NUM: NUM, _NAME: NAME, _UNIT: UNIT}.get(int(k), v) for k, v in zip(r.kind, raw)], raw


def _rolled(h: np.ndarray, n: int, salt) -> np.ndarray:
    m = len(h) - n + 1
    acc = np.full(max(m, 0), salt ^ _U(n), np.uint64)
    for j in range(n if m > 0 else 0):
        acc = acc * _STEP + h[j : j + m]
    return mix(acc)


def template_windows(r: Reading, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the ``n``-token windows with at least two literals: with fewer,
    nothing is left to tell a template by."""
    if not 0 < n <= len(r.template):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    literal = np.concatenate([[0], np.cumsum(r.literal)])
    at = np.flatnonzero(literal[n:] - literal[:-n] >= 2)
    return _rolled(r.template, n, _TEMPLATE)[at], at


class Item:
    """A benchmark item: its windows by both readings, and the comparison with a text."""

    def __init__(self, r: Reading, window: int):
        self.r = r
        self.n, self.words = min(window, len(r.template)), min(window, len(r.plain))
        self.hash, self.at = template_windows(r, self.n)
        self.plain = _rolled(r.plain, self.words, _WORDS) if self.words else np.empty(0, np.uint64)

    def verdict(self, d: Reading, coverage: float, verbatim: float) -> tuple[float, bool] | None:
        """Coverage and whether slots were filled otherwise; None where the text lacks the item."""
        plain = 0.0
        if len(self.plain):
            plain = float(np.isin(self.plain, _rolled(d.plain, self.words, _WORDS)).mean())
        if plain == 1.0:
            return 1.0, False
        share, changed = self._template(d, coverage)
        if share >= coverage and share >= plain:
            return share, changed
        return (plain, False) if len(self.plain) and plain >= verbatim else (share, changed) if share >= coverage else None

    def _template(self, d: Reading, coverage: float) -> tuple[float, bool]:
        total = len(self.hash)
        h, at = template_windows(d, self.n)
        keep = np.isin(h, self.hash)
        h, at = h[keep], at[keep]
        if not total or len(np.unique(h)) == 0:
            return -1.0, False
        order = np.argsort(self.hash, kind="stable")
        mine, places = self.hash[order], self.at[order]
        possible = set(self.at[np.isin(self.hash, h)].tolist())
        if len(possible) < coverage * total:
            return -1.0, False
        covered: set[int] = set()
        changed, literals = False, set()
        step = max(1, (1 << 20) // total)  # places of the text at a time: bounded pairs for any text
        for lo in range(0, len(h), step):
            a, b = np.searchsorted(mine, h[lo : lo + step], "left"), np.searchsorted(mine, h[lo : lo + step], "right")
            n = b - a
            pick = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shift, p = np.repeat(at[lo : lo + step], n) - places[pick], places[pick]
            order = np.argsort(shift, kind="stable")
            cuts = np.flatnonzero(np.diff(shift[order])) + 1
            for group in sorted(np.split(order, cuts), key=len, reverse=True):
                if possible <= covered:
                    break
                here = p[group]
                ok, other = self._consistent(d, here, int(shift[group[0]]))
                if ok:
                    covered.update(here.tolist())
                    changed |= other
        for i in covered:
            literals.update((np.flatnonzero(self.r.literal[i : i + self.n]) + i).tolist())
        if len(literals) < min(4, int(self.r.literal.sum())):
            return -1.0, False
        return len(covered) / total, changed

    def _consistent(self, d: Reading, places: np.ndarray, shift: int) -> tuple[bool, bool]:
        """Whether each slot value of the windows at ``places`` has one value in the text, and if some differ.
        The first and last token of the item may be part of a longer run in the text."""
        inside = np.zeros(len(self.r.kind), bool)
        for i in places:
            inside[i : i + self.n] = True
        to: dict[tuple[int, str], str] = {}
        changed, ends = False, {0, len(inside) - 1}
        for i in sorted(np.flatnonzero(inside & ~self.r.literal).tolist(), key=lambda i: i in ends):
            mine, theirs = self.r.value(i), d.value(i + shift)
            want = to.get((int(self.r.kind[i]), mine), mine)
            if i == 0 and theirs.endswith(" " + want) or i == len(inside) - 1 and theirs.startswith(want + " "):
                theirs = want
            if to.setdefault((int(self.r.kind[i]), mine), theirs) != theirs:
                return False, False
            changed |= mine != theirs
        return True, changed


def _bench_windows(items: DataFrame, window: int, coverage: float, verbatim: float) -> DataFrame:
    """``cls``, ``reading``, ``n``, ``h`` for the windows that an item needs one of, ``total``, ``m``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer()
        for batch in batches:
            rows = []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                item = Item(lexer.read(text.as_py()), window)
                for reading, n, hashes in ((0, item.n, item.hash), (1, item.words, item.plain)):
                    u, m = np.unique(hashes, return_counts=True)
                    rows.append((np.full(len(u), cls), np.full(len(u), reading, np.int32), np.full(len(u), n, np.int32), u.view(np.int64), m, np.full(len(u), len(hashes))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], ["cls", "reading", "n", "h", "m", "total"])

    w = items.select("cls", "text").mapInArrow(of, "cls long, reading int, n int, h long, m long, total long")
    shared = w.groupBy("h").agg(F.count("*").alias("items"))
    share = F.when(F.col("reading") == 0, F.lit(coverage)).otherwise(F.lit(verbatim))
    # an item is found with ``share`` of its windows, so the rarest others and one more always hold one of them
    rarest = Window.partitionBy("cls", "reading").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)
    w = w.join(shared, "h").withColumn("before", F.coalesce(F.sum("m").over(rarest), F.lit(0)))
    return w.where(F.col("before") <= F.col("total") - F.ceil(share * F.col("total"))).select("cls", "n", "reading", "h")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, coverage: float = 0.5, verbatim: float = 0.8, bits: int = 26) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``matches``: the benchmark items found in its text.

    Needs ``text`` in ``docs`` and ``item_id``, ``text`` in ``benchmark``; other columns are
    carried or ignored whatever their names. An item is found where at least ``coverage`` of its
    template's windows occur with consistent slots and at least four of its literals (all, where
    it has fewer), or at least ``verbatim`` of the windows of its plain words. Items shorter than
    a window have one window of their length, so a very short item is found wherever its words
    stand next to each other. A template without two literals in a window is looked for by its
    plain words only. ``bits`` sets the fixed size of the Bloom filter (2^bits / 8 bytes) and
    changes no result.

    Null, empty or blank text, or an empty benchmark: no matches. An item without a word: never
    found. Null item_id: matched, reported as null. Repeated or equal documents: alike. Repeated
    items: each reported. Ties (a share equal to the limit): found. Very long texts: read whole;
    pairs of equal windows are compared in blocks of bounded size. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("cls"))
    texts_of = items.groupBy("cls").agg(F.min("text").alias("text"))  # equal items are one class
    probes = written(_bench_windows(texts_of, window, coverage, verbatim))
    sizes = sorted((r["reading"], r["n"]) for r in probes.select("reading", "n").distinct().collect())  # at most two for each length up to a window
    places = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << bits) - 1)) if s else F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, 9, 18, 64 - bits)]))
    words = probes.select(places.alias("p")).groupBy(F.expr("p div 8").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(p % 8 as int)))").alias("b")).toArrow()  # at most 2^bits / 8 rows
    bloom = np.zeros(1 << bits >> 3, np.uint8)
    bloom[words["at"].to_numpy()] = words["b"].to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast((bloom, sizes))

    @F.arrow_udf("array<long>")
    def suspects(texts: pa.Array) -> pa.Array:
        lexer, (seen, kinds), out = Lexer(), shared.value, []
        for t in texts:
            r, parts = lexer.read(t.as_py()), []
            for reading, n in kinds:
                h = template_windows(r, n)[0] if reading == 0 else _rolled(r.plain, n, _WORDS)
                for s in (64 - bits, 18, 9, 0):
                    if len(h):
                        p = (h >> _U(s)) & _U((1 << bits) - 1)
                        h = h[(seen[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & np.uint8(1) > 0]
                if len(h):
                    parts.append(np.unique(h).view(np.int64))
            out.append(np.concatenate(parts) if parts else None)
        return pa.array(out, pa.list_(pa.int64()))

    text = F.col("text").cast("string")
    key = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    # only texts with such a window go on, each once; decisions follow from a text alone
    found = docs.where("text is not null").select(*key, text.alias("text"), suspects(text).alias("hs")).where("hs is not null")
    found = written(found.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("hs").alias("hs")), "zstd")
    hits = found.select("k1", "k2", F.explode("hs").alias("h"))
    need = probes.select("h", "cls").distinct()
    if probes.count() <= MOST_BROADCAST:
        pairs = hits.join(F.broadcast(need), "h")
    else:  # a frequent window is dealt over sixteen tasks
        salt = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
        pairs = hits.withColumn("salt", F.pmod("k1", F.lit(16)).cast("int")).join(need.select("h", "cls", salt), ["h", "salt"])
    pairs = pairs.select("k1", "k2", "cls").distinct()
    pairs = pairs.join(found.select("k1", "k2", "text"), ["k1", "k2"]).join(texts_of.withColumnRenamed("text", "item"), "cls")

    @F.arrow_udf("struct<coverage:double,reparameterised:boolean>")
    def judge(texts: pa.Array, others: pa.Array) -> pa.Array:
        lexer, last, known, out = Lexer(1 << 62), None, {}, []
        for t, i in zip(texts, others):
            t, i = t.as_py(), i.as_py()
            if len(lexer) > 1_000_000:
                lexer, last, known = Lexer(1 << 62), None, {}
            if last is None or last[0] != t:
                last = (t, lexer.read(t))
            if i not in known:
                if len(known) > 10_000:
                    known.clear()
                known[i] = Item(lexer.read(i), window)
            v = known[i].verdict(last[1], coverage, verbatim)
            out.append(v and {"coverage": v[0], "reparameterised": v[1]})
        return pa.array(out, pa.struct([("coverage", pa.float64()), ("reparameterised", pa.bool_())]))

    hit = written(pairs.select("k1", "k2", "cls", judge("text", "item").alias("v")).where("v is not null"))
    one = F.struct("item_id", "v.coverage", "v.reparameterised")
    hit = hit.join(items.select("cls", "item_id"), "cls").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(one)).alias("matches"))
    hit = written(hit.select("k1", "k2", F.col("matches").cast(MATCH).alias("matches")))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key).join(hit, ["k1", "k2"], "left")
    return out.select("row", F.coalesce("matches", F.expr(f"cast(array() as {MATCH})")).alias("matches"))

