"""Near-duplicate documents by min-max hashing, bands and an exact check.

Min-max hashing evaluates each permutation once and keeps both its minimum and its
maximum, so a signature of 2P values costs P evaluations; each value agrees between two
sets with probability equal to their Jaccard similarity. With ``rows`` values a band and
``bands`` bands a link of similarity 0.8 escapes with probability
(1 - 0.8^rows)^bands: 5e-7 for the 6 rows and 48 bands used here. No band has both the
minimum and the maximum of a permutation, which in a small set never are the same shingle.

Equal sets collapse into one class first. In each bucket, classes are compared with a few
centres, not with each other; what the links found so far do not join is compared in full
afterwards, so no pairs within a joined group are emitted, and no candidate is dropped, also
where no centre has a link.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import cut, written
from .components import components

ROWS, BANDS, CENTRES, FINE = 6, 48, 4, 2048
SIDE = 64, 256
SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
_U = np.uint64


class _Words(dict):
    """Word (bytes) to its 64-bit hash; forgets all when it holds a quarter million."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: bytes, n: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, of them all."""
    words = text.lower().split()  # bytes: A-Z, and exactly the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = mix(out) + h[j : len(h) - n + 1 + j]
    return np.unique(mix(out))


def shingle_set(text: bytes, n: int) -> set:
    words = text.lower().split()
    n = min(n, len(words))
    return set(zip(*(words[j:] for j in range(n)))) if n else set()


def layout(rows: int, bands: int) -> np.ndarray:
    """The permutation behind each value of a signature, rows x bands: minima first, then maxima,
    shifted so that both of a permutation fall into different bands."""
    p = -(-rows * bands // 2)
    shift = 1 if (p + 1) % bands else 2
    return np.concatenate([np.arange(p), np.roll(np.arange(p), shift)])[: rows * bands].reshape(rows, bands)


def signer(rows: int, bands: int, seed: int = 42):
    """A function from shingle hashes to the ``bands`` keys of their min-max signature and
    the last two bits of each of its values, as two planes of packed longs."""
    rng = np.random.default_rng(seed)
    p, high_of = -(-rows * bands // 2), layout(rows, bands).ravel()[-(-rows * bands // 2) :]
    xor, mul = rng.integers(0, 2**63, p, np.uint64), rng.integers(0, 2**62, p, np.uint64) * _U(2) + _U(1)
    weight, salt = rng.integers(0, 2**62, rows, np.uint64) * _U(2) + _U(1), rng.integers(0, 2**63, bands, np.uint64)

    def sign(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(p, 2**64 - 1, np.uint64), np.zeros(p, np.uint64)
        for at in range(0, len(u), 2048):  # memory stays bounded for any length
            h = (u[at : at + 2048, None] ^ xor) * mul
            low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
        flat = mix(np.concatenate([low, ~high[high_of]]))
        values = flat.reshape(rows, bands)
        planes = np.zeros((2, -(-len(flat) // 64) * 64), np.uint8)
        planes[0, : len(flat)], planes[1, : len(flat)] = flat & _U(1), (flat >> _U(1)) & _U(1)
        keys = mix((values * weight[:, None]).sum(0, dtype=np.uint64) + salt).view(np.int64)
        return keys, np.packbits(planes.ravel(), bitorder="little").view(np.int64)

    return sign


def most_differing(values: int, percent: int) -> int:
    """How many of a signature's two-bit values may differ between linked sets: five standard
    deviations above the mean at the least similarity, so 3 links in ten million exceed it."""
    p = 0.75 * (1 - percent / 100)
    return int(values * p + 5 * (values * p * (1 - p)) ** 0.5) + 1


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def sketch_udf(n: int, rows: int, bands: int):
    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        memo, sign = _Words(), signer(rows, bands)
        sizes, keys, out, bits = [], [], [], []
        for t in texts:
            u = shingle_hashes(t.as_py() or b"", n, memo)
            sizes.append(len(u))
            keys.append(blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
            x, y = sign(u) if len(u) else (np.empty(0, np.int64), np.empty(0, np.int64))
            out.append(x)
            bits.append(y)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(out), _lists(bits)], ["n", "cls", "bands", "bits"])

    return sketch


def fine_udf(n: int):
    """Bits of a signature of ``FINE`` values, for classes that few cheap tests have told apart."""

    @F.arrow_udf("array<long>")
    def fine(texts: pa.Array) -> pa.Array:
        memo, sign = _Words(), signer(FINE, 1, seed=7)
        return _lists([sign(shingle_hashes(t.as_py(), n, memo))[1] for t in texts])

    return fine


def verify_udf(n: int, percent: int):
    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        seen: dict[bytes, set] = {}

        def of(t: bytes) -> set:
            if t not in seen:
                if len(seen) >= 32:
                    seen.clear()
                seen[t] = shingle_set(t, n)
            return seen[t]

        out = []
        for a, b in zip(left, right):
            x, y = of(a.as_py()), of(b.as_py())
            both = len(x & y)
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return linked


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose full sets are similar enough."""
    a, b = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(verify_udf(n, percent)("ta", "tb")).select("a", "b")


def linked_in_block(sets: dict, wanted: dict, percent: int) -> list[tuple]:
    """Those (y, x) of ``wanted`` (y to its x's) whose ``sets`` are similar enough: shingles become numbers, and one
    look-up table for each y counts what all its x's have in common with it."""
    number: dict = {}
    coded = {c: np.fromiter((number.setdefault(g, len(number)) for g in some), np.int64, len(some)) for c, some in sets.items()}
    mark, out = np.zeros(len(number), np.int64), []
    for y, xs in wanted.items():
        mark[coded[y]] = 1
        size = np.array([len(coded[x]) for x in xs])
        both = np.add.reduceat(mark[np.concatenate([coded[x] for x in xs])], np.concatenate([[0], np.cumsum(size)[:-1]]))
        out += [(y, xs[k]) for k in np.flatnonzero(100 * both >= percent * (size + len(coded[y]) - both)).tolist()]
        mark[coded[y]] = 0
    return out


def _verified_in_blocks(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (``y``, ``x``, ``comp``: that of x) as ``a``, ``b``, by full sets.

    Many near misses of one large component need its texts again and again; so the pairs of a component are
    dealt into blocks of about ``SIDE`` of its y and x, and a block gets each of its texts once.
    """
    ys, xs = SIDE
    some = pairs.groupBy("comp").agg(F.ceil(F.approx_count_distinct("y") / ys).alias("ny"), F.ceil(F.approx_count_distinct("x") / xs).alias("nx"))
    at = pairs.join(some, "comp").select("comp", F.pmod(F.xxhash64("y"), "ny").alias("yb"), F.pmod(F.xxhash64("x", F.lit(1)), "nx").alias("xb"), "y", "x")
    at = cut(at)
    block = ["comp", "yb", "xb"]
    has = at.select(*block, F.col("y").alias("cls")).unionByName(at.select(*block, F.col("x").alias("cls"))).distinct()
    has = has.join(texts, "cls").select(*block, "cls", "text", F.lit(None).cast("array<long>").alias("xs"))
    wants = at.groupBy(*block, "y").agg(F.collect_list("x").alias("xs")).select(*block, F.col("y").alias("cls"), F.lit(None).cast("binary").alias("text"), "xs")

    def link(t: pa.Table) -> pa.Table:
        sets, wanted = {}, {}
        for c, text, some in zip(*(t.column(k).to_pylist() for k in ("cls", "text", "xs"))):
            if some is None:
                sets[c] = shingle_set(text, n)
            else:
                wanted[c] = some
        out = linked_in_block(sets, wanted, percent)
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return has.unionByName(wants).groupBy(*block).applyInArrow(link, "a long, b long")


def _pair(x: str, y: str, or_x: str | None = None, or_y: str | None = None) -> list:
    x, y = F.coalesce(x, or_x or x), F.coalesce(y, or_y or y)
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """All columns of ``docs`` in ``row``, with ``n_shingles``, ``component_id``, ``kept``, ``first``.

    Needs ``doc_id`` and ``text``; other columns are carried in ``row`` whatever their names.
    A text's set is its distinct ``shingle``-word shingles, lower-cased in A-Z; with fewer
    words, the whole sequence. Two sets are linked where 100 * common >= ``percent`` * union.
    ``component_id``: the smallest doc_id reachable; ``kept``: the row has that doc_id.
    ``first``: the one row that stands for its component.

    Null, empty or blank text: no shingles, linked with nothing, kept and first.
    Null doc_id: such a row takes part in links, but its id is never a component's while
    another is known; a component of null ids only has a null id, and its rows are kept.
    Repeated rows: each is returned and kept alike; only one of them is first. Ties: a similarity
    equal to ``percent`` links; of equal doc_ids the first row stands. Very long texts: their whole
    sets count, hashed in blocks. Empty table: no rows.
    """
    ship(docs.sparkSession)
    rows_in = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sketched = written(rows_in.select(F.monotonically_increasing_id().alias("rid"), "row", sketch_udf(shingle, rows, bands)(F.col("row.text").cast("binary")).alias("s")), "zstd")
    nodes = sketched.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("s.n").alias("n"), F.col("s.cls").alias("cls"))
    classes = cut(nodes.where("cls is not null").groupBy("cls").agg(F.min("rid").alias("head")))  # a class is known by its first row
    heads = sketched.select("rid", F.col("s.n").cast("int").alias("n"), F.col("s.bands").alias("bands"), F.col("s.bits").alias("bits"))
    heads = heads.join(classes.select(F.col("head").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "cls")
    member = heads.select("cls", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    member = cut(member.join(shared, "bucket").join(heads.select("cls", "n", "bits"), "cls"))
    texts = sketched.select("rid", F.col("row.text").cast("binary").alias("text")).join(member.select(F.col("cls").alias("rid")).distinct(), "rid", "left_semi")
    texts = written(texts.select(F.col("rid").alias("cls"), "text"), "zstd")

    def alike(x: str, y: str, values: int, half: int):
        """Whether so many values of two signatures agree as a link's do; the differing bits are
        summed in order. half: words of a plane, of which the first are compared."""
        word = lambda c, i: F.get(c, F.lit(i))
        differ = (F.bit_count(word(x, i).bitwiseXOR(word(y, i)).bitwiseOR(word(x, i + half).bitwiseXOR(word(y, i + half)))) for i in range(-(-values // 64)))
        return sum(differ, F.lit(0)) <= most_differing(values, percent)

    def long_alike(x: str, y: str, values: int):
        """The same for long signatures, as array functions: so many words unrolled are too long a method to compile."""
        half = -(-values // 64)
        part = lambda k: F.zip_with(F.slice(x, k, half), F.slice(y, k, half), lambda a, b: a.bitwiseXOR(b))
        differ = F.zip_with(part(1), part(half + 1), lambda a, b: F.bit_count(a.bitwiseOR(b)))
        return F.aggregate(differ, F.lit(0), lambda t, v: t + v) <= most_differing(values, percent)

    def sized(x: str, y: str):
        """Sizes that a link may have."""
        return 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")

    root = None  # class to its component so far; classes without a link are not in it
    tried = None
    for k in range(8):
        one = F.struct("cls", "n", "bits")
        if root is None:
            at = member.select("bucket", one.alias("x"), F.col("cls").alias("comp"))
        else:
            at = member.join(root.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", one.alias("x"), F.coalesce("root", "cls").alias("comp"))
        # few centres for a group, whatever its bands: chosen by hash with what is left of the bucket
        by = F.struct(F.xxhash64("x.cls", F.lit(k), F.pmod("bucket", F.lit(CENTRES))).alias("h"), "x", "comp")
        sizes = at.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.min(by).alias("head"))
        mixed = sizes.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("m", "comp")).alias("most"), F.min("head").alias("c")).where("comps > 1")
        at = at.join(mixed.select("bucket", F.col("most.comp").alias("most"), "c"), "bucket")
        last = k == 7 or (k > 0 and found < CENTRES * 250 + before // 20)
        if last:  # every pair in a bucket that the links do not join yet, from its smaller components
            fine = texts.join(at.select(F.col("x.cls").alias("cls")).distinct(), "cls", "left_semi").select("cls", fine_udf(shingle)("text").alias("fine"))
            fine = cut(fine.join(heads.select("cls", "bands"), "cls").withColumnRenamed("cls", "own"))
            at = at.join(fine, F.col("x.cls") == F.col("own")).select("bucket", "comp", "most", F.struct("x.cls", "x.n", "bands", "fine").alias("x"))
            few = at.where(F.col("comp") != F.col("most")).select("bucket", F.col("x").alias("y"), F.col("comp").alias("cy"))
            # a pair meets in every bucket that both have, and from both sides: it counts in the least of them, from its smaller class
            once = ((F.col("comp") == F.col("most")) | (F.col("x.cls") < F.col("y.cls"))) & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("bucket"))
            similar = alike("x.fine", "y.fine", 320, FINE // 64) & once & long_alike("x.fine", "y.fine", FINE)
            pairs = few.join(at, "bucket").where((F.col("comp") != F.col("cy")) & sized("x", "y") & similar).select(*_pair("x.cls", "y.cls"), F.col("y.cls").alias("y"), F.col("x.cls").alias("x"), "comp")
        else:  # those with a centre
            pairs = at.where((F.col("comp") != F.col("c.comp")) & sized("x", "c.x") & alike("x.bits", "c.x.bits", rows * bands, -(-rows * bands // 64))).select(*_pair("x.cls", "c.x.cls"))
        pairs = pairs.dropDuplicates(["a", "b"])
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if last:
            links = cut(_verified_in_blocks(pairs.select("y", "x", "comp"), texts, shingle, percent))
        else:
            tried = pairs if tried is None else tried.unionByName(pairs)
            links = cut(_verified(pairs, texts, shingle, percent))
        if root is not None:  # of these, only what joins two components matters
            known = root.withColumnRenamed("node", "a").withColumnRenamed("root", "ra")
            links = links.join(known, "a", "left").join(known.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left")
            links = links.select(*_pair("ra", "rb", "a", "b"))
        found, before = links.count(), found if k else 0
        if found:
            new = components(links)
            if root is None:
                root = cut(new)
            else:
                moved = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
                old = root.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
                root = cut(old.unionByName(new.join(root.select("node"), "node", "left_anti")))
        if last:
            break
    root = root if root is not None else classes.select(F.col("head").alias("node"), F.col("head").alias("root"))
    top = classes.join(root.withColumnRenamed("node", "head"), "head", "left").select("cls", F.coalesce("root", "head").alias("comp"))
    nodes = nodes.join(top, "cls", "left")
    head = cut(nodes.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head")))
    state = nodes.join(head, "comp", "left").select(
        "rid", "n", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), (F.col("comp").isNull() | (F.col("head.rid") == F.col("rid"))).alias("first")
    )
    return sketched.select("rid", "row").join(state, "rid").select("row", F.col("n").alias("n_shingles"), "component_id", F.col("row.doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first")
