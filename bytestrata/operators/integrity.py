"""Merkle trees, manifests, diffs, range reads, search, paths, crypto round trips."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources import archive


def merkle_root(leaves: DataFrame, key: str) -> DataFrame:
    """``key``, ``root`` (hex) of leaves ``pos`` (from 0) and ``hash`` (hex). An odd level repeats its
    last node, and a single leaf is hashed with itself. As many rounds as the largest tree is high."""
    size = leaves.groupBy(key).agg(F.count("*").alias("n"))
    most = size.agg(F.max("n")).first()[0] or 0
    now = leaves.join(size, key).select(key, "n", "pos", "hash")
    for level in range(max(1, (most - 1).bit_length())):
        pairs = now.groupBy(key, "n", F.expr("pos div 2").alias("pos")).agg(F.min_by("hash", "pos").alias("l"), F.max_by("hash", "pos").alias("r"))
        parent = F.sha2(F.concat(F.unhex("l"), F.unhex("r")), 256)
        now = pairs.select(key, ((F.col("n") + 1) / 2).cast("long").alias("n"), "pos", (parent if not level else F.when(F.col("n") == 1, F.col("l")).otherwise(parent)).alias("hash"))
    return now.select(key, F.col("hash").alias("root"))


def merkle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of ``a`` whose leaf differs; all of them where the counts differ."""
    counts = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))  # two single rows
    both = a.select("pos", F.col("hash").alias("ha")).join(b.select("pos", F.col("hash").alias("hb")), "pos", "left").crossJoin(F.broadcast(counts))
    return both.where((F.col("na") != F.col("nb")) | ~F.col("ha").eqNullSafe(F.col("hb"))).select("pos")


def trusted(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """Messages whose ``peer`` is among the trusted ones; a null peer is not."""
    return messages.join(peers.select("peer"), "peer", "left_semi")


def manifest(entries: DataFrame, *more) -> DataFrame:
    """``codebook_id``, ``delta_hash``, ``chunk_size`` in order of ``object_id``, ``chunk_idx``."""
    return entries.select("object_id", "chunk_idx", F.coalesce("codebook_id", F.lit(-1)).alias("codebook_id"), F.sha2("residual", 256).alias("delta_hash"), F.col("size").alias("chunk_size"), *more)


def manifest_json(entries: DataFrame) -> DataFrame:
    """``object_id``, ``manifest``: the entries of an object in order, as JSON."""
    one = F.struct("chunk_idx", "codebook_id", "delta_hash", "chunk_size")
    return entries.groupBy("object_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("manifest"))


def manifest_from_json(manifests: DataFrame) -> DataFrame:
    """Entries of JSON manifests; one that is no JSON has none."""
    kind = "array<struct<chunk_idx:int,codebook_id:bigint,delta_hash:string,chunk_size:int>>"
    return manifests.select("object_id", F.explode(F.from_json("manifest", kind)).alias("m")).select("object_id", "m.*")


def manifest_binary(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """``object_id``, ``manifest``: binary, with the 64-bit hashes of residuals (``delta_hash`` long)."""
    ship(entries.sparkSession)

    @F.arrow_udf("binary")
    def build(digests: pa.Array, sizes: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for d, n, some in zip(digests.to_pylist(), sizes.to_pylist(), rows):
            v = some.values.flatten()  # chunk_idx, codebook_id, delta_hash, chunk_size
            table = np.zeros(len(v[0]), archive._MANIFEST_ENTRY)
            for name, column in zip(table.dtype.names, v[1:]):
                table[name] = column.to_numpy(zero_copy_only=False).astype(table.dtype[name])
            out.append(archive.write_manifest(d, n, table))
        return pa.array(out, pa.binary())

    rows = entries.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "codebook_id", "delta_hash", "chunk_size"))).alias("rows"))
    o = objects.select("object_id", F.unhex(F.sha2("content", 256)).alias("digest"), F.octet_length("content").cast("long").alias("n"))
    return rows.join(o, "object_id").select("object_id", build("digest", "n", "rows").alias("manifest"))


def manifest_from_binary(manifests: DataFrame) -> DataFrame:
    """``object_id``, ``original_size``, ``chunk_idx``, ``codebook_id``, ``delta_hash``, ``chunk_size`` of binary manifests."""
    ship(manifests.sparkSession)
    kind = manifests.schema["object_id"].dataType.simpleString()

    def of(batches):
        for batch in batches:
            for i in range(len(batch)):
                _, _, size, rows = archive.parse_manifest(batch.column(1)[i].as_py())
                if len(rows):
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows))
                    signed = [pa.array(rows[c].astype(np.int64)) for c in ("codebook_id", "delta_hash")]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), size, np.int64)), pa.array(np.arange(len(rows), dtype=np.int32)), *signed, pa.array(rows["chunk_size"].astype(np.int32))], ["object_id", "original_size", "chunk_idx", "codebook_id", "delta_hash", "chunk_size"])

    return manifests.select("object_id", "manifest").mapInArrow(of, f"object_id {kind}, original_size bigint, chunk_idx int, codebook_id bigint, delta_hash bigint, chunk_size int")


def manifest_diff(local: DataFrame, remote: DataFrame, *key: str) -> DataFrame:
    """Rows that only one side has, duplicates kept: ``side`` is missing (remote only) or extra (local only)."""
    missing = remote.join(local.select(*key).distinct(), list(key), "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(local.join(remote.select(*key).distinct(), list(key), "left_anti").withColumn("side", F.lit("extra")))


def received(wanted: DataFrame, got: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Each wanted row with the payload that came, else the local one: by key, not by position."""
    out = wanted.join(got.select(key, F.col("payload").alias("_got")).dropDuplicates([key]), key, "left")
    out = out.join(local.select(key, F.col("payload").alias("_own")).dropDuplicates([key]), key, "left")
    return out.withColumn("payload", F.coalesce("_got", "_own")).withColumn("origin", F.when(F.col("_got").isNotNull(), "peer").when(F.col("_own").isNotNull(), "local").otherwise("none")).drop("_got", "_own")


def read_range(chunks: DataFrame, start: int, length: int, data: str = "data") -> DataFrame:
    """``object_id``, ``content``: bytes [start, start + length) of every object, from the chunks that overlap them only."""
    end = start + length
    part = F.substring(data, (F.greatest(F.lit(start), F.col("offset")) - F.col("offset") + 1).cast("int"), (F.least(F.lit(end), F.col("offset") + F.col("size")) - F.greatest(F.lit(start), F.col("offset"))).cast("int"))
    over = chunks.where((F.col("offset") < end) & (F.col("offset") + F.col("size") > start)).select("object_id", "chunk_idx", part.alias("part"))
    return over.groupBy("object_id").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY chunk_idx)").alias("content"))


def tolerant(decoded: DataFrame) -> DataFrame:
    """``decoded`` with zeros where it is null, and ``corrupt``."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size")))
    return decoded.withColumn("corrupt", F.col("decoded").isNull()).withColumn("decoded", F.coalesce("decoded", zeros))


def grep_codewords(entries: DataFrame, book: DataFrame, needle: bytes) -> DataFrame:
    """Entries whose codeword has the needle, which is looked for in the codebook only."""
    hit = book.where(F.contains("pattern", F.lit(needle))).select("codebook_index", "codebook_id")
    return entries.where(F.col("encoding").isin("xor", "patch")).join(hit, ["codebook_index", "codebook_id"], "left_semi")


def grep_hits(entries: DataFrame, book: DataFrame, needle: bytes, most: int = 20) -> DataFrame:
    """Hits of ``grep_codewords`` in order: ``object_id``, ``chunk_idx``, ``offset`` (original bytes before the
    chunk), and for the first ``most`` of them ``shown``, the decoded chunk with blanks for line ends."""
    from . import packing

    w = Window.partitionBy("object_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))
    hits = grep_codewords(placed, book, needle)
    first = hits.orderBy("object_id", "chunk_idx").limit(most)
    clean = F.translate(F.decode("decoded", "ISO-8859-1"), "\n", " ")
    shown = packing.decode(first, book).select("object_id", "chunk_idx", clean.alias("shown"))
    return hits.select("object_id", "chunk_idx", "offset").join(F.broadcast(shown), ["object_id", "chunk_idx"], "left")  # at most ``most`` rows


def grep_exact(objects: DataFrame, needle: bytes) -> DataFrame:
    return objects.where(F.contains("content", F.lit(needle)))


def paths(inodes: DataFrame) -> DataFrame:
    """``id``, ``path`` of every inode by a recursive join over parents."""
    return inodes.sparkSession.sql(
        "WITH RECURSIVE p(id, path, depth) AS (SELECT id, name, 0 FROM {inodes} WHERE parent_id IS NULL UNION ALL "
        "SELECT i.id, concat(p.path, '/', i.name), p.depth + 1 FROM {inodes} i JOIN p ON i.parent_id = p.id) SELECT id, path FROM p",
        inodes=inodes,
    )


def inodes(files: DataFrame) -> DataFrame:
    """``id``, ``parent_id``, ``name``, ``is_dir``, ``size`` for files ``path`` and their folders; of equal paths the last ``mod_time`` wins."""
    last = files.groupBy("path").agg(F.max_by("size", "mod_time").alias("size"))
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/+")
    levels = last.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_", "full"), parts.alias("parts"), "size")
    whole = F.col("full") == F.array_join("parts", "/")
    nodes = levels.groupBy("full").agg(F.max(F.when(whole, F.col("size"))).alias("size"), F.max((~whole).cast("int")).alias("dir"))
    ids = nodes.select("full", F.xxhash64("full").alias("id"), "size", (F.col("dir") == 1).alias("is_dir"))
    parent = F.regexp_extract("full", "^(.*)/[^/]+$", 1)
    return ids.select("id", F.when(parent != "", F.xxhash64(parent)).alias("parent_id"), F.regexp_extract("full", "([^/]+)$", 1).alias("name"), "is_dir", "size", F.col("full").alias("path"))


def lookup_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``parent_id``, ``name``) with the node of that name; parents are compared null-safe, so roots are found too."""
    n = nodes.select(F.col("parent_id").alias("_p"), F.col("name").alias("_n"), "id", "is_dir", "size")
    return wanted.join(n, F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("name") == F.col("_n"))).drop("_p", "_n")


# What a codebook file's name tells of its category, first match first.
_NAMES = (("log", "text_logs"), ("sql", "text_sql"), ("code", "text_code"), ("img", "raw_image"), ("image", "raw_image"), ("bmp", "raw_image"), ("tiff", "raw_image"), ("svg", "raw_image"), ("universal", "universal"))


def brain_map(mapping: DataFrame, names: DataFrame, suffix: str = archive.CODEBOOK_SUFFIX) -> DataFrame:
    """``category``, ``brain``: a given map, and for categories it lacks the first file (by name) that tells of them."""
    low = F.lower("name")
    kind = F.coalesce(*[F.when(low.contains(part), F.lit(category)) for part, category in _NAMES])
    found = names.where(F.col("name").endswith(suffix)).select(kind.alias("category"), "name").where("category is not null").groupBy("category").agg(F.min("name").alias("brain"))
    return mapping.select("category", "brain").unionByName(found.join(mapping, "category", "left_anti").select("category", "brain"))


def read_brain_map(spark, folder: str) -> DataFrame:
    """``brain_map`` of a folder: its ``brains.json`` (category to file), if there is one, and its files."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    kind = F.from_json(F.decode("content", "UTF-8"), "map<string,string>")
    named = spark.read.format("binaryFile").load(folder).where(F.col("path").endswith("/brains.json")).select(F.explode(kind).alias("category", "brain"))
    return brain_map(named, files.select("name"))


def brain_route(files: DataFrame, routes: DataFrame) -> DataFrame:
    """Files (``name``, ``category``, ``hint``) with ``brain``: the route of their category, else of their hint,
    else the universal one, else the first of all that is not for images where the category is text."""
    by = lambda c, n: routes.select(F.col("category").alias(c), F.col("brain").alias(n))
    out = files.join(by("category", "b1"), "category", "left").join(by("hint", "b2"), "hint", "left")
    rest = routes.agg(F.max(F.when(F.col("category") == "universal", F.col("brain"))).alias("b3"), F.min(F.when(~F.col("category").contains("image"), F.col("brain"))).alias("b4"), F.min("brain").alias("b5"))
    last = F.when(F.col("category").startswith("text"), F.col("b4")).otherwise(F.col("b5"))
    return out.crossJoin(F.broadcast(rest)).withColumn("brain", F.coalesce("b1", "b2", "b3", last)).drop("b1", "b2", "b3", "b4", "b5")


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts ``le`` / ``count``, the last bound infinite."""
    cases = [F.sum((F.col(value) <= b).cast("long")) for b in bounds] + [F.count(value)]
    row = df.agg(F.array(*cases).alias("c"))
    return row.select(F.posexplode("c").alias("i", "count")).select(F.element_at(F.array(*[F.lit(str(b)) for b in [*bounds, "inf"]]), F.col("i") + 1).alias("le"), "count")
