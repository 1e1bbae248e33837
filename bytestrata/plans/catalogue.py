"""Registered queries of the byte-analytics operators, with their DuckDB SQL.

Bytes are emitted as lower-case hex, doubles rounded to six places, and every top-k has a
total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow, native
from ..operators import archives, chunking, codebook, integrity, packing, search
from ..session import ship, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def objects(spark, d, name="documents", key="doc_id", text="text", *more) -> DataFrame:
    return spread(table(spark, d, name).select(F.col(key).alias("object_id"), *more, native.as_bytes(F.col(text)).alias("content")))


def hexed(c: str, name: str | None = None):
    return F.lower(F.hex(c)).alias(name or c)


# ---- SQL building blocks ----
OBJ = "o AS (SELECT doc_id AS object_id, lang, source, encode(text) AS d FROM documents)"


def ch_sql(n: int, src: str = "o", name: str = "ch", cols: str = "object_id, lang, source") -> str:
    return f"""{name} AS (SELECT {cols}, CAST(i AS INTEGER) AS chunk_idx, CAST(i * {n} AS BIGINT) AS off, array_slice(d, i * {n} + 1, (i + 1) * {n}) AS data
  FROM (SELECT *, unnest(range((octet_length(d) + {n - 1}) // {n})) AS i FROM {src}))"""


def ent_sql(src: str, key: str, blob: str, name: str = "ent") -> str:
    return f"""{name} AS (SELECT {key}, -sum(c / n * log2(c / n)) + 0.0 AS e FROM (
    SELECT {key}, v, CAST(count(*) AS DOUBLE) AS c, CAST(any_value(n) AS DOUBLE) AS n FROM (
      SELECT {key}, substr(h, 2 * i + 1, 2) AS v, n FROM (SELECT {key}, hex({blob}) AS h, octet_length({blob}) AS n, unnest(range(octet_length({blob}))) AS i FROM {src})) GROUP BY {key}, v) GROUP BY {key})"""


def bucket_sql(b: str) -> str:
    return f"CASE WHEN octet_length({b}) < 2 THEN 0 ELSE CAST(('0x' || substr(hex({b}), 3, 2) || substr(hex({b}), 1, 2)) AS INTEGER) END"


def elite_sql(freq: str, most: int, per: int, name: str = "elite") -> str:
    return f"""{name} AS (SELECT data, count, bucket FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY count DESC, data) AS rk FROM (SELECT *, {bucket_sql("data")} AS bucket FROM {freq})) WHERE rk <= {per} ORDER BY count DESC, data LIMIT {most})"""


def book_sql(src: str = "elite", name: str = "book") -> str:
    return f"{name} AS (SELECT CAST(row_number() OVER (ORDER BY bucket, count DESC, data) - 1 AS BIGINT) AS codebook_id, data AS pattern, bucket, count FROM {src})"


def freq_sql(n: int = 128, src: str = "ch", name: str = "freq", where: str = "TRUE") -> str:
    return f"{name} AS (SELECT data, count(*) AS count FROM {src} WHERE octet_length(data) = {n} AND {where} GROUP BY data)"


HAMMING = "bit_count(xor(CAST(c.data AS BIT), CAST(b.pattern AS BIT)))"
BASE = f"WITH {OBJ}, {ch_sql(128)}, {freq_sql()}, {elite_sql('freq', 256, 4)}, {book_sql()}"


# ---- scans, chunkers ----
@query(f"WITH {OBJ}, {ch_sql(128)} SELECT object_id, chunk_idx, off AS \"offset\", CAST(octet_length(data) AS INTEGER) AS size, 0 AS block_id, lower(hex(data)) AS data FROM ch")
def chunk_fixed(spark, d):
    c = chunking.fixed(objects(spark, d))
    return c.select("object_id", "chunk_idx", "offset", "size", "block_id", hexed("data"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS i, len(string_split(html, chr(10))) AS n FROM pages),
p AS (SELECT page_id, i, encode(CASE WHEN i < n THEN line || chr(10) ELSE line END) AS b FROM l),
q AS (SELECT page_id, i, j, array_slice(b, j * 1024 + 1, (j + 1) * 1024) AS data FROM (SELECT *, unnest(range((octet_length(b) + 1023) // 1024)) AS j FROM p))
SELECT page_id AS object_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_idx, CAST(octet_length(data) AS INTEGER) AS size, sha256(data) AS sha FROM q WINDOW w AS (PARTITION BY page_id ORDER BY i, j)""")
def chunk_delimiter(spark, d):
    c = chunking.delimited(objects(spark, d, "pages", "page_id", "html"))
    return c.select("object_id", "chunk_idx", "size", F.sha2("data", 256).alias("sha"))


GEAR_SQL = "g(v, h) AS (VALUES " + ", ".join(f"({i}, {int(x) & 127})" for i, x in enumerate(arrow.gear().tolist())) + ")"


def _greedy_sql(candidates: str, least: int, most: int) -> str:
    """A recursive walk over cut candidates: the first at least ``least`` after the last cut, at most ``most`` after it."""
    return f"""WITH RECURSIVE {{lits}} o AS (SELECT doc_id AS object_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
bt AS (SELECT object_id, n, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS v FROM (SELECT *, unnest(range(n)) AS i FROM o)),
cand AS ({candidates}),
cl AS (SELECT object_id, list(e ORDER BY e) AS es FROM cand GROUP BY object_id),
walk AS (
  SELECT object_id, n, CAST(0 AS BIGINT) AS pos, coalesce(es, []) AS es FROM o LEFT JOIN cl USING (object_id)
  UNION ALL
  SELECT object_id, n, CAST(least(n, pos + {most}, coalesce(list_filter(es, lambda e: e >= pos + {least})[1], n)) AS BIGINT), list_filter(es, lambda e: e >= pos + {least}) FROM walk WHERE pos < n)
SELECT * FROM (SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY pos) - 1 AS INTEGER) AS chunk_idx,
  CAST(pos - lag(pos) OVER (PARTITION BY object_id ORDER BY pos) AS INTEGER) AS size FROM walk) WHERE size IS NOT NULL"""


ROLL = " + ".join(f"coalesce(lag(h, {k}) OVER w, 0) * {1 << k}" for k in range(6))
FASTCDC_SQL = _greedy_sql(f"SELECT object_id, i + 1 AS e FROM (SELECT object_id, i, {ROLL} AS z FROM bt JOIN g USING (v) WINDOW w AS (PARTITION BY object_id ORDER BY i)) WHERE z % 64 = 0", 16, 256).format(lits=GEAR_SQL + ",")
POLY = " + ".join(f"lag(v, {k}) OVER w * {pow(1099511628211, k, 64)}" for k in range(8))
CDC_SQL = _greedy_sql(f"SELECT object_id, i + 1 AS e FROM (SELECT object_id, i, {POLY} AS z FROM bt WINDOW w AS (PARTITION BY object_id ORDER BY i)) WHERE z % 64 = 0", 16, 128).format(lits="")


@query(FASTCDC_SQL)
def chunk_fastcdc(spark, d):
    return chunking.fastcdc(objects(spark, d), 64).select("object_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), "size")


@query(CDC_SQL)
def chunk_cdc(spark, d):
    return chunking.cdc(objects(spark, d), 64).select("object_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), "size")


@query()
def chunk_contextual(spark, d):
    c = chunking.contextual(objects(spark, d))
    return c.groupBy("object_id").agg(F.count("*").alias("chunks"), F.sum(F.col("size").cast("long")).alias("bytes"))


@query("SELECT doc_id AS object_id, sha256(encode(text)) AS sha, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE octet_length(encode(text)) > 0")
def reassemble_sha256(spark, d):
    r = chunking.reassemble(chunking.fastcdc(objects(spark, d)))
    return r.select("object_id", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("bytes"))


@query()
def cdc_shift_resistance(spark, d):
    o = objects(spark, d)
    shifted = o.withColumn("content", F.concat(F.unhex(F.lit("21")), F.col("content")))
    out = None
    for name in ("fixed", "cdc", "fastcdc"):
        a, b = (chunking.CHUNKERS[name](x, 64).select("object_id", "data").distinct() for x in (o, shifted))
        n = a.agg(F.count("*").alias("n"))
        part = a.join(b, ["object_id", "data"], "left_semi").agg(F.count("*").alias("shared")).crossJoin(n).select(F.lit(name).alias("chunker"), "shared", F.round(F.col("shared") / F.col("n"), 6).alias("ratio"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- scalar functions ----
@query(f"WITH {OBJ}, hd AS (SELECT object_id, array_slice(d, 1, 65536) AS d FROM o WHERE octet_length(d) > 0), {ent_sql('hd', 'object_id', 'd')} SELECT object_id, round(e, 6) AS entropy FROM ent")
def entropy_object(spark, d):
    o = objects(spark, d).where(F.octet_length("content") > 0)
    return o.select("object_id", F.round(arrow.shannon_entropy(F.substring("content", 1, 65536)), 6).alias("entropy"))


@query(f"WITH {OBJ}, {ch_sql(128)}, {ent_sql('ch', 'object_id, chunk_idx', 'data')} SELECT object_id, chunk_idx, round(e, 6) AS entropy FROM ent")
def entropy_chunk(spark, d):
    c = chunking.fixed(objects(spark, d))
    return c.select("object_id", "chunk_idx", F.round(arrow.shannon_entropy("data"), 6).alias("entropy"))


@query("SELECT CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS byte, count(*) AS count FROM (SELECT hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents) GROUP BY 1")
def byte_histogram(spark, d):
    o = objects(spark, d)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        n = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(n)], ["byte", "n"])

    return o.select("content").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("count")).where("count > 0")


@query(f"WITH {OBJ}, hd AS (SELECT object_id, array_slice(d, 1, 65536) AS d FROM o WHERE octet_length(d) > 0), {ent_sql('hd', 'object_id', 'd')} SELECT object_id, CASE WHEN e < 3 THEN 64 WHEN e < 6 THEN 128 ELSE 512 END AS chunk_size FROM ent")
def adaptive_chunk_size(spark, d):
    o = objects(spark, d).where(F.octet_length("content") > 0)
    return o.select("object_id", native.adaptive_chunk_size(arrow.shannon_entropy(F.substring("content", 1, 65536))).alias("chunk_size"))


@query(f"""WITH o AS (SELECT 'doc' AS kind, doc_id AS object_id, encode(text) AS d FROM documents UNION ALL SELECT 'page', page_id, encode(html) FROM pages),
hd AS (SELECT kind, object_id, array_slice(d, 1, 65536) AS d FROM o), {ent_sql('hd', 'kind, object_id', 'd')}
SELECT kind, object_id, coalesce(e, 0) < 1.0 OR coalesce(e, 0) > 7.8 OR octet_length(d) < 256 AS passthrough FROM o LEFT JOIN ent USING (kind, object_id)""")
def passthrough_route(spark, d):
    o = objects(spark, d).withColumn("kind", F.lit("doc")).unionByName(objects(spark, d, "pages", "page_id", "html").withColumn("kind", F.lit("page")))
    e = o.withColumn("head", F.substring("content", 1, 65536)).withColumn("e", arrow.shannon_entropy("head"))
    return e.select("kind", "object_id", (native.bypasses(F.col("head"), F.col("e")) | (F.col("e") < 1.0) | (F.octet_length("content") < 256)).alias("passthrough"))


@query(r"""WITH o AS (SELECT page_id AS object_id, html AS t FROM pages UNION ALL SELECT 1000000 + event_id, props FROM events),
c AS (SELECT object_id, decode(array_slice(encode(t), 1, 8192)) AS t, t AS whole FROM o)
SELECT object_id, CASE WHEN regexp_matches(whole, '^[ \t\n\r]*[\[{]') THEN CASE WHEN contains(whole, '}' || chr(10) || '{') THEN 'JSONL' ELSE 'JSON' END
  WHEN length(whole) - length(replace(whole, chr(10), '')) > 5 THEN 'LINES' ELSE 'UNKNOWN' END AS type FROM (SELECT object_id, t AS whole FROM o)""")
def content_type(spark, d):
    o = objects(spark, d, "pages", "page_id", "html").unionByName(objects(spark, d, "events", "event_id", "props").withColumn("object_id", F.col("object_id") + 1000000))
    return o.select("object_id", native.content_type(F.col("content")).alias("type"))


HEAD_SQL = "coalesce(" + ", ".join(f"try(decode(array_slice(encode(text), 1, {n})))" for n in range(8192, 8188, -1)) + ")"


@query(rf"""WITH o AS (SELECT doc_id AS object_id, {HEAD_SQL} AS t, CAST(least(8192, octet_length(encode(text))) AS DOUBLE) AS n FROM documents),
f AS (SELECT *, contains(t, '<svg') OR contains(upper(t), 'XML') AS svg,
  contains(upper(t), 'SELECT ') OR contains(upper(t), 'INSERT INTO ') OR contains(upper(t), 'CREATE TABLE ') AS sq,
  contains(t, 'func ') OR contains(t, 'class ') OR contains(t, 'def ') OR contains(t, 'package ') OR contains(t, 'import ') OR contains(t, 'function ') AS code,
  length(regexp_replace(t, '[^\x20-\x7e\n\r\t]', '', 'g')) / n > 0.85 AS plain FROM o)
SELECT object_id, CASE WHEN n = 0 THEN 'empty' WHEN svg THEN 'raw_image' WHEN sq THEN 'text_sql' WHEN code THEN 'text_code' WHEN plain THEN 'text_logs' ELSE 'binary' END AS category,
  CASE WHEN n = 0 THEN 'none' WHEN svg THEN 'svg' WHEN sq THEN 'sql' WHEN code THEN 'code' WHEN plain THEN 'text' ELSE 'unknown' END AS hint FROM f""")
def detect_category(spark, d):
    """The category of every document by its first 8 KiB."""
    o = objects(spark, d).withColumn("content", F.substring("content", 1, 8192))
    c, h, _ = native.category(F.col("content"), arrow.shannon_entropy("content"))
    return o.select("object_id", c.alias("category"), h.alias("hint"))


@query("SELECT doc_id AS object_id, sha256(encode(text)) AS sha256 FROM documents")
def sha256_objects(spark, d):
    return objects(spark, d).select("object_id", F.sha2("content", 256).alias("sha256"))


@query("""SELECT doc_id AS object_id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS fnv1a FROM (
  SELECT doc_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(octet_length(b)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS HUGEINT))), lambda h, v: (xor(h, v) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h
  FROM (SELECT doc_id, encode(text) AS b, hex(encode(text)) AS x FROM documents))""")
def fnv1a_objects(spark, d):
    return objects(spark, d).select("object_id", arrow.fnv1a_64("content").alias("fnv1a"))


@query()
def hash_suite(spark, d):
    return objects(spark, d).select("object_id", arrow.fnv1a_64("content").alias("fnv1a"), arrow.xxh64_seed0("content").alias("xxh64"), F.sha2("content", 256).alias("sha256"))


@query("SELECT p_partkey, string_agg(lpad(lower(hex(((p_partkey & 255) * x * x + ((p_partkey >> 8) & 255) * x + ((p_partkey >> 16) & 255)) % 256)), 2, '0'), '' ORDER BY x) AS bytes FROM part, range(16) t(x) GROUP BY 1")
def polynomial_generate(spark, d):
    return table(spark, d, "part").select("p_partkey", native.polynomial(F.col("p_partkey"), F.lit(16)).alias("bytes"))


@query("SELECT p_partkey, string_agg(lpad(lower(hex((((p_partkey * 7919) & 255) * x * x + (((p_partkey * 7919) >> 8) & 255) * x + (((p_partkey * 7919) >> 16) & 255)) % 256)), 2, '0'), '' ORDER BY x) AS bytes FROM part, range(16) t(x) GROUP BY 1")
def polynomial_find(spark, d):
    """The bytes that the seed found for a polynomial's bytes gives."""
    made = table(spark, d, "part").withColumn("b", F.unhex(native.polynomial(F.col("p_partkey") * 7919, F.lit(16))))
    return made.withColumn("seed", arrow.find_polynomial("b")).select("p_partkey", native.polynomial(F.col("seed"), F.lit(16)).alias("bytes"))


# ---- frequencies, codebooks ----
@query(f"WITH {OBJ}, {ch_sql(128)}, {freq_sql()} SELECT lower(hex(data)) AS data, count FROM freq WHERE count > 1")
def pattern_frequency(spark, d):
    return codebook.frequencies(chunking.fixed(objects(spark, d))).where("count > 1").select(hexed("data"), "count")


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT lang, count(*) AS chunks, count(DISTINCT data) AS unique_chunks, CAST(sum(octet_length(data)) AS BIGINT) AS bytes, round(count(DISTINCT data) / count(*), 6) AS ratio FROM ch GROUP BY lang")
def dedup_ratio(spark, d):
    c = chunking.fixed(objects(spark, d, "documents", "doc_id", "text", "lang")).groupBy("lang", "data").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    c = c.groupBy("lang").agg(F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    return c.withColumn("ratio", F.round(F.col("unique_chunks") / F.col("chunks"), 6))


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT count(DISTINCT data) AS patterns FROM ch WHERE octet_length(data) = 128")
def unique_patterns(spark, d):
    return codebook.frequencies(chunking.fixed(objects(spark, d))).agg(F.count("*").alias("patterns"))


def _book(spark, d, where=None, most=256, per=4, n=128):
    o = objects(spark, d, "documents", "doc_id", "text", "lang", "source")
    return search.kept(codebook.train(chunking.fixed(o if where is None else o.where(where), n), n, most, per))


@query(f"{BASE} SELECT codebook_id, lower(hex(pattern)) AS pattern, bucket, count FROM book")
def codebook_layout(spark, d):
    return _book(spark, d).select("codebook_id", hexed("pattern"), "bucket", "count")


@query(f"WITH {OBJ}, {ch_sql(128)}, {freq_sql()}, {elite_sql('freq', 500, 2)} SELECT lower(hex(data)) AS data, count, bucket FROM elite")
def train_elite(spark, d):
    return codebook.elite(codebook.frequencies(chunking.fixed(objects(spark, d))), 500, 2).select(hexed("data"), "count", "bucket")


_TWO = f"WITH {OBJ}, {ch_sql(128)}, {freq_sql(name='fen', where=chr(34) + 'lang' + chr(34) + " = 'en'")}, {elite_sql('fen', 200, 4, 'een')}, {freq_sql(name='fde', where=chr(34) + 'lang' + chr(34) + " = 'de'")}"


@query(f"{_TWO}, al AS (SELECT data, CAST(sum(count) AS BIGINT) AS count FROM (SELECT * FROM fde UNION ALL SELECT data, 100 FROM een) GROUP BY data), {elite_sql('al', 300, 4)} SELECT lower(hex(data)) AS data, count, bucket FROM elite")
def train_incremental(spark, d):
    o = objects(spark, d, "documents", "doc_id", "text", "lang")
    old = _book(spark, d, "lang = 'en'", 200)
    new = codebook.frequencies(chunking.fixed(o.where("lang = 'de'")))
    return codebook.elite(codebook.incremental(new, old), 300, 4).select(hexed("data"), "count", "bucket")


@query(f"""{_TWO}, {elite_sql('fde', 300, 4, 'ede')}, {book_sql('een', 'b')},
al AS (SELECT pattern AS data, 0 AS source, codebook_id AS r, CAST(0 AS BIGINT) AS count FROM b UNION ALL SELECT data, 1, -count, count FROM ede WHERE data NOT IN (SELECT pattern FROM b))
SELECT lower(hex(data)) AS data, source, count FROM (SELECT * FROM al ORDER BY source, r, data LIMIT 300)""")
def train_transfer(spark, d):
    o = objects(spark, d, "documents", "doc_id", "text", "lang")
    new = codebook.frequencies(chunking.fixed(o.where("lang = 'de'")))
    return codebook.transfer(_book(spark, d, "lang = 'en'", 200), new, 300, 4).select(hexed("data"), "source", "count")


@query(f"""WITH {OBJ}, {ch_sql(128)}, {freq_sql()}, top AS (SELECT lower(hex(data)) AS h, count FROM freq WHERE count > 1 ORDER BY count DESC, data LIMIT 100),
v AS (SELECT unnest([substr(h, 3) || '00', '00' || substr(h, 1, length(h) - 2), substr(h, 3) || substr(h, 1, 2)]) AS h, count // 2 AS count FROM top),
al AS (SELECT lower(hex(data)) AS h, count FROM freq UNION ALL SELECT * FROM v)
SELECT h AS data, CAST(sum(count) AS BIGINT) AS count FROM al GROUP BY h HAVING sum(count) > 1""")
def augment_patterns(spark, d):
    t = codebook.frequencies(chunking.fixed(objects(spark, d)))
    return codebook.augment(t, 100).where("count > 1").select(hexed("data"), "count")


@query("""SELECT CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS a, CAST('0x' || substr(h, 2 * i + 3, 2) AS INTEGER) AS b, count(*) AS count
FROM (SELECT hex(encode(text)) AS h, unnest(range(octet_length(encode(text)) - 1)) AS i FROM conversations) GROUP BY 1, 2""")
def bpe_pair_counts(spark, d):
    return codebook.pair_counts(objects(spark, d, "conversations", "conv_id"))


@query()
def bpe_vocab(spark, d):
    rows = codebook.bpe(objects(spark, d), 320)
    return spark.createDataFrame([(i, b.hex(), n) for i, b, n in rows], "token_id int, bytes string, freq long")


# ---- matching ----
@query(f"{BASE}, c AS (SELECT DISTINCT data FROM ch WHERE octet_length(data) = 128), m AS (SELECT c.data, b.codebook_id, {HAMMING} AS distance FROM c, book b) SELECT lower(hex(data)) AS data, min(distance) AS distance, arg_min(codebook_id, distance * 1000 + codebook_id) AS codebook_id FROM m GROUP BY data".replace("min(distance) AS distance", "CAST(min(distance) AS BIGINT) AS distance"))
def match_linear(spark, d):
    c = chunking.fixed(objects(spark, d)).where("size = 128").select("data").distinct()
    return search.nearest_codeword(c, _book(spark, d), "linear").select(hexed("data"), "match.distance", "match.codebook_id")


LSH = f"""c AS (SELECT data, {bucket_sql('data')} AS bucket FROM (SELECT DISTINCT data FROM ch WHERE octet_length(data) = 128)),
m AS (SELECT c.data, b.codebook_id, {HAMMING} AS distance FROM c JOIN book b ON b.bucket = c.bucket UNION ALL SELECT c.data, b.codebook_id, {HAMMING} FROM c, book b WHERE c.bucket NOT IN (SELECT bucket FROM book)),
nn AS (SELECT data, CAST(min(distance) AS BIGINT) AS distance, arg_min(codebook_id, distance * 1000 + codebook_id) AS codebook_id FROM m GROUP BY data)"""


@query(f"{BASE}, {LSH} SELECT lower(hex(data)) AS data, distance, codebook_id, round(greatest(0, 1 - distance / 1024), 6) AS similarity FROM nn")
def match_lsh(spark, d):
    c = chunking.fixed(objects(spark, d)).where("size = 128").select("data").distinct()
    out = search.nearest_codeword(c, _book(spark, d)).select("data", "match.distance", "match.codebook_id")
    return out.select(hexed("data"), "distance", "codebook_id", F.round(native.similarity(F.col("distance"), F.octet_length("data")), 6).alias("similarity"))


@query(f"""WITH {OBJ}, {ch_sql(128)}, {freq_sql(name='f0', where="lang = 'en'")}, {elite_sql('f0', 100, 4, 'e0')}, {book_sql('e0', 'b0')}, {freq_sql(name='f1', where="lang = 'de'")}, {elite_sql('f1', 100, 4, 'e1')}, {book_sql('e1', 'b1')},
c AS (SELECT DISTINCT data FROM ch WHERE octet_length(data) = 128),
m0 AS (SELECT c.data, min({HAMMING}) AS distance FROM c, b0 b GROUP BY c.data), m1 AS (SELECT c.data, min({HAMMING}) AS distance FROM c, b1 b GROUP BY c.data)
SELECT lower(hex(data)) AS data, CASE WHEN m0.distance <= 512 OR m0.distance <= m1.distance THEN 0 ELSE 1 END AS codebook_index,
  CAST(CASE WHEN m0.distance <= 512 THEN m0.distance ELSE least(m0.distance, m1.distance) END AS BIGINT) AS distance FROM m0 JOIN m1 USING (data)""")
def match_tiered(spark, d):
    c = chunking.fixed(objects(spark, d)).where("size = 128").select("data").distinct()
    books = [_book(spark, d, "lang = 'en'", 100), _book(spark, d, "lang = 'de'", 100)]
    return search.nearest_codeword(c, books, "linear").select(hexed("data"), "match.codebook_index", "match.distance")


FAR = "bit_count(xor(CAST(array_slice(c.data, 1, 128) AS BIT), CAST(array_slice(b.pattern, 1, octet_length(c.data)) AS BIT))) + 8 * (128 - octet_length(c.data))"


def nearest_sql(book: str, name: str) -> str:
    return f"""{name} AS (SELECT data, n, CAST(min(distance) AS BIGINT) AS distance, arg_min(codebook_id, distance * 10000 + codebook_id) AS codebook_id
  FROM (SELECT c.data, c.n, b.codebook_id, {FAR} AS distance FROM c JOIN {book} b ON b.bucket = c.bucket OR c.bucket NOT IN (SELECT bucket FROM {book})) GROUP BY data, n)"""


@query(f"""WITH {OBJ}, {ch_sql(128)}, {freq_sql()}, {elite_sql('freq', 600, 8)}, {book_sql()}, c AS (SELECT data, count(*) AS n, {bucket_sql('data')} AS bucket FROM ch GROUP BY data), {nearest_sql('book', 'p1')},
used AS (SELECT codebook_id, sum(n) AS used FROM p1 GROUP BY codebook_id ORDER BY used DESC, codebook_id LIMIT 256), again AS (SELECT * FROM book WHERE codebook_id IN (SELECT codebook_id FROM used)), {nearest_sql('again', 'p2')}
SELECT lower(hex(data)) AS data, n, codebook_id, distance FROM p2""")
def match_multipass(spark, d):
    """Use counted over all chunks, the book restricted to its top 256, all chunks matched again."""
    c = chunking.fixed(objects(spark, d)).groupBy("data").agg(F.count("*").alias("n"))
    book = _book(spark, d, most=600, per=8)
    used = search.most_used(search.nearest_codeword(c, book), 256, "n")
    again = search.nearest_codeword(c, search.kept(search.restrict(book, used)))
    return again.select(hexed("data"), "n", "match.codebook_id", "match.distance")


def _chunk_pairs(spark, d):
    """Every chunk ``c`` of a document with that of the same place in the next document, ``e``; empty where that has none."""
    c = chunking.fixed(objects(spark, d)).select("object_id", "chunk_idx", F.col("data").alias("c"))
    e = c.select((F.col("object_id") - 1).alias("object_id"), "chunk_idx", F.col("c").alias("e"))
    return c.join(e, ["object_id", "chunk_idx"], "left").withColumn("e", F.coalesce("e", F.unhex(F.lit(""))))


PAIRS = f"WITH {OBJ}, {ch_sql(128)}, p AS (SELECT x.object_id, x.chunk_idx, x.data AS c, y.data AS e FROM ch x JOIN ch y ON y.object_id = x.object_id + 1 AND y.chunk_idx = x.chunk_idx WHERE octet_length(x.data) = octet_length(y.data))"


@query(f"{PAIRS} SELECT object_id AS a, object_id + 1 AS b, chunk_idx, CAST(bit_count(xor(CAST(c AS BIT), CAST(e AS BIT))) AS BIGINT) AS distance FROM p")
def hamming_pairs(spark, d):
    p = _chunk_pairs(spark, d).where(F.octet_length("c") == F.octet_length("e"))
    return p.select(F.col("object_id").alias("a"), (F.col("object_id") + 1).alias("b"), "chunk_idx", arrow.hamming_bits("c", "e").alias("distance"))


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT object_id, chunk_idx, sha256(data) AS sha FROM ch")
def patch_roundtrip(spark, d):
    """The hash of each chunk as its edit script against the next document's chunk gives it back."""
    x = _chunk_pairs(spark, d).withColumn("s", arrow.diff_bytes("c", "e"))
    return x.select("object_id", "chunk_idx", F.sha2(arrow.patch_bytes("e", "s"), 256).alias("sha"))


@query(f"""{PAIRS}, q AS (SELECT object_id, chunk_idx, hex(c) AS c, hex(e) AS e, octet_length(c) AS n FROM p)
SELECT object_id, chunk_idx, list_aggregate(list_transform(range(n), lambda i: printf('%02x', xor(CAST('0x' || substr(c, 2 * i + 1, 2) AS INTEGER), CAST('0x' || substr(e, 2 * i + 1, 2) AS INTEGER)))), 'string_agg', '') AS x FROM q""")
def xor_residual(spark, d):
    p = _chunk_pairs(spark, d).where(F.octet_length("c") == F.octet_length("e"))
    return p.select("object_id", "chunk_idx", F.lower(F.hex(arrow.xor_bytes("c", "e"))).alias("x"))


# ---- routing, residuals, decoding ----
def _entries(spark, d, options=packing.PackOptions(), where=None, n=None, most=256, per=4):
    n = n or options.chunk_size
    o = objects(spark, d, "documents", "doc_id", "text", "lang", "source")
    return packing.route(chunking.fixed(o if where is None else o.where(where), n), _book(spark, d, most=most, per=per, n=n), options)


#: Only noise is a literal. The archive's own cut of 3 bits is below the entropy of almost every 128 bytes of text,
#: so 97 of 100 chunks would pass by the codebook.
MATCH_ALL = packing.PackOptions(literal_entropy=packing.PackOptions.stream_entropy)


@query()
def route_archive(spark, d):
    """Metrics of archive mode with a codebook of full size, every chunk but noise routed by its codeword: as a patch or as XOR."""
    return packing.metrics(_entries(spark, d, MATCH_ALL, most=8192, per=64), "lang")


@query()
def route_archive_small_chunks(spark, d):
    return packing.metrics(_entries(spark, d, packing.PackOptions(chunk_size=8)), "lang")


STREAM = f"""{BASE}, c AS (SELECT data, {bucket_sql('data')} AS bucket FROM (SELECT DISTINCT data FROM ch)),
dist AS (SELECT c.data, b.codebook_id, bit_count(xor(CAST(c.data AS BIT), CAST(array_slice(b.pattern, 1, octet_length(c.data)) AS BIT))) + 8 * (128 - octet_length(c.data)) AS distance FROM c JOIN book b ON b.bucket = c.bucket OR c.bucket NOT IN (SELECT bucket FROM book)),
nn AS (SELECT data, min(distance) AS distance FROM dist GROUP BY data)"""


@query(f"""{STREAM}, s AS (SELECT lang, octet_length(ch.data) AS size, greatest(0, 1 - distance / (octet_length(ch.data) * 8)) AS similarity FROM ch JOIN nn ON nn.data = ch.data)
SELECT lang, count(*) AS chunks, CAST(0 AS BIGINT) AS literals, count(*) AS xors, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS residual_bytes, round(avg(similarity), 6) AS avg_similarity,
  round(avg(CAST(similarity >= 0.5 AS DOUBLE)), 6) AS hit_rate_ge50, round(avg(CAST(similarity >= 0.95 AS DOUBLE)), 6) AS hit_rate_ge95 FROM s GROUP BY lang""")
def route_stream(spark, d):
    m = packing.metrics(_entries(spark, d, packing.PackOptions(mode="stream")), "lang")
    return m.select("lang", "chunks", "literals", "xors", "bytes", "residual_bytes", "avg_similarity", "hit_rate_ge50", "hit_rate_ge95")


# Every distinct chunk with its entropy, nearest codeword, similarity, signature and polynomial, by plain SQL.
_V = "TRY_CAST('0x' || substr(hex(data), 2 * {} + 1, 2) AS INTEGER)"
_MAGIC_SQL = " OR ".join(f"starts_with(hex(data), '{m}')" for m in native.COMPRESSED_MAGIC) + " OR (starts_with(hex(data), '52494646') AND substr(hex(data), 17, 8) = '57454250')"
ROUTED = f"""{BASE}, c AS (SELECT data, {bucket_sql('data')} AS bucket FROM (SELECT DISTINCT data FROM ch)), {ent_sql('c', 'data', 'data')},
dist AS (SELECT c.data, b.codebook_id, {{far}} AS distance FROM c JOIN book b ON b.bucket = c.bucket OR c.bucket NOT IN (SELECT bucket FROM book)),
nn AS (SELECT data, CAST(min(distance) AS BIGINT) AS distance, arg_min(codebook_id, distance * 1000 + codebook_id) AS codebook_id FROM dist GROUP BY data),
v AS (SELECT data, octet_length(data) AS n, {_V.format(0)} AS c0, {_V.format(1)} AS v1, {_V.format(2)} AS v2 FROM ent WHERE e <= 3.0),
ab AS (SELECT *, CASE WHEN n > 2 THEN (v2 - 2 * v1 + c0 + 512) % 256 ELSE 0 END AS twice FROM v),
ac AS (SELECT *, twice // 2 AS a, CASE WHEN n > 1 THEN (v1 - c0 - twice // 2 + 512) % 256 ELSE 0 END AS b FROM ab WHERE twice % 2 = 0),
poly AS (SELECT data FROM (SELECT data, n, unnest(range(n)) AS x, a, b, c0 FROM ac) GROUP BY data HAVING bool_and((a * x * x + b * x + c0) % 256 = {_V.format('x')})),
k AS (SELECT nn.*, e, octet_length(data) AS n, greatest(0, 1 - distance / (octet_length(data) * 8)) AS s, data IN (SELECT data FROM poly) AS f,
  (octet_length(data) > 4 AND ({_MAGIC_SQL})) OR e > 7.8 AS noisy FROM nn JOIN ent USING (data))""".format(far=FAR)


def kinds_sql(mode: str) -> str:
    """SQL: table ``r``, each chunk of a document with its encoding, similarity and residual's size."""
    literal = "FALSE" if mode == "edge" else "e > 3.0 OR noisy OR s < 0.2"
    fractal = "FALSE" if mode == "bytes" else "f"
    return f"""{ROUTED}, w AS (SELECT *, CASE WHEN {fractal} THEN 'fractal' WHEN {literal} THEN 'literal' ELSE 'xor' END AS encoding FROM k),
r AS (SELECT ch.*, n, encoding, codebook_id, distance, CASE encoding WHEN 'fractal' THEN 1.0 WHEN 'literal' THEN 0.0 ELSE s END AS similarity,
  CASE WHEN encoding = 'literal' OR (encoding = 'xor' AND '{mode}' <> 'edge') THEN n ELSE 0 END AS residual FROM ch JOIN w USING (data))"""


def metrics_sql(mode: str, by: str) -> str:
    kind = lambda k: f"count(*) FILTER (encoding = '{k}') AS {k}s"
    return f"""{kinds_sql(mode)} SELECT {by}, count(*) AS chunks, {kind('literal')}, {kind('fractal')}, {kind('xor')}, CAST(0 AS BIGINT) AS patches, CAST(sum(n) AS BIGINT) AS bytes,
  CAST(sum(residual) AS BIGINT) AS residual_bytes, round(avg(similarity), 6) AS avg_similarity, round(avg(CAST(encoding = 'xor' AND similarity >= 0.5 AS DOUBLE)), 6) AS hit_rate_ge50,
  round(avg(CAST(encoding = 'xor' AND similarity >= 0.95 AS DOUBLE)), 6) AS hit_rate_ge95 FROM r GROUP BY {by}"""


@query(f"""{kinds_sql('archive')} SELECT object_id, chunk_idx, CASE encoding WHEN 'xor' THEN 'matched' ELSE encoding END AS route, CASE encoding WHEN 'xor' THEN codebook_id ELSE -1 END AS codebook_id, round(similarity, 6) AS similarity FROM r""")
def route_archive_kinds(spark, d):
    """The route of every chunk in archive mode; whether a match is stored as a patch or as XOR is left open."""
    e = _entries(spark, d)
    matched = F.col("encoding").isin("xor", "patch")
    return e.select("object_id", "chunk_idx", F.when(matched, "matched").otherwise(F.col("encoding")).alias("route"), F.when(matched, F.col("codebook_id")).otherwise(F.lit(-1).cast("long")).alias("codebook_id"), F.round("similarity", 6).alias("similarity"))


@query(metrics_sql("edge", "lang"))
def route_edge(spark, d):
    return packing.metrics(_entries(spark, d, packing.PackOptions(mode="edge")), "lang")


@query(metrics_sql("bytes", "lang"))
def route_bytes(spark, d):
    return packing.metrics(_entries(spark, d, packing.PackOptions(mode="bytes")), "lang")


@query(metrics_sql("bytes", "source"))
def pack_metrics(spark, d):
    return packing.metrics(_entries(spark, d, packing.PackOptions(mode="bytes")), "source")


@query(f"{kinds_sql('edge')} SELECT lang, count(*) AS chunks, round(avg(CASE WHEN encoding = 'xor' THEN distance - 8 * (128 - n) ELSE 0 END), 6) AS bits_wrong FROM r GROUP BY lang")
def edge_distortion(spark, d):
    o, book = packing.PackOptions(mode="edge"), _book(spark, d)
    e = packing.decode(packing.route(chunking.fixed(objects(spark, d, "documents", "doc_id", "text", "lang")), book, o), book)
    return e.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg(arrow.hamming_bits("data", "decoded")), 6).alias("bits_wrong"))


@query("SELECT doc_id AS object_id, sha256(encode(text)) AS sha, TRUE AS same FROM documents WHERE octet_length(encode(text)) > 0")
def unpack_roundtrip(spark, d):
    book = _book(spark, d, n=8)
    e = packing.decode(packing.route(chunking.fixed(objects(spark, d), 8), book, packing.PackOptions(chunk_size=8, literal_entropy=3.5)), book)
    back = chunking.reassemble(e.select("object_id", "chunk_idx", F.col("decoded").alias("data")))
    o = objects(spark, d).select("object_id", F.sha2("content", 256).alias("want"))
    return back.select("object_id", F.sha2("content", 256).alias("sha")).join(o, "object_id").select("object_id", "sha", (F.col("sha") == F.col("want")).alias("same"))


@query("SELECT doc_id AS object_id, CAST(octet_length(encode(text)) AS INTEGER) AS size, sha256(encode(text)) AS sha, TRUE AS same FROM documents WHERE octet_length(encode(text)) > 0")
def verify_integrity(spark, d):
    book = _book(spark, d)
    e = packing.decode(packing.route(chunking.fixed(objects(spark, d)), book, packing.PackOptions(mode="stream")), book)
    back = chunking.reassemble(e.select("object_id", "chunk_idx", F.col("decoded").alias("data")))
    o = objects(spark, d).withColumnRenamed("content", "want")
    return back.join(o, "object_id").select("object_id", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha"), (F.sha2("content", 256) == F.sha2("want", 256)).alias("same"))


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT object_id, chunk_idx, CAST(octet_length(data) AS INTEGER) AS delta_size, CAST(sum(octet_length(data)) OVER (PARTITION BY object_id ORDER BY chunk_idx) - octet_length(data) AS BIGINT) AS delta_offset FROM ch")
def delta_offsets(spark, d):
    e = _entries(spark, d, packing.PackOptions(mode="stream"))
    return packing.offsets(e).select("object_id", "chunk_idx", "delta_size", "delta_offset")


@query("SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total, CAST(sum(octet_length(encode(text))) // count(*) AS BIGINT) AS mean, CAST(min(octet_length(encode(text))) AS BIGINT) AS least, CAST(max(octet_length(encode(text))) AS BIGINT) AS most FROM documents GROUP BY source")
def block_stats(spark, d):
    o = objects(spark, d, "documents", "doc_id", "text", "source").withColumn("n", F.octet_length("content").cast("long"))
    return o.groupBy("source").agg(F.sum("n").alias("total"), F.expr("sum(n) div count(*)").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"{BASE}, {LSH}, u AS (SELECT codebook_id, count(*) AS used FROM ch JOIN nn USING (data) GROUP BY 1) SELECT codebook_id, used, round(100.0 * used / (SELECT sum(used) FROM u), 6) AS percent FROM u ORDER BY used DESC, codebook_id LIMIT 10")
def codeword_top10(spark, d):
    c = chunking.fixed(objects(spark, d)).where("size = 128").groupBy("data").agg(F.count("*").alias("n"))
    u = search.nearest_codeword(c, _book(spark, d)).groupBy(F.col("match.codebook_id").alias("codebook_id")).agg(F.sum("n").alias("used"))
    return u.crossJoin(F.broadcast(u.agg(F.sum("used").alias("all")))).select("codebook_id", "used", F.round(100.0 * F.col("used") / F.col("all"), 6).alias("percent")).orderBy(F.desc("used"), "codebook_id").limit(10)


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT lower(hex(data)) AS data, count(*) AS count FROM ch GROUP BY data ORDER BY count DESC, data LIMIT 10")
def literal_fingerprint(spark, d):
    return chunking.fixed(objects(spark, d)).groupBy("data").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "data").limit(10).select(hexed("data"), "count")


@query(f"{kinds_sql('bytes')} SELECT encoding, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS bytes, CAST(sum(residual) AS BIGINT) AS residual, count(DISTINCT CASE WHEN encoding = 'xor' THEN codebook_id END) AS codewords FROM r GROUP BY encoding")
def archive_info(spark, d):
    e = _entries(spark, d, packing.PackOptions(mode="bytes"))
    return e.groupBy("encoding").agg(F.count("*").alias("chunks"), F.sum(F.col("size").cast("long")).alias("bytes"), F.sum(F.col("delta_size").cast("long")).alias("residual"), F.countDistinct("codebook_id").alias("codewords"))


def _packed(spark, d, mode="archive"):
    book = _book(spark, d)
    return archives.pack(objects(spark, d), book, packing.PackOptions(mode=mode)), book


@query()
def pack_summary(spark, d):
    return _packed(spark, d)[0].select("object_id", "passthrough", "original", "packed")


@query("SELECT doc_id AS object_id, sha256(encode(text)) AS sha FROM documents")
def archive_roundtrip(spark, d):
    """Every document packed into an archive of its own, read from its bytes and unpacked."""
    packed, book = _packed(spark, d, "stream")
    return archives.unpack(packed, book).select("object_id", F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id AS object_id, 7 AS version, CAST(octet_length(encode(text)) AS BIGINT) AS original_size, sha256(encode(text)) AS original_hash FROM documents")
def archive_headers(spark, d):
    return archives.metadata(_packed(spark, d)[0]).select("object_id", "version", "original_size", F.lower(F.hex("original_hash")).alias("original_hash"))


@query()
def pool_entropy(spark, d):
    return archives.pool_entropy(_packed(spark, d, "stream")[0])


@query()
def block_offsets(spark, d):
    return archives.block_offsets(_packed(spark, d, "stream")[0])


@query(f"{BASE} SELECT codebook_id, lower(hex(pattern)) AS pattern, bucket, sha256(unhex((SELECT string_agg(hex(pattern), '' ORDER BY codebook_id) FROM book))) AS build_hash FROM book")
def codebook_file(spark, d):
    """A codebook as a file's bytes and read again."""
    return archives.codebook_of(spark, archives.codebook_bytes(_book(spark, d))).select("codebook_id", hexed("pattern"), "bucket", "build_hash")


@query(f"{_TWO}, {book_sql('een', 'b')} SELECT count(*) FILTER (pattern IN (SELECT data FROM fde)) AS present, count(*) AS patterns FROM b")
def codebook_overlap(spark, d):
    o = objects(spark, d, "documents", "doc_id", "text", "lang")
    return codebook.overlap(_book(spark, d, "lang = 'en'", 200), codebook.frequencies(chunking.fixed(o.where("lang = 'de'"))))


@query(f"{BASE} SELECT CAST(sum(octet_length(data)) AS BIGINT) AS bytes, count(*) AS chunks, count(*) FILTER (octet_length(data) = 128) AS full_chunks, count(DISTINCT data) FILTER (octet_length(data) = 128) AS unique_patterns, (SELECT count(*) FROM book) AS codewords FROM ch")
def train_counters(spark, d):
    return codebook.counters(chunking.fixed(objects(spark, d)), _book(spark, d))


@query()
def autopack_summary(spark, d):
    o = objects(spark, d)
    tokens = [(i, b.ljust(16, b"\0")[:16]) for i, b, n in codebook.bpe(o, 400, 16) if len(b) > 2]
    book = spark.createDataFrame(tokens or [(0, b"\0" * 16)], "codebook_id long, pattern binary")
    return packing.metrics(packing.route(chunking.fixed(o, 16), book, packing.PackOptions(mode="stream", chunk_size=16)))


@query()
def variational_decode(spark, d):
    book = _book(spark, d)
    e = packing.decode(_entries(spark, d, packing.PackOptions(mode="edge")), book, jitter=2, seed=7)
    return e.groupBy("encoding").agg(F.count("*").alias("chunks"), F.sum((F.col("decoded") == F.col("data")).cast("long")).alias("same"))


@query()
def codebook_acceptance(spark, d):
    """Sources whose documents the codebook packs to at most 0.95 of their size."""
    packed, _ = _packed(spark, d)
    r = packed.join(table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), "source"), "object_id").groupBy("source").agg((F.sum("packed") / F.sum("original")).alias("ratio"))
    return r.select("source", F.round("ratio", 6).alias("ratio"), (F.col("ratio") <= 0.95).alias("accepted"))


# ---- reads, integrity, sync, search ----
@query("SELECT doc_id AS object_id, lower(hex(array_slice(encode(text), 301, 1000))) AS bytes FROM documents WHERE octet_length(encode(text)) > 300")
def range_read(spark, d):
    return integrity.read_range(chunking.fastcdc(objects(spark, d)), 300, 700).select("object_id", hexed("content", "bytes"))


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT object_id, chunk_idx, chunk_idx % 7 = 3 AS corrupt, CASE WHEN chunk_idx % 7 = 3 THEN repeat('00', octet_length(data)) ELSE lower(hex(data)) END AS data FROM ch")
def corrupt_tolerant(spark, d):
    c = chunking.fixed(objects(spark, d)).withColumn("decoded", F.when(F.col("chunk_idx") % 7 != 3, F.col("data")))
    return integrity.tolerant(c).select("object_id", "chunk_idx", "corrupt", hexed("decoded", "data"))


def _leaves(spark, d):
    from pyspark.sql import Window

    o = objects(spark, d, "documents", "doc_id", "text", "source")
    return o.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("object_id")) - 1).cast("long").alias("pos"), F.sha2("content", 256).alias("hash"))


@query("""WITH RECURSIVE l AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, sha256(encode(text)) AS hash, count(*) OVER (PARTITION BY source) AS n, 0 AS lv FROM documents),
t AS (SELECT source, pos, hash, n, lv FROM l UNION ALL
  SELECT source, pos, hash, (n + 1) // 2, lv + 1 FROM (
    SELECT source, pos // 2 AS pos, n, lv, sha256(unhex(hash) || unhex(coalesce(lead(hash) OVER (PARTITION BY source, lv ORDER BY pos), hash))) AS hash, pos % 2 AS odd FROM t WHERE n > 1 OR lv = 0) WHERE odd = 0)
SELECT source, hash AS root FROM t WHERE n = 1 AND lv > 0""")
def merkle_root(spark, d):
    return integrity.merkle_root(_leaves(spark, d), "source")


@query("SELECT CAST(doc_id AS BIGINT) AS pos FROM documents WHERE doc_id % 17 = 5")
def merkle_diff(spark, d):
    a = objects(spark, d).select(F.col("object_id").alias("pos"), F.sha2("content", 256).alias("hash"))
    b = a.withColumn("hash", F.when(F.col("pos") % 17 == 5, F.lit("other")).otherwise(F.col("hash")))
    return integrity.merkle_diff(a, b)


MAN = f"WITH {OBJ}, {ch_sql(128)}, man AS (SELECT object_id, chunk_idx, sha256(data) AS delta_hash, CAST(octet_length(data) AS INTEGER) AS chunk_size, source FROM ch)"


def _manifest(spark, d):
    c = chunking.fixed(objects(spark, d, "documents", "doc_id", "text", "source"))
    c = c.withColumn("codebook_id", F.lit(None).cast("long")).withColumn("residual", F.col("data"))
    return integrity.manifest(c, "source", F.col("data").alias("payload")).drop("codebook_id")


@query(f"{MAN}, a AS (SELECT * FROM man WHERE object_id % 3 <> 0), b AS (SELECT * FROM man WHERE object_id % 3 <> 1) SELECT object_id, chunk_idx, delta_hash, 'missing' AS side FROM b WHERE delta_hash NOT IN (SELECT delta_hash FROM a) UNION ALL SELECT object_id, chunk_idx, delta_hash, 'extra' FROM a WHERE delta_hash NOT IN (SELECT delta_hash FROM b)")
def manifest_diff(spark, d):
    m = _manifest(spark, d).select("object_id", "chunk_idx", "delta_hash")
    return integrity.manifest_diff(m.where("object_id % 3 <> 0"), m.where("object_id % 3 <> 1"), "delta_hash")


def _hashed(spark, d):
    """Manifest entries of documents in stream mode, where residuals are as long as their chunks."""
    return integrity.manifest(_entries(spark, d, packing.PackOptions(mode="stream")))


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT object_id, chunk_idx, CAST(octet_length(data) AS INTEGER) AS chunk_size FROM ch")
def manifest_json(spark, d):
    """Manifests as JSON and read again."""
    return integrity.manifest_from_json(integrity.manifest_json(_hashed(spark, d))).select("object_id", "chunk_idx", "chunk_size")


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT object_id, CAST(octet_length(d) AS BIGINT) AS original_size, chunk_idx, CAST(octet_length(data) AS INTEGER) AS chunk_size, CAST(('0x' || substr(sha256(data), 1, 15)) AS BIGINT) AS delta_hash FROM ch JOIN o USING (object_id)")
def manifest_binary(spark, d):
    """Binary manifests of chunk hashes and read again."""
    m = _manifest(spark, d).select("object_id", "chunk_idx", F.lit(-1).cast("long").alias("codebook_id"), F.conv(F.substring("delta_hash", 1, 15), 16, 10).cast("long").alias("delta_hash"), "chunk_size")
    return integrity.manifest_from_binary(integrity.manifest_binary(m, objects(spark, d))).drop("codebook_id")


@query(f"{MAN}, a AS (SELECT * FROM man WHERE object_id % 3 <> 0) SELECT object_id, chunk_idx FROM man WHERE object_id % 3 = 0 AND delta_hash NOT IN (SELECT delta_hash FROM a)")
def manifest_missing_idx(spark, d):
    m = _manifest(spark, d)
    return integrity.manifest_diff(m.where("object_id % 3 <> 0"), m.where("object_id % 3 = 0"), "delta_hash").where("side = 'missing'").select("object_id", "chunk_idx")


@query(f"{MAN} SELECT object_id, chunk_idx, CASE WHEN delta_hash IN (SELECT delta_hash FROM man WHERE object_id % 3 = 0) THEN 'peer' WHEN delta_hash IN (SELECT delta_hash FROM man WHERE object_id % 3 = 1) THEN 'local' ELSE 'none' END AS origin FROM man")
def chunk_receive(spark, d):
    m = _manifest(spark, d)
    return integrity.received(m.drop("payload"), m.where("object_id % 3 = 0"), m.where("object_id % 3 = 1"), "delta_hash").select("object_id", "chunk_idx", "origin")


@query(f"{BASE}, {LSH} SELECT object_id, chunk_idx FROM ch JOIN nn USING (data) JOIN book USING (codebook_id) WHERE contains(hex(pattern), hex(encode('tion'))) AND position(hex(encode('tion')) IN hex(pattern)) % 2 = 1".replace("contains(hex(pattern), hex(encode('tion'))) AND position(hex(encode('tion')) IN hex(pattern)) % 2 = 1", "regexp_matches(hex(pattern), '^(..)*74696F6E')"))
def grep_semantic(spark, d):
    e = packing.route(chunking.fixed(objects(spark, d)).where("size = 128"), b := _book(spark, d), packing.PackOptions(mode="stream"))
    return integrity.grep_codewords(e, b, b"tion").select("object_id", "chunk_idx")


@query(f"""{BASE}, c AS (SELECT data, count(*) AS n, {bucket_sql('data')} AS bucket FROM ch GROUP BY data), {nearest_sql('book', 'p1')},
h AS (SELECT object_id, chunk_idx, off AS "offset", data, row_number() OVER (ORDER BY object_id, chunk_idx) AS rk FROM ch JOIN p1 USING (data) JOIN book USING (codebook_id) WHERE regexp_matches(hex(pattern), '^(..)*74696F6E'))
SELECT object_id, chunk_idx, "offset", CASE WHEN rk <= 20 THEN list_aggregate(list_transform(range(octet_length(data)), lambda i: CASE WHEN substr(hex(data), 2 * i + 1, 2) = '0A' THEN '20' ELSE lower(substr(hex(data), 2 * i + 1, 2)) END), 'string_agg', '') END AS shown FROM h""")
def grep_hits(spark, d):
    """Chunks whose codeword has the needle, their offsets, and the first 20 decoded on one line."""
    book = _book(spark, d)
    e = packing.route(chunking.fixed(objects(spark, d)), book, packing.PackOptions(mode="stream"))
    return integrity.grep_hits(e, book, b"tion").withColumn("shown", F.lower(F.hex(F.encode("shown", "ISO-8859-1"))))


@query("SELECT doc_id AS object_id FROM documents WHERE contains(text, 'thing')")
def grep_exact(spark, d):
    return integrity.grep_exact(objects(spark, d), b"thing").select("object_id")


# ---- routing tables, paths, trust ----
@query("""WITH f AS (SELECT doc_id AS name, CASE doc_id % 4 WHEN 0 THEN 'text_sql' WHEN 1 THEN 'text_logs' WHEN 2 THEN 'raw_image' ELSE 'binary' END AS category, CASE WHEN doc_id % 5 = 0 THEN 'png' ELSE 'none' END AS hint FROM documents)
SELECT name, category, CASE WHEN category = 'text_sql' THEN 'sql.cb' WHEN category = 'raw_image' THEN 'img.cb' WHEN hint = 'png' THEN 'png.cb' WHEN category = 'text_logs' THEN 'png.cb' ELSE 'img.cb' END AS brain FROM f""")
def brain_route(spark, d):
    k = F.col("doc_id") % 4
    f = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.when(k == 0, "text_sql").when(k == 1, "text_logs").when(k == 2, "raw_image").otherwise("binary").alias("category"), F.when(F.col("doc_id") % 5 == 0, "png").otherwise("none").alias("hint"))
    routes = spark.createDataFrame([("text_sql", "sql.cb"), ("raw_image", "img.cb"), ("png", "png.cb")], "category string, brain string")
    return integrity.brain_route(f, routes).select("name", "category", "brain")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def trust_filter(spark, d):
    known = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("peer"))
    return integrity.trusted(table(spark, d, "supplier").withColumn("peer", F.col("s_nationkey")), known).select("s_suppkey")


URLP = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(rf"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace({URLP}, '^/+|/+$', '', 'g'), '/+', '/', 'g') AS path FROM pages),
q AS (SELECT path, string_split(path, '/') AS parts FROM p), r AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM q))
SELECT path FROM r""")
def inode_paths(spark, d):
    f = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.octet_length("html").alias("size"), F.col("page_id").alias("mod_time"))
    return integrity.paths(integrity.inodes(f).select("id", "parent_id", "name")).select("path")


@query(rf"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace({URLP}, '^/+|/+$', '', 'g'), '/+', '/', 'g') AS path FROM pages),
q AS (SELECT string_split(path, '/') AS parts FROM p), r AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path, array_to_string(parts[1:i-1], '/') AS up FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM q))
SELECT up AS parent, count(*) AS children FROM r WHERE up <> '' GROUP BY up""")
def inode_children(spark, d):
    f = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.octet_length("html").alias("size"), F.col("page_id").alias("mod_time"))
    n = integrity.inodes(f)
    return n.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children")).join(n.select("id", F.col("path").alias("parent")), "id").select("parent", "children")


@query(rf"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace({URLP}, '^/+|/+$', '', 'g'), '/+', '/', 'g') AS path FROM pages),
q AS (SELECT string_split(path, '/') AS parts FROM p), r AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path, array_to_string(parts[1:i-1], '/') AS up, parts[i] AS name FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM q))
SELECT path AS up, (SELECT count(*) FROM r x WHERE x.up = r.path AND x.name = 'en') AS nodes FROM r WHERE up = ''""")
def node_lookup(spark, d):
    """The folder ``en`` of every host, looked up by parent and name."""
    f = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.octet_length("html").alias("size"), F.col("page_id").alias("mod_time"))
    n = integrity.inodes(f)
    hosts = n.where("parent_id is null").select("id", F.col("path").alias("up"))
    found = integrity.lookup_node(n, hosts.select(F.col("id").alias("parent_id"), F.lit("en").alias("name")))
    return hosts.join(found.select(F.col("parent_id").alias("id"), F.lit(1).alias("one")), "id", "left").groupBy("up").agg(F.count("one").alias("nodes"))


# ---- crypto, compression ----
SECRET = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"


@query(f"WITH {OBJ}, {ch_sql(128)} SELECT count(DISTINCT data) AS sealed, count(*) AS chunks, TRUE AS all_back FROM ch")
def convergent_dedup(spark, d):
    c = chunking.fixed(objects(spark, d)).withColumn("s", native.convergent_encrypt(SECRET, F.col("data")))
    back = native.convergent_decrypt(SECRET, F.col("s"), F.unhex(F.sha2("data", 256)))
    return c.agg(F.countDistinct("s").alias("sealed"), F.count("*").alias("chunks"), F.every(back == F.col("data")).alias("all_back"))


@query("SELECT doc_id AS object_id, CAST(octet_length(encode(text)) + 28 AS INTEGER) AS sealed, TRUE AS same FROM documents")
def aes_roundtrip(spark, d):
    key = F.unhex(F.lit(SECRET))
    o = objects(spark, d).withColumn("s", F.aes_encrypt("content", key, F.lit("GCM")))
    return o.select("object_id", F.octet_length("s").alias("sealed"), (F.aes_decrypt("s", key, F.lit("GCM")) == F.col("content")).alias("same"))


@query("SELECT doc_id AS object_id, sha256(encode(text)) AS sha FROM documents")
def zstd_pool(spark, d):
    return objects(spark, d).select("object_id", F.sha2(arrow.zstd_decompress(arrow.zstd_compress("content")), 256).alias("sha"))


# ---- batch twins of the streams ----
@query("SELECT event_type AS type, count(*) AS messages, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS weight FROM (SELECT DISTINCT ON (event_id) * FROM events) WHERE value > 0 GROUP BY 1".replace("CAST(value * 100 AS BIGINT)", "CAST(floor(value * 100) AS BIGINT)"))
def gossip_weights(spark, d):
    from ..streaming import streams

    e = streams.once(table(spark, d, "events"), ["event_id"])
    line = F.to_json(F.struct(F.lit("propose").alias("type"), F.col("event_type").alias("pattern"), F.floor(F.col("value") * 100).alias("weight")))
    w = streams.weights(e.where("value > 0").select(line.alias("value")))
    return w.select(F.col("pattern").alias("type"), "messages", "weight")


WAL = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS first, event_id FROM events),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)"""


@query(f"WITH {WAL} SELECT user_id, count(*) AS writes, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM s GROUP BY user_id, k")
def wal_sessions(spark, d):
    from ..streaming import streams

    return streams.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select("user_id", "writes", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("SELECT user_id, count(*) AS touches FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def decay_evict(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.count("*").alias("touches"), F.max("ts").alias("last")).crossJoin(F.broadcast(now)).where(F.expr("last < now - interval 1 day")).select("user_id", "touches")


@query("SELECT le, count(*) FILTER (value <= b) AS count FROM events, (VALUES ('0.1', 0.1), ('1', 1), ('5', 5), ('10', 10), ('30', 30), ('60', 60), ('inf', 'inf'::DOUBLE)) t(le, b) GROUP BY le")
def duration_histogram(spark, d):
    return integrity.histogram(table(spark, d, "events"), "value", [0.1, 1, 5, 10, 30, 60])
