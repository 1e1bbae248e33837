import os
import random

import pytest
from pyspark.sql import functions as F

from bytestrata.functions import arrow, native
from bytestrata.operators import chunking, codebook, integrity, packing, search
from bytestrata.sources import archive, files
from bytestrata.streaming import streams

RNG = random.Random(1)


def df(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "object_id long, content binary")


INPUTS = [b"", b"a", b"Hello, World! " * 52, RNG.randbytes(5000), bytes(3000), b"ABCDC" * 2000, b"\n".join(b'{"k": %d}' % i for i in range(300))]


@pytest.mark.parametrize("name", chunking.CHUNKERS)
def test_chunkers_reassemble(spark, name):
    back = {r.object_id: bytes(r.content) for r in chunking.reassemble(chunking.CHUNKERS[name](df(spark, *INPUTS))).collect()}
    assert back == {i: c for i, c in enumerate(INPUTS) if c}


def fastcdc_slow(b, target):
    least, most, out, start, h = max(1, target // 4), 4 * target, [], 0, 0
    g = [int(x) for x in arrow.gear()]
    for i, x in enumerate(b):
        h = ((h << 1) + g[x]) % 2**64
        n = i + 1 - start
        if n >= least and h & (target - 1) == 0 or n == most:
            out.append(i + 1)
            start, h = i + 1, 0
    return out + ([len(b)] if start < len(b) else [])


@pytest.mark.parametrize("target", [16, 64, 128, 512])
def test_fastcdc_matches_sequential_rule(target):
    for n in (10, 100, 5000):
        b = RNG.randbytes(n)
        assert arrow.fastcdc_ends(b, target) == (fastcdc_slow(b, target) if n > target // 4 else [n])


def test_content_defined_chunks_resist_shifts():
    b = RNG.randbytes(10240)
    for ends, least in ((arrow.cdc_ends, 0.9), (arrow.fastcdc_ends, 0.9)):
        parts = lambda x: [x[i:j] for i, j in zip([0, *ends(x, 64)], ends(x, 64))]
        a, c = set(parts(b)), set(parts(b"!" + b))
        assert len(a & c) >= least * len(a)


def test_hamming_vectors():
    cases = [(b"\x01\x02\x03", b"\x01\x02\x03", 0), (b"\x01\x02\x03", b"\x01\x02\x04", 3), (b"\x01\x02\x03", b"\x04\x05\x06", 7), (b"\x01\x02", b"\x01\x02\x03\x04", 16), (b"", b"\x01", 8)]
    assert [arrow.hamming(a, b) for a, b, _ in cases] == [d for *_, d in cases]


def test_nearest_codeword_vectors(spark):
    book = spark.createDataFrame([(0, bytearray(4)), (1, bytearray(b"\xff\0\0\0")), (2, bytearray(b"\x01\x02\x03\x04")), (3, bytearray(b"\x0a\x14\x1e\x28"))], "codebook_id long, pattern binary")
    chunks = spark.createDataFrame([(bytearray(x),) for x in (b"\x01\x02\x03\x04", b"\x01\x02\x03\x05", b"\xfe\0\0\0")], "data binary")
    for method in ("linear", "lsh"):
        got = {bytes(r.data): (r.match.codebook_id, r.match.distance) for r in search.nearest_codeword(chunks, book, method).collect()}
        assert got == {b"\x01\x02\x03\x04": (2, 0), b"\x01\x02\x03\x05": (2, 1), b"\xfe\0\0\0": (1, 1)}
    assert search.nearest_codeword(chunks, book.limit(0)).where("match is not null").count() == 0


def test_edit_scripts_round_trip():
    for _ in range(60):
        a = bytes(RNG.choice(b"abc") for _ in range(RNG.randint(0, 300)))
        b = bytes(RNG.choice(b"abc") for _ in range(RNG.randint(0, 300)))
        assert arrow.apply_script(b, arrow.edit_script(a, b)) == a
    assert arrow.edit_script(b"x" * 128, b"x" * 128) == bytes([0, 128])


def test_xor_tail_and_polynomials(spark):
    assert arrow.xor(b"\x01\x02\x03\x04", b"\xff\xff") == b"\xfe\xfd\x03\x04"
    assert arrow.polynomial_seed(b"") is None and arrow.polynomial_seed(b"\x07") == 7 << 16
    for seed in (0, 5, 0x030201, 0x7F0000):
        made = bytes.fromhex(spark.range(1).select(native.polynomial(F.lit(seed), F.lit(20))).first()[0])
        assert arrow.polynomial_seed(made) == seed
    assert arrow.fnv1a(b"") == 0xCBF29CE484222325 and arrow.fnv1a(b"a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize("mode", ["archive", "stream", "bytes"])
def test_pack_round_trip(spark, mode):
    objects = df(spark, b"the quick brown fox " * 200, RNG.randbytes(2000), bytes(i * 13 % 256 for i in range(4000)), b"i" * 700)
    chunks = chunking.fixed(objects, 16)
    book = codebook.train(chunks, 16, 64, 8)
    entries = packing.offsets(packing.route(chunks, book, packing.PackOptions(mode=mode, chunk_size=16, literal_entropy=3.5)))
    got = packing.decode(entries, book).collect()
    assert all(r.decoded == r.data for r in got)
    at = {}
    for r in sorted(got, key=lambda r: (r.object_id, r.chunk_idx)):
        assert r.delta_offset == at.get(r.object_id, 0)
        at[r.object_id] = r.delta_offset + r.delta_size


def test_edge_decodes_to_codewords_and_tiers_keep_their_index(spark):
    chunks = chunking.fixed(df(spark, b"a9cQefzh" * 50, bytes(255 - x for x in b"a9cQefzh") * 50), 8)
    books = [codebook.train(chunks.where(f"object_id = {i}"), 8) for i in (0, 1)]
    e = packing.route(chunks, books, packing.PackOptions(mode="edge", chunk_size=8, literal_entropy=9))
    assert all(r.decoded == r.data for r in packing.decode(e, books).collect()) and {r.codebook_index for r in e.collect()} - {None} == {0, 1}
    stream = packing.route(chunks, books[0].limit(0), packing.PackOptions(mode="stream", chunk_size=8))
    assert {r.encoding for r in stream.collect()} == {"literal"}


def test_merkle_and_manifest_vectors(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).digest()
    leaves = [h(bytes([i])) for i in range(3)]
    rows = [("a", i, x.hex()) for i, x in enumerate(leaves)] + [("b", 0, leaves[0].hex())]
    got = {r.k: r.root for r in integrity.merkle_root(spark.createDataFrame(rows, "k string, pos long, hash string"), "k").collect()}
    assert got == {"a": h(h(leaves[0] + leaves[1]) + h(leaves[2] + leaves[2])).hex(), "b": h(leaves[0] * 2).hex()}
    local = spark.createDataFrame([(1, "AAA"), (2, "BBB"), (3, "CCC")], "id long, h string")
    remote = spark.createDataFrame([(2, "BBB"), (4, "DDD"), (5, "EEE")], "id long, h string")
    diff = {(r.side, r.id) for r in integrity.manifest_diff(local, remote, "id", "h").collect()}
    assert diff == {("missing", 4), ("missing", 5), ("extra", 1), ("extra", 3)}


def test_range_reads_on_variable_chunks(spark):
    b = RNG.randbytes(9000)
    chunks = chunking.fastcdc(df(spark, b), 128).cache()
    for _ in range(5):
        start, n = RNG.randrange(8000), RNG.randint(1, 900)
        assert bytes(integrity.read_range(chunks, start, n).first().content) == b[start : start + n]


def test_convergent_encryption(spark):
    import hashlib
    import hmac

    secret = bytes(range(32)).hex()
    x = df(spark, b"same", b"same", b"other").withColumn("s", native.convergent_encrypt(secret, F.col("content")))
    rows = x.withColumn("back", native.convergent_decrypt(secret, F.col("s"), F.unhex(F.sha2("content", 256)))).collect()
    assert rows[0].s == rows[1].s != rows[2].s and all(r.back == r.content for r in rows)
    digest = hashlib.sha256(b"same").digest()
    assert spark.range(1).select(native.hmac_sha256(secret, F.unhex(F.lit(digest.hex())))).first()[0] == hmac.new(bytes(range(32)), digest, "sha256").hexdigest()


def test_detection(spark):
    samples = {b"\x89PNG\r\n\x1a\n....": "compressed", b"BM......": "raw_image", b"SELECT a FROM b": "text_sql", b"package main\nfunc main() {}": "text_code", b"INFO started\n" * 9: "text_logs", bytes(200): "binary", b"": "empty", b"<svg width='1'>": "raw_image"}
    c, _, _ = native.category(F.col("content"), arrow.shannon_entropy("content"))
    got = {bytes(r.content): r.c for r in df(spark, *samples).select("content", c.alias("c")).collect()}
    assert got == samples
    kinds = {b"\x7fELF1": "ELF", b' [{"a": 1}]': "JSON", b'{"a":1}\n{"a":2}\n': "JSONL", b"l\n" * 9: "LINES", b"abc": "UNKNOWN", b"": "UNKNOWN"}
    assert {bytes(r.content): r.k for r in df(spark, *kinds).select("content", native.content_type(F.col("content")).alias("k")).collect()} == kinds


def test_bpe_finds_long_tokens(spark):
    vocabulary = codebook.bpe(df(spark, b"ABABABA CDCD " * 1000), 300, 128)
    assert any(len(b) > 4 for _, b, _ in vocabulary) and len(vocabulary) <= 300


@pytest.mark.parametrize("version", range(1, 10))
def test_headers(version):
    h = archive.Header(version, original_hash=os.urandom(32), original_size=1 << 40, chunk_count=7)
    if version > 1:
        h.salt, h.encrypted, h.passthrough = os.urandom(16), True, version > 2
    if version > 3:
        h.chunk_size, h.codebook_hashes = 128, [os.urandom(8), *([os.urandom(8)] * 2 if version > 5 else [bytes(8)] * 2)]
    if version > 4:
        h.merkle_root = os.urandom(32)
    if version > 5:
        h.convergent = True
    if version > 7:
        h.dictionary = b"dictionary"
    data = archive.write_header(h)
    assert archive.parse_header(data) == h
    with pytest.raises(ValueError):
        archive.parse_header(data[:-1])
    with pytest.raises(ValueError):
        archive.parse_header(b"XXXX" + data[4:])


def test_oversized_dictionary_and_tables():
    data = bytearray(archive.write_header(archive.Header(8)))
    data[137:141] = (archive.MOST_DICTIONARY + 1).to_bytes(4, "little")
    with pytest.raises(ValueError):
        archive.parse_header(bytes(data))
    for version, rows in ((6, [(1, 2, 3, 4)] * 3), (7, [(archive.LITERAL_ID, 2, 3, 4, 255)] * 3)):
        table = archive.write_chunk_table(rows, version)
        assert [tuple(x) for x in archive.parse_chunk_table(table, 3, version).tolist()] == rows
        with pytest.raises(ValueError):
            archive.parse_chunk_table(table[:-1], 3, version)
    assert archive.parse_mutation(archive.write_mutation(123, 9)) == (123, 9)


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.bin").write_bytes(b"abc" * 100)
    (tmp_path / "in" / "sub" / "b.bin").write_bytes(b"xyz" * 100)
    assert files.files(spark, str(tmp_path / "in")).count() == 2
    book = codebook.train(chunking.fixed(files.files(spark, str(tmp_path / "in")), 8), 8)
    streams.pack_stream(files.file_stream(spark, str(tmp_path / "in")), book, str(tmp_path / "out"), str(tmp_path / "cp"), 8).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("size")).first()[0] >= 300
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "m.json").write_text('{"type":"propose","pattern":"p","weight":3}\n{"type":"propose","pattern":"p","weight":0}\n{"type":"announce","filename":"f"}\nnot json\n')
    lines = spark.readStream.text(str(tmp_path / "log"))
    q = streams.weights(lines).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("w").collect()] == [("p", 3, 1)]


def test_sessions_stream_equals_batch(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:00:{s:02d}") for u, s in ((1, 0), (1, 1), (1, 9), (2, 5), (2, 20))]
    spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    want = sorted((r.user_id, r.writes) for r in streams.sessions(batch, "3 seconds").collect())
    q = streams.sessions(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e")), "3 seconds").writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, r.writes) for r in spark.table("s").collect()) == want == [(1, 1), (1, 2), (2, 1), (2, 1)]


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['bytestrata.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def whole_documents(spark, d):
    import random

    rng = random.Random(21)
    docs = [(i, "".join(rng.choice("abcdefgh \n") for _ in range(n)), "en" if i % 2 else "de", "s", n) for i, n in enumerate((300, 900, 2500, 9000, 64, 700))]
    docs += [(6, docs[1][1][:256] * 3, "en", "s", 768), (7, docs[0][1], "de", "s", 300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return {r[0]: r[1].encode() for r in docs}


def test_queries_over_all_documents(spark, tmp_path):
    from bytestrata.plans.catalogue import QUERIES

    docs, d = whole_documents(spark, tmp_path), str(tmp_path)
    full = {b[i : i + 128] for b in docs.values() for i in range(0, len(b) - 127, 128)}
    for name in ("match_linear", "match_tiered"):
        assert sorted(r.data for r in QUERIES[name](spark, d).collect()) == sorted(x.hex() for x in full)
    assert sorted(r.object_id for r in QUERIES["detect_category"](spark, d).collect()) == sorted(docs)
    fixed = {(i, b[j : j + 64]) for i, b in docs.items() for j in range(0, len(b), 64)}
    moved = {(i, (b"!" + b)[j : j + 64]) for i, b in docs.items() for j in range(0, len(b) + 1, 64)}
    got = {r.chunker: (r.shared, r.ratio) for r in QUERIES["cdc_shift_resistance"](spark, d).collect()}
    assert got["fixed"] == (len(fixed & moved), round(len(fixed & moved) / len(fixed), 6))


def test_chunkers_and_residuals_over_whole_documents(spark, tmp_path):
    import hashlib

    from bytestrata.plans.catalogue import QUERIES

    docs, d = whole_documents(spark, tmp_path), str(tmp_path)
    for name in ("chunk_fastcdc", "chunk_cdc"):
        total = dict.fromkeys(docs, 0)
        for r in QUERIES[name](spark, d).collect():
            total[r.object_id] += r["size"]
        assert total == {i: len(b) for i, b in docs.items()}
    assert {r.object_id: r.sha256 for r in QUERIES["hash_suite"](spark, d).collect()} == {i: hashlib.sha256(b).hexdigest() for i, b in docs.items()}
    chunks = {(i, k): b[k * 128 : k * 128 + 128] for i, b in docs.items() for k in range(-(-len(b) // 128))}
    both = {(i, k): bytes(x ^ y for x, y in zip(c, chunks[i + 1, k])) for (i, k), c in chunks.items() if len(chunks.get((i + 1, k), b"")) == len(c)}
    assert {(r.object_id, r.chunk_idx): r.x for r in QUERIES["xor_residual"](spark, d).collect()} == {k: v.hex() for k, v in both.items()}
    assert {(r.a, r.chunk_idx): r.distance for r in QUERIES["hamming_pairs"](spark, d).collect()} == {k: sum(x.bit_count() for x in v) for k, v in both.items()}
    assert {(r.object_id, r.chunk_idx): r.sha for r in QUERIES["patch_roundtrip"](spark, d).collect()} == {k: hashlib.sha256(c).hexdigest() for k, c in chunks.items()}


def test_multipass_weighs_restricts_and_matches_again(spark, tmp_path):
    from collections import Counter

    from bytestrata.operators import search
    from bytestrata.plans.catalogue import QUERIES

    docs = whole_documents(spark, tmp_path)
    want = Counter(b[i : i + 128].hex() for b in docs.values() for i in range(0, len(b), 128))
    assert {r.data: r.n for r in QUERIES["match_multipass"](spark, str(tmp_path)).collect()} == want
    few = spark.createDataFrame([((0, 5, 3, None), 1), ((0, 4, 3, None), 9), ((0, 5, 3, None), 1)], f"match {search.MATCH}, n long")
    assert [(r.codebook_id, r.used) for r in search.most_used(few, 1, "n").collect()] == [(4, 9)]


# ---- stored formats ----
def test_codebook_file_round_trip_and_errors(spark, tmp_path):
    from bytestrata.operators import archives
    from bytestrata.sources import archive

    patterns = [bytes([i]) * 8 for i in range(5)]
    data = archive.write_codebook(patterns)
    assert len(data) == 512 + 40 and archive.parse_codebook(data)[1] == patterns
    archives.write_file(spark, f"{tmp_path}/b.book", data)
    book = archives.read_codebook(spark, f"{tmp_path}/b.book")
    assert [(r.codebook_id, r.pattern) for r in book.orderBy("codebook_id").collect()] == list(enumerate(map(bytearray, patterns)))
    assert archives.codebook_bytes(book) == data and archives.swap(book, book) is book
    other = archives.codebook_of(spark, archive.write_codebook(patterns[::-1]))
    assert archives.swap(book, other) is other
    for bad in (b"", data[:300], b"X" + data[1:], data[:6] + b"\2\0" + data[8:], data[:8] + b"\0\0" + data[10:], data[:-1], data[:18] + bytes(8) + data[26:], data[:-1] + b"x"):
        with pytest.raises(ValueError):
            archive.parse_codebook(bad)
    for bad in ([], [b"a", b"bc"], [b""]):
        with pytest.raises(ValueError):
            archive.write_codebook(bad)


@pytest.mark.parametrize("mode", ["archive", "stream", "bytes"])
def test_archives_store_and_come_back(spark, mode):
    import random

    from bytestrata.operators import archives, codebook, packing
    from bytestrata.sources import archive

    rng = random.Random(3)
    words = [bytes(rng.randrange(97, 101) for _ in range(64)) for _ in range(40)]
    objects = {i: b"".join(rng.choice(words) for _ in range(rng.randint(5, 50))) + b"tail"[: i % 5] for i in range(12)}
    objects |= {20: b"", 21: b"short", 22: bytes(1000), 23: rng.randbytes(3000), 24: b"\x1f\x8b" + rng.randbytes(500), 25: bytes(range(256)) * 4, 26: None}
    df = spark.createDataFrame([(i, b) for i, b in objects.items()], "object_id long, content binary")
    from bytestrata.operators import chunking

    book = codebook.train(chunking.fixed(df.where("object_id < 12"), 64), 64, 64, 8)
    packed = archives.pack(df, book, packing.PackOptions(mode=mode, chunk_size=64)).cache()
    got = {r.object_id: r for r in packed.collect()}
    assert set(got) == set(objects) and all(got[i].passthrough for i in (20, 21, 22, 24, 26))
    assert all(r.packed <= r.original + archive.V8_SIZE for r in got.values())
    assert any(not got[i].passthrough for i in range(12))
    back = {r.object_id: bytes(r.content) for r in archives.unpack(packed, book).collect()}
    assert back == {i: b or b"" for i, b in objects.items()}
    meta = {r.object_id: r for r in archives.metadata(packed.unionByName(packed.limit(1).selectExpr("cast(99 as bigint) as object_id", "cast('xx' as binary) as archive", "passthrough", "original", "packed"))).collect()}
    assert meta[99].error and all(meta[i].original_size == len(b or b"") and not meta[i].error for i, b in objects.items())
    places = archives.block_offsets(packed).collect()
    assert {r.object_id for r in places} == {i for i, r in got.items() if not r.passthrough}
    assert all(r.offset + r["size"] == got[r.object_id].packed for r in places)
    assert all(0 <= r.randomness <= 100 for r in archives.pool_entropy(packed).collect())
    whole = next(bytes(r.archive) for r in got.values() if not r.passthrough)
    for n in (60, 141, 200, len(whole) - 1):
        with pytest.raises(ValueError):
            archive.parse_archive(whole[:n])


def test_manifests_in_both_forms(spark):
    from bytestrata.operators import integrity
    from bytestrata.sources import archive

    entries = spark.createDataFrame([(1, 1, 7, 2**62, 128), (1, 0, -1, -5, 64), (2, 0, 3, 9, 1)], "object_id long, chunk_idx int, codebook_id long, delta_hash long, chunk_size int")
    objects = spark.createDataFrame([(1, b"abc"), (2, b"")], "object_id long, content binary")
    binary = integrity.manifest_binary(entries, objects)
    assert {r.object_id: len(r.manifest) for r in binary.collect()} == {1: 46 + 40, 2: 46 + 20}
    back = integrity.manifest_from_binary(binary)
    assert sorted(map(tuple, back.drop("original_size").collect())) == sorted(map(tuple, entries.collect()))
    text = entries.withColumn("delta_hash", entries.delta_hash.cast("string"))
    assert sorted(map(tuple, integrity.manifest_from_json(integrity.manifest_json(text)).collect())) == sorted(map(tuple, text.collect()))
    for bad in (b"", bytes(binary.first().manifest)[:-1]):
        with pytest.raises(ValueError):
            archive.parse_manifest(bad)


def test_brain_map_from_folder(spark, tmp_path):
    from bytestrata.operators import integrity

    end = archive.CODEBOOK_SUFFIX
    for name in ("brain_LOGS", "a_sql", "b_sql", "my_img", "brain_universal"):
        (tmp_path / f"{name}{end}").write_bytes(b"x")
    (tmp_path / "a_log.txt").write_bytes(b"x")
    (tmp_path / "brains.json").write_text('{"text_code": "code", "raw_image": "given"}')
    got = {r.category: r.brain for r in integrity.read_brain_map(spark, str(tmp_path)).collect()}
    assert got == {"text_logs": f"brain_LOGS{end}", "text_sql": f"a_sql{end}", "raw_image": "given", "text_code": "code", "universal": f"brain_universal{end}"}


def test_keys_and_small_functions(spark):
    from pyspark.sql import functions as F

    from bytestrata.functions import native

    assert native.derive_key(b"password", b"salt", 1).hex() == "120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b"
    assert len(native.new_salt()) == 16 and native.new_salt() != native.new_salt()
    row = spark.range(1).select(native.one_line(F.lit("a\nb")), native.entry_size(F.lit(6)), native.entry_size(F.lit(7)), native.block_count(F.lit(131_073)), native.is_model_file(F.lit(b"GGUFx"))).first()
    assert tuple(row) == ("a b", 24, 25, 2, True)


# ---- streams with state, counters, names, command line ----
def test_evictions_keep_state_until_idle(spark, tmp_path):
    rows = [[("a", 0), ("b", 5)], [("a", 30)], [("c", 200)], [("a", 210)], [("c", 1000)], [("d", 1001)]]
    for k, batch in enumerate(rows):
        df = spark.createDataFrame(batch, "user_id string, s int").selectExpr("user_id", "timestamp_seconds(1000000 + s) AS ts")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        os.utime(next((tmp_path / "in" / str(k)).glob("*.parquet")), (1_000_000 + k, 1_000_000 + k))
    events = spark.readStream.schema("user_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = streams.evictions(events, 60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    got = sorted((r.user_id, r.touches, int(r["last"].timestamp()) % 1000) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, 210), ("a", 2, 30), ("b", 1, 5), ("c", 1, 200)]


def test_messages_count_once(spark, tmp_path):
    rows = [("m1", 1), ("m1", 2), ("m2", 3)]
    df = spark.createDataFrame(rows, "id string, s int").selectExpr("id", "timestamp_seconds(s) AS ts")
    assert streams.once(df, ["id"]).count() == 2
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.once(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["id"], "1 minute")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_counters_see_what_passes(spark):
    df = spark.createDataFrame([(10, 4), (20, 0)], "size int, delta_size int")
    out, seen = streams.with_progress(df)
    assert out.count() == 2 and seen.get == {"chunks": 2, "bytes": 30, "residual_bytes": 4}


def test_sql_names(spark):
    chunking.register(spark)
    rows = spark.sql("SELECT c.* FROM VALUES (X'616263') AS t(b), LATERAL bytestrata_chunks(t.b, 2) AS c ORDER BY chunk_idx").collect()
    assert [(r.chunk_idx, r.offset, r.size, bytes(r.data)) for r in rows] == [(0, 0, 2, b"ab"), (1, 2, 1, b"c")]
    assert spark.sql("SELECT bytestrata_entropy(X'0001'), bytestrata_fnv1a(X''), bytestrata_xxh64(X'')").first()[:2] == (1.0, arrow._signed(0xCBF29CE484222325))


def test_command_line_round_trip(spark, tmp_path, capsys):
    import json

    from bytestrata.__main__ import main

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.txt").write_bytes((b"aaaabbbbccccdddd" * 8 + bytes([97 + k]) * 128) * 6)
    at = lambda x: f"{tmp_path}/{x}"
    run = lambda *args: (main(list(args)), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])
    assert run("train", at("in"), at("b.book"))[1][0]["codewords"] == 4
    assert run("pack", at("in"), at("packed"), "--codebook", at("b.book"))[1][0]["files"] == 3
    assert len(run("info", at("packed"))[1]) == 3
    assert run("unpack", at("packed"), at("out"), "--codebook", at("b.book"))[1] == [{"files": 3}]
    assert run("verify", at("in"), at("out")) == (0, [{"same": True}])
    hits = run("grep", "aaaabbbb", at("packed"), "--codebook", at("b.book"))[1]
    assert len(hits) == 18 and all(h["content"].startswith("aaaabbbb") for h in hits)
    (tmp_path / "out" / "more").write_bytes(b"x")
    assert run("verify", at("in"), at("out"))[0] == 1
    assert run("benchmark", at("in"), "--codebook", at("b.book"))[1][0]["runs"] == 1


def test_codebook_acceptance_of_a_peer(spark):
    from bytestrata.operators import archives

    sample = spark.createDataFrame([(1, b"abababab" * 200)], "object_id long, content binary")
    good = archive.write_codebook([b"abababab" * 8, bytes(64)])
    trusted = spark.createDataFrame([("p",)], "peer string")
    assert archives.accepted(sample, good, "p", trusted)[0]
    assert archives.accepted(sample, good, "q", trusted) == (False, "not trusted")
    assert archives.accepted(sample, good, "p", trusted, most=10) == (False, "too large")
    assert not archives.accepted(sample, good[:-1], "p", trusted)[0]
    assert not archives.accepted(spark.createDataFrame([(1, os.urandom(4000))], "object_id long, content binary"), good, "p", trusted)[0]


def test_bpe_matches_plain_merges(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", "abc", "a", "aaa", " "]) for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    got = codebook.bpe(spark.createDataFrame(list(enumerate(texts)), "object_id long, content binary"), 290, 12)
    streams_, want = [[bytes([x]) for x in t] for t in texts], []
    while len(want) < 34:
        n = {}
        for s in streams_:
            for p in zip(s, s[1:]):
                if len(p[0]) + len(p[1]) <= 12:
                    n[p] = n.get(p, 0) + 1
        if not n or max(n.values()) < 2:
            break
        best = min((p for p in n if n[p] == max(n.values())))
        want.append((best[0] + best[1], n[best]))
        for s in streams_:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == best:
                    s[i : i + 2] = [s[i] + s[i + 1]]
                i += 1
    assert [(b, n) for _, b, n in got[256:]] == want and [i for i, _, _ in got] == list(range(len(got)))


def test_fnv_of_many_and_of_long_values(spark):
    values = [b"", b"a", None, bytes(range(200)) * 5] + [bytes([k]) * (k % 9) for k in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v binary").coalesce(1)
    got = {r.i: r.h for r in df.select("i", arrow.fnv1a_64("v").alias("h")).collect()}
    assert got == {i: None if v is None else arrow._signed(arrow.fnv1a(v)) for i, v in enumerate(values)}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_chunks_do_not_carry_their_object(spark):
    import re

    df = spark.createDataFrame([(1, b"x" * 1000), (2, None), (3, b"")], "object_id long, content binary")
    for c in (chunking.fixed(df), chunking.cdc(df, 64)):
        kept = re.search(r"Generate posexplode\(.*\), \[([^\]]*)\], false", _plan(c.select("object_id", arrow.shannon_entropy("data"))))[1]
        assert "object_id" in kept and "content" not in kept, kept


def test_routes_and_archives_shuffle_nothing(spark):
    import hashlib

    from bytestrata.operators import archives

    rng = random.Random(5)
    some = [bytes(rng.choice(b"abcdefgh \n") for _ in range(n)) for n in (300, 900, 64, 0, 700, 900)]
    # one id twice, with other bytes; a null; an object of one byte over and over
    rows = [(1, some[0]), (1, some[1]), (2, some[2]), (3, some[3]), (4, None), (5, some[4]), (6, b"z" * 5000), (7, some[5]), (7, some[5])]
    df = spark.createDataFrame(rows, "object_id long, content binary")
    book = search.kept(codebook.train(chunking.fixed(df, 8), 8, 16, 4))
    routed = packing.route(chunking.fixed(df, 8), book, packing.PackOptions(chunk_size=8))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # objects reach over batches
    try:
        for mode in ("archive", "edge", "stream"):
            packed = archives.pack(df, book, packing.PackOptions(mode=mode, chunk_size=8))
            assert "Exchange" not in _plan(packed)
            got = packed.collect()
            assert sorted((r.object_id, r.original) for r in got) == sorted((i, len(b or b"")) for i, b in rows)
            heads = archives.metadata(packed).collect()
            assert sorted((r.object_id, bytes(r.original_hash)) for r in heads) == sorted((i, hashlib.sha256(b or b"").digest()) for i, b in rows)
            if mode != "edge":
                one = packed.where("object_id in (2, 5, 6)")
                assert {r.object_id: bytes(r.content or b"") for r in archives.unpack(one, book).collect()} == {2: some[2], 5: some[4], 6: b"z" * 5000}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Exchange" not in _plan(routed) and _plan(routed).count("ArrowEvalPython") <= 2
    assert routed.count() == sum(-(-len(b or b"") // 8) for _, b in rows)


def test_edit_scripts_take_the_cheapest_way_in_little_memory():
    import tracemalloc

    rng = random.Random(9)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(12))) for _ in range(2))
        cost = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + 2 * (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        s, got, k = arrow.edit_script(a, b), 0, 0
        while k < len(s):
            got += (0, 2, 1, 1)[s[k]] * s[k + 1]
            k += 2 + s[k + 1] * (s[k] in (1, 2))
        assert got == cost[-1][-1] and arrow.apply_script(b, s) == a
    a, b = rng.randbytes(3000), rng.randbytes(3000)
    tracemalloc.start()
    s = arrow.edit_script(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert arrow.apply_script(b, s) == a and peak < 8 << 20, peak


def test_route_archive_matches_every_chunk_but_noise(spark, tmp_path):
    from collections import Counter, defaultdict

    import numpy as np

    from bytestrata.plans import catalogue

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9)))
    like = lambda: "state" + "".join(rng.choice("xyz") for _ in range(123))  # noqa: E731  # one bucket of more than four
    line = " ".join(word() for _ in range(200))
    some = [("en", " ".join(word() for _ in range(300))) for _ in range(12)] + [("de", line), ("de", line), ("de", "Z" * 300), ("fr", line.replace("e", "i", 9)), (None, "short one"), ("fr", ""), ("fr", None), ("fr", "\x89PNG\r\n then text"), ("es", "".join(like() for _ in range(90)))]
    spark.createDataFrame([(i, t, x, "s") for i, (x, t) in enumerate(some)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = [(x, b[k : k + 128]) for x, t in some for b in [(t or "").encode()] for k in range(0, len(b), 128)]
    full = Counter(c for _, c in cut if len(c) == 128)
    kept, by_bucket = [], defaultdict(int)
    for c, n in sorted(full.items(), key=lambda x: (-x[1], x[0])):
        by_bucket[c[:2]] += 1
        if by_bucket[c[:2]] <= 64:
            kept.append((int.from_bytes(c[:2], "little"), -n, c))
    book = [c for *_, c in sorted(kept[:8192])]
    want = defaultdict(Counter)
    for x, c in cut:
        got = want[x]
        got["chunks"] += 1
        e = float(arrow.entropies(np.frombuffer(c, np.uint8)[None])[0])
        own = [b for b in book if b[:2] == c[:2]] or book
        best = min(own, key=lambda b: (arrow.hamming(c, b), book.index(b)))
        s = max(0, 1 - arrow.hamming(c, best) / (8 * len(c)))
        if arrow.polynomial_seed(c) is not None and e <= 3:
            kind, size = "fractals", 0
        elif e > 7.8 or c.startswith(b"\x89PNG") or s < 0.2:
            kind, size = "literals", len(c)
        else:
            kind, size = "xors", len(c)
            if s >= (0.95 if e > 6 else 0.8) and len(p := arrow.edit_script(c, best)) < size and len(p) <= 256:
                kind, size = "patches", len(p)
        got[kind] += 1
        got["residual_bytes"] += size
    rows = {r.lang: r.asDict() for r in catalogue.QUERIES["route_archive"](spark, str(tmp_path)).collect()}
    assert rows.keys() == want.keys()
    for x, w in want.items():
        assert {k: rows[x][k] for k in ("chunks", "literals", "fractals", "xors", "patches", "residual_bytes")} == {k: w[k] for k in ("chunks", "literals", "fractals", "xors", "patches", "residual_bytes")}, x
    # at most the short ends are too far from every codeword
    assert rows["en"]["literals"] <= 12 < rows["en"]["xors"] + rows["en"]["patches"] and rows["de"]["patches"] and rows["de"]["fractals"]
