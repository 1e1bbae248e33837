"""Command line: train, pack, unpack, verify, info, grep, benchmark."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from .operators import archives, chunking, codebook, integrity, packing
from .session import local_session
from .sources import files


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m bytestrata", description=__doc__)
    p.add_argument("--cpus", default="*")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, book: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        if book:
            c.add_argument("--codebook", required=True)
        return c

    t = add("train", "input", "output", book=False)
    t.add_argument("--size", type=int, default=8192)
    t.add_argument("--chunk-size", type=int, default=128)
    t.add_argument("--per-bucket", type=int, default=64)
    t.add_argument("--augment", action="store_true")
    for name in ("pack", "benchmark"):
        c = add(name, "input", *(["output"] if name == "pack" else []))
        c.add_argument("--mode", default="archive", choices=["archive", "edge", "stream", "bytes"])
        c.add_argument("--chunk-size", type=int, default=128)
    sub.choices["benchmark"].add_argument("--runs", type=int, default=1)
    add("unpack", "input", "output")
    add("info", "input", book=False)
    add("grep", "needle", "input")
    add("verify", "original", "restored", book=False)
    return p


def _digests(spark, path: str) -> set:
    return {bytes(r[0]) for r in files.files(spark, path).select(F.unhex(F.sha2("content", 256))).collect()}  # one hash a file


def main(args: list[str] | None = None) -> int:
    """Runs one command and prints JSON; 1 where a verification fails. Inputs are files or folders."""
    a = _arguments().parse_args(args)
    spark = local_session("bytestrata", a.cpus)
    show = lambda **x: print(json.dumps(x, default=str))
    if a.command == "train":
        chunks = chunking.fixed(files.files(spark, a.input), a.chunk_size)
        book = archives.codebook_bytes(codebook.train(chunks, a.chunk_size, a.size, a.per_bucket, a.augment))
        archives.write_file(spark, a.output, book)
        show(codewords=(len(book) - 512) // a.chunk_size, bytes=len(book))
    elif a.command == "pack":
        packed = archives.pack(files.files(spark, a.input), archives.read_codebook(spark, a.codebook), packing.PackOptions(mode=a.mode, chunk_size=a.chunk_size))
        packed.write.mode("overwrite").parquet(a.output)
        s = spark.read.parquet(a.output).agg(F.count("*").alias("files"), F.sum("original").alias("original"), F.sum("packed").alias("packed")).first()
        show(**s.asDict())
    elif a.command == "unpack":
        out = archives.unpack(spark.read.parquet(a.input), archives.read_codebook(spark, a.codebook))
        show(files=archives.export(out.withColumnRenamed("content", "archive"), a.output, suffix="").count())
    elif a.command == "info":
        packed = spark.read.parquet(a.input)
        for r in archives.metadata(packed).join(archives.pool_entropy(packed), "object_id", "left").orderBy("object_id").toLocalIterator():
            show(**{k: v.hex() if isinstance(v, bytearray) else v for k, v in r.asDict().items()})
    elif a.command == "grep":
        book = archives.read_codebook(spark, a.codebook)
        hits = integrity.grep_hits(archives.read(spark.read.parquet(a.input)), book, a.needle.encode())
        for r in hits.orderBy("object_id", "chunk_idx").toLocalIterator():
            show(object_id=r.object_id, chunk=r.chunk_idx, offset=r.offset, content=r.shown)
    elif a.command == "verify":
        same = _digests(spark, a.original) == _digests(spark, a.restored)
        show(same=same)
        return int(not same)
    else:
        book, runs = archives.read_codebook(spark, a.codebook), []
        for _ in range(a.runs):
            start = time.time()
            objects = files.files(spark, a.input)
            packed = archives.pack(objects, book, packing.PackOptions(mode=a.mode, chunk_size=a.chunk_size)).cache()
            s = packed.agg(F.sum("original").alias("o"), F.sum("packed").alias("p")).first()
            middle = time.time()
            archives.unpack(packed, book).write.format("noop").mode("overwrite").save()
            runs.append((middle - start, time.time() - middle))
            packed.unpersist()
        show(original=s["o"], packed=s["p"], pack_ms=round(1000 * sum(x for x, _ in runs) / len(runs)), unpack_ms=round(1000 * sum(y for _, y in runs) / len(runs)), runs=len(runs))
    return 0


if __name__ == "__main__":
    sys.exit(main())
