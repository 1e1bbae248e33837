"""Harmonic packing of token pieces into fixed-capacity sequences.

The capacity is a power of two and every class of pieces has length capacity / 2^j: a bin
of class j takes exactly 2^j pieces and is then full. Documents are cut into whole
capacities and the binary parts of what remains, so full bins have no padding. Each worker
numbers the pieces of a class by itself; one row per worker and class gives those numbers
their global base, and bins follow by division. What does not fill a last bin, less than
one bin in each class, is laid out by falling length, so only the last sequence is padded.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import cut, numbered

_PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("_pid", T.LongType()), ("_idx", T.LongType())]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of a text, as ``tokenizers`` gives them for the file at ``path``.

    A file of the same vocabulary as ranks beside it, if there is one, is read by the
    faster ``tiktoken``; texts with the string of an added token go to ``tokenizers``.
    """

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow, self.fast = Tokenizer.from_file(path), None
        self.added = [x["content"] for x in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(length: int, capacity: int) -> list[int]:
    """Whole capacities, then the binary parts of the rest by falling length."""
    full, rest = divmod(length, capacity)
    return [capacity] * full + [1 << j for j in range(capacity.bit_length() - 2, -1, -1) if rest >> j & 1]


def harmonic_pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 1024, separator: int = 0) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Needs ``doc_id`` and ``text`` and ignores other columns. A document is its token ids and
    then ``separator``. Null or empty text: only the separator. Null doc_id: packed like any
    other, with a null id. Repeated rows: each is packed. Empty table: no rows. A very long
    text is cut into as many pieces as it needs. Ties need no rule: pieces of a class are
    alike. Sequences number gaplessly from 0, offsets within each too.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    path = tokenizer or tokenizer_path()
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in _PIECE])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, encode, used = TaskContext.get().partitionId(), Encoder(path), {}
        for batch in batches:
            took, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), separator], "<u4")
                at = 0
                for n in cuts(len(ids), capacity):
                    k = used[n] = used.get(n, -1) + 1
                    rows.append((at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), pid, k))
                    took.append(i)
                    at += n
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took)), *(pa.array(x, pa.int64()) for x in zip(*rows))], ["doc_id", *(n for n, _ in _PIECE)])

    cutted = cut(docs.select("doc_id", "text").mapInArrow(pieces, schema))
    placed = numbered(cutted, "_pid", "_idx", "length", "_at")
    a_bin = F.lit(capacity) / F.col("length")
    by_size = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    sizes = (
        cutted.groupBy("length")
        .agg(F.count("*").alias("_m"))
        .withColumn("_each", a_bin.cast("long"))
        .withColumn("_full", F.expr("_m div _each"))
        .withColumn("_first", F.coalesce(F.sum("_full").over(by_size), F.lit(0)))
        .withColumn("_rest_at", F.coalesce(F.sum(F.expr("(_m - _full * _each) * length")).over(by_size), F.lit(0)))
        .withColumn("_bins", F.sum("_full").over(Window.partitionBy(F.lit(0))))
    )
    out = placed.join(F.broadcast(sizes), "length")  # at most 1 + log2(capacity) rows
    rest = "(_rest_at + (_at - _full * _each) * length)"
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr(f"if(_at < _full * _each, _first + _at div _each, _bins + {rest} div {capacity})").alias("sequence_id"),
        F.expr(f"if(_at < _full * _each, _at % _each * length, {rest} % {capacity})").alias("offset"),
    )
