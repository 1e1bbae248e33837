"""Byte sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``object_id`` (path), ``content`` of every readable file under ``path``; Spark passes over empty files."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true")
    return read.load(path).select(F.col("path").alias("object_id"), "content")


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``content`` of files as they arrive."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
