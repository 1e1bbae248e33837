"""Helpers that the training-data operators share: tables, checkpoints, scratch tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shuffles_dropped, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process (``local[n]``, as in
    tests) a temporary folder takes its place; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="bytestrata-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Seconds between two calls of ``settle`` that do something.
SETTLE_S = 10
_settled = [float("-inf")]


def settle(spark: SparkSession) -> None:
    """Hands back to the system what the driver's JVM has no use for: heap behind a collection, then what the
    C library keeps of freed memory (after many queries some 200 MB, by compiler arenas and threads that are gone).

    Steps of an iteration leave both behind, and neither shrinks by itself. A JVM that cannot trim is left alone.
    """
    if time.monotonic() - _settled[0] < SETTLE_S:
        return
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()

    def array(kind, *values):
        out = new(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        of = jvm.java.lang.Class.forName
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        call = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(of, kinds)))
        call.invoke(server, array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))
    except Py4JError:  # not on Linux, or an older JVM
        pass
    _settled[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)
    settle(df.sparkSession)
    return out


_scratch: set[str] = set()


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder (unlike a checkpoint, later reads prune
    its columns). The table stays until ``release`` or the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(release, spark)
    _scratch.add(path)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables; results that still read them must have been written."""
    while _scratch:
        path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM is gone: the folder's owner cleans up
            return


#: So many rows are broadcast at most; a larger side is dealt over ``SALTS`` copies of each key.
MOST_BROADCAST, SALTS = 200_000, 16


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, of which each key has one row; a hot key of ``left`` fills no single task.

    ``right`` must be cheap to read (written or cut): its rows are counted.
    """
    if right.limit((MOST_BROADCAST if most is None else most) + 1).count() <= (MOST_BROADCAST if most is None else most):
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, pid: str, idx: str, by: str, out: str) -> DataFrame:
    """``df`` with ``out``: a gapless number from 0 in each value of ``by``.

    ``df`` must be cut, with a local number ``idx`` in each (``pid``, ``by``). Only one
    row per partition and value is sorted, never the rows themselves.
    """
    n = df.groupBy(pid, by).agg((F.max(idx) + 1).alias("_n"))
    w = Window.partitionBy(by).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    base = n.select(pid, by, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return df.join(base, [pid, by]).withColumn(out, F.col("_base") + F.col(idx)).drop("_base")


_NO_LETTER = re.compile(r"[\W\d_]")


def blocks(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut where no letter stands, so that no word is split."""
    at = 0
    while at < len(text):
        cut_at = _NO_LETTER.search(text, at + size) if at + size < len(text) else None
        end = cut_at.end() if cut_at else len(text)
        yield text[at:end]
        at = end


def words_sql(text: str) -> str:
    """SQL for the words ``[^\\x20\\x09-\\x0D]+`` of a text, none where it is null."""
    return rf"""array_remove(split(translate(coalesce({text}, ''), '\t\n\u000b\u000c\r', '     '), ' '), '')"""
