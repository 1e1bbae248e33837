"""Structured Streaming jobs; each is the same plan on a batch DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chunking, packing

MESSAGE = "type string, filename string, original_size bigint, chunk_count int, sender string, pattern string, weight bigint"


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """``user_id``, ``writes``, ``first``, ``last``: writes that follow each other within ``gap`` are one flush."""
    events = events.withWatermark("ts", delay) if delay else events
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("writes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("user_id", "writes", "first", "last")


def messages(lines: DataFrame) -> DataFrame:
    """Announcements and proposals from JSON lines ``value``; others and proposals without weight are dropped."""
    m = lines.select(F.from_json("value", MESSAGE).alias("m")).select("m.*")
    return m.where((F.col("type") == "announce") | ((F.col("type") == "propose") & (F.col("weight") > 0)))


def once(messages_: DataFrame, keys: list[str], delay: str | None = None) -> DataFrame:
    """Each message once: within the watermark ``delay`` of its ``ts`` in a stream, over all rows of a batch."""
    if messages_.isStreaming:
        return messages_.withWatermark("ts", delay or "10 minutes").dropDuplicatesWithinWatermark(keys)
    return messages_.dropDuplicates(keys)


def weights(lines: DataFrame) -> DataFrame:
    return messages(lines).where("type = 'propose'").groupBy("pattern").agg(F.sum("weight").alias("weight"), F.count("*").alias("messages"))


def pack_stream(files: DataFrame, book: DataFrame, out: str, checkpoint: str, chunk_size: int = 128):
    """Packs each micro-batch of binary files (``path``, ``content``) and appends its entries to ``out``."""

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunking.fixed(batch.select(F.col("path").alias("object_id"), "content"), chunk_size)
        packing.route(chunks, book, packing.PackOptions(mode="stream", chunk_size=chunk_size)).write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(mutations: DataFrame, out: str, checkpoint: str):
    """Appends mutations (``object_id``, ``seq``, ``ts``, ``payload``) as they come."""
    return mutations.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched(events: DataFrame, idle: str) -> DataFrame:
    """Keys with their last touch, kept while they are no longer idle than ``idle`` behind the watermark."""
    return events.withWatermark("ts", idle).groupBy("user_id", F.window("ts", idle)).agg(F.max("ts").alias("last"), F.count("*").alias("touches"))


def evictions(events: DataFrame, idle_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """``user_id``, ``touches``, ``last``: a key each time it is evicted, ``idle_seconds`` of event time after its
    last touch. State is one row a key, dropped with the eviction."""

    def row(key, touches: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "touches": [touches], "last": [pd.Timestamp(last, unit="us", tz="UTC").tz_localize(None)]})

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            yield row(key, *state.get)
            state.remove()
            return
        touches, last = state.get if state.exists else (0, 0)
        for at in sorted(int(x) for batch in batches for x in batch["ts"].astype("datetime64[us]").astype("int64")):
            if touches and at - last > idle_seconds * 1_000_000:  # it had been idle before this touch
                yield row(key, touches, last)
                touches = 0
            touches, last = touches + 1, max(last, at)
        state.update((touches, last))
        state.setTimeoutTimestamp(max(last // 1000 + 1000 * idle_seconds, state.getCurrentWatermarkMs() + 1))

    kind = events.schema["user_id"].dataType.simpleString()
    rows = events.withWatermark("ts", delay).select("user_id", "ts").groupBy("user_id")
    return rows.applyInPandasWithState(step, f"user_id {kind}, touches long, last timestamp", "touches long, last long", "append", GroupStateTimeout.EventTimeTimeout)


class Counters(StreamingQueryListener):
    """Totals over the batches of named streaming queries, by what ``observe`` collects under ``name``."""

    def __init__(self, name: str, on_progress=None):
        self.name, self.on_progress, self.totals = name, on_progress, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for k, v in row.asDict().items():
                self.totals[k] = self.totals.get(k, 0) + (v or 0)
            if self.on_progress:
                self.on_progress(dict(self.totals))

    def onQueryTerminated(self, event) -> None:
        pass


def counted(entries: DataFrame, name: str) -> DataFrame:
    """``entries`` that report chunks, bytes and residual bytes under ``name`` when they are computed, without a pass of their own."""
    return entries.observe(name, F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.sum("delta_size").alias("residual_bytes"))


def with_progress(entries: DataFrame) -> tuple[DataFrame, Observation]:
    """``entries`` of a batch, and the observation that has the same counts after its action."""
    seen = Observation()
    return entries.observe(seen, F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.sum("delta_size").alias("residual_bytes")), seen
