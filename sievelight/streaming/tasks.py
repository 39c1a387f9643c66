"""Streams: crawl-task events to the latest state of each task, and batches of pages into the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last event of each key; in a stream use with outputMode("complete") or update."""
    values = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max(F.struct(time, tie, *(c for c in values if c not in (time, tie)))).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in values))


def progress(events: DataFrame, key: str, done: Column, failed: Column, cap: float = 0.95) -> DataFrame:
    """Per task: events, those done and failed, and the share done, capped until nothing is left."""
    n, ready = F.count(F.lit(1)), F.count_if(done)
    share = F.when(ready == n, 1.0).otherwise(F.least(F.lit(cap), ready / n))
    return events.groupBy(key).agg(n.alias("n_events"), ready.alias("n_done"), F.count_if(failed).alias("n_failed"), share.alias("share"))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per tumbling window and kind; events later than ``late`` behind the newest are dropped in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def once_each(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def contextual(turns: DataFrame, session: str, order: str, text: str, pronoun: str = r"^(?:it|this|that|they|these|those|那|这|它|上面|刚才)\b?") -> DataFrame:
    """``turns`` with ``context``: a turn that begins with a pronoun is put behind the turn before it in its session."""
    from pyspark.sql import Window

    before = F.lag(text).over(Window.partitionBy(session).orderBy(order))
    follows = F.rlike(F.lower(F.trim(F.col(text))), F.lit(pronoun)) & before.isNotNull()
    return turns.withColumn("context", F.when(follows, F.concat_ws(" ", before, text)).otherwise(F.col(text)))


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Feeds each micro-batch to ``write(batch, batch_id)``, which must be idempotent per batch id; restarts from ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
