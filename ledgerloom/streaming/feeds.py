"""Structured Streaming counterparts: audit trail, windowed ageing, case state, intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.keys import sender_allowed


def audit_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append audit events to a table as they come."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and values by window and kind; events later than ``late`` are left out. Batch frames work too."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", user: str = "user_id", time: str = "ts") -> DataFrame:
    """Sessions of each user: runs of events with gaps below ``gap``."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), "n")


def latest_state(changes: DataFrame, checkpoint: str, apply: object, key: str = "document_id", version: str = "changed_at") -> StreamingQuery:
    """Hand the latest change of each key of a batch to ``apply(batch, id)``; it should upsert, so that replays agree."""

    def each(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in batch.columns if c != key]
        apply(batch.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("s")).select(key, "s.*"), batch_id)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted_mail(messages: DataFrame, allowed: list[str], limit: int | None = None) -> DataFrame:
    """Unread messages of allowed senders that carry a PDF; ``limit`` caps a batch, oldest first."""
    pdf = F.exists("attachments", lambda x: F.lower(x).endswith(".pdf"))
    rows = messages.filter(~F.col("seen") & sender_allowed(F.col("sender"), allowed) & pdf)
    return rows.orderBy("received_at", "message_id").limit(limit) if limit is not None and not rows.isStreaming else rows
