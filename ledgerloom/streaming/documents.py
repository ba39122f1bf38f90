"""The processing of documents as a state machine, over a table of changes or a stream of them.

``changes``: ``document_id, changed_at, state``.  A document is queued, then
processed, and ends completed or failed; a failed one may be processed again.
Whoever reports a state is believed, but a move that the machine does not know is
flagged.  A document that has been processing for longer than ``patience`` counts
as failed from then on (``timed_out``), so that it may be tried again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# States and the moves between them; None is a document nobody has heard of.
STATES = ("queued", "processing", "completed", "failed")
MOVES = ((None, "queued"), ("queued", "processing"), ("processing", "completed"), ("processing", "failed"), ("failed", "processing"))
MOVED = "document_id string, changed_at timestamp, previous string, state string, legal boolean, timed_out boolean, attempt long"


def legal(previous: Column, state: Column) -> Column:
    known = [(previous.isNull() if a is None else previous == a) & (state == b) for a, b in MOVES]
    out = known[0]
    for k in known[1:]:
        out = out | k
    return F.coalesce(out, F.lit(False))


def _kept(changes: DataFrame) -> DataFrame:
    """One change a document and instant; of several the last in order of the states."""
    known = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    rows = changes.filter(F.col("document_id").isNotNull() & F.col("changed_at").isNotNull() & F.col("state").isNotNull())
    return rows.groupBy("document_id", "changed_at").agg(F.max_by("state", F.struct(known, F.col("state"))).alias("state"))


def moves(changes: DataFrame, patience: timedelta, as_of: datetime | None = None) -> DataFrame:
    """All moves of a table of changes, those by time-out included; ``as_of`` ends the wait for documents without a later change."""
    rows = _kept(changes)
    by_time = Window.partitionBy("document_id").orderBy("changed_at")
    rows = rows.withColumns({"before": F.lag("state").over(by_time), "since": F.lag("changed_at").over(by_time), "next": F.lead("changed_at").over(by_time)})
    due = F.col("changed_at") + F.lit(patience)
    end = F.coalesce("next", F.lit(as_of).cast(rows.schema["changed_at"].dataType))
    late = (F.col("state") == "processing") & (end > due)
    expired = (F.col("before") == "processing") & (F.col("changed_at") > F.col("since") + F.lit(patience))
    own = F.struct(F.col("changed_at").alias("changed_at"), F.when(expired, F.lit("failed")).otherwise(F.col("before")).alias("previous"), F.col("state").alias("state"), F.lit(False).alias("timed_out"))
    timed = F.struct(due.alias("changed_at"), F.lit("processing").alias("previous"), F.lit("failed").alias("state"), F.lit(True).alias("timed_out"))
    out = rows.select("document_id", F.explode(F.array_compact(F.array(own, F.when(late, timed)))).alias("m")).select("document_id", "m.*")
    attempt = F.sum((F.col("state") == "processing").cast("long")).over(Window.partitionBy("document_id").orderBy("changed_at", F.col("timed_out").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.select("document_id", "changed_at", "previous", "state", legal(F.col("previous"), F.col("state")).alias("legal"), "timed_out", attempt.alias("attempt"))


class _Machine(StatefulProcessor):
    """Last state, its time and the attempts of a document; a timer while it is processing."""

    def __init__(self, patience: timedelta):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, at timestamp, attempt long")

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _timer(self, at: datetime) -> None:
        self.handle.registerTimer(int(pd.Timestamp(at, tz="UTC").timestamp() * 1000) if pd.Timestamp(at).tz is None else int(pd.Timestamp(at).timestamp() * 1000))

    def _moved(self, key: str, at: datetime, previous: str | None, state: str, timed_out: bool, attempt: int) -> tuple:
        return key, at, previous, state, (previous, state) in MOVES, timed_out, attempt

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        (name,) = key
        state, since, attempt = self.last.get() if self.last.exists() else (None, None, 0)
        changes = pd.concat(list(rows)).dropna(subset=["changed_at", "state"])
        rank = changes["state"].map(lambda s: STATES.index(s) + 1 if s in STATES else 0)
        changes = changes.assign(rank=rank).sort_values(["changed_at", "rank", "state"]).drop_duplicates("changed_at", keep="last")
        out = []
        for at, new in zip(changes["changed_at"], changes["state"], strict=True):
            if state == "processing" and at > pd.Timestamp(since) + self.patience:
                due = pd.Timestamp(since) + self.patience
                out.append(self._moved(name, due, state, "failed", True, attempt))
                state = "failed"
            attempt += new == "processing"
            out.append(self._moved(name, at, state, new, False, attempt))
            state, since = new, at
        if not out:
            return
        self._forget_timers()
        if state == "processing":
            self._timer(pd.Timestamp(since) + self.patience)
        self.last.update((state, pd.Timestamp(since).to_pydatetime(), int(attempt)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MOVED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        (name,) = key
        state, since, attempt = self.last.get()
        due = pd.Timestamp(since) + self.patience
        if state != "processing":
            return
        self.last.update(("failed", due.to_pydatetime(), attempt))
        yield pd.DataFrame([self._moved(name, due, state, "failed", True, attempt)], columns=[c.split()[0] for c in MOVED.split(", ")])

    def close(self) -> None:
        pass


def moves_of_stream(changes: DataFrame, patience: timedelta, late: str = "1 hour") -> DataFrame:
    """The moves of a stream, as they come; time-outs come when the watermark (``late`` behind the newest change) has passed them.

    A document's changes are taken in order within a batch, and batches in turn.  The
    session needs the RocksDB state store (``with_state_store``).
    """
    rows = changes.withWatermark("changed_at", late).select("document_id", "changed_at", "state").filter("document_id is not null")
    return rows.groupBy("document_id").transformWithStateInPandas(statefulProcessor=_Machine(patience), outputStructType=MOVED, outputMode="append", timeMode="eventTime")


def with_state_store(spark) -> None:  # noqa: ANN001
    """Use the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_moves(changes: DataFrame, path: str, checkpoint: str, patience: timedelta, late: str = "1 hour") -> StreamingQuery:
    """Append the moves of a stream to a table; what was read is told by the checkpoint, so a restart goes on."""
    out = moves_of_stream(changes, patience, late)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
