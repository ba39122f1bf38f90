"""Mail hand-over at least once: every accepted message becomes one case, whatever fails in between.

A mailbox is a table of messages and a table of marks, the ids of those that were
handed over.  A pass takes the oldest unmarked messages up to a limit, writes their
cases, and marks them only then: an unmarked message comes again, a lost one
doesn't.  A case's id follows from its message, and a pass writes no case that is
there already, so a pass that was broken off between its two writes doubles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.keys import title
from ledgerloom.sources import store
from ledgerloom.streaming.feeds import accepted_mail

MESSAGE = "message_id string, sender string, subject string, seen boolean, attachments array<string>, received_at timestamp"
CASE = "exception_id string, message_id string, title string, sender string, attachment_count int, created_at timestamp"
MARK = "message_id string"


def cases_of(messages: DataFrame) -> DataFrame:
    """A case for each message; its id is made of the message's."""
    return messages.select(
        F.concat(F.lit("MAIL-"), F.substring(F.sha2("message_id", 256), 1, 24)).alias("exception_id"), "message_id", title(F.col("subject")).alias("title"), "sender",
        F.size(F.filter("attachments", lambda x: F.lower(x).endswith(".pdf"))).alias("attachment_count"), F.col("received_at").alias("created_at"),
    )


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table, or none of its rows where nothing was written yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(ddl).parquet(path)
    return spark.createDataFrame([], ddl)


def mark(handed: DataFrame, marks: str) -> None:
    handed.select("message_id").write.mode("append").parquet(marks)


def poll_once(messages: DataFrame, cases: str, marks: str, allowed: list[str], limit: int, create: Callable[[DataFrame], DataFrame] = cases_of) -> int:
    """One pass over a mailbox: how many messages it handed over.

    ``create`` gives the cases of messages, or none for those to be tried again later.
    Passes over one mailbox are run one after the other.
    """
    spark = messages.sparkSession
    once = messages.dropDuplicates(["message_id"]).join(_read(spark, marks, MARK), "message_id", "left_anti")
    # The pass's messages are written down, so that both writes are of the same ones.
    path = store.fresh_path(spark)
    accepted_mail(once, allowed, limit).write.parquet(path)
    taken = spark.read.schema(once.schema).parquet(path)
    made = create(taken)
    made.join(_read(spark, cases, CASE).select("exception_id"), "exception_id", "left_anti").write.mode("append").parquet(cases)
    handed = taken.join(_read(spark, cases, CASE).select("message_id"), "message_id", "left_semi")
    n = handed.count()
    mark(handed, marks)
    return n


def hand_over(messages: DataFrame, mailbox: str, cases: str, marks: str, checkpoint: str, allowed: list[str], limit: int) -> StreamingQuery:
    """Each batch of a stream of messages goes into the mailbox, then there is a pass over it.

    A batch that comes again after a failure replaces what it had put there.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{mailbox}/batch={batch_id}")
        poll_once(batch.sparkSession.read.schema(MESSAGE).parquet(mailbox).drop("batch"), cases, marks, allowed, limit)

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
