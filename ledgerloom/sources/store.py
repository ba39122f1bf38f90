"""Reading and writing of cases, documents and audit events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.keys import blank_to_null
from ledgerloom.model import CASE, DEFAULT_WORKSPACE, DOCUMENT

KEY = "exception_id"
#: Stored tables of this process: (application, name) to path.
_STORED: dict[tuple[str, str], str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/ledgerloom-{uuid.uuid4().hex}"


#: Spark's setting for shuffle files that go when their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def write_packed(rows: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Write a table of our own: small on disk, without shuffle files that outlive the write."""
    with tidy(rows.sparkSession):
        writer = rows.write.mode(mode).option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the work folder and read back: worked out once, whatever is asked of them, and a short plan after."""
    path = fresh_path(rows.sparkSession)
    write_packed(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_by_month(rows: DataFrame, path: str, sort: Sequence[str], lots: int = 4) -> None:
    """Write ``rows`` by their ``created_date``, files by size, sorted within them: what brings a month together moves a lot of the months at a time.

    The rows are worked out into lots first, which go as soon as they are dealt out.
    """
    spark, staged = rows.sparkSession, fresh_path(rows.sparkSession)
    lot = F.coalesce(F.pmod(F.year("created_date") * 12 + F.month("created_date"), F.lit(lots)), F.lit(0))
    write_packed(rows.withColumn("_lot", lot), staged, "_lot")
    schema = T.StructType([*rows.schema.fields, T.StructField("_lot", T.IntegerType())])
    for k in range(lots):
        part = spark.read.schema(schema).parquet(staged).filter(F.col("_lot") == k).drop("_lot")
        write_packed(part.hint("rebalance", "created_date").sortWithinPartitions("created_date", *sort), path, "created_date", mode="append")
        delete(spark, f"{staged}/_lot={k}")
    delete(spark, staged)


def once(spark: SparkSession, name: str, write) -> str:
    """Path of a table that ``write(path)`` makes the first time that this application asks for ``name``."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = fresh_path(spark)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records: one a line, which many tasks share, or a single value (a list, or an object that holds one), which is one task's a file."""
    lines = spark.read.json(path)
    return lines if KEY in lines.columns else spark.read.json(path, multiLine=True)


def read_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Seed cases with nested documents, a line each or as a list: cases, and documents with their case's id."""
    raw = _records(spark, path)
    cases = raw.select(F.explode("cases").alias("c")).select("c.*") if "cases" in raw.columns else raw
    if "documents" not in cases.columns:
        return cases, spark.createDataFrame([], DOCUMENT)
    documents = cases.select(KEY, F.explode("documents").alias("d")).select(KEY, *[F.col(f"d.{c}") for c in cases.schema["documents"].dataType.elementType.names if c != KEY])
    return cases.drop("documents"), documents


def read_cases_json(spark: SparkSession, path: str) -> DataFrame:
    """Cases a line each, or of a JSON file that is a list or ``{"cases": […]}``; anything else is an error."""
    raw = _records(spark, path)
    rows = raw.select(F.explode("cases").alias("c")).select("c.*") if raw.columns == ["cases"] else raw
    if KEY not in rows.columns:
        raise ValueError(f"{path} holds no list of cases")
    return rows


def flat_rows(records: DataFrame) -> DataFrame:
    """Records as the flat case table: casts that give null on bad text, '' as null, unknown columns dropped."""
    have = set(records.columns)

    def column(f) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        return (blank_to_null(c.cast("string")) if f.dataType.simpleString() == "string" else c.cast("string").try_cast(f.dataType)).alias(f.name)

    return records.select(*map(column, CASE))


def merge_if_absent(base: DataFrame, more: DataFrame, key: str = KEY) -> DataFrame:
    """``base`` and those rows of ``more`` whose key it lacks."""
    return base.unionByName(more.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def _unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def upsert(current: DataFrame, changes: DataFrame, key: str = KEY, updated: str = "updated_at") -> DataFrame:
    """Latest row of each key; a change wins a tie."""
    new, rank = _unused("_new", current, changes), _unused("_rank", current, changes)
    both = current.withColumn(new, F.lit(0)).unionByName(changes.withColumn(new, F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(updated).desc_nulls_last(), F.desc(new))
    return both.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank, new)


def merge_fields(current: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = KEY) -> DataFrame:
    """``current`` with the non-null ``fields`` of ``changes`` laid over it; a row per key in ``changes``."""
    names = {f: _unused(f"_{f}", current, changes) for f in fields}
    out = current.join(changes.select(F.col(key), *[F.col(f).alias(n) for f, n in names.items()]), key, "left")
    return out.withColumns({f: F.coalesce(n, f) for f, n in names.items()}).drop(*names.values())


def write_cases(cases: DataFrame, path: str, by: str = "day") -> None:
    """Replace the case table: by day (or month) of creation, files by size, sorted by vendor and type within them.

    Empty input is an error.
    """
    if cases.isEmpty():
        raise ValueError("refusing to replace the case table by nothing")
    day = F.to_date("created_at")
    rows = cases.withColumn("created_date", day if by == "day" else F.trunc(day, "MM"))
    rows = rows.hint("rebalance", "created_date").sortWithinPartitions("created_date", "vendor_id", "exception_type")
    rows.write.mode("overwrite").partitionBy("created_date").parquet(path)


def read_cases(spark: SparkSession, path: str, since: str | None = None, keep_undated: bool = True, schema: T.StructType = CASE) -> DataFrame:
    """The case table, its days before ``since`` pruned; undated rows are a partition of their own.

    Its partition column stays, so that windows of days can prune later too.
    """
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("created_date", T.DateType())])).parquet(path)
    if since is not None:
        recent = F.col("created_date") >= F.lit(since).cast("date")
        rows = rows.filter(recent | F.col("created_date").isNull() if keep_undated else recent)
    return rows


def verify(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def purge_count(cases: DataFrame, origin: str = "synthetic") -> DataFrame:
    """How many rows ``purge`` would take and leave."""
    goes = F.coalesce(F.col("origin") == origin, F.lit(False))
    return cases.agg(F.count_if(goes).alias("purged"), F.count_if(~goes).alias("kept"))


def purge(cases: DataFrame, origin: str = "synthetic") -> DataFrame:
    """The rows that stay when those of an origin go; rows without an origin stay."""
    return cases.filter(F.coalesce(F.col("origin") != origin, F.lit(True)))


def in_workspace(workspace: str, default_missing: bool = False) -> Column:
    """Tenancy: plain equality, or a missing workspace counts as the default one."""
    c = F.coalesce(F.col("workspace_id"), F.lit(DEFAULT_WORKSPACE)) if default_missing else F.col("workspace_id")
    return c == workspace


def one_case(cases: DataFrame, exception_id: str, workspace: str) -> DataFrame:
    """A case by key; another tenant's is as absent as one that doesn't exist."""
    return cases.filter((F.col(KEY) == exception_id) & in_workspace(workspace))


def documents_of(documents: DataFrame, exception_id: str) -> DataFrame:
    return documents.filter(F.col(KEY) == exception_id)


def some_cases(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cases of many keys at once: those whose id and workspace both stand in ``wanted``."""
    return cases.join(wanted.select(KEY, "workspace_id"), [KEY, "workspace_id"], "left_semi")


def documents_of_some(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    return documents.join(wanted.select(KEY), KEY, "left_semi")


def public_view(cases: DataFrame) -> DataFrame:
    return cases.drop("matching_input")


def write_json(rows: DataFrame, path: str) -> None:
    """Newline-delimited JSON."""
    rows.write.mode("overwrite").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def audit_of(events: DataFrame, exception_id: str) -> DataFrame:
    return events.filter(F.col(KEY) == exception_id).orderBy("timestamp", "event_id")
