"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words: space and the ASCII controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where all share the machine's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/ledgerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    out, path = _written(df)
    if _OPEN:
        _OPEN[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def kept(df: DataFrame, by: str | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a stored table, and what deletes it.

    With ``by`` it is bucketed by that column into as many buckets as shuffles have
    partitions, so that a join on the column moves the other side alone, and written
    for size.
    """
    spark = df.sparkSession
    if by is None:
        out, path = _written(df)
        return out, lambda: _delete(spark, path)
    name = f"ledgerloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).option("compression", "zstd").option("parquet.writer.version", "v2").saveAsTable(name)

    def delete() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)

    return spark.table(name), delete


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that is done are deleted at once; for jobs whose rows are stored and not asked for again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def in_turn(spark: SparkSession, docs: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``docs`` through steps, each on the rows that the one before wrote.

    What a step stored for itself is deleted with its end, and its own rows
    once the next step has written its.
    """
    before = None
    for step in steps:
        with scratch(spark):
            docs, path = _written(step(docs))
        if before:
            _delete(spark, before)
        before = path
    return docs


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_hash(df: DataFrame, seed: int) -> Column:
    """Hash of all columns of a row; nulls are told from empty values.  Maps, which have no hash, are left out."""
    names = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    cols = [F.col(f"`{c}`") for c in names]
    return F.xxhash64(F.lit(seed), F.concat(F.lit(""), *[F.isnull(c).cast("int").cast("string") for c in cols]), *cols)


def words_of(text: Column) -> Column:
    """Words of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
