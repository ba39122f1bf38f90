"""Document states, the mail hand-over, changes in place, scan cost and bound statements over derived tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import statements as S
from ledgerloom.plans.analytics_queries import _VENDOR_COLUMNS
from ledgerloom.plans.ledger import AS_OF, CASES, cases, derived_cases
from ledgerloom.plans.registry import ORACLES, query
from ledgerloom.sources import partitions, store
from ledgerloom.streaming import documents, mail

_ORDER = "CAST(split_part(exception_id, '-', 2) AS BIGINT)"
PATIENCE = timedelta(hours=6)


def _order():  # noqa: ANN202
    return F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long")


@query("""WITH c AS (SELECT 'D' || user_id AS document_id, ts AS changed_at, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS state FROM events),
w AS (SELECT *, lag(state) OVER t AS before, lag(changed_at) OVER t AS since, lead(changed_at) OVER t AS after FROM c WINDOW t AS (PARTITION BY document_id ORDER BY changed_at)),
m AS (SELECT document_id, changed_at, CASE WHEN before = 'processing' AND changed_at > since + INTERVAL 6 HOUR THEN 'failed' ELSE before END AS previous, state, false AS timed_out FROM w UNION ALL
SELECT document_id, changed_at + INTERVAL 6 HOUR, 'processing', 'failed', true FROM w WHERE state = 'processing' AND coalesce(after, TIMESTAMP '2024-01-31') > changed_at + INTERVAL 6 HOUR)
SELECT *, coalesce((previous IS NULL AND state = 'queued') OR (previous = 'queued' AND state = 'processing') OR (previous = 'processing' AND state IN ('completed', 'failed')) OR (previous = 'failed' AND state = 'processing'), false) AS legal,
CAST(sum(CAST(state = 'processing' AS INT)) OVER (PARTITION BY document_id ORDER BY changed_at, timed_out ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM m""")
def document_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of documents: every move, whether the machine knows it, and time-outs."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", F.lit("queued")).when(kind == "view", F.lit("completed")).when(kind == "error", F.lit("failed")).otherwise(F.lit("processing"))
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("D"), "user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("changed_at"), state.alias("state"))
    end = spark.sql("SELECT TIMESTAMP '2024-01-31' AS t").first().t
    return documents.moves(changes, PATIENCE, end).withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@query("""SELECT 'MAIL-' || substr(sha256(m), 1, 24) AS exception_id, m AS message_id, 'Turn ' || m AS title, CAST(1 + turn % 2 AS INTEGER) AS attachment_count FROM (SELECT DISTINCT conv_id || '/' || turn AS m, turn, role FROM conversations) WHERE role = 'user' AND turn % 3 <> 1""")
def mail_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a mailbox, handed over in three passes, of which one breaks off before its marks: a case for every accepted message."""
    turn = F.col("turn").cast("int")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    files = F.when(turn % 3 == 1, F.array(F.lit("a.txt"))).when(turn % 2 == 1, F.array(F.lit("a.pdf"), F.lit("b.PDF"))).otherwise(F.array(F.lit("a.pdf")))
    box = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        name.alias("message_id"), F.concat("role", F.lit("@ok.com")).alias("sender"), F.concat(F.lit("Turn "), name).alias("subject"), F.lit(False).alias("seen"), files.alias("attachments"), F.timestamp_seconds(turn).alias("received_at"),
    )
    third = box.count() // 3 + 1
    at = store.fresh_path(spark)
    passes = [lambda **k: mail.poll_once(box, f"{at}/cases", f"{at}/marks", ["user@ok.com"], third, **k)] * 3

    def broken(messages: DataFrame) -> DataFrame:
        """Cases are written, then the pass ends without its marks."""
        mail.cases_of(messages).write.mode("append").parquet(f"{at}/cases")
        raise InterruptedError

    try:
        passes[0](create=broken)
    except InterruptedError:
        pass
    for handed in passes:
        handed()
    return spark.read.schema(mail.CASE).parquet(f"{at}/cases").select("exception_id", "message_id", "title", "attachment_count")


def _own_table(spark: SparkSession, sf_dir: str) -> str:
    """A case table of our own to change."""
    path = store.fresh_path(spark)
    origin = F.when(_order() % 7 == 0, F.lit("synthetic_portfolio")).when(_order() % 7 == 1, F.lit(None)).otherwise(F.lit("upload"))
    store.write_cases(derived_cases(spark, sf_dir).withColumn("origin", origin), path, by="month")
    return path


def _schema(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    return derived_cases(spark, sf_dir).schema


@query(f"""WITH {CASES} SELECT exception_id, CASE WHEN {_ORDER} % 10 = 0 THEN 'closed' ELSE status END AS status, CASE WHEN {_ORDER} % 50 = 0 THEN created_at + INTERVAL 40 DAY ELSE created_at END AS created_at FROM cases UNION ALL
SELECT exception_id || '-N', 'received', created_at FROM cases WHERE {_ORDER} % 77 = 0""")
def upserted_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after changes, of which some move a case to another month and some are new."""
    path, schema = _own_table(spark, sf_dir), _schema(spark, sf_dir)
    later = lambda c, days: F.col(c) + F.make_dt_interval(days=F.lit(days))
    table = store.read_cases(spark, path, schema=schema).drop("created_date")
    changed = table.filter(_order() % 10 == 0).withColumns({"status": F.lit("closed"), "updated_at": later("updated_at", 1), "created_at": F.when(_order() % 50 == 0, later("created_at", 40)).otherwise(F.col("created_at"))})
    new = table.filter(_order() % 77 == 0).withColumns({"exception_id": F.concat("exception_id", F.lit("-N")), "status": F.lit("received")})
    partitions.upsert_in_place(spark, path, changed.unionByName(new), schema=schema)
    table = store.read_cases(spark, path, schema=schema).drop("created_date")
    partitions.upsert_in_place(spark, path, table.filter(_order() % 9 == 0).withColumns({"status": F.lit("stale"), "updated_at": later("updated_at", -1)}), schema=schema)
    return store.read_cases(spark, path, schema=schema).select("exception_id", "status", "created_at")


@query(f"WITH {CASES} SELECT exception_id FROM cases WHERE {_ORDER} % 7 <> 0")
def purged_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after a dry run, which changes nothing, and the purge of one origin."""
    path, schema = _own_table(spark, sf_dir), _schema(spark, sf_dir)
    for dry_run in (True, False):
        partitions.purge_in_place(spark, path, "synthetic_portfolio", schema, dry_run)
    return store.read_cases(spark, path, schema=schema).select("exception_id")


@query(f"""WITH {CASES}, m AS (SELECT date_trunc('month', created_at) AS m FROM cases) SELECT count(DISTINCT m) AS whole_months, count(DISTINCT m) FILTER (m >= date_trunc('month', TIMESTAMP '2001-12-01' - INTERVAL 365 DAY)) AS window_months, true AS prunes FROM m""")
def scan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a year's window opens of the stored cases, by the files' own sizes."""
    table = cases(spark, sf_dir)
    told = partitions.scan_cost(table, AS_OF, 365)
    months = table.agg(F.count_distinct("created_date").alias("whole_months"), F.count_distinct(F.when(F.col("created_date") >= F.trunc((F.lit(AS_OF) - F.expr("INTERVAL 365 DAYS")).cast("date"), "MM"), F.col("created_date"))).alias("window_months"))
    return months.join(F.broadcast(told.select("prunes")))  # a row each


@query(ORACLES["portfolio_summary_90"])
def bound_portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.portfolio_summary(cases(spark, sf_dir), AS_OF, 90)


@query(ORACLES["vendor_risk"])
def bound_vendor_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vendor_risk(cases(spark, sf_dir), AS_OF).select(*_VENDOR_COLUMNS)


@query(ORACLES["monthly_trend"])
def bound_monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.monthly_trend(cases(spark, sf_dir), AS_OF)


@query(ORACLES["ageing_buckets"])
def bound_ageing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ageing_buckets(cases(spark, sf_dir), AS_OF)


@query(ORACLES["cross_case_value"])
def bound_cross_case_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cross_case_value(cases(spark, sf_dir), AS_OF)
