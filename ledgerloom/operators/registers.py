"""Register views over cases: invoices, purchase orders, vendors; search and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.model import CLEAN_TYPE
from ledgerloom.operators.analytics import is_exception, money
from ledgerloom.sources import store


def is_cleared() -> Column:
    """Clean by type or by status."""
    return F.coalesce(F.col("exception_type") == CLEAN_TYPE, F.lit(False)) | F.coalesce(F.col("status") == "cleared", F.lit(False))


def recent(cases: DataFrame, n: int = 8) -> DataFrame:
    return cases.filter(is_exception()).orderBy(F.desc("created_at"), "exception_id").limit(n)


def invoice_rows(cases: DataFrame) -> DataFrame:
    """A row per case with ``cleared``, ``analysed`` and how many cases share its invoice id."""
    rows = cases.withColumn("duplicate_count", F.count(F.lit(1)).over(Window.partitionBy("invoice_id")))
    return rows.withColumns({"cleared": is_cleared(), "analysed": F.col("exception_type").isNotNull(), "financial_impact": F.when(is_exception(), F.col("financial_impact"))})


def invoice_filter(rows: DataFrame, which: str) -> DataFrame:
    """Rows of ``invoice_rows``: exceptions, cleared, unanalysed or all."""
    keep = {"exceptions": F.col("analysed") & ~F.col("cleared"), "cleared": F.col("cleared"), "unanalysed": ~F.col("analysed"), "all": F.lit(True)}
    return rows.filter(keep[which])


def invoice_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col("invoice_amount"))).cast("double").alias("invoiced"), F.sum(money(F.col("financial_impact"))).cast("double").alias("impact"))


def po_rows(cases: DataFrame) -> DataFrame:
    """A row per purchase order as written: billed and ordered amounts and statuses; ``po_invoices`` has its invoices."""
    place = F.struct("created_at", "exception_id")
    rows = cases.filter(F.coalesce(F.col("purchase_order_id"), F.lit("")) != "")
    rows = rows.select("purchase_order_id", "created_at", "exception_id", "vendor_id", "invoice_id", "invoice_amount", "po_amount", "exception_type", "status").repartition("purchase_order_id")
    # Different vendors and invoices are told by the first row of each, where the order's rows have moved together: counts of several different columns would move each row once more for each.
    fresh = lambda c: F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy("purchase_order_id", c).orderBy("exception_id")) == 1)
    rows = rows.withColumn("new_vendor", fresh("vendor_id")).withColumn("new_invoice", fresh("invoice_id"))
    rows = rows.groupBy("purchase_order_id").agg(
        F.count(F.lit(1)).alias("invoice_count"), F.sum(money(F.col("invoice_amount"))).cast("double").alias("billed_amount"),
        F.min(F.when(F.col("po_amount") > 0, F.struct(place.alias("place"), F.col("po_amount").alias("v")))).alias("first"),
        F.count_if(is_exception()).alias("exception_count"), F.count_if("new_vendor").alias("vendor_count"), F.array_sort(F.collect_set("status")).alias("statuses"),
        (F.count(F.lit(1)) - F.count_if("new_invoice")).alias("repeated_invoices"),
    )
    rows = rows.withColumn("ordered_amount", F.col("first.v")).drop("first")
    return rows.withColumn("over_billed", F.col("billed_amount") > F.col("ordered_amount") + 0.01)


def po_invoices(cases: DataFrame) -> DataFrame:
    """The invoices of each purchase order, a row each."""
    return cases.filter(F.coalesce(F.col("purchase_order_id"), F.lit("")) != "").select("purchase_order_id", "created_at", "exception_id", "invoice_id", "invoice_amount")


def po_filter(rows: DataFrame, which: str, status: str | None = None, search: str = "", invoices: DataFrame | None = None) -> DataFrame:
    """Orders that are overbilled, billed more than once or have exceptions, by status, by order or invoice number (of ``po_invoices``)."""
    keep = {"overbilled": F.col("over_billed"), "multi": F.col("invoice_count") > 1, "exceptions": F.col("exception_count") > 0, "all": F.lit(True)}
    rows = rows.filter(keep[which])
    if status:
        rows = rows.filter(F.array_contains("statuses", status))
    if search:
        by_order = F.lower("purchase_order_id").contains(search.lower())
        if invoices is None:
            return rows.filter(by_order)
        hits = invoices.filter(F.lower("invoice_id").contains(search.lower())).select("purchase_order_id").distinct().withColumn("_hit", F.lit(True))
        rows = rows.join(hits, "purchase_order_id", "left").filter(by_order | F.col("_hit").isNotNull()).drop("_hit")
    return rows


def po_totals(rows: DataFrame) -> DataFrame:
    """Ordered value over the orders that state one, how many those are, and billed value."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ordered_amount").cast("decimal(18,2)")).cast("double").alias("ordered"), F.count("ordered_amount").alias("known"), F.sum(money(F.col("billed_amount"))).cast("double").alias("billed"),
    )


def vendor_filter(rows: DataFrame, band: str | None = None, search: str = "") -> DataFrame:
    if band:
        rows = rows.filter(F.col("risk_band") == band)
    return rows.filter(F.lower("vendor_name").contains(search.lower())) if search else rows


def vendor_sort(rows: DataFrame, key: str) -> DataFrame:
    """By name ascending, or by a number descending where null counts as 0."""
    return rows.orderBy("vendor_name", "vendor_id") if key == "vendor_name" else rows.orderBy(F.coalesce(F.col(key), F.lit(0)).desc(), "vendor_id")


def vendor_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("vendors"), F.sum(money(F.col("value_at_risk"))).cast("double").alias("value_at_risk"), F.count_if(F.col("risk_band") == "high").alias("high_count"), F.sum("invoice_count").alias("invoices"),
    )


def queue_filter(cases: DataFrame, outcome: str = "all", status: str | None = None, search: str = "", fields: tuple[str, ...] = ("vendor_name", "invoice_id", "exception_type", "purchase_order_id", "exception_id")) -> DataFrame:
    """Outcome (exceptions, cleared, all), status and a substring of any of ``fields``."""
    if outcome != "all":
        cases = cases.filter(is_exception() if outcome == "exceptions" else is_cleared())
    if status:
        cases = cases.filter(F.col("status") == status)
    if search:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(F.col(f)).contains(search.lower()), F.lit(False))
        cases = cases.filter(hit)
    return cases


def search(rows: DataFrame, needle: str, fields: list[str], n: int = 20, bonus: Column | None = None) -> DataFrame:
    """Top rows by the best field: 1000 for a prefix, else 500 less the place of the match."""

    def score(c: str) -> Column:
        at = F.coalesce(F.locate(needle.lower(), F.lower(F.col(c))), F.lit(0))
        return F.when(at == 1, 1000).when(at > 1, 501 - at).otherwise(0)

    best = F.greatest(*map(score, fields)) if len(fields) > 1 else score(fields[0])
    rows = rows.withColumn("score", best.cast("long")).filter("score > 0")
    if bonus is not None:
        rows = rows.withColumn("score", F.col("score") + bonus)
    return rows.orderBy(F.desc("score"), "exception_id").limit(n)


def register_sort(rows: DataFrame, key: str, descending: bool = False, tie: str = "exception_id") -> DataFrame:
    """Nulls come last in either direction; numbers by size, text by the root locale's order (case and accents last), not by bytes."""
    c = F.collate(F.col(key), "UNICODE") if dict(rows.dtypes)[key].startswith("string") else F.col(key)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def placed(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted table with their ``place``, from 1: rows are counted by partition, then within it.

    The sorted rows are written first, since another sort could cut its partitions elsewhere.
    """
    spark = ordered.sparkSession
    path = store.fresh_path(spark)
    store.write_packed(ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    out = rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.withColumn("place", F.col("_before") + F.col("_id") - F.shiftleft("_part", 33) + 1).drop("_id", "_part", "_before")


def status_options(cases: DataFrame) -> DataFrame:
    return cases.select("status").filter("status is not null").distinct().orderBy("status")


def bubble_scale(rows: DataFrame) -> DataFrame:
    """Value at risk on a log scale from 0 to 1, for charts."""
    top = rows.agg(F.max("value_at_risk").alias("_top"))  # one row
    return rows.join(F.broadcast(top)).withColumn("scale", F.round(F.try_divide(F.log1p("value_at_risk"), F.log1p("_top")), 6)).drop("_top")
