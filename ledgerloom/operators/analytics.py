"""The portfolio analytics over a ``cases`` DataFrame (see ``ledgerloom.model.CASE``).

Each takes an explicit ``as_of``; a window of ``days`` keeps rows without a
date.  Money is summed as DECIMAL(38,2), so results don't depend on the order of
addition.  All are one grouped pass over the cases.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import age_bucket, age_days, month_key
from ledgerloom.functions.keys import blank_to_null, vendor_key
from ledgerloom.functions.variance import risk_band
from ledgerloom.model import AGE_BUCKETS, CLEAN_SCORE, CLEAN_TYPE, CROSS_CASE_TYPES, MAX_DAYS, MAX_MONTHS, MAX_VENDORS, OPEN_STATUSES, SLA_DAYS, clamp

EXCEPTION = "exception_type is not null and exception_type not in ('', 'no_exception')"


def is_exception() -> Column:
    return F.coalesce(F.expr(EXCEPTION), F.lit(False))


def is_open() -> Column:
    return is_exception() & F.coalesce(F.col("status").isin(*OPEN_STATUSES), F.lit(False))


def money(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast("decimal(18,2)")


def total(c: Column, where: Column | None = None) -> Column:
    """Sum of money, 0 over no rows."""
    value = money(c) if where is None else F.when(where, money(c))
    return F.coalesce(F.sum(value), F.lit(0).cast("decimal(28,2)"))


def rate(n: Column, d: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(n, d), places), F.lit(0.0)).cast("double")


def scoped(cases: DataFrame, as_of: datetime, days: int | None, workspace: str | None = None) -> DataFrame:
    """Rows of a workspace that are undated or not older than ``days``; all dates if ``days`` is None or 0."""
    if workspace is not None:
        cases = cases.filter(F.col("workspace_id") == workspace)
    if days:
        since = F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
        cases = cases.filter(F.col("created_at").isNull() | (F.col("created_at") >= since))
        if "created_date" in cases.columns:  # the stored table's partition: a day, or the first of a month
            cases = cases.filter(F.col("created_date").isNull() | (F.col("created_date") >= F.trunc(since.cast("date"), "MM")))
    return cases


def _vendor() -> Column:
    return F.coalesce(blank_to_null(F.col("vendor_id")), blank_to_null(F.col("vendor_name")), F.lit("unknown"))


def vendor_types(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """``vendor_id, exception_type, n, type_rank``: a vendor's types, most frequent first, ties by name."""
    n = scoped(cases, as_of, days, workspace).filter(EXCEPTION).groupBy(_vendor().alias("vendor_id"), "exception_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("type_rank", F.row_number().over(Window.partitionBy("vendor_id").orderBy(F.desc("n"), "exception_type")))


def vendor_top_type(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """The most frequent exception type of each vendor."""
    return vendor_types(cases, as_of, days, workspace).filter("type_rank = 1").select("vendor_id", F.col("exception_type").alias("top_exception_type"), "n")


def vendor_measures(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """All measures of every vendor, in two grouped steps on the vendor key.

    The first step counts by vendor and type, so the second has the types at hand
    and no join is needed; it sees a row per vendor and type.
    """
    rows = scoped(cases, as_of, days, workspace).withColumn("vendor_id", _vendor())
    first = lambda c: F.min(F.when(blank_to_null(F.col(c)).isNotNull(), F.struct("created_at", "exception_id", F.col(c).alias("v"))))
    by_type = rows.groupBy("vendor_id", F.when(is_exception(), F.col("exception_type")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), total(F.col("invoice_amount")).alias("invoiced"), total(F.col("financial_impact"), is_open()).alias("at_risk"),
        F.sum("match_score").alias("score_sum"), F.count("match_score").alias("score_n"),
        F.sum(F.when(is_open(), age_days(F.col("created_at"), F.lit(as_of)).cast("decimal(28,9)"))).alias("age_sum"), F.count(F.when(is_open(), F.col("created_at"))).alias("age_n"),
        first("vendor_name").alias("name"), first("business_unit").alias("unit"),
    )
    kinds = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "kind"))), lambda x: x["kind"].isNotNull())
    out = by_type.groupBy("vendor_id").agg(
        F.sum("n").alias("invoice_count"), F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)).alias("exception_count"),
        F.sum("invoiced").alias("invoiced_value"), F.sum("at_risk").alias("value_at_risk"), F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"),
        F.sum("age_sum").alias("age_sum"), F.sum("age_n").alias("age_n"), F.min("name").alias("name"), F.min("unit").alias("unit"), kinds.alias("kinds"),
    )
    exact_rate = F.col("exception_count") / F.col("invoice_count")
    return out.select(
        "vendor_id", F.coalesce("name.v", F.lit("Unknown vendor")).alias("vendor_name"), F.col("unit.v").alias("business_unit"),
        F.col("invoice_count").cast("long").alias("invoice_count"), F.col("exception_count").cast("long").alias("exception_count"),
        rate(F.col("exception_count"), F.col("invoice_count")).alias("exception_rate"),
        F.col("value_at_risk").cast("double").alias("value_at_risk"), F.col("invoiced_value").cast("double").alias("invoiced_value"),
        F.get("kinds", F.lit(0))["kind"].alias("top_exception_type"),
        F.transform("kinds", lambda x: F.struct(x["kind"].alias("exception_type"), (-x["minus_n"]).alias("n"))).alias("recurring_types"),
        F.round(F.try_divide("score_sum", "score_n"), 1).cast("double").alias("average_match_score"),
        F.coalesce(F.round(F.try_divide("age_sum", "age_n"), 1), F.lit(0)).cast("double").alias("average_open_age_days"),
        risk_band(exact_rate, F.col("value_at_risk")).alias("risk_band"),
    )


# Sentences of the reports.
NO_EXCEPTIONS = "No exceptions across %d invoices in this window."
RAISED = "%d of %d invoices raised an exception (%s)."
MOST_COMMON = "Most common failure: %s (%s of their exceptions)."
OPEN_VALUE = "INR %s is currently open and unpaid."
AVERAGING = f"Open cases are averaging %s days, past the {SLA_DAYS}-day SLA."
NO_CROSS_CASE = "No cross-case findings in this window."
ONE_CROSS_CASE = "%d exception worth INR %s came from checks that read the rest of the workspace, not this invoice."
CROSS_CASES = "%d exceptions worth INR %s came from checks that read the rest of the workspace, not this invoice."
WOULD_HAVE_CLEARED = " %d of them scored a full three-way match on their own documents — a per-invoice system would have passed them for payment."


def why_at_risk() -> Column:
    """A sentence over the columns of ``vendor_measures``."""
    # Multiplied first: a quotient times 100 may fall just beside a half.
    pct = lambda part, whole: F.concat(F.bround(100.0 * part / whole, 0).cast("int").cast("string"), F.lit("%"))
    top, n, e = F.get("recurring_types", F.lit(0)), F.col("invoice_count"), F.col("exception_count")
    some = F.concat_ws(
        " ", F.format_string(RAISED, e, n, pct(e, n)),
        F.when(F.col("top_exception_type").isNotNull(), F.format_string(MOST_COMMON, F.replace("top_exception_type", F.lit("_"), F.lit(" ")), pct(top["n"], e))),
        F.when(F.col("value_at_risk") > 0, F.format_string(OPEN_VALUE, F.format_number("value_at_risk", 0))),
        F.when(F.col("average_open_age_days") >= SLA_DAYS, F.format_string(AVERAGING, F.format_number("average_open_age_days", 0))),
    )
    return F.when(e == 0, F.format_string(NO_EXCEPTIONS, n)).otherwise(some)


def vendor_risk(cases: DataFrame, as_of: datetime, days: int | None = 365, limit: int = 25, workspace: str | None = None) -> DataFrame:
    """The vendors with most value at risk, then highest rate; ties by id."""
    rows = vendor_measures(cases, as_of, days, workspace).withColumn("why_at_risk", why_at_risk())
    return rows.orderBy(F.desc("value_at_risk"), F.desc("exception_rate"), "vendor_id").limit(limit)


def vendor_count(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """Number of vendors before any limit."""
    return scoped(cases, as_of, days, workspace).agg(F.count_distinct(_vendor()).alias("vendor_count"))


def portfolio_summary(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """Counts, rates and values of the whole portfolio, one row."""
    out = scoped(cases, as_of, days, workspace).agg(
        F.count(F.lit(1)).alias("invoice_count"), F.count_if(is_exception()).alias("exception_count"), F.count_if(is_open()).alias("open_exception_count"),
        total(F.col("invoice_amount")).alias("invoiced"), total(F.col("financial_impact"), is_open()).alias("at_risk"),
    )
    n, e = F.col("invoice_count"), F.col("exception_count")
    return out.select(
        n, e, (n - e).alias("clean_count"), rate(e, n).alias("exception_rate"), rate(n - e, n).alias("clean_rate"), "open_exception_count",
        F.col("invoiced").cast("double").alias("invoiced_value"), F.col("at_risk").cast("double").alias("value_at_risk"),
        rate(F.col("at_risk").cast("double"), F.col("invoiced").cast("double")).alias("value_at_risk_share"),
    )


def portfolio_by_type(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """Number and value of each exception type, most frequent first."""
    out = scoped(cases, as_of, days, workspace).filter(EXCEPTION).groupBy("exception_type")
    return out.agg(F.count(F.lit(1)).alias("n"), total(F.col("financial_impact")).cast("double").alias("value")).orderBy(F.desc("n"), "exception_type")


def monthly_trend(cases: DataFrame, as_of: datetime, months: int = 12, workspace: str | None = None, tail: bool = True) -> DataFrame:
    """A row per month, in order: the last ``months`` of them, or without ``tail`` all that the window touches."""
    rows = scoped(cases, as_of, months * 31, workspace).filter("created_at is not null").groupBy(month_key(F.col("created_at")).alias("month"))
    out = rows.agg(F.count(F.lit(1)).alias("invoices"), F.count_if(is_exception()).alias("exceptions"), total(F.col("financial_impact"), is_exception()).cast("double").alias("value_at_risk"))
    out = out.withColumn("clean", F.col("invoices") - F.col("exceptions")).withColumn("exception_rate", rate(F.col("exceptions"), F.col("invoices")))
    return (out.orderBy(F.desc("month")).limit(months) if tail else out).orderBy("month")


def _open_aged(cases: DataFrame, as_of: datetime, days: int | None, workspace: str | None) -> DataFrame:
    rows = scoped(cases, as_of, days, workspace).filter(is_open() & F.col("created_at").isNotNull())
    return rows.withColumn("age", age_days(F.col("created_at"), F.lit(as_of)))


def ageing_headline(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """Open exceptions, breaches of the SLA and the oldest age, one row."""
    return _open_aged(cases, as_of, days, workspace).agg(
        F.lit(SLA_DAYS).cast("long").alias("sla_days"), F.count(F.lit(1)).alias("open_exceptions"), F.count_if(F.col("age") > SLA_DAYS).alias("breaching_sla"),
        F.coalesce(F.round(F.max("age"), 1), F.lit(0.0)).alias("oldest_open_days"),
    )


def ageing_buckets(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None, whole_days: bool = True) -> DataFrame:
    """Number and value of open exceptions by age, empty buckets included.

    Without ``whole_days`` an age of 3.5 days is beyond the bucket that ends at 3.
    """
    age = F.col("age") if whole_days else F.ceil("age")
    rows = _open_aged(cases, as_of, days, workspace).groupBy(age_bucket(age).alias("label")).agg(F.count(F.lit(1)).alias("n"), total(F.col("financial_impact")).cast("double").alias("value"))
    labels = cases.sparkSession.createDataFrame([(i, label) for i, (label, _, _) in enumerate(AGE_BUCKETS)], "ordinal int, label string")
    out = F.broadcast(labels).join(rows, "label", "left")  # five labels
    return out.select("ordinal", "label", F.coalesce("n", F.lit(0)).cast("long").alias("count"), F.coalesce("value", F.lit(0.0)).alias("value_at_risk")).orderBy("ordinal")


def cross_case_value(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    """What only checks across cases found, and how much of it had a clean score, one row."""
    cross = is_exception() & F.col("exception_type").isin(*CROSS_CASE_TYPES)
    single = is_exception() & ~F.col("exception_type").isin(*CROSS_CASE_TYPES)
    clean = cross & (F.col("match_score") >= CLEAN_SCORE)
    impact = F.col("financial_impact")
    out = scoped(cases, as_of, days, workspace).agg(
        F.count(F.lit(1)).alias("invoice_count"), F.count_if(is_exception()).alias("exception_count"), F.count_if(single).alias("single_count"), total(impact, single).cast("double").alias("single_value"),
        F.count_if(cross).alias("cross_count"), total(impact, cross).cast("double").alias("cross_value"), F.count_if(clean).alias("would_have_cleared_count"), total(impact, clean).cast("double").alias("would_have_cleared_value"),
    )
    return out.withColumn("share_of_exceptions", rate(F.col("cross_count"), F.col("exception_count"))).withColumn("headline", _headline())


def _headline() -> Column:
    n, clean, value = F.col("cross_count"), F.col("would_have_cleared_count"), F.format_number("cross_value", 0)
    first = F.when(n == 1, F.format_string(ONE_CROSS_CASE, n, value)).otherwise(F.format_string(CROSS_CASES, n, value))
    return F.when(n == 0, F.lit(NO_CROSS_CASE)).otherwise(F.concat(first, F.when(clean > 0, F.format_string(WOULD_HAVE_CLEARED, clean)).otherwise(F.lit(""))))


def cross_case_by_type(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    rows = scoped(cases, as_of, days, workspace).filter(is_exception() & F.col("exception_type").isin(*CROSS_CASE_TYPES)).groupBy("exception_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), total(F.col("financial_impact")).cast("double").alias("value")).orderBy(F.desc("value"), "exception_type")


def vendor_history(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """``cases`` (with vendor_name) and their vendor's row in ``ranked``, by identity key; the first of several that share it."""
    by_key = ranked.withColumn("vendor_key", vendor_key(F.col("vendor_name"))).groupBy("vendor_key")
    order = F.struct((-F.col("value_at_risk")).alias("v"), (-F.col("exception_rate")).alias("r"), "vendor_id")
    first = by_key.agg(F.min_by(F.struct("vendor_id", "invoice_count", "exception_count", "value_at_risk"), order).alias("history"))
    return cases.withColumn("vendor_key", vendor_key(F.col("vendor_name"))).join(first, "vendor_key", "left")


def request(days: int | None = None, limit: int | None = None, months: int | None = None) -> tuple[int, int, int]:
    """Days, vendor rows and months of a request within their guard rails."""
    return clamp(days, 1, MAX_DAYS, 365), clamp(limit, 1, MAX_VENDORS, 25), clamp(months, 1, MAX_MONTHS, 12)


def dashboard_summary(cases: DataFrame, workspace: str | None = None) -> DataFrame:
    """All-time counts; here a case is open by its status alone."""
    if workspace is not None:
        cases = cases.filter(F.col("workspace_id") == workspace)
    by_status = F.coalesce(F.col("status").isin(*OPEN_STATUSES), F.lit(False))
    return cases.agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if(by_status).alias("open_count"), F.count_if(F.col("exception_type") == CLEAN_TYPE).alias("clean_count"),
        F.count_if(F.col("status").startswith("awaiting")).alias("awaiting_count"), F.count_if(F.col("risk_level") == "high").alias("high_risk_count"),
        total(F.col("financial_impact"), by_status).cast("double").alias("open_value"),
    )
