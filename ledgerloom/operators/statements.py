"""The five portfolio analytics as SQL statements with bound parameters.

No value is ever put into the text of a statement: the window, the workspace, the
open statuses and the rest are named parameters, arrays and nulls included.  A
null ``cutoff`` means all dates, a null ``workspace_id`` every workspace.  They give
what the functions of the same names in ``analytics`` give.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.variance import risk_band
from ledgerloom.model import AGE_BUCKETS, CLEAN_SCORE, CLEAN_TYPE, CROSS_CASE_TYPES, OPEN_STATUSES
from ledgerloom.operators import analytics

SCOPE = """(:cutoff IS NULL OR created_at IS NULL OR created_at >= :cutoff) AND (:cutoff IS NULL OR created_date IS NULL OR created_date >= trunc(CAST(:cutoff AS DATE), 'MM'))
  AND (:workspace_id IS NULL OR workspace_id = :workspace_id)"""
EXCEPTION = "coalesce(exception_type <> '' AND exception_type <> :clean_type, false)"
OPEN = f"({EXCEPTION} AND coalesce(array_contains(:open_statuses, status), false))"
CROSS = f"({EXCEPTION} AND array_contains(:cross_types, exception_type))"
AGE = "greatest(0D, (unix_micros(CAST(:as_of AS TIMESTAMP)) - unix_micros(CAST(created_at AS TIMESTAMP))) / 86400000000D)"


def _money(column: str, where: str | None = None) -> str:
    kept = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(coalesce(sum(CAST(coalesce({column}, 0D) AS DECIMAL(18,2))){kept}, 0) AS DOUBLE)"


def _rate(n: str, d: str) -> str:
    return f"CAST(coalesce(round(try_divide({n}, {d}), 4), 0) AS DOUBLE)"


PORTFOLIO_SUMMARY = f"""
WITH s AS (SELECT count(*) AS n, count_if({EXCEPTION}) AS e, count_if({OPEN}) AS o, {_money("invoice_amount")} AS invoiced, {_money("financial_impact", OPEN)} AS at_risk FROM {{cases}} WHERE {SCOPE})
SELECT n AS invoice_count, e AS exception_count, n - e AS clean_count, {_rate("e", "n")} AS exception_rate, {_rate("n - e", "n")} AS clean_rate, o AS open_exception_count,
  invoiced AS invoiced_value, at_risk AS value_at_risk, {_rate("at_risk", "invoiced")} AS value_at_risk_share FROM s"""

VENDOR_RISK = f"""
WITH scoped AS (SELECT *, coalesce(nullif(vendor_id, ''), nullif(vendor_name, ''), 'unknown') AS vendor, CASE WHEN {EXCEPTION} THEN exception_type END AS kind FROM {{cases}} WHERE {SCOPE}),
by_type AS (SELECT vendor, kind, count(*) AS n, sum(CAST(coalesce(invoice_amount, 0D) AS DECIMAL(18,2))) AS invoiced, sum(CAST(coalesce(financial_impact, 0D) AS DECIMAL(18,2))) FILTER (WHERE {OPEN}) AS at_risk,
  sum(match_score) AS score_sum, count(match_score) AS score_n, sum(CAST({AGE} AS DECIMAL(28,9))) FILTER (WHERE {OPEN} AND created_at IS NOT NULL) AS age_sum, count(*) FILTER (WHERE {OPEN} AND created_at IS NOT NULL) AS age_n,
  min(struct(created_at, exception_id, vendor_name)) FILTER (WHERE vendor_name <> '') AS name, min(struct(created_at, exception_id, business_unit)) FILTER (WHERE business_unit <> '') AS unit
  FROM scoped GROUP BY vendor, kind),
v AS (SELECT vendor, sum(n) AS n, coalesce(sum(n) FILTER (WHERE kind IS NOT NULL), 0) AS e, coalesce(sum(at_risk), 0) AS at_risk, sum(invoiced) AS invoiced, sum(score_sum) AS score_sum, sum(score_n) AS score_n,
  sum(age_sum) AS age_sum, sum(age_n) AS age_n, min(name) AS name, min(unit) AS unit, array_sort(collect_list(CASE WHEN kind IS NOT NULL THEN struct(-n AS less, kind AS kind) END)) AS kinds FROM by_type GROUP BY vendor)
SELECT vendor AS vendor_id, coalesce(name.vendor_name, 'Unknown vendor') AS vendor_name, unit.business_unit AS business_unit, n AS invoice_count, e AS exception_count, {_rate("e", "n")} AS exception_rate,
  CAST(at_risk AS DOUBLE) AS value_at_risk, CAST(invoiced AS DOUBLE) AS invoiced_value, get(kinds, 0).kind AS top_exception_type, transform(kinds, x -> struct(x.kind AS exception_type, -x.less AS n)) AS recurring_types,
  CAST(round(try_divide(score_sum, score_n), 1) AS DOUBLE) AS average_match_score, CAST(coalesce(round(try_divide(age_sum, age_n), 1), 0) AS DOUBLE) AS average_open_age_days, e / n AS exact_rate
FROM v ORDER BY value_at_risk DESC, exception_rate DESC, vendor_id LIMIT :row_limit"""

MONTHLY_TREND = f"""
WITH m AS (SELECT date_format(created_at, 'yyyy-MM') AS month, count(*) AS invoices, count_if({EXCEPTION}) AS exceptions, {_money("financial_impact", EXCEPTION)} AS value_at_risk
  FROM {{cases}} WHERE {SCOPE} AND created_at IS NOT NULL GROUP BY 1),
last AS (SELECT * FROM m ORDER BY month DESC LIMIT :months)
SELECT month, invoices, exceptions, value_at_risk, invoices - exceptions AS clean, {_rate("exceptions", "invoices")} AS exception_rate FROM last ORDER BY month"""

AGEING = f"""
WITH aged AS (SELECT {AGE} AS age, coalesce(financial_impact, 0D) AS impact FROM {{cases}} WHERE {SCOPE} AND {OPEN} AND created_at IS NOT NULL),
b AS (SELECT i AS ordinal, label, get(:lows, i) AS low, get(:highs, i) AS high FROM (SELECT posexplode(:labels) AS (i, label)))
SELECT ordinal, label, count(age) AS count, {_money("impact", "age IS NOT NULL")} AS value_at_risk FROM b LEFT JOIN aged ON floor(age) >= low AND floor(age) <= high GROUP BY ordinal, label ORDER BY ordinal"""

CROSS_CASE_VALUE = f"""
SELECT count(*) AS invoice_count, count_if({EXCEPTION}) AS exception_count, count_if({EXCEPTION} AND NOT {CROSS}) AS single_count, {_money("financial_impact", f"{EXCEPTION} AND NOT {CROSS}")} AS single_value,
  count_if({CROSS}) AS cross_count, {_money("financial_impact", CROSS)} AS cross_value, count_if({CROSS} AND match_score >= :clean_score) AS would_have_cleared_count,
  {_money("financial_impact", f"{CROSS} AND match_score >= :clean_score")} AS would_have_cleared_value, {_rate(f"count_if({CROSS})", f"count_if({EXCEPTION})")} AS share_of_exceptions FROM {{cases}} WHERE {SCOPE}"""


#: Days that no case reaches, where a bucket has no end.
MAX_AGE = 2**31 - 1


def _array(values: Sequence[str | int]) -> Column:
    return F.array(*map(F.lit, values))


def run(statement: str, cases: DataFrame, as_of: datetime, days: int | None, workspace: str | None = None, **more: object) -> DataFrame:
    """A statement over ``cases`` with its parameters bound."""
    if "created_date" not in cases.columns:  # tables without partitions by date
        cases = cases.withColumn("created_date", F.lit(None).cast("date"))
    labels, lows, highs = zip(*AGE_BUCKETS, strict=True)
    bound = {
        "cutoff": as_of - timedelta(days=days) if days else None, "workspace_id": workspace, "as_of": as_of, "clean_type": CLEAN_TYPE, "clean_score": CLEAN_SCORE,
        "open_statuses": _array(OPEN_STATUSES), "cross_types": _array(CROSS_CASE_TYPES), "labels": _array(labels), "lows": _array(lows), "highs": _array([MAX_AGE if h is None else h for h in highs]), **more,
    }
    return cases.sparkSession.sql(statement, args={k: v for k, v in bound.items() if f":{k}" in statement}, cases=cases)


def portfolio_summary(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    return run(PORTFOLIO_SUMMARY, cases, as_of, days, workspace)


def vendor_risk(cases: DataFrame, as_of: datetime, days: int | None = 365, limit: int = 25, workspace: str | None = None) -> DataFrame:
    out = run(VENDOR_RISK, cases, as_of, days, workspace, row_limit=limit)
    return out.withColumn("risk_band", risk_band(F.col("exact_rate"), F.col("value_at_risk"))).drop("exact_rate").withColumn("why_at_risk", analytics.why_at_risk())


def monthly_trend(cases: DataFrame, as_of: datetime, months: int = 12, workspace: str | None = None) -> DataFrame:
    return run(MONTHLY_TREND, cases, as_of, months * 31, workspace, months=months)


def ageing_buckets(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    return run(AGEING, cases, as_of, days, workspace)


def cross_case_value(cases: DataFrame, as_of: datetime, days: int | None = 365, workspace: str | None = None) -> DataFrame:
    return run(CROSS_CASE_VALUE, cases, as_of, days, workspace)
