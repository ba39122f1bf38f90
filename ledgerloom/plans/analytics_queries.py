"""Portfolio analytics, dashboard and registers over the derived ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import analytics as A
from ledgerloom.operators import registers as R
from ledgerloom.plans.ledger import AS_OF, CASES, cases
from ledgerloom.plans.registry import query

_NOW = "TIMESTAMP '2001-12-01'"
_EXC = "exception_type <> 'no_exception'"
_OPEN = f"({_EXC} AND status IN ('exception_detected', 'assigned', 'awaiting_procurement', 'awaiting_receiving', 'awaiting_vendor'))"
_CROSS = "exception_type IN ('duplicate_invoice', 'po_over_billed', 'payment_details_changed', 'recurring_suspected', 'vendor_price_drift')"
_AGE = f"(greatest(0, epoch_us({_NOW}) - epoch_us(created_at)) / 86400000000.0::DOUBLE)"
_BUCKET = f"CASE WHEN trunc({_AGE}) <= 3 THEN '0-3' WHEN trunc({_AGE}) <= 7 THEN '4-7' WHEN trunc({_AGE}) <= 14 THEN '8-14' WHEN trunc({_AGE}) <= 30 THEN '15-30' ELSE '31+' END"


def _dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def _scope(days: int | None) -> str:
    where = f"WHERE created_at IS NULL OR created_at >= {_NOW} - INTERVAL {days} DAY" if days else ""
    return f"WITH {CASES}, scoped AS (SELECT * FROM cases {where})"


_VENDOR = f"""{_scope(365)}, named AS (SELECT vendor_id, arg_min(vendor_name, (created_at, exception_id)) AS vendor_name, arg_min(business_unit, (created_at, exception_id)) AS business_unit,
  count(*) AS invoice_count, count(*) FILTER ({_EXC}) AS exception_count, coalesce(sum({_dec('financial_impact')}) FILTER ({_OPEN}), 0) AS risk, sum({_dec('invoice_amount')}) AS invoiced,
  sum(match_score) AS ss, count(match_score) AS sn, sum(CAST({_AGE} AS DECIMAL(28,9))) FILTER ({_OPEN}) AS ages, count(*) FILTER ({_OPEN}) AS an FROM scoped GROUP BY vendor_id),
types AS (SELECT vendor_id, exception_type, count(*) AS n, row_number() OVER (PARTITION BY vendor_id ORDER BY count(*) DESC, exception_type) AS r FROM scoped WHERE {_EXC} GROUP BY vendor_id, exception_type),
vendors AS (SELECT n.vendor_id, vendor_name, business_unit, invoice_count, exception_count, round(exception_count / invoice_count, 4) AS exception_rate, CAST(risk AS DOUBLE) AS value_at_risk, CAST(invoiced AS DOUBLE) AS invoiced_value,
  exception_type AS top_exception_type, round(ss / sn, 1) AS average_match_score, CASE WHEN an > 0 THEN round(CAST(ages AS DOUBLE) / an, 1) ELSE 0 END AS average_open_age_days,
  CASE WHEN exception_count / invoice_count >= 0.4 OR risk >= 1000000 THEN 'high' WHEN exception_count / invoice_count >= 0.2 OR risk >= 250000 THEN 'medium' ELSE 'low' END AS risk_band
  FROM named n LEFT JOIN types t ON t.vendor_id = n.vendor_id AND r = 1)"""
_VENDOR_COLUMNS = ("vendor_id", "vendor_name", "business_unit", "invoice_count", "exception_count", "exception_rate", "value_at_risk", "invoiced_value", "top_exception_type", "average_match_score", "average_open_age_days", "risk_band")


@query(f"{_VENDOR} SELECT {', '.join(_VENDOR_COLUMNS)} FROM vendors ORDER BY value_at_risk DESC, exception_rate DESC, vendor_id LIMIT 25")
def vendor_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vendor_risk(cases(spark, sf_dir), AS_OF).select(*_VENDOR_COLUMNS)


@query(f"{_VENDOR} SELECT {', '.join(_VENDOR_COLUMNS)} FROM vendors")
def vendor_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vendor_measures(cases(spark, sf_dir), AS_OF).select(*_VENDOR_COLUMNS)


@query(f"{_scope(365)} SELECT vendor_id, exception_type, count(*) AS n, row_number() OVER (PARTITION BY vendor_id ORDER BY count(*) DESC, exception_type) AS type_rank FROM scoped WHERE {_EXC} GROUP BY vendor_id, exception_type")
def vendor_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vendor_types(cases(spark, sf_dir), AS_OF).withColumn("type_rank", F.col("type_rank").cast("long"))


@query(f"{_VENDOR} SELECT vendor_id, exception_type AS top_exception_type, n FROM types WHERE r = 1")
def vendor_top_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vendor_top_type(cases(spark, sf_dir), AS_OF)


@query(f"{_scope(365)} SELECT count(DISTINCT vendor_id) AS vendor_count FROM scoped")
def vendor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vendor_count(cases(spark, sf_dir), AS_OF)


def _summary_sql(days: int | None) -> str:
    return f"""{_scope(days)}, s AS (SELECT count(*) AS n, count(*) FILTER ({_EXC}) AS e, count(*) FILTER ({_OPEN}) AS o, CAST(sum({_dec('invoice_amount')}) AS DOUBLE) AS inv, CAST(coalesce(sum({_dec('financial_impact')}) FILTER ({_OPEN}), 0) AS DOUBLE) AS risk FROM scoped)
    SELECT n AS invoice_count, e AS exception_count, n - e AS clean_count, round(e / n, 4) AS exception_rate, round((n - e) / n, 4) AS clean_rate, o AS open_exception_count, inv AS invoiced_value, risk AS value_at_risk, round(risk / inv, 4) AS value_at_risk_share FROM s"""


@query(_summary_sql(365))
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.portfolio_summary(cases(spark, sf_dir), AS_OF)


@query(_summary_sql(30))
def portfolio_summary_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.portfolio_summary(cases(spark, sf_dir), AS_OF, 30)


@query(_summary_sql(90))
def portfolio_summary_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.portfolio_summary(cases(spark, sf_dir), AS_OF, 90)


@query(_summary_sql(None))
def portfolio_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.portfolio_summary(cases(spark, sf_dir), AS_OF, None)


@query(f"{_scope(365)} SELECT exception_type, count(*) AS n, CAST(sum({_dec('financial_impact')}) AS DOUBLE) AS value FROM scoped WHERE {_EXC} GROUP BY exception_type")
def portfolio_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.portfolio_by_type(cases(spark, sf_dir), AS_OF)


@query(f"""{_scope(12 * 31)}, m AS (SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS invoices, count(*) FILTER ({_EXC}) AS exceptions, CAST(coalesce(sum({_dec('financial_impact')}) FILTER ({_EXC}), 0) AS DOUBLE) AS value_at_risk FROM scoped WHERE created_at IS NOT NULL GROUP BY 1)
SELECT month, invoices, exceptions, value_at_risk, invoices - exceptions AS clean, round(exceptions / invoices, 4) AS exception_rate FROM m ORDER BY month DESC LIMIT 12""")
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monthly_trend(cases(spark, sf_dir), AS_OF)


@query(f"{_scope(365)} SELECT CAST(14 AS BIGINT) AS sla_days, count(*) AS open_exceptions, count(*) FILTER ({_AGE} > 14) AS breaching_sla, coalesce(round(max({_AGE}), 1), 0) AS oldest_open_days FROM scoped WHERE {_OPEN}")
def ageing_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ageing_headline(cases(spark, sf_dir), AS_OF)


@query(f"""{_scope(365)}, b AS (SELECT {_BUCKET} AS label, count(*) AS n, CAST(sum({_dec('financial_impact')}) AS DOUBLE) AS v FROM scoped WHERE {_OPEN} GROUP BY 1)
SELECT d.ordinal, d.label, coalesce(n, 0) AS count, coalesce(v, 0) AS value_at_risk FROM (VALUES (0, '0-3'), (1, '4-7'), (2, '8-14'), (3, '15-30'), (4, '31+')) d(ordinal, label) LEFT JOIN b ON b.label = d.label""")
def ageing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ageing_buckets(cases(spark, sf_dir), AS_OF)


@query(f"""{_scope(365)}, s AS (SELECT count(*) AS n, count(*) FILTER ({_EXC}) AS e, count(*) FILTER ({_EXC} AND NOT {_CROSS}) AS sc, CAST(coalesce(sum({_dec('financial_impact')}) FILTER ({_EXC} AND NOT {_CROSS}), 0) AS DOUBLE) AS sv,
  count(*) FILTER ({_CROSS}) AS cc, CAST(coalesce(sum({_dec('financial_impact')}) FILTER ({_CROSS}), 0) AS DOUBLE) AS cv, count(*) FILTER ({_CROSS} AND match_score >= 100) AS wc, CAST(coalesce(sum({_dec('financial_impact')}) FILTER ({_CROSS} AND match_score >= 100), 0) AS DOUBLE) AS wv FROM scoped)
SELECT n AS invoice_count, e AS exception_count, sc AS single_count, sv AS single_value, cc AS cross_count, cv AS cross_value, wc AS would_have_cleared_count, wv AS would_have_cleared_value, round(cc / e, 4) AS share_of_exceptions FROM s""")
def cross_case_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cross_case_value(cases(spark, sf_dir), AS_OF).drop("headline")


@query(f"{_scope(365)} SELECT exception_type, count(*) AS n, CAST(sum({_dec('financial_impact')}) AS DOUBLE) AS value FROM scoped WHERE {_CROSS} GROUP BY exception_type")
def cross_case_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cross_case_by_type(cases(spark, sf_dir), AS_OF)


@query(f"""{_scope(None)} SELECT count(*) AS case_count, count(*) FILTER (status IN ('exception_detected', 'awaiting_vendor', 'awaiting_receiving')) AS open_count, count(*) FILTER (exception_type = 'no_exception') AS clean_count,
count(*) FILTER (starts_with(status, 'awaiting')) AS awaiting_count, count(*) FILTER (risk_level = 'high') AS high_risk_count, CAST(sum({_dec('financial_impact')}) FILTER (status IN ('exception_detected', 'awaiting_vendor', 'awaiting_receiving')) AS DOUBLE) AS open_value FROM scoped""")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dashboard_summary(cases(spark, sf_dir))


@query(f"{_scope(None)} SELECT exception_id, invoice_id, vendor_id, exception_type, status, created_at FROM scoped WHERE {_EXC} ORDER BY created_at DESC, exception_id LIMIT 8")
def recent_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent(cases(spark, sf_dir)).select("exception_id", "invoice_id", "vendor_id", "exception_type", "status", "created_at")


@query(f"""{_scope(None)} SELECT exception_id, invoice_id, vendor_id, invoice_amount, CASE WHEN {_EXC} THEN financial_impact END AS financial_impact, exception_type = 'no_exception' OR status = 'cleared' AS cleared, count(*) OVER (PARTITION BY invoice_id) AS duplicate_count FROM scoped""")
def invoice_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.invoice_rows(cases(spark, sf_dir)).select("exception_id", "invoice_id", "vendor_id", "invoice_amount", "financial_impact", "cleared", "duplicate_count")


@query(f"{_scope(None)} SELECT count(*) AS n, CAST(sum({_dec('invoice_amount')}) AS DOUBLE) AS invoiced, CAST(sum({_dec('financial_impact')}) AS DOUBLE) AS impact FROM scoped WHERE {_EXC} AND NOT status = 'cleared'")
def invoice_register_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.invoice_totals(R.invoice_filter(R.invoice_rows(cases(spark, sf_dir)), "exceptions"))


_PO = f"""{_scope(None)}, po AS (SELECT purchase_order_id, count(*) AS invoice_count, CAST(sum({_dec('invoice_amount')}) AS DOUBLE) AS billed_amount, arg_min(po_amount, (created_at, exception_id)) FILTER (po_amount > 0) AS ordered_amount,
 count(*) FILTER ({_EXC}) AS exception_count, count(DISTINCT vendor_id) AS vendor_count, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, count(*) - count(DISTINCT invoice_id) AS repeated_invoices FROM scoped WHERE purchase_order_id <> '' GROUP BY purchase_order_id)"""


@query(f"{_PO} SELECT *, CASE WHEN ordered_amount IS NOT NULL THEN billed_amount > ordered_amount + 0.01 END AS over_billed FROM po")
def po_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.po_rows(cases(spark, sf_dir)).withColumn("statuses", F.array_join("statuses", ","))


@query(f"{_PO} SELECT purchase_order_id, billed_amount, ordered_amount, invoice_count FROM po WHERE billed_amount > ordered_amount + 0.01")
def po_overbilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.po_filter(R.po_rows(cases(spark, sf_dir)), "overbilled").select("purchase_order_id", "billed_amount", "ordered_amount", "invoice_count")


@query(f"{_PO} SELECT count(*) AS n, CAST(sum({_dec('ordered_amount')}) AS DOUBLE) AS ordered, count(ordered_amount) AS known, CAST(sum({_dec('billed_amount')}) AS DOUBLE) AS billed FROM po")
def po_register_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.po_totals(R.po_rows(cases(spark, sf_dir)))


@query(f"{_VENDOR} SELECT count(*) AS vendors, CAST(sum({_dec('value_at_risk')}) AS DOUBLE) AS value_at_risk, count(*) FILTER (risk_band = 'high') AS high_count, CAST(sum(invoice_count) AS BIGINT) AS invoices FROM vendors")
def vendor_register_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vendor_totals(A.vendor_measures(cases(spark, sf_dir), AS_OF))


@query(f"{_scope(None)} SELECT exception_id, vendor_name, status FROM scoped WHERE status = 'awaiting_vendor' AND {_EXC} AND (contains(lower(vendor_name), '00001') OR contains(lower(invoice_id), '00001') OR contains(lower(exception_type), '00001') OR contains(lower(purchase_order_id), '00001') OR contains(lower(exception_id), '00001'))")
def queue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.queue_filter(cases(spark, sf_dir), outcome="exceptions", status="awaiting_vendor", search="00001").select("exception_id", "vendor_name", "status")


@query(f"""{_scope(None)}, s AS (SELECT exception_id, greatest({', '.join(f"CASE WHEN strpos(lower({c}), '101') = 1 THEN 1000 WHEN strpos(lower({c}), '101') > 1 THEN 501 - strpos(lower({c}), '101') ELSE 0 END" for c in ('invoice_id', 'vendor_name', 'purchase_order_id'))}) AS score FROM scoped)
SELECT exception_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, exception_id LIMIT 20""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(cases(spark, sf_dir), "101", ["invoice_id", "vendor_name", "purchase_order_id"], 20).select("exception_id", "score")


@query(f"{_scope(None)} SELECT exception_id, po_amount, CAST(row_number() OVER (ORDER BY po_amount DESC NULLS LAST, exception_id) AS BIGINT) AS place FROM scoped")
def nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placed(R.register_sort(cases(spark, sf_dir), "po_amount", descending=True)).select("exception_id", "po_amount", "place")


@query(f"{_scope(None)} SELECT DISTINCT status FROM scoped")
def status_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_options(cases(spark, sf_dir))


@query(f"{_VENDOR} SELECT vendor_id, value_at_risk, round(ln(1 + value_at_risk) / (SELECT ln(1 + max(value_at_risk)) FROM vendors), 6) AS scale FROM vendors")
def risk_bubble_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bubble_scale(A.vendor_measures(cases(spark, sf_dir), AS_OF)).select("vendor_id", "value_at_risk", "scale")
