"""Match engine and scalar keys over the derived ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, keys
from ledgerloom.functions import variance as V
from ledgerloom.operators import matching as M
from ledgerloom.plans.history_queries import VENDOR_KEY_SQL
from ledgerloom.plans.ledger import LEDGER, ledger
from ledgerloom.plans.registry import query


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as matching input: some orders are another vendor's, some documents cite another order."""
    rows = ledger(spark, sf_dir)
    money = lambda c: F.col(c) / F.lit(100.0)
    po = F.col("purchase_order_exists")
    even = F.col("vendor_id").cast("long") % 2 == 0
    buyer = F.when(F.col("part") % 37 == 0, F.lit("Another Company")).when(even, F.concat("po_vendor_name", F.lit(" PRIVATE LIMITED"))).otherwise(F.upper("po_vendor_name"))
    other = F.when(F.col("part") % 29 == 0, F.lit("PO-0")).otherwise(F.concat(F.lit("PO-"), "purchase_order_id"))
    spelled = F.when(even, F.concat(F.lit("M/s "), "po_vendor_name", F.lit(" Pvt. Ltd."))).otherwise(F.col("po_vendor_name"))
    return rows.select(
        "exception_id", spelled.alias("vendor_name"), F.when(po, buyer).alias("po_vendor_name"), F.concat(F.lit("PO-"), "purchase_order_id").alias("invoice_po_number"), F.when(po, other).alias("po_number"), "purchase_order_exists", "goods_receipt_exists",
        money("total_c").alias("invoice_amount"), money("total_c").alias("invoice_total"), money("subtotal_c").alias("invoice_subtotal"), money("tax_c").alias("tax_amount"), F.when(po, money("po_c")).alias("po_total"),
        money("unit_c").alias("invoice_unit_price"), F.when(po, money("po_unit_c")).alias("po_unit_price"), F.col("qty").cast("double").alias("invoice_quantity"), F.col("received_qty").cast("double").alias("received_quantity"), "part", "line_number", "purchase_order_id",
    )


_IN = f"""WITH {LEDGER}, i AS (SELECT *, purchase_order_exists AS po, total_c / 100.0::DOUBLE AS amount, unit_c / 100.0::DOUBLE AS up, po_unit_c / 100.0::DOUBLE AS pp, qty::DOUBLE AS q, received_qty::DOUBLE AS rq, po AND part % 37 = 0 AS other_vendor, po AND part % 29 = 0 AS conflict FROM (SELECT *, purchase_order_exists AS po FROM ledger)),
v AS (SELECT *, CASE WHEN pp = 0 THEN CASE WHEN up = 0 THEN 0 END ELSE (up - pp) / pp * 100 END AS pv, CASE WHEN rq = 0 THEN CASE WHEN q = 0 THEN 0 END ELSE (q - rq) / rq * 100 END AS qv, (total_c - subtotal_c - tax_c) / 100.0::DOUBLE AS tv,
 CASE WHEN subtotal_c + tax_c = 0 THEN CASE WHEN total_c = 0 THEN 0 END ELSE (total_c / 100.0::DOUBLE - (subtotal_c + tax_c) / 100.0::DOUBLE) / ((subtotal_c + tax_c) / 100.0::DOUBLE) * 100 END AS tp FROM i),
o AS (SELECT *, coalesce(abs(pv) > 5, true) AS price_out, coalesce(abs(qv) > 2, true) AS qty_out, coalesce(abs(tp) > 5, true) AS tax_out FROM v),
e AS (SELECT *, CASE WHEN NOT po THEN 'missing_purchase_order' WHEN tax_out THEN 'tax_total_mismatch' WHEN conflict THEN 'unrelated_documents' WHEN other_vendor THEN 'vendor_mismatch' WHEN NOT goods_receipt_exists THEN 'missing_goods_receipt'
 WHEN qty_out THEN 'quantity_variance' WHEN price_out THEN 'price_variance' ELSE 'no_exception' END AS exception_type,
 CASE WHEN NOT po OR conflict THEN 0 ELSE CAST(round(100.0 * (CAST(NOT other_vendor AS INT) + 1 + CAST(NOT price_out AS INT) + CAST(goods_receipt_exists AND NOT qty_out AS INT) + CAST(NOT tax_out AS INT)) / (4 + CAST(goods_receipt_exists AS INT))) AS INT) END AS match_score FROM o)"""


@query(f"""{_IN} SELECT exception_id, exception_type, match_score, CASE WHEN conflict THEN 'contradicted' ELSE 'consistent' END AS verdict,
CASE WHEN exception_type IN ('missing_purchase_order', 'unrelated_documents', 'vendor_mismatch', 'missing_goods_receipt') THEN amount WHEN exception_type = 'tax_total_mismatch' THEN abs(round(tv, 2))
 WHEN exception_type = 'quantity_variance' THEN CAST(round(CAST(greatest(0, q - rq) * abs(amount / q) AS DECIMAL(28,6)), 2) AS DOUBLE) WHEN exception_type = 'price_variance' THEN CAST(round(CAST(abs(round(up - pp, 2)) * q AS DECIMAL(28,6)), 2) AS DOUBLE) ELSE 0 END AS financial_impact,
CASE WHEN exception_type = 'no_exception' THEN 'low' WHEN exception_type = 'missing_goods_receipt' THEN CASE WHEN price_out OR other_vendor OR amount >= 100000 THEN 'high' WHEN amount >= 25000 THEN 'medium' ELSE 'low' END
 WHEN exception_type = 'quantity_variance' THEN CASE WHEN abs(round(qv, 2)) < 25 THEN 'medium' ELSE 'high' END WHEN exception_type = 'price_variance' THEN CASE WHEN abs(round(pv, 2)) <= 10 THEN 'medium' ELSE 'high' END ELSE 'high' END AS risk_level FROM e""")
def exception_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluate(inputs(spark, sf_dir)).select("exception_id", "exception_type", "match_score", "verdict", "financial_impact", "risk_level")


@query(f"{_IN} SELECT exception_id, match_score FROM e")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluate(inputs(spark, sf_dir)).select("exception_id", "match_score")


@query(f"""{_IN} SELECT exception_id, CASE WHEN conflict THEN 'contradicted' ELSE 'consistent' END AS verdict, conflict AS po_conflict, other_vendor FROM e""")
def coherence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.completed(inputs(spark, sf_dir)).select("exception_id", M.coherence_signals().alias("s"))
    has = lambda code: F.exists("s", lambda x: x["code"] == code)
    return rows.select("exception_id", M.verdict(F.col("s")).alias("verdict"), has("po_reference_conflict").alias("po_conflict"), has("different_vendor").alias("other_vendor"))


@query(f"{_IN} SELECT exception_id, round(pv, 2) AS percentage_variance, CASE WHEN pv IS NULL THEN 'outside_tolerance' WHEN pv = 0 THEN 'matched' WHEN abs(pv) <= 5 THEN 'within_tolerance' ELSE 'outside_tolerance' END AS classification FROM v")
def unit_price_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = V.percent_variance(F.col("unit_c") / F.lit(100.0), F.col("po_unit_c") / F.lit(100.0))
    return ledger(spark, sf_dir).select("exception_id", F.round(pv, 2).alias("percentage_variance"), V.tolerance_class(pv, F.lit(5.0)).alias("classification"))


@query(f"{_IN} SELECT exception_id, round(qv, 2) AS percentage_variance, CASE WHEN qv IS NULL THEN 'outside_tolerance' WHEN qv = 0 THEN 'matched' WHEN abs(qv) <= 2 THEN 'within_tolerance' ELSE 'outside_tolerance' END AS classification FROM v")
def quantity_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    qv = V.percent_variance(F.col("qty").cast("double"), F.col("received_qty").cast("double"))
    return ledger(spark, sf_dir).select("exception_id", F.round(qv, 2).alias("percentage_variance"), V.tolerance_class(qv, F.lit(2.0)).alias("classification"))


@query(f"""{_IN}, l AS (SELECT *, round(up - pp, 2) AS dv FROM v) SELECT purchase_order_id, count(*) AS n_lines, count(*) FILTER (coalesce(abs(pv) > 5, true)) AS n_outside, round(coalesce(sum(CAST(dv AS DECIMAL(18,2)) * qty) FILTER (coalesce(abs(pv) > 5, true) AND dv > 0), 0)::DOUBLE, 2) AS overcharge FROM l GROUP BY purchase_order_id""")
def line_overcharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda price: F.struct(F.concat_ws(" ", F.lit("item"), F.lpad(F.col("part").cast("string"), 9, "0"), "exception_id", F.lit("end")).alias("description"), F.col("qty").cast("double").alias("quantity"), (F.col(price) / F.lit(100.0)).alias("unit_price"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("hsn_sac"))
    orders = ledger(spark, sf_dir).groupBy("purchase_order_id").agg(F.collect_list(line("po_unit_c")).alias("po"), F.array_sort(F.collect_list(line("unit_c"))).alias("inv"))
    lines = orders.select("purchase_order_id", M.compared_lines(F.col("po"), F.col("inv"), F.lit(5.0)).alias("l"))
    outside = F.filter("l", lambda x: x["classification"] == "outside_tolerance")
    return lines.select("purchase_order_id", F.size("l").cast("long").alias("n_lines"), F.size(outside).cast("long").alias("n_outside"), M.line_overcharge(F.col("l")).alias("overcharge"))


@query(f"""WITH {LEDGER}, t AS (SELECT l.*, CAST(vendor_id AS INT) % 10 = 3 AS v, CASE WHEN CAST(vendor_id AS INT) % 20 = 3 THEN 8.0 END AS vp, business_unit = 'NATION_1' AS c FROM ledger l)
SELECT exception_id, coalesce(vp, CASE WHEN c THEN 3.0 END, 5.0)::DOUBLE AS price_tolerance, CASE WHEN c THEN 4.0 ELSE 2.0 END::DOUBLE AS quantity_tolerance,
CASE WHEN v THEN 'vendor rule: No. ' || vendor_id WHEN c THEN 'category rule: NATION_1' ELSE 'workspace default' END AS tolerance_source FROM t""")
def tolerance_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of vendors spelled in two ways (the first counts) and of categories, of which one is spelled otherwise and so never met."""
    rows = ledger(spark, sf_dir).select("exception_id", F.concat(F.lit("no "), "vendor_id").alias("vendor_name"), F.col("business_unit").alias("category"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 10 = 3")
    rule = lambda before, price, place: suppliers.select(F.lit("vendor").alias("scope"), F.concat(F.lit(before), F.col("s_suppkey").cast("string")).alias("name"), price.cast("double").alias("price"), F.lit(None).cast("double").alias("quantity"), F.lit(place).alias("place"))
    special = rule("No. ", F.when(F.col("s_suppkey") % 20 == 3, 8.0), 1).unionByName(rule("NO-", F.lit(99.0), 2))
    fixed = spark.createDataFrame([("default", None, 5.0, 2.0, 0), ("category", "NATION_1", 3.0, 4.0, 0), ("category", "nation 2", 1.0, 1.0, 0)], "scope string, name string, price double, quantity double, place int")
    return M.resolved_tolerance(rows, fixed.unionByName(special)).select("exception_id", "price_tolerance", "quantity_tolerance", "tolerance_source")


@query(f"WITH {LEDGER} SELECT vendor_id, {VENDOR_KEY_SQL} AS vendor_key, count(*) AS n, count(DISTINCT vendor_name) AS spellings FROM ledger GROUP BY ALL")
def vendor_key_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("vendor_id", keys.vendor_key(F.col("vendor_name")).alias("vendor_key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vendor_name").alias("spellings"))


@query(f"WITH {LEDGER} SELECT exception_id, regexp_replace(lower(exception_id), '[^a-z0-9]', '', 'g') AS ascii_key, regexp_replace(lower('Ré-' || vendor_name || ' № ' || invoice_number), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS unicode_key FROM ledger")
def reference_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("exception_id", keys.ascii_key(F.col("exception_id")).alias("ascii_key"), keys.unicode_key(F.concat(F.lit("Ré-"), "vendor_name", F.lit(" № "), "invoice_number")).alias("unicode_key"))


_NOTATIONS = ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y", "%d-%b-%y", "%b %d, %Y")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 10 AS notation, CAST(l_shipdate AS DATE) AS parsed, count(*) AS n FROM lineitem GROUP BY ALL")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.lit(None).cast("string")
    for k, p in enumerate(("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMM-yy", "MMM d, yyyy")):
        # Two-digit years mean 2000 to 2099 here.
        made = F.date_format("l_shipdate", p.replace("yy", "yyyy") if p.endswith("-yy") or p.endswith("/yy") else p)
        written = F.when(F.col("l_partkey") % 10 == k, made).otherwise(written)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10).alias("notation"), dates.parse_date(written).alias("parsed"))
    return rows.groupBy("l_orderkey", "l_linenumber", "notation", "parsed").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEDGER}, a AS (SELECT greatest(0, epoch_us(TIMESTAMP '2001-12-01') - epoch_us(created_at)) / 86400000000.0::DOUBLE AS age, total_c / 100.0::DOUBLE AS v FROM ledger)
SELECT CASE WHEN trunc(age) <= 3 THEN '0-3' WHEN trunc(age) <= 7 THEN '4-7' WHEN trunc(age) <= 14 THEN '8-14' WHEN trunc(age) <= 30 THEN '15-30' ELSE '31+' END AS bucket, CASE WHEN v < 1 THEN '0' ELSE '~1e' || CAST(floor(log10(v)) AS BIGINT) END AS magnitude, count(*) AS n FROM a GROUP BY ALL""")
def age_and_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.plans.ledger import AS_OF

    bucket = dates.age_bucket(dates.age_days(F.col("created_at"), F.lit(AS_OF)))
    return ledger(spark, sf_dir).groupBy(bucket.alias("bucket"), keys.magnitude(F.col("total_c") / F.lit(100.0)).alias("magnitude")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' 50mm supply 12 Part'), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND NOT list_contains(['part', 'supply', 'type'], w) AND NOT regexp_matches(w, '^[0-9]+$')))) AS t FROM part)
SELECT p_partkey, array_to_string(t, ' ') AS tokens, len(list_intersect(t, ['small', 'ring', 'economy'])) AS overlap FROM t""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type", F.lit("50mm supply 12 Part"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array_sort(keys.tokens(text)).alias("t"))
    return rows.select("p_partkey", F.array_join("t", " ").alias("tokens"), F.size(F.array_intersect("t", F.array(*map(F.lit, ("small", "ring", "economy"))))).cast("long").alias("overlap"))
