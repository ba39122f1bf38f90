"""The match engine with history, its figures and sentences, and what follows from a finding, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.functions import variance as V
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import evidence
from ledgerloom.operators import matching as M
from ledgerloom.operators import orchestration as O
from ledgerloom.model import DOCUMENT
from ledgerloom.plans.document_queries import _PAIRS, LIVE, analysed_papers, decisions
from ledgerloom.plans.history_queries import _INV, NEAR, billed, invoices
from ledgerloom.plans.ledger import CASES, LEDGER, cases, ledger
from ledgerloom.plans.matching_queries import _IN, inputs
from ledgerloom.plans.registry import query
from ledgerloom.sources import store

_N = "(part % 4)"
_LINES_SQL = f"""WITH {LEDGER}, l AS (SELECT *, part % 4 AS n, CASE WHEN part % 5 = 0 THEN 1 ELSE 2 END AS known FROM ledger)"""


def with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with none to three lines each: some for services, some without quantity or amount."""
    c = F.col

    def line(i: int) -> Column:
        service = (c("part") % 6 == 0) if i == 0 else F.lit(False)
        return F.struct(
            F.when(service, F.concat(F.lit("Providing and fixing item "), c("part").cast("string"))).otherwise(F.concat(F.lit("Steel pipe "), c("part").cast("string"), F.lit(f" size {i}"))).alias("description"),
            (F.when(c("part") % 5 != 0, c("qty") + i) if i == 1 else c("qty") + i).cast("double").alias("quantity"), ((c("unit_c") + i) / F.lit(100.0)).alias("unit_price"),
            F.when(c("part") % 7 != 0, F.lit(100.0 * (i + 1))).alias("amount"), F.when((c("part") % 11 == 0) & F.lit(i == 0), F.lit(" 9983 ")).otherwise(F.lit("7306")).alias("hsn_sac"),
        )

    return ledger(spark, sf_dir).withColumn("lines", F.slice(F.array(line(0), line(1), line(2)), F.lit(1), (c("part") % 4).cast("int")))


@query(f"""{_LINES_SQL} SELECT exception_id, CASE WHEN part % 13 = 0 THEN 'stateditem' WHEN n = 1 THEN regexp_replace(lower(CASE WHEN part % 6 = 0 THEN 'providing and fixing item ' || part ELSE 'steel pipe ' || part || ' size 0' END), '[^a-z0-9]', '', 'g') END AS item_key,
CASE WHEN part % 13 = 0 THEN 5.5 WHEN n = 1 THEN unit_c / 100.0::DOUBLE END AS unit_price, CASE WHEN part % 13 = 0 THEN 7.0 WHEN n = 1 OR (n = 2 AND part % 5 = 0) THEN qty::DOUBLE END AS quantity,
CASE WHEN n > 0 AND (part % 11 = 0 OR (part % 6 = 0 AND n = 1)) THEN 'services' ELSE 'goods' END AS kind,
CASE WHEN part % 3 = 0 THEN 'unknown' WHEN part % 3 = 1 THEN 'gross' WHEN n > 0 AND part % 7 <> 0 THEN 'net' ELSE 'unknown' END AS basis,
CASE WHEN n = 0 THEN 'unspecified items' ELSE (CASE WHEN part % 6 = 0 THEN 'Providing and fixing item ' || part ELSE 'Steel pipe ' || part || ' size 0' END) || CASE WHEN n > 1 THEN '; Steel pipe ' || part || ' size 1' ELSE '' END || CASE WHEN n > 2 THEN ' (+1 more)' ELSE '' END END AS preview,
CASE WHEN n = 0 THEN NULL WHEN part % 6 = 0 THEN CASE WHEN n > 1 THEN 'fixing pipe providing size steel' ELSE 'fixing providing' END ELSE 'pipe size steel' END AS tokens FROM l""")
def line_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is derived from a document's lines: keys, prices, quantities, kind, tax basis, preview and tokens."""
    c = F.col
    stated = c("part") % 13 == 0
    x = F.struct(F.when(stated, F.lit("Stated Item")).alias("line_item_description"), F.when(stated, F.lit(5.5)).alias("unit_price"), c("lines").alias("line_items"))
    total = F.when(c("part") % 3 != 0, 100.0 * (c("part") % 4) * (c("part") % 4 + 1) / 2)
    tax = F.when(c("part") % 3 == 1, F.lit(1.0))
    return with_lines(spark, sf_dir).select(
        "exception_id", keys.item_key(x).alias("item_key"), keys.unit_price_of(x).alias("unit_price"), keys.billable_quantity(F.when(stated, F.lit(7.0)), c("lines")).alias("quantity"), V.procurement_kind(c("lines")).alias("kind"),
        V.tax_basis(total, F.lit(None).cast("double"), tax, c("lines")).alias("basis"), V.preview(c("lines")).alias("preview"), F.array_join(F.array_sort(keys.document_tokens(c("lines"))), " ").alias("tokens"),
    )


@query(f"""{_IN} SELECT exception_id, CASE WHEN part % 4 = 0 THEN NULL WHEN part % 4 = 1 THEN 'matched' WHEN part % 4 = 2 THEN 'within_tolerance' ELSE 'outside_tolerance' END AS classification,
CASE part % 4 WHEN 1 THEN 0.0 WHEN 2 THEN 4.0 WHEN 3 THEN 25.0 END::DOUBLE AS percentage_variance FROM i""")
def quoted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their quotations, of which some state nothing."""
    k = F.col("part") % 4
    compared = V.quoted_price(F.when(k == 0, F.lit(0.0)).otherwise(F.lit(100.0)), F.when(k == 1, F.lit(100.0)).when(k == 2, F.lit(104.0)).otherwise(F.lit(125.0)), F.lit(5.0))
    return ledger(spark, sf_dir).select("exception_id", "part", compared.alias("q")).select("exception_id", "q.classification", "q.percentage_variance")


@query(f"""{_IN} SELECT exception_id, (CAST(NOT other_vendor AS INT) + 1 + CAST(NOT price_out AS INT) + CAST(NOT tax_out AS INT)) || ' of 4 checked fields agree. No goods receipt is on file, so nothing yet confirms this was delivered — that is the only thing holding '
|| format('{{:,}}', CAST(round_even(amount, 0) AS BIGINT)) || '.' AS sentence FROM e WHERE po AND NOT goods_receipt_exists AND NOT conflict""")
def outstanding_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.evaluate(inputs(spark, sf_dir)).filter("purchase_order_exists and not goods_receipt_exists and verdict <> 'contradicted'")
    return rows.select("exception_id", V.outstanding(F.lit("goods receipt"), F.col("comparisons"), F.col("line_comparisons"), F.col("invoice_amount")).alias("sentence"))


def full_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching input with what the history checks found, lines on some cases and links that nobody confirmed."""
    orders = billed(spark, sf_dir).filter("is_primary and purchase_order_exists and part % 3 = 0").select("exception_id", F.col("purchase_order_id").alias("po_number"), (F.col("po_c") / F.lit(100.0)).alias("order_value"))
    found = O.history_columns(invoices(spark, sf_dir), orders).drop("drift_first", "drift_latest", "drift_percent")
    rows = inputs(spark, sf_dir).join(found, "exception_id", "left")
    drift = F.col("part") % 10 == 7
    line = lambda words, price: F.array(F.struct(words.alias("description"), F.lit(2.0).alias("quantity"), F.lit(price).alias("unit_price"), F.lit(2.0 * price).alias("amount"), F.lit(None).cast("string").alias("hsn_sac")))
    lined = F.col("part") % 8 == 3
    # Lines that are billed at the ordered price, a tenth above, or of other things altogether.
    po_lines = F.when(lined, line(F.lit("Steel pipe flange"), 10.0))
    other = F.when(F.col("part") % 24 == 3, line(F.lit("Steel pipe flange"), 10.0)).when(F.col("part") % 24 == 11, line(F.lit("Steel pipe flange welded"), 11.5)).otherwise(line(F.lit("Office chairs leather"), 10.0))
    warned = F.when(F.col("part") % 9 == 4, F.array(F.struct(F.lit("unverified_link").alias("code"), F.lit("purchase_order").alias("role"))))
    return rows.withColumns({
        "drift_first": F.when(drift, F.lit(10.0)), "drift_latest": F.when(drift, F.lit(12.0)), "drift_percent": F.when(drift, F.lit(20.0)), "po_line_items": po_lines, "invoice_line_items": F.when(lined, other), "link_warnings": warned,
        "po_subtotal": F.col("po_total"), "po_tax_amount": F.when(F.col("po_total").isNotNull(), F.lit(1.0)),
    })


_FULL = f"""{_INV}, {_IN[len(f'WITH {LEDGER}, '):]},
dup AS (SELECT a.exception_id, count(b.exception_id) > 0 AS exact FROM inv a LEFT JOIN inv b ON a.number_key <> '' AND a.workspace_id = b.workspace_id AND a.vendor_key = b.vendor_key AND a.number_key = b.number_key AND a.exception_id <> b.exception_id WHERE a.prime GROUP BY 1),
near AS (SELECT DISTINCT a.exception_id, a.workspace_id, a.vendor_key, a.total_c {NEAR}),
gap AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER w, d) > 0 THEN date_diff('day', lag(d) OVER w, d) END AS gap FROM inv WHERE d IS NOT NULL WINDOW w AS (PARTITION BY workspace_id, vendor_key, total_c ORDER BY d, exception_id)),
cyc AS (SELECT workspace_id, vendor_key, total_c FROM gap GROUP BY ALL HAVING count(*) >= 3 AND count(gap) >= 2 AND avg(gap) BETWEEN 20 AND 400 AND stddev_pop(gap) / avg(gap) <= 0.25),
bank AS (SELECT workspace_id, vendor_key, exception_id, bank_account, row_number() OVER (PARTITION BY workspace_id, vendor_key ORDER BY uploaded_at DESC, document_id DESC) AS rank FROM (SELECT * FROM inv QUALIFY row_number() OVER (PARTITION BY exception_id ORDER BY uploaded_at DESC, document_id DESC) = 1)),
pay AS (SELECT i.exception_id FROM (SELECT * FROM inv WHERE prime) i JOIN bank l ON l.workspace_id = i.workspace_id AND l.vendor_key = i.vendor_key AND l.rank <= 2 AND l.exception_id <> i.exception_id QUALIFY row_number() OVER (PARTITION BY i.exception_id ORDER BY l.rank) = 1 AND lower(l.bank_account) <> lower(i.bank_account)),
per_order AS (SELECT workspace_id, purchase_order_id, sum(total_c) AS c, count(*) AS n FROM inv GROUP BY ALL), per_case AS (SELECT exception_id, sum(total_c) AS c, count(*) AS n FROM inv GROUP BY ALL),
bill AS (SELECT i.exception_id, o.c - p.c + i.total_c AS billed_c, o.n - p.n + 1 AS billed_n FROM inv i JOIN per_order o ON o.workspace_id = i.workspace_id AND o.purchase_order_id = i.purchase_order_id JOIN per_case p ON p.exception_id = i.exception_id WHERE i.prime),
f AS (SELECT e.*, dup.exact, near.exception_id IS NOT NULL AS is_near, cyc.total_c IS NOT NULL AND NOT dup.exact AND near.exception_id IS NOT NULL AS cycle, pay.exception_id IS NOT NULL AS paid_elsewhere, billed_c, billed_n, e.part % 3 = 0 AND e.po AS summed, e.part % 8 = 3 AS lined,
  e.tax_c <> 0 AS taxed FROM e JOIN dup USING (exception_id) JOIN bill USING (exception_id) LEFT JOIN near ON near.exception_id = e.exception_id LEFT JOIN pay ON pay.exception_id = e.exception_id LEFT JOIN cyc ON cyc.workspace_id = near.workspace_id AND cyc.vendor_key = near.vendor_key AND cyc.total_c = near.total_c),
g AS (SELECT *, CASE WHEN NOT po THEN 'missing_purchase_order' WHEN exact THEN 'duplicate_invoice' WHEN paid_elsewhere THEN 'payment_details_changed' WHEN summed AND taxed AND billed_c - po_c > 1 AND billed_n > 1 THEN 'po_over_billed'
  WHEN is_near AND NOT cycle THEN 'duplicate_invoice' WHEN tax_out THEN 'tax_total_mismatch' WHEN other_vendor THEN 'vendor_mismatch' WHEN NOT goods_receipt_exists THEN 'missing_goods_receipt' WHEN qty_out THEN 'quantity_variance' WHEN price_out THEN 'price_variance'
  WHEN lined AND part % 24 <> 3 THEN 'price_variance' WHEN cycle THEN 'recurring_suspected' WHEN part % 10 = 7 THEN 'vendor_price_drift' ELSE 'no_exception' END AS found,
  po AND (conflict OR (lined AND part % 24 = 19 AND total_c > 0 AND total_c / 100.0::DOUBLE > po_c / 100.0::DOUBLE * 1.5)) AS hard, po AND (part % 9 = 4 OR (lined AND part % 24 = 19)) AS soft FROM f),
h AS (SELECT *, CASE WHEN hard THEN 'contradicted' WHEN soft THEN 'unverified' ELSE 'consistent' END AS verdict,
  CASE WHEN hard AND found NOT IN ('missing_purchase_order', 'tax_total_mismatch', 'duplicate_invoice', 'po_over_billed', 'payment_details_changed', 'recurring_suspected', 'vendor_price_drift') THEN 'unrelated_documents' ELSE found END AS kind FROM g)"""


@query(f"""{_FULL} SELECT exception_id, kind AS exception_type, verdict, found IN ('duplicate_invoice', 'po_over_billed', 'payment_details_changed', 'recurring_suspected', 'vendor_price_drift') AS cross_case,
CASE WHEN kind IN ('missing_purchase_order', 'duplicate_invoice', 'payment_details_changed', 'vendor_mismatch', 'missing_goods_receipt', 'unrelated_documents') THEN amount WHEN kind = 'po_over_billed' THEN (billed_c - po_c) / 100.0::DOUBLE WHEN kind = 'tax_total_mismatch' THEN abs(round(tv, 2))
 WHEN kind = 'quantity_variance' THEN CAST(round(CAST(greatest(0, q - rq) * abs(amount / q) AS DECIMAL(28,6)), 2) AS DOUBLE) WHEN kind = 'price_variance' AND price_out THEN CAST(round(CAST(abs(round(up - pp, 2)) * q AS DECIMAL(28,6)), 2) AS DOUBLE)
 WHEN kind = 'price_variance' THEN CASE WHEN part % 24 = 11 THEN 3.0 ELSE 20.0 END WHEN kind = 'vendor_price_drift' THEN CAST(round(CAST(2.0 * CASE WHEN q <> 0 THEN q ELSE 1 END AS DECIMAL(28,6)), 2) AS DOUBLE) ELSE 0 END::DOUBLE AS financial_impact FROM h""")
def full_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the cascade on data: history, lines and unconfirmed links join the three-way match."""
    return M.evaluate(full_inputs(spark, sf_dir)).select("exception_id", "exception_type", "verdict", "cross_case", "financial_impact")


@query(f"""{_IN} SELECT exception_id, CASE WHEN po AND NOT conflict THEN 'figures stand' WHEN po THEN 'withdrawn' ELSE 'no order' END AS state,
CAST(CASE WHEN NOT po OR conflict THEN 0 ELSE 4 + CAST(goods_receipt_exists AS INT) - 1 END AS INTEGER) AS cross_document, CAST(CASE WHEN po THEN 1 ELSE 0 END AS INTEGER) AS own FROM e""")
def withdrawn_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many comparisons across documents, and of a document with itself, can still be evaluated."""
    live = lambda own: F.size(F.filter("comparisons", lambda c: c["evaluable"] & ((c["field"] == "tax_arithmetic") == F.lit(own))))
    state = F.when(~F.col("purchase_order_exists"), F.lit("no order")).when(F.col("verdict") == "contradicted", F.lit("withdrawn")).otherwise(F.lit("figures stand"))
    return M.evaluate(inputs(spark, sf_dir)).select("exception_id", state.alias("state"), live(False).alias("cross_document"), live(True).alias("own"))


@query(f"""WITH {LEDGER} SELECT exception_id, CASE part % 4 WHEN 0 THEN NULL WHEN 1 THEN 4.0 WHEN 2 THEN 15.0 ELSE 20.0 END::DOUBLE AS worst, CAST(CASE part % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS outside,
CASE part % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'within_tolerance' ELSE 'outside_tolerance' END AS first_class FROM ledger""")
def worst_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that can't be priced, are within tolerance, or are beyond it, the second worse than the first."""
    k = F.col("part") % 4
    line = lambda name, price: F.struct(F.lit(name).alias("description"), F.lit(1.0).alias("quantity"), price.cast("double").alias("unit_price"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("hsn_sac"))
    po = F.array(line("alpha pipe", F.lit(100.0)), line("beta pipe", F.lit(100.0)))
    inv = F.when(k == 0, F.array(line("alpha pipe", F.lit(None)), line("beta pipe", F.lit(None)))).otherwise(F.array(line("Alpha pipe", F.when(k == 1, F.lit(104.0)).when(k == 2, F.lit(115.0)).otherwise(F.lit(110.0))), line("BETA-pipe", F.when(k == 3, F.lit(80.0)).otherwise(F.lit(100.0)))))
    rows = ledger(spark, sf_dir).select("exception_id", "part", M.compared_lines(po, inv, F.lit(5.0)).alias("l"))
    worst = F.array_max(F.transform("l", lambda x: F.abs(x["percentage_variance"])))
    outside = F.when(F.size(F.filter("l", lambda x: x["classification"] != "missing")) == 0, F.lit(1)).otherwise((F.size(F.filter("l", lambda x: x["classification"] == "outside_tolerance")) > 0).cast("int"))
    return rows.select("exception_id", worst.alias("worst"), outside.alias("outside"), F.get("l", F.lit(0))["classification"].alias("first_class"))


@query(f"""{_PAIRS}, l AS (SELECT expected AS label FROM p UNION SELECT predicted FROM p), s AS (SELECT label, (SELECT count(*) FROM p WHERE expected = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE predicted = label) AS pp, (SELECT count(*) FROM p WHERE expected = label) AS ep FROM l),
r AS (SELECT round(tp / nullif(pp, 0), 4) AS p, round(tp / nullif(ep, 0), 4) AS r, round(2.0 * (tp / nullif(pp, 0)) * (tp / nullif(ep, 0)) / nullif(tp / nullif(pp, 0) + tp / nullif(ep, 0), 0), 4) AS f FROM s)
SELECT round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(f), 4) AS macro_f1 FROM r""")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(decisions(spark, sf_dir))


@query(f"""WITH {CASES} SELECT exception_id, abs(financial_impact) * 0.25 AS largest FROM cases WHERE CAST(split_part(exception_id, '-', 2) AS BIGINT) % 8 = 0 AND financial_impact > 0.1 ORDER BY created_at DESC, exception_id LIMIT 25""")
def recent_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 25 overridden figures."""
    order = F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long")
    rows = cases(spark, sf_dir).select("exception_id", (F.col("financial_impact") * F.when(order % 8 == 0, 1.25).otherwise(1.0)).alias("ai_value"), F.col("financial_impact").alias("computed_value"), F.col("created_at").alias("checked_at"))
    return E.recent_overrides(E.trust_checks(rows)).select("exception_id", (F.col("ai_value") - F.col("computed_value")).alias("largest"))


@query(f"""WITH {CASES}, s AS (SELECT exception_id, exception_type, match_score, CAST(split_part(exception_id, '-', 2) AS BIGINT) % 3 AS k FROM cases)
SELECT exception_id, CASE WHEN k = 0 THEN exception_type ELSE 'computed' END AS exception_type, CASE WHEN k = 0 THEN match_score ELSE 77 END AS match_score FROM s""")
def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored outcome counts only whole: with both type and score."""
    k = F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long") % 3
    stored = cases(spark, sf_dir).select("exception_id", F.when(k != 1, F.col("exception_type")).alias("exception_type"), F.when(k != 2, F.col("match_score")).alias("match_score"), "financial_impact", "risk_level", "assigned_team")
    computed = stored.select("exception_id", F.lit("computed").alias("exception_type"), F.lit(77).alias("match_score"), F.lit(1.0).alias("financial_impact"), F.lit("low").alias("risk_level"), F.lit("Team").alias("recommended_owner"))
    return M.with_outcome(stored, computed).select("exception_id", "exception_type", "match_score")


@query(f"""WITH {CASES}, t AS (SELECT *, CASE WHEN CAST(split_part(exception_id, '-', 2) AS BIGINT) % 4 = 0 THEN 'assigned' WHEN CAST(split_part(exception_id, '-', 2) AS BIGINT) % 4 = 1 THEN NULL ELSE 'processing' END AS before FROM cases)
SELECT exception_id, CASE WHEN before = 'assigned' THEN 'assigned' WHEN exception_type = 'no_exception' THEN 'cleared' ELSE 'exception_detected' END AS status, risk_level AS severity,
CASE exception_type WHEN 'price_variance' THEN 'Vendor correction request' WHEN 'quantity_variance' THEN 'Confirm receipt with Receiving' WHEN 'missing_goods_receipt' THEN 'Obtain delivery confirmation' WHEN 'missing_purchase_order' THEN 'Locate or raise the purchase order'
 WHEN 'duplicate_invoice' THEN 'Hold payment; confirm re-submission' WHEN 'po_over_billed' THEN 'Amend the order or reject the excess' WHEN 'tax_total_mismatch' THEN 'Ask the vendor to restate the invoice' WHEN 'no_exception' THEN 'No action required' ELSE 'Review and route manually' END AS action, CASE WHEN match_score >= 95 THEN '95-100' WHEN match_score >= 80 THEN '80-94' WHEN match_score >= 60 THEN '60-79' ELSE 'below-60' END AS band FROM t""")
def after_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, severity, next step and score band that follow from a finding."""
    order = F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long") % 4
    before = F.when(order == 0, F.lit("assigned")).when(order != 1, F.lit("processing"))
    t = F.col("exception_type")
    return cases(spark, sf_dir).select("exception_id", evidence.status_after_analysis(before, t).alias("status"), evidence.severity(F.col("risk_level")).alias("severity"), evidence.next_action(t).alias("action"), keys.score_band(F.col("match_score")).alias("band"))


@query(f"""WITH {CASES}, k AS (SELECT exception_id, financial_impact AS c, CAST(split_part(exception_id, '-', 2) AS BIGINT) % 3 AS k FROM cases) SELECT exception_id, CASE k WHEN 0 THEN c + 0.005 ELSE c END AS value FROM k""")
def guarded_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated amounts that are immaterially off, far off, or absent."""
    c, k = F.col("financial_impact"), F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long") % 3
    return cases(spark, sf_dir).select("exception_id", evidence.guarded(F.when(k == 0, c + 0.005).when(k == 1, c * 2 + 5), c).alias("value"))


def sources_on_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each role that a case holds."""
    document = lambda has, suffix: F.when(has, F.concat("exception_id", F.lit(suffix)))
    return ledger(spark, sf_dir).select("exception_id", document(F.lit(True), "-I").alias("vendor_invoice"), document(F.col("purchase_order_exists"), "-P").alias("purchase_order"), document(F.col("goods_receipt_exists"), "-G").alias("goods_receipt_note"))


@query(f"""{LIVE}, k AS (SELECT exception_id, place * 3 AS o, 'Received quantity ' || x AS claim, exception_id || '-G' AS source_document_id, 'received_quantity' AS source_field FROM live WHERE f = 'quantity' UNION ALL
SELECT exception_id, place * 3 + 1, 'Invoice ' || replace(f, '_', ' ') || ' ' || y, exception_id || '-I', f FROM live WHERE f IN ('unit_price', 'quantity') UNION ALL
SELECT exception_id, place * 3 + 2, 'Purchase order unit price ' || x, exception_id || '-P', f FROM live WHERE f = 'unit_price'),
n AS (SELECT * FROM k UNION ALL SELECT exception_id, 0, 'Invoice on file', exception_id || '-I', 'total_amount' FROM e WHERE exception_id NOT IN (SELECT exception_id FROM k))
SELECT exception_id, CAST(row_number() OVER (PARTITION BY exception_id ORDER BY o) - 1 AS INTEGER) AS place, claim, source_document_id, source_field FROM n""")
def case_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation of every case, with the document and field it points at."""
    return evidence.citations(M.evaluate(inputs(spark, sf_dir)), sources_on_file(spark, sf_dir))


@query(f"""{LIVE} SELECT exception_id, 'Purchase order unit price ' || x AS claim, exception_id || '-P' AS source_document_id FROM live WHERE f = 'unit_price'""")
def price_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered prices that are cited."""
    rows = evidence.citations(M.evaluate(inputs(spark, sf_dir)), sources_on_file(spark, sf_dir))
    return rows.filter("claim like 'Purchase order unit price%'").select("exception_id", "claim", "source_document_id")


@query(f"""{LIVE}, s AS (SELECT *, CASE WHEN p IS NOT NULL THEN 'The ' || replace(f, '_', ' ') || ' on the invoice is ' || y || ', against an expected ' || x || ' — a variance of ' || format('{{:.2f}}', p) || '%, outside the ' || CASE f WHEN 'quantity' THEN '2.0' ELSE '5.0' END || '% tolerance.' END AS t FROM live WHERE bad),
w AS (SELECT exception_id, arg_min(t, place) FILTER (t IS NOT NULL) AS t, arg_min({{'f': replace(f, '_', ' '), 'x': x, 'y': y}}, place) AS b FROM s GROUP BY 1)
SELECT e.exception_id, CASE WHEN w.t IS NOT NULL THEN w.t WHEN w.b.f = 'vendor' THEN 'The vendor on the invoice (' || CASE WHEN CAST(vendor_id AS INT) % 2 = 0 THEN 'M/s ' || po_vendor_name || ' Pvt. Ltd.' ELSE po_vendor_name END || ') does not match the expected value (Another Company).'
 WHEN w.exception_id IS NOT NULL THEN 'The ' || w.b.f || ' on the invoice (' || w.b.y || ') does not match the expected value (' || w.b.x || ').' ELSE 'No comparison fell outside the configured tolerance.' END AS sentence FROM e LEFT JOIN w ON w.exception_id = e.exception_id""")
def variance_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluate(inputs(spark, sf_dir)).select("exception_id", evidence.variance_sentence(F.col("comparisons")).alias("sentence"))


@query("SELECT p_type AS exception_type, CAST(i AS INTEGER) AS rank, 'check ' || i || ' of ' || p_type AS check, greatest(0.2, round(0.55 - 0.1 * (i - 1), 2))::DOUBLE AS likelihood FROM (SELECT DISTINCT p_type FROM part), range(1, 7) r(i)")
def ranked_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type").distinct()
    checks = F.array(*[F.concat(F.lit(f"check {i} of "), "p_type") for i in range(1, 7)])
    return evidence.ranked_checks(kinds.select(F.col("p_type").alias("exception_type"), checks.alias("checks")))


@query(f"""WITH {LEDGER} SELECT exception_id, CASE WHEN line_number % 2 = 0 THEN 'ann,bob' ELSE 'ann' END AS participants FROM ledger""")
def case_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    uploads = rows.select("exception_id", F.when(F.col("line_number") % 2 == 0, F.lit("BOB")).otherwise(F.lit("")).alias("uploaded_by"))
    people = evidence.participants(rows.select("exception_id", F.lit(" Ann ").alias("created_by")), uploads.unionByName(rows.select("exception_id", F.lit("ann").alias("uploaded_by"))))
    return people.select("exception_id", F.array_join("participants", ",").alias("participants"))


@query(f"""{LIVE}, sides AS (SELECT exception_id, f, CASE f WHEN 'vendor' THEN CASE WHEN other_vendor THEN 'Another Company' WHEN CAST(vendor_id AS INT) % 2 = 0 THEN po_vendor_name || ' PRIVATE LIMITED' ELSE upper(po_vendor_name) END WHEN 'po_number' THEN 'PO-' || purchase_order_id ELSE x END AS x,
 CASE f WHEN 'vendor' THEN CASE WHEN CAST(vendor_id AS INT) % 2 = 0 THEN 'M/s ' || po_vendor_name || ' Pvt. Ltd.' ELSE po_vendor_name END WHEN 'po_number' THEN 'PO-' || purchase_order_id ELSE y END AS y, p, bad, inside, live.exception_type FROM live JOIN (SELECT exception_id, vendor_id, po_vendor_name, purchase_order_id, other_vendor FROM e) USING (exception_id)),
n AS (SELECT exception_id, exception_id || '-value-' || f AS id, 'extracted_value' AS t, f || ': expected ' || x || ' / actual ' || y AS l, coalesce('variance ' || CAST(p AS VARCHAR) || '%', '') AS d FROM sides UNION ALL
SELECT exception_id, exception_id || '-finding-' || f, 'finding', CASE WHEN bad THEN 'Outside Tolerance: ' ELSE 'Within Tolerance: ' END || f, exception_type FROM sides WHERE bad OR inside UNION ALL
SELECT exception_id, exception_id || '-rule-tolerance', 'business_rule', 'Tolerance rule', 'Price tolerance 5.0% · Quantity tolerance 2.0% (settings/tolerance_rules)' FROM e UNION ALL
SELECT exception_id, 'doc-' || exception_id || '-' || d.d, 'document', d.d, 'Type: ' || d.d || ' · Confidence: n/a' FROM e, (VALUES ('vendor_invoice'), ('purchase_order'), ('goods_receipt_note')) d(d) WHERE d.d = 'vendor_invoice' OR (d.d = 'purchase_order' AND po) OR (d.d = 'goods_receipt_note' AND goods_receipt_exists) UNION ALL
SELECT DISTINCT exception_id, exception_id || '-routing-action', 'routing', 'Recommended action', CASE exception_type WHEN 'price_variance' THEN 'Vendor correction request' WHEN 'quantity_variance' THEN 'Confirm receipt with Receiving' WHEN 'missing_goods_receipt' THEN 'Obtain delivery confirmation'
 WHEN 'vendor_mismatch' THEN 'Confirm the billing entity' WHEN 'tax_total_mismatch' THEN 'Ask the vendor to restate the invoice' WHEN 'no_exception' THEN 'No action required' ELSE 'Review and route manually' END FROM live WHERE bad OR inside UNION ALL
SELECT DISTINCT exception_id, exception_id || '-routing-owner', 'routing', 'Recommended owner', CASE exception_type WHEN 'price_variance' THEN 'Procurement' WHEN 'quantity_variance' THEN 'Receiving' WHEN 'missing_goods_receipt' THEN 'Requesting business unit' WHEN 'vendor_mismatch' THEN 'Procurement' WHEN 'no_exception' THEN 'No action required' ELSE 'Accounts Payable' END FROM live WHERE bad OR inside)
SELECT exception_id, string_agg(concat_ws('|', id, t, l, d), chr(10) ORDER BY id) AS nodes FROM n GROUP BY exception_id""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of each case's evidence graph."""
    nodes = evidence.graph_nodes(*analysed_papers(spark, sf_dir))
    row = F.struct("id", F.concat_ws("|", "id", "type", "label", F.coalesce("detail", F.lit(""))).alias("text"))
    return nodes.groupBy("exception_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"]), "\n").alias("nodes"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'Invoice ' || c_custkey || ' from Acme' ELSE repeat('x', 120) END AS title FROM customer")
def case_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.lit(" \t\n")).when(k == 1, F.concat(F.lit(" Invoice\n\t"), "c_custkey", F.lit("  from Acme "))).otherwise(F.repeat(F.lit("x"), F.lit(500)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", keys.title(raw).alias("title"))


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice, order and receipt of each ledger row with their extractions.

    Some invoices were replaced by a later one, of another amount or the same; after
    some comes an upload that failed; some orders and receipts never completed.
    """
    c = F.col
    money = lambda x: c(x) / F.lit(100.0)
    own = F.concat(F.lit("PO-"), "purchase_order_id")
    facts = {
        "vendor_invoice": {"invoice_number": c("invoice_number"), "vendor_name": c("vendor_name"), "po_number": own, "invoice_date": F.date_format("created_at", "dd/MM/yyyy"), "line_item_description": c("part").cast("string"), "quantity": c("qty").cast("double"), "unit_price": money("unit_c"),
                           "subtotal": money("subtotal_c"), "tax_amount": money("tax_c"), "total_amount": money("total_c"), "bank_account_number": c("bank_account")},
        "purchase_order": {"vendor_name": F.when(c("vendor_id").cast("long") % 2 == 0, F.concat("po_vendor_name", F.lit(" PRIVATE LIMITED"))).otherwise(c("po_vendor_name")), "po_number": F.concat(F.lit("po "), "purchase_order_id"), "unit_price": money("po_unit_c"), "total_amount": money("po_c")},
        "goods_receipt_note": {"po_number": own, "received_quantity": c("received_qty").cast("double")},
    }
    there = {"purchase_order": c("purchase_order_exists"), "goods_receipt_note": c("goods_receipt_exists")}

    def document(kind: str) -> Column:
        fields = [facts[kind].get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT["extraction"].dataType]
        made = F.struct(F.concat_ws("-", "exception_id", F.lit(kind)).alias("document_id"), F.lit(kind).alias("document_type"), F.struct(*fields).alias("extraction"))
        return F.when(there.get(kind, F.lit(True)), made)

    rows = ledger(spark, sf_dir).select("exception_id", "workspace_id", "uploaded_at", "part", "total_c", F.explode(F.array_compact(F.array(*map(document, facts)))).alias("d"))
    state = F.when((c("d.document_type") == "purchase_order") & (c("part") % 23 == 7), F.lit("failed")).when((c("d.document_type") == "goods_receipt_note") & (c("part") % 29 == 11), F.lit("processing")).otherwise(F.lit("completed"))
    rows = rows.select("d.document_id", "exception_id", "workspace_id", "d.document_type", state.alias("processing_state"), "uploaded_at", "d.extraction", "part", "total_c")
    invoice = rows.filter("document_type = 'vendor_invoice'")
    other = lambda suffix, hours, amount: {"document_id": F.concat("exception_id", F.lit(suffix)), "uploaded_at": c("uploaded_at") + F.make_dt_interval(hours=F.lit(hours)), "extraction": c("extraction").withField("total_amount", amount)}
    before = invoice.filter("part % 17 = 5").withColumns(other("-S", -6, (c("total_c") + F.when(c("part") % 2 == 0, 700).otherwise(0)) / F.lit(100.0)))
    broken = invoice.filter("part % 19 = 3").withColumns(other("-X", 6, F.lit(1.0))).withColumn("processing_state", F.lit("failed"))
    return rows.unionByName(before).unionByName(broken).drop("part", "total_c")


_OWN = """ledger AS (SELECT * REPLACE (purchase_order_exists AND part % 23 <> 7 AS purchase_order_exists, goods_receipt_exists AND part % 29 <> 11 AS goods_receipt_exists) FROM ledger0)"""
_CASE = f"""WITH {LEDGER.replace("ledger AS (SELECT 'EXC-'", "ledger0 AS (SELECT 'EXC-'")}, {_OWN}, billed AS (SELECT *, exception_id AS document_id, true AS prime FROM ledger UNION ALL
 SELECT * REPLACE (total_c + CASE WHEN part % 2 = 0 THEN 700 ELSE 0 END AS total_c, uploaded_at - INTERVAL 6 HOUR AS uploaded_at), exception_id || '-S', false FROM ledger WHERE part % 17 = 5),
{_INV[_INV.index('inv AS (SELECT'):]}, {_IN[len(f'WITH {LEDGER}, '):]},
dup AS (SELECT a.exception_id, count(b.exception_id) > 0 AS exact FROM inv a LEFT JOIN inv b ON a.workspace_id = b.workspace_id AND a.vendor_key = b.vendor_key AND a.number_key = b.number_key AND a.exception_id <> b.exception_id WHERE a.prime GROUP BY 1),
near AS (SELECT DISTINCT a.exception_id, a.workspace_id, a.vendor_key, a.total_c {NEAR}),
gap AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER w, d) > 0 THEN date_diff('day', lag(d) OVER w, d) END AS gap FROM inv WINDOW w AS (PARTITION BY workspace_id, vendor_key, total_c ORDER BY d, exception_id)),
cyc AS (SELECT workspace_id, vendor_key, total_c FROM gap GROUP BY ALL HAVING count(*) >= 3 AND count(gap) >= 2 AND avg(gap) BETWEEN 20 AND 400 AND stddev_pop(gap) / avg(gap) <= 0.25),
bank AS (SELECT workspace_id, vendor_key, exception_id, bank_account, row_number() OVER (PARTITION BY workspace_id, vendor_key ORDER BY uploaded_at DESC, document_id DESC) AS rank FROM (SELECT * FROM inv QUALIFY row_number() OVER (PARTITION BY exception_id ORDER BY uploaded_at DESC, document_id DESC) = 1)),
pay AS (SELECT i.exception_id FROM (SELECT * FROM inv WHERE prime) i JOIN bank l ON l.workspace_id = i.workspace_id AND l.vendor_key = i.vendor_key AND l.rank <= 2 AND l.exception_id <> i.exception_id QUALIFY row_number() OVER (PARTITION BY i.exception_id ORDER BY l.rank) = 1 AND lower(l.bank_account) <> lower(i.bank_account)),
price AS (SELECT *, date_diff('day', min(d) OVER s, d) / 30.44::DOUBLE AS months, unit_c - lag(unit_c) OVER (PARTITION BY workspace_id, vendor_key, part ORDER BY d, exception_id) AS step FROM inv WINDOW s AS (PARTITION BY workspace_id, vendor_key, part)),
drift AS (SELECT workspace_id, vendor_key, part, regr_slope(unit_c / 100.0::DOUBLE, months) AS slope, arg_min(unit_c, (d, exception_id)) / 100.0::DOUBLE AS a, arg_max(unit_c, (d, exception_id)) / 100.0::DOUBLE AS b FROM price GROUP BY ALL
 HAVING count(*) >= 4 AND max(months) > 0 AND slope > 0 AND slope / a * 100 >= 0.5 AND (b - a) / a * 100 >= 5 AND count(*) FILTER (step < -1) = 0 AND count(*) FILTER (step > 1) * 2 > count(*) - 1),
per_order AS (SELECT workspace_id, purchase_order_id, sum(total_c) AS c, count(*) AS n FROM inv GROUP BY ALL), per_case AS (SELECT exception_id, sum(total_c) AS c, count(*) AS n FROM inv GROUP BY ALL),
bill AS (SELECT i.exception_id, o.c - p.c + i.total_c AS billed_c, o.n - p.n + 1 AS billed_n FROM inv i JOIN per_order o ON o.workspace_id = i.workspace_id AND o.purchase_order_id = i.purchase_order_id JOIN per_case p ON p.exception_id = i.exception_id WHERE i.prime),
k AS (SELECT v.exception_id, v.part, CASE WHEN NOT v.po THEN 'missing_purchase_order' WHEN dup.exact THEN 'duplicate_invoice' WHEN pay.exception_id IS NOT NULL THEN 'payment_details_changed' WHEN false AND billed_c - v.po_c > 1 AND billed_n > 1 THEN 'po_over_billed'
 WHEN near.exception_id IS NOT NULL AND cyc.total_c IS NULL THEN 'duplicate_invoice' WHEN o.tax_out THEN 'tax_total_mismatch' WHEN NOT v.goods_receipt_exists THEN 'missing_goods_receipt' WHEN o.qty_out THEN 'quantity_variance' WHEN abs(o.pv) > 5 OR o.pv IS NULL THEN 'price_variance'
 WHEN near.exception_id IS NOT NULL THEN 'recurring_suspected' WHEN drift.part IS NOT NULL THEN 'vendor_price_drift' ELSE 'no_exception' END AS kind
 FROM v JOIN o USING (exception_id) JOIN dup USING (exception_id) JOIN bill USING (exception_id) JOIN (SELECT * FROM inv WHERE prime) inv ON inv.exception_id = v.exception_id LEFT JOIN near ON near.exception_id = v.exception_id LEFT JOIN pay ON pay.exception_id = v.exception_id
 LEFT JOIN cyc ON cyc.workspace_id = near.workspace_id AND cyc.vendor_key = near.vendor_key AND cyc.total_c = near.total_c LEFT JOIN drift ON drift.workspace_id = inv.workspace_id AND drift.vendor_key = inv.vendor_key AND drift.part = inv.part)"""


@query(f"""{_CASE} SELECT exception_id, kind AS exception_type, CASE WHEN part % 4 = 0 THEN 'assigned' WHEN kind = 'no_exception' THEN 'cleared' ELSE 'exception_detected' END AS status FROM k""")
def case_orchestration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to links, history, tolerances, match and status in one plan; orders state no tax, so no total can be compared with what was billed."""
    rules = spark.createDataFrame([("default", None, 5.0, 2.0), ("category", "services", 50.0, 50.0)], "scope string, name string, price double, quantity double")
    rows = ledger(spark, sf_dir).select("exception_id", F.when(F.col("part") % 4 == 0, F.lit("assigned")).when(F.col("part") % 4 == 1, F.lit("received")).otherwise(F.lit("processing")).alias("status"))
    return O.analysed(rows, case_documents(spark, sf_dir), rules).select("exception_id", "exception_type", "status")


@query(f"""{_CASE} SELECT exception_id, kind AS exception_type FROM k""")
def late_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without some late documents, brought up to date when these come: as if all had been there."""
    rules = spark.createDataFrame([("default", None, 5.0, 2.0)], "scope string, name string, price double, quantity double")
    every = store.written(case_documents(spark, sf_dir))
    late = every.filter(F.pmod(F.xxhash64("document_id"), F.lit(100)) == 0)
    first = store.written(O.matched(every.join(late, "document_id", "left_anti"), rules).select("exception_id", "exception_type"))
    return O.reanalysed(first, every, late, rules)


@query(f"""WITH {LEDGER}, m AS (SELECT exception_id, CASE WHEN part % 9 = 0 THEN NULL ELSE total_c / 100.0::DOUBLE * CASE WHEN part % 4 = 0 THEN 1000 WHEN part % 4 = 1 THEN 10 ELSE 1 END END AS v, CAST(floor(total_c / 100.0::DOUBLE * CASE WHEN part % 4 = 0 THEN 1000 WHEN part % 4 = 1 THEN 10 ELSE 1 END + 0.5) AS BIGINT) AS w FROM ledger),
t AS (SELECT *, CASE WHEN v IS NULL THEN '—' WHEN w < 1000 THEN '₹' || w ELSE '₹' || reverse(regexp_replace(reverse(CAST(w // 1000 AS VARCHAR)), '([0-9]{{2}})', '\\1,', 'g')) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') END AS raw FROM m),
g AS (SELECT *, regexp_replace(raw, '₹,', '₹') AS shown, CAST(round(v * 100) AS BIGINT) AS cents FROM t), h AS (SELECT *, (cents + 5000000) // 10000000 AS c, (cents + 50000) // 100000 AS l FROM g) SELECT exception_id, shown, CASE WHEN v IS NULL THEN '—' WHEN v >= 10000000 THEN '₹' || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || 'Cr' WHEN v >= 100000 THEN '₹' || l // 100 || '.' || lpad(CAST(l % 100 AS VARCHAR), 2, '0') || 'L' ELSE shown END AS short FROM h""")
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("part")
    value = F.when(part % 9 != 0, F.col("total_c") / F.lit(100.0) * F.when(part % 4 == 0, 1000).when(part % 4 == 1, 10).otherwise(1))
    return ledger(spark, sf_dir).select("exception_id", keys.money_text(value).alias("shown"), keys.money_short(value).alias("short"))


@query(f"""{_FULL}, r AS (SELECT kind, found IN ('duplicate_invoice', 'po_over_billed', 'payment_details_changed', 'recurring_suspected', 'vendor_price_drift') AS c FROM h) SELECT count(*) FILTER (c) AS exceptions_found, round(count(*) FILTER (c) / count(*) FILTER (kind <> 'no_exception'), 4) AS share_of_exceptions FROM r""")
def cross_case_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.evaluate(full_inputs(spark, sf_dir)).select(F.col("exception_type").alias("predicted"), "cross_case", "financial_impact")
    return E.cross_case_share(rows).drop("value")


@query(f"WITH {CASES} SELECT exception_id, round(financial_impact * 1.248, 2) AS stated, financial_impact > 0.04 AS overridden FROM cases")
def injected_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard rails put to the test: figures that are wrong on purpose are caught."""
    rows = cases(spark, sf_dir).select("exception_id", E.with_fault(F.col("financial_impact")).alias("ai_value"), F.col("financial_impact").alias("computed_value"))
    return E.trust_checks(rows).select("exception_id", F.col("ai_value").alias("stated"), "overridden")


@query(f"WITH {CASES}, s AS (SELECT exception_id, CASE WHEN exception_type <> 'no_exception' THEN exception_type END AS t FROM cases) SELECT exception_id, t AS exception_type, CAST(row_number() OVER (ORDER BY t ASC NULLS LAST, exception_id) AS BIGINT) AS place FROM s")
def queue_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue by a text column: rows not analysed come last."""
    from ledgerloom.operators import registers as R

    rows = cases(spark, sf_dir).select("exception_id", F.when(F.col("exception_type") != "no_exception", F.col("exception_type")).alias("exception_type"))
    return R.placed(R.register_sort(rows, "exception_type"))
