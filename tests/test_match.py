"""The match engine on small cases with known answers, and negatives for each check."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching as M

BASE = dict(vendor_name="Acme Pvt Ltd", po_vendor_name="ACME Private Limited", invoice_po_number="PO-1", po_number="PO-1", purchase_order_exists=True, goods_receipt_exists=True)
KINDS = {**M._INPUT, "exception_id": "string"}


def run(spark, *cases):
    rows = [{**BASE, "exception_id": str(i), **c} for i, c in enumerate(cases)]
    schema = ", ".join(f"{c} {k}" for c, k in KINDS.items())
    df = spark.createDataFrame([tuple(r.get(c) for c in KINDS) for r in rows], schema)
    out = M.evaluate(df).select("exception_id", "exception_type", "financial_impact", "match_score", "risk_level", "verdict", "recommended_owner", "comparisons")
    return sorted(out.collect(), key=lambda r: int(r.exception_id))


def line(d, q, p, code=None):
    return (d, q, p, None if q is None or p is None else q * p, code)


def test_golden_cases(spark):
    a, b, c = run(
        spark,
        dict(po_unit_price=2400.0, invoice_unit_price=2650.0, invoice_quantity=100.0, received_quantity=100.0, invoice_amount=265000.0),
        dict(po_unit_price=630.0, invoice_unit_price=630.0, invoice_quantity=500.0, received_quantity=420.0, invoice_amount=315000.0),
        dict(goods_receipt_exists=False, invoice_amount=180000.0, po_unit_price=10.0, invoice_unit_price=10.0, invoice_quantity=1.0),
    )
    price = next(x for x in a.comparisons if x.field == "unit_price")
    assert (a.exception_type, a.financial_impact, price.percentage_variance, a.recommended_owner) == ("price_variance", 25000.0, 10.42, "Procurement")
    quantity = next(x for x in b.comparisons if x.field == "quantity")
    assert (b.exception_type, b.financial_impact, quantity.percentage_variance, b.recommended_owner) == ("quantity_variance", 50400.0, 19.05, "Receiving")
    assert (c.exception_type, c.financial_impact, c.recommended_owner) == ("missing_goods_receipt", 180000.0, "Requesting business unit")


@pytest.mark.parametrize(
    ("change", "kind", "impact"),
    [
        (dict(), "no_exception", 0.0),
        (dict(purchase_order_exists=False, duplicate_confidence="exact"), "missing_purchase_order", 100.0),
        (dict(duplicate_confidence="exact", payment_changed=True), "duplicate_invoice", 100.0),
        (dict(payment_changed=True), "payment_details_changed", 100.0),
        (dict(duplicate_confidence="near"), "duplicate_invoice", 100.0),
        (dict(po_vendor_name="Other"), "vendor_mismatch", 100.0),
        (dict(invoice_subtotal=80.0, tax_amount=8.0, invoice_total=100.0), "tax_total_mismatch", 12.0),
        (dict(duplicate_confidence="recurring"), "recurring_suspected", 0.0),
        (dict(drift_first=8.0, drift_latest=10.0, drift_percent=25.0), "vendor_price_drift", 20.0),
        (dict(invoice_unit_price=10.5), "no_exception", 0.0),  # the limit itself is within
        (dict(invoice_unit_price=0.0, po_unit_price=0.0), "no_exception", 0.0),
        (dict(po_unit_price=0.0), "price_variance", 100.0),
        (dict(received_quantity=12.0), "quantity_variance", 0.0),  # below the receipt: nothing at risk
        (dict(po_number="PO-2"), "unrelated_documents", 100.0),
        (dict(po_number="PO-2", payment_changed=True), "payment_details_changed", 100.0),
    ],
)
def test_cascade(spark, change, kind, impact):
    (r,) = run(spark, dict(invoice_amount=100.0, invoice_unit_price=10.0, po_unit_price=10.0, invoice_quantity=10.0, received_quantity=10.0) | change)
    assert (r.exception_type, r.financial_impact) == (kind, impact)
    if change.get("po_number"):
        assert r.verdict == "contradicted" and r.match_score == 0


def test_lines_pair_greedily_by_prefix(spark):
    df = spark.createDataFrame([([line("Steel pipe", 2.0, 10.0), line("Bolt", 1.0, 5.0), line(None, 1.0, 1.0)], [line("BOLT", 4.0, 6.0), line("steel-pipe 50mm", 2.0, 10.0), line("Extra", 1.0, 7.0)])], f"po {M.LINES}, inv {M.LINES}")
    lines = df.select(M.compared_lines(F.col("po"), F.col("inv"), F.lit(5.0)).alias("l")).first().l
    assert [(x.description, x.classification, x.only_on) for x in lines] == [("steel-pipe 50mm", "matched", None), ("BOLT", "outside_tolerance", None), (None, "missing", "purchase_order"), ("Extra", "missing", "invoice")]
    assert df.select(M.line_overcharge(M.compared_lines(F.col("po"), F.col("inv"), F.lit(5.0))).alias("s")).first().s == 4.0


def test_coherence(spark):
    pipes, chairs = [line("Mild steel pipe", 1.0, 1.0)], [line("Ergonomic office chair", 1.0, 1.0)]
    common = dict(invoice_amount=240.0, invoice_unit_price=1.0, po_unit_price=1.0, invoice_quantity=1.0, received_quantity=1.0)
    far, near, same = run(
        spark, common | dict(po_line_items=chairs, invoice_line_items=pipes, invoice_total=240.0, po_total=54.0), common | dict(po_line_items=chairs, invoice_line_items=pipes, invoice_total=30.0, po_total=120.0),
        common | dict(po_line_items=pipes, invoice_line_items=pipes, invoice_total=240.0, po_total=54.0),
    )
    assert (far.verdict, far.exception_type) == ("contradicted", "unrelated_documents")
    assert near.verdict == "unverified" and same.verdict == "consistent"
