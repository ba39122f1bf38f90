"""Evidence graph, citations, ranked checks, approval, status rules and the trust ledger."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.operators import evidence as V
from ledgerloom.operators import matching as M


@pytest.fixture(scope="module")
def analysed(spark):
    row = ("1", "Acme", "Acme", "PO-1", "PO-1", True, True, 110.0, 11.0, 10.0, 10.0, 10.0)
    schema = "exception_id string, vendor_name string, po_vendor_name string, invoice_po_number string, po_number string, purchase_order_exists boolean, goods_receipt_exists boolean, invoice_amount double, invoice_unit_price double, po_unit_price double, invoice_quantity double, received_quantity double"
    return M.evaluate(spark.createDataFrame([row], schema)).select("exception_id", "exception_type", "recommended_owner", "price_tolerance", "quantity_tolerance", "comparisons")


PAPERS = "exception_id string, document_type string, document_id string"


def test_graph_of_a_price_variance(spark, analysed):
    docs = spark.createDataFrame([("1", "vendor_invoice", "I"), ("1", "purchase_order", "P"), ("1", "purchase_order", "OLD"), ("1", "rejection_notice", "R")], PAPERS)
    sources = spark.createDataFrame([("1", "purchase_order", "P"), ("1", "vendor_invoice", "I"), ("1", "goods_receipt_note", None)], PAPERS)
    got = {(r.source, r.relationship, r.target) for r in V.graph_edges(analysed, docs, sources).collect()}
    value, finding = "1-value-unit_price", "1-finding-unit_price"
    assert {(value, "extracted_from", "doc-P"), (value, "extracted_from", "doc-I"), (value, "evaluated_against", "1-rule-tolerance"), (value, "produces", finding), (finding, "routed_to", "1-routing-owner"), (finding, "routed_to", "1-routing-action")} <= got
    assert {t for s, k, t in got if s == "1-value-quantity" and k == "extracted_from"} == {"doc-I"}, "no receipt is on file"
    assert not [x for x in got if "doc-R" in x or "doc-OLD" in x or "1-finding-vendor" in x]
    nodes = {r.id: (r.type, r.label, r.detail) for r in V.graph_nodes(analysed, docs.withColumn("confidence", F.lit(0.9))).collect()}
    assert {x for s, _, t in got for x in (s, t)} <= set(nodes)
    assert nodes[value] == ("extracted_value", "unit_price: expected 10.0 / actual 11.0", "variance 10.0%")
    assert nodes[finding] == ("finding", "Outside Tolerance: unit_price", "price_variance")
    assert nodes["doc-R"] == ("document", "rejection_notice", "Type: rejection_notice · Confidence: 0.9")
    assert nodes["1-rule-tolerance"][2] == "Price tolerance 5.0% · Quantity tolerance 2.0% (settings/tolerance_rules)"
    assert (nodes["1-routing-owner"][2], nodes["1-routing-action"][2]) == ("Procurement", "Vendor correction request")


def test_citations_point_at_documents(spark, analysed):
    schema = "exception_id string, vendor_invoice string, purchase_order string, goods_receipt_note string"
    cited = lambda *row: [tuple(r)[2:] for r in V.citations(analysed, spark.createDataFrame([row], schema)).orderBy("place").collect()]
    full = [("Invoice unit price 11.0", "I", "unit_price"), ("Purchase order unit price 10.0", "P", "unit_price"), ("Received quantity 10.0", "G", "received_quantity"), ("Invoice quantity 10.0", "I", "quantity")]
    assert cited("1", "I", "P", "G") == full
    assert cited("1", "I", None, None) == [full[0], full[3]]
    bare = analysed.withColumn("comparisons", F.filter("comparisons", lambda c: c["field"] == "vendor"))
    rows = V.citations(bare, spark.createDataFrame([("1", "I", "P", "G")], schema)).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "Invoice on file", "I", "total_amount")]
    assert V.citations(bare, spark.createDataFrame([("1", None, None, None)], schema)).count() == 0


def test_variance_sentences(spark, analysed):
    said = lambda df: df.select(V.variance_sentence(F.col("comparisons")).alias("s")).first().s
    assert said(analysed) == "The unit price on the invoice is 11.0, against an expected 10.0 — a variance of 10.00%, outside the 5.0% tolerance."
    other = analysed.withColumn("comparisons", F.transform("comparisons", lambda c: F.when(c["field"] == "vendor", c.withField("classification", F.lit("outside_tolerance")).withField("actual_str", F.lit("Zenith"))).otherwise(c.withField("classification", F.lit("matched")))))
    assert said(other) == "The vendor on the invoice (Zenith) does not match the expected value (Acme)."
    assert said(analysed.withColumn("comparisons", F.filter("comparisons", lambda c: c["field"] == "po_number"))) == "No comparison fell outside the configured tolerance."


def test_figures_in_plain_digits(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 5.0, 2650.0, 10.42, 12345678.0, 12345678.25, -98765432.5, None)], "x double")
    assert [r.t for r in rows.select(V.number_text(F.col("x")).alias("t")).collect()] == ["0.0", "5.0", "2650.0", "10.42", "12345678.0", "12345678.25", "-98765432.5", None]


def test_labels(spark):
    rows = spark.createDataFrame([("high", "vendor_price_drift"), ("critical", "no_exception"), ("low", "unrelated_documents"), ("odd", "recurring_suspected"), (None, None)], "risk string, kind string")
    got = [tuple(r) for r in rows.select(V.severity(F.col("risk")), V.next_action(F.col("kind"))).collect()]
    assert got == [("high", "Re-quote or check the escalation clause"), ("critical", "No action required"), ("low", "Review and route manually"), ("medium", "Confirm this is not a second copy"), ("medium", "Review and route manually")]


def test_approval_and_participants(spark):
    cases = spark.createDataFrame([("1", " Ann ")], "exception_id string, created_by string")
    docs = spark.createDataFrame([("1", "BOB"), ("1", None), ("1", "ann")], "exception_id string, uploaded_by string")
    assert V.participants(cases, docs).first().participants == ["ann", "bob"]
    limits = spark.createDataFrame([("manager", 100.0, 1), ("director", None, 2), ("MANAGER", 5.0, 3)], "role string, max_value double, place int")
    asked = spark.createDataFrame(
        [
            ("1", "resolved", "eve", "Manager", 100.0, ["bob"]), ("2", "closed", "eve", "manager", 100.5, ["bob"]), ("3", "resolved", " Bob", "director", 1.0, ["bob"]), ("4", "approved_with_exception", "eve", "director", 1e9, None),
            ("5", "resolved", "eve", "guest", 1.0, []), ("6", "resolved", "bob", "guest", 1.0, ["bob"]), ("7", "assigned", "bob", "guest", 1e9, ["bob"]), ("8", "closed", "eve", None, 50.0, []), ("9", "closed", "bob", None, 1.0, ["bob"]),
        ],
        "exception_id string, new_status string, actor string, role string, amount double, participants array<string>",
    )
    decided = lambda *a, **k: {r.exception_id: r.decision for r in V.approval(asked, *a, **k).collect()}
    ok, duties, role, limit = "approved", "segregation_of_duties", "role_not_authorized", "approval_limit_exceeded"
    assert decided(limits) == {"1": ok, "2": limit, "3": duties, "4": ok, "5": role, "6": duties, "7": ok, "8": role, "9": duties}
    assert decided(limits, segregated=False, default_role="manager") == {"1": ok, "2": limit, "3": ok, "4": ok, "5": role, "6": role, "7": ok, "8": ok, "9": ok}
    assert decided(limits.limit(0)) == {"1": ok, "2": ok, "3": duties, "4": ok, "5": ok, "6": duties, "7": ok, "8": ok, "9": duties}
    assert set(decided(None).values()) == {ok}


def test_the_first_of_several_rules_counts(spark):
    schema = "scope string, name string, price double, quantity double, place int"
    rules = spark.createDataFrame([("default", None, 5.0, 2.0, 0), ("vendor", "ACME LTD.", 9.0, None, 2), ("vendor", "Acme Ltd", None, None, 1), ("category", "services", 1.0, None, 0)], schema)
    cases = spark.createDataFrame([("1", "acme ltd", "goods"), ("2", "acme ltd", "services"), ("3", "Other", "Services"), ("4", None, "services"), ("5", "", None)], "exception_id string, vendor_name string, category string")
    got = {r.exception_id: (r.price_tolerance, r.quantity_tolerance, r.tolerance_source) for r in M.resolved_tolerance(cases, rules).collect()}
    assert got == {
        "1": (5.0, 2.0, "vendor rule: Acme Ltd"), "2": (1.0, 2.0, "vendor rule: Acme Ltd"), "3": (5.0, 2.0, "workspace default"), "4": (1.0, 2.0, "category rule: services"), "5": (5.0, 2.0, "workspace default"),
    }


def test_rules(spark):
    rows = spark.createDataFrame([("assigned", "price_variance", 10.0, 12.0), ("processing", "no_exception", 5.0, 5.0), (None, "price_variance", None, 3.0)], "status string, kind string, stated double, computed double")
    got = rows.select(V.status_after_analysis(F.col("status"), F.col("kind")).alias("s"), V.guarded(F.col("stated"), F.col("computed")).alias("g"), V.status_change(F.col("status")).alias("e")).collect()
    assert [(r.s, r.g, r.e) for r in got] == [("assigned", 12.0, None), ("cleared", 5.0, None), ("exception_detected", 3.0, "missing_status")]
    checks = spark.createDataFrame([("price_variance", ["a", "b", "c", "d", "e"])], "exception_type string, checks array<string>")
    assert [r.likelihood for r in V.ranked_checks(checks).orderBy("rank").collect()] == [0.55, 0.45, 0.35, 0.25, 0.2]


def test_trust_ledger(spark):
    nothing = E.trust_checks(spark.createDataFrame([("1", None, 7.0)], "exception_id string, ai_value double, computed_value double")).first()
    assert (nothing.difference, nothing.difference_percent, nothing.overridden) == (0.0, None, False)
    less = E.trust_checks(spark.createDataFrame([("1", 5.0, 7.0)], "exception_id string, ai_value double, computed_value double")).first()
    assert (less.difference, less.difference_percent, less.overridden) == (2.0, 28.5714, True)
    rows = [("1", 100.0, 100.0, "live"), ("1", 124.8, 100.0, "live"), ("2", 5.0, 0.0, "live"), ("3", 9.0, 1.0, "fault_injection")]
    checks = E.trust_checks(spark.createDataFrame(rows, "exception_id string, ai_value double, computed_value double, kind string"))
    r = E.trust_summary(checks).first()
    assert (r.checks, r.cases, r.overrides, r.significant, r.largest, r.prevented, r.injected, r.override_rate) == (3, 2, 2, 1, 24.8, 29.8, 1, 0.6667)
