"""Three-way match, coherence check and classification, one row per case.

``evaluate`` takes the wide matching input: names and references
(``vendor_name, po_vendor_name, invoice_po_number, po_number,
receipt_po_number``), flags (``purchase_order_exists, goods_receipt_exists``),
nullable figures (``invoice_amount, invoice_total, invoice_subtotal, tax_amount,
po_total, po_subtotal, po_tax_amount, quotation_total, invoice_unit_price,
po_unit_price, invoice_quantity, received_quantity``), arrays of lines
(``po_line_items, invoice_line_items``), ``link_warnings``, the history columns
(``duplicate_confidence, payment_changed, order_value, total_billed, over_billed_by,
invoice_count, drift_first, drift_latest, drift_percent``) and the tolerances.
Missing columns count as null.  Null never becomes 0 before a class is decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import variance as V
from ledgerloom.functions.keys import billable_quantity, document_tokens, unicode_key, vendor_key
from ledgerloom.model import CROSS_DOCUMENT_FIELDS, EXPLICABLE_MULTIPLE, PRICE_TOLERANCE, QUANTITY_TOLERANCE, SURVIVES_INCOHERENCE

LINES = "array<struct<description:string,quantity:double,unit_price:double,amount:double,hsn_sac:string>>"
_LINE = LINES[6:-1]
_PAIR = f"struct<po:{_LINE},inv:{_LINE}>"
_INPUT = {
    **dict.fromkeys(("vendor_name", "po_vendor_name", "invoice_po_number", "po_number", "receipt_po_number", "duplicate_confidence"), "string"),
    **dict.fromkeys(
        ("invoice_amount", "invoice_total", "invoice_subtotal", "tax_amount", "po_total", "po_subtotal", "po_tax_amount", "quotation_total", "invoice_unit_price", "po_unit_price", "invoice_quantity",
         "received_quantity", "order_value", "total_billed", "over_billed_by", "drift_first", "drift_latest", "drift_percent", "price_tolerance", "quantity_tolerance", "high_value_threshold"), "double",
    ),
    **dict.fromkeys(("po_line_items", "invoice_line_items"), LINES), "invoice_count": "bigint", "payment_changed": "boolean", "purchase_order_exists": "boolean", "goods_receipt_exists": "boolean",
    "link_warnings": "array<struct<code:string,role:string>>",
}


def completed(inputs: DataFrame) -> DataFrame:
    """The input with all its columns, in their types."""
    have = set(inputs.columns)
    out = inputs.withColumns({c: (F.col(c) if c in have else F.lit(None)).cast(kind) for c, kind in _INPUT.items()})
    default = {"purchase_order_exists": True, "goods_receipt_exists": True, "payment_changed": False, "price_tolerance": PRICE_TOLERANCE, "quantity_tolerance": QUANTITY_TOLERANCE}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})


def paired_lines(po: Column, invoice: Column) -> Column:
    """Greedy pairs of ordered and billed lines, then what is left on the invoice.

    Each ordered line takes the first remaining billed line whose key equals its
    own or begins with it, or the other way round.
    """
    empty = F.array().cast(LINES)
    # Keys are made once a line, before lines are held against each other.
    keyed = F.transform(F.coalesce(po, empty), lambda x: F.struct(unicode_key(x["description"]).alias("key"), x.alias("x")))
    numbered = F.transform(F.coalesce(invoice, empty), lambda x, i: F.struct(i.alias("i"), unicode_key(x["description"]).alias("key"), x.alias("x")))
    start = F.struct(numbered.alias("rest"), F.array().cast(f"array<{_PAIR}>").alias("pairs"))

    def step(acc: Column, line: Column) -> Column:
        fits = lambda c: (line["key"] != "") & (c["key"] != "") & (c["key"].startswith(line["key"]) | line["key"].startswith(c["key"]))
        chosen = F.get(F.filter(acc["rest"], fits), F.lit(0))

        def taken(c: Column) -> Column:
            rest = F.filter(acc["rest"], lambda x: c.isNull() | (x["i"] != c["i"]))
            return F.struct(rest.alias("rest"), F.concat(acc["pairs"], F.array(F.struct(line["x"].alias("po"), c["x"].alias("inv")).cast(_PAIR))).alias("pairs"))

        return F.get(F.transform(F.array(chosen), taken), F.lit(0))

    left = lambda acc: F.transform(acc["rest"], lambda c: F.struct(F.lit(None).cast(_LINE).alias("po"), c["x"].alias("inv")).cast(_PAIR))
    return F.aggregate(keyed, start, step, lambda acc: F.concat(acc["pairs"], left(acc)))


def compared_lines(po: Column, invoice: Column, tolerance: Column) -> Column:
    """Price comparison of each pair; empty unless both documents have lines."""

    def one(p: Column) -> Column:
        a, b = p["inv"], p["po"]
        both = a.isNotNull() & b.isNotNull()
        priced = both & a["unit_price"].isNotNull() & b["unit_price"].isNotNull()
        percent = V.percent_variance(a["unit_price"], b["unit_price"])
        return F.struct(
            F.coalesce(a["description"], b["description"]).alias("description"), b["quantity"].alias("po_quantity"), a["quantity"].alias("invoice_quantity"),
            b["unit_price"].alias("po_unit_price"), a["unit_price"].alias("invoice_unit_price"), b["amount"].alias("po_amount"), a["amount"].alias("invoice_amount"),
            F.when(priced, F.round(a["unit_price"] - b["unit_price"], 2)).alias("variance_amount"), F.when(priced, F.round(percent, 2)).alias("percentage_variance"),
            F.when(priced, V.tolerance_class(percent, tolerance)).otherwise(F.lit("missing")).alias("classification"),
            F.when(b.isNull(), F.lit("invoice")).when(a.isNull(), F.lit("purchase_order")).alias("only_on"),
        )

    both = (F.size(F.coalesce(po, F.array().cast(LINES))) > 0) & (F.size(F.coalesce(invoice, F.array().cast(LINES))) > 0)
    made = F.transform(paired_lines(po, invoice), one)
    return F.when(both, made).otherwise(F.filter(made, lambda _: F.lit(False)))


def line_overcharge(lines: Column) -> Column:
    """Sum over lines billed above the ordered price; an unknown quantity counts as one."""
    over = F.filter(lines, lambda x: (x["classification"] == "outside_tolerance") & (x["variance_amount"] > 0))
    units = lambda x: F.when(x["invoice_quantity"].isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), x["invoice_quantity"]))
    return F.round(F.aggregate(over, F.lit(0.0), lambda s, x: s + x["variance_amount"] * units(x)), 2)


def _line_rollup(lines: Column, tolerance: Column) -> Column:
    priced = F.filter(lines, lambda x: x["classification"] != "missing")
    worst = F.array_max(F.transform(F.filter(priced, lambda x: x["percentage_variance"].isNotNull()), lambda x: F.abs(x["percentage_variance"])))
    bad = F.exists(lines, lambda x: x["only_on"].isNotNull() | (x["classification"] == "outside_tolerance"))
    kind = F.when(bad, F.lit("outside_tolerance")).when(F.size(priced) == 0, F.lit("missing")).when(worst == 0, F.lit("matched")).otherwise(F.lit("within_tolerance"))
    count = lambda c, what: F.concat(F.size(F.coalesce(c, F.array().cast(LINES))).cast("string"), F.lit(f" line(s) {what}"))
    made = V._comparison("line_items", expected_str=count(F.col("po_line_items"), "ordered"), actual_str=count(F.col("invoice_line_items"), "billed"), percentage_variance=worst, tolerance_percent=tolerance, classification=kind, evaluable=kind != "missing")
    return F.when(F.size(lines) > 0, made)


def coherence_signals() -> Column:
    """Signals (code, strength) on whether the documents belong together, in order."""
    signal = lambda code, strength: F.struct(F.lit(code).alias("code"), F.lit(strength).alias("strength"))
    invoice, po, receipt = (unicode_key(F.col(c)) for c in ("invoice_po_number", "po_number", "receipt_po_number"))
    po_conflict = (invoice != "") & (po != "") & (invoice != po)
    receipt_conflict = (invoice != "") & (receipt != "") & (invoice != receipt)
    a, b = document_tokens(F.col("po_line_items")), document_tokens(F.col("invoice_line_items"))
    apart = a.isNotNull() & b.isNotNull() & ~F.arrays_overlap(a, b)
    billed = F.coalesce(F.when(F.col("invoice_total") != 0, F.col("invoice_total")), F.col("invoice_amount"))
    explicable = F.when((billed > 0) & (F.col("po_total") > 0), billed <= F.col("po_total") * EXPLICABLE_MULTIPLE)
    beyond = F.coalesce(~explicable, F.lit(False))
    v, w = vendor_key(F.col("vendor_name")), vendor_key(F.col("po_vendor_name"))
    fixed = F.array(
        F.when(po_conflict, signal("po_reference_conflict", "hard")), F.when(receipt_conflict, signal("receipt_reference_conflict", "hard")),
        F.when(apart & beyond, signal("unrelated_line_items", "hard")).when(apart, signal("no_descriptive_overlap", "soft")),
        F.when((v != "") & (w != "") & (v != w), signal("different_vendor", "context")),
    )
    warned = F.filter(F.coalesce("link_warnings", F.array().cast(_INPUT["link_warnings"])), lambda x: ~((x["code"] == "reference_mismatch") & (po_conflict | receipt_conflict)))
    soft = F.transform(warned, lambda x: F.struct(F.coalesce(x["code"], F.lit("unverified_link")).alias("code"), F.lit("soft").alias("strength")))
    return F.when(F.col("purchase_order_exists"), F.concat(F.array_compact(fixed), soft)).otherwise(F.array().cast("array<struct<code:string,strength:string>>"))


def verdict(signals: Column) -> Column:
    has = lambda s: F.exists(signals, lambda x: x["strength"] == s)
    return F.when(has("hard"), F.lit("contradicted")).when(has("soft"), F.lit("unverified")).otherwise(F.lit("consistent"))


def _compared() -> dict[str, Column]:
    """The comparisons of a case with an order, by field and in order; null where one cannot be made."""
    tol, c = F.col("price_tolerance"), F.col
    basis = V.tax_basis(c("invoice_total"), c("invoice_subtotal"), c("tax_amount"), c("invoice_line_items"))
    po_basis = V.tax_basis(c("po_total"), c("po_subtotal"), c("po_tax_amount"), c("po_line_items"))
    comparable = (basis == po_basis) & (basis != "unknown")
    over = F.col("total_billed") - F.col("order_value")
    kind = F.when(~comparable, F.lit("unable_to_verify")).when(over > 0.01, F.lit("outside_tolerance")).otherwise(F.lit("matched"))
    billed = V._comparison("po_billed_total", expected_num=c("order_value"), actual_num=c("total_billed"), absolute_variance=F.round(over, 2), percentage_variance=F.round(F.try_divide(over, c("order_value")) * 100, 2), tolerance_percent=tol, classification=kind, evaluable=comparable)
    unable = V._comparison("total", expected_num=c("po_total"), actual_num=c("invoice_total"), classification=F.lit("unable_to_verify"), evaluable=F.lit(False))
    both = lambda a, b: c(a).isNotNull() & c(b).isNotNull()
    vendor, number = V.compare_exact("vendor", c("vendor_name"), c("po_vendor_name")), V.compare_exact("po_number", c("invoice_po_number"), c("po_number"))
    received = F.when(c("goods_receipt_exists"), c("received_quantity"))
    return {
        "vendor": vendor, "po_number": number, "unit_price": V.compare("unit_price", c("invoice_unit_price"), c("po_unit_price"), tol), "quantity": V.compare("quantity", c("billable"), received, c("quantity_tolerance")),
        "line_items": _line_rollup(c("line_comparisons"), tol), "subtotal": F.when(both("invoice_subtotal", "po_subtotal"), V.compare("subtotal", c("invoice_subtotal"), c("po_subtotal"), tol)),
        "tax_arithmetic": V.self_arithmetic(c("invoice_subtotal"), c("tax_amount"), c("invoice_total"), tol), "quoted_price": V.quoted_price(c("quotation_total"), F.coalesce(F.when(c("po_subtotal") != 0, c("po_subtotal")), c("po_total")), tol),
        "po_billed_total": F.when(c("order_value") != 0, billed), "tax": F.when(both("tax_amount", "po_tax_amount"), V.compare("tax", c("tax_amount"), c("po_tax_amount"), tol)),
        "total": F.when(both("invoice_total", "po_total"), F.when(comparable, V.compare("total", c("invoice_total"), c("po_total"), tol)).otherwise(unable)),
    }


def _place(field: str) -> str:
    """The column that holds a comparison until all are put together."""
    return f"{field}_compared_"


def _comparisons(fields: list[str]) -> Column:
    known = lambda f: F.col(_place(f))
    return F.when(F.col("purchase_order_exists"), F.array_compact(F.array(*map(known, fields)))).otherwise(F.array(known("vendor"), known("po_number"), V.missing("unit_price"), V.missing("quantity")))


def _findings() -> Column:
    """The first finding that holds: its type, impact, risk, owner and whether it needs other cases."""
    c = F.col
    of = lambda f: F.col(_place(f))
    outside = lambda f: F.coalesce(of(f)["evaluable"] & (of(f)["classification"] == "outside_tolerance"), F.lit(False))
    made = lambda kind, impact, risk, owner, cross=False: F.struct(F.lit(kind).alias("exception_type"), F.round(impact.cast("decimal(28,6)"), 2).cast("double").alias("financial_impact"), risk.alias("risk_level"), F.lit(owner).alias("recommended_owner"), F.lit(cross).alias("cross_case"))
    amount, high, medium, low = F.coalesce(c("invoice_amount"), F.lit(0.0)), F.lit("high"), F.lit("medium"), F.lit("low")
    units = F.greatest(F.lit(0.0), c("billable") - c("received_quantity"))
    rate = V.implied_rate(c("invoice_amount"), c("billable"), c("invoice_unit_price"), c("po_unit_price"))
    qty, price, tax = of("quantity"), of("unit_price"), of("tax_arithmetic")
    lines = c("line_comparisons")
    unpaired = F.exists(lines, lambda x: x["only_on"].isNotNull())
    outside_lines = F.filter(lines, lambda x: x["classification"] == "outside_tolerance")
    overcharge = line_overcharge(lines)
    extra = F.aggregate(F.filter(lines, lambda x: x["only_on"] == "invoice"), F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), F.coalesce(x["invoice_amount"], F.lit(0.0))))
    worst = F.array_max(F.transform(outside_lines, lambda x: F.abs(x["percentage_variance"])))
    billed = of("po_billed_total")
    confidence = F.coalesce(c("duplicate_confidence"), F.lit(""))
    return (
        F.when(~c("purchase_order_exists"), made("missing_purchase_order", amount, high, "Procurement"))
        .when(confidence == "exact", made("duplicate_invoice", amount, high, "Accounts Payable", True))
        .when(c("payment_changed"), made("payment_details_changed", amount, high, "Accounts Payable", True))
        .when(F.coalesce(billed["evaluable"] & (c("over_billed_by") > 0.01) & (c("invoice_count") > 1), F.lit(False)), made("po_over_billed", c("over_billed_by"), high, "Procurement", True))
        .when(confidence == "near", made("duplicate_invoice", amount, medium, "Accounts Payable", True))
        .when(outside("tax_arithmetic"), made("tax_total_mismatch", F.abs(F.coalesce(tax["absolute_variance"], F.lit(0.0))), high, "Accounts Payable"))
        .when(outside("vendor"), made("vendor_mismatch", amount, high, "Procurement"))
        .when(~c("goods_receipt_exists"), made("missing_goods_receipt", amount, V.risk_unconfirmed(amount, c("comparisons"), c("high_value_threshold")), "Requesting business unit"))
        .when(outside("quantity"), made("quantity_variance", units * rate, F.when(F.abs(qty["percentage_variance"]) < 25, medium).otherwise(high), "Receiving"))
        .when(outside("unit_price"), made("price_variance", F.abs(price["absolute_variance"]) * F.greatest(F.lit(0.0), F.coalesce(c("billable"), F.lit(0.0))), F.when(F.abs(price["percentage_variance"]) <= 10, medium).otherwise(high), "Procurement"))
        .when(unpaired | (F.size(outside_lines) > 0), made("price_variance", F.when(unpaired & (overcharge == 0), F.round(extra, 2)).otherwise(overcharge), F.when(unpaired | F.coalesce(worst > 10, F.lit(False)), high).otherwise(medium), "Procurement"))
        .when(confidence == "recurring", made("recurring_suspected", F.lit(0.0), low, "Accounts Payable", True))
        .when(c("drift_latest").isNotNull(), made("vendor_price_drift", F.round((c("drift_latest") - c("drift_first")) * F.coalesce(F.when(c("billable") != 0, c("billable")), F.lit(1.0)), 2), F.when(c("drift_percent") >= 3 * c("price_tolerance"), high).otherwise(medium), "Procurement", True))
        .otherwise(made("no_exception", F.lit(0.0), low, "No action required"))
    )


def evaluate(inputs: DataFrame) -> DataFrame:
    """The input with comparisons, score, coherence verdict and finding."""
    out = completed(inputs).withColumn("billable", billable_quantity(F.col("invoice_quantity"), F.col("invoice_line_items")))
    out = out.withColumn("line_comparisons", compared_lines(F.col("po_line_items"), F.col("invoice_line_items"), F.col("price_tolerance")))
    fields = _compared()
    out = out.withColumns({_place(f): x for f, x in fields.items()})
    out = out.withColumns({"comparisons": _comparisons(list(fields)), "signals": coherence_signals()})
    out = out.withColumns({"finding": _findings(), "verdict": verdict(F.col("signals")), "match_score": V.match_score(F.col("comparisons"))}).drop(*map(_place, fields))
    contradicted = F.col("verdict") == "contradicted"
    replaced = contradicted & ~F.col("finding.exception_type").isin(*SURVIVES_INCOHERENCE)

    def withdrawn(x: Column) -> Column:
        gone = x.withField("classification", F.lit("unable_to_verify")).withField("evaluable", F.lit(False)).withField("absolute_variance", F.lit(None).cast("double")).withField("percentage_variance", F.lit(None).cast("double"))
        return F.when(x["field"].isin(*CROSS_DOCUMENT_FIELDS), gone).otherwise(x)

    new = {
        "exception_type": F.when(replaced, F.lit("unrelated_documents")).otherwise(F.col("finding.exception_type")),
        "financial_impact": F.when(replaced, F.coalesce("invoice_amount", F.lit(0.0))).otherwise(F.col("finding.financial_impact")),
        "risk_level": F.when(replaced, F.lit("high")).otherwise(F.col("finding.risk_level")),
        "recommended_owner": F.when(replaced, F.lit("Accounts Payable")).otherwise(F.col("finding.recommended_owner")), "cross_case": F.col("finding.cross_case"),
        # All figures across documents are withdrawn, so none of them can be evaluated.
        "match_score": F.when(contradicted, F.lit(0)).otherwise(F.col("match_score")), "comparisons": F.when(contradicted, F.transform("comparisons", withdrawn)).otherwise(F.col("comparisons")),
        "line_comparisons": F.when(~contradicted, F.col("line_comparisons")),
        "procurement_kind": F.when(~F.col("goods_receipt_exists"), V.procurement_kind(F.coalesce("invoice_line_items", "po_line_items"))),
    }
    return out.withColumns(new).drop("finding")


def with_outcome(cases: DataFrame, computed: DataFrame) -> DataFrame:
    """``cases`` with the outcome of the match where none is stored; a stored one counts only with both type and score."""
    fields = {"exception_type": "exception_type", "match_score": "match_score", "financial_impact": "financial_impact", "risk_level": "risk_level", "assigned_team": "recommended_owner"}
    made = computed.select("exception_id", F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias("made_outcome"))
    out = cases.join(made, "exception_id", "left").withColumn("has_outcome", F.col("exception_type").isNotNull() & F.col("match_score").isNotNull() | F.col("made_outcome").isNull())
    return out.withColumns({f: F.when(F.col("has_outcome"), F.col(f)).otherwise(F.col(f"made_outcome.{f}")) for f in fields}).drop("made_outcome", "has_outcome")


def resolved_tolerance(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """``cases`` (with vendor_name, category) and the tolerances that hold: vendor over category over the workspace's default.

    ``rules``: ``scope`` (default, category, vendor), ``name``, ``price``, ``quantity`` and
    optionally ``place``; a null figure leaves the wider rule's.  Vendors are told
    by their letters and digits, and of several rules whose names agree so the
    first by ``place`` counts (by name without it); categories agree exactly.
    ``tolerance_source`` says which rule answered, even if it only repeats the wider one.
    """
    place = F.col("place") if "place" in rules.columns else F.lit(0)

    def part(scope: str, key: Column) -> DataFrame:
        rows = rules.filter(F.col("scope") == scope).withColumn(f"{scope}_key_", key)
        rule = F.struct("name", F.col("price").alias("p"), F.col("quantity").alias("q"))
        return rows.groupBy(f"{scope}_key_").agg(F.min_by(rule, F.struct(place, F.col("name"))).alias(f"{scope}_rule_"))

    default = rules.filter("scope = 'default'").agg(F.min_by(F.struct(F.col("price").alias("p"), F.col("quantity").alias("q")), F.struct(place, F.col("price"), F.col("quantity"))).alias("default_rule_"))  # one row
    names = [c for c in ("vendor_key_", "category_key_", "vendor_rule_", "category_rule_", "default_rule_") if c in cases.columns]
    if names:
        raise ValueError(f"columns {names} are taken")
    out = cases.withColumns({"vendor_key_": F.when(F.col("vendor_name") != "", unicode_key(F.col("vendor_name"))), "category_key_": F.nullif(F.col("category"), F.lit(""))})
    out = out.join(part("vendor", unicode_key(F.col("name"))), "vendor_key_", "left").join(part("category", F.col("name")), "category_key_", "left").join(F.broadcast(default))
    pick = lambda x, d: F.coalesce(f"vendor_rule_.{x}", f"category_rule_.{x}", f"default_rule_.{x}", F.lit(d))
    said = lambda scope: F.concat(F.lit(f"{scope} rule: "), F.col(f"{scope}_rule_.name"))
    source = F.when(F.col("vendor_rule_").isNotNull(), said("vendor")).when(F.col("category_rule_").isNotNull(), said("category")).otherwise(F.lit("workspace default"))
    return out.withColumns({"price_tolerance": pick("p", PRICE_TOLERANCE), "quantity_tolerance": pick("q", QUANTITY_TOLERANCE), "tolerance_source": source}).drop("vendor_key_", "category_key_", "vendor_rule_", "category_rule_", "default_rule_")
