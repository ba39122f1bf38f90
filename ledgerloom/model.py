"""Schemas and constants of accounts-payable control data."""

from __future__ import annotations

from pyspark.sql import types as T

# Statuses, types and thresholds that are query semantics.
OPEN_STATUSES = ("exception_detected", "assigned", "awaiting_procurement", "awaiting_receiving", "awaiting_vendor")
SYSTEM_STATUSES = ("received", "processing", "exception_detected", "cleared")
CLEAN_TYPE = "no_exception"
CROSS_CASE_TYPES = ("duplicate_invoice", "po_over_billed", "payment_details_changed", "recurring_suspected", "vendor_price_drift")
SURVIVES_INCOHERENCE = ("missing_purchase_order", "tax_total_mismatch", *CROSS_CASE_TYPES)
CROSS_DOCUMENT_FIELDS = ("vendor", "po_number", "unit_price", "quantity", "line_items", "subtotal", "tax", "total", "quoted_price", "po_billed_total")
AGE_BUCKETS = (("0-3", 0, 3), ("4-7", 4, 7), ("8-14", 8, 14), ("15-30", 15, 30), ("31+", 31, None))
SLA_DAYS = 14
CLEAN_SCORE = 100
RISK_BANDS = (("high", 0.40, 1_000_000), ("medium", 0.20, 250_000))
PRICE_TOLERANCE, QUANTITY_TOLERANCE = 5.0, 2.0
AMOUNT_EPSILON, NEAR_DAYS = 0.01, 90
MIN_OCCURRENCES, MAX_CV, MIN_GAP, MAX_GAP = 3, 0.25, 20, 400
CADENCES = (("monthly", 30.4, 6), ("quarterly", 91.3, 12), ("half-yearly", 182.6, 18), ("annual", 365.25, 25))
MIN_DRIFT_POINTS, MIN_DRIFT_TOTAL, MIN_DRIFT_MONTHLY, DAYS_PER_MONTH = 4, 4.0, 0.5, 30.44
EXPLICABLE_MULTIPLE, MIN_DESCRIPTIVE_TOKENS, MIN_TOKEN_LENGTH = 1.5, 2, 3
HIGH_VALUE = 100_000.0
MATCHED = ("matched", "within_tolerance")
DEFAULT_WORKSPACE = "default"
MAX_DAYS, MAX_VENDORS, MAX_MONTHS = 730, 50, 24
# Words that describe no item.
STOPWORDS = (
    "and", "for", "the", "with", "per", "each", "unit", "units", "item", "items", "nos", "no", "qty", "quantity", "rate", "amount", "total", "including",
    "incl", "excluding", "excl", "tax", "gst", "supply", "supplied", "delivery", "delivered", "charges", "charge", "service", "services", "work", "works",
    "job", "misc", "other", "others", "sub", "part", "parts", "set", "sets", "pcs", "pieces", "assorted", "various", "sku", "code", "ref", "reference",
    "model", "type", "line", "description",
)
SERVICE_WORDS = (
    "work", "works", "labour", "labor", "service", "servicing", "installation", "installing", "providing and fixing", "reconditioning", "repair",
    "maintenance", "charges", "consultancy", "supervision", "erection", "commissioning", "painting",
)

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CASE = _struct(
    exception_id=_S, workspace_id=_S, invoice_id=_S, vendor_id=_S, vendor_name=_S, purchase_order_id=_S, business_unit=_S, currency=_S,
    invoice_amount=_D, po_amount=_D, status=_S, exception_type=_S, match_score=T.IntegerType(), financial_impact=_D, risk_level=_S,
    assigned_team=_S, origin=_S, created_at=_TS, updated_at=_TS,
)
LINE = _struct(description=_S, quantity=_D, unit_price=_D, amount=_D, hsn_sac=_S)
EXTRACTION = _struct(
    invoice_number=_S, vendor_name=_S, po_number=_S, invoice_date=_S, line_items=T.ArrayType(LINE), line_item_description=_S, quantity=_D,
    unit_price=_D, currency=_S, subtotal=_D, tax_amount=_D, total_amount=_D, bank_account_number=_S, bank_ifsc=_S, bank_name=_S,
    vendor_tax_id=_S, receipt_number=_S, received_quantity=_D, quotation_number=_S, reference=_S, rejection_reason=_S,
)
DOCUMENT = _struct(document_id=_S, exception_id=_S, workspace_id=_S, document_type=_S, processing_state=_S, uploaded_at=_TS, confidence=_D, extraction=EXTRACTION)
DOCUMENT_TYPES = ("vendor_invoice", "purchase_order", "goods_receipt_note", "quotation", "rejection_notice")


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """A request parameter within its guard rails."""
    return default if value is None else max(low, min(high, value))
