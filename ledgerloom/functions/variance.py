"""Variances, tolerance classes and comparisons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.keys import vendor_key
from ledgerloom.model import HIGH_VALUE, MATCHED, RISK_BANDS, SERVICE_WORDS

COMPARISON = "struct<field:string,expected_num:double,actual_num:double,expected_str:string,actual_str:string,absolute_variance:double,percentage_variance:double,tolerance_percent:double,classification:string,evaluable:boolean>"


def percent_variance(actual: Column, expected: Column) -> Column:
    """Percent of the expected value; null where 0 was expected and something came."""
    return F.when(expected == 0, F.when(actual == expected, F.lit(0.0))).otherwise((actual - expected) / expected * 100)


def tolerance_class(percent: Column, tolerance: Column) -> Column:
    """On the percentage before rounding: null and beyond are outside, the limit itself is within."""
    return F.when(percent.isNull(), F.lit("outside_tolerance")).when(percent == 0, F.lit("matched")).when(F.abs(percent) <= tolerance, F.lit("within_tolerance")).otherwise(F.lit("outside_tolerance"))


def _comparison(field: str, **parts: Column) -> Column:
    names = ("expected_num", "actual_num", "expected_str", "actual_str", "absolute_variance", "percentage_variance", "tolerance_percent", "classification", "evaluable")
    null = F.lit(None)
    return F.struct(F.lit(field).alias("field"), *[parts.get(n, null).alias(n) for n in names]).cast(COMPARISON)


def missing(field: str) -> Column:
    return _comparison(field, classification=F.lit("missing"), evaluable=F.lit(False))


def compare(field: str, actual: Column, expected: Column, tolerance: Column) -> Column:
    """Numeric comparison; missing if either side is."""
    percent = percent_variance(actual, expected)
    made = _comparison(
        field, expected_num=expected, actual_num=actual, absolute_variance=F.round(actual - expected, 2), percentage_variance=F.round(percent, 2),
        tolerance_percent=tolerance, classification=tolerance_class(percent, tolerance), evaluable=F.lit(True),
    )
    return F.when(actual.isNotNull() & expected.isNotNull(), made).otherwise(missing(field))


def compare_exact(field: str, actual: Column, expected: Column) -> Column:
    """Text comparison: vendors by key, others trimmed and in lower case."""
    same = vendor_key(actual) == vendor_key(expected) if field == "vendor" else F.lower(F.trim(actual)) == F.lower(F.trim(expected))
    made = _comparison(field, expected_str=expected, actual_str=actual, classification=F.when(same, F.lit("matched")).otherwise(F.lit("outside_tolerance")), evaluable=F.lit(True))
    known = (F.coalesce(actual, F.lit("")) != "") & (F.coalesce(expected, F.lit("")) != "")
    return F.when(known, made).otherwise(missing(field))


def self_arithmetic(subtotal: Column, tax: Column, total: Column, tolerance: Column) -> Column:
    """An invoice against its own sum; null without subtotal or total."""
    expected = F.round(subtotal + F.coalesce(tax, F.lit(0.0)), 2)
    return F.when(subtotal.isNotNull() & total.isNotNull(), compare("tax_arithmetic", total, expected, tolerance))


def quoted_price(quoted: Column, ordered: Column, tolerance: Column) -> Column:
    return F.when((quoted != 0) & ordered.isNotNull(), compare("quoted_price", ordered, quoted, tolerance))


def tax_basis(total: Column, subtotal: Column, tax: Column, lines: Column) -> Column:
    """Whether a total has tax in it: gross, net or unknown."""
    line_sum = F.coalesce(F.round(F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.coalesce(x["amount"], F.lit(0.0))), 2), F.lit(0.0))
    return (
        F.when(total.isNull(), F.lit("unknown"))
        .when(F.coalesce(tax, F.lit(0.0)) != 0, F.lit("gross"))
        .when((line_sum != 0) & (F.abs(total - line_sum) < 0.01), F.lit("net"))
        .when(F.abs(total - subtotal) < 0.01, F.lit("net"))
        .otherwise(F.lit("unknown"))
    )


def match_score(comparisons: Column) -> Column:
    """Percent of the evaluable comparisons that match, half-even; 0 if none can be evaluated."""
    evaluable = F.size(F.filter(comparisons, lambda c: c["evaluable"]))
    matched = F.size(F.filter(comparisons, lambda c: c["evaluable"] & c["classification"].isin(*MATCHED)))
    return F.when(evaluable == 0, 0).otherwise(F.bround(100.0 * matched / evaluable, 0).cast("int"))


def risk_band(rate: Column, value: Column) -> Column:
    out = F.lit("low")
    for band, least_rate, least_value in reversed(RISK_BANDS):
        out = F.when((rate >= least_rate) | (value >= least_value), F.lit(band)).otherwise(out)
    return out


def procurement_kind(lines: Column) -> Column:
    """services if a line has a service code or most lines read like one, else goods."""
    coded = F.exists(lines, lambda x: F.trim(x["hsn_sac"]).startswith("99") & (F.length(F.trim(x["hsn_sac"])) >= 4))
    worded = F.size(F.filter(lines, lambda x: F.lower(x["description"]).rlike("|".join(SERVICE_WORDS))))
    return F.when(F.coalesce(coded, F.lit(False)) | (worded * 2 > F.size(lines)), F.lit("services")).otherwise(F.lit("goods"))


def risk_unconfirmed(amount: Column, comparisons: Column, threshold: Column | None = None) -> Column:
    limit = F.lit(HIGH_VALUE) if threshold is None else F.coalesce(threshold, F.lit(HIGH_VALUE))
    breached = F.exists(comparisons, lambda c: c["evaluable"] & (c["classification"] == "outside_tolerance"))
    return F.when(breached | (amount >= limit), F.lit("high")).when(amount >= limit / 4, F.lit("medium")).otherwise(F.lit("low"))


def implied_rate(amount: Column, quantity: Column, invoice_price: Column, po_price: Column) -> Column:
    nonzero = lambda c: F.when(c != 0, c)
    return F.abs(F.coalesce(amount / nonzero(quantity), nonzero(invoice_price), nonzero(po_price), F.lit(0.0)))


# Parts of the sentence on what is outstanding.
ALL_LINES = "All %d of %d ordered lines match the invoice"
SOME_LINES = "%d of %d ordered lines match the invoice"
SOME_FIELDS = "%d of %d checked fields agree"
NO_CHECKS = "The documents on file agree"
OUTSTANDING = "%s. No %s is on file, so nothing yet confirms this was delivered — that is the only thing holding %s."


def outstanding(awaiting: Column, comparisons: Column, lines: Column, amount: Column) -> Column:
    """What is checked and what is still missing, as a sentence."""
    checked = F.size(F.filter(comparisons, lambda c: c["evaluable"]))
    agreed = F.size(F.filter(comparisons, lambda c: c["evaluable"] & c["classification"].isin(*MATCHED)))
    n, ok = F.size(lines), F.size(F.filter(lines, lambda x: x["classification"].isin(*MATCHED)))
    part_lines = F.when(n > 0, F.when(ok == n, F.format_string(ALL_LINES, ok, n)).otherwise(F.format_string(SOME_LINES, ok, n)))
    part_fields = F.when(checked > 0, F.format_string(SOME_FIELDS, agreed, checked))
    settled = F.coalesce(F.nullif(F.concat_ws("; ", part_lines, part_fields), F.lit("")), F.lit(NO_CHECKS))
    return F.format_string(OUTSTANDING, settled, awaiting, F.format_number(amount, 0))


def preview(lines: Column, most: int = 2) -> Column:
    """The first descriptions of a document, and how many more there are."""
    said = F.filter(F.transform(lines, lambda x: F.trim(x["description"])), lambda d: d.isNotNull() & (d != ""))
    more = F.when(F.size(said) > most, F.format_string(" (+%d more)", F.size(said) - most)).otherwise(F.lit(""))
    return F.when(F.coalesce(F.size(said), F.lit(0)) > 0, F.concat(F.array_join(F.slice(said, 1, most), "; "), more)).otherwise(F.lit("unspecified items"))
