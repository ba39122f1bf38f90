"""Timestamps, free-text dates, ages and cadences as column expressions.

All take an explicit ``as_of`` where time matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.model import AGE_BUCKETS, CADENCES

# Notations of a date, tried in this order.
DATE_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMM-yy", "MMM d, yyyy")
_SHAPES = (r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}\.\d{1,2}\.\d{4}", r"\d{1,2}/\d{1,2}/\d{2}",
           r"\d{1,2} [A-Za-z]{3} \d{4}", r"\d{1,2} [A-Za-z]{4,9} \d{4}", r"\d{1,2}-[A-Za-z]{3}-\d{4}", r"\d{1,2}-[A-Za-z]{3}-\d{2}", r"[A-Za-z]{3} \d{1,2}, \d{4}")


def parse_timestamp(text: Column) -> Column:
    """ISO text to a timestamp; naive text is UTC in a UTC session, bad text null."""
    return F.try_to_timestamp(text)


def parse_date(text: Column) -> Column:
    """Date in one of ten notations or ISO; null if none fits."""
    t = F.trim(text)
    tries = [F.when(t.rlike(f"^{s}$"), F.to_date(F.try_to_timestamp(F.initcap(t) if "MMM" in p else t, F.lit(p)))) for p, s in zip(DATE_PATTERNS, _SHAPES, strict=True)]
    return F.coalesce(*tries, F.to_date(F.try_to_timestamp(t)))


def age_days(created: Column, as_of: Column) -> Column:
    """Days with fractions, never below 0; null without a date."""
    return F.when(created.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(86_400_000_000.0)))


def age_bucket(age: Column) -> Column:
    """Label of the whole-day bucket."""
    whole = F.floor(age).cast("int")
    out = F.lit(None).cast("string")
    for label, low, high in reversed(AGE_BUCKETS):
        inside = whole >= low if high is None else whole.between(low, high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def cadence(mean_gap: Column) -> Column:
    """Name of the billing cycle that a mean gap of days fits, else null."""
    out = F.lit(None).cast("string")
    for name, days, slack in reversed(CADENCES):
        out = F.when(F.abs(mean_gap - days) <= slack, F.lit(name)).otherwise(out)
    return out
