"""Identity keys and token sets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.model import MIN_DESCRIPTIVE_TOKENS, MIN_TOKEN_LENGTH, STOPWORDS

# How legal forms are abbreviated.
LEGAL_FORMS = {"private": "pvt", "limited": "ltd", "company": "co", "corporation": "corp", "incorporated": "inc", "and": "&"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def vendor_key(name: Column) -> Column:
    """One key for the spellings of a vendor; '' for null."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"^(m/s|messrs)", "")
    words = F.filter(F.split(text, "[^a-z0-9&]+"), lambda w: w != "")
    forms = F.create_map(*[F.lit(x) for pair in LEGAL_FORMS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(forms, w), w)), "")


def ascii_key(value: Column) -> Column:
    """Lower-case ASCII letters and digits; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def unicode_key(value: Column) -> Column:
    """Lower-case letters and digits of any script; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]", "")


def tokens(description: Column) -> Column:
    """Different meaningful words: three characters or more, no stock phrase, not digits alone."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9]+"))
    words = F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))
    return F.filter(words, lambda w: (F.length(w) >= MIN_TOKEN_LENGTH) & ~w.rlike("^[0-9]+$"))


def document_tokens(lines: Column) -> Column:
    """Token set of all lines; null (not comparable) below the minimum."""
    every = F.array_distinct(F.flatten(F.transform(lines, lambda x: tokens(x["description"]))))
    return F.when(F.size(every) >= MIN_DESCRIPTIVE_TOKENS, every)


def only_line(lines: Column, field: str) -> Column:
    """A field of the sole line; null with none or several."""
    return F.when(F.size(lines) == 1, F.get(lines, F.lit(0))[field])


def item_key(extraction: Column) -> Column:
    """Description key: the stated one, else the sole line's; null if there is none."""
    stated = blank_to_null(extraction["line_item_description"])
    return blank_to_null(ascii_key(F.coalesce(stated, only_line(extraction["line_items"], "description"))))


def unit_price_of(extraction: Column) -> Column:
    return F.coalesce(extraction["unit_price"], only_line(extraction["line_items"], "unit_price"))


def billable_quantity(quantity: Column, lines: Column) -> Column:
    """The stated quantity, else that of the only line which has one."""
    known = F.filter(lines, lambda x: x["quantity"].isNotNull())
    return F.coalesce(quantity, only_line(known, "quantity"))


def title(value: Column, most: int = 120) -> Column:
    """Printable characters, runs of space collapsed, cut; null if nothing is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, r"[\p{C}]", " "), r"\s+", " "))
    return blank_to_null(F.rtrim(F.substring(text, 1, most)))


def magnitude(amount: Column) -> Column:
    """Order of magnitude as text; '0' below 1 and for null."""
    a = F.abs(F.coalesce(amount, F.lit(0.0)))
    return F.when(a < 1, F.lit("0")).otherwise(F.concat(F.lit("~1e"), F.floor(F.log10(a)).cast("string")))


# Least score of each band.
SCORE_BANDS = (("95-100", 95), ("80-94", 80), ("60-79", 60))


def score_band(score: Column) -> Column:
    """Band of a match score; 'unknown' for null."""
    out = F.lit("below-60")
    for band, least in reversed(SCORE_BANDS):
        out = F.when(score >= least, F.lit(band)).otherwise(out)
    return F.when(score.isNull(), F.lit("unknown")).otherwise(out)


def object_path(workspace: Column, case: Column, document: Column) -> Column:
    return F.concat_ws("/", workspace, case, document)


def sender_allowed(address: Column, allowed: list[str]) -> Column:
    """Whether an address equals an entry of the list, or ends with an entry that is a domain (@…)."""
    mail = F.lower(F.trim(F.coalesce(blank_to_null(F.regexp_extract(address, r"<([^<>]+)>", 1)), address)))
    exact = [a.strip().lower() for a in allowed if not a.strip().startswith("@")]
    domains = [a.strip().lower() for a in allowed if a.strip().startswith("@")]
    hit = mail.isin(exact) if exact else F.lit(False)
    for d in domains:
        hit = hit | mail.endswith(d)
    return F.coalesce(hit, F.lit(False))


# Currency sign, what stands for an unknown amount, and the units of short amounts.
CURRENCY, UNKNOWN_AMOUNT, CRORE, LAKH = "₹", "—", 10_000_000, 100_000


def money_text(value: Column) -> Column:
    """Whole amount with groups of two digits above the thousands; a dash if it isn't known."""
    whole = F.floor(value + 0.5).cast("long")
    digits = F.abs(whole).cast("string")
    front = F.substring(digits, F.lit(1), F.length(digits) - 3)
    pairs = F.reverse(F.regexp_replace(F.reverse(front), r"(\d{2})(?=\d)", "$1,"))
    grouped = F.when(F.length(digits) > 3, F.concat(pairs, F.lit(","), F.substring(digits, -3, 3))).otherwise(digits)
    shown = F.concat(F.lit(CURRENCY), F.when(whole < 0, F.lit("-")).otherwise(F.lit("")), grouped)
    return F.when(value.isNull() | F.isnan(value), F.lit(UNKNOWN_AMOUNT)).otherwise(shown)


def money_short(value: Column) -> Column:
    """Crore and lakh with two places, smaller amounts as ``money_text``."""
    short = lambda unit, name: F.concat(F.lit(CURRENCY), F.format_string("%.2f", value / F.lit(float(unit))), F.lit(name))
    return F.when(value >= CRORE, short(CRORE, "Cr")).when(value >= LAKH, short(LAKH, "L")).otherwise(money_text(value))
