"""Personal data to linked pseudonyms of the same format, in built-in functions alone.

Numbers that pass their check (payment cards by issuer and Luhn, IPv4 octets, social
security numbers that can be issued, phone shapes) and dates that exist are
permuted by a keyed Feistel network over exactly their format: the digits of a
number, the octets of an address, the days from 1900 to 2099.  A permutation
gives equal values equal pseudonyms and different values different ones, in any
document.  Cards keep their issuer's two
digits and a valid check digit, account numbers (IBAN, by country, length and check)
their country and a valid check, phones their country code or leading
zero, separators their places.  ``dd/mm`` is tried before ``mm/dd``; what can
only be the latter is permuted among its like.  E-mail addresses, IPv6
addresses and secrets have no fixed domain; they get a keyed hash in their own
shape.  Secrets are what follows a password's name in quotes or at once, what follows
the name of a password, key or token after a space and has a digit, keys of known
beginnings, private keys between their lines, and long hexadecimals.

Each text is searched as a whole, however long, unless it has none of the signs
that every shape needs (a digit, ``@``, ``:`` or ``=``).  Null and empty texts
stay as they are; rows are treated one by one, so repeated rows and ties get
the same result, and an empty table gives no rows.  Extra columns pass through
``pseudonymised`` whatever their names.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh

# Shapes, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ADDRESS = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
#: Where a run of digit groups ends for something of another shape.
_OTHER = rf"(?!{_ADDRESS}|\d{{3}}-\d{{2}}-\d{{4}}(?!\d)|\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?!\d)|(?:19|20)\d\d-\d\d-\d\d(?!\d)|0\d{{2,4}}[ /-]\d{{6,8}}(?!\d))"
_NAMED = r"(?i:passwords?|passwd|passphrase|pwd)(?:[\"']?: ?[\"']| = [\"']?|[\"']?[=:][\"']?)"
#: Without quotes, the value must have a digit.
_PLAIN = r"(?i:passwords?|passwd|passphrase|pwd)\s{0,2}[=:]\s{0,2}(?=[^\s\"'<>,;])"
_PEM = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
_PEM_END = r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
_KEYED = r"(?i:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|client[_-]?secret|private[_-]?key|(?:auth|access)?[_-]?token)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
_KNOWN = r"(?:(?i:AKIA|ASIA)(?=[A-Za-z0-9]{16}(?![A-Za-z0-9]))|[spr]k[-_](?:(?:live|test|proj)[-_])?(?=[A-Za-z0-9_-]{16})|gh[pousr]_(?=[A-Za-z0-9]{30})|xox[abprs]-(?=[A-Za-z0-9-]{10})|AIza(?=[A-Za-z0-9_-]{30})|eyJ(?=[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.))"
#: Characters of an account number by country.
IBAN_LENGTHS = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
SHAPES = {
    "secret": rf"(?<![A-Za-z0-9])(?:{_PEM}[A-Za-z0-9+/=\s:,-]*?{_PEM_END}|{_NAMED}[^\s\"'<>]{{6,}}|{_PLAIN}(?=[^\s\"'<>,;]*\d)[^\s\"'<>,;]{{6,}}|{_KEYED}(?=[^\s\"'<>,;]*\d)[^\s\"'<>,;]{{8,}}|{_KNOWN}[A-Za-z0-9._-]*[A-Za-z0-9]|[0-9a-fA-F]{{32,}}(?![A-Za-z0-9]))",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\d/-])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){_ADDRESS}",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![\p{L}\p{N}:]))(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*[0-9])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5}::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?)",
    "iban": "(?<![A-Za-z0-9])(?:" + "|".join(rf"{c}\d\d(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for c, n in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    "phone": (
        r"(?<![\d+])\+\d{1,3}[ .-]\d(?:[ .-]\d\d){4}(?!\d)|"
        rf"(?<![\d+])(?:\+\d{{1,3}}[ .-]?)(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:(?:[ .-]{_OTHER})?\d{{2,4}}){{1,4}}(?!\d)"
        r"|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.+/-])[2-9]\d\d[-.]\d{3}[-.]\d{4}(?![\d-]|\.\d)|(?<![\d.+/-])0[1-9]\d{1,3}[ /-]\d{6,8}(?![\d-]|\.\d)"
    ),
    "card": rf"(?<![\d-])\d(?:(?:[ -]{_OTHER})?\d){{12,18}}(?![\d-])",
}
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
#: Beginnings and lengths of card numbers that are issued.
ISSUED = r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3[0689]\d{12}|35\d{14,17}|6\d{15,18})$"
#: What begins a secret and stays.
SECRET_HEAD = rf"^(?:{_PEM}\s*|{_PLAIN}|{_NAMED}|{_KEYED}|{_KNOWN})"
#: What ends one and stays.
SECRET_TAIL = rf"\s*{_PEM_END}$"
#: A sign that each shape has.
SIGNS = "[0-9@:=]"
ROUNDS = 10
_DAYS = (17, 4297)  # their product: the days from 1900-01-01 to 2099-12-31
#: Month and day of the dates that can't be read the other way round, of a year without a leap day.
LATE = [d.strftime("%m/%d") for d in (date(1999, 1, 1) + timedelta(k) for k in range(365)) if d.day > 12]
LEAP_YEARS = [y for y in range(1900, 2100) if y % 4 == 0 and y != 1900]


def _prf(key: str, kind: Column, i: Column, value: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), kind, i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def feistel(key: str, kind: Column, left: Column, right: Column, m: Column, n: Column) -> Column:
    """A keyed permutation of Z_m x Z_n; gives a struct of l and r."""

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (x["l"] + _prf(key, kind, i, x["r"], m)) % m).otherwise(x["l"]).alias("l"),
            F.when(even, x["r"]).otherwise((x["r"] + _prf(key, kind, i, x["l"], n)) % n).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Digits (1 to 36 of them) to as many digits, one to one."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    name = F.concat(F.lit(kind), n.cast("string"))
    left = F.when(a > 0, F.substring(digits, F.lit(1), a).cast("long")).otherwise(F.lit(0).cast("long"))
    out = feistel(key, name, left, F.substring(digits, a + 1, n - a).cast("long"), _power(a), _power(n - a))
    joined = F.transform(F.array(out), lambda x: F.concat(F.when(a > 0, F.lpad(x["l"].cast("string"), a, "0")).otherwise(F.lit("")), F.lpad(x["r"].cast("string"), n - a, "0")))
    return F.get(joined, F.lit(0))


def _luhn_sum(payload: Column) -> Column:
    """Luhn sum of the digits before the check digit."""
    m = F.length(payload)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(payload, i, F.lit(1)).cast("int") * (2 - (m - i) % 2)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), m), F.lit(0), add)


def _check_digit(payload: Column) -> Column:
    return ((10 - _luhn_sum(payload) % 10) % 10).cast("string")


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order."""

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (c != "")
        return F.struct(
            (acc["k"] + is_digit.cast("int")).alias("k"),
            F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"),
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit(0).alias("k"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _date(key: str, x: Column) -> Column:
    """A date of 1900 to 2099 in its own notation; null if there is no such day."""
    base = F.lit("1900-01-01").cast("date")
    of = lambda moved, use: F.get(F.transform(F.array(moved), use), F.lit(0))
    # Month before day, where the day is above 12: by year and place in the year, leap days by year alone.
    late, leap = F.array(*map(F.lit, LATE)), F.array(*map(F.lit, LEAP_YEARS))
    year = F.substring(x, 7, 4).try_cast("int")
    moved = feistel(key, F.lit("late"), year - 1900, F.array_position(late, F.substring(x, 1, 5)) - 1, F.lit(200), F.lit(len(LATE)))
    out = of(moved, lambda m: F.concat(F.get(late, m["r"].cast("int")), F.lit("/"), (m["l"] + 1900).cast("string")))
    place = F.array_position(leap, year) - 1
    moved = feistel(key, F.lit("leap"), F.floor(place / 7), place % 7, F.lit(7), F.lit(7))
    leap_day = of(moved, lambda m: F.concat(F.lit("02/29/"), F.get(leap, (m["l"] * 7 + m["r"]).cast("int")).cast("string")))
    out = F.when(x.rlike(r"^(?:0[1-9]|1[0-2])/(?:1[3-9]|[23]\d)/"), F.when(F.array_contains(late, F.substring(x, 1, 5)), out).when(x.startswith("02/29") & (place >= 0), leap_day))
    for pattern in ("dd.MM.yyyy", "dd/MM/yyyy", "yyyy-MM-dd"):
        day = F.try_to_timestamp(x, F.lit(pattern)).cast("date")
        k = F.datediff(day, base)
        moved = feistel(key, F.lit("date"), F.floor(k / _DAYS[1]), k % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]))
        out = F.when(day.isNotNull(), of(moved, lambda m: F.date_format(F.date_add(base, (m["l"] * _DAYS[1] + m["r"]).cast("int")), pattern))).otherwise(out)  # noqa: B023
    return out


def _ssn(key: str, x: Column) -> Column:
    """A number that can be issued to another such: areas but 000, 666 and 900 on, groups but 00, serials but 0000."""
    part = lambda i: F.split_part(x, F.lit("-"), F.lit(i)).cast("long")
    area = part(1) - F.when(part(1) > 666, 2).otherwise(1)
    moved = feistel(key, F.lit("ssn"), area * 99 + part(2) - 1, part(3) - 1, F.lit(898 * 99), F.lit(9999))
    three = lambda a: a + F.when(a >= 665, 2).otherwise(1)
    return F.get(F.transform(F.array(moved), lambda m: F.concat_ws("-", F.lpad(three(F.floor(m["l"] / 99)).cast("string"), 3, "0"), F.lpad((m["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((m["r"] + 1).cast("string"), 4, "0"))), F.lit(0))


def _ip(key: str, x: Column) -> Column:
    o = lambda i: F.split_part(x, F.lit("."), F.lit(i)).cast("long")
    moved = feistel(key, F.lit("ip"), o(1) * 256 + o(2), o(3) * 256 + o(4), F.lit(65536), F.lit(65536))
    parts = lambda v: (F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return F.get(F.transform(F.array(moved), lambda m: F.concat_ws(".", *parts(m["l"]), *parts(m["r"]))), F.lit(0))


def _account_sum(x: Column) -> Column:
    """The check of an account number: its rest by 97 with the first four characters behind the others, letters as 10 to 35."""
    turned = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
    value = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.cast("int"))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda have, c: (have * F.when(c.between("A", "Z"), 100).otherwise(10) + value(c)) % 97)


def _iban(key: str, x: Column) -> Column:
    """An account number to another of its country: its digits are permuted, letters and spaces stay, and its check holds."""
    bare = F.replace(x, F.lit(" "), F.lit(""))
    country, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    moved = _refilled(account, permuted_digits(key, "iban", _digits(account)))
    checked = lambda a: _refilled(x, F.concat(F.lpad((98 - _account_sum(F.concat(country, F.lit("00"), a))).cast("string"), 2, "0"), _digits(a)))
    return F.get(F.transform(F.array(moved), checked), F.lit(0))


def card_in(x: Column) -> Column:
    """What of a match in a card's shape is a card: all of it, else the first of its runs of groups that passes the check; null if none."""

    def valid(y: Column) -> Column:
        d = _digits(y)
        n = F.length(d)
        return d.rlike(ISSUED) & (_check_digit(F.substring(d, F.lit(1), n - 1)) == F.substring(d, n, F.lit(1)))

    n = F.length(x)
    places = F.sequence(F.lit(1), n)
    apart = lambda i: F.substring(x, i, F.lit(1)).isin(" ", "-")
    starts = F.filter(places, lambda i: (i == 1) | apart(i - 1))
    ends = F.filter(places, lambda j: (j == n) | apart(j + 1))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: j - i >= 12), lambda j: F.substring(x, i, j - i + 1))))
    return F.when(valid(x), x).when(x.rlike("[ -]"), F.get(F.filter(runs, valid), F.lit(0)))


def _hashed(key: str, kind: str, x: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), x), 256)


def kind_of(x: Column) -> Column:
    """The kind of a match: that of the first shape it has as a whole; null if it fails its check."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, shape in SHAPES.items():
        # What a shape wants around a match isn't there any more; cards, dates and known kinds are told by what they are.
        out = out.when(x.rlike(f"^(?:{shape})$"), F.when(card_in(x).isNotNull(), F.lit(kind)) if kind == "card" else F.when(_day(x).isNotNull(), F.lit(kind)) if kind == "date" else F.when(_account_sum(F.replace(x, F.lit(" "), F.lit(""))) == 1, F.lit(kind)) if kind == "iban" else F.lit(kind))
    return out


def _day(x: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy")])


def pseudonym(key: str, kind: Column, x: Column) -> Column:
    """What stands for a match; a match without a kind stays."""
    country = F.regexp_extract(x, r"^(\+\d{1,3}(?=\D)|0)?", 1)
    local = F.substring(x, F.length(country) + 1, F.length(x))

    def card_of(run: Column) -> Column:
        """The match with its card replaced."""
        d = _digits(run)
        new_payload = F.concat(F.substring(d, 1, 2), permuted_digits(key, "card", F.substring(d, F.lit(3), F.length(d) - 3)))
        new = F.get(F.transform(F.array(new_payload), lambda p: _refilled(run, F.concat(p, _check_digit(p)))), F.lit(0))
        at = F.instr(x, run)
        return F.concat(F.substring(x, F.lit(1), at - 1), new, F.substring(x, at + F.length(run), F.length(x)))

    card = F.get(F.transform(F.array(card_in(x)), card_of), F.lit(0))
    head = F.regexp_extract(x, SECRET_HEAD, 0)
    tail = F.regexp_extract(x, SECRET_TAIL, 0)
    value = F.substring(x, F.length(head) + 1, F.length(x) - F.length(head) - F.length(tail))
    hashed = F.substring(F.repeat(_hashed(key, "secret", value), F.ceil(F.length(x) / 64).cast("int")), F.lit(1), F.length(value))
    secret = F.concat(head, F.when(x.rlike("^(?i:AKIA|ASIA)"), F.upper(hashed)).otherwise(hashed), tail)
    shape = F.lower(x)
    ipv6 = F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(_hashed(key, "ipv6", shape), i + 1, F.lit(1)))), "")
    return (
        F.when(kind == "email", F.concat(F.lit("u"), F.substring(_hashed(key, "email", F.lower(x)), 1, 12), F.lit("@example.invalid")))
        .when(kind == "date", _date(key, x))
        .when(kind == "ssn", _ssn(key, x))
        .when(kind == "ip", _ip(key, x))
        .when(kind == "ipv6", ipv6)
        .when(kind == "card", card)
        .when(kind == "iban", _iban(key, x))
        .when(kind == "phone", F.concat(country, _refilled(local, permuted_digits(key, "phone", _digits(local)))))
        .when(kind == "secret", secret)
        .otherwise(x)
    )


def pseudonymised(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the text; ``count_col`` names a struct with the number of each kind, if wanted."""
    text = F.col(text_col)
    found, kinds, new = fresh("found"), fresh("kinds"), fresh("new")
    rows = docs.withColumn(found, F.when(text.rlike(SIGNS), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    rows = rows.withColumn(kinds, F.transform(found, kind_of))
    made = F.zip_with(found, kinds, lambda x, k: F.when(k.isNull(), x).otherwise(pseudonym(key, k, x)))
    rows = rows.withColumn(new, F.when(F.size(found) > 0, made))
    parts = F.zip_with(F.split(text, ANY), F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.when(F.col(new).isNotNull(), F.array_join(parts, "")).otherwise(text)
    out = [changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    n = lambda k: F.size(F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda x: x == k)).cast("long")
    return rows.select(*out, *([F.struct(*[n(k).alias(k) for k in SHAPES]).alias(count_col)] if count_col else []))


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: ``doc_id``, the new ``text`` and how many of each kind it had."""
    counts = fresh("n")
    out = pseudonymised(docs.select("doc_id", "text"), key, count_col=counts)
    return out.select("doc_id", "text", *[F.col(f"{counts}.{k}").alias(f"n_{k}") for k in SHAPES])
