"""Quality rules with host verdicts, in built-in column functions alone.

Each document is measured on its whole text.  The failures of each host (a
domain, here the source) are summed, each host's rate is shrunk by a beta prior
fitted to all hosts by moments, and a document is kept if it passes the base
rule and its host's shrunk rate is low enough.

Null and blank texts have no words and fail; very long texts are measured whole.
A null host is a host of its own.  Repeated rows count as documents, ids may have
any type, empty tables give no rows, and extra columns pass through ``judged``
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, fresh, stored, words_of

#: Words of a window that counts as repeated.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text_col: str = "text", window: int = WINDOW, prefix: str = "") -> DataFrame:
    """``docs`` with the five measures, each a long named ``prefix`` and its name."""
    name = {m: f"{prefix}{m}" for m in MEASURES}
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, single, hashes, places = fresh("words"), fresh("single"), fresh("hashes"), fresh("places")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(words, words_of(F.col(text_col)))
    n = F.size(words)
    # Each word is hashed once; a window's hash is made of its words' hashes.
    out = out.withColumn(single, F.transform(words, lambda w: F.xxhash64(w)))
    whole = lambda i: F.xxhash64(*[F.get(F.col(single), i + k) for k in range(window)])
    out = out.withColumn(hashes, F.when(n > window, F.transform(F.sequence(F.lit(0), n - window), whole)).otherwise(F.array().cast("array<bigint>")))
    # Only texts with fewer different windows than windows need their places looked at.
    ordered = F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(places, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered))
    equal = lambda i, j: F.get(F.col(places), i)["h"] == F.get(F.col(places), j)["h"]
    twice = F.filter(F.col(places), lambda x, i: F.coalesce(equal(i, i - 1), F.lit(False)) | F.coalesce(equal(i, i + 1), F.lit(False)))
    out = out.withColumn(places, F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.col(places),
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumns(
        {
            name["n_words"]: F.size(words).cast("long"),
            name["word_chars"]: F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            name["n_symbols"]: F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            name["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            name["n_repeat_words"]: F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop(words, single, hashes, places)


def base_failed(prefix: str = "", min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < min_words) | (100 * F.col(f"{prefix}n_repeat_words") > max_repeat_percent * n)


def host_verdicts(failures: DataFrame, *, max_rate: float = 0.5, max_strength: float = 100.0) -> DataFrame:
    """``host, failed`` rows to one row per host: documents, failures, shrunk ``rate`` and ``host_ok``.

    The prior's mean is the mean rate of the hosts, its strength comes from
    their variance (between 1 and ``max_strength``); with one host, or hosts
    that are alike, the strength is ``max_strength``.
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failures"))
    hosts = stored(hosts)
    raw = F.col("host_failures") / F.col("host_docs")
    m, v = hosts.agg(F.avg(raw), F.var_pop(raw)).first()  # one row
    strength = max(1.0, min(max_strength, m * (1 - m) / v - 1)) if v else max_strength
    rate = (F.col("host_failures") + F.lit((m or 0.0) * strength)) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", F.col("host_rate") <= max_rate)


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """One row per document: measures, ``base_failed``, its host's shrunk rate and ``kept``."""
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")))
    rows = stored(rows.withColumn("base_failed", base_failed()).drop("text"))
    hosts = host_verdicts(rows.select("host", F.col("base_failed").alias("failed")), **limits)
    out = rows.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), "host_rate")


def judged(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The rows are written with their verdict, so texts are measured once and no
    filter can be pushed into the measures, which would compute them many times.
    """
    prefix, failed, host = fresh("q") + "_", fresh("failed"), fresh("host")
    rows = measured(docs, text_col, prefix=prefix).withColumn(failed, base_failed(prefix))
    rows = stored(rows.select(*[F.col(f"`{c}`") for c in docs.columns], failed))
    hosts = host_verdicts(rows.select(F.col(host_col).alias("host"), F.col(failed).alias("failed")), **limits)
    bad = hosts.filter(~F.col("host_ok")).select(F.col("host").alias(host))
    return rows.filter(~F.col(failed)).drop(failed).join(bad, F.col(host_col).eqNullSafe(F.col(host)), "left_anti")
