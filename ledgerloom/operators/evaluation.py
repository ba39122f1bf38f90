"""Scores of decisions and extractions against labels, and the trust ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files of recorded runs.
REPORTS = {"eval_report.json": "pipeline", "extraction_report.json": "extraction"}


def confusion(rows: DataFrame) -> DataFrame:
    """``expected, predicted, n``."""
    return rows.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_type(rows: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 of each label; undefined ratios are null, not 0."""
    cells = confusion(rows)
    sides = cells.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit("e").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("x"), (F.col("expected") == F.col("predicted")).alias("hit"), "n")
    sides = sides.select("x.label", "x.side", "hit", "n")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    e, p = F.col("side") == "e", F.col("side") == "p"
    out = sides.groupBy("label").agg(count(e & F.col("hit")).alias("tp"), count(p & ~F.col("hit")).alias("fp"), count(e & ~F.col("hit")).alias("fn"))
    out = out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumns({"f1": F.round(f1, 4), "precision": F.round("precision", 4), "recall": F.round("recall", 4)})


def macro(rows: DataFrame) -> DataFrame:
    """Means over the labels for which a ratio is defined."""
    return per_type(rows).agg(*[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def detection(rows: DataFrame, clean: str = "no_exception") -> DataFrame:
    """Exceptions found at all, whatever their type: recall, precision, missed, false alarms, exact share."""
    real, said = F.col("expected") != clean, F.col("predicted") != clean
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(real & said).alias("caught"), F.count_if(real & ~said).alias("missed"), F.count_if(~real & said).alias("false_alarms"), F.count_if(F.col("expected") == F.col("predicted")).alias("exact"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    return out.withColumns({"recall": ratio(F.col("caught"), F.col("caught") + F.col("missed")), "precision": ratio(F.col("caught"), F.col("caught") + F.col("false_alarms")), "exact_share": ratio(F.col("exact"), F.col("n"))})


def cross_case_share(rows: DataFrame) -> DataFrame:
    """``predicted, cross_case, financial_impact``: how much of what was flagged needed other cases to be seen."""
    flagged = F.col("predicted") != "no_exception"
    out = rows.agg(F.count_if("cross_case").alias("exceptions_found"), F.coalesce(F.sum(F.when(F.col("cross_case"), F.col("financial_impact").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("value"), F.count_if(flagged).alias("flagged"))
    return out.withColumn("share_of_exceptions", F.coalesce(F.round(F.try_divide("exceptions_found", "flagged"), 4), F.lit(0.0))).drop("flagged")


def by_condition(rows: DataFrame, *columns: str) -> DataFrame:
    """Accuracy by noise or any other condition."""
    hit = F.col("expected") == F.col("predicted")
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"), F.round(F.avg(hit.cast("double")), 4).alias("accuracy"))


def tally(rows: DataFrame) -> DataFrame:
    """Extraction outcomes overall, by layout and by field in one pass; absent fields don't count for accuracy."""
    rows.createOrReplaceTempView("ledgerloom_tally")
    return rows.sparkSession.sql(
        """SELECT CASE WHEN grouping(layout) = 0 THEN 'layout' WHEN grouping(field) = 0 THEN 'field' ELSE 'all' END AS level, coalesce(layout, field, 'all') AS name,
        count_if(outcome = 'correct') AS correct, count_if(outcome = 'wrong') AS wrong, count_if(outcome = 'missed') AS missed, count_if(outcome = 'absent') AS absent,
        round(try_divide(count_if(outcome = 'correct'), count_if(outcome <> 'absent')), 4) AS accuracy
        FROM ledgerloom_tally GROUP BY GROUPING SETS ((), (layout), (field)) ORDER BY level, coalesce(accuracy, 0), name"""
    )


def field_outcome(kind: str, parsed: str, expected: str):
    """Outcome of a field as a column: numbers by value, references by key, the rest as trimmed text."""
    from ledgerloom.functions.dates import parse_date
    from ledgerloom.functions.keys import ascii_key

    a, b, k = F.col(parsed), F.col(expected), F.col(kind)
    same = (
        F.when(k == "number", F.abs(a.try_cast("double") - b.try_cast("double")) < 0.01).when(k == "date", parse_date(a) == parse_date(b))
        .when(k == "reference", ascii_key(a) == ascii_key(b)).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))
    )
    return F.when(b.isNull(), F.when(a.isNull(), F.lit("absent")).otherwise(F.lit("wrong"))).when(a.isNull(), F.lit("missed")).when(F.coalesce(same, F.lit(False)), F.lit("correct")).otherwise(F.lit("wrong"))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """``report, body``: the recorded runs among ``pipeline`` and ``extraction``; none at all is an error, a broken one is left out."""
    names = F.create_map(*[F.lit(x) for kv in REPORTS.items() for x in kv])
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.try_element_at(names, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).alias("report"), F.col("value").alias("body"))
    found = found.filter(F.col("report").isNotNull() & F.try_parse_json("body").isNotNull())
    if found.isEmpty():
        raise ValueError("not measured: no run has been recorded")
    return found


def corpus_counts(cases: DataFrame) -> DataFrame:
    """Exceptions by type, for calibration; clean cases left out."""
    return cases.filter("exception_type is not null and exception_type <> 'no_exception'").groupBy("exception_type").agg(F.count(F.lit(1)).alias("n"))


# Fixed value: what a stated amount is multiplied by where the guard rail is put to the test.
FAULT = 1.248


def with_fault(correct: Column) -> Column:
    """A stated amount that is wrong on purpose."""
    return F.round(correct * FAULT, 2)


def trust_checks(rows: DataFrame, least: float = 0.01) -> DataFrame:
    """Stated against computed values: how far apart, in per cent (null if 0 was computed or nothing stated), overridden.

    Where nothing was stated, the difference is 0 and nothing was overridden.
    """
    diff = F.coalesce(F.abs(F.col("ai_value") - F.col("computed_value")), F.lit(0.0))
    percent = F.when(F.col("ai_value").isNotNull() & (F.col("computed_value") != 0), F.round(diff / F.abs(F.col("computed_value")) * 100, 4))
    return rows.withColumns({"difference": F.round(diff, 2), "difference_percent": percent, "overridden": diff > least})


def trust_summary(checks: DataFrame, significant: float = 1.0) -> DataFrame:
    """One row over real checks; injected faults are counted apart."""
    real = F.coalesce(F.col("kind") != "fault_injection", F.lit(True))
    bad = real & F.col("overridden")
    out = checks.agg(
        F.count_if(real).alias("checks"), F.count_distinct(F.when(real, F.col("exception_id"))).alias("cases"), F.count_if(bad).alias("overrides"), F.count_if(bad & (F.col("difference_percent") >= significant)).alias("significant"),
        F.coalesce(F.max(F.when(bad, F.abs("difference"))), F.lit(0.0)).alias("largest"), F.coalesce(F.sum(F.when(bad, F.abs("difference").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("prevented"), F.count_if(~real).alias("injected"),
    )
    return out.withColumn("override_rate", F.coalesce(F.round(F.try_divide("overrides", "checks"), 4), F.lit(0.0)))


def recent_overrides(checks: DataFrame, n: int = 25) -> DataFrame:
    return checks.filter("overridden").orderBy(F.desc("checked_at"), "exception_id").limit(n)


def exemplars(cases: DataFrame, n: int = 8) -> DataFrame:
    """A first case of the most frequent (type, risk) pairs, clean ones left out, whitelisted columns only."""
    rows = cases.filter("exception_type is not null and exception_type <> 'no_exception'")
    out = rows.groupBy("exception_type", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("match_score", "financial_impact"), F.struct("created_at", "exception_id")).alias("x"))
    return out.orderBy(F.desc("n"), "exception_type", "risk_level").limit(n).select("exception_type", "risk_level", "n", "x.*")
