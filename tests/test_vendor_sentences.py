from pyspark.sql import functions as F

from ledgerloom.operators.analytics import why_at_risk


def test_percentages_at_a_half_go_to_the_even_one(spark):
    """46 of 80 are 57.5 %, though 46 / 80 * 100 is a little less; 1 of 8 are 12.5 %."""
    rows = [("a", 80, 46, 23), ("b", 8, 1, 1), ("c", 200, 57, 57)]
    out = spark.createDataFrame(rows, "id string, invoice_count long, exception_count long, top long").withColumns({
        "top_exception_type": F.lit("price_variance"), "value_at_risk": F.lit(0.0), "average_open_age_days": F.lit(0.0),
        "recurring_types": F.array(F.struct(F.lit("price_variance").alias("exception_type"), F.col("top").alias("n"))),
    })
    said = {r["id"]: r["s"] for r in out.select("id", why_at_risk().alias("s")).collect()}
    assert "(58%)" in said["a"] and "(50% of their exceptions)" in said["a"]
    assert "(12%)" in said["b"] and "(28%)" in said["c"]
