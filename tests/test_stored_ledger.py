import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import ledger as L
from ledgerloom.sources import store

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_lines_move_once_on_their_way_into_the_ledger(spark):
    """To their order; all windows keep to that, and vendors come to them."""
    plan = L.derived_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_a_table_by_month_is_whole_and_leaves_no_lots(spark, tmp_path):
    days = [dt.date(2024, 1 + k % 11, 1 + k % 28) for k in range(300)] + [None, None]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(days)], "id int, day date").withColumn("created_date", F.trunc("day", "MM"))
    before = {p.name for p in Path(store.work_folder(spark).removeprefix("file://").removeprefix("file:")).iterdir()}
    store.write_by_month(rows, str(tmp_path / "t"), ["id"])
    back = spark.read.schema(rows.schema).parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("created_date=")]) == 12
    assert {p.name for p in Path(store.work_folder(spark).removeprefix("file://").removeprefix("file:")).iterdir()} == before
    assert spark.conf.get(store.CLEANUP, None) in (None, "false", "true")
