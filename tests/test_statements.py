"""Bound statements against the frame forms, with hostile names, nulls and no rows; pruning of bound windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.model import CASE
from ledgerloom.operators import analytics as A
from ledgerloom.operators import statements as S
from ledgerloom.sources import store

AS_OF = dt.datetime(2024, 6, 1)
HOSTILE = ["w", "w' OR '1'='1", "'; DROP TABLE cases; --", ":cutoff", "{cases}", 'a"b', "\\'", "%", "ω"]


def rows(n=300, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        made = {
            "exception_id": f"e{i}", "workspace_id": r.choice(HOSTILE), "vendor_id": r.choice(["v1", "v2", "", None]), "vendor_name": r.choice(["Acme", "", None, "Zed"]), "business_unit": r.choice(["u", None]), "invoice_amount": r.choice([None, 10.25, 1e6]),
            "status": r.choice(["assigned", "exception_detected", "closed", None]), "exception_type": r.choice([None, "", "no_exception", "price_variance", "duplicate_invoice", "po_over_billed"]), "match_score": r.choice([None, 100, 40]),
            "financial_impact": r.choice([None, 1.5, 3e5]), "created_at": r.choice([None, AS_OF - dt.timedelta(days=r.randint(0, 500), minutes=r.randint(0, 900)), AS_OF + dt.timedelta(days=1)]),
        }
        out.append(tuple(made.get(f.name) for f in CASE))
    return out


FORMS = ["portfolio_summary", "vendor_risk", "monthly_trend", "ageing_buckets", "cross_case_value"]


@pytest.mark.parametrize("name", FORMS)
def test_statements_like_the_frame_forms(spark, name):
    cases = spark.createDataFrame(rows(), CASE)
    for table in (cases, cases.limit(0)):
        for days, workspace in ((365, None), (30, HOSTILE[1]), (None, HOSTILE[2]), (90, "nobody")):
            window = {"months": 5} if name == "monthly_trend" else {"days": days}
            want = getattr(A, name)(table, AS_OF, workspace=workspace, **window).drop("headline")
            got = getattr(S, name)(table, AS_OF, workspace=workspace, **window)
            assert [r.asDict(True) for r in got.select(*want.columns).collect()] == [r.asDict(True) for r in want.collect()], (days, workspace)


@pytest.mark.parametrize("workspace", HOSTILE)
def test_a_workspace_is_a_value_whatever_its_name(spark, workspace):
    made = rows()
    got = S.portfolio_summary(spark.createDataFrame(made, CASE), AS_OF, None, workspace).first().invoice_count
    assert got == sum(r[CASE.names.index("workspace_id")] == workspace for r in made)
    assert workspace == "w" or workspace not in S.PORTFOLIO_SUMMARY.replace("{cases}", "").replace(":cutoff", "") or workspace == "%"


def test_bound_windows_prune(spark, tmp_path):
    dated = [r for r in rows() if r[CASE.names.index("created_at")]]
    store.write_cases(spark.createDataFrame(dated, CASE), str(tmp_path / "c"), by="month")
    table = store.read_cases(spark, str(tmp_path / "c"))
    plan = S.portfolio_summary(table, AS_OF, 30)._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert S.portfolio_summary(table, AS_OF, 30).collect() == A.portfolio_summary(table, AS_OF, 30).collect()
    files = table.filter(F.col("created_date") >= "2024-05-01").select(F.input_file_name()).distinct().count()
    assert 0 < files < table.select(F.input_file_name()).distinct().count()
