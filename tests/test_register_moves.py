import datetime as dt

from ledgerloom.operators import registers as R

COLUMNS = "exception_id string, purchase_order_id string, vendor_id string, invoice_id string, invoice_amount double, po_amount double, exception_type string, status string, created_at timestamp"
ROWS = [("a", "P", "v", "1", 1.0, 9.0, "no_exception", "closed", dt.datetime(2024, 1, 1)), ("b", "P", "v", "1", 2.0, None, "price_variance", "cleared", dt.datetime(2024, 1, 2)), ("c", "P", None, "2", 3.0, None, None, "closed", None), ("d", "Q", "w", None, 4.0, None, None, None, None), ("e", "", "w", "3", 4.0, None, None, None, None)]


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_orders_move_once_and_count_what_differs(spark):
    out = R.po_rows(spark.createDataFrame(ROWS, COLUMNS))
    got = {r.purchase_order_id: (r.invoice_count, r.vendor_count, r.repeated_invoices, r.billed_amount, r.ordered_amount) for r in out.collect()}
    assert got == {"P": (3, 1, 1, 6.0, 9.0), "Q": (1, 1, 1, 4.0, None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_sorted_rows_dont_move_to_get_their_place(spark):
    ordered = spark.createDataFrame(ROWS, COLUMNS).select("exception_id", "status").orderBy("exception_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.placed(ordered)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [(r.exception_id, r.place) for r in out.orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
