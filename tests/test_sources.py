"""Stores, streams, text fields and date notations on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, keys
from ledgerloom.operators import evaluation, extraction, linking
from ledgerloom.sources import store
from ledgerloom.streaming import feeds


def test_seed_and_case_files(spark, tmp_path):
    seed = {"cases": [{"exception_id": "a", "vendor_id": "", "invoice_amount": "12.5", "documents": [{"document_id": "d", "document_type": "quotation"}]}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed))
    cases, documents = store.read_seed(spark, str(tmp_path / "seed.json"))
    row = store.flat_rows(cases.withColumn("junk", F.lit(1)).withColumn("match_score", F.lit("bad"))).first()
    assert (row.vendor_id, row.invoice_amount, row.match_score) == (None, 12.5, None) and documents.first().exception_id == "a"
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(ValueError, match="no list"):
        store.read_cases_json(spark, str(tmp_path / "bad.json"))


def cases(spark):
    rows = [("a", "w", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6), "synthetic"), ("b", None, dt.datetime(2024, 3, 5), dt.datetime(2024, 3, 6), None), ("c", "w", None, None, "live")]
    return store.flat_rows(spark.createDataFrame(rows, "exception_id string, workspace_id string, created_at timestamp, updated_at timestamp, origin string"))


def test_case_table(spark, tmp_path):
    path = f"{tmp_path}/cases"
    store.write_cases(cases(spark), path)
    assert sorted(r.exception_id for r in store.read_cases(spark, path).collect()) == ["a", "b", "c"]
    recent = store.read_cases(spark, path, since="2024-02-01")
    assert sorted(r.exception_id for r in recent.collect()) == ["b", "c"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((created_date" in plan or "created_date" in plan.split("PartitionFilters")[1][:80]
    assert [r.exception_id for r in store.read_cases(spark, path, since="2024-02-01", keep_undated=False).collect()] == ["b"]
    with pytest.raises(ValueError, match="nothing"):
        store.write_cases(cases(spark).limit(0), path)


def test_merges_and_tenancy(spark):
    base = cases(spark)
    change = base.filter("exception_id = 'a'").withColumns({"status": F.lit("closed"), "updated_at": F.lit(dt.datetime(2025, 1, 1))})
    assert {r.exception_id: r.status for r in store.upsert(base, change).collect()} == {"a": "closed", "b": None, "c": None}
    assert {r.exception_id: r.status for r in store.merge_fields(base, change, ["status"]).collect()}["a"] == "closed"
    assert store.merge_if_absent(base, base).count() == 3
    assert sorted(r.exception_id for r in store.purge(base).collect()) == ["b", "c"]
    assert store.one_case(base, "a", "w").count() == 1 and store.one_case(base, "a", "other").count() == 0 and store.one_case(base, "b", "default").count() == 0
    assert base.filter(store.in_workspace("default", default_missing=True)).count() == 1


def test_streams(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(i, "a", dt.datetime(2024, 1, 1, 0, i), float(i)) for i in range(5)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, value double").write.parquet(source)
    live = spark.readStream.schema("user_id long, event_type string, ts timestamp, value double").parquet(source)
    feeds.audit_sink(live, out, f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(out).count() == 5
    counted = feeds.windowed_counts(live).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert [(r.n, r.value) for r in spark.table("counted").collect()] == [(5, 10.0)]
    seen = {}
    feeds.latest_state(live.withColumn("k", F.col("user_id") % 2), f"{tmp_path}/c2", lambda b, _: seen.update({r.k: r.user_id for r in b.collect()}), "k", "ts").awaitTermination()
    assert seen == {0: 4, 1: 3}
    mail = spark.createDataFrame([("1", "A <x@ok.com>", False, ["a.PDF"], rows[0][2]), ("2", "x@evil.com", False, ["a.pdf"], rows[0][2]), ("3", "x@ok.com", False, ["a.txt"], rows[0][2]), ("4", "b@evil.com", True, ["a.pdf"], rows[0][2])], "message_id string, sender string, seen boolean, attachments array<string>, received_at timestamp")
    assert [r.message_id for r in feeds.accepted_mail(mail, ["@ok.com"], 5).collect()] == ["1"]


def test_dates_and_keys(spark):
    texts = ["2024-1-5", "5/1/2024", "05-01-2024", "5.1.2024", "5/1/24", "5 Jan 2024", "5 january 2024", "05-JAN-2024", "5-Jan-24", "Jan 5, 2024", "2024-01-05T10:00:00Z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.parse_date(F.col("t")).alias("d")).collect()
    assert {r.d for r in got} == {dt.date(2024, 1, 5)}
    assert spark.createDataFrame([("31/02/2024",), ("soon",), (None,)], "t string").select(dates.parse_date(F.col("t")).alias("d")).filter("d is not null").count() == 0
    names = ["M/s Acme & Sons Private Limited", "ACME and Sons Pvt. Ltd.", "Messrs. Acme & Sons Pvt Ltd"]
    assert {r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(keys.vendor_key(F.col("n")).alias("k")).collect()} == {"acme&sonspvtltd"}
    ages = spark.createDataFrame([(3.5,), (0.0,), (7.99,), (31.0,), (None,)], "a double").select(dates.age_bucket(F.col("a")).alias("b")).collect()
    assert [r.b for r in ages] == ["0-3", "0-3", "4-7", "31+", None]


def test_extraction_and_scores(spark):
    text = "TAX INVOICE\nInvoice No: A-1\nSubtotal: Rs. 1,000.50\nTotal Tax\n\n  100\nIFSC: hdfc0001234\nref PO-77 and PO-2024/0099\n27ABCDE1234F1Z5"
    x = spark.createDataFrame([(text,)], "t string").select(extraction.invoice_fields(F.col("t")).alias("x"), extraction.classify(F.col("t")).alias("c")).first()
    assert (x.x.invoice_number, x.x.subtotal, x.x.tax_amount, x.x.total_amount, x.x.po_number, x.x.bank_ifsc, x.x.vendor_tax_id) == ("A-1", 1000.5, 100.0, 1100.5, "PO-2024/0099", "HDFC0001234", "27ABCDE1234F1Z5")
    assert x.c.document_type == "vendor_invoice"
    assert spark.createDataFrame([("nothing here",)], "t string").select(extraction.classify(F.col("t")).alias("c")).first().c.document_type is None
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "expected string, predicted string")
    got = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluation.per_type(rows).collect()}
    assert got == {"a": (1, 1, 1, 0.5, 0.5), "b": (0, 1, 0, 0.0, None), "c": (0, 0, 1, None, 0.0)}
    files = spark.createDataFrame([("a.pdf", b"%PDF-1", None), ("a.txt", b"%PDF-1", None), ("a.pdf", b"", None), ("a.pdf", b"MZ", None), ("a.pdf", b"%PDF-1", "memo")], "n string, d binary, k string")
    assert [r.e for r in files.select(extraction.upload_error(F.col("n"), F.col("d"), F.col("k")).alias("e")).collect()] == [None, "unsupported_extension", "empty_file", "not_a_pdf", "unknown_document_type"]


def test_linking_prefers_references(spark):
    from ledgerloom.model import DOCUMENT

    def doc(i, kind, po, hour):
        fields = {f: None for f in DOCUMENT["extraction"].dataType.names} | {"po_number": po}
        return (i, "e", "w", kind, "completed", dt.datetime(2024, 1, 1, hour), 0.9, fields)

    def link(*docs):
        return tuple(linking.linked(spark.createDataFrame(list(docs), DOCUMENT), "purchase_order").select("document_id", "warning").first())

    inv = doc("i", "vendor_invoice", "PO-1", 0)
    assert link(inv, doc("a", "purchase_order", "po 1", 1), doc("b", "purchase_order", "PO-2", 5)) == ("a", None)
    assert link(inv, doc("b", "purchase_order", "PO-2", 5)) == ("b", "reference_mismatch")
    # The invoice states an order that none carries; only where it states none is the link merely unverified.
    assert link(inv, doc("b", "purchase_order", None, 5), doc("c", "purchase_order", None, 6)) == ("c", "reference_mismatch")
    assert link(doc("i", "vendor_invoice", None, 0), doc("b", "purchase_order", "PO-2", 5), doc("c", "purchase_order", None, 6)) == ("c", "unverified_link")


def test_windows_read_their_months_alone(spark, tmp_path):
    from ledgerloom.model import CASE
    from ledgerloom.operators import analytics

    rows = [{f.name: None for f in CASE} | {"exception_id": f"e{k}", "vendor_id": "v", "created_at": dt.datetime(2024, 1, 1) + dt.timedelta(days=10 * k) if k else None, "invoice_amount": 1.0} for k in range(30)]
    cases = spark.createDataFrame([tuple(r[f.name] for f in CASE) for r in rows], CASE)
    store.write_cases(cases, str(tmp_path / "cases"), by="month")
    table = store.read_cases(spark, str(tmp_path / "cases"))
    as_of = dt.datetime(2024, 10, 1)
    for days, want in ((30, 6), (365, 30), (None, 30)):
        assert analytics.scoped(table, as_of, days).count() == analytics.scoped(cases, as_of, days).count() == want
    recent = analytics.scoped(table, as_of, 30)
    months = {r.f.split("created_date=")[1][:10] for r in recent.select(F.input_file_name().alias("f")).distinct().collect()}
    assert months <= {"2024-09-01", "2024-10-01", "__HIVE_DEF"}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert analytics.portfolio_summary(table, as_of, 30).first().invoice_count == 6


def test_stores_keep_columns_of_any_name(spark):
    now = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "x", now, 1, 2), ("b", "y", now, 3, 4)], "exception_id string, status string, updated_at timestamp, _new int, _rank int")
    new = spark.createDataFrame([("a", "z", now + dt.timedelta(1), 5, 6)], rows.schema)
    assert {tuple(r)[:2] + tuple(r)[3:] for r in store.upsert(rows, new).collect()} == {("a", "z", 5, 6), ("b", "y", 3, 4)}
    merged = store.merge_fields(rows.withColumn("_status", F.lit(9)), new.select("exception_id", "status"), ["status"])
    assert {(r.exception_id, r.status, r["_status"]) for r in merged.collect()} == {("a", "z", 9), ("b", "y", 9)}


def test_registers_sort_as_people_read(spark):
    from ledgerloom.operators import registers

    names = ["Zed", "apple", "Äpfel", "Apple", "zebra", "éclair", "Eclair", "eclair", "_x", "10", "9", None]
    rows = spark.createDataFrame([(f"e{i}", n, None if n is None else float(i)) for i, n in enumerate(names)], "exception_id string, name string, amount double")
    order = ["_x", "10", "9", "Äpfel", "apple", "Apple", "eclair", "Eclair", "éclair", "zebra", "Zed"]
    assert [r.name for r in registers.register_sort(rows, "name").collect()] == [*order, None]
    assert [r.name for r in registers.register_sort(rows, "name", descending=True).collect()] == [*order[::-1], None]
    assert [r.amount for r in registers.register_sort(rows, "amount", descending=True).collect()] == [float(i) for i in range(10, -1, -1)] + [None]
    assert [r.place for r in registers.placed(registers.register_sort(rows, "name")).orderBy("place").collect()] == list(range(1, 13))
