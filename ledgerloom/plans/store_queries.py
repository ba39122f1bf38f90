"""Stores, tenancy, uploads, mail and requests over derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.operators import analytics as A
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import evidence as V
from ledgerloom.operators import extraction as X
from ledgerloom.operators import linking as L
from ledgerloom.operators import registers as R
from ledgerloom.plans.analytics_queries import _EXC, _OPEN, _VENDOR, _dec, _scope
from ledgerloom.plans.document_queries import _DOCS, documents
from ledgerloom.plans.ledger import AS_OF, CASES, cases
from ledgerloom.plans.registry import query
from ledgerloom.sources import store
from ledgerloom.streaming import feeds

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_ORDER = "CAST(split_part(exception_id, '-', 2) AS BIGINT)"


def _order() -> Column:
    return F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A seed of the customers as cases, a line each, every other one with two documents, read back."""
    document = lambda k: F.struct(F.concat(F.lit(f"D{k}-"), "c_custkey").alias("document_id"), F.lit("vendor_invoice").alias("document_type"))
    held = F.when(F.col("c_custkey") % 2 == 1, F.array(document(1), document(2))).otherwise(F.array(document(1)).cast("array<struct<document_id:string,document_type:string>>"))
    path = store.fresh_path(spark)
    store.write_json(_table(spark, sf_dir, "customer").select(F.concat(F.lit("SEED-"), "c_custkey").alias("exception_id"), F.concat(F.lit("Customer "), "c_custkey").alias("vendor_name"), held.alias("documents")), path)
    return store.read_seed(spark, path)


@query("SELECT 'SEED-' || c_custkey AS exception_id, 'Customer ' || c_custkey AS vendor_name FROM customer UNION ALL SELECT 'SEED-' || -s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def seed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_path(spark)
    store.write_json(_table(spark, sf_dir, "supplier").select(F.concat(F.lit("SEED-"), F.when(F.col("s_suppkey") % 2 == 1, -F.col("s_suppkey")).otherwise(F.col("s_suppkey"))).alias("exception_id"), F.col("s_name").alias("vendor_name")), path)
    return store.merge_if_absent(seed(spark, sf_dir)[0].select("exception_id", "vendor_name"), spark.read.json(path))


@query("SELECT 'SEED-' || c_custkey AS exception_id, 'D' || k || '-' || c_custkey AS document_id, 'vendor_invoice' AS document_type FROM customer, (VALUES (1), (2)) v(k) WHERE k = 1 OR c_custkey % 2 = 1")
def seed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed(spark, sf_dir)[1]


@query("SELECT 'SEED-' || c_custkey AS exception_id, c_mktsegment AS vendor_name FROM customer")
def cases_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_path(spark)
    store.write_json(_table(spark, sf_dir, "customer").select(F.concat(F.lit("SEED-"), "c_custkey").alias("exception_id"), F.col("c_mktsegment").alias("vendor_name")), path)
    return store.read_cases_json(spark, path)


@query(f"WITH {CASES} SELECT exception_id, vendor_id, CAST(created_at AS TIMESTAMP) AS created_at FROM cases WHERE created_at >= TIMESTAMP '2001-11-01'")
def case_table_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case table by day, of the last months, read from a day on."""
    path = store.fresh_path(spark)
    recent = cases(spark, sf_dir).drop("created_date").filter("created_at >= timestamp_ntz '2001-09-01'")
    store.write_cases(recent, path)
    return store.read_cases(spark, path, since="2001-11-01", schema=recent.schema).select("exception_id", "vendor_id", "created_at")


_WANTED = tuple(f"EXC-{order}-{line}-1" for order in (0, 1) for line in range(1, 8))


@query(f"WITH {CASES} SELECT exception_id, workspace_id, status FROM cases WHERE exception_id IN {_WANTED}")
def case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by key, asked for in every workspace: each is there in its own alone."""
    wanted = spark.createDataFrame([(i, w) for i in _WANTED for w in REGIONS], "exception_id string, workspace_id string")
    return store.some_cases(cases(spark, sf_dir), wanted).select("exception_id", "workspace_id", "status")


@query(f"WITH {CASES} SELECT exception_id FROM cases WHERE {_ORDER} % 5 = 0")
def default_workspace_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing workspace counts as the default one in the seed store."""
    rows = cases(spark, sf_dir).withColumn("workspace_id", F.when(_order() % 5 != 0, F.col("workspace_id")))
    return rows.filter(store.in_workspace("default", default_missing=True)).select("exception_id")


@query(f"{_DOCS} SELECT exception_id, document_id, t AS document_type FROM docs WHERE exception_id IN {_WANTED}")
def documents_of_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(i,) for i in _WANTED], "exception_id string")
    return store.documents_of_some(documents(spark, sf_dir), wanted).select("exception_id", "document_id", "document_type")


@query(f"{_DOCS} SELECT d.exception_id, d.document_id FROM docs d JOIN ledger l ON l.exception_id = d.exception_id WHERE d.t = 'purchase_order' AND d.st = 'completed' AND l.workspace_id = 'EUROPE' AND d.exception_id <> '{_WANTED[0]}'")
def documents_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.others(documents(spark, sf_dir), "purchase_order", _WANTED[0], "EUROPE").select("exception_id", "document_id")


@query(f"""{_DOCS}, own AS (SELECT exception_id, document_id AS vendor_invoice, k FROM prime),
r AS (SELECT d.exception_id, d.document_id, d.t, row_number() OVER (PARTITION BY d.exception_id, d.t ORDER BY (d.t <> 'quotation' AND o.k <> '' AND d.k = o.k) DESC, d.h DESC, d.document_id DESC) AS r FROM keyed d JOIN own o ON o.exception_id = d.exception_id WHERE d.st = 'completed')
SELECT o.exception_id, o.vendor_invoice, max(document_id) FILTER (t = 'purchase_order' AND r = 1) AS purchase_order, max(document_id) FILTER (t = 'goods_receipt_note' AND r = 1) AS goods_receipt_note, max(document_id) FILTER (t = 'quotation' AND r = 1) AS quotation,
CASE WHEN CAST(split_part(o.exception_id, '-', 2) AS BIGINT) % 6 = 0 THEN o.exception_id || '-R' END AS rejection_notice, CASE WHEN CAST(split_part(o.exception_id, '-', 2) AS BIGINT) % 6 = 0 THEN 'late' END AS rejection_reason
FROM own o LEFT JOIN r ON r.exception_id = o.exception_id GROUP BY o.exception_id, o.vendor_invoice""")
def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    notice = rows.filter(F.col("document_id").endswith("-I") & (_order() % 6 == 0))
    notice = notice.withColumns({"document_id": F.concat("exception_id", F.lit("-R")), "document_type": F.lit("rejection_notice"), "extraction": F.col("extraction").withField("rejection_reason", F.lit("late"))})
    return L.source_documents(rows.unionByName(notice))


@query(f"""WITH {CASES} SELECT exception_id, CASE WHEN {_ORDER} % 3 <> 0 THEN vendor_id END AS vendor_id, CASE WHEN {_ORDER} % 4 <> 0 THEN invoice_amount END AS invoice_amount, CASE WHEN {_ORDER} % 5 <> 0 THEN match_score END AS match_score,
CASE WHEN {_ORDER} % 7 <> 0 THEN CAST(created_at AS TIMESTAMP) END AS created_at, CAST(NULL AS VARCHAR) AS risk_level FROM cases""")
def flat_case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose records as the flat case table: '' and bad figures are null, unknown columns go, missing ones come."""
    text = lambda c, k, bad: F.when(_order() % k == 0, F.lit(bad)).otherwise(F.col(c).cast("string"))
    loose = cases(spark, sf_dir).select(
        "exception_id", text("vendor_id", 3, "").alias("vendor_id"), text("invoice_amount", 4, "a lot").alias("invoice_amount"), text("match_score", 5, "").alias("match_score"), text("created_at", 7, "soon").alias("created_at"), F.lit(1).alias("unknown"),
    )
    return store.flat_rows(loose).select("exception_id", "vendor_id", "invoice_amount", "match_score", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "risk_level")


@query(f"""WITH {CASES} SELECT exception_id, CASE WHEN {_ORDER} % 10 = 0 THEN 'closed' ELSE status END AS status FROM cases UNION ALL SELECT 'NEW-' || exception_id, 'received' FROM cases WHERE {_ORDER} % 10 = 1""")
def case_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later changes win, earlier ones don't, new keys come in."""
    rows = cases(spark, sf_dir).select("exception_id", "status", "updated_at")
    later = rows.filter(_order() % 10 == 0).withColumns({"status": F.lit("closed"), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")})
    stale = rows.filter(_order() % 10 == 2).withColumns({"status": F.lit("stale"), "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 DAY")})
    new = rows.filter(_order() % 10 == 1).withColumns({"exception_id": F.concat(F.lit("NEW-"), "exception_id"), "status": F.lit("received")})
    return store.upsert(rows, later.unionByName(stale).unionByName(new)).select("exception_id", "status")


@query(f"WITH {CASES} SELECT exception_id, CASE WHEN {_ORDER} % 9 = 0 THEN 'assigned' ELSE status END AS status, CASE WHEN {_ORDER} % 9 = 0 THEN 'Tax team' ELSE 'Accounts Payable' END AS assigned_team FROM cases")
def case_fields_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("exception_id", "status", "assigned_team")
    changes = rows.filter(_order() % 9 == 0).select("exception_id", F.lit("assigned").alias("status"), F.lit("Tax team").alias("assigned_team"))
    return store.merge_fields(rows, changes, ["status", "assigned_team"])


@query(f"WITH {CASES} SELECT exception_id FROM cases WHERE {_ORDER} % 4 <> 0")
def case_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.purge(_of_origin(spark, sf_dir)).select("exception_id")


@query(f"WITH {CASES} SELECT count(*) FILTER ({_ORDER} % 4 = 0) AS purged, count(*) FILTER ({_ORDER} % 4 <> 0) AS kept FROM cases")
def case_purge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.purge_count(_of_origin(spark, sf_dir))


def _of_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).withColumn("origin", F.when(_order() % 4 == 0, F.lit("synthetic")).when(_order() % 4 == 1, F.lit("upload")))


@query(f"WITH {CASES} SELECT exception_id, status FROM cases")
def public_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("exception_id", "status", F.struct("invoice_amount").alias("matching_input"))
    return store.public_view(rows)


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS exception_id, event_type AS action, CAST(ts AS TIMESTAMP) AS timestamp FROM events WHERE user_id = 7")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in two lots, read for one case."""
    path = store.fresh_path(spark)
    events = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("exception_id"), F.col("event_type").alias("action"), F.col("ts").alias("timestamp"))
    store.append_audit(events.filter("cast(event_id as long) % 2 = 0"), path)
    store.append_audit(events.filter("cast(event_id as long) % 2 = 1"), path)
    return store.audit_of(spark.read.parquet(path), "7").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'empty_file' WHEN 1 THEN 'unsupported_extension' WHEN 2 THEN 'not_a_pdf' WHEN 3 THEN 'too_large' WHEN 4 THEN 'unknown_document_type' END AS error FROM part""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    data = F.when(k == 0, F.lit("")).when(k == 2, F.lit("MZ junk")).when(k == 3, F.concat(F.lit("%PDF-"), F.repeat(F.lit("x"), F.lit(100)))).otherwise(F.lit("%PDF-1.7")).cast("binary")
    name = F.when(k == 1, F.lit("scan.png")).otherwise(F.lit("Scan.PDF"))
    declared = F.when(k == 4, F.lit("memo")).when(k == 5, F.lit("vendor_invoice"))
    return _table(spark, sf_dir, "part").select("p_partkey", X.upload_error(name, data, declared, 50).alias("error"))


_MAIL = """WITH m AS (SELECT event_id AS message_id, ts, user_id % 5 AS who, event_id % 3 = 0 AS seen, event_id % 4 <> 1 AS pdf FROM events), ok AS (SELECT message_id, ts FROM m WHERE NOT seen AND pdf AND who IN (0, 1, 3))"""


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of five senders: two allowed by address, one by domain, two not."""
    senders = F.array(*map(F.lit, ("Bills <AP@vendor.example>", "billing@corp.example ", "AP@vendor.example.evil", "Any One <one@Trusted.example>", "x@nottrusted.example")))
    files = F.when(F.col("event_id") % 4 != 1, F.array(F.lit("note.txt"), F.lit("Invoice.PDF"))).otherwise(F.array(F.lit("note.txt")))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.get(senders, (F.col("user_id") % 5).cast("int")).alias("sender"), (F.col("event_id") % 3 == 0).alias("seen"), files.alias("attachments"), F.col("ts").alias("received_at"))


_ALLOWED = ["ap@vendor.example", "Billing@corp.example", "@trusted.example"]


@query(f"{_MAIL} SELECT message_id FROM ok")
def accepted_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.accepted_mail(_mail(spark, sf_dir), _ALLOWED).select("message_id")


@query(f"{_MAIL} SELECT message_id FROM ok ORDER BY ts, message_id LIMIT 25")
def accepted_mail_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the cap of a batch."""
    return feeds.accepted_mail(_mail(spark, sf_dir), _ALLOWED, 25).select("message_id")


@query(f"WITH {CASES} SELECT exception_id, workspace_id || '/' || exception_id || '/' || invoice_id AS path FROM cases")
def object_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("exception_id", keys.object_path(F.col("workspace_id"), F.col("exception_id"), F.col("invoice_id")).alias("path"))


@query("SELECT 'pipeline' AS report, CAST(count(*) AS VARCHAR) AS cases FROM orders")
def eval_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recorded run, one that is broken off, and a file that is no report."""
    path = store.fresh_path(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    bodies = {"eval_report.json": f'{{"cases": {_table(spark, sf_dir, "orders").count()}}}', "extraction_report.json": '{"cases": ', "notes.json": "{}"}
    for name, body in bodies.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(body.encode()))
        out.close()
    return E.read_reports(spark, path).select("report", F.get_json_object("body", "$.cases").alias("cases"))


@query(f"""{_scope(365)}, t AS (SELECT * FROM scoped WHERE workspace_id = 'EUROPE') SELECT count(*) AS invoice_count, count(*) FILTER ({_EXC}) AS exception_count, count(*) FILTER ({_OPEN}) AS open_exception_count, CAST(sum({_dec('invoice_amount')}) AS DOUBLE) AS invoiced_value FROM t""")
def portfolio_summary_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.portfolio_summary(cases(spark, sf_dir), AS_OF, workspace="EUROPE").select("invoice_count", "exception_count", "open_exception_count", "invoiced_value")


@query(f"""{_scope(365)} SELECT vendor_id, workspace_id, count(*) AS invoice_count, count(*) FILTER ({_EXC}) AS exception_count FROM scoped GROUP BY ALL""")
def vendor_risk_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor measures of every workspace, each asked for on its own."""
    one = lambda w: A.vendor_measures(cases(spark, sf_dir), AS_OF, workspace=w).select("vendor_id", F.lit(w).alias("workspace_id"), "invoice_count", "exception_count")
    return reduce(DataFrame.unionByName, map(one, REGIONS))


@query(f"""{_scope(730)}, v AS (SELECT vendor_id, coalesce(sum({_dec('financial_impact')}) FILTER ({_OPEN}), 0) AS risk, round(count(*) FILTER ({_EXC}) / count(*), 4) AS rate FROM scoped GROUP BY vendor_id) SELECT vendor_id, CAST(risk AS DOUBLE) AS value_at_risk FROM v ORDER BY risk DESC, rate DESC, vendor_id LIMIT 50""")
def vendor_risk_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request beyond its guard rails: 730 days and 50 vendors at most."""
    days, limit, _ = A.request(days=10_000, limit=500)
    return A.vendor_risk(cases(spark, sf_dir), AS_OF, days, limit).select("vendor_id", "value_at_risk")


@query(f"{_VENDOR}, l AS (SELECT vendor_id, string_agg(exception_type || ':' || n, ',' ORDER BY n DESC, exception_type) AS recurring_types FROM types GROUP BY vendor_id) SELECT v.vendor_id, coalesce(recurring_types, '') AS recurring_types FROM vendors v LEFT JOIN l ON l.vendor_id = v.vendor_id")
def vendor_recurring_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("recurring_types", lambda x: F.concat_ws(":", x["exception_type"], x["n"].cast("string"))), ",")
    return A.vendor_measures(cases(spark, sf_dir), AS_OF).select("vendor_id", shown.alias("recurring_types"))


@query(f"""{_VENDOR}, w AS (SELECT v.*, n AS top_n FROM vendors v LEFT JOIN types t ON t.vendor_id = v.vendor_id AND r = 1)
SELECT vendor_id, CASE WHEN exception_count = 0 THEN 'No exceptions across ' || invoice_count || ' invoices in this window.' ELSE exception_count || ' of ' || invoice_count || ' invoices raised an exception (' || CAST(round_even(100.0 * exception_count / invoice_count, 0) AS BIGINT) || '%).'
|| ' Most common failure: ' || replace(top_exception_type, '_', ' ') || ' (' || CAST(round_even(100.0 * top_n / exception_count, 0) AS BIGINT) || '% of their exceptions).' || CASE WHEN value_at_risk > 0 THEN ' INR ' || format('{{:,}}', CAST(round_even(value_at_risk, 0) AS BIGINT)) || ' is currently open and unpaid.' ELSE '' END
|| CASE WHEN average_open_age_days >= 14 THEN ' Open cases are averaging ' || CAST(round_even(average_open_age_days, 0) AS BIGINT) || ' days, past the 14-day SLA.' ELSE '' END END AS why_at_risk FROM w""")
def vendor_why_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vendor_measures(cases(spark, sf_dir), AS_OF).select("vendor_id", A.why_at_risk().alias("why_at_risk"))


@query(f"""{_scope(365)}, s AS (SELECT count(*) FILTER (exception_type IN ('duplicate_invoice', 'po_over_billed')) AS c, coalesce(sum({_dec('financial_impact')}) FILTER (exception_type IN ('duplicate_invoice', 'po_over_billed')), 0)::DOUBLE AS v, count(*) FILTER (exception_type IN ('duplicate_invoice', 'po_over_billed') AND match_score >= 100) AS w FROM scoped)
SELECT c || ' exceptions worth INR ' || format('{{:,}}', CAST(round_even(v, 0) AS BIGINT)) || ' came from checks that read the rest of the workspace, not this invoice.' || CASE WHEN w > 0 THEN ' ' || w || ' of them scored a full three-way match on their own documents — a per-invoice system would have passed them for payment.' ELSE '' END AS headline FROM s""")
def cross_case_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cross_case_value(cases(spark, sf_dir), AS_OF).select("headline")


@query(f"""{_VENDOR}, k AS (SELECT regexp_replace(lower(vendor_name), '(^m/s)|( pvt. ltd.)|( private limited)|[^a-z0-9]', '', 'g') AS key, arg_min({{'id': vendor_id, 'n': exception_count}}, (-value_at_risk, -exception_rate, vendor_id)) AS h FROM (SELECT * FROM vendors ORDER BY value_at_risk DESC, exception_rate DESC, vendor_id LIMIT 200) GROUP BY 1)
SELECT c.exception_id, k.h.id AS history_vendor, k.h.n AS history_exceptions FROM cases c LEFT JOIN k ON k.key = regexp_replace(lower(c.vendor_name), '(^m/s)|( pvt. ltd.)|( private limited)|[^a-z0-9]', '', 'g')""")
def vendor_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = A.vendor_risk(cases(spark, sf_dir), AS_OF, 365, 200)
    return A.vendor_history(cases(spark, sf_dir).select("exception_id", "vendor_name"), ranked).select("exception_id", F.col("history.vendor_id").alias("history_vendor"), F.col("history.exception_count").alias("history_exceptions"))


@query(f"""{_scope(12 * 31)} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS invoices, count(*) FILTER ({_EXC}) AS exceptions FROM scoped WHERE created_at IS NOT NULL GROUP BY 1""")
def monthly_trend_untailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monthly_trend(cases(spark, sf_dir), AS_OF, tail=False).select("month", "invoices", "exceptions")


@query(f"""{_scope(365)}, a AS (SELECT greatest(0, epoch_us(TIMESTAMP '2001-12-01') - epoch_us(created_at + INTERVAL 7 HOUR)) / 86400000000.0::DOUBLE AS age, financial_impact FROM scoped WHERE {_OPEN}),
b AS (SELECT CASE WHEN age <= 3 THEN '0-3' WHEN age <= 7 THEN '4-7' WHEN age <= 14 THEN '8-14' WHEN age <= 30 THEN '15-30' ELSE '31+' END AS label, count(*) AS n FROM a GROUP BY 1)
SELECT d.label, coalesce(n, 0) AS count FROM (VALUES ('0-3'), ('4-7'), ('8-14'), ('15-30'), ('31+')) d(label) LEFT JOIN b ON b.label = d.label""")
def ageing_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = cases(spark, sf_dir).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 7 HOURS"))
    return A.ageing_buckets(later, AS_OF, whole_days=False).select("label", "count")


@query(f"{_VENDOR} SELECT vendor_id, risk_band FROM vendors WHERE risk_band = 'high' AND contains(lower(vendor_name), 'supplier')")
def vendor_register_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vendor_filter(A.vendor_measures(cases(spark, sf_dir), AS_OF), "high", "SUPPLIER").select("vendor_id", "risk_band")


@query(f"{_VENDOR} SELECT vendor_id, row_number() OVER (ORDER BY value_at_risk DESC, vendor_id) AS by_value, row_number() OVER (ORDER BY vendor_name, vendor_id) AS by_name FROM vendors")
def vendor_register_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.vendor_measures(cases(spark, sf_dir), AS_OF).select("vendor_id", "vendor_name", "value_at_risk")
    place = lambda key, name: R.placed(R.vendor_sort(rows, key)).select("vendor_id", F.col("place").alias(name))
    return place("value_at_risk", "by_value").join(place("vendor_name", "by_name"), "vendor_id")


_PO = f"""{_scope(None)}, po AS (SELECT purchase_order_id, count(*) AS n, count(*) FILTER ({_EXC}) AS e, list(DISTINCT status) AS statuses, bool_or(contains(invoice_id, '12')) AS hit FROM scoped GROUP BY purchase_order_id)"""


@query(f"{_PO} SELECT purchase_order_id FROM po WHERE n > 1 AND list_contains(statuses, 'closed') AND (hit OR contains(purchase_order_id, '12'))")
def po_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    return R.po_filter(R.po_rows(rows), "multi", "closed", "12", R.po_invoices(rows)).select("purchase_order_id")


@query(f"{_PO} SELECT purchase_order_id, e AS exception_count FROM po WHERE e > 0")
def po_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.po_filter(R.po_rows(cases(spark, sf_dir)), "exceptions").select("purchase_order_id", "exception_count")


@query(f"{_scope(None)} SELECT exception_id, exception_type FROM scoped WHERE {_EXC} AND {_ORDER} % 2 = 0 UNION ALL SELECT exception_id, NULL FROM scoped WHERE {_ORDER} % 2 = 1")
def invoice_register_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of the analysed rows that aren't cleared, and the rows not analysed yet."""
    rows = cases(spark, sf_dir).withColumns({"exception_type": F.when(_order() % 2 == 0, F.col("exception_type")), "status": F.lit("assigned")})
    rows = R.invoice_rows(rows)
    return R.invoice_filter(rows, "exceptions").unionByName(R.invoice_filter(rows, "unanalysed")).select("exception_id", "exception_type")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'missing_status' WHEN 1 THEN 'invalid_status' END AS error FROM customer""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return _table(spark, sf_dir, "customer").select("c_custkey", V.status_change(F.when(k == 0, F.lit("")).when(k == 1, F.lit("done")).when(k == 2, F.lit("assigned")).otherwise(F.lit("closed"))).alias("error"))


@query(f"{_scope(None)} SELECT exception_type, count(*) AS n FROM scoped WHERE {_EXC} GROUP BY 1")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corpus_counts(cases(spark, sf_dir))
