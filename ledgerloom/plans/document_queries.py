"""Linking, evidence, approval, extraction, evaluation and streams over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_timestamp
from ledgerloom.model import DOCUMENT
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import evidence as V
from ledgerloom.operators import linking as L
from ledgerloom.operators import matching as M
from ledgerloom.plans.ledger import CASES, LEDGER, cases, ledger
from ledgerloom.plans.matching_queries import _IN, inputs
from ledgerloom.plans.registry import query
from ledgerloom.sources import store
from ledgerloom.streaming import feeds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice, up to two orders, receipt and quotation of each ledger row; some failed, some replaced by a later one, some still processed."""
    rows = ledger(spark, sf_dir)
    doc = lambda kind, suffix, number, hours: F.struct(F.concat("exception_id", F.lit(suffix)).alias("document_id"), F.lit(kind).alias("document_type"), number.alias("po_number"), (F.col("uploaded_at") + F.make_dt_interval(hours=F.lit(hours))).cast("timestamp").alias("uploaded_at"))
    own = F.concat(F.lit("PO-"), "purchase_order_id")
    made = F.array(
        doc("vendor_invoice", "-I", F.when(F.col("part") % 19 != 0, own), 0), F.when(F.col("purchase_order_exists"), doc("purchase_order", "-P", F.when(F.col("part") % 29 == 0, F.lit("PO-0")).otherwise(F.concat(F.lit("po "), "purchase_order_id")), 1)),
        F.when(F.col("part") % 5 == 0, doc("purchase_order", "-Q", F.lit("PO-1"), 2)), F.when(F.col("goods_receipt_exists"), doc("goods_receipt_note", "-G", F.when(F.col("part") % 3 != 0, own), 3)), F.when(F.col("part") % 4 == 0, doc("quotation", "-T", own, 0)),
        F.when(F.col("part") % 23 == 2, doc("vendor_invoice", "-J", F.lit("PO-1"), 9)), F.when(F.col("part") % 21 == 8, doc("vendor_invoice", "-K", F.lit("PO-1"), -2)), F.when(F.col("part") % 8 == 4, doc("quotation", "-U", F.lit("PO-1"), 1)),
    )
    out = rows.select("exception_id", "workspace_id", F.explode(F.array_compact(made)).alias("d"), "part", "total_c")
    fields = [F.col("d.po_number").alias(f.name) if f.name == "po_number" else F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENT["extraction"].dataType]
    kind = F.right("d.document_id", F.lit(2))
    state = F.when((F.col("part") % 31 == 0) | (kind == "-J") | ((kind == "-P") & (F.col("part") % 7 == 3)), F.lit("failed")).when((kind == "-G") & (F.col("part") % 13 == 4), F.lit("processing")).otherwise(F.lit("completed"))
    return out.select("d.document_id", "exception_id", "workspace_id", "d.document_type", state.alias("processing_state"), "d.uploaded_at", F.lit(0.9).alias("confidence"), F.struct(*fields).alias("extraction"))


_DOCS = f"""WITH {LEDGER}, docs0 AS (
SELECT exception_id, exception_id || '-I' AS document_id, 'vendor_invoice' AS t, CASE WHEN part % 19 <> 0 THEN 'PO-' || purchase_order_id END AS ref, 0 AS h, part FROM ledger UNION ALL
SELECT exception_id, exception_id || '-P', 'purchase_order', CASE WHEN part % 29 = 0 THEN 'PO-0' ELSE 'po ' || purchase_order_id END, 1, part FROM ledger WHERE purchase_order_exists UNION ALL
SELECT exception_id, exception_id || '-Q', 'purchase_order', 'PO-1', 2, part FROM ledger WHERE part % 5 = 0 UNION ALL
SELECT exception_id, exception_id || '-G', 'goods_receipt_note', CASE WHEN part % 3 <> 0 THEN 'PO-' || purchase_order_id END, 3, part FROM ledger WHERE goods_receipt_exists UNION ALL
SELECT exception_id, exception_id || '-T', 'quotation', 'PO-' || purchase_order_id, 0, part FROM ledger WHERE part % 4 = 0 UNION ALL
SELECT exception_id, exception_id || '-J', 'vendor_invoice', 'PO-1', 9, part FROM ledger WHERE part % 23 = 2 UNION ALL
SELECT exception_id, exception_id || '-K', 'vendor_invoice', 'PO-1', -2, part FROM ledger WHERE part % 21 = 8 UNION ALL
SELECT exception_id, exception_id || '-U', 'quotation', 'PO-1', 1, part FROM ledger WHERE part % 8 = 4),
docs AS (SELECT *, CASE WHEN part % 31 = 0 OR document_id LIKE '%-J' OR (document_id LIKE '%-P' AND part % 7 = 3) THEN 'failed' WHEN document_id LIKE '%-G' AND part % 13 = 4 THEN 'processing' ELSE 'completed' END AS st FROM docs0),
keyed AS (SELECT *, regexp_replace(lower(coalesce(ref, '')), '[^a-z0-9]', '', 'g') AS k FROM docs),
prime AS (SELECT * FROM keyed WHERE t = 'vendor_invoice' AND st = 'completed' QUALIFY row_number() OVER (PARTITION BY exception_id ORDER BY h DESC, document_id DESC) = 1)"""


def _link_sql(role: str) -> str:
    return f"""{_DOCS}, c AS (SELECT d.exception_id, d.document_id, i.k AS wanted, d.k AS stated, row_number() OVER (PARTITION BY d.exception_id ORDER BY (i.k <> '' AND d.k = i.k) DESC, d.h DESC, d.document_id DESC) AS r
FROM keyed d JOIN prime i ON i.exception_id = d.exception_id WHERE d.t = '{role}' AND d.st = 'completed')
SELECT exception_id, document_id, CASE WHEN wanted <> '' AND wanted = stated THEN NULL WHEN wanted <> '' THEN 'reference_mismatch' ELSE 'unverified_link' END AS warning FROM c WHERE r = 1"""


@query(_link_sql("purchase_order"))
def link_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.linked(documents(spark, sf_dir), "purchase_order").drop("extraction")


@query(_link_sql("goods_receipt_note"))
def link_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.linked(documents(spark, sf_dir), "goods_receipt_note").drop("extraction")


@query(f"""{_DOCS} SELECT e.exception_id, ty.t AS document_type, count(d.document_id) AS n FROM (SELECT DISTINCT exception_id FROM docs) e CROSS JOIN (VALUES ('vendor_invoice'), ('purchase_order'), ('goods_receipt_note'), ('quotation'), ('rejection_notice')) ty(t)
LEFT JOIN docs d ON d.exception_id = e.exception_id AND d.t = ty.t AND d.st = 'completed' GROUP BY ALL""")
def readiness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.readiness(documents(spark, sf_dir))


@query(f"{_DOCS} SELECT exception_id, count(*) AS total, count(*) FILTER (st = 'completed') AS completed, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'processing') AS processing, CAST(round_even(100.0::DOUBLE * count(*) FILTER (st <> 'processing') / count(*), 0) AS INTEGER) AS percent FROM docs GROUP BY exception_id")
def document_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.progress(documents(spark, sf_dir)).drop("queued")


@query(f"""{_DOCS}, g AS (SELECT exception_id, k AS reference_key, count(*) AS n, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM keyed GROUP BY ALL)
SELECT *, sum(CAST(reference_key <> '' AS INT)) OVER (PARTITION BY exception_id) > 1 AS mixed, CASE WHEN reference_key <> '' THEN CAST(row_number() OVER (PARTITION BY exception_id ORDER BY CAST(reference_key = '' AS INT), n DESC, reference_key) AS INTEGER) END AS place FROM g""")
def documents_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_reference(documents(spark, sf_dir)).withColumn("documents", F.array_join("documents", ","))


@query(f"""{_DOCS}, c AS (SELECT i.exception_id, count(DISTINCT p.document_id) > 0 AS po, count(DISTINCT g.document_id) > 0 AS grn, count(DISTINCT t.document_id) > 0 AS q FROM prime i LEFT JOIN keyed p ON p.exception_id = i.exception_id AND p.t = 'purchase_order' AND p.st = 'completed'
LEFT JOIN keyed g ON g.exception_id = i.exception_id AND g.t = 'goods_receipt_note' AND g.st = 'completed' LEFT JOIN keyed t ON t.exception_id = i.exception_id AND t.t = 'quotation' GROUP BY 1)
SELECT exception_id, po AS purchase_order_exists, grn AS goods_receipt_exists FROM c""")
def matching_input_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.matching_input(documents(spark, sf_dir)).select("exception_id", "purchase_order_exists", "goods_receipt_exists")


#: Comparisons of each case that can be evaluated, with their figures as text and their class.
LIVE = f"""{_IN}, f AS (SELECT *, unnest([
 {{'place': 0, 'f': 'vendor', 'live': po AND NOT conflict, 'bad': other_vendor, 'even': true, 'x': '', 'y': '', 'p': NULL::DOUBLE}}, {{'place': 1, 'f': 'po_number', 'live': po AND NOT conflict, 'bad': false, 'even': true, 'x': '', 'y': '', 'p': NULL}},
 {{'place': 2, 'f': 'unit_price', 'live': po AND NOT conflict, 'bad': price_out, 'even': coalesce(pv = 0, false), 'x': CAST(pp AS VARCHAR), 'y': CAST(up AS VARCHAR), 'p': round(pv, 2)}},
 {{'place': 3, 'f': 'quantity', 'live': po AND goods_receipt_exists AND NOT conflict, 'bad': qty_out, 'even': coalesce(qv = 0, false), 'x': CAST(rq AS VARCHAR), 'y': CAST(q AS VARCHAR), 'p': round(qv, 2)}},
 {{'place': 4, 'f': 'tax_arithmetic', 'live': po, 'bad': tax_out, 'even': coalesce(tp = 0, false), 'x': CAST((subtotal_c + tax_c) / 100.0::DOUBLE AS VARCHAR), 'y': CAST(amount AS VARCHAR), 'p': round(tp, 2)}}]) AS c FROM e),
live AS (SELECT exception_id, exception_type, po, goods_receipt_exists AS g, c.place AS place, c.f AS f, c.x AS x, c.y AS y, c.p AS p, c.bad AS bad, NOT c.even AND NOT c.bad AS inside FROM f WHERE c.live)"""
_SIDES = "(VALUES ('vendor', 'purchase_order'), ('vendor', 'vendor_invoice'), ('po_number', 'purchase_order'), ('po_number', 'vendor_invoice'), ('unit_price', 'purchase_order'), ('unit_price', 'vendor_invoice'), ('quantity', 'goods_receipt_note'), ('quantity', 'vendor_invoice')) s(f, d)"


def analysed_papers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Analysed cases and the documents on their file."""
    there = {"vendor_invoice": F.lit(True), "purchase_order": F.col("purchase_order_exists"), "goods_receipt_note": F.col("goods_receipt_exists")}
    roles = F.array_compact(F.array(*[F.when(has, F.lit(role)) for role, has in there.items()]))
    docs = ledger(spark, sf_dir).select("exception_id", F.explode(roles).alias("document_type")).withColumn("document_id", F.concat_ws("-", "exception_id", "document_type"))
    return M.evaluate(inputs(spark, sf_dir)), docs


@query(f"""{LIVE}, x AS (SELECT exception_id, exception_id || '-value-' || f AS a, 'doc-' || exception_id || '-' || s.d AS b, 'extracted_from' AS r FROM live JOIN {_SIDES} USING (f) UNION ALL
SELECT exception_id, exception_id || '-value-' || f, exception_id || '-rule-tolerance', 'evaluated_against' FROM live UNION ALL SELECT exception_id, exception_id || '-value-' || f, exception_id || '-finding-' || f, 'produces' FROM live WHERE bad OR inside UNION ALL
SELECT exception_id, exception_id || '-finding-' || f, exception_id || '-routing-' || t.t, 'routed_to' FROM live, (VALUES ('owner'), ('action')) t(t) WHERE bad OR inside)
SELECT exception_id, string_agg(a || ' ' || r || ' ' || b, chr(10) ORDER BY a || ' ' || r || ' ' || b) AS edges FROM x GROUP BY exception_id""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of each case's evidence graph."""
    analysed, docs = analysed_papers(spark, sf_dir)
    edges = V.graph_edges(analysed, docs)
    return edges.groupBy("exception_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "relationship", "target"))), "\n").alias("edges"))


@query(f"""WITH {LEDGER}, r AS (SELECT exception_id, CASE CAST(vendor_id AS INT) % 5 WHEN 0 THEN 'clerk' WHEN 1 THEN 'manager' WHEN 2 THEN 'director' WHEN 3 THEN 'visitor' ELSE '' END AS role, total_c / 100.0::DOUBLE AS amount, line_number % 5 = 0 AS involved, part % 6 = 0 AS moved FROM ledger)
SELECT exception_id, CASE WHEN moved THEN 'approved' WHEN involved THEN 'segregation_of_duties' WHEN role = 'visitor' THEN 'role_not_authorized' WHEN (role IN ('clerk', '') AND amount > 10000) OR (role = 'manager' AND amount > 50000) THEN 'approval_limit_exceeded' ELSE 'approved' END AS decision, role FROM r""")
def approval_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("clerk", "Manager", "director", "visitor", ""))), (F.col("vendor_id").cast("int") % 5 + 1).cast("int"))
    who = F.when(F.col("line_number") % 5 == 0, F.array(F.lit("ann"))).otherwise(F.array(F.lit("bob")))
    status = F.when(F.col("part") % 6 == 0, F.lit("awaiting_vendor")).when(F.col("part") % 6 == 1, F.lit("closed")).when(F.col("part") % 6 == 2, F.lit("resolved")).otherwise(F.lit("approved_with_exception"))
    requests = ledger(spark, sf_dir).select("exception_id", status.alias("new_status"), F.lit(" Ann").alias("actor"), role.alias("role"), (F.col("total_c") / F.lit(100.0)).alias("amount"), who.alias("participants"))
    limits = spark.createDataFrame([("clerk", 10000.0, 1), ("manager", 50000.0, 2), ("director", None, 3), ("Clerk ", 99.0, 4)], "role string, max_value double, place int")
    return V.approval(requests, limits, default_role="Clerk").select("exception_id", "decision", F.lower("role").alias("role"))


_PAIRS = f"""WITH {CASES}, p AS (SELECT exception_type AS expected, CASE WHEN CAST(split_part(exception_id, '-', 2) AS BIGINT) % 10 = 0 THEN 'no_exception' WHEN CAST(split_part(exception_id, '-', 2) AS BIGINT) % 17 = 0 THEN 'price_variance' ELSE exception_type END AS predicted, business_unit, workspace_id FROM cases)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long")
    said = F.when(order % 10 == 0, F.lit("no_exception")).when(order % 17 == 0, F.lit("price_variance")).otherwise(F.col("exception_type"))
    return cases(spark, sf_dir).select(F.col("exception_type").alias("expected"), said.alias("predicted"), "business_unit", "workspace_id")


@query(f"{_PAIRS} SELECT expected, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(decisions(spark, sf_dir))


@query(f"""{_PAIRS}, l AS (SELECT expected AS label FROM p UNION SELECT predicted FROM p), s AS (SELECT label, (SELECT count(*) FROM p WHERE expected = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE expected <> label AND predicted = label) AS fp, (SELECT count(*) FROM p WHERE expected = label AND predicted <> label) AS fn FROM l)
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 4) AS f1 FROM s""")
def per_type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_type(decisions(spark, sf_dir))


@query(f"""{_PAIRS}, c AS (SELECT count(*) AS n, count(*) FILTER (expected <> 'no_exception' AND predicted <> 'no_exception') AS caught, count(*) FILTER (expected <> 'no_exception' AND predicted = 'no_exception') AS missed, count(*) FILTER (expected = 'no_exception' AND predicted <> 'no_exception') AS false_alarms, count(*) FILTER (expected = predicted) AS exact FROM p)
SELECT *, round(caught / (caught + missed), 4) AS recall, round(caught / (caught + false_alarms), 4) AS precision, round(exact / n, 4) AS exact_share FROM c""")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detection(decisions(spark, sf_dir))


@query(f"{_PAIRS} SELECT workspace_id, count(*) AS n, count(*) FILTER (expected = predicted) AS correct, round(avg(CAST(expected = predicted AS DOUBLE)), 4) AS accuracy FROM p GROUP BY ALL")
def accuracy_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_condition(decisions(spark, sf_dir), "workspace_id")


@query(f"""{_PAIRS}, o AS (SELECT workspace_id AS layout, business_unit AS field, CASE WHEN expected = predicted THEN 'correct' WHEN predicted = 'no_exception' THEN 'missed' ELSE 'wrong' END AS outcome FROM p)
SELECT CASE WHEN grouping(layout) = 0 THEN 'layout' WHEN grouping(field) = 0 THEN 'field' ELSE 'all' END AS level, coalesce(layout, field, 'all') AS name, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong,
count(*) FILTER (outcome = 'missed') AS missed, count(*) FILTER (outcome = 'absent') AS absent, round(count(*) FILTER (outcome = 'correct') / count(*), 4) AS accuracy FROM o GROUP BY GROUPING SETS ((), (layout), (field))""")
def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("expected") == F.col("predicted"), F.lit("correct")).when(F.col("predicted") == "no_exception", F.lit("missed")).otherwise(F.lit("wrong"))
    return E.tally(decisions(spark, sf_dir).select(F.col("workspace_id").alias("layout"), F.col("business_unit").alias("field"), outcome.alias("outcome")))


@query(f"""WITH {CASES}, k AS (SELECT exception_id, financial_impact * CASE WHEN CAST(split_part(exception_id, '-', 2) AS BIGINT) % 9 = 0 THEN NULL WHEN CAST(split_part(exception_id, '-', 2) AS BIGINT) % 8 = 0 THEN 1.25::DOUBLE ELSE 1 END AS a, financial_impact AS c, CASE WHEN CAST(split_part(exception_id, '-', 2) AS BIGINT) % 50 = 0 THEN 'fault_injection' ELSE 'live' END AS kind FROM cases),
d AS (SELECT *, coalesce(abs(a - c), 0) > 0.01 AS o, CASE WHEN c <> 0 THEN round(abs(a - c) / abs(c) * 100, 4) END AS p, round(a - c, 2) AS diff FROM k)
SELECT count(*) FILTER (kind = 'live') AS checks, count(DISTINCT exception_id) FILTER (kind = 'live') AS cases, count(*) FILTER (kind = 'live' AND o) AS overrides, count(*) FILTER (kind = 'live' AND o AND p >= 1) AS significant, max(abs(diff)) FILTER (kind = 'live' AND o) AS largest,
count(*) FILTER (kind <> 'live') AS injected, round(count(*) FILTER (kind = 'live' AND o) / count(*) FILTER (kind = 'live'), 4) AS override_rate FROM d""")
def trust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.split_part("exception_id", F.lit("-"), F.lit(2)).cast("long")
    rows = cases(spark, sf_dir).select("exception_id", (F.col("financial_impact") * F.when(order % 9 == 0, F.lit(None)).when(order % 8 == 0, 1.25).otherwise(1.0)).alias("ai_value"), F.col("financial_impact").alias("computed_value"), F.when(order % 50 == 0, F.lit("fault_injection")).otherwise(F.lit("live")).alias("kind"))
    return E.trust_summary(E.trust_checks(rows)).drop("prevented")


@query(f"""WITH {CASES} SELECT exception_type, risk_level, count(*) AS n, arg_min(match_score, (created_at, exception_id)) AS match_score, arg_min(financial_impact, (created_at, exception_id)) AS financial_impact FROM cases WHERE exception_type <> 'no_exception' GROUP BY ALL ORDER BY n DESC, exception_type, risk_level LIMIT 8""")
def severity_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exemplars(cases(spark, sf_dir))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.sessions(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query(f"WITH {CASES} SELECT count(*) AS n, min(created_at) AS first, max(created_at) AS last FROM cases")
def load_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.verify(cases(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-03-01 10:20:30' WHEN c_custkey % 3 = 1 THEN NULL ELSE TIMESTAMP '2024-03-01 00:00:00' END AS parsed FROM customer")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-03-01T10:20:30Z")).when(F.col("c_custkey") % 3 == 1, F.lit("soon")).otherwise(F.lit("2024-03-01"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", parse_timestamp(text).cast("timestamp_ntz").alias("parsed"))
