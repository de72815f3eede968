"""Queue, details, operating figures and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEVERITIES
from .ledger import first_success, lookup

# The queue's order, and the names states are shown by.
RANKS = {"BLOCKED": 0, "NEEDS_REVIEW": 1, "POST_FAILED": 2, "EXTRACT_FAILED": 3, "EXTRACTED": 4, "PENDING": 5, "POSTED": 6, "REJECTED": 7}
LABELS = {"POSTED": "registered", "NEEDS_REVIEW": "needs review", "BLOCKED": "blocked", "POST_FAILED": "registration failed", "EXTRACT_FAILED": "reading failed", "REJECTED": "rejected", "EXTRACTED": "clean", "PENDING": "waiting"}
#: Titles of checks for people; others are shown by their message.
TITLES = {
    "extraction.lines_present": "No lines were read", "fields.invoice_number": "No invoice number", "arithmetic.line_sum": "Lines do not add up", "arithmetic.tax_per_code": "Tax is wrong",
    "arithmetic.total": "Total is wrong", "arithmetic.line_product": "Quantity and price differ", "partner.resolved": "Unknown supplier", "partner.agreement": "Supplier details conflict",
    "partner.match_quality": "Supplier is uncertain", "dedupe.exact": "Already received", "dedupe.near": "Possibly received before", "dates.parsed": "Dates unreadable", "dates.order": "Due before issue",
    "tax_code.known": "Unknown tax rate", "fields.units_present": "Units missing", "grounding.values_present": "Values not on the page", "confidence.floor": "Low confidence",
    "handwriting.detected": "Handwriting", "handwriting.on_payment_details": "Payment details altered", "amount.threshold": "Over the limit", "accounting.accepted": "Refused by the ledger",
}


def first_reason(checks: Column, status: Column, notes: Column) -> Column:
    """The first failed blocker or error in ladder order; else the notes of a row that is stuck."""
    first = F.get(F.filter(checks, lambda c: ~c["passed"] & c["severity"].isin("BLOCKER", "ERROR")), F.lit(0))
    return F.coalesce(first["message"], F.when(status.isin("BLOCKED", "POST_FAILED", "EXTRACT_FAILED"), notes))


def rank(status: Column) -> Column:
    return F.coalesce(lookup(RANKS, status), F.lit(9))


def queue(invoices: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One row per invoice for the work queue, with rank to sort by (then arrival), and with the ledger's number of the
    first successful posting where postings are given."""
    if postings is not None:
        first = first_success(postings).withColumnRenamed("accounting_id", "_id")
        rows = queue(invoices).join(first, "arrival", "left")
        return rows.withColumnRenamed("_id", "accounting_id")
    failed = F.size(F.filter("checks", lambda c: ~c["passed"]))
    return invoices.select(
        "arrival", "status", rank(F.col("status")).alias("rank"), "supplier_name", "partner_code", "invoice_number", "issue_date", "due_date", "total_amount",
        first_reason(F.col("checks"), F.col("status"), F.col("notes")).alias("reason"), failed.alias("failed_checks"),
    )


def sections(invoices: DataFrame) -> DataFrame:
    """Sizes of the queue's sections in display order; empty ones are left out."""
    return invoices.groupBy("status").agg(F.count(F.lit(1)).alias("invoices")).withColumn("rank", rank(F.col("status")))


def detail(invoices: DataFrame, arrival: int | None = None) -> DataFrame:
    """Invoices with nested lines and checks, failed checks by severity; one only, if arrival is given."""
    rows = invoices if arrival is None else invoices.filter(F.col("arrival") == arrival)
    titled = F.transform("checks", lambda c: F.struct(c["name"].alias("name"), c["severity"].alias("severity"), c["passed"].alias("passed"), F.coalesce(lookup(TITLES, c["name"]), c["message"]).alias("title"), c["message"].alias("message")))
    ordered = F.array_sort(F.transform(titled, lambda c, i: F.struct(c["passed"].alias("passed"), F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c["severity"]).alias("rank"), i.alias("pos"), c.alias("check"))))
    return rows.withColumn("checks", F.transform(ordered, lambda x: x["check"]))


def assemble(headers: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """headers with each child table's rows as an array in the order of its column, empty where it has none."""
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c not in (key, order)]
        grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
        headers = headers.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return headers


def status_counts(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("status").agg(F.count(F.lit(1)).alias("invoices"))


def status_report(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy(F.coalesce(lookup(LABELS, F.col("status")), F.col("status")).alias("label")).agg(F.count(F.lit(1)).alias("invoices"))


def cost_stats(extractions: DataFrame) -> DataFrame:
    """Calls, documents, costs and mean latency; failed calls count with the latency they have."""
    total = F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double")
    return extractions.agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("document_id").alias("documents"), F.round(total, 6).alias("cost_usd"),
        F.round(F.try_divide(total, F.count(F.lit(1))), 6).alias("cost_per_call"), F.floor(F.avg("latency_ms")).cast("int").alias("latency_ms"),
    )


def upper_median(extractions: DataFrame) -> DataFrame:
    """The upper middle of the latencies that are not 0, found from counts of each value rather than one sorted list."""
    return median_of_counts(extractions.filter("latency_ms <> 0").groupBy("latency_ms").agg(F.count(F.lit(1)).alias("n")))


def median_of_counts(counts: DataFrame) -> DataFrame:
    """latency_median of latencies counted (latency_ms, n): one short row a value."""
    upto = F.sum("n").over(Window.orderBy("latency_ms"))
    placed = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return placed.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("latency_ms").alias("latency_median"))


def posted_split(invoices: DataFrame, events: DataFrame) -> DataFrame:
    """Registered invoices that a reviewer approved, and the rest."""
    approved = events.filter("action = 'approve'").select("arrival").distinct().withColumn("approved", F.lit(1))
    posted = invoices.filter("status = 'POSTED'").join(approved, "arrival", "left")
    reviewed = F.coalesce(F.sum("approved"), F.lit(0))
    return posted.agg(reviewed.alias("after_review"), (F.count(F.lit(1)) - reviewed).alias("automatic"))


def auto_pass(invoices: DataFrame, events: DataFrame) -> DataFrame:
    """The share of all invoices registered without review, to four places, and as a whole percentage."""
    both = posted_split(invoices, events).withColumn("_one", F.lit(1)).join(invoices.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1)), "_one").drop("_one")
    rate = F.bround(F.col("automatic") / F.greatest("total", F.lit(1)), 4)
    return both.withColumn("auto_pass_rate", rate).withColumn("auto_pass_pct", F.round(rate * 100).cast("int"))


def ledger_drift(registered: int, counted: int) -> int:
    return registered - counted


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once: empty where the uniqueness rule holds."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
