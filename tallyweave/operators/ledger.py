"""Payloads, the ledger's own validation, admission of a batch and what follows from its answers.

Admission is a pure function of the batch and the ledger table: no task has side effects, so retries are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iso_date
from ..schemas import CHECK, FALLBACK_UNIT, TAX_RATES
from ..sources.stores import store, unbroadcast
from .checks import expected_tax, line_sum, unknown_codes

# The ledger's error codes with their response status, and the state that each leads to.
RESPONSES = {"UNAUTHORIZED": 401, "PARTNER_NOT_FOUND": 400, "UNKNOWN_TAX_CODE": 400, "DUE_DATE_BEFORE_ISSUE_DATE": 400, "DUPLICATE_INVOICE": 409, "AMOUNT_MISMATCH": 422, "VALIDATION_ERROR": 422, "NOT_FOUND": 404}
STATES = {"DUPLICATE_INVOICE": "BLOCKED", "PARTNER_NOT_FOUND": "BLOCKED", "AMOUNT_MISMATCH": "NEEDS_REVIEW", "UNKNOWN_TAX_CODE": "NEEDS_REVIEW", "DUE_DATE_BEFORE_ISSUE_DATE": "NEEDS_REVIEW", "VALIDATION_ERROR": "NEEDS_REVIEW"}
KEY = ["partner_code", "invoice_number"]
#: Buckets of suppliers and numbers that a stored ledger is written in.
BUCKETS = 256
#: Ranges of arrivals that are numbered side by side, at least.
SEQUENCE_PARTITIONS = 64


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def build_payload(invoices: DataFrame) -> DataFrame:
    """arrival, the payload's columns and gap, which names what is missing. Amounts are computed from the lines."""
    gap = F.when(F.coalesce("partner_code", F.lit("")) == "", "partner_code").when(F.size("lines") == 0, "lines").when(F.col("issue_date").isNull() | F.col("due_date").isNull(), "dates")
    lines = F.transform(
        "lines",
        lambda x: F.struct(x["description"].alias("description"), x["quantity"].alias("quantity"), F.when(x["unit"] == "", FALLBACK_UNIT).otherwise(x["unit"]).alias("unit"), x["unit_price"].alias("unit_price"), x["amount"].alias("amount"), x["tax_code"].alias("tax_code")),
    )
    return invoices.select(
        "arrival", gap.alias("gap"), "partner_code", F.coalesce("invoice_number", F.lit("")).alias("invoice_number"),
        F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"), F.date_format("due_date", "yyyy-MM-dd").alias("due_date"), F.lit("JPY").alias("currency"), lines.alias("lines"),
        line_sum().alias("subtotal"), expected_tax().alias("tax_amount"), (line_sum() + expected_tax()).alias("total_amount"),
    )


def payload_json(payloads: DataFrame) -> DataFrame:
    names = [c for c in payloads.columns if c not in ("arrival", "gap")]
    return payloads.select("arrival", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("body"))


def shape_error() -> Column:
    """The first fault of a request's shape, or null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = [F.when(blank(c), f"{c} must be text") for c in (*KEY, "issue_date", "due_date")]
    for c in ("issue_date", "due_date"):
        tests += [F.when(~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), f"{c} must be YYYY-MM-DD"), F.when(iso_date(F.col(c)).isNull(), f"{c} is no real date")]
    tests.append(F.when(F.coalesce("currency", F.lit("JPY")) != "JPY", "only JPY is taken"))
    tests += [F.when(F.col(c).isNull(), f"{c} must be whole") for c in ("subtotal", "tax_amount", "total_amount")]
    tests.append(F.when(F.coalesce(F.size("lines"), F.lit(0)) <= 0, "there must be a line"))
    fault = lambda x: F.when(F.coalesce(x["description"], F.lit("")) == "", "description").when(F.coalesce(x["unit"], F.lit("")) == "", "unit").when(x["amount"].isNull(), "amount").when(x["tax_code"].isNull(), "tax_code")
    faults = F.filter(F.transform("lines", lambda x, i: F.concat(F.lit("line "), i.cast("string"), F.lit(": "), fault(x))), lambda m: m.isNotNull())
    return F.coalesce(*tests, F.get(faults, F.lit(0)))


def rule_error() -> Column:
    """The first broken rule of a well-formed request from a known partner, or null."""
    expected = {"subtotal": line_sum(), "tax_amount": expected_tax(), "total_amount": line_sum() + expected_tax()}
    wrong = F.coalesce(*[F.when(F.col(c) != v, F.concat(F.lit(f"{c}: expected "), v.cast("string"), F.lit(", received "), F.col(c).cast("string"))) for c, v in expected.items()])
    fault = lambda code, text: F.struct(F.lit(code).alias("code"), text.alias("message"))
    return (
        F.when(F.size(unknown_codes()) > 0, fault("UNKNOWN_TAX_CODE", F.array_join(unknown_codes(), ", ")))
        .when(iso_date(F.col("due_date")) < iso_date(F.col("issue_date")), fault("DUE_DATE_BEFORE_ISSUE_DATE", F.col("due_date")))
        .when(wrong.isNotNull(), fault("AMOUNT_MISMATCH", wrong))
    )


def judge(requests: DataFrame, partners: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """requests with error_code and error_message as the ledger would answer them in order of arrival.

    Shape comes first, then duplicates of what the ledger holds or an earlier request registers, then the rules; the
    first request of a key that breaks none is the one registered.
    """
    known = unbroadcast(partners.select("partner_code").distinct().withColumn("known", F.lit(True)))
    # what a request's own lines tell is worked out before the joins, which need not carry them then
    rows = requests.withColumn("shape", shape_error()).withColumn("rule", F.when(F.col("shape").isNull(), rule_error())).join(known, "partner_code", "left")
    unknown = F.struct(F.lit("PARTNER_NOT_FOUND").alias("code"), F.col("partner_code").alias("message"))
    rows = rows.withColumn("rule", F.when(F.col("shape").isNull() & F.col("known").isNull(), unknown).otherwise(F.col("rule")))
    if ledger is None:
        rows = rows.withColumn("held", F.lit(False))
    else:
        rows = rows.join(unbroadcast(ledger.select(*KEY).distinct().withColumn("held", F.lit(True))), KEY, "left").withColumn("held", F.coalesce("held", F.lit(False)))
    valid = F.col("shape").isNull() & F.col("rule").isNull() & ~F.col("held")
    winners = rows.filter(valid).groupBy(*KEY).agg(F.min("arrival").alias("winner"))
    rows = rows.join(unbroadcast(winners), KEY, "left")
    duplicate = F.col("held") | (F.col("arrival") > F.col("winner"))
    code = F.when(F.col("shape").isNotNull(), "VALIDATION_ERROR").when(duplicate, "DUPLICATE_INVOICE").otherwise(F.col("rule.code"))
    message = F.when(F.col("shape").isNotNull(), F.col("shape")).when(duplicate, F.col("invoice_number")).otherwise(F.col("rule.message"))
    return rows.withColumn("error_code", code).withColumn("error_message", message).drop("shape", "known", "rule", "held", "winner")


def numbered(registered: DataFrame, start: int = 0) -> DataFrame:
    """registered with n, dense from start + 1 in order of arrival, without a global sort in one task: rows are
    range-partitioned by arrival, and each partition is numbered from the count of those before it. Which row lies in
    which partition is written down once: bounds are sampled, so a stage run again could deal rows otherwise."""
    parts = max(SEQUENCE_PARTITIONS, int(registered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = store(registered.repartitionByRange(parts, "arrival").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_skip", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("arrival"))
    return ranged.join(F.broadcast(before.select("_part", "_skip")), "_part").withColumn("n", (F.col("_skip") + place + start).cast("bigint")).drop("_part", "_skip")


def admit(requests: DataFrame, partners: DataFrame, ledger: DataFrame | None = None, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, records): every request with its error or accounting_id, and the new ledger records. Numbers go on
    from start, which is what the ledger holds where it is not told."""
    # judged once, without the lines: whole requests are dealt once, when all is known that is put to them
    judged = store(judge(requests, partners, ledger).select("arrival", "error_code", "error_message"))
    if start is None:
        start = ledger.count() if ledger is not None else 0
    ids = numbered(judged.filter("error_code is null").select("arrival"), start).select("arrival", F.format_string("ACC-%04d", "n").alias("accounting_id"))
    answers = requests.join(unbroadcast(judged.join(unbroadcast(ids), "arrival", "left")), "arrival").withColumn("response_status", F.coalesce(lookup(RESPONSES, F.col("error_code")), F.lit(201)))
    return answers, records_of(answers)


def bucket(partner: Column | str = KEY[0], number: Column | str = KEY[1]) -> Column:
    return F.pmod(F.xxhash64(partner, number), F.lit(BUCKETS)).cast("int")


def touched(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Those buckets of held (a stored ledger, partitioned by bucket) that requests have keys in: the others' files are
    not opened."""
    numbers = [r[0] for r in requests.select(bucket()).distinct().collect()]  # BUCKETS numbers at most
    return held.filter(F.col("bucket").isin(numbers)).select(*KEY)


def records_of(answers: DataFrame) -> DataFrame:
    columns = ["accounting_id", *KEY, "issue_date", "due_date", "subtotal", "tax_amount", "total_amount", F.size("lines").alias("line_count")]
    return answers.filter("error_code is null").select(*columns)


def status_after(code: Column) -> Column:
    return F.when(code.isNull(), "POSTED").otherwise(F.coalesce(lookup(STATES, code), F.lit("POST_FAILED")))


def refusal_check(checks: Column, code: Column, message: Column) -> Column:
    """checks with the ledger's refusal in place of any earlier one."""
    severity = F.when(code.isin("DUPLICATE_INVOICE", "PARTNER_NOT_FOUND"), "BLOCKER").otherwise("ERROR")
    text = F.concat(F.lit("the ledger refused it: "), code, F.lit(" "), F.coalesce(message, F.lit("")))
    new = F.struct(F.lit("accounting.accepted").alias("name"), severity.alias("severity"), F.lit(False).alias("passed"), text.alias("message"), message.alias("detail")).cast(CHECK)
    kept = F.filter(checks, lambda c: c["name"] != "accounting.accepted")
    return F.when(code.isNull(), kept).otherwise(F.array_append(kept, new))


def postings(answers: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """One posting row per answer, with its attempt number after those of earlier (arrival)."""
    out = answers.select("arrival", "response_status", "accounting_id", "error_code", F.col("error_code").isNull().alias("succeeded"))
    if earlier is None:
        return out.withColumn("attempt", F.lit(1))
    tried = earlier.groupBy("arrival").agg(F.count(F.lit(1)).alias("tried"))
    return out.join(tried, "arrival", "left").withColumn("attempt", (F.coalesce("tried", F.lit(0)) + 1).cast("int")).drop("tried")


def first_success(posted: DataFrame) -> DataFrame:
    """arrival and accounting_id of each invoice's first successful posting."""
    return posted.filter("succeeded").groupBy("arrival").agg(F.min_by("accounting_id", "attempt").alias("accounting_id"))


def confirm(pending: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sends without an answer: POSTED if the ledger holds exactly that supplier and number, else POST_FAILED."""
    held = ledger.groupBy(*KEY).agg(F.min("accounting_id").alias("accounting_id"))
    both = pending.join(held, KEY, "left")
    return both.withColumn("status", F.when(F.col("accounting_id").isNotNull(), "POSTED").otherwise("POST_FAILED")).withColumn("error_code", F.when(F.col("accounting_id").isNull(), "TRANSPORT_ERROR"))


def drift(posted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keys that only one side holds."""
    ours, theirs = (d.select(*KEY).distinct().withColumn(n, F.lit(True)) for d, n in ((posted, "ours"), (ledger, "theirs")))
    return ours.join(theirs, KEY, "full_outer").filter("ours is null or theirs is null").select(*KEY, F.when(F.col("ours").isNull(), "ledger only").otherwise("local only").alias("side"))


def known_codes() -> tuple[str, ...]:
    return tuple(TAX_RATES)
