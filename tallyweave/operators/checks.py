"""The check ladder: one expression per check, gathered in an array on the invoice row, so no check shuffles.

A check is (name, severity, passed, message, detail); conditional ones are left out where they do not apply. Further
checks can be added to LADDER.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import folded, tax_for
from ..schemas import CHECK, POLICY, TAX_RATES

Policy = dict


def line_sum() -> Column:
    return F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["amount"])


def base_of(code: str) -> Column:
    return F.aggregate(F.filter("lines", lambda x: x["tax_code"] == code), F.lit(0).cast("bigint"), lambda a, x: a + x["amount"])


def has_code(code: str) -> Column:
    return F.exists("lines", lambda x: x["tax_code"] == code)


def tax_by_code() -> Column:
    """Map of each known code that occurs to the floored tax of its lines."""
    entries = [F.when(has_code(c), F.struct(F.lit(c).alias("key"), tax_for(base_of(c), F.lit(c)).alias("value"))) for c in TAX_RATES]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def expected_tax() -> Column:
    taxes = [F.when(has_code(c), tax_for(base_of(c), F.lit(c))).otherwise(F.lit(0)) for c in TAX_RATES]
    return sum(taxes[1:], taxes[0]).cast("bigint")


def expected_total() -> Column:
    return line_sum() + expected_tax()


def line_mismatches() -> Column:
    wrong = F.filter("lines", lambda x: x["quantity"].isNotNull() & x["unit_price"].isNotNull() & (x["quantity"] * x["unit_price"] != x["amount"]))
    return F.transform(wrong, lambda x: F.struct(x["seq"].alias("seq"), x["amount"].alias("amount"), (x["quantity"] * x["unit_price"]).alias("expected")))


def unknown_codes() -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: x["tax_code"]), lambda c: ~c.isin(*TAX_RATES))))


def missing_units() -> Column:
    return F.transform(F.filter("lines", lambda x: F.trim(F.coalesce(x["unit"], F.lit(""))) == ""), lambda x: x["seq"])


def ungrounded() -> Column:
    """Names of printed values that the text layer does not show; blank values are not looked for."""
    page = folded(F.col("text_layer"))
    shown = {"invoice_number": F.col("invoice_number"), "subtotal": F.format_number("subtotal", 0), "total_amount": F.format_number("total_amount", 0)}
    missing = [F.when((folded(v) != "") & (F.instr(page, folded(v)) == 0), F.lit(k)) for k, v in shown.items()]
    return F.filter(F.array(*missing), lambda x: x.isNotNull())


def money(c: Column) -> Column:
    return F.format_number(c, 0)


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def check(name: str, severity: str, passed: Column, good: Column, bad: Column, detail: Column | None = None) -> Column:
    passed = F.coalesce(passed, F.lit(False))
    return F.struct(
        F.lit(name).alias("name"), F.lit(severity).alias("severity"), passed.alias("passed"),
        F.when(passed, good).otherwise(bad).alias("message"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def _ladder(policy: Policy) -> list[Column]:
    some, number = F.size("lines") > 0, F.trim(F.coalesce("invoice_number", F.lit("")))
    subtotal, tax, total = F.col("subtotal"), F.col("tax_amount"), F.col("total_amount")
    dated = F.col("issue_date").isNotNull() & F.col("due_date").isNotNull()
    floor, limit = policy["confidence_floor"], policy["amount_review_threshold"]
    marked, pays = F.col("has_handwriting"), F.col("handwriting_affects_payment")
    layer = F.trim(F.coalesce("text_layer", F.lit(""))) != ""
    rates = F.concat(F.col("_unknown"), F.col("unmapped_tax_rates"))
    return [
        check("extraction.lines_present", "BLOCKER", some, say(F.size("lines"), " lines were read"), say("no lines were read"), F.to_json(F.struct(F.size("lines").alias("line_count")))),
        check("fields.invoice_number", "ERROR", number != "", say("invoice number ", F.col("invoice_number")), say("the invoice number is missing")),
        check("arithmetic.line_sum", "ERROR", some & (F.col("_sum") == subtotal), say("the lines add up to ", money(subtotal)), say("the lines add up to ", money(F.col("_sum")), ", the subtotal shows ", money(subtotal))),
        check("arithmetic.tax_per_code", "ERROR", some & (F.col("_tax") == tax), say("the tax is ", money(tax)), say("the tax by code is ", money(F.col("_tax")), ", the invoice shows ", money(tax))),
        check("arithmetic.total", "ERROR", some & subtotal.isNotNull() & tax.isNotNull() & ((F.col("_sum") + F.col("_tax")) == total), say("the total is ", money(total)), say("the total should be ", money((F.col("_sum") + F.col("_tax"))), ", the invoice shows ", money(total))),
        check("arithmetic.line_product", "WARN", F.size(F.col("_mismatches")) == 0, say("quantity times price gives every amount"), say("quantity times price differs on ", F.size(F.col("_mismatches")), " lines"), F.to_json(F.col("_mismatches"))),
        check("partner.resolved", "BLOCKER", F.col("partner_code").isNotNull(), say("supplier ", F.col("partner_code")), say("supplier ", F.col("supplier_name"), " is not in the master")),
        check("partner.agreement", "ERROR", F.col("agreement"), say("number and name agree"), say("the number means ", F.col("by_registration"), ", the name ", F.col("by_name"))),
        check("partner.match_quality", "ERROR", F.col("method") != "FUZZY_NAME", say("matched by ", F.col("method")), say("matched by similarity of names only")),
        check("dedupe.exact", "BLOCKER", F.col("dup_exact").isNull(), say("no such invoice is known"), say("the same invoice is known as ", F.col("dup_exact"))),
        check("dedupe.near", "ERROR", F.size("dup_near") == 0, say("no similar invoice is known"), say(F.size("dup_near"), " similar invoices are known"), F.to_json(F.col("dup_near"))),
        check("dates.parsed", "ERROR", dated, say("dates ", F.col("issue_date"), " and ", F.col("due_date")), say("a date cannot be read")),
        F.when(dated, check("dates.order", "ERROR", F.col("due_date") >= F.col("issue_date"), say("due on or after issue"), say("due ", F.col("due_date"), " before issue ", F.col("issue_date")))),
        check("tax_code.known", "ERROR", F.size(rates) == 0, say("every line has a known tax code"), say("unknown tax rates: ", F.array_join(rates, ", "))),
        check("fields.units_present", "WARN", F.size(missing_units()) == 0, say("every line has a unit"), say("no unit on lines ", F.array_join(missing_units().cast("array<string>"), ", "))),
        F.when(layer, check("grounding.values_present", "WARN", F.size(F.col("_unseen")) == 0, say("the text shows the key values"), say("the text does not show ", F.array_join(F.col("_unseen"), ", ")))),
        check("confidence.floor", "ERROR", F.col("min_confidence") >= floor, say("confidence ", F.format_string("%.2f", "min_confidence")), say("confidence ", F.format_string("%.2f", "min_confidence"), f" is under {floor:.2f}")),
        check("handwriting.detected", "WARN", ~marked | pays, say("no other handwriting"), say("handwriting: ", F.col("handwriting_notes")), F.col("handwriting_notes")),
        check("handwriting.on_payment_details", "ERROR", ~pays, say("no handwriting on payment details"), say("handwriting changes payment details")),
        F.when((F.lit(limit) != 0) & total.isNotNull(), check("amount.threshold", "ERROR", total <= limit, say("the total is within the limit"), say("the total ", money(total), f" is over {limit:,}"))),
    ]


LADDER: list[Callable[[Policy], list[Column]]] = [_ladder]
NAMES = (
    "extraction.lines_present", "fields.invoice_number", "arithmetic.line_sum", "arithmetic.tax_per_code", "arithmetic.total", "arithmetic.line_product", "partner.resolved", "partner.agreement",
    "partner.match_quality", "dedupe.exact", "dedupe.near", "dates.parsed", "dates.order", "tax_code.known", "fields.units_present", "grounding.values_present", "confidence.floor",
    "handwriting.detected", "handwriting.on_payment_details", "amount.threshold", "accounting.accepted",
)


def run_checks(invoices: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """invoices (normalised, resolved, with duplicates; text_layer optional) with checks, status and reason."""
    if "text_layer" not in invoices.columns:
        invoices = invoices.withColumn("text_layer", F.lit(None).cast("string"))
    # worked out once a row, before the checks that share them
    shown = F.trim(F.coalesce("text_layer", F.lit(""))) != ""
    facts = {"_sum": line_sum(), "_tax": expected_tax(), "_mismatches": line_mismatches(), "_unknown": unknown_codes(), "_unseen": F.when(shown, ungrounded())}
    invoices = invoices.withColumns(facts)
    made = {f"_check_{i}": c.cast(CHECK) for i, c in enumerate(c for part in LADDER for c in part(policy))}
    # each a column of its own, which the array, the state and the reason take
    each = invoices.withColumns(made).drop(*facts)
    fails = lambda name, severity: F.coalesce(~F.col(name)["passed"] & (F.col(name)["severity"] == severity), F.lit(False))
    first = lambda severity, value: F.coalesce(*[F.when(fails(n, severity), F.struct(value(F.col(n)).alias("x"))) for n in made])["x"]
    some = lambda severity: first(severity, lambda c: F.lit(True)).isNotNull()
    status = F.when(some("BLOCKER"), "BLOCKED").when(some("ERROR"), "NEEDS_REVIEW").otherwise("EXTRACTED")
    why = F.coalesce(*[first(s, lambda c: c["message"]) for s in ("BLOCKER", "ERROR")])
    return each.withColumns({"checks": F.filter(F.array(*made), lambda c: c.isNotNull()), "status": status, "reason": why}).drop(*made)


def failed(checks: Column, *severities: str) -> Column:
    return F.filter(checks, lambda c: ~c["passed"] & c["severity"].isin(*severities))


def long_checks(checked: DataFrame) -> DataFrame:
    return checked.select("arrival", F.posexplode("checks").alias("pos", "c")).select("arrival", "pos", "c.*")


def failed_sorted(checks: Column) -> Column:
    """Names of failed checks by severity, then place in the ladder."""
    return F.flatten(F.array(*[F.transform(failed(checks, s), lambda c: c["name"]) for s in ("BLOCKER", "ERROR", "WARN", "INFO")]))
