"""Comparing extracted invoices with the truth, and scoring models by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import unbroadcast

FIELDS = ("registration_no", "invoice_number", "issue_date", "due_date", "subtotal", "tax_amount", "total_amount")


def loose_key(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit("-"), F.lit("")))


def compare(truth: DataFrame, got: DataFrame) -> DataFrame:
    """One row per model and name of got (model, name, FIELDS, lines, error), against truth (name, FIELDS, lines):
    fields that agree, lines expected, got and matched by place on amount and tax code, and whether sums hold."""
    # of lines only what is compared goes through the join
    pair = lambda x: F.struct(x["amount"].alias("amount"), x["tax_code"].alias("tax_code"))
    expected = truth.select("name", *[F.col(c).alias(f"t_{c}") for c in FIELDS], F.transform("lines", pair).alias("t_lines"))
    both = got.select("model", "name", "error", *FIELDS, F.transform("lines", pair).alias("lines")).join(unbroadcast(expected), "name")
    agree = [loose_key(F.col(c)).eqNullSafe(loose_key(F.col(f"t_{c}"))) if c == "registration_no" else F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in FIELDS]
    matched = F.size(F.filter(F.zip_with("lines", "t_lines", lambda a, b: a.eqNullSafe(b) & a.isNotNull()), lambda m: m))
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["amount"])
    return both.select(
        "model", "name", "error", sum([a.cast("int") for a in agree[1:]], agree[0].cast("int")).alias("fields_ok"),
        F.size("t_lines").alias("lines_expected"), F.size("lines").alias("lines_got"), matched.alias("lines_matched"),
        ((matched == F.size("t_lines")) & (F.size("lines") == F.size("t_lines"))).alias("lines_exact"), F.coalesce(total == F.col("subtotal"), F.lit(False)).alias("reconciles"),
    )


def score(compared: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One row per model; calls that failed count as invoices but not in the accuracies."""
    good = F.col("error").isNull()
    n = F.sum(good.cast("long"))
    of = lambda c: F.coalesce(F.sum(F.when(good, c)), F.lit(0))
    out = compared.groupBy("model").agg(
        F.count(F.lit(1)).alias("invoices"), n.alias("read"),
        (of(F.col("fields_ok")) / (len(FIELDS) * F.greatest(n, F.lit(1)))).alias("field_accuracy"),
        (of(F.col("lines_matched")) / F.greatest(of(F.col("lines_expected")), F.lit(1))).alias("line_accuracy"),
        of(((F.col("fields_ok") == len(FIELDS)) & F.col("lines_exact")).cast("long")).alias("perfect"), of(F.col("reconciles").cast("long")).alias("reconciled"),
    )
    if costs is None:
        return out
    spent = costs.groupBy("model").agg(F.sum("cost_usd").cast("double").alias("cost_usd"), F.avg("latency_ms").alias("latency_ms"))
    return out.join(spent, "model", "left").withColumn("cost_per_invoice", F.col("cost_usd") / F.greatest("invoices", F.lit(1)))


def markdown(scored: DataFrame) -> str:
    """The score table, best field accuracy first (one row per model, so it is small)."""
    columns = ("model", "invoices", "field_accuracy", "line_accuracy", "perfect", "reconciled")
    rows = scored.orderBy(F.col("field_accuracy").desc(), "model").select(*columns).collect()
    shown = ["| " + " | ".join(f"{v:.1%}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *shown])
