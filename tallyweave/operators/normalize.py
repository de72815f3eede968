"""Raw transcriptions to typed invoices: a narrow projection, one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.udfs import nfkc
from ..schemas import CONFIDENCES, RAW_TEXTS


def breakdown_codes(breakdown: Column) -> Column:
    """Distinct known codes of the printed tax breakdown."""
    return F.array_distinct(F.filter(F.transform(breakdown, lambda b: S.tax_code(b["rate_raw"])), lambda c: c.isNotNull()))


def typed_lines(lines: Column) -> Column:
    """Lines with an amount and a description, each text of them read once; rate is the printed one, code what it
    stands for."""
    typed = F.transform(
        lines,
        lambda x: F.struct(
            S.clean(x["description"]).alias("description"),
            S.parse_amount(x["quantity_raw"]).alias("quantity"),
            S.clean(x["unit"]).alias("unit"),
            S.parse_amount(x["unit_price_raw"]).alias("unit_price"),
            S.parse_amount(x["amount_raw"]).alias("amount"),
            x["tax_rate_raw"].alias("rate"),
            F.when(x["tax_rate_raw"].isin("10%", "8%"), False).otherwise(F.btrim(S.wide(x["tax_rate_raw"]), F.lit(S.BLANKS)) == "").alias("blank"),
            S.tax_code(x["tax_rate_raw"]).alias("code"),
        ),
    )
    return F.filter(typed, lambda x: x["amount"].isNotNull() & (x["description"] != ""))


def normalize_lines(typed: Column, codes: Column) -> Column:
    """typed lines numbered anew in printed order. A line without a printed rate takes the one code of the breakdown,
    T10 if there is none, and UNKNOWN if there are several."""
    fallback = F.when(F.size(codes) == 1, F.element_at(codes, 1)).when(F.size(codes) == 0, F.lit("T10"))
    code = lambda x: F.coalesce(F.when(x["blank"], fallback).otherwise(x["code"]), F.lit("UNKNOWN"))
    return F.transform(typed, lambda x, i: F.struct((i + 1).alias("seq"), x["description"], x["quantity"], x["unit"], x["unit_price"], x["amount"], code(x).alias("tax_code")))


def unmapped_rates(typed: Column, breakdown: Column, codes: Column) -> Column:
    """Printed rates that no code stands for, of the breakdown and of lines that count, and a remark where a line
    without a rate could be either of several; sorted, each once."""
    odd = lambda x: x.isNotNull() & (S.clean(x) != "") & S.tax_code(x).isNull()
    rates = F.filter(F.transform(breakdown, lambda b: b["rate_raw"]), odd)
    of_lines = F.transform(F.filter(typed, lambda x: ~x["blank"] & x["code"].isNull()), lambda x: x["rate"])
    unclear = (F.size(codes) > 1) & F.exists(typed, lambda x: x["blank"])
    remark = F.when(unclear, F.array(F.lit("a line shows no rate and the breakdown has several"))).otherwise(F.array().cast("array<string>"))
    # what most invoices show, with nothing to remark
    plain = F.forall(breakdown, lambda b: b["rate_raw"].isin("10%", "8%")) & F.forall(typed, lambda x: ~x["blank"] & x["code"].isNotNull())
    return F.when(F.coalesce(plain, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(rates, of_lines, remark))))


def folded(value: Column, kind: T.DataType) -> Column:
    """value with NFKC applied to every text in it that the native fold does not cover; nulls stay."""
    if isinstance(kind, T.StringType):
        return F.when(~S.is_foldable(value), nfkc(value)).otherwise(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: folded(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[folded(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def fold(raw: DataFrame) -> DataFrame:
    """raw with NFKC applied to every text. An array goes through it only where one of its texts needs it."""
    texts = {c: folded(F.col(c), T.StringType()) for c in RAW_TEXTS if c in raw.columns}
    nested = {}
    for c in ("lines", "tax_breakdown", "handwritten_annotations"):
        if c in raw.columns:
            kind = raw.schema[c].dataType
            shown = F.transform(c, lambda x: F.concat_ws("", *[x[f.name] for f in kind.elementType if isinstance(f.dataType, T.StringType)]))
            nested[c] = F.when(S.bound(F.array_join(shown, ""), lambda text: ~S.is_foldable(text)), folded(F.col(c), kind)).otherwise(F.col(c))
    return raw.withColumns(texts | nested)


def normalize(raw: DataFrame) -> DataFrame:
    """Typed invoices from raw transcriptions (RAW_SCHEMA and any other columns, which are kept). All text is folded as
    NFKC does."""
    raw = fold(raw)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(raw.schema[c].dataType))
    lines, breakdown, marks = empty("lines"), empty("tax_breakdown"), empty("handwritten_annotations")
    payment = F.exists(marks, lambda m: F.coalesce(m["affects_payment_details"], F.lit(False)))
    currency = S.clean(F.col("currency"))
    rest = [c for c in raw.columns if c not in (*RAW_TEXTS, "lines", "tax_breakdown", "handwritten_annotations", "field_confidence")]
    # in a projection of their own: both are used more than once
    raw = raw.withColumn("_typed", typed_lines(lines)).withColumn("_codes", breakdown_codes(breakdown))
    typed, codes = F.col("_typed"), F.col("_codes")
    return raw.select(
        *rest,
        S.clean(F.col("supplier_name")).alias("supplier_name"),
        S.clean(F.col("supplier_registration_no")).alias("registration_no"),
        S.clean(F.col("invoice_number")).alias("invoice_number"),
        S.parse_date(F.col("issue_date_raw")).alias("issue_date"),
        S.parse_date(F.col("due_date_raw")).alias("due_date"),
        F.coalesce("issue_date_raw", F.lit("")).alias("issue_date_raw"),
        F.coalesce("due_date_raw", F.lit("")).alias("due_date_raw"),
        S.parse_amount(F.col("subtotal_raw")).alias("subtotal"),
        S.parse_amount(F.col("tax_amount_raw")).alias("tax_amount"),
        S.parse_amount(F.col("total_amount_raw")).alias("total_amount"),
        F.when(currency == "", "JPY").otherwise(currency).alias("currency"),
        S.clean(F.col("bank_details_raw")).alias("bank_details"),
        normalize_lines(typed, codes).alias("lines"),
        unmapped_rates(typed, breakdown, codes).alias("unmapped_tax_rates"),
        S.least_confidence(F.col("field_confidence"), CONFIDENCES).alias("min_confidence"),
        (F.size(marks) > 0).alias("has_handwriting"),
        payment.alias("handwriting_affects_payment"),
        S.handwriting_notes(marks).alias("handwriting_notes"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def read_counts() -> list[Column]:
    """What normalisation made of all its texts: rows and lines, and by column the values that are missing or unknown."""
    unread = [F.count_if(F.col(c).isNull()).alias(c) for c in ("issue_date", "due_date", "subtotal", "tax_amount", "total_amount", "min_confidence")]
    blank = [F.count_if(F.col(c) == "").alias(c) for c in ("supplier_name", "registration_no", "invoice_number", "bank_details", "issue_date_raw", "due_date_raw", "notes", "handwriting_notes")]
    of_lines = lambda name, test: F.sum(F.size(F.filter("lines", test))).alias(name)
    return [
        F.count(F.lit(1)).alias("rows"), *unread, *blank, F.count_if(F.col("currency") != "JPY").alias("foreign"), F.count_if("has_handwriting").alias("marked"),
        F.count_if("handwriting_affects_payment").alias("altered"), F.sum(F.size("unmapped_tax_rates")).alias("unmapped"), F.sum(F.size("lines")).alias("lines"),
        of_lines("unpriced", lambda x: x["unit_price"].isNull()), of_lines("uncounted", lambda x: x["quantity"].isNull()), of_lines("untaxed", lambda x: x["tax_code"] == "UNKNOWN"),
    ]
