"""Invoices as suppliers would print them, projected from orders, lines and customers: every kind of fault occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import tax_for
from ..schemas import CONFIDENCES, POLICY, RAW_MARK
from .stores import unbroadcast

#: The limit lies at about nine tenths of the totals.
PROJECTED_POLICY = {**POLICY, "amount_review_threshold": 400_000}
LATER = 1_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier master: all customers but every fiftieth."""
    c = read(spark, sf_dir, "customer").filter("c_custkey % 50 <> 0")
    return c.select(
        F.format_string("P-%06d", "c_custkey").alias("partner_code"), F.col("c_name").alias("name"), F.array(F.replace("c_name", F.lit("#"), F.lit(""))).alias("aliases"),
        F.format_string("T%013d", "c_custkey").alias("registration_no"), F.col("c_custkey").alias("ord"),
    )


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    q = F.col("l_quantity").cast("bigint")
    line = read(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order)).withColumn("q", q).withColumn("price", F.floor(F.floor("l_extendedprice") / q))
    rate = F.when(F.col("l_tax") >= F.lit(0.04), "10%").when(F.col("l_tax") > 0, "8%").otherwise("")
    line = line.withColumn("amount", F.col("q") * F.col("price") + F.when(F.col("l_orderkey") % 53 == 0, 1).otherwise(0))
    return line.select("l_orderkey", "l_partkey", "seq", "q", "price", "amount", ((F.col("l_linenumber") % 5 == 0) & (F.col("l_returnflag") == "R")).alias("minus"), rate.alias("rate"))


def yen(n: Column) -> Column:
    return F.concat(F.when(n < 0, "△").otherwise("¥"), F.format_number(F.abs(n), 0))


def invoice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its printed lines and totals."""
    lines = typed_lines(spark, sf_dir)
    signed = F.when(F.col("minus"), -F.col("amount")).otherwise(F.col("amount"))
    printed = F.struct(
        "seq", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description"), F.when(F.col("minus"), "").otherwise(F.col("q").cast("string")).alias("quantity_raw"),
        F.when(F.col("l_partkey") % 37 == 0, "").otherwise("pc").alias("unit"), F.format_number("price", 0).alias("unit_price_raw"), yen(signed).alias("amount_raw"), F.col("rate").alias("tax_rate_raw"),
    )
    part = lambda r: F.coalesce(F.sum(F.when(F.col("rate") == r, signed)), F.lit(0)).alias(f"at_{r.strip('%') or 0}")
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(printed)).alias("printed"), F.sum(signed).alias("sum"), part("10%"), part("8%"), part(""), F.array_sort(F.collect_set(F.when(F.col("rate") != "", F.col("rate")))).alias("rates"))
    only = lambda r: F.when((F.size("rates") == 1) & (F.get("rates", F.lit(0)) == r), F.col("at_0")).otherwise(0)
    base10 = F.col("at_10") + F.when(F.size("rates") == 0, F.col("at_0")).otherwise(only("10%"))
    base8 = F.col("at_8") + only("8%")
    grouped = grouped.withColumn("tax", tax_for(base10, F.lit("T10")) + tax_for(base8, F.lit("T08")))
    customers = unbroadcast(read(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    both = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(unbroadcast(grouped), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.withColumns({"sum": F.coalesce("sum", F.lit(0)), "tax": F.coalesce("tax", F.lit(0)), "issue": F.col("o_orderdate").cast("date")})


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival and the raw transcription of every order's invoice and of the copies sent later."""
    h, key = invoice_headers(spark, sf_dir), F.col("o_orderkey")
    every = lambda n, rest=0: key % n == rest
    name = F.when(F.col("o_custkey") % 50 == 0, F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 12)).when(every(2), F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("")))
    name = F.when(every(307), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)
    registration = F.when(every(3), "").otherwise(F.format_string("T%013d", F.col("o_custkey") + F.when(every(211), 1).otherwise(0)))
    due = F.when(every(97), F.date_sub("issue", 5)).otherwise(F.date_add("issue", 30))
    lines = F.transform(F.coalesce("printed", F.array().cast(h.schema["printed"].dataType)), lambda x: x.dropFields("seq"))
    mark = lambda text, pays: F.array(F.struct(F.lit(text).alias("text"), F.lit("margin").alias("location"), F.lit(pays).alias("affects_payment_details")))
    raw = h.select(
        key.alias("key"), "issue", key.alias("arrival"), name.alias("supplier_name"), registration.alias("supplier_registration_no"), F.concat(F.lit("INV-"), key.cast("string")).alias("invoice_number"),
        F.when(every(101), "n/a").otherwise(F.date_format(due, "yyyy/MM/dd")).alias("due_date_raw"),
        F.when(every(103), "").otherwise(yen(F.col("sum"))).alias("subtotal_raw"), yen(F.col("tax") + F.when(every(89), 100).otherwise(0)).alias("tax_amount_raw"),
        yen(F.col("sum") + F.col("tax") + F.when(every(40, 9), 1).otherwise(0)).alias("total_amount_raw"), F.lit("").alias("currency"), F.lit("").alias("bank_details_raw"), F.lit("").alias("notes"),
        lines.alias("lines"), F.transform(F.coalesce("rates", F.array().cast("array<string>")), lambda r: F.struct(r.alias("rate_raw"), F.lit("").alias("base_raw"), F.lit("").alias("tax_raw"))).alias("tax_breakdown"),
        F.when(every(59), mark("new account", True)).when(every(29), mark("received", False)).otherwise(F.array().cast(f"array<{RAW_MARK}>")).alias("handwritten_annotations"),
        F.struct(*[F.when(every(61), 0.4).otherwise(0.95).alias(c) if c == "due_date" else F.lit(0.95).alias(c) for c in CONFIDENCES]).alias("field_confidence"),
    )
    later = F.col("arrival") + LATER
    twins = raw.filter("key % 40 = 13").withColumns({"arrival": later, "invoice_number": F.lower("invoice_number")})
    again = raw.filter("key % 40 = 7").withColumns({"arrival": later, "invoice_number": F.concat("invoice_number", F.lit("-R2")), "issue": F.date_add("issue", (F.col("key") % 14).cast("int"))})
    both = raw.unionByName(twins).unionByName(again)
    era = F.concat(F.lit("平成"), (F.year("issue") - 1988).cast("string"), F.date_format("issue", "年M月d日"))
    shown = F.when(F.col("key") % 4 == 0, F.date_format("issue", "yyyy-MM-dd")).when(F.col("key") % 4 == 1, F.date_format("issue", "yyyy/MM/dd")).when(F.col("key") % 4 == 2, F.date_format("issue", "yyyy年M月d日")).otherwise(era)
    # every fifth has a text layer, and every seventh of those is smudged
    page = F.when(F.col("key") % 35 == 0, F.lit("smudged beyond recognition")).otherwise(F.translate(F.concat_ws(" ", "invoice_number", "subtotal_raw", "total_amount_raw"), "△", "-"))
    both = both.withColumn("text_layer", F.when(F.col("key") % 5 == 0, page))
    return both.withColumn("issue_date_raw", shown).drop("key", "issue")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_operations(read(spark, sf_dir, "events"))


def as_operations(events: DataFrame) -> DataFrame:
    """Events as calls of the reading model and as invoices in their states."""
    status = F.when(F.col("event_type") == "purchase", "POSTED").when(F.col("event_type") == "view", "EXTRACTED").when(F.col("event_type") == "click", "NEEDS_REVIEW").when(F.col("event_type") == "error", "EXTRACT_FAILED").otherwise("BLOCKED")
    return events.select(
        F.col("event_id").alias("arrival"), F.col("user_id").alias("document_id"), F.col("ts").alias("at"), status.alias("status"), (F.col("user_id") * 0.001).alias("cost_usd"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.col("value") * 10)).cast("int").alias("latency_ms"),
    )
