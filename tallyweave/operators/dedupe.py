"""Exact and near duplicates of an invoice among those that count as existing.

Both joins are equi joins on the supplier and a value (the number, or the total and a stretch of days), so they shuffle
on a selective key and never meet all invoices of a supplier, nor all of a monthly fixed total, with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import number_key
from ..schemas import ACTIVE

FACTS = ("arrival", "partner_code", "invoice_number", "total_amount", "issue_date")


def _sides(invoices: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    if "status" in existing.columns:
        existing = existing.filter(F.col("status").isin(*ACTIVE))
    this = invoices.select(*FACTS).filter("partner_code is not null").withColumn("key", number_key(F.col("invoice_number")))
    that = existing.select(*[F.col(c).alias(f"o_{c}") for c in FACTS]).filter("o_partner_code is not null").withColumn("o_key", number_key(F.col("o_invoice_number")))
    return this, that


def _near(this: DataFrame, that: DataFrame, order: Column, window_days: int) -> DataFrame:
    # days fall in stretches one longer than the window, so near ones lie in the same or in neighbouring stretches
    stretch = lambda c: F.floor(F.unix_date(F.col(c)) / (window_days + 1))
    this = this.withColumn("stretch", F.explode(F.sequence(stretch("issue_date") - 1, stretch("issue_date") + 1)))
    that = that.withColumn("o_stretch", stretch("o_issue_date"))
    same = (F.col("partner_code") == F.col("o_partner_code")) & (F.col("total_amount") == F.col("o_total_amount")) & (F.col("stretch") == F.col("o_stretch"))
    close = F.abs(F.date_diff("issue_date", "o_issue_date")) <= window_days
    twin = F.coalesce((F.col("key") != "") & (F.col("key") == F.col("o_key")), F.lit(False))
    return this.join(that, same & close & order).filter(~twin).select("arrival", F.col("o_arrival").alias("other"))


def _order(scope: str) -> Column:
    return F.col("o_arrival") < F.col("arrival") if scope == "earlier" else F.col("o_arrival") != F.col("arrival")


def candidates(invoices: DataFrame, existing: DataFrame, scope: str = "earlier", window_days: int = 7) -> DataFrame:
    """Pairs (arrival, other, kind) of an invoice and an existing one of the same supplier that is an exact or a near
    duplicate. scope 'earlier' counts only what arrived before it; 'all' every other one."""
    this, that = _sides(invoices, existing)
    same = (F.col("partner_code") == F.col("o_partner_code")) & (F.col("key") == F.col("o_key"))
    exact = this.filter("key <> ''").join(that, same & _order(scope)).select("arrival", F.col("o_arrival").alias("other"))
    return exact.withColumn("kind", F.lit("exact")).unionByName(_near(this, that, _order(scope), window_days).withColumn("kind", F.lit("near")))


def first_exact(this: DataFrame, that: DataFrame, scope: str) -> DataFrame:
    """arrival and dup_exact, the first exact duplicate, from the two first arrivals of each number: no group of copies
    is paired up."""
    order = Window.partitionBy("o_partner_code", "o_key").orderBy("o_arrival")
    firsts = that.filter("o_key <> ''").select("o_partner_code", "o_key", "o_arrival").distinct().withColumn("nth", F.row_number().over(order)).filter("nth <= 2")
    firsts = firsts.groupBy("o_partner_code", "o_key").agg(F.min("o_arrival").alias("first"), F.max("o_arrival").alias("second"))
    met = this.join(firsts, (F.col("partner_code") == F.col("o_partner_code")) & (F.col("key") == F.col("o_key")))
    other = F.when(F.col("first") != F.col("arrival"), F.col("first")).when((F.col("second") != F.col("arrival")), F.col("second"))
    if scope == "earlier":
        other = F.when(F.col("first") < F.col("arrival"), F.col("first"))
    return met.select("arrival", other.alias("dup_exact")).filter("dup_exact is not null")


def find_duplicates(invoices: DataFrame, existing: DataFrame, scope: str = "earlier", window_days: int = 7) -> DataFrame:
    """arrival, dup_exact (the first exact duplicate) and dup_near (near ones, in order of arrival). The scan stops at
    the first exact duplicate, so only near ones that arrived before it are listed."""
    this, that = _sides(invoices, existing)
    near = _near(this, that, _order(scope), window_days).groupBy("arrival").agg(F.array_sort(F.collect_list("other")).alias("near"))
    both = first_exact(this, that, scope).join(near, "arrival", "full_outer").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))
    kept = F.filter("near", lambda x: F.col("dup_exact").isNull() | (x < F.col("dup_exact")))
    return both.select("arrival", "dup_exact", kept.alias("dup_near"))


GROUP = ("partner_code", "total_amount")


def _days(existing: DataFrame, *more: str) -> DataFrame:
    """Existing invoices counted by supplier, total (and more) and day: however often a supplier repeats a total, there
    is one row a day. only is the arrival, where there is one."""
    dated = existing.filter("o_partner_code is not null and o_total_amount is not null and o_issue_date is not null")
    keys = [F.col(f"o_{c}").alias(c) for c in (*GROUP, *more)]
    return dated.groupBy(*keys, F.unix_date("o_issue_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("o_arrival").alias("only"))


def _within(asked: DataFrame, days: DataFrame, window_days: int, *more: str) -> DataFrame:
    """Per day asked, how many existing invoices lie within the window, and the first and last of their days."""
    window = Window.partitionBy(*GROUP, *more).orderBy("day").rangeBetween(-window_days, window_days)
    both = days.select(*GROUP, *more, "day", "n", F.col("day").alias("held"), F.lit(False).alias("asked"))
    both = both.unionByName(asked.select(*GROUP, *more, "day").distinct().withColumns({"n": F.lit(0).cast("bigint"), "held": F.lit(None).cast("int"), "asked": F.lit(True)}))
    counted = both.withColumns({"_n": F.sum("n").over(window), "_first": F.min("held").over(window), "_last": F.max("held").over(window)})
    return counted.filter("asked").select(*GROUP, *more, "day", F.col("_n").alias("n"), F.col("_first").alias("first_day"), F.col("_last").alias("last_day"))


def near_counts(invoices: DataFrame, existing: DataFrame, window_days: int = 7) -> DataFrame:
    """arrival and n_near, the number of near duplicates among all other existing invoices, where there are any, with
    the first and last day of the stretch of the supplier's total that they lie in (which may hold twins too).

    The near ones of an invoice are one stretch of the days of its supplier and total, less its twins and itself. So
    days are counted, not pairs made: the output has one row an invoice. `candidates` lists them on demand."""
    this, that = _sides(invoices, existing)
    this = this.filter("total_amount is not null and issue_date is not null").withColumn("day", F.unix_date("issue_date"))
    all_near = _within(this, _days(that), window_days)
    keyed = this.filter("key <> ''")
    twins = _within(keyed, _days(that.filter("o_key <> ''"), "key"), window_days, "key").select(*GROUP, "key", "day", F.col("n").alias("twins"))
    itself = that.select(F.col("o_arrival").alias("arrival"), "o_partner_code", "o_total_amount", "o_key", F.unix_date("o_issue_date").alias("o_day"))
    both = this.join(all_near, [*GROUP, "day"]).join(twins, [*GROUP, "key", "day"], "left").join(itself, "arrival", "left")
    twin = F.coalesce((F.col("key") != "") & (F.col("key") == F.col("o_key")), F.lit(False))
    counted = (F.col("partner_code") == F.col("o_partner_code")) & (F.col("total_amount") == F.col("o_total_amount")) & (F.abs(F.col("day") - F.col("o_day")) <= window_days) & ~twin
    near = F.col("n") - F.coalesce("twins", F.lit(0)) - F.when(counted, 1).otherwise(0)
    of_day = lambda c: F.date_from_unix_date(F.col(c)).alias(c)
    return both.select("arrival", near.alias("n_near"), of_day("first_day"), of_day("last_day")).filter("n_near > 0")


def nearest_days(invoices: DataFrame, existing: DataFrame) -> DataFrame:
    """arrival and near_gap, the days to the nearest other existing invoice of the same supplier and total, whatever its
    number: from that window on, an invoice without exact duplicates has near ones."""
    this, that = _sides(invoices, existing)
    this = this.filter("total_amount is not null and issue_date is not null").withColumn("day", F.unix_date("issue_date"))
    by_day = Window.partitionBy(*GROUP).orderBy("day")
    here = F.struct("day", "n", "only")
    # an invoice's own row can hide one day, so each side keeps two
    days = _days(that).select(*GROUP, "day", here.alias("here"), F.lag(here).over(by_day).alias("before"), F.lead(here).over(by_day).alias("after"))
    held = days.select(*GROUP, "day", F.struct("here", "before", "after").alias("held"), F.lit(False).alias("asked"))
    asked = this.select(*GROUP, "day").distinct().withColumns({"held": F.lit(None).cast(held.schema["held"].dataType), "asked": F.lit(True)})
    upto, since = by_day.rangeBetween(Window.unboundedPreceding, 0), by_day.rangeBetween(0, Window.unboundedFollowing)
    placed = held.unionByName(asked).withColumns({"up": F.last("held", ignorenulls=True).over(upto), "down": F.first("held", ignorenulls=True).over(since)}).filter("asked")
    around = F.array(F.col("up.here"), F.col("up.before"), F.col("down.here"), F.col("down.after"))
    met = this.join(placed.select(*GROUP, "day", around.alias("around")), [*GROUP, "day"])
    others = F.filter("around", lambda x: x.isNotNull() & ((x["n"] > 1) | (x["only"] != F.col("arrival"))))
    return met.select("arrival", F.array_min(F.transform(others, lambda x: F.abs(x["day"] - F.col("day")))).alias("near_gap")).filter("near_gap is not null")


def with_duplicates(invoices: DataFrame, existing: DataFrame, scope: str = "earlier", window_days: int = 7) -> DataFrame:
    joined = invoices.join(find_duplicates(invoices, existing, scope, window_days), "arrival", "left")
    return joined.withColumn("dup_near", F.coalesce("dup_near", F.array().cast("array<bigint>")))
