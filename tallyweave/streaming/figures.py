"""Live operating figures with retractions: an invoice that changes state moves from one count to another.

Every batch's last change of each invoice is met with the state it had before, and what is counted under the old one is
taken away and put under the new one. The figures are a small table, one row a state and one a latency, kept in shared
storage: a batch adds its differences to the figures of the batch before it. Old states are looked up in those of 256
buckets that a batch has invoices in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report
from ..sources.stores import store
from .arrivals import earlier, earlier_numbered, run_stream, write_batch

BUCKETS = 256
COST = "decimal(38,6)"
CALL = ("status", "cost_usd", "latency_ms")


def newest_changes(changes: DataFrame) -> DataFrame:
    """arrival, bucket and state: the last change (by version; ties by what it says) of each invoice. Rows without an
    arrival or a version tell nothing and are left out."""
    state = F.struct("version", "status", F.col("cost_usd").cast(COST).alias("cost_usd"), "latency_ms")
    last = changes.filter("arrival is not null and version is not null").groupBy("arrival").agg(F.max(state).alias("state"))
    return last.withColumn("bucket", F.pmod(F.xxhash64("arrival"), F.lit(BUCKETS)).cast("int"))


def states_before(asked: DataFrame, held: DataFrame) -> DataFrame:
    """arrival and old: the newest held state of the invoices of asked, read from their buckets only."""
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    mine = held.filter(F.col("bucket").isin(buckets)).join(asked.select("arrival"), "arrival", "left_semi")
    return mine.groupBy("arrival").agg(F.max("state").alias("old"))


def differences(moved: DataFrame) -> DataFrame:
    """kind (status or latency), key, n and cost_usd that moved (old, state) adds to the figures. A latency of 0 or none
    is no latency."""
    signed = lambda state, sign: F.struct(F.col(state).alias("s"), F.lit(sign).alias("sign"))
    each = moved.select(F.explode(F.array(signed("old", -1), signed("state", 1))).alias("c")).filter("c.s is not null").select("c.sign", "c.s.*")
    cost = F.coalesce("cost_usd", F.lit(0).cast(COST)) * F.col("sign")
    entry = lambda kind, key, cost: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), cost.cast(COST).alias("cost_usd"))
    entries = F.array(entry("status", F.col("status"), cost), F.when(F.col("latency_ms") != 0, entry("latency", F.col("latency_ms"), F.lit(0))))
    return summed(each.select(F.col("sign").cast("bigint").alias("n"), F.explode(F.array_compact(entries)).alias("e")).select("e.*", "n"))


def summed(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("cost_usd").cast(COST).alias("cost_usd"))


def figures_batch(batch: DataFrame, number: int, out: str) -> None:
    """Fold a batch of changes (arrival, version, status, cost_usd, latency_ms) into the figures. A change older than the
    state that an invoice has is ignored; a batch that is run again gives the same rows."""
    spark = batch.sparkSession
    last, held = store(newest_changes(batch)), earlier(spark, f"{out}/states", number)
    old = last.select("arrival", F.col("state").alias("old")).limit(0) if held is None else states_before(last, held)
    moved = store(last.join(old, "arrival", "left").filter("old is null or state.version > old.version"))
    sums, before = differences(moved), figures(spark, out, number)
    if before is not None:
        sums = summed(sums.unionByName(before))
    # one file a bucket, not one for each task and bucket
    write_batch(moved.select("arrival", "state", "bucket").repartition("bucket"), f"{out}/states", number, "bucket")
    write_batch(store(sums.filter("n <> 0")), f"{out}/figures", number)


def figures(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The figures as the last batch (before the one given) left them."""
    held = earlier_numbered(spark, f"{out}/figures", 2**62 if before is None else before)
    if held is None:
        return None
    newest = held.agg(F.max("batch")).first()[0]
    return None if newest is None else held.filter(F.col("batch") == newest).drop("batch")


def figures_stream(changes: DataFrame, out: str) -> StreamingQuery:
    """Keep figures of a stream of changes under out."""
    return run_stream(changes, f"{out}/checkpoint", lambda batch, number: figures_batch(batch, number, out))


def by_status(rows: DataFrame) -> DataFrame:
    """status, invoices and cost_usd of figures."""
    return rows.filter("kind = 'status'").select(F.col("key").alias("status"), F.col("n").alias("invoices"), F.col("cost_usd").cast("double").alias("cost_usd"))


def latency_median(rows: DataFrame) -> DataFrame:
    """The upper median of the latencies that figures count."""
    return report.median_of_counts(rows.filter("kind = 'latency'").select(F.col("key").cast("int").alias("latency_ms"), "n"))
