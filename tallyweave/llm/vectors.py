"""What the two vector searches share: usable rows, shards, blocks of queries, and merging shard results.

An id names one vector: of rows that repeat an id with several usable vectors the least counts, component by component
(a vector that begins another comes first). Vectors of different lengths are never compared; each length has shards of
its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
#: Partitions that the groups of a search are dealt to, at most.
MOST_TASKS = 10_000


def usable(vectors: DataFrame, id_column: str, column: str, zero: bool) -> DataFrame:
    """One row (id, vector of doubles, dim) for each id whose vector is neither null nor holds null or non-finite components, nor is
    all zero where zero is False."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & good)
    if not zero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def sharded(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """rows with a shard number, pseudorandom by id, and how many shards there are."""
    shards = max(1, -(-rows.count() // shard_rows))
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), shards


def blocked(queries: DataFrame) -> tuple[DataFrame, int]:
    """queries with the number of their block, and how many blocks there are."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    return queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")), blocks


def for_each(rows: DataFrame, column: str, n: int) -> DataFrame:
    """rows once for each number from 0 to n - 1."""
    return rows.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def spread(rows: DataFrame, groups: int, *keys: str) -> DataFrame:
    """rows dealt by keys to a number of partitions, four for each group, so that AQE does not put these few rows, each
    of which is much work, into one task. A partition without rows costs nothing."""
    return rows.repartition(min(4 * groups, MOST_TASKS), *keys)


def matrix(rows: pa.Table, column: str = "vector") -> np.ndarray:
    values = rows.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


def merged(found: DataFrame, k: int, best_first: bool) -> DataFrame:
    """The k best of each query over all shards, with ranks; ties go to the smaller id."""
    order = F.col("score").desc() if best_first else F.col("score").asc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
