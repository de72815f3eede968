"""Rules that stored tables must keep, watched in the job that writes them; rows that break one are set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def guard(rows: DataFrame, order: str, unique: dict[str, tuple[str, ...]], never: dict[str, Column] | None = None) -> DataFrame:
    """rows with rules_broken, the sorted names of the rules each breaks. Of the rows that share a key of unique, all
    but the first by order break its rule, and all of them if several come first; a key with a null in it is no key. A
    rule of never is broken where its condition is true. rows must have no column named rules_broken."""
    marked = rows.select(F.struct(*rows.columns).alias("row"), F.col(order).alias("order"), *[c.alias(f"never_{i}") for i, c in enumerate((never or {}).values())])
    broken = [F.when(F.col(f"never_{i}"), F.lit(name)) for i, name in enumerate(never or {})]
    for i, (name, key) in enumerate(unique.items()):
        names = [f"key_{j}" for j in range(len(key))]
        keyed = rows.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(order).alias("order")).dropna(subset=names)
        # counted in two steps before the join, and only keys that repeat are joined: a hot key is one row there
        each = keyed.groupBy(*names, "order").agg(F.count(F.lit(1)).alias("n"))
        least = F.min(F.struct("order", "n"))
        repeated = each.groupBy(*names).agg(least.alias(f"least_{i}"), F.sum("n").alias("n")).filter("n > 1").drop("n")
        match = [F.col(f"row.{k}") == F.col(n) for k, n in zip(key, names)]
        marked = marked.join(repeated, match, "left").drop(*names)
        first = F.col(f"least_{i}")
        sound = F.col("order").eqNullSafe(first["order"]) & (first["n"] == 1)
        broken.append(F.when(first.isNotNull() & ~sound, F.lit(name)))
    return marked.select("row.*", F.array_sort(F.array_compact(F.array(*broken))).alias("rules_broken"))


def store_guarded(rows: DataFrame, path: str, order: str, unique: dict[str, tuple[str, ...]], never: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(sound rows, rows set apart with rules_broken, rows written and broken ones by rule): one job writes both, in
    folders of their own under path, and counts on the way."""
    seen, names = Observation(), [*unique, *(never or {})]
    marked = guard(rows, order, unique, never)
    watched = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains("rules_broken", n)).alias(n) for n in names])
    watched.withColumn("sound", F.size("rules_broken") == 0).write.mode("overwrite").partitionBy("sound").parquet(path)
    stored = rows.sparkSession.read.schema(T.StructType([*marked.schema.fields, T.StructField("sound", T.BooleanType())])).parquet(path)
    return stored.filter("sound").drop("sound", "rules_broken"), stored.filter("not sound").drop("sound"), seen.get
