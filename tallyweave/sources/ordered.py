"""Rows kept in order: sorted files and a list of what each holds, so that a page or a row opens few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_ordered(rows: DataFrame, path: str, section: str, key: str) -> None:
    """rows sorted by section (an int, few values) and key over all files of path/rows; path/files has one short row for
    each file and section: its least and greatest key, its rows, where they start in the file. Neither may be null, and
    a key stands once in a section."""
    rows.repartitionByRange(section, key).sortWithinPartitions(section, key).write.mode("overwrite").parquet(f"{path}/rows")
    held = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    held = held.select(F.col(section).alias("section"), F.col(key).alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    listed = held.groupBy("section", "file").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/files")


def opened(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """The rows of some files only."""
    schema = spark.read.parquet(f"{path}/rows").schema
    names = list(dict.fromkeys(files))
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def page(spark: SparkSession, path: str, section: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The next size rows after (section, key), or the first ones, in order; opens the files that hold them."""
    files, beyond = listed(spark, path), F.lit(True)
    if after:
        beyond = lambda s, k: (F.col(s) > after[0]) | ((F.col(s) == after[0]) & (F.col(k) > after[1]))
        files, beyond = files.filter(beyond("section", "most")), beyond(section, key)
    need, names = size, []
    # every file and section listed has a row on the page but perhaps the last, so these are at most size + 1
    for i, f in enumerate(files.orderBy("section", "least", "most", "file").limit(size + 1).collect()):
        names.append(f.file)
        need -= 1 if i == 0 and after else f.n
        if need <= 0:
            break
    return opened(spark, path, names).filter(beyond).orderBy(section, key).limit(size)


def find(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key; opens at most the few files, one or two a section, whose range it lies in."""
    near = listed(spark, path).filter((F.col("least") <= value) & (F.col("most") >= value)).select("file").collect()
    return opened(spark, path, [f.file for f in near]).filter(F.col(key) == value)


def placed(spark: SparkSession, path: str, section: str) -> DataFrame:
    """Every row with its place (from 1) in the stored order, from the list and its position in its file alone. The list
    is summed up in one task: one short row a file and section."""
    earlier = Window.orderBy("section", "least", "most", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = listed(spark, path).select(F.col("section").alias("_section"), F.col("file").alias("_file"), "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"), F.col(section).alias("_section"))
    place = (F.col("before") + F.col("_at") - F.col("at") + 1).cast(T.LongType())
    return rows.join(starts, ["_section", "_file"]).withColumn("place", place).drop("_section", "_file", "_at", "at", "before")
