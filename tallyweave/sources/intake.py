"""Taking documents in: screening, completeness, content hashes, raw records and what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CONFIDENCES, RAW_SCHEMA, RAW_TEXTS

# The suffixes taken, with their types; the largest file; the least text of a text layer.
TYPES = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}
LARGEST, LEAST_TEXT, TAIL = 25 * 1024 * 1024, 40, 2048


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def screen(files: DataFrame) -> DataFrame:
    """files (path, length, content) with filename, mime_type, accepted and reason."""
    kind = suffix(F.col("path"))
    reason = F.when(~kind.isin(*TYPES), F.concat(F.lit("unsupported type: "), kind)).when(F.col("length") > LARGEST, "larger than 25 MiB").otherwise(incomplete(F.col("content"), kind))
    mime = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), kind), F.lit("application/octet-stream"))
    return files.withColumns({"filename": F.regexp_extract("path", "([^/]+)$", 1), "mime_type": mime, "reason": reason, "accepted": reason.isNull()})


def incomplete(content: Column, kind: Column) -> Column:
    """Why a file looks cut off, or null: empty, a PDF without its end mark near the end, an image without its own."""
    last = lambda n: F.decode(F.substring(content, F.greatest(F.length(content) - n + 1, F.lit(1)), F.lit(n)), "ISO-8859-1")
    ends = F.hex(F.substring(content, F.greatest(F.length(content) - 15, F.lit(1)), F.lit(16)))
    return (
        F.when(F.length(content) == 0, "the file is empty")
        .when((kind == "pdf") & (F.instr(last(TAIL), "%%EOF") == 0), "the PDF has no end mark")
        .when(kind.isin("jpg", "jpeg") & ~ends.rlike("FFD9(00)*$"), "the image is cut off")
        .when((kind == "png") & ~ends.contains("49454E44"), "the image is cut off")
    )


def has_text_layer(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= LEAST_TEXT


def new_documents(arrivals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first arrival of each content (arrival, sha256) that known (sha256) does not hold."""
    fresh = arrivals if known is None else arrivals.join(known.select("sha256").distinct(), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min("arrival").alias("arrival"))
    return fresh.join(first, ["sha256", "arrival"], "left_semi")


def repeated_documents(arrivals: DataFrame) -> DataFrame:
    """Every arrival with the first one of its content, and whether it is a repeat."""
    first = F.min("arrival").over(Window.partitionBy("sha256"))
    return arrivals.withColumn("first", first).withColumn("already_ingested", F.col("arrival") != F.col("first"))


def recovered_json(text: Column) -> Column:
    """The JSON object in a model's answer: without a code fence, else from the first brace to the last; null if
    neither can be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    readable = lambda c: F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{")
    return F.when(readable(bare), bare).when((braces != "") & readable(braces), braces)


def read_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Every answer, read once, with failed, the fields of RAW_SCHEMA with defaults for what is missing, unknown keys left
    out, and column as it came."""
    parsed = answers.withColumn("_json", recovered_json(F.col(column))).withColumn("_raw", F.from_json("_json", RAW_SCHEMA, {"mode": "PERMISSIVE"}))
    keep = [c for c in answers.columns if c != column]
    texts = [F.coalesce(f"_raw.{c}", F.lit("JPY" if c == "currency" else "")).alias(c) for c in RAW_TEXTS if c not in keep]
    arrays = [F.coalesce(f"_raw.{c}", F.array().cast(parsed.select(f"_raw.{c}").schema[0].dataType)).alias(c) for c in ("lines", "tax_breakdown", "handwritten_annotations")]
    sure = F.struct(*[F.coalesce(f"_raw.field_confidence.{c}", F.lit(1.0)).alias(c) for c in CONFIDENCES]).alias("field_confidence")
    return parsed.select(*keep, *texts, *arrays, sure, F.col("_json").isNull().alias("failed"), F.col(column).alias("_answer"))


def raw_records(answers: DataFrame, column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(records, failures) of answers: those that can be read, and the rows that cannot, as EXTRACT_FAILED with notes. One
    bad row never fails the batch."""
    both = read_answers(answers, column)
    keep = [c for c in answers.columns if c != column]
    failures = both.filter("failed").select(*keep, F.lit("EXTRACT_FAILED").alias("status"), F.concat(F.lit("Extraction failed: "), F.substring(F.coalesce("_answer", F.lit("")), 1, 80)).alias("notes"))
    return both.filter("not failed").drop("failed", "_answer"), failures


def read_partners(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("partner_code string, name string, aliases array<string>, registration_no string, ord int").json(path)


def reset(spark: SparkSession, path: str) -> int:
    """Empty a Parquet table and say how many rows it had."""
    table = spark.read.parquet(path)
    n, schema = table.count(), table.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def append(df: DataFrame, path: str, run_date: str) -> None:
    """Add rows to a table that is partitioned by the date of the run."""
    df.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("append").partitionBy("run_date").parquet(path)
