"""Importance resampling towards a target: documents drawn by how much their n-grams resemble the target's.

A text's letters A to Z are lower-cased and all separators between words collapsed to single spaces; an overlapped
regular expression, bounded by lookarounds, then emits the span of every run of 1 to n words, and the CRC-32 of a
span's bytes is its bucket. Counts by bucket of the raw documents and of the target give each bucket a gain; a
document's weight is the sum over its features, and Gumbel noise drawn from its id turns the highest scores into a
sample without replacement.

Texts are scanned once: a document's buckets are written down, packed, and read again once the gains are known. What
the driver sees is the gain of each bucket, whose number is a parameter. The drawn ones are ranked from ranges of scores
and their counts, not by one sort in one task.

Defined cases: a null or empty text has no features and weighs 0; a null id counts as empty text in the noise and comes
last among equals; repeated rows are documents of their own, ranked one after the other; an empty target gives gains
from the raw documents alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Separators are ASCII and no digit or letter; A to Z are lower-cased.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Features whose buckets a task remembers.
REMEMBERED = 500_000


def spans_of(words: int) -> regex.Pattern:
    """Every run of so many words between single spaces."""
    return regex.compile(rb"(?<![^ ])[^ ]+" + rb" [^ ]+" * (words - 1) + rb"(?![^ ])")


def collapsed(text: str | None) -> bytes:
    """text in lower case, its words with one space between them."""
    return b" ".join((text or "").encode().translate(PLAIN).split())


class Buckets(dict):
    """CRC-32 buckets of features."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def hashed_features(texts: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and the packed buckets of each row of texts (doc_id, text)."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spans = Buckets(buckets), [spans_of(n) for n in range(1, ngrams + 1)]
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                words, found = [], []
                for text in part.column("text").to_pylist():
                    flat = collapsed(text)
                    words.append(flat.count(b" ") + 1 if flat else 0)
                    found.append(np.array([known[m[0]] for span in spans for m in span.finditer(flat, overlapped=True)], kind))
                columns = [part.column("doc_id"), pa.array(words, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(hashed: DataFrame, buckets: int) -> DataFrame:
    """bucket and how many features of hashed fall into it; tasks add up their own first."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                counts += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met], pa.int64())], names=["bucket", "n"])

    return hashed.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, from bucket_counts of the raw documents and of the target (one short row a bucket)."""
    both = raw.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets))
    for row in both.collect():
        counts[row["side"], row["bucket"]] = row["n"]
    (s, t), (raw_sum, target_sum) = counts, counts.sum(1)
    return np.floor(1000 * np.log((t + 1) * (raw_sum + buckets) / ((s + 1) * (target_sum + buckets)))).astype(np.int64)


def weighted(hashed: DataFrame, gain: np.ndarray) -> DataFrame:
    """hashed with the weight of each row in place of its buckets."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.frombuffer(packed.as_buffer(), kind)].sum()) for packed in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return hashed.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise of doc_id in thousandths, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """rows with rank (1, 2, 3 ... by order) as far as `most`, else null. Rows are dealt to ranges of the order, and
    each is numbered from the counts of the ranges before it; which row lies in which range is written down once, as
    the limits are sampled."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    skip = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_skip") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ranged.join(F.broadcast(skip.select("_part", "_skip")), "_part").withColumn("rank", place.cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_part", "_skip")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, ngrams: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text): the `percent` of those with
    least_words words that score highest for target (text) are drawn and ranked; the others' rank is null."""
    hashed = materialize(hashed_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ngrams, buckets))
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), ngrams, buckets)
    gain = gains(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets), buckets)
    scored = materialize(weighted(hashed, gain).withColumn("score", F.col("weight") + noise(seed)))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = ranked(able, percent * able.count() // 100, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
