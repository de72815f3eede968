"""License scans by diagonal voting.

All rolling k-word hashes of all documents meet the template positions with the same hash in one Spark join. A hit at
word p of the document and word q of the template votes for the diagonal p - q; votes are counted by document,
template and diagonal, and neighbouring diagonals a few words apart (a word added or left out) are merged to a place.
A place may hold a notice several times, or torn pieces of it, so each of its hits is tried as a beginning: enough of
the template's k-word groups must follow in the template's order within a limited stretch, compared as words and not
only as hashes. Of stretches that overlap, the best is the span.

Defined cases: a null or empty text has no words and no labels; a template met twice in a document gives two spans;
equal rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Digits, letters and everything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Diagonals this many words apart belong to one place; the share of a template's groups that must stand there.
NEAR, ENOUGH = 2, 0.85

#: Phrases whose exact places are counted, and the sentences that name a licence in full.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "released under the mit license": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "you may not use this file except in compliance with the license": "apache-text",
    "all rights reserved": "all-rights-reserved",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(LICENSE_WORD), 0)


def grams(words: Column, k: int = K) -> Column:
    """The k-word groups of words, each joined by spaces, in order."""
    rolled = words
    for i in range(1, k):
        rolled = F.zip_with(rolled, F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.slice(rolled, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def template_grams(spark, phrases: dict[str, str], notices: dict[str, str], k: int = K) -> DataFrame:
    """One row per position of each template (a short parameter, so its size is bounded)."""
    rows = [(t, label, base, q, " ".join(w[q : q + k]), len(w) - k + 1) for base, group in ((True, phrases), (False, notices)) for t, label in group.items() for w in [t.split()] for q in range(len(w) - k + 1)]
    frame = spark.createDataFrame(rows, "template string, label string, base boolean, q int, words string, positions int")
    return frame.withColumn("hash", F.xxhash64("words"))


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Verified places of the templates in docs (doc_id, text): key, template, label, base, start, end and score.

    key stands for the row's id and content, so equal rows share their places.
    """
    return spans_of(license_hits(docs, phrases, notices).filter("template is not null"))


FACTS = ("key", "template", "label", "base", "positions")


def license_hits(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row (key, template, label, base, positions, p, q) for each k-word group of docs that stands in a template,
    and one for each row of docs, without a template, with its doc_id and n_words. Texts are read once for both."""
    spark = docs.sparkSession
    # the words in a projection of their own: they are used several times and found once
    worded = docs.select(F.col("doc_id"), row_key().alias("key"), words_of(F.col("text")).alias("_words"))
    whole = F.concat(F.array(F.lit(None).cast("string")), grams(F.col("_words")))
    rolled = worded.select("doc_id", "key", F.size("_words").cast("long").alias("n_words"), F.posexplode(whole).alias("at", "gram"))
    rolled = rolled.withColumn("hash", F.xxhash64("gram"))
    known = template_grams(spark, phrases, notices)
    met = rolled.join(F.broadcast(known), (rolled["hash"] == known["hash"]) & (rolled["gram"] == known["words"]), "left").filter("template is not null or at = 0")
    own = F.col("at") == 0
    return materialize(met.select(F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words"), *FACTS, (F.col("at") - 1).alias("p"), "q"))


def spans_of(hits: DataFrame) -> DataFrame:
    """The verified places of hits: key, template, label, base, start, end and score."""
    # one row for each hit, whatever the copies of its row
    hits = hits.select(*FACTS, "p", "q").distinct()
    diagonal = (F.col("p") - F.col("q")).alias("diagonal")
    exact = hits.filter("base").groupBy(*FACTS, diagonal).agg(F.count(F.lit(1)).alias("votes"), F.max("p").alias("high"))
    exact = exact.filter(F.col("votes") == F.col("positions")).select(*FACTS, F.col("diagonal").alias("start"), (F.col("high") + K).alias("end"), F.lit(1.0).alias("score"))

    votes = hits.filter("not base").groupBy(*FACTS, diagonal).agg(F.count(F.lit(1)).alias("votes"), F.collect_list(F.struct("p", "q")).alias("hits"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    placed = votes.withColumn("place", F.sum(gap.cast("int")).over(along))
    # a place with fewer votes than a template needs cannot hold it
    placed = placed.withColumn("all", F.sum("votes").over(Window.partitionBy("key", "template", "place"))).filter(F.col("all") >= ENOUGH * F.col("positions"))
    placed = placed.select(*FACTS, "place", F.explode("hits").alias("hit")).select(*FACTS, "place", "hit.p", "hit.q")
    # a stretch is at most twice as long as its template: places in units of that length, so that one range fits all
    unit = 1 << 20
    along = F.floor(F.col("p").cast("long") * unit / (2 * (F.col("positions") + K)))
    ahead = Window.partitionBy("key", "template", "place").orderBy(along).rangeBetween(0, unit - 1)
    tried = placed.withColumn("chain", _chain(F.collect_list(F.struct("p", (-F.col("q")).alias("minus_q"))).over(ahead), F.col("positions"), F.col("p"), F.col("q")))
    score = F.col("chain")["met"] / F.col("positions")
    tried = tried.select(*FACTS, "place", F.col("p").alias("start"), (K - F.col("chain")["minus_end"]).alias("end"), score.alias("score")).filter(score >= ENOUGH)
    before = Window.partitionBy("key", "template", "place").orderBy("start", "end", "score").rowsBetween(Window.unboundedPreceding, -1)
    tried = tried.withColumn("new", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    tried = tried.withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("score", (F.col("start") - F.col("end")).alias("shortness"), "start", "end")).alias("best")
    fuzzy = tried.groupBy(*FACTS, "place", "span").agg(best).select(*FACTS, "best.start", "best.end", "best.score")
    return exact.unionByName(fuzzy).drop("positions")


def _chain(hits: Column, positions: Column, p: Column, q: Column) -> Column:
    """Of hits (p, minus_q): the most template places that follow one another in both document and template, from the hit
    (p, q) on, as struct (met, minus_end), the nearest end first. A hit adds to the best chain that ends before its q."""
    none = F.struct(F.lit(0).alias("met"), F.lit(0).alias("minus_end"))

    def add(best: Column, hit: Column) -> Column:
        at = -hit["minus_q"]
        led = F.when(at > 0, F.array_max(F.slice(best, 1, at))["met"]).otherwise(0)
        begins = (hit["p"] == p) & (at == q)
        new = F.when(begins | (led > 0), F.struct((led + 1).alias("met"), (-hit["p"]).alias("minus_end"))).otherwise(none)
        return F.transform(best, lambda v, j: F.when((j == at) & (new["met"] > v["met"]), new).otherwise(v))

    return F.array_max(F.aggregate(F.array_sort(hits), F.array_repeat(none, positions), add))


def row_key() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(text.cast("binary"), 256))


def scan_documents(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of docs: its words, exact places of the phrases and the labels found."""
    hits = license_hits(docs, phrases, notices)
    spans = spans_of(hits.filter("template is not null"))
    first = lambda c, keep: F.when(F.col("base"), F.col(c)) if keep else F.col(c)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("key").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(first("start", True)).cast("long").alias("first_word"),
        F.max(first("start", True)).cast("long").alias("last_word"),
        joined(first("label", True)).alias("base_labels"),
        joined(first("label", False)).alias("labels"),
        F.max("score").alias("score"),
    )
    out = hits.filter("template is null").select("doc_id", "key", "n_words").join(found, "key", "left").drop("key")
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
