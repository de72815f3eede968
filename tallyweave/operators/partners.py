"""Matching suppliers to the master by registration number, name, alias and, for the rest, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import company_key, registration_key
from ..functions.udfs import indel_ratio, may_reach
from ..schemas import FUZZY_THRESHOLD
from ..sources.stores import store, unbroadcast


#: What matching and the search for duplicates need of an invoice.
ASKED = ("arrival", "supplier_name", "registration_no", "invoice_number", "total_amount", "issue_date")


def registration_index(partners: DataFrame) -> DataFrame:
    """reg_key to by_reg; of partners that share a number the last counts."""
    keyed = partners.withColumn("reg_key", registration_key(F.col("registration_no"))).filter("reg_key <> ''")
    return unbroadcast(keyed.groupBy("reg_key").agg(F.max_by("partner_code", "ord").alias("by_reg")))


def name_keys(partners: DataFrame) -> DataFrame:
    """One row per partner and distinct key of its name and aliases."""
    names = F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), company_key)))
    return partners.select("partner_code", "ord", company_key(F.col("name")).alias("own_key"), names.alias("name_key")).filter("name_key <> ''")


def name_index(partners: DataFrame) -> DataFrame:
    """name_key to by_name and method; of partners that share a key the first counts."""
    first = name_keys(partners).groupBy("name_key").agg(F.min_by(F.struct("partner_code", "own_key"), "ord").alias("p"))
    method = F.when(F.col("p.own_key") == F.col("name_key"), "EXACT_NAME").otherwise("ALIAS")
    return unbroadcast(first.select("name_key", F.col("p.partner_code").alias("by_name"), method.alias("name_method")))


def fuzzy_matches(missed: DataFrame, partners: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """name_key, by_name and score of the best partner at or above threshold for each of missed (name_key, distinct);
    ties go to the earliest partner.

    A partner's key that is one character longer or shorter and else equal beats every other, so these are looked up
    first, by the keys with a character left out. For the rest a key is cut into two segments more than it may have
    characters added or lost, so at least two stand unchanged in the name. Two of them do so after exactly as many
    changes as segments before the one, and one less than before the other (see `asked_segments`): that leaves few places
    for them, and pairs join on both segments at once. An edit-distance bound in the JVM leaves few of them for the
    exact score.
    """
    keys = name_keys(partners).groupBy("name_key").agg(F.min_by("partner_code", "ord").alias("partner_code"), F.min("ord").alias("ord"))
    # dealt to all tasks, as each key makes many short rows: by their bytes alone all keys would go to a few
    parts = int(partners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = unbroadcast(keys.withColumnRenamed("name_key", "key").repartition(parts, "key"))
    # written down once each: what follows takes them in several places, and would plan all before them in each
    asked = store(missed.select("name_key").filter("name_key <> ''"))
    longer = asked.join(held.withColumn("less", F.explode(shortened(F.col("key")))), F.col("name_key") == F.col("less")).drop("less")
    shorter = asked.withColumn("less", F.explode(shortened(F.col("name_key")))).join(held, F.col("less") == F.col("key")).drop("less")
    close = store(_scored(longer.unionByName(shorter), threshold).filter(F.length("name_key") > 2))
    rest = asked.join(unbroadcast(close.select("name_key").distinct()), "name_key", "left_anti")
    scored = close.unionByName(_scored(segment_pairs(rest, held, threshold), threshold))
    best = scored.groupBy("name_key").agg(F.max_by(F.struct("partner_code", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("name_key", F.col("b.partner_code").alias("by_name"), F.lit("FUZZY_NAME").alias("name_method"), F.round("b.score", 1).alias("score"))


def _scored(pairs: DataFrame, threshold: int) -> DataFrame:
    near = pairs.filter(may_reach(F.col("name_key"), F.col("key"), threshold)).distinct()
    return near.withColumn("score", indel_ratio("name_key", "key")).filter(F.col("score") >= threshold)


def shortened(key: Column) -> Column:
    """key with each one of its characters left out."""
    n = F.length(key)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n))))


#: Changes up to which keys join on two segments (keys of 24 characters at 85): of more segments there are many pairs.
PAIRED = 8


def segment_pairs(asked: DataFrame, held: DataFrame, threshold: int) -> DataFrame:
    """Names of asked (name_key) with the rows of held (key) that share segments where a similar key could have them;
    pairs may come more than once."""
    n = F.length("name_key")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n * threshold / (200 - threshold))).cast("int"), F.floor(n * (200 - threshold) / threshold).cast("int"))
    wanted, cut = asked.withColumn("length", F.explode(lengths)), held.withColumn("length", F.length("key"))
    # only keys of lengths that a name asks for, and the other way round, are cut up; of lengths there are few
    few = lambda rows: rows.select("length").distinct().hint("broadcast")
    wanted, cut = wanted.join(few(cut), "length", "left_semi"), cut.join(few(wanted), "length", "left_semi")
    wanted = wanted.withColumn("segment", F.explode(asked_segments(F.col("name_key"), F.col("length"), threshold)))
    cut = cut.withColumn("segment", F.explode(segments(F.col("key"), threshold)))
    return unbroadcast(wanted).join(unbroadcast(cut), ["length", "segment"]).drop("length", "segment")


def _most(length: Column, threshold: int) -> Column:
    """Characters that a name similar to a key of this length may have more or less than it, counted together."""
    longest = F.floor(length * (200 - threshold) / threshold)
    return F.floor((length + longest) * (100 - threshold) / 100).cast("int")


def _cut(length: Column, threshold: int) -> tuple[Column, Column, Column]:
    """Whether a key is too short for that many segments and goes by single characters, whether its segments go in
    pairs, and their number."""
    most = _most(length, threshold)
    short, paired = most + 2 > length, most <= PAIRED
    return short, paired, F.when(short, length).otherwise(most + F.when(paired, 2).otherwise(1)).cast("int")


def _range(first: Column, last: Column, step: int = 1) -> Column:
    return F.when(first <= last, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _piece(text: Column, length: Column, parts: Column, i: Column, shift: Column) -> Column:
    """The stretch of text where a key of this length has its segment i, moved by shift."""
    start = lambda i: F.floor(i * length / parts).cast("int")
    return F.substring(text, start(i) + 1 + shift, start(i + 1) - start(i))


def _tagged(i: Column, j: Column, text: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), text.alias("text"))


def segments(key: Column, threshold: int) -> Column:
    """Segments (i, j, text) that a key is found by: pairs, single ones (j is -1), or characters (both are -1)."""
    n, none, still = F.length(key), F.lit(-1), F.lit(0)
    short, paired, parts = _cut(n, threshold)
    piece = lambda i: _piece(key, n, parts, i, still)
    pairs = F.flatten(F.transform(_range(F.lit(0), parts - 2), lambda i: F.transform(_range(i + 1, parts - 1), lambda j: _tagged(i, j, F.concat(piece(i), piece(j))))))
    single = F.transform(_range(F.lit(0), parts - 1), lambda i: _tagged(i, none, piece(i)))
    return F.when(short, _characters(key)).when(paired, pairs).otherwise(single)


def _characters(text: Column) -> Column:
    return F.array_distinct(F.transform(_range(F.lit(1), F.length(text)), lambda i: _tagged(F.lit(-1), F.lit(-1), F.substring(text, i, F.lit(1)))))


def asked_segments(name: Column, length: Column, threshold: int) -> Column:
    """Segments that a name looks for among keys of this length.

    Give each segment of a key the characters lost in it and those added in or after it, and walk along the segments: up
    by its changes, down by one. Steps go down by one at most, and the walk ends below zero, at -2 or lower for pairs. So
    after the last place at height 0 stands an unchanged segment i, with exactly i changes before it, and after the last
    place at height -1 another one, j, with exactly j - 1 before it. Every change moves what follows by one place, so
    shifts are bound on both sides, by the changes before and by those left over, and are even or odd as these are.
    """
    n, none = F.length(name), F.lit(-1)
    short, paired, parts = _cut(length, threshold)
    apart = n - length
    # added and lost characters together are even or odd as the lengths' difference is
    most = F.floor((n + length) * (100 - threshold) / 100)
    most = (most - F.pmod(most + apart, F.lit(2))).cast("int")
    lost, added = F.floor((most - apart) / 2), F.floor((most + apart) / 2)
    piece = lambda i, shift: _piece(name, length, parts, i, shift)
    # a stretch that starts before the name, ends behind it, or moves further than characters can be lost or added
    start = lambda i: F.floor(i * length / parts)
    within = lambda i, shift, left: (shift >= -lost) & (shift <= added) & (start(i) + shift >= 0) & (start(i + 1) + shift <= n) & (F.abs(apart - shift) <= left)
    shifts = lambda i, middle, by, left: F.filter(_range(middle - by, middle + by, 2), lambda d: within(i, d, left))
    seconds = lambda i, d: F.flatten(F.transform(_range(i + 1, parts - 1), lambda j: F.transform(shifts(j, d, j - 1 - i, most + 1 - j), lambda e: _tagged(i, j, F.concat(piece(i, d), piece(j, e))))))
    pairs = F.flatten(F.transform(_range(F.lit(0), parts - 2), lambda i: F.flatten(F.transform(shifts(i, F.lit(0), i, most - i), lambda d: seconds(i, d)))))
    single = F.flatten(F.transform(_range(F.lit(0), parts - 1), lambda i: F.transform(shifts(i, F.lit(0), i, most - i), lambda d: _tagged(i, none, piece(i, d)))))
    return F.array_distinct(F.when(short, _characters(name)).when(paired, pairs).otherwise(single))


def resolve(invoices: DataFrame, partners: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """invoices (supplier_name, registration_no) with by_registration, by_name, agreement, partner_code, method and
    match_confidence. Similarity is tried only on distinct names that no key equals."""
    keyed = invoices.withColumn("reg_key", registration_key(F.col("registration_no"))).withColumn("name_key", company_key(F.col("supplier_name")))
    names = name_index(partners)
    missed = keyed.select("name_key").distinct().join(names, "name_key", "left_anti")
    names = names.withColumn("score", F.lit(None).cast("double")).unionByName(fuzzy_matches(missed, partners, threshold))
    # the master meets each pair of keys once, and whole invoices are dealt by their pair once
    pairs = keyed.select("reg_key", "name_key").distinct()
    known = pairs.join(registration_index(partners), "reg_key", "left").join(unbroadcast(names), "name_key", "left")
    both = keyed.join(unbroadcast(known), ["reg_key", "name_key"])
    return both.select(*invoices.columns, *reconciled(F.col("by_reg"), F.col("by_name"), F.col("name_method"), F.col("score")))


def reconciled(by_reg: Column, by_name: Column, name_method: Column, score: Column) -> list[Column]:
    conflict = F.coalesce(by_reg != by_name, F.lit(False))
    method = F.when(conflict, "UNRESOLVED").when(by_reg.isNotNull(), "REGISTRATION_NO").when(by_name.isNotNull(), name_method).otherwise("UNRESOLVED")
    by_method = F.when(name_method == "EXACT_NAME", 0.95).when(name_method == "ALIAS", 0.90).otherwise(0.60)
    confidence = F.when(conflict, 0.0).when(by_reg.isNotNull(), F.when(by_name == by_reg, 1.0).otherwise(0.92)).when(by_name.isNotNull(), by_method).otherwise(0.0)
    return [
        by_reg.alias("by_registration"), by_name.alias("by_name"), (~conflict).alias("agreement"),
        F.when(~conflict, F.coalesce(by_reg, by_name)).alias("partner_code"), method.alias("method"),
        confidence.alias("match_confidence"), score.alias("fuzzy_score"),
    ]


def chosen_by_reviewer(resolved: DataFrame, partners: DataFrame) -> DataFrame:
    """resolved (with reviewer_code) where a reviewer's code that the master knows and the match differs from wins."""
    known = unbroadcast(partners.select(F.col("partner_code").alias("known_code")).distinct())
    both = resolved.join(known, F.col("reviewer_code") == F.col("known_code"), "left")
    wins = F.col("known_code").isNotNull() & ~F.col("known_code").eqNullSafe(F.col("partner_code"))
    set_to = {"partner_code": F.col("known_code"), "method": F.lit("EXACT_NAME"), "match_confidence": F.lit(1.0), "agreement": F.lit(True)}
    return both.withColumns({c: F.when(wins, v).otherwise(F.col(c)) for c, v in set_to.items()}).drop("known_code")
