"""URL filters: prefix rules, and behind them a list of canonical URLs found by a blocked Bloom filter.

Each listed URL sets one bit in each of the eight 64-bit words of one block, so a lookup reads one row of the filter.
Spark builds the filter by grouping on the block number and joins urls to it by that number; it broadcasts the filter
only under its own size threshold and otherwise shuffles. What passes is joined to the listed URLs themselves, which
removes the false positives; AQE splits a url that very many rows share.

Defined cases: a url that is null or has no "://" has an empty host and path, fits no rule and is not listed; an
empty list blocks nothing; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

WORDS = 8
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Query parameters that name where a reader came from, not a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
#: Host words of gambling, spam, drug, advertising and adult sites.
LISTED_WORDS = ("casino", "bets", "pills", "ads", "spam", "adult")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www., default port, trailing slash, fragment and tracking parameters; the other
    parameters in order. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    named = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    rest = F.array_join(F.array_sort(named), "&")
    page = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    return F.when(host != "", page)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Of the (verdict, host, path) rules that fit, the longest, as a struct (rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit(1))
    # 1 << 63 is negative; the bits still combine as they should
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * w).bitwiseAND(63).cast("int")) for w in range(WORDS)]


def build_filter(listed: DataFrame, bits_per_key: int = 12) -> tuple[DataFrame, int]:
    """The filter's non-empty blocks (block, w0..w7) of listed (canonical), and how many blocks there are."""
    blocks = max(1, -(-listed.count() * bits_per_key // (64 * WORDS)))
    marks = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), *[b.alias(f"b{w}") for w, b in enumerate(_bits(F.col("canonical")))])
    return marks.groupBy("block").agg(*[F.bit_or(f"b{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def possible(urls: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """urls with a boolean `possible`: false only for a canonical URL that is certainly not listed."""
    marked = urls.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
    bits = _bits(F.col("canonical"))
    hit = F.col("canonical").isNotNull()
    for w in range(WORDS):
        hit = hit & (F.col(f"w{w}").bitwiseAND(bits[w]) == bits[w])
    joined = marked.join(filter_blocks, "block", "left")
    return joined.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{w}" for w in range(WORDS)])


def judge_urls(urls: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (any columns with url) as host, path, rule, verdict and listed beside their own id columns.

    A fitting rule decides; else a listed URL is blocked and any other allowed. rules is a short parameter, tried as
    one expression; the list may be of any length.
    """
    listed = materialize(listed.select("canonical").filter("canonical is not null").distinct())
    blocks, n = build_filter(listed)
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "listed", "canonical", "possible")]
    # the rows travel as one column, so that no name of theirs meets one of the filter's
    parts = urls.select(F.struct(*keep).alias("row"), F.col("url"), canonical_url(F.col("url")).alias("canonical"))
    parts = materialize(possible(parts, materialize(blocks), n))
    hits = parts.filter("possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    judged = hits.unionByName(parts.filter("not possible").withColumn("listed", F.lit(None).cast("boolean")))
    judged = judged.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("listed", F.coalesce("listed", F.lit(False)))
    judged = judged.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("row.*", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), "listed")


def flagged_hosts(urls: DataFrame, words: tuple = LISTED_WORDS) -> DataFrame:
    """The canonical URLs of urls whose host has one of words between dots and hyphens."""
    named = F.arrays_overlap(F.split(host_of(F.col("url")), "[.-]"), F.array(*[F.lit(w) for w in words]))
    return urls.filter(named).select(canonical_url(F.col("url")).alias("canonical")).distinct()
