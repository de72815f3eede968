r"""Secret scans over an incremental blob ledger.

Every historical version of a path is addressed by the SHA-256 of its content. The ledger holds one row per blob and
rule version with that rule's findings; a scan reads only the pairs it does not hold, once per distinct content
however many paths and versions share it, and the findings are joined back to all of them.

Positions come from cutting the text at its matches: the lengths of the pieces and of the matches add up to the
offsets, in code points, with the end exclusive.

Defined cases: a null text counts as empty and has no findings; equal rows give equal rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Rule:
    """pattern as Java reads it; group `part` must have `least` characters, or the match is dropped."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1
    base: bool = False

    @property
    def version(self) -> str:
        return f"{self.kind}/{self.part}/{self.least}/{self.pattern}"


#: A private key: the header, then all up to its END line unless another BEGIN or END comes first; without an END line,
#: the header fields and base64 that follow (runs of 16 and more, or lines of nothing else), also where line ends are
#: written as \\n. The loops are possessive, which Java runs without recursion.
KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:[\x20\x09-\x0D]|\\[nrt])++(?:(?:Proc-Type|DEK-Info):(?:(?!\\[nr])[^\r\n])*+"
    r"|[A-Za-z0-9+/]{16,}+={0,2}+|(?<=[\r\n]|\\n)[A-Za-z0-9+/]++={0,2}+(?=[\x20\t]*+(?:[\r\n]|\\[nr]|\z))))*+)"
)
#: Kinds in the order that breaks ties; the first three are the base, the others the scanner's own.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("key", KEY),
)
SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPAN}"


def matches(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in text, leftmost and non-overlapping, as an array of spans in order."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, 0)
    part = whole if rule.part == 0 else F.regexp_extract_all(text, pattern, rule.part)
    between = F.split(text, rule.pattern, -1)
    lengths = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(part, F.length).alias("part"))
    start = lambda done, x: done["at"] + x["gap"]
    walked = F.aggregate(
        F.filter(lengths, lambda x: x["len"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda done, x: F.struct(
            (start(done, x) + x["len"]).alias("at"),
            F.when(
                x["part"] >= rule.least,
                F.array_append(done["spans"], F.struct(start(done, x).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start(done, x) + x["len"]).alias("end"))),
            ).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return F.when(F.regexp_like(text, pattern), walked).otherwise(F.array().cast(SPAN))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blob and rule-version pairs of versions (text) that ledger
    lacks. One copy of each content is kept, map-side first, before the text is scanned."""
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    names = [r.version for r in rules]
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version").isin(names)).groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        blobs = blobs.join(seen.filter(F.size("seen") >= len(rules)).select("blob"), "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    blobs = blobs.join(seen, "blob", "left") if ledger is not None else blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    due = lambda r: ~F.coalesce(F.array_contains("seen", F.lit(r.version)), F.lit(False))
    found = [F.when(due(r), F.struct(F.lit(r.version).alias("rule_version"), matches(F.col("text"), r, i).alias("spans"))) for i, r in enumerate(rules)]
    rows = blobs.select("blob", F.explode(F.array(*found)).alias("row")).filter("row is not null")
    return rows.select("blob", "row.rule_version", "row.spans")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): each row of versions as `row`, with its blob and spans (all rules, by start, then rule
    order), and the ledger with the new pairs, to be kept for the next scan."""
    fresh = materialize(scan_unseen(versions, ledger, rules))
    full = fresh if ledger is None else ledger.unionByName(fresh)
    return findings(versions, full, rules), full


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of versions as `row`, with its blob and the spans that ledger holds of it. A pair that the ledger holds
    twice, as two scans at once or one that was half moved leave it, counts once."""
    hits = ledger.filter(F.col("rule_version").isin([r.version for r in rules]) & (F.size("spans") > 0))
    pairs = F.collect_set(F.struct("rule_version", "spans"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.transform(pairs, lambda p: p["spans"]))).alias("spans"))
    found = versions.select(F.struct(*versions.columns).alias("row"), blob_of(F.col("text")).alias("blob")).join(hits, "blob", "left")
    return found.select("row", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan_into(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of versions by the ledger kept under path, to which the pairs it lacks are scanned and added. A scan
    that is stopped adds nothing or all of its pairs, and one that is repeated finds nothing left to scan."""
    spark = versions.sparkSession
    try:
        held = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    scan_unseen(versions, held, rules).write.mode("append").option("compression", "zstd").parquet(path)
    return findings(versions, spark.read.schema(LEDGER).parquet(path), rules)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """text with the stretches that spans cover, overlaps merged, replaced by [secret]."""
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, s: F.when(s["end"] <= done["at"], done).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < done["at"], done["out"])
                .otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("[secret]")))
                .alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every finding replaced and n_chars counted anew; the columns are those of docs."""
    found, _ = scan_versions(docs)
    new = redacted(F.col("row")["text"], F.col("spans"))
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length(new)).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[own[c].alias(c) for c in docs.columns])
