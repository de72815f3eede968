"""The registered queries of the invoice jobs and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import checks, dedupe, evals, guards, ledger, normalize, partners, policy, report, review
from .plans import casework, verify
from .schemas import FALLBACK_UNIT, TAX_RATES
from .sources import intake, ordered, structure
from .sources.projection import LATER, PROJECTED_POLICY, as_operations, operations, raw_invoices, read, typed_lines
from .sources.projection import partners as master
from .sources.stores import layer, shared_dir, stored_layer
from .streaming import arrivals, figures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{prelude}\n{sql}"
        return f

    return add


#: The same invoices, typed straight from the tables.
TYPED = r"""
WITH ln0 AS (
    SELECT l_orderkey AS ok, l_partkey, l_quantity::BIGINT AS q, floor(l_extendedprice)::BIGINT // l_quantity::BIGINT AS up, l_linenumber % 5 = 0 AND l_returnflag = 'R' AS neg,
           CASE WHEN l_tax >= 0.04::DOUBLE THEN 'T10' WHEN l_tax > 0 THEN 'T08' END AS rate,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_returnflag)::INTEGER AS seq
    FROM lineitem),
fb AS (SELECT ok, count(DISTINCT rate) AS k, min(rate) AS one FROM ln0 GROUP BY ok),
ln AS (
    SELECT ln0.ok, seq, l_partkey, CASE WHEN NOT neg THEN q END AS quantity, up AS unit_price, CASE WHEN l_partkey % 37 = 0 THEN '' ELSE 'pc' END AS unit,
           (q * up + (ln0.ok % 53 = 0)::INT) * CASE WHEN neg THEN -1 ELSE 1 END AS amount, coalesce(rate, CASE k WHEN 0 THEN 'T10' WHEN 1 THEN one ELSE 'UNKNOWN' END) AS tax_code
    FROM ln0 JOIN fb ON fb.ok = ln0.ok),
sums AS (
    SELECT ok, count(*) AS n, sum(amount)::BIGINT AS s, coalesce(sum(amount) FILTER (tax_code = 'T10'), 0)::BIGINT AS b10, coalesce(sum(amount) FILTER (tax_code = 'T08'), 0)::BIGINT AS b08,
           count(*) FILTER (quantity IS NOT NULL AND quantity * unit_price <> amount) AS wrong, count(*) FILTER (unit = '') AS nounit, count(*) FILTER (tax_code = 'UNKNOWN') AS unknown
    FROM ln GROUP BY ok),
hdr AS (
    SELECT o_orderkey AS ok, o_custkey AS ck, o_orderdate::DATE AS issue, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(b10, 0) AS b10, coalesce(b08, 0) AS b08,
           (floor(coalesce(b10, 0) * 0.1::DOUBLE) + floor(coalesce(b08, 0) * 0.08::DOUBLE))::BIGINT AS tax, coalesce(wrong, 0) AS wrong, coalesce(nounit, 0) AS nounit, coalesce(unknown, 0) AS unknown,
           CASE WHEN o_custkey % 50 = 0 THEN substr(md5(o_custkey::VARCHAR), 1, 12) WHEN o_orderkey % 2 = 0 THEN c_name ELSE replace(c_name, '#', '') END AS base,
           CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN o_custkey + 1 ELSE o_custkey END AS rk
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN sums ON ok = o_orderkey),
named AS (SELECT *, lower(CASE WHEN ok % 307 = 0 THEN left(base, length(base) - 1) ELSE base END) AS nk FROM hdr),
keys AS (
    SELECT c_custkey AS pk, lower(c_name) AS key, 'EXACT_NAME' AS m FROM customer WHERE c_custkey % 50 <> 0
    UNION ALL SELECT c_custkey, lower(replace(c_name, '#', '')), 'ALIAS' FROM customer WHERE c_custkey % 50 <> 0),
missed AS (SELECT DISTINCT nk FROM named WHERE nk NOT IN (SELECT key FROM keys)),
fuzzy AS (
    SELECT nk, min(pk) AS pk FROM missed JOIN keys ON length(key) = length(nk) + 1 AND key LIKE '%' || array_to_string(string_split(nk, ''), '%') || '%' GROUP BY nk),
who AS (
    SELECT named.*, r.c_custkey AS rp, coalesce(keys.pk, fuzzy.pk) AS np, CASE WHEN keys.pk IS NOT NULL THEN keys.m WHEN fuzzy.pk IS NOT NULL THEN 'FUZZY_NAME' END AS nm
    FROM named LEFT JOIN customer r ON r.c_custkey = rk AND rk % 50 <> 0 LEFT JOIN keys ON keys.key = nk LEFT JOIN fuzzy ON fuzzy.nk = named.nk),
met AS (
    SELECT *, coalesce(rp <> np, false) AS conflict, CASE WHEN coalesce(rp <> np, false) THEN NULL ELSE coalesce(rp, np) END AS pid,
           CASE WHEN coalesce(rp <> np, false) THEN 'UNRESOLVED' WHEN rp IS NOT NULL THEN 'REGISTRATION_NO' WHEN np IS NOT NULL THEN nm ELSE 'UNRESOLVED' END AS method
    FROM who),
sent AS (
    SELECT ok AS arrival, 'INV-' || ok AS number, issue AS issued, * FROM met
    UNION ALL SELECT ok + 1000000000, lower('INV-' || ok), issue, * FROM met WHERE ok % 40 = 13
    UNION ALL SELECT ok + 1000000000, 'INV-' || ok || '-R2', issue + (ok % 14)::INTEGER, * FROM met WHERE ok % 40 = 7),
inv AS (
    SELECT *, CASE WHEN pid IS NOT NULL THEN format('P-{:06d}', pid) END AS partner_code, CASE WHEN ok % 101 = 0 THEN NULL WHEN ok % 97 = 0 THEN issue - 5 ELSE issue + 30 END AS due,
           CASE WHEN ok % 103 <> 0 THEN s END AS subtotal, tax + CASE WHEN ok % 89 = 0 THEN 100 ELSE 0 END AS tax_amount, s + tax + (ok % 40 = 9)::INT AS total_amount, upper(trim(number)) AS nkey
    FROM sent),
ex AS (SELECT a.arrival, b.arrival AS other FROM inv a JOIN inv b ON a.pid = b.pid AND a.nkey = b.nkey AND b.arrival < a.arrival),
ne AS (SELECT a.arrival, b.arrival AS other FROM inv a JOIN inv b ON a.pid = b.pid AND a.total_amount = b.total_amount AND a.nkey <> b.nkey AND abs(a.issued - b.issued) <= 7 AND b.arrival < a.arrival),
dup AS (
    SELECT inv.arrival, (SELECT min(other) FROM ex WHERE ex.arrival = inv.arrival) AS dup_exact FROM inv),
near AS (SELECT dup.arrival, dup.dup_exact, count(ne.other) FILTER (dup.dup_exact IS NULL OR ne.other < dup.dup_exact) AS n_near FROM dup LEFT JOIN ne ON ne.arrival = dup.arrival GROUP BY ALL),
laddered AS (
    SELECT inv.*, dup_exact, n_near, list_filter([
        {'name': 'extraction.lines_present', 'severity': 'BLOCKER', 'passed': n > 0},
        {'name': 'fields.invoice_number', 'severity': 'ERROR', 'passed': true},
        {'name': 'arithmetic.line_sum', 'severity': 'ERROR', 'passed': coalesce(n > 0 AND s = subtotal, false)},
        {'name': 'arithmetic.tax_per_code', 'severity': 'ERROR', 'passed': coalesce(n > 0 AND tax = tax_amount, false)},
        {'name': 'arithmetic.total', 'severity': 'ERROR', 'passed': coalesce(n > 0 AND subtotal IS NOT NULL AND s + tax = total_amount, false)},
        {'name': 'arithmetic.line_product', 'severity': 'WARN', 'passed': wrong = 0},
        {'name': 'partner.resolved', 'severity': 'BLOCKER', 'passed': pid IS NOT NULL},
        {'name': 'partner.agreement', 'severity': 'ERROR', 'passed': NOT conflict},
        {'name': 'partner.match_quality', 'severity': 'ERROR', 'passed': method <> 'FUZZY_NAME'},
        {'name': 'dedupe.exact', 'severity': 'BLOCKER', 'passed': dup_exact IS NULL},
        {'name': 'dedupe.near', 'severity': 'ERROR', 'passed': n_near = 0},
        {'name': 'dates.parsed', 'severity': 'ERROR', 'passed': due IS NOT NULL},
        CASE WHEN due IS NOT NULL THEN {'name': 'dates.order', 'severity': 'ERROR', 'passed': due >= issued} END,
        {'name': 'tax_code.known', 'severity': 'ERROR', 'passed': unknown = 0},
        {'name': 'fields.units_present', 'severity': 'WARN', 'passed': nounit = 0},
        CASE WHEN ok % 5 = 0 THEN {'name': 'grounding.values_present', 'severity': 'WARN', 'passed': ok % 35 <> 0} END,
        {'name': 'confidence.floor', 'severity': 'ERROR', 'passed': ok % 61 <> 0},
        {'name': 'handwriting.detected', 'severity': 'WARN', 'passed': ok % 29 <> 0 OR ok % 59 = 0},
        {'name': 'handwriting.on_payment_details', 'severity': 'ERROR', 'passed': ok % 59 <> 0},
        {'name': 'amount.threshold', 'severity': 'ERROR', 'passed': total_amount <= 400000}], lambda c: c IS NOT NULL) AS checks
    FROM inv JOIN near USING (arrival)),
judged AS (
    SELECT *, list_filter(checks, lambda c: NOT c.passed) AS bad,
           CASE WHEN len(list_filter(checks, lambda c: NOT c.passed AND c.severity = 'BLOCKER')) > 0 THEN 'BLOCKED'
                WHEN len(list_filter(checks, lambda c: NOT c.passed AND c.severity = 'ERROR')) > 0 THEN 'NEEDS_REVIEW' ELSE 'EXTRACTED' END AS status
    FROM laddered)
"""
OPERATIONS = """
WITH op AS (
    SELECT event_id AS arrival, user_id AS document_id, ts AS at, user_id * 0.001::DOUBLE AS cost_usd, CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 10) END::INTEGER AS latency_ms,
           CASE event_type WHEN 'purchase' THEN 'POSTED' WHEN 'view' THEN 'EXTRACTED' WHEN 'click' THEN 'NEEDS_REVIEW' WHEN 'error' THEN 'EXTRACT_FAILED' ELSE 'BLOCKED' END AS status
    FROM events)
"""


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "normalized", lambda: normalize.normalize(raw_invoices(spark, sf_dir)))


def normalized_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a query that takes a few of its columns: where the layer is not there yet, it is not stored for it, but
    every text of every invoice is read in one pass, and what was read is counted on the way."""
    held = stored_layer(spark, sf_dir, "normalized")
    return normalize.normalize(raw_invoices(spark, sf_dir)).observe("normalized", *normalize.read_counts()) if held is None else held


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells suppliers and duplicates, with the supplier; the rest of each invoice stays where it is."""
    return layer(spark, sf_dir, "matched", lambda: partners.resolve(normalized(spark, sf_dir).select(*partners.ASKED), master(spark, sf_dir)))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).join(matched(spark, sf_dir).select("arrival", *policy.MATCHED), "arrival")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "checked", lambda: verify.judge(matched(spark, sf_dir), PROJECTED_POLICY, rest=normalized(spark, sf_dir)))


# normalisation


@query("SELECT arrival, issued AS issue_date, due AS due_date FROM inv", TYPED)
def parse_date(spark, sf_dir):
    return normalized_once(spark, sf_dir).select("arrival", "issue_date", "due_date")


@query("SELECT arrival, subtotal, tax_amount, total_amount FROM inv", TYPED)
def parse_amount(spark, sf_dir):
    return normalized_once(spark, sf_dir).select("arrival", "subtotal", "tax_amount", "total_amount")


@query("SELECT arrival, number AS invoice_number, 'JPY' AS currency, CASE WHEN ok % 61 = 0 THEN 0.4 ELSE 0.95 END::DOUBLE AS min_confidence, ok % 59 = 0 OR ok % 29 = 0 AS has_handwriting, ok % 59 = 0 AS handwriting_affects_payment, CASE WHEN ok % 59 = 0 THEN 'new account (margin)' WHEN ok % 29 = 0 THEN 'received (margin)' ELSE '' END AS handwriting_notes FROM inv", TYPED)
def normalize_header(spark, sf_dir):
    return normalized_once(spark, sf_dir).select("arrival", "invoice_number", "currency", "min_confidence", "has_handwriting", "handwriting_affects_payment", "handwriting_notes")


@query("SELECT arrival, seq, 'Part ' || l_partkey AS description, quantity, unit, unit_price, amount, tax_code FROM inv JOIN ln ON ln.ok = inv.ok", TYPED)
def normalize_lines(spark, sf_dir):
    return normalized(spark, sf_dir).select("arrival", F.explode("lines").alias("x")).select("arrival", "x.*")


@query("SELECT tax_code, count(*) AS n_lines, sum(amount)::BIGINT AS amount FROM inv JOIN ln ON ln.ok = inv.ok GROUP BY tax_code", TYPED)
def line_tax_code(spark, sf_dir):
    lines = normalized(spark, sf_dir).select(F.explode("lines").alias("x"))
    return lines.groupBy("x.tax_code").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("x.amount").alias("amount"))


@query("SELECT arrival, (unknown > 0)::INTEGER AS n_unmapped FROM inv", TYPED)
def unmapped_rates(spark, sf_dir):
    return normalized(spark, sf_dir).select("arrival", F.size("unmapped_tax_rates").alias("n_unmapped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE round(l_tax * 100)::INTEGER WHEN 10 THEN 'T10' WHEN 8 THEN 'T08' END AS tax_code FROM lineitem")
def tax_code(spark, sf_dir):
    shown = F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("％"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") > F.lit(0.011), S.tax_code(shown)).alias("tax_code"))


@query("SELECT o_orderkey, floor((o_orderkey - 7500) * 0.1::DOUBLE)::BIGINT AS tax10, floor((7 * o_orderkey - 50000) * 0.08::DOUBLE)::BIGINT AS tax08 FROM orders")
def tax_floor(spark, sf_dir):
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", S.tax_for(key - 7500, F.lit("T10")).alias("tax10"), S.tax_for(7 * key - 50000, F.lit("T08")).alias("tax08"))


@query("SELECT c_custkey, 'T' || c_custkey || 'X' AS reg_key FROM customer")
def reg_key(spark, sf_dir):
    shown = F.concat(F.lit("Ｔ-"), F.col("c_custkey").cast("string"), F.lit(" x."))
    return read(spark, sf_dir, "customer").select("c_custkey", S.registration_key(shown).alias("reg_key"))


@query("SELECT c_custkey, lower(c_name) AS name_key FROM customer")
def name_key(spark, sf_dir):
    shown = F.concat(F.lit("㈱　"), F.col("c_name"), F.lit(" 株式会社 御中"))
    return read(spark, sf_dir, "customer").select("c_custkey", S.company_key(shown).alias("name_key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN array_to_string(list_filter(['payment details: ' || CASE o_orderkey % 5 WHEN 0 THEN 'supplier confirmed the printed account is correct; the pen was wrong' WHEN 1 THEN 'supplier confirmed the account changed' WHEN 2 THEN 'supplier could not be reached' ELSE 'something else' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'pay ' || o_orderkey END, CASE WHEN o_orderstatus <> 'F' THEN 'by phone ' || o_orderstatus END], lambda x: x IS NOT NULL), '; ') END AS payment_note FROM orders")
def payment_note(spark, sf_dir):
    key = F.col("o_orderkey")
    outcome = F.when(key % 5 == 0, "pay_printed").when(key % 5 == 1, "pay_altered").when(key % 5 == 2, "supplier_unreachable").when(key % 5 == 3, "something else")
    confirmed = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("by phone "), F.col("o_orderstatus"))).otherwise("")
    return read(spark, sf_dir, "orders").select("o_orderkey", S.payment_note(outcome, F.when(key % 3 != 0, key.cast("string")), confirmed).alias("payment_note"))


@query("SELECT tax_code, rate, count(ln.ok) AS n_lines FROM (VALUES ('T10', 0.1::DOUBLE), ('T08', 0.08::DOUBLE)) t(tax_code, rate) LEFT JOIN ln USING (tax_code) LEFT JOIN inv ON inv.ok = ln.ok GROUP BY ALL", TYPED)
def tax_codes(spark, sf_dir):
    """The tax-code dimension, with the lines of all invoices that use each code."""
    known = spark.createDataFrame([(code, rate) for code, rate in TAX_RATES.items()], "tax_code string, rate double")
    lines = normalized(spark, sf_dir).select(F.explode("lines").alias("x")).groupBy("x.tax_code").agg(F.count(F.lit(1)).alias("n_lines"))
    return known.join(lines, "tax_code", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0).cast("long")))


# intake


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, length(trim(coalesce(text, ''))) >= 40 AS has_text_layer FROM documents")
def intake_sha(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("sha256"), intake.has_text_layer(F.col("text")).alias("has_text_layer"))


@query("SELECT min(doc_id) AS arrival, sha256(coalesce(text, '')) AS sha256 FROM documents GROUP BY sha256(coalesce(text, ''))")
def intake_dedupe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("arrival"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return intake.new_documents(docs)


def chunk_of(kind: bytes, data: bytes):
    return F.unhex(F.lit((len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")).hex()))


PAGE_KINDS = "list_extract(['pdf', 'PNG', 'webp', 'exe', 'jpg'], (page_id % 5 + 1)::INTEGER)"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as if they had come as files of several types, every third of the pdf ones with an end mark."""
    kinds = F.array(*[F.lit(k) for k in ("pdf", "PNG", "webp", "exe", "jpg")])
    mark = F.when((F.col("page_id") % 5 == 0) & (F.col("page_id") % 3 == 0), F.concat(F.coalesce("html", F.lit("")), F.lit("%%EOF"))).otherwise(F.coalesce("html", F.lit("")))
    files = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/page "), F.col("page_id").cast("string"), F.lit("."), F.get(kinds, (F.col("page_id") % 5).cast("int"))).alias("path"), mark.cast("binary").alias("content"))
    return files.withColumn("length", F.length("content").cast("bigint"))


@query(f"""
    WITH f AS (SELECT page_id, {PAGE_KINDS} AS ext, coalesce(html, '') || CASE WHEN page_id % 15 = 0 THEN '%%EOF' ELSE '' END AS body FROM pages)
    SELECT page_id, 'page ' || page_id || '.' || ext AS filename,
           CASE lower(ext) WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime_type,
           CASE WHEN ext = 'exe' THEN 'unsupported type: exe' WHEN body = '' THEN 'the file is empty' WHEN ext = 'pdf' AND NOT contains(right(body, 2048), '%%EOF') THEN 'the PDF has no end mark'
                WHEN ext IN ('PNG', 'jpg') THEN 'the image is cut off' END AS reason,
           coalesce(ext = 'webp' AND body <> '' OR ext = 'pdf' AND contains(right(body, 2048), '%%EOF'), false) AS accepted
    FROM f""")
def intake_screen(spark, sf_dir):
    return intake.screen(page_files(spark, sf_dir)).select("page_id", "filename", "mime_type", "reason", "accepted")


@query(f"SELECT page_id, CASE WHEN coalesce(html, '') = '' AND page_id % 15 <> 0 THEN 'the file is empty' WHEN {PAGE_KINDS} = 'pdf' AND page_id % 3 <> 0 AND NOT contains(right(html, 2048), '%%EOF') THEN 'the PDF has no end mark' WHEN {PAGE_KINDS} IN ('PNG', 'jpg') THEN 'the image is cut off' END AS gap FROM pages")
def intake_complete(spark, sf_dir):
    return page_files(spark, sf_dir).select("page_id", intake.incomplete(F.col("content"), intake.suffix(F.col("path"))).alias("gap"))


@query("""
    SELECT page_id, CASE page_id % 4 WHEN 2 THEN CASE page_id % 3 WHEN 0 THEN 'the image is damaged' WHEN 2 THEN 'the PDF''s cross-reference is wrong' END
                                     WHEN 3 THEN CASE page_id % 3 WHEN 2 THEN 'the PDF has no end mark' ELSE 'the image is cut off' END END AS fault FROM pages""")
def intake_structure(spark, sf_dir):
    """The pages as PNG, JPEG and PDF files that hold their text; a quarter has a byte too many inside (which a JPEG's
    scan does not show), another lacks its last twelve bytes."""
    text, raw = F.coalesce("html", F.lit("")).cast("binary"), lambda h: F.unhex(F.lit(h))
    size = lambda b: F.unhex(F.lpad(F.hex(F.length(b).cast("bigint")), 8, "0"))
    ascii_ = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c]).cast("binary")
    note = F.concat(raw("7445587448544D4C00"), text)
    dot = zlib.compress(b"\0\0")
    png = F.concat(
        raw("89504E470D0A1A0A"), chunk_of(b"IHDR", bytes.fromhex("00000001000000010800000000")), size(F.concat(raw("48544D4C00"), text)), note,
        F.unhex(F.lpad(F.hex(F.crc32(note)), 8, "0")), chunk_of(b"IDAT", dot), chunk_of(b"IEND", b""),
    )
    jpg = F.concat(raw("FFD8FFC0000B080001000101011100FFDA0008010100003F00"), text, raw("FFD9"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n(").cast("binary"), text, F.lit(")\nendobj\n").cast("binary"))
    pdf = F.concat(body, ascii_("xref\n0 2\n0000000000 65535 f \n0000000009 00000 n \ntrailer\n<< /Size 2 >>\nstartxref\n", F.length(body).cast("string"), "\n%%EOF\n"))
    head = F.element_at(F.array(F.lit(41 + 4), F.lit(25), F.lit(18)), (F.col("page_id") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("png"), F.lit("jpg"), F.lit("pdf")), (F.col("page_id") % 3 + 1).cast("int"))
    whole = F.when(kind == "png", png).when(kind == "jpg", jpg).otherwise(pdf)
    files = read(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), head.alias("head"), whole.alias("whole"))
    some = lambda a, n: F.substring("whole", a, n)
    content = F.when(F.col("page_id") % 4 == 2, F.concat(some(F.lit(1), F.col("head")), F.lit("x").cast("binary"), some(F.col("head") + 1, F.length("whole")))).when(F.col("page_id") % 4 == 3, some(F.lit(1), F.length("whole") - 12)).otherwise(F.col("whole"))
    return files.select("page_id", structure.fault(content, F.col("kind")).alias("fault"))


@query("SELECT arrival, ok % 10 = 3 AS failed, CASE WHEN ok % 10 <> 3 THEN number END AS invoice_number, CASE WHEN ok % 10 <> 3 THEN n::INTEGER END AS n_lines FROM inv", TYPED)
def json_recover(spark, sf_dir):
    """Every invoice as a model's answer, fenced or wrapped in talk; every tenth is cut off."""
    raw = raw_invoices(spark, sf_dir)
    body = F.to_json(F.struct(*[c for c in raw.columns if c != "arrival"]))
    kind = F.col("arrival") % 1_000_000_000 % 10
    answer = F.when(kind == 3, F.substring(body, 1, 30)).when(kind < 3, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind < 6, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)
    both = intake.read_answers(raw.select("arrival", answer.alias("answer")))
    return both.select("arrival", "failed", F.when(~F.col("failed"), F.col("invoice_number")).alias("invoice_number"), F.when(~F.col("failed"), F.size("lines")).alias("n_lines"))


@query("SELECT format('P-{:06d}', c_custkey) AS partner_code, c_name AS name, replace(c_name, '#', '') AS alias, format('T{:013d}', c_custkey) AS registration_no FROM customer WHERE c_custkey % 50 <> 0")
def partners_scan(spark, sf_dir):
    return master(spark, sf_dir).select("partner_code", "name", F.get("aliases", F.lit(0)).alias("alias"), "registration_no")


# matching and duplicates


@query("SELECT arrival, format('P-{:06d}', rp) AS by_reg FROM inv WHERE rp IS NOT NULL", TYPED)
def match_reg(spark, sf_dir):
    keyed = normalized(spark, sf_dir).select("arrival", S.registration_key(F.col("registration_no")).alias("reg_key"))
    return keyed.join(partners.registration_index(master(spark, sf_dir)), "reg_key").select("arrival", "by_reg")


@query("SELECT arrival, format('P-{:06d}', np) AS by_name, nm AS name_method FROM inv WHERE nm IN ('EXACT_NAME', 'ALIAS')", TYPED)
def match_name(spark, sf_dir):
    keyed = normalized(spark, sf_dir).select("arrival", S.company_key(F.col("supplier_name")).alias("name_key"))
    return keyed.join(partners.name_index(master(spark, sf_dir)), "name_key").select("arrival", "by_name", "name_method")


@query("SELECT DISTINCT nk AS name_key, format('P-{:06d}', np) AS by_name, round(200.0 * length(nk) / (2 * length(nk) + 1), 1)::DOUBLE AS score FROM inv WHERE nm = 'FUZZY_NAME'", TYPED)
def match_fuzzy(spark, sf_dir):
    keyed = normalized(spark, sf_dir).select(S.company_key(F.col("supplier_name")).alias("name_key")).distinct()
    people = master(spark, sf_dir)
    missed = keyed.join(partners.name_index(people), "name_key", "left_anti")
    return partners.fuzzy_matches(missed, people).select("name_key", "by_name", "score")


@query("SELECT arrival, partner_code, method, NOT conflict AS agreement, (CASE WHEN conflict THEN 0 WHEN rp IS NOT NULL THEN CASE WHEN np = rp THEN 1.0 ELSE 0.92 END WHEN np IS NOT NULL THEN CASE nm WHEN 'EXACT_NAME' THEN 0.95 WHEN 'ALIAS' THEN 0.90 ELSE 0.60 END ELSE 0 END)::DOUBLE AS match_confidence FROM inv", TYPED)
def resolve(spark, sf_dir):
    return matched(spark, sf_dir).select("arrival", "partner_code", "method", "agreement", "match_confidence")


@query("SELECT arrival, other, 'exact' AS kind FROM ex UNION ALL SELECT arrival, other, 'near' FROM ne", TYPED)
def dup_candidates(spark, sf_dir):
    rows = matched(spark, sf_dir)
    return dedupe.candidates(rows, rows)


@query("SELECT arrival, dup_exact, n_near::INTEGER AS n_near FROM near WHERE dup_exact IS NOT NULL OR arrival IN (SELECT arrival FROM ne)", TYPED)
def duplicates(spark, sf_dir):
    rows = matched(spark, sf_dir)
    return dedupe.find_duplicates(rows, rows).select("arrival", "dup_exact", F.size("dup_near").alias("n_near"))


@query("SELECT a.arrival, count(*) AS n_near FROM inv a JOIN inv b ON a.pid = b.pid AND a.total_amount = b.total_amount AND a.nkey <> b.nkey AND abs(a.issued - b.issued) <= 7 AND b.arrival <> a.arrival GROUP BY a.arrival", TYPED)
def near_counts(spark, sf_dir):
    rows = matched(spark, sf_dir)
    return dedupe.near_counts(rows, rows).select("arrival", "n_near")


# amounts and checks


@query("SELECT arrival, s AS line_sum, b10 AS base_t10, b08 AS base_t08, tax AS expected_tax, s + tax AS expected_total, wrong::INTEGER AS mismatches, nounit::INTEGER AS missing_units, (unknown > 0)::INTEGER AS unknown_codes FROM inv", TYPED)
def expected_total(spark, sf_dir):
    c = checks
    return normalized(spark, sf_dir).select(
        "arrival", c.line_sum().alias("line_sum"), c.base_of("T10").alias("base_t10"), c.base_of("T08").alias("base_t08"), c.expected_tax().alias("expected_tax"), c.expected_total().alias("expected_total"),
        F.size(c.line_mismatches()).alias("mismatches"), F.size(c.missing_units()).alias("missing_units"), F.size(c.unknown_codes()).alias("unknown_codes"),
    )


@query("SELECT arrival, tax_code, sum(amount)::BIGINT AS base, floor(sum(amount) * CASE tax_code WHEN 'T10' THEN 0.1::DOUBLE WHEN 'T08' THEN 0.08::DOUBLE END)::BIGINT AS tax FROM inv JOIN ln ON ln.ok = inv.ok GROUP BY arrival, tax_code", TYPED)
def tax_base(spark, sf_dir):
    lines = normalized_once(spark, sf_dir).select("arrival", F.explode("lines").alias("x")).groupBy("arrival", "x.tax_code").agg(F.sum("x.amount").alias("base"))
    return lines.withColumn("tax", S.tax_for(F.col("base"), F.col("tax_code")))


@query("SELECT arrival, unnest(checks, recursive := true) FROM judged", TYPED)
def checks_long(spark, sf_dir):
    return checks.long_checks(checked(spark, sf_dir)).select("arrival", "name", "severity", "passed")


def _check_queries() -> None:
    for i, name in enumerate(checks.NAMES[:20], 1):
        def one(spark, sf_dir, name=name):
            return checks.long_checks(checked(spark, sf_dir)).filter(F.col("name") == name).select("arrival", "severity", "passed")

        QUERIES[f"check_{i}"] = one
        ORACLES[f"check_{i}"] = f"{TYPED} SELECT arrival, c.severity AS severity, c.passed AS passed FROM (SELECT arrival, unnest(checks) AS c FROM judged) WHERE c.name = '{name}'"


_check_queries()


@query("""
    WITH d AS (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents)
    SELECT doc_id, contains(regexp_replace(d.text, '[\\s,，、]', '', 'g'), regexp_replace(b.text, '[\\s,，、]', '', 'g')) AS grounded FROM d JOIN benchmark b USING (item_id)""")
def grounded_passages(spark, sf_dir):
    probes = read(spark, sf_dir, "benchmark").select("item_id", S.folded(F.col("text")).alias("probe"))
    docs = read(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % probes.count())
    return docs.join(probes, "item_id").select("doc_id", (F.instr(S.folded(F.col("text")), F.col("probe")) > 0).alias("grounded"))


@query("SELECT arrival, status, coalesce(list_filter(bad, lambda c: c.severity = 'BLOCKER')[1].name, list_filter(bad, lambda c: c.severity = 'ERROR')[1].name) AS because FROM judged", TYPED)
def disposition(spark, sf_dir):
    first = lambda s: F.get(checks.failed(F.col("checks"), s), F.lit(0))["name"]
    return checked(spark, sf_dir).select("arrival", "status", F.coalesce(first("BLOCKER"), first("ERROR")).alias("because"))


@query("SELECT status, count(*) AS invoices FROM judged GROUP BY status", TYPED)
def dispositions(spark, sf_dir):
    return report.status_counts(checked(spark, sf_dir))


@query("SELECT arrival, array_to_string(list_transform(list_concat(list_filter(bad, lambda c: c.severity = 'BLOCKER'), list_filter(bad, lambda c: c.severity = 'ERROR'), list_filter(bad, lambda c: c.severity = 'WARN')), lambda c: c.name), ',') AS failed FROM judged", TYPED)
def failed_sorted(spark, sf_dir):
    return checked(spark, sf_dir).select("arrival", F.array_join(checks.failed_sorted(F.col("checks")), ",").alias("failed"))


@query("SELECT arrival, status, CASE status WHEN 'BLOCKED' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 4 END AS rank, partner_code, number AS invoice_number, issued AS issue_date, due AS due_date, total_amount, len(bad)::INTEGER AS failed_checks FROM judged", TYPED)
def queue(spark, sf_dir):
    return report.queue(checked(spark, sf_dir)).drop("supplier_name", "reason")


RANKED = "CASE status WHEN 'BLOCKED' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 4 END"


def ordered_queue(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the work queue, kept in its order."""
    path = run_folder(spark)
    ordered.write_ordered(report.queue(checked(spark, sf_dir)), path, "rank", "arrival")
    return path


@query(f"SELECT arrival, status, row_number() OVER (ORDER BY {RANKED}, arrival) AS place FROM judged", TYPED)
def queue_order(spark, sf_dir):
    """Every invoice's place in the stored queue, by file and position in it."""
    return ordered.placed(spark, ordered_queue(spark, sf_dir), "rank").select("arrival", "status", "place")


@query(f"SELECT arrival, ((row_number() OVER (ORDER BY {RANKED}, arrival) - 1) // 100 + 1)::INTEGER AS page FROM judged WHERE {RANKED} >= 1 ORDER BY {RANKED}, arrival LIMIT 300", TYPED)
def queue_pages(spark, sf_dir):
    """Three pages of 100 from the first invoice that needs review, each by the last key of the one before."""
    path, after, pages = ordered_queue(spark, sf_dir), (0, 2 * LATER), []
    for i in range(3):
        page = ordered.page(spark, path, "rank", "arrival", 100, after)
        pages.append(page.select("arrival", F.lit(i + 1).alias("page")))
        last = page.agg(F.max(F.struct("rank", "arrival")).alias("last")).first()["last"]
        after = tuple(last) if last else after
    return pages[0].unionAll(pages[1]).unionAll(pages[2])


@query("""SELECT judged.arrival, status, (SELECT array_to_string(list(seq || ':' || 'Part ' || l_partkey || ':' || amount || ':' || tax_code ORDER BY seq), ',') FROM ln WHERE ln.ok = judged.ok) AS lines,
       array_to_string(list_transform(list_concat(list_filter(bad, lambda c: c.severity = 'BLOCKER'), list_filter(bad, lambda c: c.severity = 'ERROR'), list_filter(bad, lambda c: c.severity = 'WARN')), lambda c: c.name), ',') AS failed, len(checks)::INTEGER AS n_checks FROM judged""", TYPED)
def detail_text(spark, sf_dir):
    """Every invoice's nested lines and its failed checks in the order of its detail page, as text."""
    rows = report.detail(checked(spark, sf_dir))
    line = F.transform("lines", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["description"], x["amount"].cast("string"), x["tax_code"]))
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"])
    return rows.select("arrival", "status", F.when(F.size("lines") > 0, F.array_join(line, ",")).alias("lines"), F.array_join(failed, ",").alias("failed"), F.size("checks").alias("n_checks"))


@query("SELECT o_orderkey, (SELECT array_to_string(list(seq || ':' || q ORDER BY seq), ',') FROM ln0 WHERE ok = o_orderkey) AS parts FROM orders", TYPED)
def assemble(spark, sf_dir):
    """Orders with their lines as children."""
    lines = typed_lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "seq", "q")
    both = report.assemble(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", lines=(lines, "seq"))
    shown = F.transform("lines", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["q"].cast("string")))
    return both.select("o_orderkey", F.when(F.size("lines") > 0, F.array_join(shown, ",")).alias("parts"))


@query()
def invoice_detail(spark, sf_dir):
    return report.detail(checked(spark, sf_dir)).select("arrival", "status", "lines", "checks")


# registration


@query("SELECT arrival, CASE WHEN pid IS NULL THEN 'partner_code' WHEN n = 0 THEN 'lines' WHEN due IS NULL THEN 'dates' END AS gap, s AS subtotal, tax AS tax_amount, s + tax AS total_amount, strftime(issued, '%Y-%m-%d') AS issue_date, n::INTEGER AS n_lines FROM inv", TYPED)
def payload(spark, sf_dir):
    return ledger.build_payload(resolved(spark, sf_dir)).select("arrival", "gap", "subtotal", "tax_amount", "total_amount", "issue_date", F.size("lines").alias("n_lines"))


#: Every invoice without a gap, with its number in capitals so that twins collide.
ADMITTED = (
    TYPED
    + """, req AS (SELECT arrival, pid, upper(number) AS number, CASE WHEN unknown > 0 THEN 'UNKNOWN_TAX_CODE' WHEN due < issued THEN 'DUE_DATE_BEFORE_ISSUE_DATE' END AS fault FROM inv WHERE pid IS NOT NULL AND n > 0 AND due IS NOT NULL),
    won AS (SELECT pid, number, min(arrival) AS winner FROM req WHERE fault IS NULL GROUP BY ALL),
    ans AS (SELECT req.*, CASE WHEN arrival > winner THEN 'DUPLICATE_INVOICE' ELSE fault END AS error_code FROM req LEFT JOIN won ON won.pid = req.pid AND won.number = req.number)"""
)


def answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def build() -> DataFrame:
        requests = ledger.build_payload(resolved(spark, sf_dir)).filter("gap is null").drop("gap").withColumn("invoice_number", F.upper("invoice_number"))
        return ledger.admit(requests, master(spark, sf_dir))[0]

    answers = layer(spark, sf_dir, "answers", build)
    return answers, ledger.records_of(answers)


@query("SELECT arrival, error_code, CASE WHEN error_code IS NULL THEN 201 WHEN error_code = 'DUPLICATE_INVOICE' THEN 409 ELSE 400 END AS response_status, CASE WHEN error_code IS NULL THEN 'ACC-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') END AS accounting_id FROM (SELECT *, row_number() OVER (PARTITION BY error_code IS NULL ORDER BY arrival) AS n FROM ans)", ADMITTED)
def ledger_admit(spark, sf_dir):
    return answered(spark, sf_dir)[0].select("arrival", "error_code", "response_status", "accounting_id")


@query("SELECT CASE WHEN error_code IS NULL THEN 'POSTED' WHEN error_code = 'DUPLICATE_INVOICE' THEN 'BLOCKED' ELSE 'NEEDS_REVIEW' END AS status, count(*) AS invoices FROM ans GROUP BY ALL", ADMITTED)
def post_status(spark, sf_dir):
    return answered(spark, sf_dir)[0].groupBy(ledger.status_after(F.col("error_code")).alias("status")).agg(F.count(F.lit(1)).alias("invoices"))


#: Requests with a foreign supplier or a wrong total now and then, against a ledger that holds some of them already.
FAULTY = (
    TYPED
    + """, r AS (SELECT arrival, pid, CASE WHEN arrival % 31 = 0 THEN 'P-999999' ELSE partner_code END AS pc, upper(number) AS number, unknown, due, issued FROM inv WHERE pid IS NOT NULL AND n > 0 AND due IS NOT NULL),
    held AS (SELECT DISTINCT pc, number FROM r WHERE arrival % 37 = 0),
    ruled AS (SELECT r.*, held.pc IS NOT NULL AS is_held, CASE WHEN arrival % 31 = 0 THEN 'PARTNER_NOT_FOUND' WHEN unknown > 0 THEN 'UNKNOWN_TAX_CODE' WHEN due < issued THEN 'DUE_DATE_BEFORE_ISSUE_DATE' WHEN arrival % 29 = 0 THEN 'AMOUNT_MISMATCH' END AS fault
              FROM r LEFT JOIN held ON held.pc = r.pc AND held.number = r.number),
    won AS (SELECT pc, number, min(arrival) AS winner FROM ruled WHERE fault IS NULL AND NOT is_held GROUP BY ALL)"""
)


@query("SELECT arrival, CASE WHEN is_held OR coalesce(arrival > winner, false) THEN 'DUPLICATE_INVOICE' ELSE fault END AS error_code FROM ruled LEFT JOIN won ON won.pc = ruled.pc AND won.number = ruled.number", FAULTY)
def ledger_rules(spark, sf_dir):
    """All four rules and duplicates of a ledger that already holds records."""
    sent = ledger.build_payload(resolved(spark, sf_dir)).filter("gap is null").drop("gap").withColumn("invoice_number", F.upper("invoice_number"))
    sent = sent.withColumn("partner_code", F.when(F.col("arrival") % 31 == 0, "P-999999").otherwise(F.col("partner_code"))).withColumn("total_amount", F.col("total_amount") + F.when(F.col("arrival") % 29 == 0, 1).otherwise(0))
    held = sent.filter("arrival % 37 = 0").select(*ledger.KEY)
    return ledger.judge(sent, master(spark, sf_dir), held).select("arrival", "error_code")


@query("SELECT arrival, CASE WHEN arrival % 13 = 0 THEN 'due_date must be YYYY-MM-DD' WHEN arrival % 19 = 0 THEN 'due_date is no real date' WHEN arrival % 11 = 0 THEN 'only JPY is taken' WHEN arrival % 23 = 0 THEN 'tax_amount must be whole' WHEN arrival % 17 = 0 THEN 'there must be a line' WHEN nounit > 0 AND arrival % 3 = 0 THEN 'line' END AS shape FROM inv WHERE pid IS NOT NULL AND n > 0 AND due IS NOT NULL", TYPED)
def ledger_shape(spark, sf_dir):
    """The first fault of each request's shape; lines without a unit are sent as they are for every third."""
    every = lambda n: F.col("arrival") % n == 0
    sent = ledger.build_payload(resolved(spark, sf_dir)).filter("gap is null").drop("gap")
    bare = F.transform("lines", lambda x: x.withField("unit", F.when((x["unit"] == FALLBACK_UNIT) & every(3), "").otherwise(x["unit"])))
    changes = {
        "due_date": F.when(every(13), "26-01-01").when(every(19), "2026-02-30").otherwise(F.col("due_date")), "currency": F.when(every(11), "USD").otherwise(F.col("currency")),
        "tax_amount": F.when(~every(23), F.col("tax_amount")), "lines": F.when(every(17), F.slice("lines", 1, 0)).otherwise(bare),
    }
    return sent.withColumns(changes).select("arrival", F.regexp_replace(ledger.shape_error(), "^line .*", "line").alias("shape"))


@query("SELECT arrival, 'BLOCKER' AS severity, false AS passed, 'the ledger refused it: DUPLICATE_INVOICE ' || number AS message FROM judged WHERE status = 'EXTRACTED' AND arrival % 3 = 0", TYPED)
def check_21(spark, sf_dir):
    """Clean invoices sent to a ledger that holds a third of them: the refusals as checks."""
    clean = checked(spark, sf_dir)
    held = clean.filter("status = 'EXTRACTED' and arrival % 3 = 0").select(F.lit("ACC-0").alias("accounting_id"), *ledger.KEY)
    done, _ = verify.register(clean, master(spark, sf_dir), held, PROJECTED_POLICY)
    return checks.long_checks(done).filter("name = 'accounting.accepted'").select("arrival", "severity", "passed", "message")


@query("SELECT arrival, CASE WHEN error_code IS NULL THEN 'ACC-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') END AS accounting_id FROM (SELECT *, row_number() OVER (PARTITION BY error_code IS NULL ORDER BY arrival) AS n FROM ans) WHERE arrival IN (SELECT arrival FROM judged)", ADMITTED)
def queue_registered(spark, sf_dir):
    """Queue rows with the ledger's number of the first posting that went through, the first try of some having failed."""
    answers, _ = answered(spark, sf_dir)
    again = ledger.postings(answers)
    lost = again.filter("arrival % 7 = 0").withColumns({"accounting_id": F.lit(None).cast("string"), "succeeded": F.lit(False)})
    later = ledger.postings(answers.filter("arrival % 7 = 0"), lost)
    rows = report.queue(checked(spark, sf_dir), again.filter("arrival % 7 <> 0").unionByName(lost).unionByName(later))
    return rows.join(answers.select("arrival"), "arrival", "left_semi").select("arrival", "accounting_id")


@query("SELECT arrival, 1 AS attempt, error_code IS NULL AS succeeded FROM ans", ADMITTED)
def postings(spark, sf_dir):
    return ledger.postings(answered(spark, sf_dir)[0]).select("arrival", "attempt", "succeeded")


@query("SELECT CASE WHEN status = 'EXTRACTED' THEN 'POSTED' ELSE status END AS status, count(*) AS invoices FROM judged GROUP BY ALL", TYPED)
def auto_gate(spark, sf_dir):
    done, _ = verify.register(checked(spark, sf_dir), master(spark, sf_dir), policy=PROJECTED_POLICY)
    return report.status_counts(done)


@query("SELECT count(*) AS sent, 0 AS mismatches FROM judged WHERE status = 'EXTRACTED'", TYPED)
def preflight_parity(spark, sf_dir):
    """Clean invoices sent with their printed amounts: the ledger must find no fault in any."""
    clean = checked(spark, sf_dir).filter("status = 'EXTRACTED'")
    printed = clean.select("arrival", *[F.col(c).alias(f"p_{c}") for c in ("subtotal", "tax_amount", "total_amount")])
    sent = ledger.build_payload(clean).drop("gap").join(printed, "arrival").withColumns({c: F.col(f"p_{c}") for c in ("subtotal", "tax_amount", "total_amount")})
    judged = ledger.judge(sent, master(spark, sf_dir))
    return judged.agg(F.count(F.lit(1)).alias("sent"), F.count(F.when(F.col("error_code") == "AMOUNT_MISMATCH", 1)).cast("int").alias("mismatches"))


@query("SELECT arrival, CASE WHEN error_code IS NULL THEN 'POSTED' ELSE 'POST_FAILED' END AS status FROM ans WHERE error_code IS NULL OR error_code <> 'DUPLICATE_INVOICE'", ADMITTED)
def confirm(spark, sf_dir):
    """Requests that broke no uniqueness rule, had their answers been lost."""
    answers, records = answered(spark, sf_dir)
    pending = answers.filter("error_code is null or error_code <> 'DUPLICATE_INVOICE'").select("arrival", *ledger.KEY)
    return ledger.confirm(pending, records).select("arrival", "status")


@query("SELECT format('P-{:06d}', pid) AS partner_code, number AS invoice_number, 'ledger only' AS side FROM ans WHERE error_code IS NULL AND arrival % 17 = 0", ADMITTED)
def ledger_drift(spark, sf_dir):
    """What the ledger holds beyond ours, had every seventeenth posting been forgotten."""
    answers, records = answered(spark, sf_dir)
    return ledger.drift(answers.filter("error_code is null and arrival % 17 <> 0"), records)


@query("SELECT 0::BIGINT AS repeated FROM ans LIMIT 1", ADMITTED)
def uniqueness(spark, sf_dir):
    return report.duplicate_keys(answered(spark, sf_dir)[1], *ledger.KEY).agg(F.count(F.lit(1)).alias("repeated"))


#: The rows that each rule of a table lets through once only, with what tells them apart.
KEPT_ONCE = """
, shown AS (SELECT arrival, partner_code, nkey, s + tax <> total_amount AS off FROM inv),
put AS (
    SELECT 'documents' AS source, 'content' AS rule, doc_id AS id, rank() OVER w > 1 OR count(*) OVER (PARTITION BY coalesce(text, ''), doc_id) > 1 AS broken FROM documents WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id)
    UNION ALL SELECT 'lines', 'line', l_orderkey, rank() OVER w > 1 OR count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) > 1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey)
    UNION ALL SELECT 'invoices', 'number', arrival, partner_code IS NOT NULL AND rank() OVER w > 1 FROM shown WINDOW w AS (PARTITION BY partner_code, nkey ORDER BY arrival)
    UNION ALL SELECT 'invoices', 'amount', arrival, coalesce(off, false) FROM shown)
"""


def guarded(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame, dict[str, int]]]:
    """Documents by content, lines by invoice and number, invoices by supplier and number and by their total: each
    table written with its rules watched. Every row's id is kept as id."""
    out = run_folder(spark)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey")
    rows = checked(spark, sf_dir).select(F.col("arrival").alias("id"), "partner_code", S.number_key(F.col("invoice_number")).alias("number"), (checks.expected_total() != F.col("total_amount")).alias("off"))
    return {
        "documents": guards.store_guarded(docs, f"{out}/documents", "id", {"content": ("sha256",)}),
        "lines": guards.store_guarded(lines, f"{out}/lines", "l_partkey", {"line": ("id", "l_linenumber")}),
        "invoices": guards.store_guarded(rows, f"{out}/invoices", "id", {"number": ("partner_code", "number")}, {"amount": F.col("off")}),
    }


@query(f"SELECT source, id, array_to_string(list_sort(list(rule)), ',') AS rules FROM (SELECT source, id, rule FROM put WHERE broken AND source <> 'lines') GROUP BY source, id UNION ALL SELECT source, id, rule FROM put WHERE broken AND source = 'lines'", f"{TYPED}{KEPT_ONCE}")
def set_apart(spark, sf_dir):
    """The rows that break a rule of their table."""
    parts = [apart.select(F.lit(name).alias("source"), "id", F.array_join("rules_broken", ",").alias("rules")) for name, (_, apart, _) in guarded(spark, sf_dir).items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT source, rule, count(*) AS held, count(*) FILTER (broken) AS breaks FROM put GROUP BY source, rule", f"{TYPED}{KEPT_ONCE}")
def rule_counts(spark, sf_dir):
    """What the writing jobs counted: rows and breaks of each rule."""
    told = [(name, rule, counts["rows"], n) for name, (_, _, counts) in guarded(spark, sf_dir).items() for rule, n in counts.items() if rule != "rows"]
    return spark.createDataFrame(told, "source string, rule string, held bigint, breaks bigint")


# review and policy


def approvals(invoices: DataFrame) -> DataFrame:
    key = F.col("arrival")
    return invoices.filter("arrival % 4 = 1").select("arrival", F.concat(F.lit("reviewer "), (key % 3).cast("string")).alias("actor"), F.when(key % 2 == 1, "pay_printed").alias("outcome"), F.lit("seen").alias("note"))


APPROVED = TYPED + ", app AS (SELECT *, 'reviewer ' || (arrival % 3) AS actor, list_filter(bad, lambda c: c.severity = 'ERROR') AS over FROM judged WHERE arrival % 4 = 1)"


@query("SELECT arrival, actor, CASE WHEN status = 'BLOCKED' THEN 'blocked' ELSE 'send' END AS result, 'seen; payment details: supplier confirmed the printed account is correct; the pen was wrong' || CASE WHEN len(over) > 0 THEN '; overrode ' || len(over) || ' check(s): ' || array_to_string(list_transform(over, lambda c: c.name), ', ') ELSE '' END AS event_note FROM app", APPROVED)
def apply_approvals(spark, sf_dir):
    rows = checked(spark, sf_dir)
    return review.judge_approvals(rows, approvals(rows)).select("arrival", "actor", "result", "event_note")


@query("SELECT actor, name, count(*) AS times FROM (SELECT actor, unnest(over).name AS name FROM app WHERE status <> 'BLOCKED') GROUP BY ALL", APPROVED)
def override_report(spark, sf_dir):
    rows = checked(spark, sf_dir)
    return review.override_report(review.judge_approvals(rows, approvals(rows)))


@query("SELECT arrival, CASE WHEN arrival % 6 = 0 THEN 'REJECTED' ELSE status END AS status FROM judged", TYPED)
def apply_rejects(spark, sf_dir):
    rows = checked(spark, sf_dir)
    twice = rows.filter("arrival % 6 = 0").select("arrival", F.lit(None).cast("string").alias("note"), F.explode(F.array(F.lit(1), F.lit(2))).alias("event_id"))
    return review.apply_rejects(rows, twice).select("arrival", "status")


@query("SELECT arrival, CASE WHEN arrival % 10 = 4 THEN 'edited ' || arrival ELSE number END AS invoice_number, total_amount, (CASE WHEN arrival % 10 = 4 THEN 1 ELSE n END)::INTEGER AS n_lines FROM judged", TYPED)
def apply_edits(spark, sf_dir):
    rows = checked(spark, sf_dir)
    line = F.array(F.struct(F.lit("all").alias("description"), F.lit(1).cast("bigint").alias("quantity"), F.lit("").alias("unit"), F.col("total_amount").alias("unit_price"), F.col("total_amount").alias("amount"), F.lit("T10").alias("tax_code")))
    edits = rows.filter("arrival % 10 = 4").select("arrival", F.lit("reviewer").alias("actor"), F.concat(F.lit("edited "), F.col("arrival").cast("string")).alias("patch_invoice_number"), F.lit(None).cast("bigint").alias("patch_total_amount"), line.alias("patch_lines"), F.lit(2).alias("event_id"))
    before = edits.withColumns({"event_id": F.lit(1), "patch_invoice_number": F.lit("first try"), "patch_lines": F.lit(None).cast(edits.schema["patch_lines"].dataType)})
    edits = before.unionByName(edits)
    return review.apply_edits(rows, edits)[0].select("arrival", "invoice_number", "total_amount", F.size("lines").alias("n_lines"))


#: Every open invoice judged again among all others, with the limit at another height.
AGAIN = (
    TYPED
    + """, ex2 AS (SELECT a.arrival, min(b.arrival) AS other FROM inv a JOIN inv b ON a.pid = b.pid AND a.nkey = b.nkey AND b.arrival <> a.arrival GROUP BY ALL),
    ne2 AS (SELECT a.arrival, count(*) FILTER (ex2.other IS NULL OR b.arrival < ex2.other) AS k FROM inv a JOIN inv b ON a.pid = b.pid AND a.total_amount = b.total_amount AND a.nkey <> b.nkey AND abs(a.issued - b.issued) <= 7 AND b.arrival <> a.arrival
            LEFT JOIN ex2 ON ex2.arrival = a.arrival GROUP BY a.arrival),
    again AS (
        SELECT judged.arrival, status AS was,
               len(list_filter(bad, lambda c: c.severity = 'BLOCKER' AND c.name <> 'dedupe.exact')) > 0 OR ex2.other IS NOT NULL AS blocked,
               len(list_filter(bad, lambda c: c.severity = 'ERROR' AND c.name NOT IN ('dedupe.near', 'amount.threshold'))) > 0 OR coalesce(ne2.k, 0) > 0 OR total_amount > 250000 AS doubtful
        FROM judged LEFT JOIN ex2 ON ex2.arrival = judged.arrival LEFT JOIN ne2 ON ne2.arrival = judged.arrival)"""
)


@query("SELECT was, CASE WHEN blocked THEN 'BLOCKED' WHEN doubtful THEN 'NEEDS_REVIEW' ELSE 'EXTRACTED' END AS now, count(*) AS invoices FROM again GROUP BY ALL", AGAIN)
def policy_whatif(spark, sf_dir):
    return policy.what_if(checked(spark, sf_dir), PROJECTED_POLICY, {"amount_review_threshold": 250_000}, master(spark, sf_dir))


#: A grid of 600 policies, each judged by itself.
GRID = (
    TYPED
    + """, twin AS (SELECT DISTINCT a.arrival FROM inv a JOIN inv b ON a.pid = b.pid AND a.nkey = b.nkey AND b.arrival <> a.arrival),
    gap AS (SELECT a.arrival, min(abs(a.issued - b.issued)) AS days FROM inv a JOIN inv b ON a.pid = b.pid AND a.total_amount = b.total_amount AND a.nkey <> b.nkey AND b.arrival <> a.arrival GROUP BY a.arrival),
    base AS (
        SELECT status AS was, total_amount, CASE WHEN ok % 61 = 0 THEN 0.4 ELSE 0.95 END AS confidence, days, twin.arrival IS NOT NULL OR len(list_filter(bad, lambda c: c.severity = 'BLOCKER' AND c.name <> 'dedupe.exact')) > 0 AS blocked,
               len(list_filter(bad, lambda c: c.severity = 'ERROR' AND c.name NOT IN ('dedupe.near', 'amount.threshold', 'confidence.floor'))) > 0 AS doubtful
        FROM judged LEFT JOIN twin ON twin.arrival = judged.arrival LEFT JOIN gap ON gap.arrival = judged.arrival),
    grid AS (SELECT l.l, f.f, w.w FROM (SELECT unnest(range(0, 1000000, 10000)) AS l) l, (SELECT unnest([0.3, 0.8]) AS f) f, (SELECT unnest([0, 7, 30]) AS w) w)"""
)


@query(
    "SELECT l AS amount_review_threshold, f::DOUBLE AS confidence_floor, w::INTEGER AS duplicate_window_days, was, CASE WHEN blocked THEN 'BLOCKED' WHEN doubtful OR l <> 0 AND total_amount > l OR confidence < f OR coalesce(days <= w, false) THEN 'NEEDS_REVIEW' ELSE 'EXTRACTED' END AS now, count(*) AS invoices FROM base, grid GROUP BY ALL",
    GRID,
)
def policy_grid(spark, sf_dir):
    points = layer(spark, sf_dir, "breakpoints", lambda: policy.breakpoints(checked(spark, sf_dir), PROJECTED_POLICY, master(spark, sf_dir)))
    return policy.what_if_grid(points, range(0, 1_000_000, 10_000), (0.3, 0.8), (0, 7, 30))


# operating figures


@query("SELECT status, count(*) AS invoices FROM op GROUP BY status", OPERATIONS)
def status_counts(spark, sf_dir):
    return report.status_counts(operations(spark, sf_dir))


@query("SELECT CASE status WHEN 'POSTED' THEN 'registered' WHEN 'EXTRACTED' THEN 'clean' WHEN 'NEEDS_REVIEW' THEN 'needs review' WHEN 'EXTRACT_FAILED' THEN 'reading failed' ELSE 'blocked' END AS label, count(*) AS invoices FROM op GROUP BY ALL", OPERATIONS)
def status_report(spark, sf_dir):
    return report.status_report(operations(spark, sf_dir))


@query("SELECT count(*) AS calls, count(DISTINCT document_id) AS documents, round(sum(cost_usd), 6) AS cost_usd, round(sum(cost_usd) / count(*), 6) AS cost_per_call, floor(avg(latency_ms))::INTEGER AS latency_ms FROM op", OPERATIONS)
def cost_stats(spark, sf_dir):
    return report.cost_stats(operations(spark, sf_dir))


@query("SELECT list_sort(list(latency_ms))[len(list(latency_ms)) // 2 + 1] AS latency_median FROM op WHERE latency_ms <> 0", OPERATIONS)
def latency_median(spark, sf_dir):
    return report.upper_median(operations(spark, sf_dir))


@query("SELECT count(*) FILTER (status = 'POSTED' AND arrival % 7 = 0) AS after_review, count(*) FILTER (status = 'POSTED' AND arrival % 7 <> 0) AS automatic, count(*) AS total, round_even(count(*) FILTER (status = 'POSTED' AND arrival % 7 <> 0) / count(*), 4) AS auto_pass_rate, round(100 * round_even(count(*) FILTER (status = 'POSTED' AND arrival % 7 <> 0) / count(*), 4))::INTEGER AS auto_pass_pct FROM op", OPERATIONS)
def auto_pass(spark, sf_dir):
    rows = operations(spark, sf_dir)
    return report.auto_pass(rows, rows.filter("arrival % 7 = 0").select("arrival", F.lit("approve").alias("action")))


@query("SELECT arrival FROM op WHERE status = 'EXTRACT_FAILED'", OPERATIONS)
def retry_set(spark, sf_dir):
    return review.retry_set(operations(spark, sf_dir)).select("arrival")


@query("SELECT p.arrival AS event_id, c.arrival AS change_id FROM (SELECT * FROM op WHERE status = 'POSTED') p ASOF LEFT JOIN (SELECT * FROM op WHERE status = 'BLOCKED' AND document_id % 10 = 0) c ON p.at >= c.at", OPERATIONS)
def policy_asof(spark, sf_dir):
    rows = operations(spark, sf_dir)
    changes = rows.filter("status = 'BLOCKED' and document_id % 10 = 0").select(F.col("arrival").alias("change_id"), "at", F.col("latency_ms").alias("value"))
    return policy.in_force(rows.filter("status = 'POSTED'").select(F.col("arrival").alias("event_id"), "at"), changes).select("event_id", "change_id")


@query("SELECT arrival AS change_id FROM op WHERE status = 'BLOCKED' ORDER BY arrival DESC LIMIT 25", OPERATIONS)
def policy_history(spark, sf_dir):
    return policy.history(operations(spark, sf_dir).filter("status = 'BLOCKED'").select(F.col("arrival").alias("change_id")))


@query("SELECT name, count(*) AS failures FROM (SELECT unnest(bad).name AS name FROM judged) GROUP BY name", TYPED)
def check_copy(spark, sf_dir):
    bad = checks.long_checks(checked(spark, sf_dir)).filter("not passed")
    titled = bad.withColumn("title", F.coalesce(ledger.lookup(report.TITLES, F.col("name")), F.col("message")))
    return titled.groupBy("name").agg(F.count(F.lit(1)).alias("failures"))


# evaluation

EVALUATED = (
    TYPED
    + """, got AS (SELECT *, amount + (l_partkey % 19 = 0)::INT AS g_amount, seq = max(seq) OVER (PARTITION BY ok) AND ok % 23 = 0 AS dropped FROM ln),
    cmp AS (SELECT hdr.ok AS name, CASE WHEN hdr.ok % 2 = 0 THEN 'even' ELSE 'odd' END AS model, 7 AS fields_ok, count(seq) AS lines_expected, count(seq) FILTER (NOT dropped) AS lines_got,
                   count(seq) FILTER (NOT dropped AND g_amount = amount) AS lines_matched, coalesce(sum(g_amount) FILTER (NOT dropped), 0) = any_value(hdr.s) AS reconciles
            FROM hdr LEFT JOIN got ON got.ok = hdr.ok GROUP BY hdr.ok)"""
)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth part number or so read one too high, and last lines lost now and then."""
    typed = normalized(spark, sf_dir).filter("arrival < 1000000000").withColumnRenamed("arrival", "name")
    part = lambda x: F.regexp_extract(x["description"], "([0-9]+)", 1).cast("bigint")
    totals = {"subtotal": checks.line_sum(), "tax_amount": checks.expected_tax(), "total_amount": checks.expected_total()}
    truth = typed.withColumns(totals).select("name", *evals.FIELDS, "lines")
    read_ = F.transform("lines", lambda x: F.struct((x["amount"] + F.when(part(x) % 19 == 0, 1).otherwise(0)).alias("amount"), x["tax_code"].alias("tax_code")))
    lost = F.when(F.col("name") % 23 == 0, F.slice(read_, 1, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(read_)
    got = truth.withColumn("lines", lost).withColumn("model", F.when(F.col("name") % 2 == 0, "even").otherwise("odd")).withColumn("error", F.lit(None).cast("string"))
    return evals.compare(truth, got)


@query("SELECT model, name, fields_ok, lines_expected::INTEGER AS lines_expected, lines_got::INTEGER AS lines_got, lines_matched::INTEGER AS lines_matched, lines_matched = lines_expected AND lines_got = lines_expected AS lines_exact, reconciles FROM cmp", EVALUATED)
def eval_compare(spark, sf_dir):
    return compared(spark, sf_dir).drop("error")


@query("SELECT model, count(*) AS invoices, count(*) AS read, 1.0::DOUBLE AS field_accuracy, sum(lines_matched) / sum(lines_expected) AS line_accuracy, count(*) FILTER (lines_matched = lines_expected AND lines_got = lines_expected) AS perfect, count(*) FILTER (reconciles) AS reconciled FROM cmp GROUP BY model", EVALUATED)
def eval_score(spark, sf_dir):
    return evals.score(compared(spark, sf_dir))


# streams


def run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


@query("SELECT count(*) AS documents, min(first) AS first FROM (SELECT min(doc_id) AS first FROM documents GROUP BY text)")
def stream_intake(spark, sf_dir):
    """The documents as a stream of files, each content written once."""
    out = run_folder(spark)
    stream = spark.readStream.schema(read(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    arrivals.intake_stream(stream.select(F.col("doc_id").alias("arrival"), "text"), f"{out}/documents", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/documents").agg(F.count(F.lit(1)).alias("documents"), F.min("arrival").alias("first"))


@query("SELECT CASE WHEN status = 'EXTRACTED' THEN 'POSTED' ELSE status END AS status, count(*) AS invoices, count(*) FILTER (status = 'EXTRACTED') AS numbers FROM judged GROUP BY ALL", TYPED)
def stream_register(spark, sf_dir):
    """The transcriptions as they arrive in three deliveries, each verified and registered against those before it."""
    out, raw, people = run_folder(spark), raw_invoices(spark, sf_dir), master(spark, sf_dir)
    half = read(spark, sf_dir, "orders").agg(F.expr("max(o_orderkey) div 2")).first()[0] or 0
    for part in (F.col("arrival") <= half, (F.col("arrival") > half) & (F.col("arrival") < LATER), F.col("arrival") >= LATER):
        raw.filter(part).write.mode("append").parquet(f"{out}/raw")
        stream = spark.readStream.schema(raw.schema).parquet(f"{out}/raw")
        arrivals.register_stream(stream, people, out, PROJECTED_POLICY)[-1].awaitTermination()
    done = spark.read.parquet(f"{out}/invoices")
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("invoices"), F.countDistinct("accounting_id").alias("numbers"))


@query("SELECT status, count(*) AS invoices FROM op GROUP BY status", OPERATIONS)
def stream_status(spark, sf_dir):
    """Live counts of states over the events as a stream of files."""
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    name = f"states_{uuid.uuid4().hex}"
    arrivals.status_stream(as_operations(events), name).awaitTermination()
    return spark.table(name)


@query(
    "SELECT status, count(*) AS invoices, round(sum(cost_usd), 6) AS cost_usd, (SELECT list_sort(list(latency_ms))[len(list(latency_ms)) // 2 + 1] FROM op WHERE latency_ms <> 0) AS latency_median FROM op GROUP BY status",
    OPERATIONS,
)
def stream_figures(spark, sf_dir):
    """Invoices that arrive waiting, then are blocked at twice the cost, then take the state that they end in: counts,
    costs and the median as three deliveries of changes leave them."""
    out, rows = run_folder(spark), operations(spark, sf_dir)
    waiting = rows.withColumns({"version": F.lit(1), "status": F.lit("PENDING"), "latency_ms": F.lit(None).cast("int")})
    odd = rows.filter("arrival % 2 = 1").withColumns({"version": F.lit(2), "status": F.lit("BLOCKED"), "cost_usd": F.col("cost_usd") * 2, "latency_ms": F.lit(7)})
    for delivery in (waiting, odd, rows.withColumn("version", F.lit(3))):
        delivery.select("arrival", "version", *figures.CALL).write.mode("append").parquet(f"{out}/raw")
        stream = spark.readStream.schema(spark.read.parquet(f"{out}/raw").schema).parquet(f"{out}/raw")
        figures.figures_stream(stream, out).awaitTermination()
    done = figures.figures(spark, out)
    return figures.by_status(done).withColumn("_one", F.lit(1)).join(figures.latency_median(done).withColumn("_one", F.lit(1)), "_one").drop("_one")


def folded_sql() -> str:
    """Every open invoice as two turns of events and a change of policy leave it (see case_events)."""
    def judged(name: str, rows: str, others: str, limit: int = 400_000) -> str:
        # rows: the invoices judged, with their facts; others: all, as they were before
        return f"""{name}_d AS (
            SELECT a.arrival, coalesce(bool_or(a.nkey = b.nkey), false) AS twin,
                   coalesce(bool_or(a.nkey <> b.nkey AND a.total_amount = b.total_amount AND abs(a.issued - b.issued) <= 7), false) AS near
            FROM {rows} a LEFT JOIN {others} b ON a.pid = b.pid AND b.arrival <> a.arrival AND b.status <> 'REJECTED' AND (a.nkey = b.nkey OR a.total_amount = b.total_amount) GROUP BY a.arrival),
        {name} AS (
            SELECT a.* EXCLUDE (status), a.status AS was, n = 0 OR a.pid IS NULL OR twin AS blocked,
                   other OR unsure OR near OR due IS NULL OR coalesce(due < issued, false) OR total_amount > {limit} AS doubtful
            FROM {rows} a JOIN {name}_d USING (arrival))"""

    verdict = "CASE WHEN blocked THEN 'BLOCKED' WHEN doubtful THEN 'NEEDS_REVIEW' ELSE 'EXTRACTED' END"
    sent = "CASE WHEN unknown > 0 OR due < issued THEN 'NEEDS_REVIEW' ELSE 'POSTED' END"
    approved = f"CASE WHEN blocked THEN 'BLOCKED' WHEN kind = 'bare' AND pays THEN was WHEN due IS NULL THEN was ELSE {sent} END"
    said = "CASE WHEN blocked THEN 'blocked' WHEN kind = 'bare' AND pays THEN 'payment decision missing' WHEN due IS NULL THEN 'cannot be sent: dates' WHEN unknown > 0 THEN 'refused: UNKNOWN_TAX_CODE' WHEN due < issued THEN 'refused: DUE_DATE_BEFORE_ISSUE_DATE' ELSE 'registered' END"
    facts = "arrival, pid, number, nkey, total_amount, issued, due, n, unknown, other, unsure, pays, kind, status, result1, result2"
    step = lambda name, of, result, keep: f"{name} AS (SELECT arrival, pid, number, nkey, total_amount, issued, due, n, unknown, other, unsure, pays, kind, {of} AS status, {result} FROM {keep})"
    return (
        TYPED
        + f""", s0 AS (
            SELECT arrival, pid, number, nkey, total_amount, issued, due, n, unknown, ok % 59 = 0 AS pays, method = 'FUZZY_NAME' OR conflict AS unsure, status, NULL::VARCHAR AS result1, NULL::VARCHAR AS result2,
                   len(list_filter(bad, lambda c: c.severity = 'ERROR' AND c.name NOT IN ('dedupe.near', 'dates.parsed', 'dates.order', 'amount.threshold', 'partner.match_quality', 'partner.agreement'))) > 0 AS other,
                   CASE arrival % 12 WHEN 1 THEN 'edit' WHEN 2 THEN 'reject' WHEN 3 THEN 'late' WHEN 4 THEN 'twice' WHEN 5 THEN 'choose' WHEN 6 THEN 'bare' END AS kind
            FROM judged),
        a1 AS (SELECT * REPLACE (CASE WHEN kind = 'edit' THEN 'N' || arrival ELSE number END AS number, CASE WHEN kind = 'edit' THEN 'N' || arrival ELSE nkey END AS nkey,
                      CASE WHEN kind = 'choose' THEN 1 ELSE pid END AS pid, unsure AND NOT (kind = 'choose' AND coalesce(pid <> 1, true)) AS unsure) FROM s0 WHERE kind IN ('edit', 'twice', 'choose', 'bare')),
        {judged("j1", "a1", "s0")},
        {step("t1", f"CASE WHEN kind IN ('edit', 'choose') THEN {verdict} ELSE {approved} END", f"CASE WHEN kind IN ('edit', 'choose') THEN 'edited' ELSE {said} END AS result1, result2", "j1")},
        s1 AS (SELECT {facts} FROM t1 UNION ALL SELECT {facts} FROM (SELECT * REPLACE (CASE WHEN kind IN ('reject', 'late') THEN 'REJECTED' ELSE status END AS status, CASE WHEN kind IN ('reject', 'late') THEN 'rejected' END AS result1)
               FROM s0 WHERE kind IS NULL OR kind IN ('reject', 'late'))),
        a2 AS (SELECT * REPLACE (CASE WHEN kind = 'edit' THEN issued + 30 ELSE due END AS due) FROM s1 WHERE kind IN ('edit', 'late') OR kind = 'twice' AND status <> 'POSTED'),
        {judged("j2", "a2", "s1")},
        {step("t2", f"CASE WHEN kind = 'edit' THEN {verdict} ELSE {approved} END", f"result1, CASE WHEN kind = 'edit' THEN 'edited' ELSE {said} END AS result2", "j2")},
        s2 AS (SELECT {facts} FROM t2 UNION ALL SELECT {facts} FROM (SELECT * REPLACE (CASE kind WHEN 'twice' THEN 'already registered' WHEN 'reject' THEN 'rejected' END AS result2) FROM s1 WHERE arrival NOT IN (SELECT arrival FROM t2))),
        o AS (SELECT * FROM s2 WHERE status IN ('EXTRACTED', 'NEEDS_REVIEW', 'BLOCKED')),
        {judged("j3", "o", "s2", 250_000)},
        {step("t3", verdict, "result1, result2", "j3")},
        s3 AS (SELECT {facts} FROM t3 UNION ALL SELECT {facts} FROM s2 WHERE status NOT IN ('EXTRACTED', 'NEEDS_REVIEW', 'BLOCKED')),
        posted AS (SELECT arrival, row_number() OVER (ORDER BY coalesce(result1, '') <> 'registered', arrival) AS place FROM s3 WHERE status = 'POSTED')"""
    )


FOLDED = folded_sql()


def case_events(rows: DataFrame) -> DataFrame:
    """Two events for two invoices in twelve each: edits, rejections, a rejection and a late approval, approvals; one
    for two more: a supplier chosen, an approval without a word about the account; and a change of policy at the end."""
    key, no = F.col("arrival") % 12, F.lit(None).cast("string")
    kinds = [(1, 1, "edit", no), (1, 2, "edit", no), (2, 1, "reject", no), (2, 2, "reject", no), (3, 1, "reject", no), (3, 2, "approve", F.lit("pay_printed")), (4, 1, "approve", F.lit("pay_altered")), (4, 2, "approve", F.lit("pay_altered")), (5, 1, "edit", no), (6, 1, "approve", no)]
    when = lambda value, rest, turn, patch: F.when((F.lit(value[0]) == rest) & (F.lit(value[1]) == turn), patch)
    made = [
        rows.filter(key == k[0]).select((F.lit(k[1] * 10**12) + F.col("arrival")).alias("event_id"), "arrival", F.lit(k[2]).alias("kind"), F.lit("ann").alias("actor"), F.lit(f"turn {k[1]}").alias("note"), k[3].alias("outcome"),
                                        when(k, 1, 1, F.concat(F.lit("N"), F.col("arrival").cast("string"))).alias("patch_invoice_number"), when(k, 1, 2, F.date_add("issue_date", 30)).alias("patch_due_date"), when(k, 5, 1, F.lit("P-000001")).alias("patch_partner_code"))
        for k in kinds
    ]
    last = rows.sparkSession.range(1).select((F.lit(10**13)).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("arrival"), F.lit("policy").alias("kind"), F.lit("bob").alias("actor"), F.lit("amount_review_threshold").alias("note"), F.lit("250000").alias("outcome"), no.alias("patch_invoice_number"), F.lit(None).cast("date").alias("patch_due_date"), no.alias("patch_partner_code"))
    out = made[0]
    for more in [*made[1:], last]:
        out = out.unionByName(more)
    return out


@query("SELECT s3.arrival, status, number AS invoice_number, CASE WHEN pid IS NOT NULL THEN format('P-{:06d}', pid) END AS partner_code, due AS due_date, CASE WHEN status = 'POSTED' THEN 'ACC-' || lpad(place::VARCHAR, greatest(4, length(place::VARCHAR))::INTEGER, '0') END AS accounting_id FROM s3 LEFT JOIN posted USING (arrival)", FOLDED)
def review_state(spark, sf_dir):
    """Every invoice as its reviewers' events and a change of policy leave it."""
    rows = checked(spark, sf_dir)
    cases = casework.apply_events(casework.open_cases(rows, rules=PROJECTED_POLICY), case_events(rows), master(spark, sf_dir))
    return cases.invoices().select("arrival", "status", "invoice_number", "partner_code", "due_date", "accounting_id")


@query("""SELECT arrival, CASE WHEN kind IN ('edit', 'choose') THEN 'edit' WHEN kind IN ('twice', 'bare') THEN 'approve' ELSE 'reject' END AS kind, result1 AS result, 'turn 1' AS note FROM s3 WHERE result1 IS NOT NULL
    UNION ALL SELECT arrival, CASE WHEN kind IN ('late', 'twice') THEN 'approve' ELSE kind END, result2, 'turn 2' FROM s3 WHERE result2 IS NOT NULL
    UNION ALL SELECT NULL, 'policy', 'policy changed', 'amount_review_threshold'""", FOLDED)
def stream_review(spark, sf_dir):
    """The same events as a stream of two deliveries, and what came of each."""
    out, rows = run_folder(spark), checked(spark, sf_dir)
    events = case_events(rows)
    for first in (True, False):
        events.filter((F.col("event_id") < 2 * 10**12) == F.lit(first)).write.mode("append").parquet(f"{out}/events")
        arrivals.review_stream(spark.readStream.schema(events.schema).parquet(f"{out}/events"), rows, master(spark, sf_dir), out, f"{out}/checkpoint", PROJECTED_POLICY).awaitTermination()
    told = spark.read.parquet(f"{out}/log")
    return told.select("arrival", "kind", "result", F.regexp_extract("event_note", "^(turn [12]|[a-z_]+)", 1).alias("note"))


@query("SELECT 'EXTRACT_FAILED' AS status, count(*) AS invoices FROM documents")
def extract_failed(spark, sf_dir):
    """Documents are no JSON records, so reading them as answers must fail one by one and not the batch."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("arrival"), F.col("text").alias("answer"))
    return report.status_counts(intake.raw_records(docs)[1])
