"""The registered queries of this subpackage: each applies one operator to its whole table and derives digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, divergence, hmm, hnsw, licenses, mixing, neardup, resample, secretscan, substrings, toxicity, urlfilter
from .common import remainder, shared_dir, table

#: The production rules of op3: (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, query_step=100)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge_urls(pages, urlfilter.flagged_hosts(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder(F.col("doc_id"), 4) == 2
    field = toxicity.fit(docs, toxicity.labelled_sample(table(spark, sf_dir, "labels").filter(~held_out)))
    scored = toxicity.score_documents(docs, field)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_inner_products(table(spark, sf_dir, "embeddings"), k=20, query_step=20)


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.score_documents(docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans into one ledger, as versions come in: first half of the documents, then all of them, of which only the
    blobs that the first scan has not met are read for secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}"
    secretscan.scan_into(docs.filter(remainder(F.col("doc_id"), 2) == 0), path)
    found = secretscan.scan_into(docs, path)
    kinds = [r.kind for r in secretscan.RULES if r.base]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "row.doc_id", *[secretscan.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(secretscan.spans_text(base).cast("binary"), 256).alias("base_sha256"), secretscan.spans_text(F.col("spans")).alias("spans"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return digest_ids(coded)


def digest_ids(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OPERATIONS = (
    op1_mix_sources, op2_hnsw, op3_url_filter, op4_toxicity, op5_cover_tree, op6_hmm_score, op7_secret_scan, op8_minhash, op9_byte_bpe, op10_license_scan, op11_substring_dedup,
    op12_source_divergence, op13_resample,
)
QUERIES = {f.__name__: f for f in OPERATIONS}

#: The queries DuckDB can express; the others are tested against brute force in tests/llm.
ORACLES = {
    "op3_url_filter": r"""
        WITH parts AS (
            SELECT page_id, url,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
                   regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query
            FROM pages),
        named AS (
            SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains(
                   ['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'], split_part(p, '=', 1)))), '&') AS rest
            FROM parts),
        keyed AS (
            SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                   || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END END AS canonical
            FROM named),
        listed AS (
            SELECT DISTINCT canonical FROM keyed
            WHERE canonical IS NOT NULL AND list_has_any(regexp_split_to_array(host, '[.-]'), ['casino', 'bets', 'pills', 'ads', 'spam', 'adult'])),
        rules(verdict, of, start) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        judged AS (
            SELECT k.*, (SELECT r.of || r.start || ' ' || r.verdict FROM rules r
                         WHERE (k.host = r.of OR ends_with(k.host, '.' || r.of)) AND starts_with(k.path, r.start)
                         ORDER BY length(r.of || r.start) DESC LIMIT 1) AS best,
                   coalesce(k.canonical IN (SELECT canonical FROM listed), false) AS listed
            FROM keyed k)
        SELECT page_id, host, path, CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 1) END AS rule,
               coalesce(split_part(best, ' ', 2), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
        FROM judged""",
    "op5_cover_tree": """
        WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.id AS query_id, d.id AS vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
              FROM v q JOIN v d ON q.id % 20 = 0 AND q.id <> d.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        sh AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
        n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sh),
        e AS (SELECT doc_id, unnest(s) AS g FROM sh),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n_shingles + y.n_shingles - same)),
        two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, t.b FROM reach r JOIN two t ON t.a = r.b)
        SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
        FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles""",
    "op11_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
        windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS w FROM starts),
        seen AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN seen USING (w) WHERE first < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT doc_id, lang, source, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
                  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM cells),
        q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
              FROM (SELECT lang, term, sum(n)::HUGEINT AS n, any_value(v) AS v FROM cells GROUP BY lang, term)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
                         WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        terms AS (SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
        both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
    "op13_resample": r"""
        WITH w AS (
            SELECT 'd' AS side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
            UNION ALL
            SELECT 'b', NULL, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
        f AS (SELECT side, doc_id, unnest(ws) AS word FROM w),
        tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
                lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
        codes AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT)),
                         lambda c, b: xor(c // 256, tbl.t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM f), tbl),
        n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN codes USING (word) GROUP BY bucket),
        sums AS (SELECT sum(s)::DOUBLE AS sd, sum(t)::DOUBLE AS td FROM n),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sd + 10000) / ((s + 1)::DOUBLE * (td + 10000))))::BIGINT AS gain FROM n, sums),
        weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN codes USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
        scored AS (SELECT w.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                   + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || w.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN weight USING (doc_id) WHERE side = 'd'),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
        SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM scored s LEFT JOIN r USING (doc_id)"""
}
