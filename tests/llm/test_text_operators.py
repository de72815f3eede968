"""Text operators against brute force, on small tables that hold every odd case."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import bpe, hmm, licenses, mixing, neardup, queries, secretscan, toxicity, urlfilter
from tallyweave.llm.common import remainder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, size bigint, spans string, ids string, hash string, key string, score double"
WORD, LICENSE_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(licenses.LICENSE_WORD)
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
BASE = " ".join(f"word{i}" for i in range(200))
TEXTS = [
    None, "", "   \n", "one", "two words", "Two Words", BASE, BASE, BASE.replace("word7 ", "other ", 1), BASE.replace("word100 ", "thing "), LONG, LONG + " end", "ß é 中文　字   x y it's don't",
    "password = hunter22 token:abc, API_KEY='k-123456' AKIA" + "A1" * 9 + " " + "0f" * 14, "secret=a token=abcdef1 AKIAX", "\U0001f600 token: abcdefgh \U0001f600 " + "ab" * 20, "eyJhbGciOi12.eyJzdWIiOi34.c2ln x",
    "Released under the MIT License.", "mit license MIT-License mit  license", "GNU General Public License, version 3. general public license", "Licensed under the Apache License, Version 2.0", "mit", "the mit",
    "you idiot, you moron. what a clown", "plain talk of the day " * 30,
]


def low(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "a", "c"][i % 5], None, "x", 1, "s", "i", "h", "k", 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[13], (None, "null id mit license", "en", "a", 3, "x", 1, "s", "i", "h", "k", 0.5), (6, "another text of six", "en", "b", 3, "x", 1, "s", "i", "h", "k", 0.5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_mixing(spark, docs):
    rows = mixing.taken_words(mixing.mix_sources(docs, block_words=8, shard_slots=512)).collect()
    assert len(rows) == docs.count()
    of_source = Counter()
    for r in docs.collect():
        of_source[r.source] += len(WORD.findall(r.text or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(of_source, key=lambda s: (s is None, s)))}
    target, left, total = {}, dict(weight), 1.5 * sum(of_source.values())
    while left:
        level = (total - sum(target.values())) / sum(left.values())
        over = [s for s in left if 2 * of_source[s] <= level * left[s]]
        target |= {s: 2.0 * of_source[s] for s in over} or {s: level * w for s, w in left.items()}
        left = {s: w for s, w in left.items() if s not in target}
    assert sorted(round(t, 6) for t in target.values()) == sorted({round(r.target, 6) for r in rows})
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows) and sum(r["size"] for r in rows) == sum(of_source.values())
    for t in target.values():
        assert abs(sum(r.taken for r in rows if abs(r.target - t) < 1e-6) - t) <= 0.05 * t + 16
    again = mixing.taken_words(mixing.mix_sources(docs.coalesce(1), block_words=8, shard_slots=512)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mixed_documents_meet_the_targets(spark):
    """Words by source of the emitted texts, for long documents, a hot source, and rows that share id, source and size."""
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, words(i, 150 + i * 37 % 500), "abc"[i % 3] if i % 2 else "c") for i in range(240)]
    rows += [(7, words(1000, 200), "c"), (7, words(1001, 200), "c"), (None, words(1002, 200), None), (None, words(1003, 200), None), (8, None, "a"), (9, " \n", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, source string, n_chars bigint").repartition(3)
    docs = docs.withColumns({c: F.lit(1) for c in ("_copy", "row", "size", "nth", "rank", "times", "pieces", "of_doc")})
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    plan = mixing.mix_sources(docs)
    got, of_doc = Counter(), Counter()
    for r in out:
        got[r.source] += len(WORD.findall(r.text))
        of_doc[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    for r in plan.sources.collect():
        assert abs(got[r.source] - r.target) <= 0.03 * r.target + 128, (r.source, got[r.source], r.target)
    # as the plan takes them: no word but the document's own, each at most twice, rows of one id not mixed up
    planned = Counter()
    for r in mixing.taken_words(plan).collect():
        planned[r.doc_id] += r.taken
    assert planned == Counter({i: sum(n for (j, _), n in of_doc.items() if j == i) for i in planned})
    own = {(i, w): s for i, t, s in rows for w in WORD.findall(t or "")}
    used = Counter((r.doc_id, w) for r in out for w in WORD.findall(r.text))
    assert all(n <= 2 and k in own for k, n in used.items())
    assert all(len({w.split("x")[0] for w in WORD.findall(r.text)}) == 1 for r in out)


def test_blocks_and_shards_of_the_mix(spark):
    """The blocks themselves: full blocks of the documents' own words, targets met, and counts that vary by shard."""
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i % 300, words(i, 40 + i * 31 % 90), "abcd"[i % 4] if i % 3 else "a") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    mix = mixing.mix_sources(docs, block_words=8, shard_slots=256)
    out = mixing.mixed_blocks(mix, docs).collect()
    slots = mix.slots.collect()
    assert len(out) == len(slots) == len({(r.shard, r.i) for r in slots})
    assert sum(len(r.words) == 8 for r in out) >= 0.97 * len(out) and all(0 < len(r.words) <= 8 for r in out)
    own = {w for _, t, _ in rows for w in t.split()}
    of = {w: s for _, t, s in rows for w in t.split()}
    assert all(w in own and of[w] == r.source for r in out for w in r.words)
    used = Counter(w for r in out for w in r.words)
    assert max(used.values()) <= 2
    got, shards = Counter(), {}
    for r in out:
        got[r.source] += len(r.words)
        shards.setdefault(r.shard, Counter())[r.source] += 1
    for r in mix.sources.collect():
        assert abs(got[r.source] - r.target) <= 0.02 * r.target + 16
    # each full shard's counts are a draw: their spread is that of a multinomial, not none and not far more
    full = [c for s, c in shards.items() if sum(c.values()) == 256]
    assert len(full) >= 15
    p = sum(r.source == "a" for r in slots) / len(slots)
    spread = sum((c["a"] - 256 * p) ** 2 for c in full) / len(full)
    assert 0.3 < spread / (256 * p * (1 - p)) < 2.5


def test_mixing_is_a_permutation(spark):
    n = 1000
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(5)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n)) and [r.p for r in got][:5] != list(range(5))


def test_secrets(spark, docs):
    assign = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found, ledger = secretscan.scan_versions(docs)
    rows = found.select("row.text", "spans", secretscan.spans_text(F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))).alias("base")).collect()
    assert len(rows) == docs.count() and sum(bool(r.base) for r in rows) == 4
    for r in rows:
        t = r.text or ""
        want = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.base == ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(want))
    assert any(s.kind == "jwt" for r in rows for s in r.spans)
    # nothing is scanned twice, and a new rule is scanned alone
    ledger = ledger.cache()
    assert secretscan.scan_unseen(docs, ledger).count() == 0
    rule = secretscan.Rule("word", "idiot")
    assert secretscan.scan_unseen(docs, ledger, (*secretscan.RULES, rule)).count() == docs.select(secretscan.blob_of(F.col("text"))).distinct().count()
    odd = docs.select("*", F.lit(1).alias("_spans"), F.lit("b").alias("_blob"), F.lit(2).alias("row"), F.lit(3).alias("blob"))
    redacted = secretscan.redact_documents(odd)
    assert redacted.columns == odd.columns and {(r._spans, r._blob, r.row, r.blob) for r in redacted.collect()} == {(1, "b", 2, 3)}
    clean = {r.doc_id: r.text for r in redacted.collect()}
    assert clean[14] == "secret=a [secret] AKIAX" and clean[17] == TEXTS[17] and "hunter22" not in clean[13]


def test_a_kept_ledger_is_added_to(spark, docs, tmp_path):
    path = str(tmp_path / "ledger")
    some = docs.filter("doc_id < 15")
    read = lambda: spark.read.schema(secretscan.LEDGER).parquet(path)
    blobs = lambda frame: {r[0] for r in frame.select(secretscan.blob_of(F.col("text"))).distinct().collect()}
    secretscan.scan_into(some, path)
    first = {(r.blob, r.rule_version) for r in read().collect()}
    assert {b for b, _ in first} == blobs(some) and len(first) == len(blobs(some)) * len(secretscan.RULES)
    # the second scan is due just the blobs that are new, and adds them once
    assert {r.blob for r in secretscan.scan_unseen(docs, read()).collect()} == blobs(docs) - blobs(some)
    found = secretscan.scan_into(docs, path).select("row.doc_id", "row.text", "spans").collect()
    assert read().count() == len(blobs(docs)) * len(secretscan.RULES)
    secretscan.scan_into(docs, path)
    assert read().count() == len(blobs(docs)) * len(secretscan.RULES)
    want, _ = secretscan.scan_versions(docs)
    assert sorted(map(str, found)) == sorted(str(r) for r in want.select("row.doc_id", "row.text", "spans").collect())


def test_private_keys_are_masked_whole(spark):
    body = [base64.b64encode(hashlib.sha512(bytes([i])).digest()).decode()[:64] for i in range(24)] + ["Qk9EWQ=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FFA1", ""]
    texts, want = zip(
        (f"a {begin}\n" + "\n".join(body) + f"\n{end} z", "a [secret] z"),
        ("a\n" + "\r\n".join([begin, *fields, *body, end]) + "\nz", "a\n[secret]\nz"),
        (f"a {begin} " + " ".join(body) + f" {end} z", "a [secret] z"),  # line ends made spaces
        ('"' + "\\n".join([begin, *fields, *body, end]) + '" z', '"[secret]" z'),  # or written out
        ("a\n" + "\n".join([begin, *fields, *body]), "a\n[secret]"),  # cut off
        (begin + "\n" + "\n".join(body) + "\nplain words follow it", "[secret]\nplain words follow it"),
        ('"' + "\\n".join([begin, *body]) + '\\nplain words"', '"[secret]\\nplain words"'),
        ("\n".join([begin, *body[:3], begin, *body[3:], end]) + "\nz", "[secret]\n[secret]\nz"),  # the first has no end
        ("-----BEGIN CERTIFICATE-----\nabc\n-----END CERTIFICATE----- b", "-----BEGIN CERTIFICATE-----\nabc\n-----END CERTIFICATE----- b"),
        (f"{begin} is how a key starts", "[secret] is how a key starts"),
        (begin + "\n" + "\n".join(body * 4000) + f"\n{end} z", "[secret] z"),  # long ones do not exhaust the stack
        (begin + "\n" + "\n".join(body * 4000) + "\nz z", "[secret]\nz z"),
        (begin + " - - x" * 100_000, "[secret]" + " - - x" * 100_000),
    )
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in secretscan.redact_documents(docs).collect()}
    for i, t in enumerate(want):
        assert got[i] == t, (i, got[i][:300])
    assert not any(line in got[i] for i in got for line in body)


def test_licenses(spark, docs):
    rows = licenses.scan_documents(docs).collect()
    assert len(rows) == docs.count()
    by_words = Counter()
    for r in docs.collect():
        words = LICENSE_WORD.findall(low(r.text))
        starts, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += hits
            labels |= {label} if hits else set()
        by_words[(r.doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))] += 1
    assert by_words == Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert all({*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.labels for r in rows}[17] == "mit,mit-notice"


def test_license_spans_are_verified(spark):
    """Repeated notices, torn ones, words added or left out, and pieces in the wrong order."""
    gpl, asf = "this work is licensed under the gnu general public license version 3", "you may not use this file except in compliance with the license"
    cases = [
        ("all rights " * 6 + "all rights reserved", [("all-rights-reserved", 12, 15)]),
        ("All rights reserved. " * 3, [("all-rights-reserved", 3 * i, 3 * i + 3) for i in range(3)]),
        ("x " + asf + " y", [("apache-text", 1, 13)]),
        (asf.replace("use this", "use all of this"), [("apache-text", 0, 14)]),
        (asf.replace("use this", "use any or all of this"), []),
        (asf.replace("the license", "the said license"), [("apache-text", 0, 11)]),
        (f"{gpl} {gpl}", [("gpl-3.0", 0, 12), ("gpl-3.0", 12, 24)]),
        ("version 3 license public general gnu the under licensed is work this", []),
        ("general public license version 3 under the gnu is licensed under this work is", []),
        ("reserved rights all", []),
        ("all rights " * 3000 + "reserved", [("all-rights-reserved", 5998, 6001)]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {}
    for r in licenses.license_spans(docs).filter("not base").collect():
        got.setdefault(int(r.key.split(":")[0]), []).append((r.label, r.start, r.end))
    for i, (text, want) in enumerate(cases):
        assert sorted(got.get(i, [])) == want, (text[:80], got.get(i))


def test_bpe_round_trip(spark, docs):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_documents(docs, path, P.PATTERN)
    for r in coded.collect():
        assert list(r.ids) == theirs.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.digest_ids(coded).collect()}
    ids = theirs.encode_ordinary(BASE)
    assert (6, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(BASE.encode()).hexdigest()) in digests


def test_near_duplicates(spark, docs):
    for shingle, percent in ((3, 85), (5, 80)):
        rows = docs.collect()
        sets = []
        for r in rows:
            w = WORD.findall(low(r.text))
            sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
        parent = list(range(len(rows)))
        find = lambda x: x if parent[x] == x else find(parent[x])
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    parent[find(i)] = find(j)
        least = {}
        for i, r in enumerate(rows):
            if r.doc_id is not None:
                least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
        want = Counter((r.doc_id, len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))
        got = neardup.near_duplicates(docs, shingle, percent / 100).collect()
        assert want == Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_near_duplicate_group_stays(spark, docs):
    """Repeated rows, shared ids and null ids."""
    extra = [(i, t, "en", "b", n, "x", 1, "s", "i", "h", "k", 0.5) for i, t, n in (
        *[(70, "the same long row many times over", 1)] * 40, (None, "nobody owns this text at all", 2), (None, "nobody owns this text at all", 2),
        (6, BASE.replace("word50 ", "thing "), 3), (5, BASE.replace("word60 ", "some "), 3), (5, "a clean text under a shared id", 3), (90, "a clean text under a shared id", 3),
        (91, "the first of two with no least id", 4), (None, "the first of two with no least id", 4), (None, None, 5), (None, None, 5))]
    rows = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).repartition(5)
    got = neardup.without_near_duplicates(rows)
    assert got.columns == rows.columns
    everything, sets = rows.collect(), []
    for r in everything:
        w = WORD.findall(low(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    stay = {}
    for i, r in enumerate(everything):
        k = find(i) if sets[i] else ("no words", i)
        if k not in stay or (r.doc_id is None, r.doc_id or 0) < (stay[k].doc_id is None, stay[k].doc_id or 0):
            stay[k] = r
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left == Counter((r.doc_id, r.text) for r in stay.values())
    assert left[70, "the same long row many times over"] == left[6, "another text of six"] == left[5, "a clean text under a shared id"] == left[None, "nobody owns this text at all"] == 1


def test_signatures_follow_the_similarity():
    for similarity in (0.95, 0.85, 0.8, 0.7, 0.6, 0.5, 0.3, 0.1):
        shape = neardup.shape_of(similarity)
        agree, n = similarity + (1 - similarity) / 16, shape.bands * shape.band
        below = sum(math.comb(n, i) * agree**i * (1 - agree) ** (n - i) for i in range(shape.least))
        assert below <= 1e-8 and (1 - similarity**shape.band) ** shape.bands <= 1e-8


def test_pairs_at_a_low_threshold_are_found(spark):
    """Pairs of texts that share 60 of 100 words."""
    words = lambda i, c, n: [f"{c}{i}x{j}" for j in range(n)]
    pairs = [(words(i, "s", 60) + words(i, "a", 20), words(i, "s", 60) + words(i, "b", 20)) for i in range(60)]
    rows = [(2 * i + k, " ".join(t)) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, 0.6).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == 120


def test_near_duplicate_groups_beyond_a_block(spark):
    """A chain and a star larger than a block, with members that only one other joins."""
    words = [f"t{i}" for i in range(120)]
    texts = [" ".join(words[: i % 118] + [f"n{i}"] + words[i % 118 + 1 :]) for i in range(700)]
    got = neardup.near_duplicates(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)] + [(0, " ".join(words)), (9999, "far away from all of these")], "doc_id bigint, text string"), 3, 0.85).collect()
    assert {r.component_id for r in got if r.doc_id != 9999} == {0}


def test_language_model(spark, docs):
    held = docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    rows = hmm.score_documents(held, words=30, classes=5, states=2, passes=2).collect()
    assert len(rows) == docs.count()
    tokens = [(r.doc_id, r.text or "", [*WORD.findall(low(r.text)), 0]) for r in docs.collect()]
    count = Counter()
    for i, _, t in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(t)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(t), sum(x in count for x in t), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 6)) for i, _, t in tokens)
    assert want == Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_forward_recursion_is_exact():
    import numpy as np

    model = hmm.Model.first(np.arange(1.0, 8.0), 3)
    sequences = [np.array(s, np.uint16) for s in ([0], [1, 2, 3, 0], [6, 6, 5, 0])]
    for s, got in zip(sequences, model.log10_likelihood(sequences)):
        now = model.start * model.emit[s[0]]
        for x in s[1:]:
            now = (now @ model.move) * model.emit[x]
        assert abs(math.log10(now.sum()) - got) < 1e-12


def test_expected_counts_are_those_of_whole_chains():
    """Against the plain recursion, on chains of very different lengths, one of them of 200 tokens."""
    import numpy as np

    from tallyweave.llm.chains import Packed

    random = np.random.default_rng(5)
    model = hmm.Model(np.ones(7), random.dirichlet(np.ones(3)), random.dirichlet(np.ones(3), 3), random.dirichlet(np.ones(7), 3).T)
    chains = [random.integers(0, 7, n).astype(np.uint16) for n in (3, 200, 1, 66)]
    start, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for x in chains:
        ahead, back = [model.start * model.emit[x[0]]], [np.ones(3)]
        for s in x[1:]:
            ahead.append(ahead[-1] @ model.move * model.emit[s] / ahead[-1].sum())
        for s in x[:0:-1]:
            back.append(model.move @ (back[-1] * model.emit[s]) / back[-1].sum())
        back = back[::-1]
        for t, s in enumerate(x):
            here = ahead[t] * back[t]
            emitted[s] += here / here.sum()
            if t == 0:
                start += here / here.sum()
            else:
                both = ahead[t - 1][:, None] * model.move * (model.emit[s] * back[t])
                moves += both / both.sum()
    for got, want in zip(model.expected(Packed(chains)), (start, moves, emitted)):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    better = model.next(start, moves, emitted)
    assert better.emit.sum(0).round(6).tolist() == [1, 1, 1] and better.log10_likelihood(chains).sum() > model.log10_likelihood(chains).sum() - 5


def test_scores_are_probabilities(spark):
    """score end to end, from the symbols and class shares that the docstring names, on whole texts of 1 to 90 words."""
    import numpy as np

    texts = [" ".join(f"w{(i * j) % 11}" for j in range(1 + 10 * i)) for i in range(10)]
    docs = spark.createDataFrame([(i, t, i == 9) for i, t in enumerate(texts)], "doc_id bigint, text string, held_out boolean")
    words, classes, states = 5, 3, 2
    rows = {r.doc_id: r.score for r in hmm.score_documents(docs, words, classes, states, 2).collect()}
    count = Counter(w for t in texts[:9] for w in t.split())
    frequent = sorted(count, key=lambda w: (-count[w], w))[:words]
    of_class = lambda w: zlib.crc32(w.encode()) % classes
    rare = {c: [count[w] for w in count if w not in frequent and of_class(w) == c] for c in range(classes)}
    symbol = lambda w: frequent.index(w) + 1 if w in frequent else words + 1 + of_class(w)
    chains = [np.array([*map(symbol, t.split()), 0], np.uint16) for t in texts]
    model = hmm.Model.first(np.array([9, *[count[w] for w in frequent], *[sum(rare[c]) for c in range(classes)]]) + 0.5, states)
    for _ in range(2):
        model = model.next(*model.expected(hmm.Packed(chains[:9])))
    share = lambda w: 0 if w in frequent else math.log10((count[w] + 1) / (sum(rare[of_class(w)]) + len(rare[of_class(w)]) + 1))
    for i, got in enumerate(model.log10_likelihood(chains)):
        assert abs(rows[i] - got - sum(map(share, texts[i].split()))) < 1e-3


def test_toxicity(spark, docs):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i * 37))
    train = [(i, f"some talk {word(i)} {'idiot' if i % 2 else 'friend'} {word(i + 1)} words", i % 2) for i in range(100, 300)]
    train += [(i, f"some talk {word(i)} plain {word(i + 1)} words", 0) for i in range(300, 900)]
    labels = spark.createDataFrame([(i, 0, t) for i, _, t in train] + [(100, 0, None), (None, 1, 1), (101, 0, 1)], "doc_id bigint, quality int, toxic int")
    field = toxicity.fit(spark.createDataFrame([t[:2] for t in train], "doc_id bigint, text string"), toxicity.labelled_sample(labels))
    rows = {key(r): r for r in toxicity.score_documents(docs.select("doc_id", "text"), field).collect()}
    odd = spark.createDataFrame([(1, "\u0130\u0130 Idiot"), (2, None)], "doc_id bigint, text string")
    assert [(s.start, s.end) for r in toxicity.score_documents(odd, field).collect() for s in r.spans] == [(3, 8)]
    insult, plain, empty = rows[(False, 23, TEXTS[23])], rows[(False, 24, TEXTS[24])], rows[(False, 1, "")]
    assert insult.score >= 0.3 > plain.score and empty.score < 0.3 and all(0 <= r.score <= 1 for r in rows.values())
    assert [TEXTS[23][s.start : s.end] for s in insult.spans] == ["idiot"]
    blank = toxicity.fit(docs.select("doc_id", "text"), toxicity.labelled_sample(labels.filter("false")))
    assert toxicity.score_documents(docs.select("doc_id", "text"), blank).filter("score > 0.1 or size(spans) > 0").count() == 0


def test_marginals_are_exact():
    """By enumeration on short chains, and by the plain recursion of the whole chain on one of 300 tokens."""
    import numpy as np

    from tallyweave.llm.chains import Packed

    field = toxicity.Field.blank({})
    random = np.random.default_rng(3)
    field.own, field.left, field.right, field.move, field.start = random.normal(size=4), random.normal(size=4), random.normal(size=4), random.normal(size=(2, 2)), random.normal(size=2)
    short, long = (toxicity.features(np.array(g, np.uint8)) for g in ([0, 3, 1, 0, 2], random.integers(0, 4, 300)))
    psi, weight = field.potentials()[short], {}
    for states in range(32):
        y = [states >> i & 1 for i in range(5)]
        weight[tuple(y)] = math.exp(field.start[y[0]] + sum(field.move[a, b] for a, b in zip(y, y[1:]))) * math.prod(psi[i] if s else 1 for i, s in enumerate(y))
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(5)]
    psi, move = field.potentials()[long], np.exp(field.move)
    ahead, back = [np.exp(field.start) * [1, psi[0]]], [np.ones(2)]
    for x in psi[1:]:
        ahead.append(ahead[-1] @ move * [1, x] / ahead[-1].sum())
    for x in psi[:0:-1]:
        back.append(move @ (back[-1] * [1, x]) / back[-1].sum())
    both = np.array(ahead) * np.array(back[::-1])
    got = field.of_documents([short[:0], long, short])
    assert len(got[0]) == 0 and np.allclose(got[1], both[:, 1] / both.sum(1)) and np.allclose(got[2], want)
    _, pairs = field.marginals(Packed([short]), np.ones(1))
    for a in (0, 1):
        for b in (0, 1):
            expected = sum(w * sum(y[i : i + 2] == (a, b) for i in range(4)) for y, w in weight.items()) / sum(weight.values())
            assert abs(pairs[a, b] - expected) < 1e-9


def test_document_weights_do_not_diverge():
    """Evidence that parts toxic from clean documents without error, of very different scales."""
    import numpy as np

    toxic = np.repeat([1.0, 0.0], [30, 970])
    evidence = np.stack([np.ones(1000), toxic, toxic * 3 + np.arange(1000) % 7 / 100, 50 * toxic], 1)
    weights = toxicity.logistic(evidence, toxic, np.where(toxic, 1.0, 20.0))
    p = 1 / (1 + np.exp(-evidence @ weights))
    assert p[toxic == 1].min() > 0.9 and p[toxic == 0].max() < 0.05 and np.abs(weights).max() < 100


def test_evidence_does_not_grow_with_plain_text():
    """Plain tokens add nothing, finds far apart do not add up, and a dense passage counts wherever it stands."""
    import numpy as np

    field = toxicity.Field.blank({})
    plain, dense = np.full(200_000, 1e-3), np.full(200_000, 1e-3)
    assert np.allclose(field.evidence(plain), [1, 1e-3, 0, 0, 0, 0]) and np.allclose(field.evidence(plain[:5]), field.evidence(plain)) and np.allclose(field.evidence(plain[:0]), [1, 0, 0, 0, 0, 0])
    plain[::1000], dense[-20:] = 0.9, 0.9
    assert np.isclose(field.evidence(plain)[2], np.log1p(0.9)) and np.isclose(field.evidence(dense)[2], np.log1p(18))
    assert np.isclose(field.evidence(dense[-40:])[2], np.log1p(18)) and np.isclose(field.evidence(dense[-40:])[5], np.log1p(45))


def test_the_form_of_the_score_is_chosen_by_folds(monkeypatch):
    """One column tells the labels in every fold, another only in the first: the first form is chosen, by training rows."""
    import numpy as np

    draw = np.random.default_rng(1)
    fold, toxic = np.arange(400) % 4, (np.arange(400) // 4 % 2).astype(float)
    good, lucky = toxic + draw.normal(size=400) / 3, np.where(fold == 0, 5 * toxic, draw.normal(size=400))
    evidence = np.stack([np.ones(400), lucky, good], 1)
    monkeypatch.setattr(toxicity, "FORMS", ((0, 1), (0, 2)))
    weights = toxicity.document_weights(evidence, toxic, np.ones(400), fold)
    assert weights[1] == 0 and weights[2] > 1


def test_a_pair_that_stands_twice_in_the_ledger_counts_once(spark, docs):
    found, ledger = secretscan.scan_versions(docs)
    twice = secretscan.findings(docs, ledger.unionByName(ledger).unionByName(ledger.filter("rule_version like 'hex%'")))
    show = lambda rows: sorted((r.blob, str(r.spans)) for r in rows.collect())
    assert show(twice) == show(found) and found.filter("size(spans) > 1").count() > 0


def test_urls_with_columns_of_the_filters_names(spark):
    urls = spark.createDataFrame([(1, "http://spam.net/a", 5, 6, "b", "c", "r"), (2, None, 5, 6, "b", "c", "r"), (2, None, 5, 6, "b", "c", "r")], "page_id int, url string, block int, w0 int, _best string, b3 string, row string")
    got = urlfilter.judge_urls(urls, urlfilter.flagged_hosts(urls), queries.URL_RULES)
    assert sorted((r.page_id, r.verdict, r.block, r.w0, r._best, r.b3, r.row) for r in got.collect()) == [(1, "block", 5, 6, "b", "c", "r"), (2, "allow", 5, 6, "b", "c", "r"), (2, "allow", 5, 6, "b", "c", "r")]
    nothing = urlfilter.judge_urls(urls.limit(0), urlfilter.flagged_hosts(urls), queries.URL_RULES)
    unlisted = urlfilter.judge_urls(urls, urlfilter.flagged_hosts(urls).limit(0), queries.URL_RULES)
    assert nothing.count() == 0 and {r.verdict for r in unlisted.collect()} == {"allow"}


def test_toxicity_on_held_out_documents(spark):
    """The documents whose labels op4 does not learn from. Some labels have no trace in the text; those texts that hold
    a word which stands in several toxic documents and no clean one must be caught."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_toxicity(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    text = {r.doc_id: set(toxicity.tokens_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == text.keys() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    clean, bad = Counter(), Counter()
    for i, toxic in truth.items():
        (bad if toxic else clean).update(text[i])
    telling = {w for w, n in bad.items() if n >= 6 and not clean[w]}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id] and text[r.doc_id] & telling]
    assert len(caught) >= 5 and sum(caught) >= 0.9 * len(caught)
    assert sum(r.predicted for r in held if not truth[r.doc_id]) <= 0.02 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    high, low = ([r.score for r in held if truth[r.doc_id] == t and bool(text[r.doc_id] & telling) == bool(t)] for t in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in high for b in low) >= 0.95 * len(high) * len(low)


def test_urls(spark):
    urls = [None, "no scheme", "http://A.com", "http://a.com/", "https://www.Example.com/en/x?utm_source=1#t", "http://sub.www.example.com/en/", "http://x.net/es/q", "http://xnet/es/q", "http://casino.org/a?b=1&a=2&ref=x", "http://www.casino.org:80/a/?a=2&b=1", "http://ok.org/a", "ftp://com/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(8, urls[8], "again")], "page_id bigint, url string, host string")
    rows = urlfilter.judge_urls(pages, urlfilter.flagged_hosts(pages), queries.URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 13 and got[0] == got[1] == ("", "", None, "allow") and got[2] == ("a.com", "", None, "allow") and got[3][2] == "com/"
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5][2] == "www.example.com/en/" and got[6][3] == "block" and got[7][2] is None
    assert got[8][3] == got[9][3] == "block" and got[10][3] == "allow" and got[11][2] == "com/"
    listed = spark.range(500).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("canonical"))
    blocks, n = urlfilter.build_filter(listed)
    assert urlfilter.possible(listed, blocks, n).filter("not possible").count() == 0
    others = spark.range(500, 5500).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("canonical"))
    assert urlfilter.possible(others, blocks, n).filter("possible").count() < 400


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert mixing.taken_words(mixing.mix_sources(none)).count() == 0 and neardup.near_duplicates(none).count() == 0
    assert secretscan.scan_versions(none)[0].count() == 0 and licenses.scan_documents(none).count() == 0
    assert hmm.score_documents(none.withColumn("held_out", F.lit(False))).count() == 0
    assert toxicity.without_toxic(none, labels).count() == 0
