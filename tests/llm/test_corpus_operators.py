"""Substring deduplication, source divergence and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import divergence, resample, substrings

SCHEMA = "doc_id bigint, text string, lang string, source string, block int, row int, term string, buckets string, rank double"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
TERM, PLAIN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 2, "t", "b", 0.5) for i, t, lang, source in rows], SCHEMA).repartition(3)


def words_of(text):
    return (text or "").encode().split()


def low(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def rows():
    """Passages shared in part, copies, a frequent phrase among changing words, and every odd case."""
    draw = random.Random(11)
    some = lambda n: [draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randint(1, 3) for _ in range(n)]
    passage, phrase = some(40), some(9)
    out = []
    for i in range(120):
        a = draw.randint(0, 20)
        text = some(draw.randint(0, 30)) + passage[a : a + draw.randint(5, 20)] * (i % 3 == 0) + some(8) + phrase * (i % 2) + some(draw.randint(0, 12))
        out.append((i, draw.choice([" ", "\n", "\t "]).join(text), ["en", "de", None][i % 3], ["s1", "s2", None, "s3", "s1"][i % 5]))
    out += [(200 + i, " ".join(passage), "en", "copies") for i in range(5)] + [(205, LONG, "en", "s1"), (206, LONG + " end", "en", "s2"), (207, "x " * 40, "de", "s1"), (208, "x " * 60, "de", "s1")]
    out += [(300, None, "fr", "none"), (301, "", "fr", "none"), (302, "  \n", None, None), (303, "ß é 中文　字 don't-Stop STOP", "fr", "s9"), (304, "Don't stop", "fr", "s9")]
    out += [(None, " ".join(passage), "en", "s1"), (None, " ".join(passage), "en", "s1"), (7, " ".join(passage), "en", "s2"), out[3], out[3], (-5, " ".join(passage[:14]), "en", "s2")]
    return out


def removed(rows, window):
    first = {}
    for doc, text, *_ in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1) if doc is not None else ():
            first[tuple(w[i : i + window])] = min(doc, first.get(tuple(w[i : i + window]), doc))
    out = []
    for doc, text, *_ in rows:
        w = words_of(text)
        gone = {j for i in range(len(w) - window + 1) if doc is not None and first[tuple(w[i : i + window])] < doc for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), tuple(sorted(gone))))
    return out


@pytest.mark.parametrize("window, hot", [(13, 1000), (13, 3), (4, 1000), (1, 1000)])
def test_substrings(spark, rows, monkeypatch, window, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    some = rows if window > 1 else [r for r in rows if len(r[1] or "") < 5000]
    got = substrings.remove_repeats(made(spark, some), window).collect()
    spans = lambda r: tuple(j for s in r.spans for j in range(s.start, s.end))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, spans(r)) for r in got), key=key) == sorted(removed(some, window), key=key)
    assert any(r.n_removed for r in got) and all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))


def test_first_documents_of_an_automaton():
    draw = random.Random(5)
    sequences = [[draw.randint(0, 3) for _ in range(draw.randint(1, 30))] for _ in range(40)]
    automaton = substrings.Automaton()
    for i, s in enumerate(sequences):
        automaton.add(s, 100 - i)
    automaton.finish()
    for window in (1, 3, 6):
        first = {}
        for i, s in enumerate(sequences):
            for j in range(len(s) - window + 1):
                first[tuple(s[j : j + window])] = 100 - i
        for s in sequences:
            assert automaton.first_of_windows(s, window) == [first[tuple(s[j : j + window])] for j in range(len(s) - window + 1)]


def audited(rows, least, top):
    text = lambda x: x or ""
    holders, counts = defaultdict(set), defaultdict(Counter)
    homes = {(text(lang), text(source)) for _, _, lang, source in rows}
    for doc, t, lang, source in rows:
        for term in TERM.findall(low(t)):
            holders[text(lang), term].add(("by text", t) if doc is None else doc)
            counts[text(lang), text(source)][term] += 1
    kept = defaultdict(list)
    for (lang, term), docs in holders.items():
        if len(docs) >= least:
            kept[lang].append(term)
    share = lambda c, lang: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept[lang]) + 2 * len(kept[lang])) for t in kept[lang]}
    far = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in homes:
        p = share(counts[lang, source], lang)
        whole = Counter()
        for a, b in homes:
            if a == lang:
                whole.update(counts[a, b])
        q = share(whole, lang)
        parts = {"pair": [(sum(far(p[t], r[t]) for t in p), b) for a, b in homes if a == lang and b != source for r in [share(counts[a, b], lang)]]}
        parts["term"] = [(far(p[t], q[t]), t) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("least, small", [(10, {}), (3, {"GATHERED": 500, "PENDING": 50, "CELLS": 14, "SHARD_BYTES": 2_000})])
def test_source_divergence(spark, rows, monkeypatch, least, small):
    for name, value in small.items():
        monkeypatch.setattr(divergence, name, value)
    some = [r for r in rows if len(r[1] or "") < 5000] + [(400 + i, "Re-count, re count; RECOUNT. www.re.org/re"[i:], "it", f"s{i % 3}") for i in range(12)]
    got = sorted(tuple(r) for r in divergence.audit(made(spark, some), least, 10).collect())
    assert got == audited(some, least, 10) and {r[2] for r in got} == {"pair", "term"}


def test_documents_of_a_term_are_counted_once_over_chunks(spark):
    """Nine documents hold both forms of a word, a tenth one of them; the other word has nine."""
    texts = [(i, "Word, word. other", "en", "a") for i in range(9)] + [(9, "word!", "en", "a"), (3, "other", "en", "a"), (3, "other", "en", "b")]
    assert [r.terms for r in divergence.kept_terms(made(spark, texts), 10).collect()] == [b"word"]


def test_shares_are_exact_for_large_counts():
    n = 10**11 + 7
    assert divergence.shares(np.array([n, 0]), 10**13 + 1, 5).tolist() == [1 + 10**9 * (n + 2) // (10**13 + 11), 1 + 2 * 10**9 // (10**13 + 11)]


def resampled(rows, target, percent, n, buckets, least, seed):
    def features(text):
        w = PLAIN.findall(low(text))
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(code(f) for x in texts for f in features(x)[0]) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc, text, *_ in rows:
        found, size = features(text)
        weight = sum(math.floor(1000 * math.log((t[code(f)] + 1) * (S + buckets) / ((s[code(f)] + 1) * (T + buckets)))) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), size))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], i) for i, r in enumerate(able[: percent * len(able) // 100], 1)]
    rest = [(*r[:4], None) for r in able[len(drawn) :] + [r for r in out if r[4] < least]]
    return drawn + rest


@pytest.mark.parametrize("n, buckets, percent, least", [(1, 10_000, 10, 20), (2, 100_000, 50, 0)])
def test_resampling(spark, rows, n, buckets, percent, least):
    target = ["a bb ccc a bb", "Don't stop; STOP don't", None, "x x x"]
    docs = made(spark, rows)
    got = resample.resample(docs, spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int"), percent, n, buckets, least, 2024).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(resampled(rows, target, percent, n, buckets, least, 2024), key=key)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, percent * sum(len(PLAIN.findall(low(r[1]))) >= least for r in rows) // 100 + 1))


def test_spans_of_runs_overlap():
    flat = resample.collapsed("One,two\n three- FOUR é")
    assert flat == "one two three four é".encode()
    assert [m.span() for m in resample.spans_of(2).finditer(flat, overlapped=True)] == [(0, 7), (4, 13), (8, 18), (14, 21)]


def test_empty_tables(spark, rows):
    empty = made(spark, rows).limit(0)
    assert substrings.remove_repeats(empty).collect() == [] and divergence.audit(empty).collect() == []
    assert resample.resample(empty, empty).collect() == []
    assert len(resample.resample(made(spark, rows[:5]), empty).collect()) == 5
    assert made(spark, rows).filter(F.col("doc_id") == 300).count() == 1
