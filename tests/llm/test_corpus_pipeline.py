from collections import Counter

import corpus_pipeline

from tallyweave.llm import bpe, mixing, neardup, secretscan, toxicity


def test_stages_keep_what_they_should(spark):
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mix", "encode"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.materialize(stage(spark, frames[-1], sf)))
        if stage is not corpus_pipeline.encode:
            assert frames[-1].columns == docs.columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    field = toxicity.fit(docs, toxicity.labelled_sample(corpus_pipeline.table(spark, sf, "labels")))
    assert ids[0] - ids[1] == {r.doc_id for r in toxicity.score_documents(docs, field).filter("score >= 0.3").collect()}
    assert ids[1] - ids[2] == {r.doc_id for r in neardup.near_duplicates(frames[1]).filter("not kept").collect()}
    assert ids[2] == ids[3] and secretscan.scan_versions(frames[3])[0].filter("size(spans) > 0").count() == 0
    taken = {r.doc_id for r in mixing.taken_words(mixing.mix_sources(frames[3])).filter("taken > 0").collect()}
    assert ids[4] == taken == ids[5] and frames[4].count() == frames[5].count() >= len(taken)
    import public_tokenizers

    text = {r.doc_id: r.text for r in frames[4].collect()}
    words = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert all(b"".join(words[i] for i in r.ids).decode() == text[r.doc_id] for r in frames[5].collect())


def write(spark, folder, rows, labels):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, _copy int, _spans string, _blob string, _id int, score double, spans int, size int, row int, ids string"
    frame = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "s", "b", 2, 0.5, 3, 4, 5, "i") for i, t, s in rows], kinds)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return frame


def test_run_with_every_odd_case(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, clashing columns, very long texts; the result against what each
    stage must do, worked out apart from it."""
    import public_tokenizers
    import tiktoken

    letters = str.maketrans("0123456789", "abcdefghij")
    say = lambda i, n: " ".join(f"w{i}x{j}".translate(letters) for j in range(n))
    rows = [(i, say(i, 60 + i), "ab"[i % 2]) for i in range(200)]
    toxic = [(i, f"{say(i, 40)} idiot {say(i + 1000, 20)} moron {say(i + 2000, 3)}", "a") for i in range(200, 260)]
    odd = [(300, None, "a"), (301, "", None), (None, say(500, 50), "b"), (None, say(500, 50), "b"), (302, say(501, 90) + " password = hunter22", None), (303, say(502, 20_000), "a")]
    copies = [(310 + i, say(600, 100), "a") for i in range(40)] + [(400, say(600, 99) + " other", "b")] + [(401, say(601, 80), "b")] * 5 + [(401, say(602, 80), "b")]
    frame = write(spark, str(tmp_path), rows + toxic + odd + copies, [(i, 0, 0) for i in range(0, 200, 2)] + [(i, 0, 1) for i in range(200, 260, 2)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs, stages = corpus_pipeline.table(spark, str(tmp_path), "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert stage is corpus_pipeline.encode or docs.columns == frame.columns
        stages.append(docs.collect())
    key = lambda r: (r.doc_id, r.text)
    left = Counter((i, t) for i, t, _ in rows + odd + copies)
    assert Counter(map(key, stages[0])) == left
    left[None, say(500, 50)] = left[401, say(601, 80)] = 1
    gone = {(310 + i, say(600, 100)) for i in range(1, 40)} | {(400, say(600, 99) + " other")}
    left = Counter({k: n for k, n in left.items() if k not in gone})
    assert Counter(map(key, stages[1])) == left
    masked = Counter({(i, t and t.replace("password = hunter22", "[secret]")): n for (i, t), n in left.items()})
    assert Counter(map(key, stages[2])) == masked
    sizes, taken = Counter(), Counter()
    for r in stages[2]:
        sizes[r.source] += len((r.text or "").split())
    for r in stages[3]:
        taken[r.source] += len(r.text.split())
    weight, total = {"a": 5, "b": 2, None: 1}, 1.5 * sum(sizes.values())
    want: dict = {}
    while set(want) != set(weight):
        level = (total - sum(want.values())) / sum(w for s, w in weight.items() if s not in want)
        over = {s: 2.0 * sizes[s] for s, w in weight.items() if s not in want and 2 * sizes[s] <= level * w}
        want |= over or {s: level * w for s, w in weight.items() if s not in want}
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 128 for s in want)
    assert all((r.n_chars == len(r.text)) and (r._copy, r._spans, r._blob, r.score, r.ids) == (1, "s", "b", 0.5, "i") for r in stages[3])
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == Counter((r.doc_id, r.source, tuple(theirs.encode_ordinary(r.text))) for r in stages[3])


def test_run_on_an_empty_table(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
