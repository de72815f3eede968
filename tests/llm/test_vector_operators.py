"""Vector searches against brute force."""

import numpy as np
import pytest

from tallyweave.llm import covertree, hnsw

SCHEMA = "vec_id bigint, embedding array<float>, score double, shard int, dim int, rank int"


@pytest.fixture(scope="module")
def table(spark):
    random = np.random.default_rng(0)
    centres = random.normal(size=(6, 16))
    x = (centres[random.integers(0, 6, 1500)] + 0.4 * random.normal(size=(1500, 16))).astype(np.float32)
    x[300:600] = x[300]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (2005, []), (None, [1.0] * 16), (2020, [1.0, 2.0])]
    return x.astype(float), spark.createDataFrame([(*r, 0.0, 1, 2, 3) for r in rows + odd], SCHEMA).repartition(4)


def test_nearest_neighbours(spark, table):
    x, frame = table
    rows = hnsw.nearest_neighbours(frame, k=10, query_step=100, shard_rows=400).collect()
    found, met = 0, {r.query_id for r in rows}
    assert met == set(range(0, 1500, 100))
    for q in met:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r.score == d[r.vec_id] and r.vec_id != q for r in mine)
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        found += len({r.vec_id for r in mine} & set(map(int, order)))
        if 300 <= q < 600:
            assert [r.vec_id for r in mine] == order  # copies of the query, smallest ids first
    assert found >= 0.95 * 150


def test_top_inner_products(spark, table):
    x, frame = table
    rows = covertree.top_inner_products(frame, k=20, query_step=20, shard_rows=500).collect()
    z = np.floor(64 * np.concatenate([x, np.zeros((1, 16))]))
    ids = np.array([*range(1500), 2001])
    for q in range(0, 1500, 20):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        s = z @ z[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        assert [(r.vec_id, r.score) for r in mine] == [(int(ids[i]), int(s[i])) for i in order]
    assert not [r for r in rows if r.query_id == 2020]


def test_few_and_large_vectors(spark):
    frame = spark.createDataFrame([(0, [1e30, 1.0]), (20, [1.0, -2.0]), (21, [0.5, 0.25])], "vec_id bigint, embedding array<double>")
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in covertree.top_inner_products(frame, 20, 20).collect()}
    assert len(rows) == 4 and rows[(20, 1)] == (0, (1 << 63) - 1) and rows[(20, 2)] == (21, 64 * 32 - 128 * 16)
    assert hnsw.nearest_neighbours(frame, 10, 20).count() == 4
    assert hnsw.nearest_neighbours(frame.filter("false"), 10, 20).count() == 0 and covertree.top_inner_products(frame.filter("false"), 20, 20).count() == 0


def test_repeated_ids(spark):
    """Of an id's different vectors the least counts, and no neighbour is lost to the others."""
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=4).tolist()) for i in [*range(12), *[1] * 6, 0, 20, 20, 20]]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    kept = {i: np.array(min(v for j, v in rows if j == i)) for i, _ in rows}
    near = hnsw.nearest_neighbours(frame, k=10, query_step=20).collect()
    high = covertree.top_inner_products(frame, k=20, query_step=20).collect()
    for q in (0, 20):
        d = sorted((float(np.sqrt(((kept[q] - v) ** 2).sum())), i) for i, v in kept.items() if i != q)
        assert [(r.score, r.vec_id) for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == q] == d[:10]
        s = sorted((-int(np.floor(64 * kept[q]) @ np.floor(64 * v)), i) for i, v in kept.items() if i != q)
        assert [(-r.score, r.vec_id) for r in sorted(high, key=lambda r: r["rank"]) if r.query_id == q] == s


def test_products_of_large_vectors(spark):
    """Whole numbers up to 64 bits, against Python's integers, in trees of several levels."""
    random = np.random.default_rng(2)
    scale = 2.0 ** random.integers(0, 56, (700, 1))
    x = np.floor(random.normal(size=(700, 8)) * scale)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = covertree.top_inner_products(frame, k=20, query_step=20, scale=1, shard_rows=300).collect()
    whole = [[max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in row] for row in x]
    hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q in range(0, 700, 20):
        want = sorted((-hold(sum(a * b for a, b in zip(whole[q], w))), i) for i, w in enumerate(whole) if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_recall_over_several_shards(spark):
    """The given vectors in several shards of some thousand rows."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect() if r.embedding is not None]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got: dict[int, set[int]] = {}
    for r in hnsw.nearest_neighbours(frame, k=10, query_step=100, shard_rows=700).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        recall.append(len(got[int(q)] & set(map(int, want))) / len(want))
    assert np.mean(recall) >= 0.9
