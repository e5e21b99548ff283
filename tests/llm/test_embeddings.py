import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.llm import embeddings as E
from vecshift.llm.graph import components, forest


def brute(ids, vecs, threshold=0.95):
    ok = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vecs]
    n, parent, links = len(ids), list(range(len(ids))), [0] * len(ids)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: (links[i], low[find(i)]) for i in range(n)}


def made(rng, n, dim=16):
    base = rng.standard_normal((n, dim))
    near = base[: n // 2] + 0.05 * rng.standard_normal((n // 2, dim))
    return np.concatenate([base, near, base[: n // 4], np.repeat(base[:1], 40, 0), base[1:2] + 0.04 * rng.standard_normal((120, dim))])


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "RECALL", 0.9999)
    rng = np.random.default_rng(5)
    x = [list(map(float, np.float32(v))) for v in made(rng, 80)]
    x += [None, [], [0.0] * 16, [math.nan] * 16, [1.0, None] * 8, [math.inf] + [0.0] * 15, [1.0], [2.0], [-1.0]]
    ids = [int(i) for i in rng.permutation(len(x)) + 10]
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<float>").withColumn("rep", F.lit("clash")).withColumn("m", F.lit(0)).repartition(3)
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    want = brute(ids, x)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_recall_at_production_parameters(spark):
    d = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {r.vec_id: int(n) - 1 for r, n in zip(rows, (x @ x.T >= 0.95).sum(1), strict=True)}
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.9 * sum(want.values())


def test_any_magnitude(spark):
    big = [[1e200, 1e200, 0.0], [1.0, 1.0, 1e-3], [1e-300, 1.01e-300, 0.0], [-1e300, -1e300, 0.0], [1e308, 0.0, 1e-308], [5e-324, 0.0, 0.0], [0.0, 5e-324, 5e-324]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_hot_bucket_in_blocks(spark, monkeypatch):
    """A thousand near copies of one vector: counts stay exact where all tables hold them in one bucket of several blocks."""
    monkeypatch.setattr(E, "BLOCK", 200)
    rng = np.random.default_rng(2)
    x = np.float32(rng.standard_normal(24) + 0.02 * rng.standard_normal((1000, 24)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = E.near_duplicates(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(999, 0)}


def test_empty_null_and_repeated_ids(spark):
    s = "vec_id long, embedding array<double>"
    assert E.near_duplicates(spark.createDataFrame([], s)).count() == 0
    got = E.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])], s)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got) == [(-1, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_components(spark):
    rng = np.random.default_rng(1)
    e = [(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, 300, (200, 2)) if a != b] + [(1000 + i, 999 + i) for i in range(1, 40)] + [(500, i) for i in range(400, 450)]
    nodes = sorted({x for p in e for x in p})
    low = {x: x for x in nodes}
    for _ in nodes:
        for a, b in e:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.child: r.root for r in components(spark.createDataFrame(e, "child long, parent long")).collect()}
    assert {x: got.get(x, x) for x in nodes} == low
    ids = np.array(nodes)
    at = {x: i for i, x in enumerate(nodes)}
    c, p = forest(len(ids), np.array([at[a] for a, _ in e]), np.array([at[b] for _, b in e]), ids)
    assert {x: dict(zip(c.tolist(), p.tolist())).get(x, x) for x in nodes} == low
