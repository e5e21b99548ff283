"""The stored index: build, append, load, search, and what it refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.operators import retrieval
from vecshift.sources.index import VectorIndex
from vecshift.sources.index_source import IndexSource
from vecshift.sources.snapshots import Conflict, Snapshots


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8)) * 3
    rows = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(8)]) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.where("doc_id % 40 = 7").withColumnRenamed("doc_id", "query_id")


def rows(df, digits=6):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, digits)) for r in df.collect())


def test_build_append_load_search(spark, corpus, queries, tmp_path):
    path = str(tmp_path / "index")
    first = VectorIndex.build(corpus.where("doc_id < 200"), path, cells=6, probes=2)
    assert (first.version, first.meta["size"], first.meta["metric"], first.meta["dimension"], first.meta["probes"]) == (1, 200, "cosine", 8, 2)
    second = first.append(corpus.where("doc_id >= 200"))
    assert (second.version, second.meta["size"]) == (2, 240) and second.audit().count() == 0
    assert {r.cell: r.vectors for r in second.counts().collect()} == {r.cell: r["count"] for r in second.rows().groupBy("cell").count().collect()}
    again = VectorIndex.load(spark, path, "cos", 8)
    assert rows(again.search(queries, 10, probes=6)) == rows(retrieval.topk(corpus, queries, 10))
    c = again.centroids
    near = retrieval.ivf_assign(corpus.select("doc_id", "v"), c)
    assert rows(again.search(queries, 10)) == rows(retrieval.ivf_search(near, queries, 10, 6, 2, c))
    assert VectorIndex.load(spark, path, version=1).rows().count() == 200
    assert np.allclose([np.linalg.norm(r.v) for r in again.rows().limit(5).collect()], 1)


def test_probed_cells_alone_are_read(spark, corpus, queries, tmp_path):
    ix = VectorIndex.build(corpus, str(tmp_path / "index"), cells=6, probes=1)
    found = ix.search(queries.limit(1), 5)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SubqueryAdaptiveBroadcast dynamicpruning" in plan


def test_exact_below_the_least_size_and_by_inner_product(spark, corpus, queries, tmp_path):
    small = corpus.where("doc_id < 38")
    ix = VectorIndex.build(small, str(tmp_path / "a"), cells=9)
    assert ix.meta["cells"] == 1 and rows(ix.search(queries, 5)) == rows(retrieval.topk(small, queries, 5))
    ix = VectorIndex.build(corpus, str(tmp_path / "b"), "ip", cells=4, probes=4)
    assert ix.meta["metric"] == "dot" and rows(ix.search(queries, 5)) == rows(retrieval.topk(corpus, queries, 5, "dot"))


def test_refusals(spark, corpus, queries, tmp_path):
    path = str(tmp_path / "index")
    ix = VectorIndex.build(corpus, path, cells=6)
    v = lambda *x: spark.createDataFrame(x, "doc_id long, v array<double>")
    ok = [1.0] * 8
    for bad, why in (
        (v((900, [1.0] * 7)), "bad_vectors"), (v((900, [float("nan")] + [0.0] * 7)), "bad_vectors"), (v((900, None)), "bad_vectors"), (v((None, ok)), "null_ids"),
        (v((900, [0.0] * 8)), "zero_vectors"), (v((900, [1e-13] * 8)), "zero_vectors"), (v((900, ok), (900, ok)), "repeated ids"), (v((5, ok)), "that the index has"), (v(), "no vectors"),
    ):
        with pytest.raises(ValueError, match=why):
            ix.append(bad)
    assert VectorIndex.load(spark, path).version == 1
    with pytest.raises(ValueError, match="metric cosine"):
        VectorIndex.load(spark, path, "dot")
    with pytest.raises(ValueError, match="dimension 8"):
        VectorIndex.load(spark, path, dimension=9)
    with pytest.raises(FileNotFoundError):
        VectorIndex.load(spark, str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        VectorIndex.build(corpus, path)
    for options in ({"metric": "l2"}, {"cells": 0}, {"cells": True}, {"probes": 0}):
        with pytest.raises(ValueError):
            VectorIndex.build(corpus, str(tmp_path / "x"), **options)
    with pytest.raises(ValueError):
        VectorIndex.build(v(), str(tmp_path / "x"))
    with pytest.raises(Exception, match="invalid query vector of 3"):
        ix.search(spark.createDataFrame([(3, [0.0] * 8)], "query_id long, v array<double>"), 3).collect()


def test_an_append_checked_against_an_old_version_is_told(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    mine = VectorIndex.build(corpus.where("doc_id < 100"), path, cells=6)
    VectorIndex.load(spark, path).append(corpus.where("doc_id BETWEEN 100 AND 120"))
    with pytest.raises(Conflict):
        mine.append(corpus.where("doc_id > 120"))
    ix = VectorIndex.load(spark, path).append(corpus.where("doc_id > 120"))
    assert ix.meta["size"] == 240 and ix.rows().select("doc_id").distinct().count() == 240


def test_audit_finds_lost_and_misplaced_vectors(spark, corpus, tmp_path):
    ix = VectorIndex.build(corpus, str(tmp_path / "index"), cells=6)
    moved = ix.rows().where("doc_id <> 8").withColumn("cell", F.when(F.col("doc_id") == 3, (F.col("cell") + 1) % 6).otherwise(F.col("cell")))
    ix.store.replace(moved, ix.version)
    found = VectorIndex.load(spark, ix.path).audit().collect()
    assert sum(r.misplaced for r in found) == 1 and sum(abs(r.stated - r.stored) for r in found) == 3


def test_snapshots_of_two_writers(spark, tmp_path):
    row = lambda *x: spark.createDataFrame([(i,) for i in x], "a long")
    a, b = (Snapshots(spark, str(tmp_path / "t"), "a long") for _ in range(2))
    assert a.read().count() == 0 and a.append(row(1)) == 1
    base, part = b.manifest(), b.write(row(2))  # b has read version 1 and written its rows
    assert a.append(row(3)) == 2
    with pytest.raises(Conflict):
        b.publish([*base["parts"], part], base["version"], {})
    assert b.add(part) == 3  # after the other's
    assert {r.a for r in a.read().collect()} == {1, 2, 3} and {r.a for r in a.read(2).collect()} == {1, 3}
    with pytest.raises(Conflict):
        a.replace(row(9), 2)
    assert a.replace(row(9), 3) == 4 and [r.a for r in b.read().collect()] == [9] and b.read(3).count() == 3
    a.write(row(7))  # a lost writer's part is in no version
    assert b.read().count() == 1 and b.versions() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        b.read(8)


def test_as_a_data_source(spark, corpus, queries, tmp_path):
    path = str(tmp_path / "index")
    VectorIndex.build(corpus.where("doc_id < 200"), path, cells=6).append(corpus.where("doc_id >= 200"))
    spark.dataSource.register(IndexSource)
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        x = spark.read.format("vecshift_index").load(path)
        row = lambda r: (r.doc_id, r.cell, tuple(r.v))
        stored = VectorIndex.load(spark, path).rows()
        assert sorted(map(row, x.collect())) == sorted(map(row, stored.collect())) and x.rdd.getNumPartitions() == 6
        for where, cells in (("cell = 2", 1), ("cell IN (1, 4) AND doc_id > 150", 2), ("cell = 77", 1), ("doc_id IN (3, 210, 999)", 6), ("doc_id BETWEEN 20 AND 22 AND v[0] > 0", 6)):
            found = spark.read.format("vecshift_index").load(path).where(where)
            assert sorted(map(row, found.collect())) == sorted(map(row, stored.where(where).collect())), where
            assert found.rdd.getNumPartitions() == cells
        assert spark.read.format("vecshift_index").option("version", 1).load(path).count() == 200
        assert rows(retrieval.topk(x, queries, 5)) == rows(retrieval.topk(stored, queries, 5))
        with pytest.raises(Exception, match="no version 9"):
            spark.read.format("vecshift_index").option("version", 9).load(path).count()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_best_of_a_block_in_bounded_memory(monkeypatch):
    """What a task holds follows the results, not the scores; equal scores at the k-th place go to the smaller id."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x, q = np.round(rng.normal(size=(6000, 8)), 1), np.round(rng.normal(size=(300, 8)), 1)
    doc = rng.permutation(6000)
    monkeypatch.setattr(retrieval, "CELLS", 1 << 16)
    best = retrieval._Best(300, 200)
    tracemalloc.start()
    most = 0
    for lo in range(0, 6000, 1500):
        best.add(x[lo : lo + 1500], doc[lo : lo + 1500], q, "dot")
        most = max(most, best.size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= best.most and peak < 12 << 20  # the scores of one batch take 3.6 MB, with ids and order a multiple of it
    got = [(int(i), int(d), s) for b in best.batches(np.arange(300)) for i, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    s = retrieval.scores(x, q, "dot")
    want = [(i, int(doc[j]), s[j, i]) for i in range(300) for j in np.lexsort((doc, -s[:, i]))[:200]]
    assert got == want
    some = retrieval._Best(300, 3)
    some.add(x[:50], doc[:50], q[[7, 9]], "dot", np.array([7, 9]))
    assert sorted({int(i) for b in some.batches(np.arange(300)) for i in b.column(0).to_pylist()}) == [7, 9]


def test_only_results_and_ties_are_sorted(monkeypatch):
    """A cut finds each query's k-th score without sorting what is held; queries with few scores and with very many stand side by side."""
    monkeypatch.setattr(retrieval, "CELLS", 1 << 12)
    rng, sorted_, lexsort = np.random.default_rng(6), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sorted_.append(len(keys[0])), lexsort(keys))[1])
    x, q, doc = rng.normal(size=(4000, 4)), rng.normal(size=(40, 4)), rng.permutation(4000)
    best = retrieval._Best(40, 10)
    for lo in range(0, 4000, 500):
        best.add(x[lo : lo + 500], doc[lo : lo + 500], q[:1], "dot", np.array([0]))
    best.add(x[:5], doc[:5], q[1:], "dot", np.arange(1, 40))
    got = [(int(i), int(d)) for b in best.batches(np.arange(40)) for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    s = retrieval.scores(x, q, "dot")
    assert got == [(i, int(doc[j])) for i in range(40) for j in lexsort((doc[: 5 if i else 4000], -s[: 5 if i else 4000, i]))[:10]]
    assert max(sorted_) == len(got) == 10 + 39 * 5
