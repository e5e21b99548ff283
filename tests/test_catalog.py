"""Every catalogued query against DuckDB on the same tables, and the properties of those that SQL can't express."""

import math

import duckdb
import pytest

from vecshift.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 8) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert got == want


def test_queries_without_sql(spark):
    rest = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert rest == {"ivf_probe_recall", "bootstrap_ci", "hash_embedding_rows", "ordered_dataset_fingerprint"}
    recall = [r.overlap for r in catalog.QUERIES["ivf_probe_recall"](spark, DIR).collect()]
    assert len(recall) == 25 and sum(recall) / len(recall) >= 0.9
    ci = catalog.QUERIES["bootstrap_ci"](spark, DIR).first()
    assert ci.low <= ci.mean <= ci.high and ci.draws == 10_000


@pytest.mark.parametrize("d", [DIR, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_coarse_index_recall(spark, d):
    recall = [r.overlap for r in catalog.QUERIES["ivf_probe_recall"](spark, d).collect()]
    assert recall and sum(recall) / len(recall) >= 0.9


def test_stored_coarse_index(spark, tmp_path, monkeypatch):
    """The index written by cell gives the rows of the one in memory, and reads the probed cells only."""
    from vecshift.operators import retrieval
    from vecshift.plans import fixtures as X
    from vecshift.sources.readers import write_index

    c, q = X.corpus(spark, DIR), X.queries(spark, DIR).limit(3)
    centroids = retrieval.ivf_train(c, 16)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(retrieval.ivf_search(c, q, 10, 16, 4, centroids))
    write_index(retrieval.ivf_assign(c, centroids), str(tmp_path / "index"), "cell")
    stored = spark.read.parquet(str(tmp_path / "index"))
    found = retrieval.ivf_search(stored, q, 10, 16, 4, centroids)
    assert rows(found) == want and len(want) == 30
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    monkeypatch.setattr(retrieval, "CELLS", 35)  # three blocks of queries, a few scores at a time
    assert rows(retrieval.ivf_search(c, q, 10, 16, 4, centroids)) == want
    assert rows(retrieval.ivf_search(c, q, 10, 16, 16, centroids)) == rows(retrieval.topk(c, q, 10))
