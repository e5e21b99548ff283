import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift import api
from vecshift.__main__ import main
from vecshift.functions.encoders import HashModel, encode
from vecshift.operators import quality, retrieval


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 40, 12))) for i in range(120)], "doc_id long, text string")
    texts = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    old = HashModel(8, seed=1)
    return docs, texts, encode(docs, old).cache(), encode(texts, old, "query_id").cache(), str(tmp_path_factory.mktemp("api") / "store")


def test_session(spark, world):
    docs, texts, index, queries, store = world
    s = api.MigrationSession(docs, index, HashModel(16), store)
    assert tuple(s.status().first()) == (120, 0)
    cold = s.search(queries, texts, 10, budget=0)
    assert {r.state for r in cold.select("state").distinct().collect()} == {"COLD"}
    assert [r.source_rank for r in cold.where("query_id = 0").orderBy("position").collect()] == list(range(10))
    traffic = docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") + 1).alias("occurrences"))
    p, n = s.prewarm(traffic, max_docs=30)
    assert n == 30 and p.cap == 30 and s.prewarm(traffic, max_docs=0)[1] == 0
    assert {r.document_id for r in s.warm().collect()} == set(range(90, 120))
    assert {r.state for r in s.search(queries, texts, 60, budget=0).select("state").distinct().collect()} <= {"PARTIAL", "COLD"}
    target = s.export_target()
    assert target.count() == 120 and s.encode() == 0 and tuple(s.status().first()) == (120, 120)
    assert {r.state for r in s.search(queries, texts, 10, budget=0).select("state").distinct().collect()} == {"WARM"}
    a, plan = api.migrate(s, queries, texts, docs_per_s=100.0)
    row = plan.first()
    assert a.grid == [10, 20, 50, 100] and row.remaining == 0 and row.recommendation in ("PROCEED_WITH_CAUTION", "EXPAND_PROBE", "DEFER") and row.confidence == ("LIMITED" if row.probes else "INSUFFICIENT")


def test_probes_are_drawn_by_hash(spark, world, tmp_path):
    docs, texts, index, queries, _ = world
    s = api.MigrationSession(docs, index, HashModel(16), str(tmp_path / "store"))
    a, plan = api.migrate(s, queries, texts, limit=4, seed=7)
    drawn = sorted(hashlib.sha256(f"7:{i}".encode()).hexdigest() for i in (0, 20, 40, 60, 80, 100))[:4]
    assert {hashlib.sha256(f"7:{r.query_id}".encode()).hexdigest() for r in a.per_query.collect()} == set(drawn)
    assert plan.first().probes == 4


def test_changed_documents_are_not_served_from_old_vectors(spark, world, tmp_path):
    docs, texts, index, queries, _ = world
    s = api.MigrationSession(docs, index, HashModel(16), str(tmp_path / "store"))
    s.encode()
    changed = api.MigrationSession(docs.withColumn("text", F.when(F.col("doc_id") < 10, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))), index, HashModel(16), s.path)
    hits = changed.search(queries, texts, 120, budget=0)
    assert {r.doc_id for r in hits.where("action = 'queued'").collect()} == set(range(10)) and hits.where("text IS NULL").count() == 0
    assert changed.encode() == 10 and changed.search(queries, texts, 120, budget=0).where("action = 'queued'").count() == 0


def test_evaluate(spark, world):
    docs, texts, index, queries, _ = world
    qrels = texts.select("query_id", F.col("query_id").alias("doc_id"), F.lit(1).alias("relevance"))
    one, curve = api.evaluate(index, queries, index, queries, qrels, grid=(10, 50))
    r = one.first()
    assert (r.source_quality, r.native_quality, r.source_recall, r.queries) == (1.0, 1.0, 1.0, 6)
    assert {(c.k, c.candidate_gap, c.containment) for c in curve.collect()} == {(10, 0.0, 1.0), (50, 0.0, 1.0)}
    assert "first 10" in quality.report(curve).first().recommendation


def test_grid_cells_and_union(spark):
    assert quality.k_grid([50, 10, 10, 900], 60) == [10, 50]
    with pytest.raises(ValueError):
        quality.k_grid([True], 10)
    assert retrieval.ivf_cells(39, 9) == 9 and retrieval.ivf_cells(39, 10) is None and retrieval.ivf_cells(10, 2) is None
    c = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 6, 0)], "query_id long, doc_id long, source_rank long")
    assert {tuple(r) for r in retrieval.ordered_union(c).collect()} == {(5, 1, 0), (6, 1, 1)}


def test_command_line(spark, capsys, tmp_path):
    assert main(["list"]) == 0 and "topk_cosine" in capsys.readouterr().out
    assert main(["sql", "topk_cosine"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "nothing", "x"]) == 2
    assert main(["run", "index_health", "/root/testdata/sf0.001", "--format", "markdown"]) == 0 and "total" in capsys.readouterr().out
    assert main(["run", "queue_stats", "/root/testdata/sf0.001", "--format", "json", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 1
