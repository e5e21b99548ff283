"""Search rounds with a budget, the store they feed, and the queue that is drained in the background."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift import api
from vecshift.functions.encoders import EmbeddingModel, FeatureHashModel, HashModel, attempts, encode, feature_hash
from vecshift.operators.serving import TargetStore


class Fragile(FeatureHashModel):
    """Fails on a batch with a text that says so."""

    def encode(self, texts):
        if any("poison" in t for t in texts):
            raise RuntimeError(f"can't read {texts}")
        out = super().encode(texts)
        out[["infinite" in t for t in texts]] = np.inf
        return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i % 7} word{i % 11} word{i % 3}") for i in range(40)] + [(40, "poison"), (41, None), (42, "  "), (43, "infinite words")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def candidates(spark, *lists):
    return spark.createDataFrame([(q, d, i) for q, ds in lists for i, d in enumerate(ds)], "query_id long, doc_id long, source_rank int")


def actions(r, query):
    return {x.doc_id: x.action for x in r.hits.where(f"query_id = {query}").collect()}


def test_rounds(spark, docs, tmp_path):
    model = Fragile()
    s = TargetStore(spark, str(tmp_path), model)
    q = encode(spark.createDataFrame([(1, "word1 word2"), (2, "word3 word3"), (3, "word0")], "query_id long, text string"), model, "query_id")
    c = candidates(spark, (1, [0, 1, 2, 3]), (2, [2, 1, 5, 6]), (3, [7, 8]))
    one = s.search(c, q, docs, 2)
    assert actions(one, 1) == {0: "encoded", 1: "encoded", 2: "shared", 3: "queued"}
    assert actions(one, 2) == {2: "encoded", 1: "encoded", 5: "queued", 6: "queued"}
    assert actions(one, 3) == {7: "encoded", 8: "encoded"}
    assert (one.encoded, one.failed, one.queued) == (5, 0, 3)  # 1 and 2 once, although two queries ask
    assert s.vectors.read().count() == 5
    state = {r.query_id: (r.candidates, r.cached, r.encoded, r.shared, r.queued, r.state) for r in one.summary().collect()}
    assert state == {1: (4, 0, 2, 1, 1, "PARTIAL"), 2: (4, 0, 2, 0, 2, "PARTIAL"), 3: (2, 0, 2, 0, 0, "WARM")}
    two = s.search(c, q, docs, 2)
    assert {r.state for r in two.summary().collect()} == {"WARM"} and (two.encoded, two.queued) == (3, 0)
    assert actions(two, 1) == {0: "cached", 1: "cached", 2: "cached", 3: "encoded"}
    vec = {r.doc_id: np.array(r.v) for r in encode(docs.where("doc_id < 10"), model).collect()}
    for query, v in ((r.query_id, np.array(r.v)) for r in q.collect()):
        rows = sorted(two.hits.where(f"query_id = {query}").collect(), key=lambda r: r.position)
        want = sorted((-round(float(vec[r.doc_id] @ v), 9), r.source_rank) for r in rows)
        assert [(-r.score, r.source_rank) for r in rows] == want
    # the queue still has what was queued; draining finds it in the store
    assert s.drain(docs, 100) == (3, 0) and s.vectors.read().count() == 8


def test_cold_budget_and_queue(spark, docs, tmp_path):
    s = TargetStore(spark, str(tmp_path), Fragile(), max_attempts=2)
    q = encode(spark.createDataFrame([(1, "word1")], "query_id long, text string"), s.model, "query_id")
    c = candidates(spark, (1, [9, 40, 41, 43, 99, 10]))
    cold = s.search(c, q, docs, 0)
    assert {(r.state, r.score) for r in cold.hits.collect()} == {("COLD", None)}
    assert [r.doc_id for r in cold.hits.orderBy("position").collect()] == [9, 40, 41, 43, 99, 10] and cold.queued == 6
    assert s.drain(docs, 4) == (2, 2)  # 9 and 10 encoded, 40 and 41 failed: by id among those queued together
    status = lambda: {r.document_id: (r.status, r.attempts) for r in s.queue().collect()}
    assert status() == {9: ("done", 1), 10: ("done", 1), 40: ("pending", 1), 41: ("pending", 1), 43: ("pending", 0), 99: ("pending", 0)}
    assert s.drain(docs, 10) == (0, 4) and s.drain(docs, 10) == (0, 2) and s.drain(docs, 10) == (0, 0)
    assert {d for d, x in status().items() if x == ("error", 2)} == {40, 41, 43, 99}
    said = {r.document_id: r.error for r in s.events.read().where("kind = 'fail'").collect()}
    assert said == {40: "RuntimeError during encoding", 41: "document text is unavailable", 43: "vector is not finite", 99: "document text is unavailable"}
    part = s.search(c, q, docs, 3)  # given up: not queued again
    assert (part.encoded, part.failed, part.queued) == (0, 3, 0) and actions(part, 1)[40] == "queued"
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 9, "other words").otherwise(F.col("text")))
    again = s.search(c, q, changed, 0)
    assert actions(again, 1)[9] == "queued" and again.queued == 1 and status()[9] == ("pending", 0)
    assert s.drain(changed, 1) == (1, 0) and s.vectors.read().count() == 3
    with pytest.raises(ValueError):
        s.search(c, q, docs, -1)


def test_a_drain_lost_before_its_entry(spark, docs, tmp_path, monkeypatch):
    s = TargetStore(spark, str(tmp_path), FeatureHashModel())
    s.enqueue(docs.where("doc_id < 6").select(F.col("doc_id").alias("document_id")))
    with monkeypatch.context() as m:
        m.setattr(s.events, "append", lambda rows: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            s.drain(docs, 4)
    assert s.vectors.read().count() == 4 and {r.status for r in s.queue().collect()} == {"pending"}
    assert s.drain(docs, 6) == (6, 0) and s.vectors.read().count() == 6  # four were there


def test_session_with_budget_and_two_models(spark, tmp_path):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 40, 12))) for i in range(60)], "doc_id long, text string")
    texts = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    old = HashModel(8, seed=1)
    index, queries = encode(docs, old).cache(), encode(texts, old, "query_id").cache()
    a, b = (api.MigrationSession(docs, index, m, str(tmp_path)) for m in (HashModel(16), FeatureHashModel(16)))
    first = a.search(queries, texts, 10, budget=10)
    assert {r.state for r in first.collect()} == {"WARM"} and first.where("text IS NULL").count() == 0
    assert {r.action for r in a.search(queries, texts, 10).collect()} == {"cached"}
    assert a.export_target().count() == 60 and b.export_target().count() == 60
    for s in (a, b):  # each its own vectors only
        v = {r.doc_id: r.v for r in s.export_target().collect()}
        assert len(v) == 60 and np.allclose(v[7], encode(docs.where("doc_id = 7"), s.model).first().v)
    assert a.vectors().count() == 120
    assert {r.state for r in b.search(queries, texts, 30).collect()} == {"WARM"}
    assert b.store.queue().count() == 0 and b.drain() == (0, 0)


def test_repeated_documents_are_encoded_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (1, "other")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, v array<double>, content_fingerprint string, model_fingerprint string")
    out = attempts(docs, none, FeatureHashModel()).collect()
    assert sorted((r.doc_id, r.error) for r in out) == [(1, None), (1, None), (2, None)]


def test_feature_hash_model_equals_the_query(spark):
    docs = spark.createDataFrame([(1, "Some words, some more words"), (2, "x"), (3, "...")], "doc_id long, text string")
    slots = {(r.doc_id, r.slot): r.weight for r in feature_hash(docs).collect()}
    for r in encode(docs, FeatureHashModel()).collect():
        assert {(r.doc_id, i): round(x, 9) for i, x in enumerate(r.v) if x} == {k: w for k, w in slots.items() if k[0] == r.doc_id}
    assert issubclass(FeatureHashModel, EmbeddingModel)
