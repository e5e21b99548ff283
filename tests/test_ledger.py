"""Prewarm plans: what makes one invalid, and runs that are lost half-way."""

import pytest
from pyspark.sql import functions as F

from vecshift import api
from vecshift.functions.encoders import FeatureHashModel
from vecshift.operators import prewarm
from vecshift.operators.ledger import PrewarmRun
from vecshift.operators.serving import TargetStore

HERE = {"source_fingerprint": "s", "backend": "parquet", "telemetry_fingerprint": "t", "index_identity_fingerprint": "i", "candidate_k": 50}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, None if i % 9 == 4 else f"text number {i % 13}") for i in range(60)], "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def traffic(docs):
    return docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 10 + 1).alias("occurrences"))


def chosen(traffic, n=40):
    none = traffic.limit(0).select("document_id")
    return prewarm.hot_set(traffic, none, n).cache()


def contents(run):
    entries = sorted(map(tuple, run.ledger.read().collect()), key=str)
    vectors = sorted((r.doc_id, tuple(r.v)) for r in run.store.vectors.read().collect())
    return entries, vectors, tuple(run.status().first())


def test_a_lost_run_ends_as_if_nothing_had_happened(spark, docs, traffic, tmp_path, monkeypatch):
    c = chosen(traffic)

    def make(name):
        store = TargetStore(spark, str(tmp_path / name), FeatureHashModel())
        if not store.vectors.versions():
            store.encode(docs.where("doc_id IN (9, 19, 3)"))
        return PrewarmRun(str(tmp_path / name / "ledger"), c, store, docs, "plan", batch=12)

    whole = make("whole")
    whole.run()
    lost = make("lost")
    lost.run(1)
    assert lost.status().first().status == "INTERRUPTED"
    for where in ("store", "ledger"):  # before the vectors are stored, and between that and the entry
        lost = make("lost")
        with monkeypatch.context() as m:
            part = lost.store.vectors if where == "store" else lost.ledger
            m.setattr(part, "append", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                lost.run()
    lost = make("lost")
    lost.run()
    assert contents(lost) == contents(whole)
    entries, vectors, _ = contents(whole)
    bad = {r.document_id for r in c.collect() if r.document_id % 9 == 4}
    s = whole.status().first()
    assert (s.planned, s.already_warm, s.encoded, s.failed, s.remaining, s.status) == (40, 3 if 3 in {r.document_id for r in c.collect()} else 2, 40 - len(bad) - (s.already_warm), len(bad), len(bad), "PARTIAL")
    assert len({d for d, _ in vectors}) == len(vectors) and {(e[0], e[2]) for e in entries if e[2] == "failed"} == {(d, "failed") for d in bad}
    assert all(sum(e[0] == d and e[2] == "failed" for e in entries) == 3 for d in bad)  # three attempts each
    whole.run()
    assert contents(whole)[0] == entries  # nothing left to do


def test_completed_noop_and_foreign_ledgers(spark, docs, traffic, tmp_path):
    store = TargetStore(spark, str(tmp_path / "s"), FeatureHashModel())
    good = docs.where("text IS NOT NULL")
    c = chosen(traffic.join(good.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi"), 20)
    run = PrewarmRun(str(tmp_path / "a"), c, store, docs, "plan", batch=50)
    assert run.status().first().status == "INTERRUPTED"
    run.run()
    assert tuple(run.status().first()) == (20, 0, 20, 0, 0, 1.0, "COMPLETED")
    again = PrewarmRun(str(tmp_path / "b"), c, store, docs, "plan", batch=50)
    again.run()
    assert again.status().first().status == "NOOP"
    with pytest.raises(ValueError):
        PrewarmRun(str(tmp_path / "a"), c, store, docs, "other plan", batch=50)
    empty = PrewarmRun(str(tmp_path / "c"), c.limit(0), store, docs, "plan")
    empty.run()
    assert tuple(empty.status().first()) == (0, 0, 0, 0, 0, 0.0, "NOOP")


def test_plan_files_and_identities(spark, docs, traffic, tmp_path):
    s = api.MigrationSession(docs, None, FeatureHashModel(), str(tmp_path / "store"))
    bound = {**HERE, "target_fingerprint": s.model.fingerprint()}
    plan = api.prewarm_plan(traffic, s.warm(), "config", 15, bindings=bound)
    print_ = plan.save(str(tmp_path / "plan"))
    back = api.PrewarmPlan.load(spark, str(tmp_path / "plan"))
    assert back.fingerprint.first().fingerprint == print_ and back.bindings == bound and back.violations(bound) == []
    assert [r.document_id for r in back.chosen.orderBy("rank").collect()] == [r.document_id for r in plan.chosen.orderBy("rank").collect()]
    row = s.run_plan(back, str(tmp_path / "ledger"), HERE, batch=4).first()
    assert row.planned == 15 and row.encoded + row.failed == 15
    other = {**bound, "backend": "else", "candidate_k": 10, "telemetry_fingerprint": " "}
    assert back.violations(other) == ["backend differs", "candidate_k differs", "telemetry_fingerprint unknown here"]
    with pytest.raises(ValueError, match="backend differs"):
        s.run_plan(back, str(tmp_path / "ledger2"), {**HERE, "backend": "else"})
    unbound = api.prewarm_plan(traffic, s.warm(), "config", 15)
    assert len(unbound.violations(bound)) == 5
    store = api.Snapshots(spark, str(tmp_path / "plan"), prewarm.CHOSEN)
    store.replace(store.read().where("rank > 1"), 1)
    with pytest.raises(ValueError, match="fingerprint"):
        api.PrewarmPlan.load(spark, str(tmp_path / "plan"))
