"""Worked examples, edge cases and invariants of single operators."""

import hashlib
import json
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecshift.functions import encoders
from vecshift.functions import scalar as S
from vecshift.operators import cache, planning, prewarm, probe, quality, retrieval, telemetry

FEATURES = ["probe_residual_tail_50", "deepest_source_rank", "late_tail_area", "stability_50", "last_shell_any", "margin_nonpositive"]
#: Feature rows with the decision they must get (fixed values).
GOLDEN = [
    (0.0025210084033613, 58.0, 0.0177404295051353, 0.9974789915966388, 0.0, 0.1092436974789916, "SAFE"),
    (0.0919999999999999, 251.2, 0.2911111111111111, 0.908, 0.2, 0.5, "EXPAND"),
    (0.0699999999999999, 233.20000000000005, 0.2866666666666667, 0.93, 0.18, 0.7, "UNSAFE_OR_UNCERTAIN"),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_decisions(spark):
    df = spark.createDataFrame(GOLDEN, [*FEATURES, "want"])
    assert all(r.decision == r.want for r in probe.guarded_decision(df).collect())
    with pytest.raises(ValueError):
        probe.guarded_decision(df.withColumn("native_ndcg", F.lit(1.0)))
    with pytest.raises(ValueError):
        probe.guarded_decision(df.drop("stability_50"))
    with pytest.raises(PySparkException):
        probe.guarded_decision(df.withColumn("stability_50", F.lit(float("nan")))).collect()
    edge = spark.createDataFrame([(0.05, 200.0, 0.20, 0.95, 0.0, 0.0, "SAFE"), (0.10, 201.0, 0.0, 0.90, 0.25, 0.50, "EXPAND"), (0.1000001, 201.0, 0.0, 0.90, 0.25, 0.50, "UNSAFE_OR_UNCERTAIN")], [*FEATURES, "want"])
    assert all(r.decision == r.want for r in probe.guarded_decision(edge).collect())


def test_leaking_names(spark):
    df = spark.createDataFrame(GOLDEN, [*FEATURES, "want"])
    for name in ("qrels_n", "native_x", "ndcg", "Candidate_Gap_50", "G(50)", "target_rank", "label", "observed_k"):
        with pytest.raises(ValueError):
            probe.guarded_decision(df.withColumn(name, F.lit(1.0)))
    assert probe.ledger(df.withColumn("recall_id", F.lit(7)), ["recall_id"]).columns == ["recall_id", *probe.REQUIRED, "decision"]


def test_short_pool_reads_the_whole_pool(spark):
    """Twelve at the top of the grid, and the best ones only behind it."""
    c = [("q", f"d{i}", i, float(100 - i)) for i in range(100)] + [("q", f"e{i}", 100 + i, 200.0 + i) for i in range(4)]
    r = probe.short_pool_features(spark.createDataFrame(c, "query_id string, doc_id string, source_rank int, target_score double"), (10, 20, 50, 100)).first()
    assert (r.probe_residual_tail_50, r.stability_50, r.deepest_source_rank, r.late_tail_area, r.last_shell_any, r.margin_nonpositive) == (0.0, 1.0, 103.0, 0.4, 1.0, 0.0)
    few = probe.short_pool_features(spark.createDataFrame(c[:4], "query_id string, doc_id string, source_rank int, target_score double"), (10, 20)).first()
    assert few.stability_50 == 1.0 and few.late_tail_area == 0.0


def test_rerank_refuses_nan(spark):
    c = spark.createDataFrame([("q", "a", 0, 0.1), ("q", "b", 1, None), ("q", "c", 2, 0.1)], "query_id string, doc_id string, source_rank int, target_score double")
    assert [(r.doc_id, r.position) for r in retrieval.rerank(c).orderBy("position").collect()] == [("a", 1), ("c", 2)]
    with pytest.raises(PySparkException):
        retrieval.rerank(c.withColumn("target_score", F.lit(float("nan")))).collect()


def test_advice(spark):
    cols = "id int, preflight string, decision string, recommended_k int, probes int, verified boolean, ann_status string, exact_registry boolean"
    cases = [
        ("FAIL", "SAFE", 50, 200, True, "PASS", True, "BLOCKED", "STRONG"),
        ("PASS", None, None, 0, True, "PASS", False, "EXPAND_PROBE", "INSUFFICIENT"),
        ("PASS", "SAFE", 50, 0, True, "PASS", False, "EXPAND_PROBE", "INSUFFICIENT"),
        ("PASS", "SAFE", None, 200, True, "PASS", False, "EXPAND_PROBE", "STRONG"),
        ("PASS", "EXPAND", 50, 49, True, "PASS", True, "EXPAND_PROBE", "LIMITED"),
        ("PASS", "UNSAFE_OR_UNCERTAIN", None, 50, True, "PASS", True, "DEFER", "MODERATE"),
        ("PASS", "SAFE", 50, 100, True, "PASS", False, "PROCEED", "STRONG"),
        ("PASS", "SAFE", 50, 100, True, "UNKNOWN", True, "PROCEED", "STRONG"),
        ("WARN", "SAFE", 50, 100, True, "UNKNOWN", False, "PROCEED_WITH_CAUTION", "MODERATE"),
        ("PASS", "SAFE", 50, 99, True, "PASS", True, "PROCEED_WITH_CAUTION", "MODERATE"),
        ("PASS", "SAFE", 50, 49, True, "PASS", True, "PROCEED_WITH_CAUTION", "LIMITED"),
        ("PASS", "SAFE", 50, 500, False, "PASS", True, "PROCEED_WITH_CAUTION", "MODERATE"),
    ]
    x = planning.advisory(spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(cases)], cols))
    assert {r.id: (r.recommendation, r.confidence) for r in x.collect()} == {i: c[7:] for i, c in enumerate(cases)}
    names = {}
    for r in planning.rollout(x, "id").orderBy("phase").collect():
        names.setdefault(r.id, []).append((r["name"], r.traffic))
    assert names[6] == [("Validate", 0.0), ("Shadow", 0.0), ("Small canary", 0.05), ("Expanded canary", 0.25), ("Target-primary path", 1.0)]
    assert [n for n, _ in names[0]] == [n for n, _ in names[5]] == ["Validate", "Shadow", "Hold"]


def test_serving_plan(spark):
    cases = [("SAFE", "PASS", 5, 10, 20, "READY", "PROGRESSIVE", 20, 0.5, ""), ("SAFE", "UNKNOWN", 0, 0, None, "READY", "PROGRESSIVE", 50, 0.0, "ANN_NOT_CONFIRMED"), ("SAFE", "WARNING", 11, 10, 20, "REVIEW", "PROGRESSIVE", 20, 1.1, "ANN_NOT_CONFIRMED,CACHE_EXCEEDS_CORPUS"), (None, "PASS", 0, 10, None, "REVIEW", "PROGRESSIVE_WITH_REVIEW", 50, 0.0, "DECISION_NOT_SAFE")]
    x = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "id int, decision string, ann_status string, cached long, documents long, recommended_k int")
    assert {r.id: (r.status, r.strategy, r.k, r.cache_fraction, r.warnings) for r in planning.serving_plan(x).collect()} == {i: c[5:] for i, c in enumerate(cases)}


def test_registry_tiers(spark):
    cols = "evidence_id int, source string, target string, source_fp string, target_fp string, corpus_fp string, corpus_name string, corpus_size long, canonical boolean"
    reg = [
        (1, "minilm_l6", "qwen3-8b", "a", "b", "c1", "nq", 10, True), (2, "MiniLM-L6-v2", "Qwen/Qwen3-Embedding-8B", "a", "b", None, "nq", 20, True), (3, "minilm-l6", "qwen3_8b", "a", "b", "c3", "nq", 30, False),
        (4, "x", "y", "a", "b", "c1", "nq", 10, True), (5, "x", "y", "a2", "b", "c1", "nq", 10, True),
    ]
    m, q = "sentence-transformers/all-MiniLM-L6-v2", "Qwen/Qwen3-Embedding-8B"
    want = [
        (m, q, "a", "b", "c1", "zz", 0, "EXACT", 1, 1), (m, q, "a", "b", None, "nq", 20, "EXACT", 1, 2), (m, q, "a", "b", "c3", "nq", 10, "EXACT", 2, 1), (m, q, "a", "b", "no", "nq", 30, "PRIOR", 3, 1), (m, q, "a", None, "c1", "nq", 10, "RELATED", 3, 1),
        ("x", "y", "a", "b", "c1", "nq", 10, "RELATED", 2, 4), ("all-MiniLM-L12", "qwen3-embedding-32b", "a", "b", "c1", "nq", 10, "RELATED", 3, 1), ("other", "y", "a", "b", "c1", "nq", 10, "NONE", 0, None),
    ]
    w = spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(want)], cols.replace("evidence_id", "pair_id").replace(", canonical boolean", ""))
    got = planning.registry_match(w, spark.createDataFrame(reg, cols)).collect()
    assert {r.pair_id: (r.tier, r.records, r.first_evidence) for r in got} == {i: c[7:] for i, c in enumerate(want)}


def test_gap_curve_keeps_its_sign(spark):
    cand = spark.createDataFrame([("q", "a", 0, 0.1), ("q", "b", 1, 0.9), ("q", "c", 2, 0.2)], "query_id string, doc_id string, source_rank int, target_score double")
    native = spark.createDataFrame([("q", "b", 0), ("q", "a", 1), ("q", "c", 2)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "query_id string, doc_id string, relevance int")
    got = {r.k: r for r in quality.gap_curve(cand, native, qrels, (1, 2, 3)).collect()}
    ideal = 3 + 1 / math.log2(3)
    full = (1 + 3 / math.log2(3)) / ideal
    assert got[1].candidate_gap == pytest.approx(full - 3 / ideal) and got[1].candidate_gap < 0
    assert got[2].candidate_gap == pytest.approx(0) and got[3].candidate_gap == pytest.approx(full - (1 + 3 / math.log2(4)) / ideal)
    assert [got[k].containment for k in (1, 2, 3)] == pytest.approx([1 / 3, 2 / 3, 1])
    curve = spark.createDataFrame([(100, 0.02), (10, 0.005), (50, 0.03)], "k int, candidate_gap double")
    assert rows(quality.observed_depth(curve)) == [(10,)] and rows(quality.observed_depth(curve, 0.001)) == [(None,)]
    with pytest.raises(PySparkException):
        quality.gap_curve(cand.withColumn("target_score", F.lit(None).cast("double")), native, qrels, (1,)).collect()
    with pytest.raises(PySparkException):
        quality.checked_qrels(qrels.withColumn("relevance", F.lit(-1))).collect()


def test_ndcg_and_recall_differ_in_where_they_cut(spark):
    r = spark.createDataFrame([("q", "x", 0), ("q", "x", 1), ("q", "a", 2)], "query_id string, doc_id string, rank int")
    q = spark.createDataFrame([("q", "a", 1), ("z", "a", 1)], "query_id string, doc_id string, relevance int")
    assert rows(quality.ndcg(r, q, 2)) == [("q", pytest.approx(1 / math.log2(3)))]
    assert rows(quality.recall(r, q, 2)) == [("q", 0.0)] and rows(quality.recall(r, q, 3)) == [("q", 1.0)]


def test_topk_ties_blocks_and_bad_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    c = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(900, [math.nan] * 4), (901, None), (902, [1.0])], "doc_id long, v array<double>").repartition(3)
    q = c.where("doc_id < 7").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 64)  # two queries a pass
    for metric in ("dot", "cosine", "l2"):
        got = {}
        for r in retrieval.topk(c, q, 5, metric).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
        ok = [i for i in range(60) if metric != "cosine" or x[i].any()]
        for i in range(7):
            if metric == "cosine" and not x[i].any():
                assert i not in got
                continue
            s = retrieval.scores(x[ok], x[i : i + 1], metric)[:, 0]
            assert [got[i][k] for k in range(5)] == [ok[j] for j in sorted(range(len(ok)), key=lambda j: (-s[j], ok[j]))[:5]]
    with pytest.raises(ValueError):
        retrieval.topk(c, q, True)
    assert retrieval.topk(c, q.limit(0), 3).count() == 0
    assert retrieval.topk(c, q, 500, "dot").groupBy("query_id").count().first()["count"] == 60


def test_scalars(spark):
    df = spark.createDataFrame([("90s",), ("1.5h",), ("2d",), ("1w",), ("5 m",), ("x",), (None,), ("90",), ("24H",), (" 2 ",)], "s string")
    assert [r[0] for r in df.select(S.seconds(F.col("s"))).collect()] == [90.0, 5400.0, 172800.0, 604800.0, None, None, None, 90.0, 86400.0, 2.0]
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = ["a", "doc-17", "é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.uuid5(ns, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]
    ids = [f"request-{i}" for i in range(500)]
    d = spark.createDataFrame([(i,) for i in ids], "i string")
    want = {i for i in ids if int.from_bytes(hashlib.sha256(f"42:{i}".encode()).digest()[:8], "big") / 2**64 < 0.3}
    assert {r.i for r in d.where(S.sampled(42, F.col("i"), 0.3)).collect()} == want
    assert d.where(S.sampled(42, F.col("i"), 0.0)).count() == 0 and d.where(S.sampled(42, F.col("i"), 1.0)).count() == 500
    red = spark.createDataFrame([("Authorization: Bearer abc.def",), ("postgres://u:pw@h/db",), ("api_key=xyz&b=1",)], "t string").select(S.redact(F.col("t"))).collect()
    assert [r[0] for r in red] == ["Authorization: Bearer abc.def", "postgres://u:<redacted>@h/db", "api_key=<redacted>"]
    env = {"DB_DSN": "pg://me:hunter2@h/x", "api_Key": "abcd", "SHORT_KEY": "abc", "PATH": "/usr/bin"}
    text = "pg://me:hunter2@h/x then hunter2, abcd, abc, /usr/bin" + "x" * 3000
    hidden = spark.createDataFrame([(text,), (None,)], "t string").select(S.redact(F.col("t"), env))
    got = [r[0] for r in hidden.collect()]
    assert got[0].startswith("<redacted> then <redacted>, <redacted>, abc, /usr/binxxx") and len(got[0]) == 2000 and got[1] is None
    assert "hunter2" not in hidden._jdf.queryExecution().toString()
    u = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(S.unit("v"), S.norm("v")).first()
    assert u[0] == pytest.approx([0.6, 0.8]) and u[1] == 5.0


def test_latency_and_cache_stats(spark):
    r = telemetry.latency_summary(spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double"), "x").first()
    assert (r.n, r.p50, r.mean, r["min"], r["max"]) == (2, 1.5, 1.5, 1.0, 2.0) and r.qps == pytest.approx(666.666667)
    one = telemetry.latency_summary(spark.createDataFrame([(0.0,)], "x double"), "x").first()
    assert one["std"] == 0.0 and one.qps == 0.0


def test_prewarm_examples(spark):
    t = spark.createDataFrame([("A", 1000), ("B", 700), ("C", 100), ("D", 10)], "document_id string, occurrences long")
    none = t.limit(0).select("document_id")
    ids = lambda *a: [r.document_id for r in prewarm.hot_set(*a).orderBy("rank").collect()]
    assert ids(t, none, 2) == ["A", "B"]
    s = prewarm.summary(t, none, prewarm.hot_set(t, none, 2), 0.99, 2).first()
    assert s.coverage == pytest.approx(1700 / 1810) and s.target_unmet and s.budget_limited and s.status == "READY"
    warm = spark.createDataFrame([("A",)], "document_id string")
    assert ids(t, warm, 2) == ["B", "C"]
    assert ids(t, warm, 10, 0.5) == [] and ids(t, none, 10, 0.6) == ["A", "B"]
    tie = spark.createDataFrame([(10, 5), (9, 5), (100, 5), (1, 0)], "document_id long, occurrences long")
    assert ids(tie, tie.limit(0).select("document_id"), 3) == [10, 100, 9]
    assert prewarm.summary(t.limit(0), none, t.limit(0)).first().status == "NO_COMPATIBLE_TRAFFIC"
    assert prewarm.caps(1000, gb=0.001, dim=64, width=4) == (1000, "max_docs") and prewarm.caps(1000, gb=0.0001, dim=64) == (419, "storage") and prewarm.caps(10, budget_s=1, docs_per_s=10) == (10, "max_docs")
    curve = {r.documents: r.coverage for r in prewarm.coverage_curve(t, warm).collect()}
    assert curve == {0: pytest.approx(1000 / 1810), 3: pytest.approx(1.0)}


def test_hot_set_invariants(spark):
    rng = random.Random(7)
    for _ in range(6):
        occ = {i: rng.randint(0, 30) for i in range(rng.randint(1, 40))}
        warm = {i for i in occ if rng.random() < 0.3}
        cap, target = rng.randint(0, 20), rng.choice([None, 0.0, 0.5, 0.9, 1.0])
        t = spark.createDataFrame(list(occ.items()), "document_id long, occurrences long")
        w = spark.createDataFrame([(i,) for i in warm], "document_id long")
        got = [r.document_id for r in prewarm.hot_set(t, w, cap, target).orderBy("rank").collect()]
        order = sorted((i for i in occ if occ[i] and i not in warm), key=lambda i: (-occ[i], str(i)))
        total, have, want = sum(occ.values()), sum(occ[i] for i in warm), []
        need = None if target is None else max(0, math.ceil(target * total) - have)
        for i in order[:cap]:
            if need is not None and sum(occ[j] for j in want) >= need:
                break
            want.append(i)
        assert got == want


def test_cache(spark):
    w = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (1, "a")], "document_id long, content_fingerprint string")
    c = spark.createDataFrame([(1, "a", "m"), (2, "old", "m"), (3, None, "m"), (4, "d", "m"), (3, "c", "other")], "document_id long, content_fingerprint string, model_fingerprint string")
    got = sorted((r.document_id, r.state) for r in cache.lookup(w, c, "m").collect())
    assert got == [(1, "hit"), (1, "hit"), (2, "stale"), (3, "hit"), (4, "stale")]
    s = "document_id long, model_fingerprint string, vector array<double>, content_fingerprint string, at long"
    old = spark.createDataFrame([(1, "m", [1.0], "x", 1)], s)
    new = spark.createDataFrame([(1, "m", [2.0], None, 5), (2, "m", [3.0], "y", 4)], s)
    got = {r.document_id: r for r in cache.upsert(old, new).collect()}
    assert (got[1].vector, got[1].content_fingerprint, got[1].created_at, got[1].accessed_at) == ([2.0], "x", 1, 5)


def test_serving_states(spark):
    s = "query_id long, doc_id long, source_rank long, hit boolean, target_score double"
    cold = [(1, i, i, False, 0.1 * i) for i in range(6)]
    part = [(2, i, i, i == 5, 0.1 * i) for i in range(6)]
    warm = [(3, i, i, True, 0.1 * i) for i in range(6)]
    df = spark.createDataFrame(cold + part + warm, s)
    p = cache.progressive(df, 0)
    st = {r.query_id: r.state for r in p.select("query_id", "state").distinct().collect()}
    assert st == {1: "COLD", 2: "PARTIAL", 3: "WARM"}
    order = lambda q: [r.doc_id for r in p.where(f"query_id = {q} AND position IS NOT NULL").orderBy("position").collect()]
    assert order(1) == [0, 1, 2, 3, 4, 5] and order(2) == [5] and order(3) == [5, 4, 3, 2, 1, 0]
    two = cache.progressive(df, 2).where("query_id = 1")
    assert [r.action for r in two.orderBy("source_rank").collect()] == ["encoded"] * 2 + ["queued"] * 4
    none = spark.createDataFrame([(9, None, True)], "query_id long, doc_id long, hit boolean")
    assert cache.serving_state(none).first().state == "WARM"


def python_queue(events, most=3):
    st = {}
    for d, seq, k in sorted(events, key=lambda e: e[1]):
        s = st.get(d)
        if k == "enqueue" and s is None:
            st[d] = ["pending", 0, seq]
        elif s and k == "claim" and s[0] == "pending" and s[1] < most:
            s[0], s[1] = "processing", s[1] + 1
        elif s and k == "done" and s[0] == "processing":
            s[0] = "done"
        elif s and k == "fail" and s[0] == "processing":
            s[0] = "pending" if s[1] < most else "error"
        elif s and k == "restart" and s[0] == "processing":
            s[0] = "pending"
        elif s and k == "requeue" and s[0] in ("done", "error"):
            s[0], s[1] = "pending", 0
    return {d: tuple(s) for d, s in st.items()}


def some_events(seed=1, n=400):
    rng = random.Random(seed)
    kinds = ["enqueue", "claim", "claim", "done", "fail", "fail", "restart", "requeue"]
    return [(rng.randrange(20), i, rng.choice(kinds)) for i in range(n)]


def test_queue_fold(spark):
    e = some_events()
    got = {r.document_id: (r.status, r.attempts, r.enqueued_at) for r in cache.queue_fold(spark.createDataFrame(e, "document_id long, seq long, kind string")).collect()}
    assert got == python_queue(e)


def test_recommendation_order(spark):
    base = {"failed": 0, "timeouts": 0, "sampled": 100, "eligible": 50, "mean_coverage": 1.0}
    cases = [({}, "SAFE", 0, "READY_FOR_CANARY_EVALUATION"), ({}, "SAFE", 1, "INVESTIGATE"), ({"failed": 6}, "EXPAND", 0, "INVESTIGATE"), ({}, "EXPAND", 0, "EXPAND_K"), ({}, "UNSAFE_OR_UNCERTAIN", 0, "INVESTIGATE"), ({"eligible": 19}, "SAFE", 0, "CONTINUE_SHADOW"), ({"mean_coverage": 0.9}, "SAFE", 0, "CONTINUE_SHADOW"), ({"mean_coverage": None}, "SAFE", 0, "READY_FOR_CANARY_EVALUATION"), ({}, "NONE", 0, "CONTINUE_SHADOW")]
    df = spark.createDataFrame([(*{**base, **c}.values(), t, f, w) for c, t, f, w in cases], "failed long, timeouts long, sampled long, eligible long, mean_coverage double, t2 string, failures long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", telemetry.recommendation(F.col("t2"), F.col("failures"))).collect())


def test_probe_curve(spark):
    per = spark.createDataFrame([(10, "a", 0.95), (20, "a", 0.8), (50, "a", 0.92), (100, "a", 1.0)], "k int, query_id string, stability double")
    r = probe.recommended_k(probe.curve(per), 100).first()
    assert (r.recommended_k, r.suffix_stable_k, r.non_monotone, r.next_k) == (10, 50, True, 200)
    low = probe.recommended_k(probe.curve(per.withColumn("stability", F.lit(0.1))), 100).first()
    assert low.recommended_k == 100 and low.suffix_stable_k is None


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "Hello, WORLD!"), (3, None), (4, "")], "doc_id long, text string")
    v = {r.doc_id: np.array(r.v) for r in encoders.encode(docs, encoders.HashModel(16)).collect()}
    assert np.allclose(v[1], v[2]) and np.allclose(v[3], v[4]) and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
    m = encoders.HashModel(8)
    empty = spark.createDataFrame([], "doc_id long, v array<double>, content_fingerprint string, model_fingerprint string")
    first = encoders.encode_missing(docs.where("text IS NOT NULL"), empty, m)
    assert first.count() == 3 and encoders.encode_missing(docs.where("text IS NOT NULL"), first, m).count() == 0


def test_planning(spark):
    left = planning.scenarios(spark.range(101), 8, "float32").orderBy("fraction").collect()
    assert [r.documents for r in left] == [2, 6, 11, 26, 51, 101] and left[0].cost_usd is None and left[0].cost_provenance == "unknown"
    d = spark.createDataFrame([(2, "b"), (1, "a")], "i long, t string")
    h = hashlib.sha256()
    for i, t in ((1, "a"), (2, "b")):
        h.update(f'{{"i":{i},"t":"{t}"}}\n'.encode())
    assert planning.rolling_digest(d, "i", "t").first().digest == h.hexdigest()
    assert planning.dataset_digest(d, "i", "t").first() == planning.dataset_digest(d.repartition(2), "i", "t").first()


def test_a_frozen_rule_is_verified(spark, tmp_path):
    from vecshift.operators import probe

    spec, digest = tmp_path / "rule.md", tmp_path / "rule.sha256"
    spec.write_bytes(b"# rule\n")
    rows = spark.createDataFrame([[0.01] * len(probe.REQUIRED)], ", ".join(f"{c} double" for c in probe.REQUIRED))
    digest.write_text(hashlib.sha256(b"# rule\n").hexdigest().upper() + "  rule.md\n")
    assert probe.guarded_decision(rows, (str(spec), str(digest))).count() == 1
    spec.write_bytes(b"# another rule\n")
    with pytest.raises(ValueError, match="not the stated one"):
        probe.guarded_decision(rows, (str(spec), str(digest)))


def test_judgements_by_label_make_no_pairs(spark):
    """Labels give what their pairs give, without a pair of them being made."""
    q = spark.createDataFrame([(0, 1), (3, 2), (4, None), (5, 3)], "query_id long, label int")
    d = spark.createDataFrame([(i, (None, 1, 1, 2, 7)[i % 5]) for i in range(40)], "doc_id long, label int")
    pairs = q.join(d, "label").select("query_id", "doc_id", F.lit(1).alias("relevance"))
    labels = quality.LabelQrels(q, d)
    ranking = spark.createDataFrame([(i, (i * 7 + j * 3) % 44, j) for i in (0, 3, 4, 5) for j in range(20)], "query_id long, doc_id long, rank int")
    exact = lambda df: [tuple(round(x, 12) for x in r) for r in sorted(map(tuple, df.collect()))]
    for k in (3, 10, 20):
        assert exact(quality.ndcg(ranking, labels, k)) == exact(quality.ndcg(ranking, pairs, k))
        assert exact(quality.recall(ranking, labels, k)) == exact(quality.recall(ranking, pairs, k))
    cand = ranking.withColumnRenamed("rank", "source_rank").withColumn("target_score", F.col("doc_id") % 9 / 9)
    assert exact(quality.gap_curve(cand, ranking, labels, (5, 20))) == exact(quality.gap_curve(cand, ranking, pairs, (5, 20)))
    from vecshift.plans import fixtures

    d, q = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("label")), spark.range(3000).select(F.col("id").alias("query_id"), F.lit(1).alias("label"))
    many = quality.ndcg(spark.range(3000).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0).alias("rank")), quality.LabelQrels(q, d))
    assert many.count() == 3000 and isinstance(fixtures.qrels(spark, "/root/testdata/sf0.001"), quality.LabelQrels)  # 90 million pairs


def test_rolling_digest_by_ranges(spark, monkeypatch):
    """The ordered digest is that of one pass, though no task reads more than its range of the rows."""
    text = lambda i: None if i % 9 == 0 else "é\n" * (i % 13)
    rows = [(i * 31 % 400, text(i * 31 % 400)) for i in range(400)]
    d = spark.createDataFrame(rows, "i long, t string").repartition(5)
    h = hashlib.sha256()
    for i in range(400):
        h.update((json.dumps({"i": i, "t": text(i)}, ensure_ascii=False, separators=(",", ":")) + "\n").encode())
    sizes, whole = [], planning._hash_on

    def spy(part, state):
        sizes.append(part.count())
        return whole(part, state)

    monkeypatch.setattr(planning, "_hash_on", spy)
    monkeypatch.setattr(planning, "PART_BYTES", 4000)
    assert planning.rolling_digest(d, "i", "t").first() == (h.hexdigest(), 400)
    assert len(sizes) > 2 and max(sizes) < 250 and sum(sizes) == 400
    assert planning.rolling_digest(d.limit(0), "i", "t").first() == (hashlib.sha256().hexdigest(), 0)
