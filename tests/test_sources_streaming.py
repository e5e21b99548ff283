import json
import random
import time

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_operators import python_queue, some_events
from vecshift.functions.encoders import HashModel
from vecshift.operators.serving import TargetStore
from vecshift.sources import readers as R
from vecshift.streaming import telemetry as T

FAILED = (PySparkException, Py4JJavaError)


def put(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_documents(spark, tmp_path):
    p = put(tmp_path / "d.jsonl", {"id": "1", "text": "a"}, {"id": "2", "text": "b"})
    assert {tuple(r) for r in R.documents(spark, p).collect()} == {("1", "a"), ("2", "b")}
    for i, bad in enumerate([['{"id": "1"'], [{"id": "1", "text": " "}], [{"text": "x"}]]):
        with pytest.raises(FAILED):
            R.documents(spark, put(tmp_path / f"b{i}.jsonl", *bad)).collect()
    with pytest.raises(ValueError):
        R.documents(spark, put(tmp_path / "t.jsonl", {"id": "1", "text": "a"}, {"id": "1", "text": "b"}))
    with pytest.raises(ValueError):
        R.documents(spark, put(tmp_path / "e.jsonl"))
    store = R.documents(spark, p)
    ids = spark.createDataFrame([("2",)], "doc_id string")
    assert [r.text for r in R.fetch(store, ids).collect()] == ["b"]
    with pytest.raises(FAILED):
        R.fetch(store, spark.createDataFrame([("9",)], "doc_id string")).collect()


def test_other_inputs(spark, tmp_path):
    q = R.queries(spark, put(tmp_path / "q", {"query_id": "x", "query": "one"}, {"text": "two"}))
    assert [(r.query_id, r.text) for r in q.orderBy("position").collect()] == [("x", "one"), ("2", "two")]
    g = R.qrels(spark, put(tmp_path / "g", {"q1": {"a": 2, "b": 0}, "q2": {"c": 1}}))
    assert {tuple(r) for r in g.collect()} == {("q1", "a", 2), ("q1", "b", 0), ("q2", "c", 1)}
    with pytest.raises(FAILED):
        R.qrels(spark, put(tmp_path / "g2", {"q1": {"a": 1.5}})).collect()
    k = R.rankings(spark, put(tmp_path / "k", {"id": "q", "ranked_ids": ["a", "b"]}, {"id": "z", "results": [{"id": "c"}, {"id": "d"}]}))
    assert {tuple(r) for r in k.collect()} == {("q", "a", 0), ("q", "b", 1), ("z", "c", 0), ("z", "d", 1)}
    t = R.access_trace(spark, put(tmp_path / "t", {"document_id": "a"}, {"document_id": "a", "count": 4}))
    assert [tuple(r) for r in t.collect()] == [("a", 5)]
    with pytest.raises(FAILED):
        R.access_trace(spark, put(tmp_path / "t2", {"document_id": "a", "count": 0})).collect()
    good, bad = R.latency_log(spark, put(tmp_path / "l", {"mode": "m", "k": 10, "total_ms": 1.5}, "not json", {"mode": "m", "k": 10, "total_ms": 2.5}))
    assert good.count() == 2 and tuple(bad.first()) == (1, 3)


def test_shards_and_reports(spark, tmp_path):
    x = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "doc_id long, v array<double>")
    R.write_shard(x, str(tmp_path / "s"))
    assert R.read_shard(spark, str(tmp_path / "s")).count() == 2
    with pytest.raises(FAILED):
        R.write_shard(x, str(tmp_path / "s"))
    spark.read.parquet(str(tmp_path / "s")).withColumn("checksum", F.lit("x")).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(FAILED):
        R.read_shard(spark, str(tmp_path / "bad")).collect()
    R.write_report(x.select("doc_id"), str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert R.markdown(x.select("doc_id").orderBy("doc_id")).splitlines()[2:] == ["| 1 |", "| 2 |"]


def run(df, name, mode, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(d)
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shape = lambda e: T.timed(e, late="40 days").select("ts", F.lit("c").alias("fp"), F.col("user_id").alias("document_id"), (F.col("event_type") == "error").alias("miss"))
    got = run(T.popularity(shape(stream)), "pop", "complete", spark, tmp_path)
    want = T.popularity(shape(batch))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    once = run(T.enqueue_once(stream.select(F.col("user_id").alias("document_id"))), "once", "append", spark, tmp_path)
    assert once.count() == batch.select("user_id").distinct().count()
    s = run(T.sample(stream.select("event_id"), "event_id", 0.2), "smp", "append", spark, tmp_path)
    assert {r.event_id for r in s.collect()} == {r.event_id for r in T.sample(batch, "event_id", 0.2).collect()}


def test_work_queue_stream(spark, tmp_path):
    e = some_events(3, 300)
    schema = "document_id long, seq long, kind string"
    for i in range(3):
        spark.createDataFrame(e[i * 100 : (i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
        (tmp_path / f"part{i}").mkdir()
    files = spark.read.schema(schema).parquet(str(tmp_path / "q"))
    assert files.count() == 300
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "q"))
        got = run(T.work_queue(stream), "wq", "update", spark, tmp_path)
        assert {r.document_id: (r.status, r.attempts, r.enqueued_at) for r in got.collect()} == python_queue(e)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_materialiser_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "c")], "doc_id long, text string")
    write, store = T.materialiser(spark, HashModel(8), str(tmp_path / "v")), str(tmp_path / "v")
    write(docs, 0)
    write(docs, 0)
    assert write.store.read().count() == 2 and write.store.versions() == [1] and write.store.path == store
    write(spark.createDataFrame([(1, "changed"), (3, None)], "doc_id long, text string"), 1)
    assert {(r.doc_id, r.content_fingerprint is None) for r in write.store.read().collect()} == {(1, False), (2, False)} and write.store.read().count() == 3


def test_requests_are_queued_and_drained_by_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" if i != 4 else None) for i in range(8)], "doc_id long, text string")
    store = TargetStore(spark, str(tmp_path / "store"), HashModel(8), max_attempts=1)
    (tmp_path / "in").mkdir()
    for i, ids in enumerate(([1, 2, 2], [2, 3, 4], [4, 5, 77])):
        spark.createDataFrame([(x,) for x in ids], "document_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(T.queue_drain(store, docs)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.document_id: r.status for r in store.queue().collect()} == {1: "done", 2: "done", 3: "done", 5: "done", 4: "error", 77: "error"}
    assert {r.doc_id for r in store.vectors.read().collect()} == {1, 2, 3, 5}


def traffic(n=400):
    """Candidate sets with repeats, and misses in the same or a later minute; times in seconds."""
    rng = random.Random(5)
    candidates, misses = [], []
    for q in range(n):
        at, fp = rng.randint(0, 3000), rng.choice("ab")
        for d in rng.sample(range(12), 3):
            miss = rng.random() < 0.3
            candidates += [(at, fp, q, d, miss)] * rng.choice([1, 1, 2])
            if rng.random() < 0.4:
                misses += [(at + rng.choice([0, 20, 70, 400]), fp, q, d)] * rng.choice([1, 2])
    return candidates, misses


def test_popularity_of_candidate_sets(spark, tmp_path):
    candidates, misses = traffic()
    want = {}
    for at, fp, q, d, miss in set(candidates):
        x = want.setdefault((at // 60 * 60, fp, d), [0, 0, 10**9, 0])
        want[at // 60 * 60, fp, d] = [x[0] + 1, x[1] + miss, min(x[2], at), max(x[3], at)]
    for at, fp, _, d in set(misses):
        if x := want.get((at // 60 * 60, fp, d)):
            x[1], x[3] = x[1] + 1, max(x[3], at)
    c = spark.createDataFrame(candidates, "at long, fp string, query_id long, document_id long, miss boolean")
    m = spark.createDataFrame(misses, "at long, fp string, query_id long, document_id long")
    shape = lambda x: T.timed(x.withColumn("ts", F.timestamp_seconds("at")).drop("at"), late="2 hours")
    found = lambda x: {(r.bucket, r.fp, r.document_id): [r.occurrences, r.misses, int(r.first_seen.timestamp()), int(r.last_seen.timestamp())] for r in x.collect()}
    zone = spark.conf.get("spark.sql.session.timeZone")
    assert zone == "UTC" and found(T.candidate_popularity(shape(c), shape(m))) == want
    # the same as streams, in any order; a candidate far later closes the minutes
    far = [(10**6, "z", 10**6, 0, False)]
    for name, rows, last in (("c", c, far), ("m", m, [x[:4] for x in far])):
        rows.repartition(4).write.parquet(str(tmp_path / name))
        time.sleep(1.1)  # files are taken by their time
        spark.createDataFrame(last, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, like: shape(spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    got = run(T.candidate_popularity(read("c", c), read("m", m)), "sets", "append", spark, tmp_path)
    assert found(got.where("fp <> 'z'")) == want
