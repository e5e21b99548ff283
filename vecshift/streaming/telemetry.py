"""Structured Streaming versions of the telemetry and work-queue operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vecshift.functions.scalar import sampled


def timed(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with a zoned event time and a watermark (a zone-less time is read as UTC)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sample(events: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    return events.where(sampled(seed, F.col(key), rate))


def popularity(events: DataFrame, ts: str = "ts") -> DataFrame:
    """60-second tumbling popularity of (fp, document_id); events (ts, fp, document_id, miss)."""
    x = events.groupBy(F.window(ts, "60 seconds").alias("w"), "fp", "document_id")
    x = x.agg(F.count(F.lit(1)).alias("occurrences"), F.sum(F.col("miss").cast("long")).alias("misses"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return x.select(F.unix_timestamp("w.start").alias("bucket"), "fp", "document_id", "occurrences", "misses", "first_seen", "last_seen")


def candidate_popularity(candidates: DataFrame, misses: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Minute buckets of (fp, document_id) from candidate sets, for streams and tables alike: occurrences, misses, first_seen, last_seen.

    candidates (ts, fp, query_id, document_id, miss): a document counts once in one query's set, however often it is named there; its
    miss is the same in all of them. misses (ts, fp, query_id, document_id): lookups that missed later. They count in the minute in
    which they arrive, and only where that minute has seen the document as a candidate; in any other minute they match nothing.
    Streams need a watermark (`timed`); repeats are known for as long as that lets events be late, and later ones may be
    dropped, as Spark does. The result of a stream can be appended: a bucket comes out once its minute is past the watermark."""
    key = ["fp", "query_id", "document_id"]
    once = lambda x: x.dropDuplicatesWithinWatermark(key) if x.isStreaming else x.dropDuplicates(key)
    x = once(candidates).select(ts, "fp", "document_id", F.lit(1).alias("seen"), F.col("miss").cast("int").alias("missed"))
    if misses is not None:
        x = x.unionByName(once(misses).select(ts, "fp", "document_id", F.lit(0).alias("seen"), F.lit(1).alias("missed")))
    x = x.groupBy(F.window(ts, "60 seconds").alias("w"), "fp", "document_id")
    x = x.agg(F.sum("seen").alias("occurrences"), F.sum("missed").alias("misses"), F.min(F.when(F.col("seen") == 1, F.col(ts))).alias("first_seen"), F.max(ts).alias("last_seen"))
    return x.where("occurrences > 0").select(F.unix_timestamp("w.start").alias("bucket"), "fp", "document_id", "occurrences", "misses", "first_seen", "last_seen")


def enqueue_once(requests: DataFrame) -> DataFrame:
    """The first request of each document; later ones are ignored in whatever state it is."""
    return requests.dropDuplicates(["document_id"])


class WorkQueue(StatefulProcessor):
    """State machine of one document: pending, processing, done, error. Input rows (document_id, seq, kind)."""

    def __init__(self, max_attempts: int = 3):
        self.most = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("work", "status string, attempts int, enqueued_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, at = self.state.get() if self.state.exists() else (None, 0, None)
        for seq, kind in sorted((int(s), k) for b in rows for s, k in zip(b["seq"], b["kind"], strict=True)):
            if kind == "enqueue" and status is None:
                status, attempts, at = "pending", 0, seq
            elif kind == "claim" and status == "pending" and attempts < self.most:
                status, attempts = "processing", attempts + 1
            elif kind == "done" and status == "processing":
                status = "done"
            elif kind == "fail" and status == "processing":
                status = "pending" if attempts < self.most else "error"
            elif kind == "restart" and status == "processing":
                status = "pending"
            elif kind == "requeue" and status in ("done", "error"):
                status, attempts = "pending", 0
        if status is not None:
            self.state.update((status, attempts, at))
            yield pd.DataFrame({"document_id": [key[0]], "status": [status], "attempts": [attempts], "enqueued_at": [at]})

    def close(self) -> None:
        pass


def work_queue(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Changes of the queue's state, keyed by document; needs the RocksDB state store."""
    return events.groupBy("document_id").transformWithStateInPandas(WorkQueue(max_attempts), "document_id long, status string, attempts int, enqueued_at long", "Update", "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def materialiser(spark, model, store_path: str):
    """A foreachBatch sink that encodes what the store lacks and adds it as one version; a replayed batch finds nothing to do, and a
    batch that is lost half-way leaves the store as it was. Documents that can't be encoded are left out."""
    from vecshift.functions.encoders import attempts
    from vecshift.operators.serving import VECTORS
    from vecshift.sources.snapshots import Snapshots, written

    store = Snapshots(spark, store_path, VECTORS)

    def write(batch: DataFrame, epoch: int) -> None:
        good = written(attempts(batch, store.read(), model).where("error IS NULL"), "batch")
        if not good.isEmpty():
            store.append(good, {"epoch": epoch})

    write.store = store
    return write


def queue_drain(store, documents: DataFrame):
    """A foreachBatch sink over requests (document_id): they are put on the store's work queue, and what waits there is encoded. The
    queue ignores what it knows, so a replayed batch adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        store.enqueue(batch.select("document_id"))
        store.drain(documents)

    return write
