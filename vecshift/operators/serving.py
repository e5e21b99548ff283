"""Search by the old space's candidates and the new space's vectors, which are encoded as searches ask for them.

A round takes a set of queries at once. They look the store up together; each may have some of its misses encoded within the round,
its budget, in the order of its candidates. Every document is encoded once however many queries ask for it, and the vectors go to the
store in the same run, so the next round finds them. What no budget covers is put on the work queue, from which `drain` takes it
in the background. Store and queue are versioned tables: a round that is lost leaves them as they were, and running it again
does what is left to do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecshift.functions.encoders import EmbeddingModel, attempts
from vecshift.functions.scalar import dot
from vecshift.operators import cache, retrieval
from vecshift.sources.snapshots import Snapshots, written

VECTORS = "doc_id long, v array<double>, content_fingerprint string, model_fingerprint string"
EVENTS = "document_id long, seq long, kind string, error string"


@dataclass
class Round:
    """hits: a row for each candidate, with action (cached, encoded, shared, queued), target_score, position, score, state."""

    hits: DataFrame
    encoded: int
    failed: int
    queued: int

    def summary(self) -> DataFrame:
        """query_id, candidates, cached, encoded, shared, queued, state."""
        count = lambda a: F.count_if(F.col("action") == a).alias(a)
        return self.hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), *map(count, ("cached", "encoded", "shared", "queued")), F.first("state").alias("state"))


class TargetStore:
    """Vectors of the target model by document and content, and the queue of documents that are to be encoded."""

    def __init__(self, spark: SparkSession, path: str, model: EmbeddingModel, max_attempts: int = 3):
        self.spark, self.model, self.most = spark, model, max_attempts
        self.vectors = Snapshots(spark, f"{path}/vectors", VECTORS)
        self.events = Snapshots(spark, f"{path}/queue", EVENTS)

    def current(self, documents: DataFrame, version: int | None = None) -> DataFrame:
        """doc_id, v: this model's vectors for what the documents hold now."""
        now = documents.select("doc_id", F.sha2("text", 256).alias("content_fingerprint")).distinct()
        held = self.vectors.read(version).where(F.col("model_fingerprint") == self.model.fingerprint())
        return held.join(now, ["doc_id", "content_fingerprint"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "v")

    def queue(self) -> DataFrame:
        """document_id, status, attempts, enqueued_at of all documents that were ever queued."""
        return cache.queue_fold(self.events.read(), self.most)

    def _seq(self) -> int:
        """Numbers for the next change of the queue: a version has 4."""
        return 4 * (self.events.manifest()["version"] + 1)

    def encode(self, documents: DataFrame) -> tuple[DataFrame, int]:
        """Encodes what the store lacks of these documents and adds it. Attempts with an error, and how many were encoded."""
        tried = written(attempts(documents, self.vectors.read(), self.model), "attempts")
        good = tried.where("error IS NULL")
        n = good.count()
        if n:
            self.vectors.append(good)
        return tried.where("error IS NOT NULL").select(F.col("doc_id").alias("document_id"), "error"), n

    def enqueue(self, ids: DataFrame) -> int:
        """New documents wait; those that were done wait again, as their text has changed since; all others stay what they are. How many
        wait now that didn't."""
        ids = ids.select("document_id").distinct()
        held = self.queue().select("document_id", "status")
        seq = self._seq()
        new = ids.join(held, "document_id", "left").where("status IS NULL OR status = 'done'")
        kind = F.when(F.col("status").isNull(), "enqueue").otherwise("requeue")
        new = written(new.select("document_id", F.lit(seq).cast("long").alias("seq"), kind.alias("kind"), F.lit(None).cast("string").alias("error")), "enqueued")
        n = new.count()
        if n:
            self.events.append(new)
        return n

    def drain(self, documents: DataFrame, limit: int | None = None) -> tuple[int, int]:
        """Takes the next documents of the queue (all that wait, without a limit), encodes them, and says how many were encoded or found, and how many failed. A document
        without text, or one that the model fails on, waits again until its attempts are used up. Vectors are stored before
        the queue says so; so a drain that is lost in between repeats nothing but the entry."""
        seq = self._seq()
        waiting = self.queue().where((F.col("status") == "pending") & (F.col("attempts") < self.most))
        claimed = written((waiting if limit is None else cache.claim(waiting, limit, self.most)).select("document_id"), "claimed")
        docs = claimed.join(documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id", "left")
        failed, _ = self.encode(docs.select(F.col("document_id").alias("doc_id"), "text"))
        ends = claimed.join(failed.groupBy("document_id").agg(F.first("error").alias("error")), "document_id", "left")
        ends = ends.select("document_id", F.lit(seq + 1).cast("long").alias("seq"), F.when(F.col("error").isNull(), "done").otherwise("fail").alias("kind"), "error")
        starts = claimed.select("document_id", F.lit(seq).cast("long").alias("seq"), F.lit("claim").alias("kind"), F.lit(None).cast("string").alias("error"))
        rows = written(starts.unionByName(ends), "drained")
        c = rows.agg(F.count_if(F.col("kind") == "done").alias("done"), F.count_if(F.col("kind") == "fail").alias("fail")).first()
        if c.done + c.fail:
            self.events.append(rows)
        return c.done, c.fail

    def search(self, candidates: DataFrame, target_queries: DataFrame, documents: DataFrame, budget: int = 4) -> Round:
        """One round. candidates (query_id, doc_id, source_rank) with distinct documents for a query; target_queries (query_id, v).

        A miss within a query's budget is `encoded`, one that another query's budget pays for is `shared`, the others are
        `queued`. Documents that can't be encoded are queued too. A query without any vector keeps the source order, without scores."""
        if isinstance(budget, bool) or not isinstance(budget, int) or budget < 0:
            raise ValueError("the budget must be a number of documents")
        have = self.current(documents)
        x = candidates.select("query_id", "doc_id", "source_rank").join(have.select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
        x = x.withColumn("hit", F.coalesce("hit", F.lit(False)))
        turn = F.sum((~F.col("hit")).cast("int")).over(Window.partitionBy("query_id").orderBy("source_rank"))
        looked = written(x.withColumn("turn", F.when(~F.col("hit"), turn)), "looked")
        asked = looked.where(F.col("turn") <= budget).select("doc_id").distinct()
        failed, n = self.encode(documents.join(asked, "doc_id", "left_semi")) if budget else (None, 0)
        vectors = self.current(documents).select("doc_id", F.col("v").alias("__d"))
        x = looked.join(target_queries.select("query_id", F.col("v").alias("__q")), "query_id", "left").join(vectors, "doc_id", "left")
        x = x.withColumn("target_score", F.round(dot("__q", "__d"), retrieval.DIGITS)).drop("__q", "__d")
        there = F.col("target_score").isNotNull()
        action = F.when(F.col("hit"), "cached").when(there & (F.col("turn") <= budget), "encoded").when(there, "shared").otherwise("queued")
        hits = written(rank_available(x.withColumn("action", action).drop("turn", "hit")), "hits")
        queued = self.enqueue(hits.where("action = 'queued'").select(F.col("doc_id").alias("document_id")))
        return Round(hits, n, failed.count() if failed is not None else 0, queued)


def rank_available(x: DataFrame) -> DataFrame:
    """x (query_id, source_rank, action, target_score, ...) with state (WARM: all candidates have a vector, PARTIAL, COLD: none),
    score and position: by score, ties in the source order, without the queued; for COLD the source order. A zero vector scores 0, a
    score that is not finite is an error."""
    by = Window.partitionBy("query_id")
    there = F.col("action") != "queued"
    have, n = F.count_if(there).over(by), F.count(F.lit(1)).over(by)
    state = F.when(have == n, "WARM").when(have > 0, "PARTIAL").otherwise("COLD")
    s = F.col("target_score")
    bad = F.isnan(s) | (F.abs(s) == float("inf"))
    score = F.when(there & bad, F.raise_error(F.lit("a target score is not finite")).cast("double")).when(there, s)
    x = x.withColumn("state", state).withColumn("score", score)
    order = F.row_number().over(by.orderBy(F.desc_nulls_last("score"), "source_rank"))
    return x.withColumn("position", F.when(there | (F.col("state") == "COLD"), order))
