"""Target-vector cache, work queue and progressive serving as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "processing", "done", "error")


def warm_condition(current: Column, cached: Column) -> Column:
    """A cached row serves a document if it is not bound to a content, or bound to the current one. Without a known
    current content a bound row does not serve."""
    return cached.isNull() | F.coalesce(current == cached, F.lit(False))


def lookup(wanted: DataFrame, cache: DataFrame, fp: str) -> DataFrame:
    """wanted (document_id, content_fingerprint, ...) with state hit, stale or miss. Repeated ids are looked up repeatedly."""
    c = cache.where(F.col("model_fingerprint") == fp).select("document_id", F.col("content_fingerprint").alias("__bound"), F.lit(True).alias("__there"))
    x = wanted.join(c, "document_id", "left")
    state = F.when(F.col("__there").isNull(), "miss").when(warm_condition(F.col("content_fingerprint"), F.col("__bound")), "hit").otherwise("stale")
    return x.withColumn("state", state).drop("__bound", "__there")


def upsert(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """Cache state after writes: the last write of a (document, model) wins; a write without a content keeps the old
    binding; created_at stays that of the first write. Both have document_id, model_fingerprint, vector,
    content_fingerprint, at; one shuffle on the key with partial aggregation."""
    x = cache.unionByName(writes)
    return x.groupBy("document_id", "model_fingerprint").agg(
        F.max_by("vector", "at").alias("vector"),
        F.max_by("content_fingerprint", F.when(F.col("content_fingerprint").isNotNull(), F.col("at"))).alias("content_fingerprint"),
        F.min("at").alias("created_at"), F.max("at").alias("accessed_at"),
    )


def integrity(cache: DataFrame) -> DataFrame:
    """Rows with the faults found: dimension, checksum, finite."""
    vec = F.transform("vector", lambda v: v.cast("double"))
    bad = [
        F.when(F.size("vector") != F.col("dimension"), F.lit("dimension")),
        F.when(F.sha2(F.concat_ws(",", F.transform("vector", lambda v: v.cast("string"))), 256) != F.col("checksum"), F.lit("checksum")),
        F.when(F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit("finite")),
    ]
    return cache.withColumn("faults", F.array_compact(F.array(*bad)))


def checksum(vector: str = "vector") -> Column:
    return F.sha2(F.concat_ws(",", F.transform(vector, lambda v: v.cast("string"))), 256)


def serving_state(candidates: DataFrame) -> DataFrame:
    """query_id, candidates, available, hit_rate, state from candidates (query_id, hit); a query without candidates is WARM."""
    x = candidates.groupBy("query_id").agg(F.count("doc_id").alias("candidates"), F.count_if(F.col("hit") & F.col("doc_id").isNotNull()).alias("available"))
    state = F.when(F.col("available") == F.col("candidates"), "WARM").when(F.col("available") > 0, "PARTIAL").otherwise("COLD")
    return x.withColumn("hit_rate", F.round(F.col("available") / F.greatest(F.lit(1), F.col("candidates")), 9)).withColumn("state", state)


def progressive(candidates: DataFrame, max_sync: int = 4) -> DataFrame:
    """One search round over candidates (query_id, doc_id, source_rank, hit, target_score): the first max_sync misses of a
    query are encoded now, the rest is queued; what is available is reranked. A query with nothing available (COLD)
    keeps the source order without scores. Adds action, position, score, state."""
    by = Window.partitionBy("query_id")
    miss = F.sum((~F.col("hit")).cast("int")).over(by.orderBy("source_rank"))
    x = candidates.withColumn("action", F.when(F.col("hit"), "cached").when(miss <= max_sync, "encoded").otherwise("queued"))
    x = x.withColumn("there", F.col("action") != "queued")
    x = x.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("have", F.sum(F.col("there").cast("int")).over(by))
    state = F.when(F.col("have") == F.col("n"), "WARM").when(F.col("have") > 0, "PARTIAL").otherwise("COLD")
    score = F.when(F.col("there"), F.col("target_score"))
    x = x.withColumn("state", state).withColumn("score", score)
    order = by.orderBy(F.desc_nulls_last("score"), "source_rank")
    pos = F.when(F.col("there") | (F.col("state") == "COLD"), F.row_number().over(order))
    return x.withColumn("position", pos).drop("there", "n", "have")


def with_text(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits with the text of their documents; null where there is none."""
    return hits.join(documents.select("doc_id", "text"), "doc_id", "left")


def shadow_observation(source: DataFrame, target: DataFrame, report_k: int = 10, least: float = 1.0) -> DataFrame:
    """query_id, coverage, top1_agreement, overlap, completed from a source list (query_id, doc_id, rank, hit) and the
    reranked target list (query_id, doc_id, rank); overlap over max(1, min(k, |source|, |target|))."""
    s = source.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("ns"), (F.count_if("hit") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("coverage"),
        F.min_by("doc_id", "rank").alias("s1"), F.collect_set(F.when(F.col("rank") < report_k, F.col("doc_id"))).alias("sk"),
    )
    t = target.groupBy("query_id").agg(F.count(F.lit(1)).alias("nt"), F.min_by("doc_id", "rank").alias("t1"), F.collect_set(F.when(F.col("rank") < report_k, F.col("doc_id"))).alias("tk"))
    x = s.join(t, "query_id", "left")
    over = F.coalesce(F.size(F.array_intersect("sk", "tk")), F.lit(0)) / F.greatest(F.lit(1), F.least(F.lit(report_k), F.col("ns"), F.coalesce("nt", F.lit(0))))
    return x.select("query_id", F.round("coverage", 9).alias("coverage"), F.coalesce((F.col("s1") == F.col("t1")).cast("int"), F.lit(0)).alias("top1_agreement"), F.round(over, 9).alias("overlap"), (F.col("coverage") >= least).alias("completed"))


def queue_fold(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Work-queue state of each document after its events (document_id, seq, kind): enqueue, claim, done, fail, restart,
    requeue. Enqueue is ignored where the id is known; fail goes back to pending while attempts are left, else to error; restart puts
    processing back to pending; requeue acts on done and error only and keeps the place in the queue. A fold over each document's own events."""
    e = events.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("ev"))
    step = f"""aggregate(ev, named_struct('status', cast(null as string), 'attempts', 0, 'enqueued_at', cast(null as long)), (s, x) -> CASE
      WHEN x.kind = 'enqueue' AND s.status IS NULL THEN named_struct('status', 'pending', 'attempts', 0, 'enqueued_at', cast(x.seq as long))
      WHEN x.kind = 'claim' AND s.status = 'pending' AND s.attempts < {max_attempts} THEN named_struct('status', 'processing', 'attempts', s.attempts + 1, 'enqueued_at', s.enqueued_at)
      WHEN x.kind = 'done' AND s.status = 'processing' THEN named_struct('status', 'done', 'attempts', s.attempts, 'enqueued_at', s.enqueued_at)
      WHEN x.kind = 'fail' AND s.status = 'processing' THEN named_struct('status', IF(s.attempts < {max_attempts}, 'pending', 'error'), 'attempts', s.attempts, 'enqueued_at', s.enqueued_at)
      WHEN x.kind = 'restart' AND s.status = 'processing' THEN named_struct('status', 'pending', 'attempts', s.attempts, 'enqueued_at', s.enqueued_at)
      WHEN x.kind = 'requeue' AND s.status IN ('done', 'error') THEN named_struct('status', 'pending', 'attempts', 0, 'enqueued_at', s.enqueued_at)
      ELSE s END)"""
    return e.select("document_id", F.expr(step).alias("s")).where("s.status IS NOT NULL").select("document_id", "s.status", "s.attempts", "s.enqueued_at")


def claim(work: DataFrame, n: int, max_attempts: int = 3) -> DataFrame:
    """The next n pending documents, in order of enqueueing and id."""
    return work.where((F.col("status") == "pending") & (F.col("attempts") < max_attempts)).orderBy("enqueued_at", "document_id").limit(n)


def missing_text(index: DataFrame, documents: DataFrame) -> DataFrame:
    return index.select("doc_id").join(documents.where(F.length(F.trim("text")) > 0).select("doc_id"), "doc_id", "left_anti")
