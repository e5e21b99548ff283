"""Windowed aggregations over traffic, latency and shadow telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecshift.operators.percentiles import FEW, exact_percentiles

STAGES = ("source_encode_ms", "ann_ms", "target_encode_ms", "lookup_ms", "sync_encode_ms", "score_ms", "topk_ms", "total_ms")
#: Statuses and failure categories that telemetry accepts (fixed values).
STATUSES = ("completed", "partial", "failed", "timeout", "timed_out")
CATEGORIES = (
    "SOURCE_CANDIDATE_ERROR",
    "TARGET_QUERY_ENCODING_ERROR",
    "DOCUMENT_RESOLUTION_ERROR",
    "TARGET_DOCUMENT_ENCODING_ERROR",
    "RERANK_ERROR",
    "CACHE_ERROR",
    "MATERIALIZATION_ERROR",
    "TIMEOUT",
    "INTERNAL",
)
#: Latencies that the shadow report tells of (fixed values).
SHADOW_STAGES = ("source", "shadow", "source_candidate", "target_query_encode", "target_rerank")


def sanitised(df: DataFrame) -> DataFrame:
    """status, failure_category, latency_ms and count columns in their allowed ranges: non-finite latency is null (a negative
    one is kept, and left out of reports), counts are non-negative integers or 0, an unknown status is "failed", an unknown
    category INTERNAL, an empty one null. Case is no matter."""
    ms = F.col("latency_ms").cast("double")
    out = df.withColumn("latency_ms", F.when(ms.isNotNull() & ~F.isnan(ms) & (F.abs(ms) < float("inf")), ms))
    status, category = F.lower("status"), F.upper("failure_category")
    out = out.withColumn("status", F.when(status.isin(*STATUSES), status).otherwise("failed"))
    out = out.withColumn("failure_category", F.when(F.length("failure_category") > 0, F.when(category.isin(*CATEGORIES), category).otherwise("INTERNAL")))
    for c in ("hits", "misses"):
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < 9e15), F.round(x)).otherwise(0).cast("long"))
    return out


_POINTS = (0.5, 0.9, 0.95, 0.99)


def latency_summary(df: DataFrame, value: str, by: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """count, mean, p50/p90/p95/p99 (linear), min, max, std (sample; 0 for one row), qps; exact percentiles. Where a group has more
    than `few` rows, they come from narrowing histograms instead of one task that holds the group; the result is the same."""
    x, rows = F.col(value), df.where(F.col(value).isNotNull())
    most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    p = F.expr(f"percentile(`{value}`, array({', '.join(map(str, _POINTS))}))") if most <= few else F.lit(None)
    out = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), p.alias("p"), F.min(x).alias("min"), F.max(x).alias("max"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"))
    if most > few:
        exact = exact_percentiles(rows, value, _POINTS, by, few=few)
        same = [out[c].eqNullSafe(exact[c]) for c in by]
        out = (out.drop("p").join(exact, same) if by else out.drop("p").join(exact)).select(*[out[c] for c in by], *[out[c] for c in ("n", "mean", "min", "max", "std")], exact.p)
    r = lambda c: F.round(c, 6)
    return out.where("n > 0").select(
        *by, "n", r(F.col("mean")).alias("mean"), *[r(F.col("p")[i]).alias(f"p{q}") for i, q in enumerate((50, 90, 95, 99))], r(F.col("min")).alias("min"), r(F.col("max")).alias("max"),
        r(F.col("std")).alias("std"), r(F.when(F.col("mean") > 0, 1000 / F.col("mean")).otherwise(0.0)).alias("qps"),
    )


def stage_summary(df: DataFrame, by: tuple[str, ...] = ("mode", "k", "nprobe"), stages=STAGES) -> DataFrame:
    """The latency summary of every stage column for each group; one pass over the log."""
    long = df.unpivot(list(by), list(stages), "stage", "ms")
    return latency_summary(long, "ms", (*by, "stage"))


def popularity(events: DataFrame) -> DataFrame:
    """Minute buckets of (fp, document_id): occurrences, queries, misses summed; first and last time seen.
    events (fp, document_id, query_id, at, miss); an id counts once in one query's candidate set."""
    once = events.groupBy("fp", "document_id", "query_id", "at").agg(F.max("miss").alias("miss"))
    bucket = (F.floor(F.col("at") / 60) * 60).cast("long")
    return once.groupBy(bucket.alias("bucket"), "fp", "document_id").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count(F.lit(1)).alias("queries"), F.sum(F.col("miss").cast("long")).alias("misses"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")
    )


def popularity_window(buckets: DataFrame, start: float, end: float, fp: str | None = None) -> DataFrame:
    """Documents by traffic in a window. Whole buckets count; a document must have been seen inside the window."""
    x = buckets.where((F.col("bucket") >= F.floor(F.lit(start) / 60) * 60) & (F.col("bucket") <= F.floor(F.lit(end) / 60) * 60))
    x = x.where(F.col("fp") == fp) if fp is not None else x
    x = x.groupBy("fp", "document_id").agg(F.sum("occurrences").alias("occurrences"), F.sum("queries").alias("queries"), F.sum("misses").alias("misses"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return x.where((F.col("last_seen") >= start) & (F.col("first_seen") <= end))


def in_window(df: DataFrame, start: float, end: float, fp: str | None = None, at: str = "at") -> DataFrame:
    x = df.where(F.col(at).between(start, end))
    return x if fp is None else x.where(F.col("fp") == fp)


def counter_totals(ledger: DataFrame, start: float, end: float) -> DataFrame:
    """fp, name, total from a ledger (at, fp, name, value), exact to the event."""
    return in_window(ledger, start, end).groupBy("fp", "name").agg(F.sum("value").alias("total"))


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, by two shuffled columns only where wide rows allow it (max_by partial aggregation)."""
    rest = [c for c in df.columns if c != key]
    x = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r"))
    return x.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def last_n(df: DataFrame, by: str, at: str, tie: str, n: int) -> DataFrame:
    """The newest n rows of each group (WindowGroupLimit keeps n before the shuffle)."""
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def cache_stats(entries: DataFrame, events: DataFrame, n: int = 100) -> DataFrame:
    """fp, entries, hits, misses, recent_hit_rate (of the last n access events)."""
    e = entries.groupBy("fp").agg(F.count(F.lit(1)).alias("entries"))
    t = events.groupBy("fp").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    r = last_n(events, "fp", "at", "event_id", n).groupBy("fp").agg(F.round(F.avg(F.col("hit").cast("double")), 9).alias("recent_hit_rate"))
    return t.join(r, "fp").join(e, "fp", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def shadow_report(obs: DataFrame, least_coverage: float = 1.0) -> DataFrame:
    """One row: traffic, hit rate, latency over all rows, ranking means over eligible rows (completed, coverage at the
    minimum; null coverage counts as 0), coverage over all rows that have it."""
    sampled = F.col("status") != "dropped"
    fine = F.col("latency_ms").isNotNull() & (F.col("latency_ms") >= 0)
    ok = (F.col("status") == "completed") & (F.coalesce("coverage", F.lit(0.0)) >= least_coverage)
    ms = F.when(fine, F.col("latency_ms"))
    r = lambda c: F.round(c, 6)
    x = obs.withColumn("__ms", ms)
    return x.agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(sampled).alias("sampled"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"), F.count_if(F.col("status") == "dropped").alias("dropped"), F.count_if(ok).alias("eligible"),
        r(F.sum("hits") / F.nullif(F.sum("hits") + F.sum("misses"), F.lit(0))).alias("hit_rate"), r(F.avg("__ms")).alias("mean_ms"), r(F.expr("percentile(__ms, 0.5)")).alias("p50_ms"), r(F.expr("percentile(__ms, 0.95)")).alias("p95_ms"),
        r(F.avg(F.when(ok, F.col("top1_agreement")))).alias("top1_agreement"), r(F.avg(F.when(ok, F.col("overlap")))).alias("overlap"), r(F.avg("coverage")).alias("mean_coverage"), r(F.min("coverage")).alias("min_coverage"),
    )


def shadow_latency(obs: DataFrame, stages: tuple[str, ...] = SHADOW_STAGES) -> DataFrame:
    """stage, count, p50_ms, p95_ms, mean_ms over the finite, non-negative values of the columns <stage>_latency_ms."""
    ms = F.expr(f"stack({len(stages)}, {', '.join(f"'{s}', cast({s}_latency_ms as double)" for s in stages)}) as (stage, ms)")
    fine = F.when((F.col("ms") >= 0) & ~F.isnan("ms") & (F.col("ms") < float("inf")), F.col("ms"))
    q = F.expr("percentile(ms, array(0.5, 0.95))")
    x = obs.select(ms).withColumn("ms", fine).groupBy("stage").agg(F.count("ms").alias("count"), q.alias("q"), F.avg("ms").alias("mean"))
    return x.select("stage", "count", F.round(F.col("q")[0], 6).alias("p50_ms"), F.round(F.col("q")[1], 6).alias("p95_ms"), F.round("mean", 6).alias("mean_ms"))


def recommendation(t2: Column, failures: Column, least_coverage: float = 1.0, enough: int = 20) -> Column:
    """The ordered rules over the columns of `shadow_report`; failures: materialisation failures."""
    error = (failures > 0) | ((F.col("failed") + F.col("timeouts")) > 0.05 * F.col("sampled"))
    warning = (F.col("sampled") < enough) | ((F.col("sampled") > 0) & (F.col("eligible") < enough)) | F.coalesce(F.col("mean_coverage") < least_coverage, F.lit(False))
    return (
        F.when(error | (t2 == "UNSAFE_OR_UNCERTAIN"), "INVESTIGATE")
        .when(t2 == "EXPAND", "EXPAND_K")
        .when((t2 == "SAFE") & (F.col("eligible") >= enough) & ~warning, "READY_FOR_CANARY_EVALUATION")
        .otherwise("CONTINUE_SHADOW")
    )


def trace_totals(trace: DataFrame) -> DataFrame:
    """document_id, count from an access trace in which a missing count is 1."""
    return trace.groupBy("document_id").agg(F.sum(F.coalesce("count", F.lit(1)).cast("long")).alias("count"))


def trace_coverage(totals: DataFrame) -> DataFrame:
    """One row: documents, accesses, share of the top 20 and of the top 1 % of documents (one at least). Documents of equal count weigh
    the same, so the shares come from how many there are of each count: at most sqrt(2 * accesses) rows."""
    steps = totals.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    t = steps.agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("count")).alias("accesses")).first()
    docs, all_ = t["documents"] or 0, t["accesses"] or 0
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("before", before)
    taken = lambda k: F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - F.col("before"))) * F.col("count")
    share = lambda k: F.round(F.coalesce(F.sum(taken(k)), F.lit(0)) / F.lit(max(1, all_)), 9)
    one = max(1, -(-docs // 100))
    return steps.agg(F.lit(docs).cast("long").alias("documents"), F.lit(all_).cast("long").alias("accesses"), share(20).alias("top20_share"), share(one).alias("top1pct_share"))


def dedup_fraction(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.countDistinct("doc_id").alias("unique_docs"), F.count(F.lit(1)).alias("occurrences")).withColumn("fraction", F.round(F.col("unique_docs") / F.greatest(F.lit(1), F.col("occurrences")), 9))


def queue_stats(work: DataFrame) -> DataFrame:
    """One row with a zero-filled count for each status."""
    return work.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "error")])


def popular_ids(log: DataFrame) -> DataFrame:
    """document_id, count from the candidate_ids lists of a latency log."""
    return log.select(F.explode("candidate_ids").alias("document_id")).groupBy("document_id").agg(F.count(F.lit(1)).alias("count"))


def count_audit(cells: DataFrame) -> DataFrame:
    """Research counts by group: cells, small gaps, certified ones, SAFE ones, falsely safe ones."""
    return cells.groupBy("group").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("gap") <= 0.01).alias("small_gap"), F.count_if(F.col("ci_certified")).alias("certified"),
        F.count_if(F.col("decision") == "SAFE").alias("safe"), F.count_if((F.col("decision") == "SAFE") & (F.col("gap") > 0.01)).alias("false_safe"),
    )


def retained(df: DataFrame, now: float, max_age: float, at: str = "at") -> DataFrame:
    """Rows not older than max_age seconds."""
    return df.where(F.col(at) >= now - max_age)
