"""Selection of the documents to encode first, under caps and a coverage target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a plan file is, and the most ids one may hold (fixed values).
SCHEMA_VERSION, STRATEGY, MAX_PLAN_IDS = 1, "traffic_hotset", 1_000_000
#: Identities that a plan is made for, and that must be those of where it is run.
BINDINGS = ("target_fingerprint", "source_fingerprint", "backend", "telemetry_fingerprint", "index_identity_fingerprint")
CHOSEN = "document_id long, occurrences long, rank int, before long"
PLANS = f"plan_id long, schema_version int, strategy string, max_docs long, documents long, config string, candidate_k long, {', '.join(f'{b} string' for b in BINDINGS)}, fingerprint string"

CHECKPOINTS = (0, 1_000, 5_000, 10_000, 25_000, 50_000, 100_000)
MAX_DOCS = 1000


def caps(max_docs: int = MAX_DOCS, gb: float | None = None, dim: int = 0, width: int = 4, budget_s: float | None = None, docs_per_s: float | None = None) -> tuple[int, str]:
    """The binding cap and its name; a later limit takes over only where it is strictly smaller."""
    cap, name = max_docs, "max_docs"
    if gb is not None and dim:
        by_bytes = int(gb * 2**30) // (dim * width)
        if by_bytes < cap:
            cap, name = by_bytes, "storage"
    if budget_s is not None and docs_per_s:
        by_time = math.floor(budget_s * docs_per_s)
        if by_time < cap:
            cap, name = by_time, "time"
    return cap, name


def caps_table(plans: DataFrame) -> DataFrame:
    """The same rule over a table (max_docs, gb, dim, width, budget_s, docs_per_s): cap, limiter."""
    b = F.floor(F.col("gb") * (1 << 30) / (F.col("dim") * F.col("width"))).cast("long")
    t = F.floor(F.col("budget_s") * F.col("docs_per_s")).cast("long")
    x = plans.withColumn("c1", F.when(b.isNotNull() & (b < F.col("max_docs")), b).otherwise(F.col("max_docs")))
    x = x.withColumn("cap", F.when(t.isNotNull() & (t < F.col("c1")), t).otherwise(F.col("c1")))
    name = F.when(F.col("cap") < F.col("c1"), "time").when(F.col("c1") < F.col("max_docs"), "storage").otherwise("max_docs")
    return x.withColumn("limiter", name).drop("c1")


def split(traffic: DataFrame, warm: DataFrame) -> DataFrame:
    """traffic (document_id, occurrences) without empty rows, with `warm`."""
    w = warm.select("document_id", F.lit(True).alias("warm")).distinct()
    return traffic.where("occurrences > 0").join(w, "document_id", "left").withColumn("warm", F.coalesce("warm", F.lit(False)))


def hot_set(traffic: DataFrame, warm: DataFrame, cap: int, target: float | None = None) -> DataFrame:
    """The cold documents to encode: document_id, occurrences, rank (1-based), before (traffic covered before this one).

    Taken by traffic, then by id as text, while the rank is within the cap and the traffic covered so far is short of
    ceil(target * total) - warm. The cap bounds what is ranked: a top-n of at most `cap` rows meets in one task."""
    x = split(traffic, warm)
    t = x.agg(F.sum("occurrences").alias("all"), F.sum(F.when(F.col("warm"), F.col("occurrences")).otherwise(0)).alias("warm")).first()
    desired = None if target is None else max(0, math.ceil(target * (t["all"] or 0)) - (t["warm"] or 0))
    order = (F.desc("occurrences"), F.col("document_id").cast("string").asc())
    top = x.where("NOT warm").orderBy(*order).limit(max(0, cap))
    w = Window.orderBy(*order)
    top = top.withColumn("rank", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("occurrences").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = top.drop("warm")
    return top if desired is None else top.where(F.col("before") < desired)


def summary(traffic: DataFrame, warm: DataFrame, chosen: DataFrame, target: float | None = None, cap: int = MAX_DOCS) -> DataFrame:
    """One row: coverage before and after, and the plan's status and warnings."""
    x = split(traffic, warm)
    t = x.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("warm"), F.col("occurrences"))), F.lit(0)).alias("warm_traffic"), F.count_if(~F.col("warm")).alias("cold_documents")
    )
    s = chosen.agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("selected_traffic"))
    y = t.join(s)
    base, after = F.col("warm_traffic") / F.greatest(F.lit(1), F.col("total")), (F.col("warm_traffic") + F.col("selected_traffic")) / F.greatest(F.lit(1), F.col("total"))
    goal = F.lit(target).cast("double")
    return y.select(
        "total", "warm_traffic", "cold_documents", "selected", "selected_traffic", F.round(base, 9).alias("baseline_coverage"), F.round(after, 9).alias("coverage"),
        F.when(F.col("total") == 0, "NO_COMPATIBLE_TRAFFIC").when(F.col("selected") == 0, "NOOP").otherwise("READY").alias("status"),
        F.coalesce(after + 1e-12 < goal, F.lit(False)).alias("target_unmet"), (F.coalesce(after < goal, F.lit(False)) & (F.col("selected") >= cap)).alias("budget_limited"),
    )


def coverage_curve(traffic: DataFrame, warm: DataFrame) -> DataFrame:
    """documents, coverage if so many of the hottest cold documents are encoded; checkpoints up to their number."""
    x = split(traffic, warm)
    t = x.agg(F.sum("occurrences").alias("all"), F.sum(F.when(F.col("warm"), F.col("occurrences")).otherwise(0)).alias("warm"), F.count_if(~F.col("warm")).alias("cold")).first()
    n, total, base = t["cold"] or 0, t["all"] or 0, t["warm"] or 0
    points = sorted({c for c in CHECKPOINTS if c <= n} | {n})
    # documents of equal traffic cover alike, so the curve needs how many there are of each traffic only: at most
    # sqrt(2 * total) rows, whatever the number of documents
    steps = x.where("NOT warm").groupBy("occurrences").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc("occurrences")).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in ((F.col("n"), "n0"), (F.col("n") * F.col("occurrences"), "s0"))]
    steps = steps.select("occurrences", "n", *sums)
    grid = F.broadcast(x.sparkSession.createDataFrame([(int(p),) for p in points], "documents long"))
    held = steps.join(grid, (F.col("documents") > F.col("n0")) & (F.col("documents") <= F.col("n0") + F.col("n")))
    held = held.select("documents", (F.col("s0") + (F.col("documents") - F.col("n0")) * F.col("occurrences")).alias("covered"))
    return grid.join(held, "documents", "left").select("documents", F.round((F.lit(base) + F.coalesce("covered", F.lit(0))) / F.lit(max(1, total)), 9).alias("coverage"))


def ids_digest(config: Column, cap: Column) -> Column:
    """An aggregate over a plan's (rank, document_id): its fingerprint."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("document_id").cast("string").alias("d")))), lambda r: r["d"])
    return F.sha2(F.concat_ws("|", config, cap.cast("string"), F.concat_ws(",", ids)), 256)


def plan_fingerprint(chosen: DataFrame, fp: str, cap: int) -> DataFrame:
    """SHA-256 of the plan: configuration, cap, and the ids in rank order (bounded by the cap)."""
    return chosen.agg(ids_digest(F.lit(fp), F.lit(cap)).alias("fingerprint"))


def plan_violations(plans: DataFrame, selections: DataFrame, current: dict) -> DataFrame:
    """plan_id, violation: what keeps each plan (PLANS) with its selected ids (plan_id, rank, document_id) from being run where the
    identities are `current` (BINDINGS and candidate_k). A plan without selected ids is checked too. Ids of one plan are collected
    for its fingerprint only if there are no more than MAX_PLAN_IDS."""
    ids = selections.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("distinct"), F.count_if(F.coalesce(F.trim(F.col("document_id").cast("string")), F.lit("")) == "").alias("blank"))
    small = selections.join(ids.where(F.col("n") <= MAX_PLAN_IDS).select("plan_id"), "plan_id", "left_semi")
    digest = small.join(plans.select("plan_id", "config", "max_docs"), "plan_id").groupBy("plan_id", "config", "max_docs").agg(ids_digest(F.col("config"), F.col("max_docs")).alias("recomputed"))
    x = plans.join(ids, "plan_id", "left").join(digest.select("plan_id", "recomputed"), "plan_id", "left").fillna(0, ["n", "distinct", "blank"])
    none = F.sha2(F.concat_ws("|", "config", F.col("max_docs").cast("string"), F.lit("")), 256)
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    checks = [
        F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), F.lit("schema_version")),
        F.when(~F.col("strategy").eqNullSafe(F.lit(STRATEGY)), F.lit("strategy")),
        F.when(F.col("blank") > 0, F.lit("blank_id")),
        F.when(F.col("n") > MAX_PLAN_IDS, F.lit("too_many_ids")),
        F.when(F.col("n") - F.col("blank") > F.col("distinct"), F.lit("repeated_ids")),
        F.when(F.col("documents") != F.col("n"), F.lit("documents")),
        F.when(F.col("max_docs").isNull() | (F.col("max_docs") < 0), F.lit("max_docs")),
        F.when(F.col("n") > F.col("max_docs"), F.lit("over_budget")),
        F.when(F.col("candidate_k") < 1, F.lit("candidate_k")).when(F.col("candidate_k") != F.lit(current.get("candidate_k")).cast("long"), F.lit("candidate_k differs")),
        F.when((F.col("n") <= MAX_PLAN_IDS) & (F.col("fingerprint") != F.coalesce("recomputed", none)), F.lit("fingerprint")),
    ]
    for b in BINDINGS:
        here = F.lit(current.get(b)).cast("string")
        checks.append(F.when(~given(F.col(b)), F.lit(f"{b} missing")).when(~given(here), F.lit(f"{b} unknown here")).when(F.col(b) != here, F.lit(f"{b} differs")))
    return x.select("plan_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def by_strategy(corpus: DataFrame, strategy: str, n: int = 0, fraction: float = 0.0, seed: int = 42, ids: DataFrame | None = None, popular: DataFrame | None = None) -> DataFrame:
    """document_id by one of: explicit, popular, first, random."""
    from vecshift.functions.scalar import sampled

    if strategy == "explicit":
        return ids.select("document_id").join(corpus.select("document_id"), "document_id", "left_semi").distinct()
    if strategy == "popular":
        return popular.orderBy(F.desc("count"), F.col("document_id").cast("string")).limit(n).select("document_id")
    if strategy == "first":
        return corpus.orderBy("document_id").limit(n).select("document_id")
    if strategy == "random":
        return corpus.where(sampled(seed, F.col("document_id"), fraction)).select("document_id")
    raise ValueError(strategy)
