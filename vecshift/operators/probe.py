"""Finite-pool stability probe: how much of the reranked top ten is already there at a smaller candidate depth.

All depths come from one window pass over the exploded candidate table; the corpus is not touched again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import GRID, prefixes

TOP = 10
#: Features that a decision needs, and name parts that would leak labels into it (fixed values).
REQUIRED = ["probe_residual_tail_50", "stability_50", "deepest_source_rank", "late_tail_area", "last_shell_any", "margin_nonpositive"]
FORBIDDEN = ["qrel", "native", "ndcg", "candidate_gap", "g(", "target_rank", "label", "observed_k"]


def top_lists(candidates: DataFrame, grid=GRID) -> DataFrame:
    """query_id, pool, and for each K the ids of the reranked top ten: t10, t20, ..."""
    x = prefixes(candidates, grid).where(F.col("position") <= TOP)
    lists = x.groupBy("query_id").agg(*[F.collect_list(F.when(F.col("k") == k, F.struct("position", "doc_id", "source_rank", "target_score"))).alias(f"t{k}") for k in grid])
    return lists.select("query_id", *[F.array_sort(f"t{k}").alias(f"t{k}") for k in grid])


def _ids(k: int):
    return F.transform(f"t{k}", lambda r: r["doc_id"])


def _same(a: int, b: int):
    return F.size(F.array_intersect(_ids(a), _ids(b)))


def _entrants(a: int, b: int):
    return F.size(F.array_except(_ids(b), _ids(a)))


def stability(candidates: DataFrame, grid=GRID) -> DataFrame:
    """k, query_id, stability: share of the final top ten (at the deepest K of the grid) that the prefix K has."""
    x, last = top_lists(candidates, grid), max(grid)
    one = F.array(*[F.struct(F.lit(k).alias("k"), (_same(k, last) / F.greatest(F.lit(1), F.size(f"t{last}"))).alias("stability")) for k in grid])
    return x.select("query_id", F.explode(one).alias("s")).select("s.k", "query_id", "s.stability")


def features(candidates: DataFrame) -> DataFrame:
    """One row for each query with the frozen feature set; pools of 500 candidates and more."""
    x = top_lists(candidates, GRID)
    shell = candidates.where("source_rank BETWEEN 50 AND 99").groupBy("query_id").agg(F.max("target_score").alias("shell_best"))
    x = x.join(shell, "query_id", "left")
    tenth = F.element_at("t50", -1)["target_score"]  # the 10th, or the last of a shorter list
    margin = F.when(F.col("shell_best").isNull(), 0.0).otherwise(tenth - F.col("shell_best"))
    s50 = _same(50, 500) / TOP
    e = {(50, 100): _entrants(50, 100), (100, 200): _entrants(100, 200), (200, 500): _entrants(200, 500)}
    return x.select(
        "query_id", (1 - s50).alias("probe_residual_tail_50"), s50.alias("stability_50"),
        F.aggregate("t500", F.lit(0), lambda z, r: F.greatest(z, r["source_rank"].cast("int"))).cast("double").alias("deepest_source_rank"),
        ((e[50, 100] / 10 + e[100, 200] / 10 + e[200, 500] / 10) / 3).alias("late_tail_area"),
        (e[200, 500] > 0).cast("double").alias("last_shell_any"), (margin <= 0).cast("double").alias("margin_nonpositive"),
        e[50, 100].cast("double").alias("entrants_50_100"), e[100, 200].cast("double").alias("entrants_100_200"), e[200, 500].cast("double").alias("entrants_200_500"),
        (e[50, 100] > 0).cast("double").alias("any_50_100"), (e[100, 200] > 0).cast("double").alias("any_100_200"), (e[200, 500] > 0).cast("double").alias("any_200_500"),
        (_same(10, 500) / TOP).alias("stability_10_20"), (_same(20, 500) / TOP).alias("stability_20_50"), (_same(50, 100) / TOP).alias("stability_50_100"),
    )


def short_pool_features(candidates: DataFrame, grid) -> DataFrame:
    """Features where the grid does not reach 500: the final list is that of the deepest K of the grid; the late tail and the
    deepest rank are those of the whole pool up to 500, against the first 50; the margin is taken as 0 (so it
    counts as non-positive nowhere)."""
    last = max(grid)
    x = top_lists(candidates, sorted({*grid, 50, 500}))
    s50 = _same(50, last) / F.greatest(F.lit(1), F.size(f"t{last}"))
    new = _entrants(50, 500)
    deep = F.aggregate("t500", F.lit(0), lambda z, r: F.greatest(z, r["source_rank"].cast("int"))).cast("double")
    return x.select(
        "query_id", (1 - s50).alias("probe_residual_tail_50"), s50.alias("stability_50"), deep.alias("deepest_source_rank"),
        (new / 10).alias("late_tail_area"), (new > 0).cast("double").alias("last_shell_any"), F.lit(0.0).alias("margin_nonpositive"),
    )


def aggregated(per_query: DataFrame) -> DataFrame:
    """Plain means of all features over queries, and as a separate column the 90th percentile of the deepest rank."""
    cols = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(*[F.round(F.avg(c), 9).alias(c) for c in cols], F.round(F.expr("percentile(deepest_source_rank, 0.9)"), 9).alias("deepest_p90_spec"), F.count(F.lit(1)).alias("queries"))


def decision():
    """SAFE, EXPAND or UNSAFE_OR_UNCERTAIN, over the columns of `aggregated`."""
    safe = (F.col("probe_residual_tail_50") <= 0.05) & (F.col("deepest_source_rank") <= 200) & (F.col("late_tail_area") <= 0.20)
    unsafe = (F.col("probe_residual_tail_50") > 0.10) | (F.col("stability_50") < 0.90) | (F.col("last_shell_any") > 0.25) | (F.col("margin_nonpositive") > 0.50)
    return F.when(safe, "SAFE").when(unsafe, "UNSAFE_OR_UNCERTAIN").otherwise("EXPAND")


def verify_frozen(spark: SparkSession, spec: str, digest: str) -> None:
    """An error if the text that a decision's rule is frozen in (a file) doesn't have the SHA-256 that another file states."""
    stated = F.trim(F.regexp_replace("value", r"\s+", " "))
    want = spark.read.text(digest, wholetext=True).select(F.lower(F.element_at(F.split(stated, " "), 1)).alias("d"))
    have = spark.read.format("binaryFile").load(spec).select(F.sha2("content", 256).alias("d"))
    found, expected = have.first(), want.first()
    if found is None or expected is None or found.d != expected.d:
        raise ValueError(f"the frozen rule is not the stated one: {found and found.d} is not {expected and expected.d}")


def guarded_decision(rows: DataFrame, frozen: tuple[str, str] | None = None) -> DataFrame:
    """rows with `decision`; missing, leaking or non-finite features are errors. frozen: the files of the rule's text and of its digest,
    which must agree before anything is decided."""
    if frozen is not None:
        verify_frozen(rows.sparkSession, *frozen)
    missing = [c for c in REQUIRED if c not in rows.columns]
    leaking = [c for c in rows.columns if any(t in c.lower() for t in FORBIDDEN)]
    if missing or leaking:
        raise ValueError(f"features missing: {missing}, forbidden: {leaking}")
    bools = [c for c in REQUIRED if rows.schema[c].dataType.typeName() == "boolean"]
    if bools:
        raise ValueError(f"features must be numbers: {bools}")
    fine = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")) for c in REQUIRED]
    ok = fine[0]
    for f in fine[1:]:
        ok = ok & f
    return rows.withColumn("decision", F.when(ok, decision()).otherwise(F.raise_error(F.lit("non-finite feature"))))


def ledger(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The decisions of a batch: the key columns, the features a decision needs, and the decision; for `write_report(kind="csv")`."""
    return guarded_decision(rows).select(*keys, *REQUIRED, "decision")


def curve(per_k: DataFrame) -> DataFrame:
    """k, mean and min stability, and whether every deeper tested K is stable as well."""
    x = per_k.groupBy("k").agg(F.round(F.avg("stability"), 9).alias("mean_stability"), F.round(F.min("stability"), 9).alias("min_stability"))
    w = Window.orderBy("k")  # a row for each K of the grid
    deeper = F.min("mean_stability").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    falls = F.coalesce(F.col("mean_stability") < F.lag("mean_stability").over(w), F.lit(False))
    return x.withColumn("suffix_stable", deeper >= 0.90).withColumn("falls", falls)


def recommended_k(curve_df: DataFrame, kmax: int, least: float = 0.90) -> DataFrame:
    return curve_df.agg(
        F.coalesce(F.min(F.when(F.col("mean_stability") >= least, F.col("k"))), F.lit(min(200, kmax))).alias("recommended_k"),
        F.min(F.when(F.col("suffix_stable"), F.col("k"))).alias("suffix_stable_k"),
        F.bool_or("falls").alias("non_monotone"),
        F.when(F.greatest(F.lit(10), 2 * F.max("k")) <= 500, F.greatest(F.lit(10), 2 * F.max("k"))).alias("next_k"),
    )


def probe_order(queries: DataFrame, seed: int, limit: int | None = None) -> DataFrame:
    """The first query of each distinct stripped text, in the order of sha256("seed:id"), at most limit of them."""
    w = Window.partitionBy(F.trim("text")).orderBy("position")
    once = queries.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    out = once.withColumn("turn", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")), 256)).orderBy("turn")
    return out.limit(limit) if limit else out
