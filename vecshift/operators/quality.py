"""Retrieval quality, candidate-gap curves and migration depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = (10, 20, 50, 100, 200, 500)


def checked_qrels(qrels: DataFrame) -> DataFrame:
    """Relevance must be a finite whole number of at least 0; anything else is an error."""
    r = F.col("relevance").cast("double")
    ok = r.isNotNull() & ~F.isnan(r) & (r >= 0) & (r == F.floor(r))
    return qrels.withColumn("relevance", F.when(ok, F.col("relevance").cast("int")).otherwise(F.raise_error(F.lit("invalid relevance"))))


def _gain(rel: Column, pos: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(pos + 1)


class PairQrels:
    """Judgements as rows (query_id, doc_id, relevance)."""

    def __init__(self, pairs: DataFrame):
        self.pairs = pairs

    def queries(self) -> DataFrame:
        return self.pairs.select("query_id").distinct()

    def within(self, queries: DataFrame) -> PairQrels:
        """Those of these queries (query_id)."""
        return PairQrels(self.pairs.join(queries, "query_id", "left_semi"))

    def judge(self, ranked: DataFrame) -> DataFrame:
        """ranked (query_id, doc_id, ...) with relevance, null where a pair isn't judged."""
        return ranked.join(self.pairs.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left")

    def ideal(self, k: int) -> DataFrame:
        """query_id, ideal: the greatest gain of k documents."""
        w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
        best = self.pairs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
        return best.groupBy("query_id").agg(F.sum(_gain(F.col("relevance"), F.col("pos"))).alias("ideal"))

    def relevant(self) -> DataFrame:
        """query_id, all: how many documents are relevant, for queries that have some."""
        return self.pairs.where("relevance > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))


class LabelQrels(PairQrels):
    """The judgements that a document with a query's label has relevance 1, from queries (query_id, label) and documents (doc_id, label).
    The pairs, whose number grows with the square of a label's rows, are not made: only ranked ones are judged, the others counted."""

    def __init__(self, queries: DataFrame, documents: DataFrame):
        self.q, self.d = queries.select("query_id", "label").where("label IS NOT NULL"), documents.select("doc_id", "label").where("label IS NOT NULL")

    def _labels(self) -> DataFrame:
        return self.d.groupBy("label").agg(F.count(F.lit(1)).alias("all"))

    def queries(self) -> DataFrame:
        return self.q.join(self._labels(), "label").select("query_id").distinct()

    def within(self, queries: DataFrame) -> LabelQrels:
        return LabelQrels(self.q.join(queries, "query_id", "left_semi"), self.d)

    def judge(self, ranked: DataFrame) -> DataFrame:
        x = ranked.join(self.q.withColumnRenamed("label", "__label"), "query_id", "left")
        d = self.d.select("doc_id", F.col("label").alias("__label"), F.lit(1).alias("relevance"))
        return x.join(d, ["doc_id", "__label"], "left").drop("__label")

    def ideal(self, k: int) -> DataFrame:
        gain = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("all")).cast("int")), F.lit(0.0), lambda z, pos: z + _gain(F.lit(1), pos))
        return self.q.join(self._labels().select("label", gain.alias("ideal")), "label").select("query_id", "ideal")

    def relevant(self) -> DataFrame:
        return self.q.join(self._labels(), "label").select("query_id", "all")


def _judgements(qrels: DataFrame | PairQrels) -> PairQrels:
    return qrels if isinstance(qrels, PairQrels) else PairQrels(qrels)


def ndcg(ranking: DataFrame, qrels: DataFrame | PairQrels, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, ndcg. ranking (query_id, doc_id, rank); repeats count at their first place and are taken out before
    the cut at k. Queries without relevant documents score 0. by: further keys of ranking (such as K). qrels: rows, or LabelQrels."""
    keys, qrels = [*by, "query_id"], _judgements(qrels)
    once = ranking.groupBy(*keys, "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy(*keys).orderBy("rank")
    top = once.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    got = qrels.judge(top).groupBy(*keys).agg(F.sum(_gain(F.coalesce("relevance", F.lit(0)), F.col("pos"))).alias("dcg"))
    score = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return got.join(qrels.ideal(k), "query_id", "left").select(*keys, score.alias("ndcg"))


def recall(ranking: DataFrame, qrels: DataFrame | PairQrels, k: int) -> DataFrame:
    """query_id, recall: the cut at k comes before repeats are taken out."""
    qrels = _judgements(qrels)
    w = Window.partitionBy("query_id").orderBy("rank")
    top = ranking.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("query_id", "doc_id").distinct()
    hits = qrels.judge(top).groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("hits"))
    return hits.join(qrels.relevant(), "query_id", "left").select("query_id", F.coalesce(F.col("hits") / F.col("all"), F.lit(0.0)).alias("recall"))


def prefixes(candidates: DataFrame, grid=GRID) -> DataFrame:
    """One copy of each candidate for every K of the grid that reaches it, with its position after reranking by target
    score (ties keep the source order)."""
    ks = F.array(*[F.lit(int(k)) for k in sorted(set(grid))])
    x = candidates.withColumn("k", F.explode(ks)).where(F.col("source_rank") < F.col("k"))
    w = Window.partitionBy("k", "query_id").orderBy(F.desc("target_score"), "source_rank")
    return x.withColumn("position", F.row_number().over(w))


def containment(candidates: DataFrame, native: DataFrame, grid=GRID, quality_k: int = 10) -> DataFrame:
    """k, query_id, containment: share of the native top quality_k among the first K source candidates."""
    top = native.where(F.col("rank") < quality_k).select("query_id", "doc_id")
    found = top.join(candidates.select("query_id", "doc_id", "source_rank"), ["query_id", "doc_id"], "left")
    ks = F.array(*[F.lit(int(k)) for k in sorted(set(grid))])
    x = found.withColumn("k", F.explode(ks))
    hit = F.coalesce((F.col("source_rank") < F.col("k")).cast("int"), F.lit(0))
    return x.groupBy("k", "query_id").agg((F.sum(hit) / F.count(F.lit(1))).alias("containment"))


def gap_curve(candidates: DataFrame, native: DataFrame, qrels: DataFrame | PairQrels, grid=GRID, quality_k: int = 10) -> DataFrame:
    """k, native_target_quality, restricted_target_quality, candidate_gap, containment, queries; over the queries that all
    inputs have. Every candidate must have a target score."""
    qrels = _judgements(qrels)
    safe = candidates.withColumn("target_score", F.coalesce("target_score", F.raise_error(F.lit("candidate without target score"))))
    common = safe.select("query_id").distinct().join(native.select("query_id").distinct(), "query_id").join(qrels.queries(), "query_id")
    keep = lambda df: df.join(common, "query_id", "left_semi")
    safe, native, qrels = keep(safe), keep(native), qrels.within(common)
    restricted = ndcg(prefixes(safe, grid).select("k", "query_id", "doc_id", F.col("position").alias("rank")), qrels, quality_k, ("k",))
    full = ndcg(native, qrels, quality_k).withColumnRenamed("ndcg", "native")
    held = containment(safe, native, grid, quality_k)
    x = restricted.join(full, "query_id").join(held, ["k", "query_id"])
    return x.groupBy("k").agg(
        F.round(F.avg("native"), 9).alias("native_target_quality"), F.round(F.avg("ndcg"), 9).alias("restricted_target_quality"),
        F.round(F.avg(F.col("native") - F.col("ndcg")), 9).alias("candidate_gap"), F.round(F.avg("containment"), 9).alias("containment"), F.count(F.lit(1)).alias("queries"),
    )


def observed_depth(curve: DataFrame, eps: float = 0.01) -> DataFrame:
    """The smallest K whose gap is at most eps; null if there is none."""
    return curve.agg(F.min(F.when(F.col("candidate_gap") <= eps, F.col("k"))).alias("observed_depth"))


def initial_k(decision: Column, suggested: Column, default: int) -> Column:
    return F.when(decision == "SAFE", suggested).otherwise(F.greatest(suggested, F.lit(default)))


def bootstrap(values: DataFrame, draws: int = 10_000, seed: int = 42, block: int = 256) -> DataFrame:
    """Percentile bootstrap of the mean of column x over rows in order of column i: mean, low, high, draws.

    Uses NumPy's PCG64, `block` draws in a task. The sample is one number a query; it is broadcast, and its size checked."""
    import numpy as np

    from vecshift.operators.retrieval import ship

    spark = values.sparkSession
    ship(spark)
    n = values.count()
    if n > 10_000_000:
        raise ValueError("bootstrap sample too large to broadcast")
    x = np.array([r.x for r in values.orderBy("i").select("x").toLocalIterator()], float)
    held = spark.sparkContext.broadcast(x)

    def run(batches):
        for b in batches:
            v = held.value
            for start, size in zip(b["start"], b["size"], strict=True):
                rng = np.random.default_rng([seed, int(start)])
                import pandas as pd

                yield pd.DataFrame({"m": [v[rng.integers(0, len(v), len(v))].mean() for _ in range(int(size))]})

    jobs = spark.range(0, draws, block).select(F.col("id").alias("start"), F.least(F.lit(block), draws - F.col("id")).alias("size"))
    means = jobs.mapInPandas(run, "m double") if n else spark.createDataFrame([], "m double")
    mean = float(x.mean()) if n else None
    return means.agg(F.lit(mean).cast("double").alias("mean"), F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"), F.count(F.lit(1)).alias("draws"))


def bootstrap_hashed(values: DataFrame, draws: int = 200, seed: int = 42) -> DataFrame:
    """The same interval with resample indices taken from hashes, so that any SQL engine reproduces it: draw r takes for
    slot j the value at index sha256("seed:r:j") mod n."""
    w = Window.orderBy("i")
    pos = values.select(F.row_number().over(w).alias("p"), "x")  # one number for each query
    n = values.agg(F.count(F.lit(1)).alias("n"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "r", "j"), 256), 1, 12), 16, 10).cast("long")
    slots = values.sparkSession.range(draws).withColumnRenamed("id", "r").join(F.broadcast(n)).withColumn("j", F.explode(F.expr("sequence(0L, n - 1)")))
    means = slots.select("r", (h % F.col("n") + 1).cast("int").alias("p")).join(pos, "p").groupBy("r").agg(F.avg("x").alias("m"))
    both = means.agg(F.round(F.expr("percentile(m, 0.025)"), 9).alias("low"), F.round(F.expr("percentile(m, 0.975)"), 9).alias("high"), F.count(F.lit(1)).alias("draws"))
    return values.agg(F.round(F.avg("x"), 9).alias("mean")).join(both)


def k_grid(grid, corpus_size: int, cap: int = 500) -> list[int]:
    """Unique positive depths in ascending order, none beyond the cap or the corpus."""
    if any(isinstance(k, bool) or not isinstance(k, int) or k < 1 for k in grid):
        raise ValueError("depths must be positive integers")
    return [k for k in sorted(set(grid)) if k <= min(cap, corpus_size)]


def evaluate(source: DataFrame, native: DataFrame, qrels: DataFrame, scored: DataFrame | None, grid=GRID, quality_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row of source and native quality, and the gap curve. source and native are rankings (query_id, doc_id, rank);
    scored holds target scores (query_id, doc_id, target_score) of the source candidates. The two quality means run over
    the queries of source, native and qrels, whether or not they have target scores."""
    qrels, kmax = checked_qrels(qrels), max(grid)
    common = source.select("query_id").distinct().join(native.select("query_id").distinct(), "query_id").join(qrels.select("query_id").distinct(), "query_id")
    keep = lambda df: df.join(common, "query_id", "left_semi")
    s, n, q = keep(source), keep(native), keep(qrels)
    x = ndcg(s, q, quality_k).withColumnRenamed("ndcg", "s").join(ndcg(n, q, quality_k).withColumnRenamed("ndcg", "n"), "query_id")
    x = x.join(recall(s, q, kmax).withColumnRenamed("recall", "sr"), "query_id").join(recall(n, q, kmax).withColumnRenamed("recall", "nr"), "query_id")
    one = x.agg(*[F.round(F.avg(a), 9).alias(b) for a, b in (("s", "source_quality"), ("n", "native_quality"), ("sr", "source_recall"), ("nr", "native_recall"))], F.count(F.lit(1)).alias("queries"))
    candidates = source.where(F.col("rank") < kmax).withColumnRenamed("rank", "source_rank").join(scored, ["query_id", "doc_id"], "left")
    return one, gap_curve(candidates, native, qrels, grid, quality_k)


def report(curve: DataFrame, eps: float = 0.01) -> DataFrame:
    """One row: the observed depth and what it recommends."""
    x = observed_depth(curve, eps)
    text = F.when(F.col("observed_depth").isNull(), "no tested depth closes the gap; encode the target index or test deeper lists").otherwise(F.format_string("rerank the first %d source candidates", F.col("observed_depth")))
    return x.withColumn("recommendation", text)
