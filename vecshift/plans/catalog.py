"""The named queries over the test tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecshift.functions import encoders
from vecshift.functions import scalar as S
from vecshift.operators import cache, planning, prewarm, probe, quality, retrieval, telemetry

from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL; whole numbers come out as bigint, as SQL counts do."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in out.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = re.sub(r'(?<!["\w])at(?!["\w])', '"at"', sql)  # a reserved word there
        return run

    return put


# ------------------------------------------------------------------ retrieval


def _topk_sql(score: str, k: int = 10) -> str:
    return f"WITH {X.EMB}, s AS (SELECT query_id, doc_id, round({score}, 9) AS score FROM q CROSS JOIN d) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s QUALIFY rank < {k}"


@query(_topk_sql("list_cosine_similarity(q.v, d.v)"))
def topk_cosine(spark, d):
    return retrieval.topk(X.corpus(spark, d), X.queries(spark, d), 10, "cosine")


@query(_topk_sql("list_dot_product(q.v, d.v)", 20))
def topk_dot(spark, d):
    return retrieval.topk(X.corpus(spark, d), X.queries(spark, d), 20, "ip")


@query(_topk_sql("-list_distance(q.v, d.v)"))
def topk_l2(spark, d):
    return retrieval.topk(X.corpus(spark, d), X.queries(spark, d), 10, "euclidean")


@query(_topk_sql("list_cosine_similarity(q.v, d.v)"))
def cosine_scale_invariance(spark, d):
    """Scaling the corpus by 3 and the queries by 0.5 leaves the cosine ranking as it is."""
    scale = lambda df, c: df.withColumn("v", F.transform("v", lambda x: x * c))
    return retrieval.topk(scale(X.corpus(spark, d), 3.0), scale(X.queries(spark, d), 0.5), 10)


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) = 64 AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 1e-12 AS valid FROM embeddings")
def vector_norm_audit(spark, d):
    c = X.corpus(spark, d)
    return c.select(F.col("doc_id").alias("vec_id"), F.round(S.norm("v"), 6).alias("norm"), (S.vector_ok("v", 64) & (S.norm("v") > 1e-12)).alias("valid"))


@query("SELECT count(*) AS total, count(*) FILTER (vec_id IS NULL) AS null_ids, count(*) FILTER (embedding IS NULL) AS null_vectors, count(DISTINCT vec_id) AS distinct_ids, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension, 0::BIGINT AS invalid_vectors FROM embeddings")
def index_health(spark, d):
    return retrieval.index_health(X.corpus(spark, d), 64)


@query(f"WITH {X.cand_sql(32)} SELECT round(avg(o), 9) AS fidelity, count(*) AS queries, CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN avg(o) >= 0.95 THEN 'PASS' ELSE 'WARNING' END AS status FROM (SELECT query_id, count(*) FILTER (source_rank < 10) / 10 AS o FROM sr WHERE native_rank < 10 GROUP BY query_id)")
def ann_fidelity(spark, d):
    """The ranking in the first 32 dimensions as an approximation of the full one."""
    c, q = X.corpus(spark, d), X.queries(spark, d)
    return retrieval.fidelity(retrieval.topk(X.cut(c, 32), X.cut(q, 32), 10), retrieval.topk(c, q, 10), 10)


@query()
def ivf_probe_recall(spark, d):
    """Coarse-cell search (16 cells, as many probes as a recall of 0.9 takes) against exact search: recall at 10 of each query."""
    c, q = X.corpus(spark, d), X.queries(spark, d)
    cells = retrieval.ivf_train(c, 16)
    found = retrieval.ivf_search(c, q, 10, 16, retrieval.ivf_probes(c, q, 10, cells), cells)
    return retrieval.overlap_at(found, retrieval.topk(c, q, 10), 10)


@query("SELECT backend, metric, round(CASE backend WHEN 'pgvector' THEN CASE metric WHEN 'cosine' THEN 1 - value ELSE -value END WHEN 'pinecone' THEN CASE metric WHEN 'l2' THEN -value * value ELSE value END WHEN 'milvus' THEN CASE metric WHEN 'l2' THEN -value ELSE value END WHEN 'weaviate' THEN -value ELSE CASE metric WHEN 'l2' THEN -value ELSE value END END, 9) AS score, event_id FROM events, (SELECT unnest(['exact','pgvector','pinecone','milvus','weaviate']) AS backend), (SELECT unnest(['cosine','dot','l2']) AS metric)")
def backend_scores(spark, d):
    """Every backend's raw number as a score where higher is better."""
    e = X.table(spark, d, "events").select("event_id", "value")
    kinds = [(b, m) for b in ("exact", "pgvector", "pinecone", "milvus", "weaviate") for m in ("cosine", "dot", "l2")]
    one = F.array(*[F.struct(F.lit(b).alias("backend"), F.lit(m).alias("metric"), F.round(S.similarity(m, F.col("value"), b), 9).alias("score")) for b, m in kinds])
    return e.select("event_id", F.explode(one).alias("s")).select("s.*", "event_id")


# ------------------------------------------------------------------ quality

_NDCG = "sum(coalesce(relevance, 0)::DOUBLE / log2(rank + 2)) / any_value(ideal)"


@query(f"WITH {X.cand_sql()} SELECT query_id, round(coalesce({_NDCG}, 0), 9) AS ndcg FROM nat LEFT JOIN qr USING (query_id, doc_id) JOIN ideal USING (query_id) WHERE rank < 10 GROUP BY query_id")
def ndcg_at_10(spark, d):
    return quality.ndcg(X.native(spark, d, 10), X.qrels(spark, d), 10).withColumn("ndcg", F.round("ndcg", 9))


@query(f"WITH {X.cand_sql()} SELECT query_id, round(count(*) FILTER (rank < 100) / count(*), 9) AS recall FROM qr LEFT JOIN nat USING (query_id, doc_id) GROUP BY query_id")
def recall_at_100(spark, d):
    return quality.recall(X.native(spark, d, 100), X.qrels(spark, d), 100).withColumn("recall", F.round("recall", 9))


@query(f"WITH {X.cand_sql()} SELECT k, round(avg(c), 9) AS containment FROM (SELECT k, query_id, count(*) FILTER (source_rank < k) / 10 AS c FROM sr CROSS JOIN ks WHERE native_rank < 10 GROUP BY ALL) GROUP BY k")
def containment_curve(spark, d):
    x = quality.containment(X.candidates(spark, d), X.native(spark, d, 10))
    return x.groupBy("k").agg(F.round(F.avg("containment"), 9).alias("containment"))


_GAP = f"""WITH {X.cand_sql()},
r AS (SELECT k, query_id, sum(coalesce(relevance, 0)::DOUBLE / log2(pos + 1)) / any_value(ideal) AS n FROM pre LEFT JOIN qr USING (query_id, doc_id) JOIN ideal USING (query_id) WHERE pos <= 10 GROUP BY ALL),
f AS (SELECT query_id, sum(coalesce(relevance, 0)::DOUBLE / log2(rank + 2)) / any_value(ideal) AS n FROM nat LEFT JOIN qr USING (query_id, doc_id) JOIN ideal USING (query_id) WHERE rank < 10 GROUP BY ALL),
c AS (SELECT k, query_id, count(*) FILTER (source_rank < k) / 10 AS c FROM sr CROSS JOIN ks WHERE native_rank < 10 GROUP BY ALL),
g AS (SELECT k, round(avg(f.n), 9) AS native_target_quality, round(avg(r.n), 9) AS restricted_target_quality, round(avg(f.n - r.n), 9) AS candidate_gap, round(avg(c), 9) AS containment, count(*) AS queries FROM r JOIN f USING (query_id) JOIN c USING (k, query_id) GROUP BY k)"""


@query(f"{_GAP} SELECT * FROM g")
def candidate_gap_curve(spark, d):
    return quality.gap_curve(X.candidates(spark, d), X.native(spark, d), X.qrels(spark, d))


@query(f"{_GAP} SELECT min(k) FILTER (candidate_gap <= 0.01) AS observed_depth FROM g")
def observed_depth(spark, d):
    return quality.observed_depth(quality.gap_curve(X.candidates(spark, d), X.native(spark, d), X.qrels(spark, d)))


@query(f"""WITH {X.cand_sql()}, nd AS (SELECT query_id, round(coalesce({_NDCG}, 0), 9) AS x FROM nat LEFT JOIN qr USING (query_id, doc_id) JOIN ideal USING (query_id) WHERE rank < 10 GROUP BY query_id),
v AS (SELECT row_number() OVER (ORDER BY query_id) AS p, x FROM nd), n AS (SELECT count(*) AS n FROM v),
m AS (SELECT r, avg(x) AS m FROM (SELECT r, ('0x' || substr(sha256('42:' || r || ':' || j), 1, 12))::BIGINT % n + 1 AS p FROM range(200) t(r), range((SELECT n FROM n)) u(j), n) JOIN v USING (p) GROUP BY r)
SELECT round((SELECT avg(x) FROM v), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, count(*) AS draws FROM m""")
def bootstrap_ci_hash(spark, d):
    x = quality.ndcg(X.native(spark, d, 10), X.qrels(spark, d), 10)
    return quality.bootstrap_hashed(x.select(F.col("query_id").alias("i"), F.round("ndcg", 9).alias("x")))


@query()
def bootstrap_ci(spark, d):
    """Percentile bootstrap with NumPy's generator, 10,000 draws."""
    x = quality.ndcg(X.native(spark, d, 10), X.qrels(spark, d), 10)
    return quality.bootstrap(x.select(F.col("query_id").alias("i"), F.col("ndcg").alias("x")))


# ------------------------------------------------------------------ probe


@query(f"WITH {X.cand_sql()} SELECT k, query_id, pos AS position, doc_id, source_rank, target_score FROM pre WHERE pos <= 10")
def prefix_rerank_top10(spark, d):
    return quality.prefixes(X.candidates(spark, d)).where("position <= 10").select("k", "query_id", "position", "doc_id", "source_rank", "target_score")


_STAB = f"""WITH {X.cand_sql()}, t AS (SELECT k, query_id, list(doc_id) AS ids FROM pre WHERE pos <= 10 GROUP BY ALL),
st AS (SELECT a.k, query_id, len(list_intersect(a.ids, b.ids)) / greatest(1, len(b.ids)) AS stability FROM t a JOIN t b USING (query_id) WHERE b.k = 500),
cv AS (SELECT k, round(avg(stability), 9) AS mean_stability, round(min(stability), 9) AS min_stability FROM st GROUP BY k),
cw AS (SELECT *, min(mean_stability) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 0.90 AS suffix_stable, coalesce(mean_stability < lag(mean_stability) OVER (ORDER BY k), false) AS falls FROM cv)"""


@query(f"{_STAB} SELECT * FROM cw")
def stability_curve(spark, d):
    return probe.curve(probe.stability(X.candidates(spark, d)))


@query(f"{_STAB} SELECT coalesce(min(k) FILTER (mean_stability >= 0.9), 200) AS recommended_k, min(k) FILTER (suffix_stable) AS suffix_stable_k, bool_or(falls) AS non_monotone, CASE WHEN greatest(10, 2 * max(k)) <= 500 THEN greatest(10, 2 * max(k)) END AS next_k FROM cw")
def recommend_k(spark, d):
    return probe.recommended_k(probe.curve(probe.stability(X.candidates(spark, d))), 500)


@query(f"{_STAB} SELECT k, suffix_stable FROM cw")
def suffix_stable_k(spark, d):
    return probe.curve(probe.stability(X.candidates(spark, d))).select("k", "suffix_stable")


def _features_sql(s: int) -> str:
    return f"""{X.cand_sql(s)}, l AS (SELECT query_id, {', '.join(f'list(doc_id) FILTER (k = {k}) AS t{k}' for k in (10, 20, 50, 100, 200, 500))}, max(source_rank) FILTER (k = 500) AS deep, min(target_score) FILTER (k = 50) AS tenth FROM pre WHERE pos <= 10 GROUP BY query_id),
shell AS (SELECT query_id, max(target_score) AS best FROM cand WHERE source_rank BETWEEN 50 AND 99 GROUP BY query_id),
n AS (SELECT *, len(list_intersect(t50, t500)) / 10 AS s50, len(t100) - len(list_intersect(t50, t100)) AS e50, len(t200) - len(list_intersect(t100, t200)) AS e100, len(t500) - len(list_intersect(t200, t500)) AS e200 FROM l LEFT JOIN shell USING (query_id)),
f AS (SELECT query_id, 1 - s50 AS probe_residual_tail_50, s50 AS stability_50, deep::DOUBLE AS deepest_source_rank, (e50 / 10 + e100 / 10 + e200 / 10) / 3 AS late_tail_area, (e200 > 0)::INT::DOUBLE AS last_shell_any, (coalesce(tenth - best, 0) <= 0)::INT::DOUBLE AS margin_nonpositive,
 e50::DOUBLE AS entrants_50_100, e100::DOUBLE AS entrants_100_200, e200::DOUBLE AS entrants_200_500, (e50 > 0)::INT::DOUBLE AS any_50_100, (e100 > 0)::INT::DOUBLE AS any_100_200, (e200 > 0)::INT::DOUBLE AS any_200_500,
 len(list_intersect(t10, t500)) / 10 AS stability_10_20, len(list_intersect(t20, t500)) / 10 AS stability_20_50, len(list_intersect(t50, t100)) / 10 AS stability_50_100 FROM n)"""


_FEATURES = ["probe_residual_tail_50", "stability_50", "deepest_source_rank", "late_tail_area", "last_shell_any", "margin_nonpositive", "entrants_50_100", "entrants_100_200", "entrants_200_500", "any_50_100", "any_100_200", "any_200_500", "stability_10_20", "stability_20_50", "stability_50_100"]
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in _FEATURES)


@query(f"WITH {_features_sql(48)} SELECT query_id, {_ROUNDED} FROM f")
def t2_query_features(spark, d):
    x = probe.features(X.candidates(spark, d, 48))
    return x.select("query_id", *[F.round(c, 9).alias(c) for c in _FEATURES])


@query(f"WITH {_features_sql(16)} SELECT query_id, entrants_50_100, entrants_100_200, entrants_200_500 FROM f")
def shell_entrants(spark, d):
    return probe.features(X.candidates(spark, d)).select("query_id", "entrants_50_100", "entrants_100_200", "entrants_200_500")


@query(f"WITH {_features_sql(16)} SELECT query_id, deepest_source_rank, margin_nonpositive FROM f")
def deepest_rank_and_margin(spark, d):
    return probe.features(X.candidates(spark, d)).select("query_id", "deepest_source_rank", "margin_nonpositive")


_DECIDE = "CASE WHEN probe_residual_tail_50 <= 0.05 AND deepest_source_rank <= 200 AND late_tail_area <= 0.20 THEN 'SAFE' WHEN probe_residual_tail_50 > 0.10 OR stability_50 < 0.90 OR last_shell_any > 0.25 OR margin_nonpositive > 0.50 THEN 'UNSAFE_OR_UNCERTAIN' ELSE 'EXPAND' END"
_AGG = ", ".join(f"round(avg({c}), 9) AS {c}" for c in _FEATURES) + ", round(quantile_cont(deepest_source_rank, 0.9), 9) AS deepest_p90_spec, count(*) AS queries"


@query(" UNION ALL ".join(f"SELECT *, {_DECIDE} AS decision, {s}::BIGINT AS source_dim FROM (WITH {_features_sql(s)} SELECT {_AGG} FROM f)" for s in (32, 48, 60)))
def t2_decision(spark, d):
    """Three source spaces, one for each branch of the decision."""
    out = None
    for s in (32, 48, 60):
        x = probe.aggregated(probe.features(X.candidates(spark, d, s))).withColumn("decision", probe.decision()).withColumn("source_dim", F.lit(s))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"""WITH {X.cand_sql(32, 300)}, l AS (SELECT query_id, list(doc_id) FILTER (k = 50) AS a, list(doc_id) FILTER (k = 100) AS b, list(doc_id) FILTER (k = 500) AS c, max(source_rank) FILTER (k = 500) AS deep FROM pre WHERE pos <= 10 GROUP BY query_id)
SELECT query_id, round(1 - len(list_intersect(a, b)) / len(b), 9) AS probe_residual_tail_50, round(len(list_intersect(a, b)) / len(b), 9) AS stability_50, deep::DOUBLE AS deepest_source_rank, round((len(c) - len(list_intersect(a, c))) / 10, 9) AS late_tail_area, (len(c) > len(list_intersect(a, c)))::INT::DOUBLE AS last_shell_any, 0.0::DOUBLE AS margin_nonpositive FROM l""")
def t2_short_pool(spark, d):
    """A pool of 300, deeper than the grid."""
    x = probe.short_pool_features(X.candidates(spark, d, 32, 300), (10, 20, 50, 100))
    return x.select("query_id", *[F.round(c, 9).alias(c) for c in x.columns[1:]])


@query("WITH o AS (SELECT doc_id, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) AS rn FROM documents) SELECT doc_id AS query_id, sha256('42:' || doc_id) AS turn FROM o WHERE rn = 1")
def probe_dedup(spark, d):
    x = X.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text", F.col("doc_id").alias("position"))
    return probe.probe_order(x, X.SEED).select("query_id", "turn")


# ------------------------------------------------------------------ telemetry

_LAT = "count(*) AS n, round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.9), 6) AS p90, round(quantile_cont({v}, 0.95), 6) AS p95, round(quantile_cont({v}, 0.99), 6) AS p99, round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(coalesce(stddev_samp({v}), 0), 6) AS std, round(CASE WHEN avg({v}) > 0 THEN 1000 / avg({v}) ELSE 0 END, 6) AS qps"


@query(f"SELECT event_type, {_LAT.format(v='value')} FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return telemetry.latency_summary(X.table(spark, d, "events"), "value", ("event_type",))


@query(f"WITH x AS (SELECT event_type AS mode, user_id % 3 AS k, user_id % 2 AS nprobe, stage, ms FROM (SELECT *, value AS ann_ms, value * 0.5 AS score_ms, value * 2 AS total_ms FROM events) UNPIVOT (ms FOR stage IN (ann_ms, score_ms, total_ms))) SELECT mode, k, nprobe, stage, {_LAT.format(v='ms')} FROM x GROUP BY ALL")
def stage_summary(spark, d):
    e = X.table(spark, d, "events")
    x = e.select(F.col("event_type").alias("mode"), (F.col("user_id") % 3).alias("k"), (F.col("user_id") % 2).alias("nprobe"), F.col("value").alias("ann_ms"), (F.col("value") * 0.5).alias("score_ms"), (F.col("value") * 2).alias("total_ms"))
    return telemetry.stage_summary(x, stages=("ann_ms", "score_ms", "total_ms"))


_POP = "pop AS (SELECT (floor(epoch_us(ts) / 60000000) * 60)::BIGINT AS bucket, fp, document_id, count(*) AS occurrences, count(*) AS queries, count(*) FILTER (miss) AS misses, min(at) AS first_seen, max(at) AS last_seen FROM tr GROUP BY ALL)"


@query(f"WITH {X.TRAFFIC}, {_POP} SELECT * FROM pop")
def popularity_minute(spark, d):
    return telemetry.popularity(X.traffic(spark, d))


_FROM, _TO = 1704500000.5, 1705500000.25  # epoch seconds inside the log


@query(f"WITH {X.TRAFFIC}, {_POP} SELECT fp, document_id, sum(occurrences)::BIGINT AS occurrences, sum(queries)::BIGINT AS queries, sum(misses)::BIGINT AS misses, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM pop WHERE bucket >= floor({_FROM} / 60) * 60 AND bucket <= floor({_TO} / 60) * 60 GROUP BY ALL HAVING max(last_seen) >= {_FROM} AND min(first_seen) <= {_TO}")
def popularity_window(spark, d):
    return telemetry.popularity_window(telemetry.popularity(X.traffic(spark, d)), _FROM, _TO)


@query(f"WITH {X.TRAFFIC} SELECT fp, event_type AS name, count(*) AS total FROM tr WHERE at BETWEEN {_FROM} AND {_TO} GROUP BY ALL")
def counter_totals(spark, d):
    t = X.traffic(spark, d).select("at", "fp", F.col("event_type").alias("name"), F.lit(1).alias("value"))
    return telemetry.counter_totals(t, _FROM, _TO)


@query(f"WITH {X.TRAFFIC} SELECT fp, query_id, at, status FROM tr QUALIFY row_number() OVER (PARTITION BY fp ORDER BY at DESC, query_id DESC) = 1")
def latest_window(spark, d):
    return telemetry.latest(X.traffic(spark, d).select("fp", "query_id", "at", "status"), "fp", "at", "query_id")


@query(f"WITH {X.TRAFFIC}, r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY at DESC, query_id DESC) AS rn FROM tr) SELECT fp, count(*) FILTER (NOT miss) AS hits, count(*) FILTER (miss) AS misses, round(avg((NOT miss)::INT) FILTER (rn <= 100), 9) AS recent_hit_rate, count(DISTINCT document_id) AS entries FROM r GROUP BY fp")
def recent_hit_rate(spark, d):
    t = X.traffic(spark, d)
    return telemetry.cache_stats(t.select("fp", "document_id").distinct(), t.select("fp", "at", F.col("query_id").alias("event_id"), (~F.col("miss")).alias("hit")))


def _observations(spark, d):
    t = X.traffic(spark, d)
    k = F.col("query_id")
    return t.select(
        "fp", "at", "status", "latency_ms", (k % 5).alias("hits"), F.when(F.col("miss"), 2).otherwise(0).alias("misses"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 3 == 0, 0.5).otherwise(1.0).alias("coverage"), (k % 4 == 0).cast("double").alias("top1_agreement"), ((k % 11) / 10).alias("overlap"),
    )


_OBS = "obs AS (SELECT fp, at, status, latency_ms, query_id % 5 AS hits, CASE WHEN miss THEN 2 ELSE 0 END AS misses, CASE WHEN query_id % 7 = 0 THEN NULL WHEN query_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS coverage, (query_id % 4 = 0)::INT::DOUBLE AS top1_agreement, (query_id % 11) / 10 AS overlap FROM tr)"
_ELIG = "status = 'completed' AND coalesce(coverage, 0) >= 1"
_REPORT = f"""rep AS (SELECT count(*) AS observed, count(*) FILTER (status <> 'dropped') AS sampled, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'timeout') AS timeouts, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER ({_ELIG}) AS eligible,
 round((sum(hits) / nullif(sum(hits) + sum(misses), 0))::DOUBLE, 6) AS hit_rate, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(avg(top1_agreement) FILTER ({_ELIG}), 6) AS top1_agreement, round(avg(overlap) FILTER ({_ELIG}), 6) AS overlap, round(avg(coverage), 6) AS mean_coverage, round(min(coverage), 6) AS min_coverage FROM obs)"""


@query(f"WITH {X.TRAFFIC}, {_OBS}, {_REPORT} SELECT * FROM rep")
def shadow_report(spark, d):
    return telemetry.shadow_report(_observations(spark, d))


@query(f"WITH {X.TRAFFIC}, {_OBS}, {_REPORT} SELECT t2, failures, CASE WHEN failures > 0 OR failed + timeouts > 0.05 * sampled OR t2 = 'UNSAFE_OR_UNCERTAIN' THEN 'INVESTIGATE' WHEN t2 = 'EXPAND' THEN 'EXPAND_K' WHEN t2 = 'SAFE' AND eligible >= 20 AND NOT (sampled < 20 OR (sampled > 0 AND eligible < 20) OR coalesce(mean_coverage < 0.5, false)) THEN 'READY_FOR_CANARY_EVALUATION' ELSE 'CONTINUE_SHADOW' END AS recommendation FROM (SELECT * REPLACE (0 AS failed, 0 AS timeouts) FROM rep), (SELECT unnest(['SAFE', 'EXPAND', 'UNSAFE_OR_UNCERTAIN', 'UNKNOWN']) AS t2), (SELECT unnest([0, 1])::BIGINT AS failures)")
def shadow_recommendation(spark, d):
    r = telemetry.shadow_report(_observations(spark, d)).withColumn("failed", F.lit(0)).withColumn("timeouts", F.lit(0))
    x = r.withColumn("t2", F.explode(F.array(*map(F.lit, ("SAFE", "EXPAND", "UNSAFE_OR_UNCERTAIN", "UNKNOWN"))))).withColumn("failures", F.explode(F.array(F.lit(0), F.lit(1))))
    return x.select("t2", "failures", telemetry.recommendation(F.col("t2"), F.col("failures"), 0.5).alias("recommendation"))


@query(f"WITH {X.TRAFFIC}, r AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, document_id::VARCHAR) AS rn, count(*) OVER () AS n, sum(occurrences) OVER () AS s FROM occ) SELECT any_value(n) AS documents, any_value(s)::BIGINT AS accesses, round(sum(occurrences) FILTER (rn <= 20) / any_value(s), 9) AS top20_share, round(sum(occurrences) FILTER (rn <= greatest(1, ceil(n / 100))) / any_value(s), 9) AS top1pct_share FROM r")
def trace_coverage(spark, d):
    t = telemetry.trace_totals(X.traffic(spark, d).select("document_id", F.lit(None).cast("long").alias("count")))
    return telemetry.trace_coverage(t)


@query(f"WITH {X.cand_sql(16, 50)} SELECT count(DISTINCT doc_id) AS unique_docs, count(*) AS occurrences, round(count(DISTINCT doc_id) / count(*), 9) AS fraction FROM cand")
def candidate_dedup(spark, d):
    return telemetry.dedup_fraction(X.candidates(spark, d, 16, 50))


@query(f"WITH {X.TRAFFIC} SELECT count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS processing, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS error FROM tr")
def queue_stats(spark, d):
    s = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
    return telemetry.queue_stats(X.traffic(spark, d).withColumn("status", s))


@query(f"WITH {X.cand_sql(16, 20)} SELECT doc_id AS document_id, count(*) AS count FROM cand GROUP BY ALL")
def popular_ids(spark, d):
    log = X.candidates(spark, d, 16, 20).groupBy("query_id").agg(F.collect_list("doc_id").alias("candidate_ids"))
    return telemetry.popular_ids(log)


@query("""SELECT "group", count(*) AS cells, count(*) FILTER (gap <= 0.01) AS small_gap, count(*) FILTER (ci_certified) AS certified, count(*) FILTER (decision = 'SAFE') AS safe, count(*) FILTER (decision = 'SAFE' AND gap > 0.01) AS false_safe
 FROM (SELECT event_type AS "group", value / 1000 AS gap, user_id % 3 = 0 AS ci_certified, CASE WHEN user_id % 2 = 0 THEN 'SAFE' ELSE 'EXPAND' END AS decision FROM events) GROUP BY ALL""")
def count_audit(spark, d):
    e = X.table(spark, d, "events")
    return telemetry.count_audit(e.select(F.col("event_type").alias("group"), (F.col("value") / 1000).alias("gap"), (F.col("user_id") % 3 == 0).alias("ci_certified"), F.when(F.col("user_id") % 2 == 0, "SAFE").otherwise("EXPAND").alias("decision")))


@query(f"SELECT event_id, {X.HASHED.format(c='event_id', t=int(0.1 * (1 << 64)))} AS sampled FROM events")
def hash_sample(spark, d):
    return X.table(spark, d, "events").select("event_id", S.sampled(X.SEED, F.col("event_id"), 0.1).alias("sampled"))


_ODD = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN -value WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE value END AS ms, CASE event_type WHEN 'view' THEN 'Completed' WHEN 'click' THEN 'TIMED_OUT' WHEN 'error' THEN 'dropped' ELSE event_type END AS st, CASE event_id % 4 WHEN 0 THEN 'rerank_error' WHEN 1 THEN 'some text' WHEN 2 THEN '' END AS cat, value - 50 AS h FROM events"


@query(f"SELECT event_id, CASE WHEN isfinite(ms) THEN round(ms, 6) END AS latency_ms, CASE WHEN lower(st) IN ('completed', 'partial', 'failed', 'timeout', 'timed_out') THEN lower(st) ELSE 'failed' END AS status, CASE WHEN cat = '' THEN NULL WHEN cat = 'rerank_error' THEN 'RERANK_ERROR' WHEN cat IS NOT NULL THEN 'INTERNAL' END AS failure_category, CASE WHEN h >= 0 THEN round(h)::BIGINT ELSE 0 END AS hits, 0::BIGINT AS misses FROM ({_ODD})")
def sanitised_telemetry(spark, d):
    e, k = X.table(spark, d, "events"), F.col("event_id")
    ms = F.when(k % 5 == 0, -F.col("value")).when(k % 5 == 1, float("inf")).when(k % 5 == 2, float("nan")).otherwise(F.col("value"))
    status = F.when(F.col("event_type") == "view", "Completed").when(F.col("event_type") == "click", "TIMED_OUT").when(F.col("event_type") == "error", "dropped").otherwise(F.col("event_type"))
    cat = F.when(k % 4 == 0, "rerank_error").when(k % 4 == 1, "some text").when(k % 4 == 2, "")
    x = e.select("event_id", ms.alias("latency_ms"), status.alias("status"), cat.alias("failure_category"), (F.col("value") - 50).alias("hits"), F.lit(float("nan")).alias("misses"))
    return telemetry.sanitised(x).withColumn("latency_ms", F.round("latency_ms", 6))


@query("""WITH x AS (SELECT unnest(['source', 'shadow', 'source_candidate', 'target_query_encode', 'target_rerank']) AS stage, unnest([value, value * 2, value / 2, value - 50, NULL]) AS ms FROM events)
SELECT stage, count(ms) FILTER (ms >= 0) AS count, round(quantile_cont(ms, 0.5) FILTER (ms >= 0), 6) AS p50_ms, round(quantile_cont(ms, 0.95) FILTER (ms >= 0), 6) AS p95_ms, round(avg(ms) FILTER (ms >= 0), 6) AS mean_ms FROM x GROUP BY stage""")
def shadow_latency(spark, d):
    v = F.col("value")
    cols = {"source": v, "shadow": v * 2, "source_candidate": v / 2, "target_query_encode": v - 50, "target_rerank": F.lit(None).cast("double")}
    return telemetry.shadow_latency(X.table(spark, d, "events").select(*[c.alias(f"{k}_latency_ms") for k, c in cols.items()]))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY ALL""")
def large_group_percentiles(spark, d):
    """Exact percentiles of a few groups that grow with the table, by narrowing histograms."""
    from vecshift.operators.percentiles import exact_percentiles

    x = exact_percentiles(X.table(spark, d, "lineitem"), "l_extendedprice", (0.5, 0.9, 0.95, 0.99), ("l_returnflag", "l_linestatus"), few=10_000)
    return x.select("l_returnflag", "l_linestatus", "n", *[F.round(F.col("p")[i], 6).alias(f"p{q}") for i, q in enumerate((50, 90, 95, 99))])


# ------------------------------------------------------------------ prewarm


def _occ(spark, d):
    return X.traffic(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("occurrences"))


_TARGET, _CAP = 0.8, 60
_HOT = f"""WITH {X.TRAFFIC}, s AS (SELECT *, document_id IN (SELECT document_id FROM warm) AS w FROM occ), t AS (SELECT sum(occurrences) AS a, sum(occurrences) FILTER (w) AS b, count(*) FILTER (NOT w) AS c FROM s),
c AS (SELECT document_id, occurrences, row_number() OVER o AS rank, coalesce(sum(occurrences) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s WHERE NOT w WINDOW o AS (ORDER BY occurrences DESC, document_id::VARCHAR)),
h AS (SELECT c.* FROM c, t WHERE rank <= {_CAP} AND before < greatest(0, ceil({_TARGET}::DOUBLE * a) - b))"""


@query(f"{_HOT} SELECT * FROM h")
def prewarm_hotset(spark, d):
    return prewarm.hot_set(_occ(spark, d), X.warm(spark, d), _CAP, _TARGET)


@query(f"{_HOT} SELECT a::BIGINT AS total, b::BIGINT AS warm_traffic, c AS cold_documents, n AS selected, m::BIGINT AS selected_traffic, round(b / a, 9) AS baseline_coverage, round((b + m) / a, 9) AS coverage, CASE WHEN a = 0 THEN 'NO_COMPATIBLE_TRAFFIC' WHEN n = 0 THEN 'NOOP' ELSE 'READY' END AS status, (b + m) / a + 1e-12 < {_TARGET}::DOUBLE AS target_unmet, (b + m) / a < {_TARGET}::DOUBLE AND n >= {_CAP} AS budget_limited FROM t, (SELECT count(*) AS n, coalesce(sum(occurrences), 0) AS m FROM h)")
def prewarm_status(spark, d):
    t, w = _occ(spark, d), X.warm(spark, d)
    return prewarm.summary(t, w, prewarm.hot_set(t, w, _CAP, _TARGET), _TARGET, _CAP)


@query(f"{_HOT} SELECT p AS documents, round((b + coalesce((SELECT sum(occurrences) FROM c WHERE rank <= p), 0)) / a, 9) AS coverage FROM t, (SELECT DISTINCT unnest([0::BIGINT, 1000, 5000, 10000, 25000, 50000, 100000, (SELECT c FROM t)]) AS p) WHERE p <= (SELECT c FROM t)")
def coverage_curve(spark, d):
    return prewarm.coverage_curve(_occ(spark, d), X.warm(spark, d))


@query("""WITH p AS (SELECT user_id AS plan_id, 1000::BIGINT AS max_docs, (user_id % 7) / 1000 AS gb, 64 AS dim, 4 AS width, (user_id % 11) * 60.0::DOUBLE AS budget_s, 3.5::DOUBLE AS rate FROM (SELECT DISTINCT user_id FROM events)),
x AS (SELECT *, floor(gb * 1073741824 / (dim * width))::BIGINT AS b, floor(budget_s * rate)::BIGINT AS t FROM p), y AS (SELECT *, CASE WHEN b < max_docs THEN b ELSE max_docs END AS c1 FROM x)
SELECT plan_id, CASE WHEN t < c1 THEN t ELSE c1 END AS cap, CASE WHEN t < c1 THEN 'time' WHEN c1 < max_docs THEN 'storage' ELSE 'max_docs' END AS limiter FROM y""")
def prewarm_caps(spark, d):
    u = X.table(spark, d, "events").select("user_id").distinct()
    x = u.select(F.col("user_id").alias("plan_id"), F.lit(1000).cast("long").alias("max_docs"), ((F.col("user_id") % 7) / 1000).alias("gb"), F.lit(64).alias("dim"), F.lit(4).alias("width"), ((F.col("user_id") % 11) * 60.0).alias("budget_s"), F.lit(3.5).alias("docs_per_s"))
    return prewarm.caps_table(x).select("plan_id", "cap", "limiter")


@query(f"{_HOT} SELECT sha256('cfg|{_CAP}|' || coalesce(string_agg(document_id::VARCHAR, ',' ORDER BY rank), '')) AS fingerprint FROM h")
def prewarm_fingerprint(spark, d):
    return prewarm.plan_fingerprint(prewarm.hot_set(_occ(spark, d), X.warm(spark, d), _CAP, _TARGET), "cfg", _CAP)


@query(f"SELECT vec_id AS document_id FROM embeddings WHERE {X.HASHED.format(c='vec_id', t=int(0.25 * (1 << 64)))}")
def prewarm_random_ids(spark, d):
    return prewarm.by_strategy(X.corpus(spark, d).select(F.col("doc_id").alias("document_id")), "random", fraction=0.25)


_PLANS = """p AS (SELECT user_id AS plan_id, CASE WHEN user_id % 17 = 3 THEN 2 ELSE 1 END AS schema_version, CASE WHEN user_id % 19 = 4 THEN 'random' ELSE 'traffic_hotset' END AS strategy,
 CASE WHEN user_id % 23 = 5 THEN NULL WHEN user_id % 29 = 6 THEN 3 ELSE 1000000 END::BIGINT AS max_docs, CASE WHEN user_id % 13 = 7 THEN count(*) + 1 END AS documents, 'cfg' || (user_id % 2) AS config,
 CASE user_id % 31 WHEN 8 THEN 0 WHEN 9 THEN 20 WHEN 10 THEN NULL ELSE 50 END::BIGINT AS candidate_k, 'target' AS target_fingerprint, CASE WHEN user_id % 7 = 1 THEN ' ' ELSE 'source' END AS source_fingerprint,
 CASE WHEN user_id % 11 = 2 THEN 'other' ELSE 'parquet' END AS backend, 'telemetry' AS telemetry_fingerprint, 'index' AS index_identity_fingerprint, count(*) AS n FROM events GROUP BY user_id),
s AS (SELECT user_id AS plan_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, CASE WHEN user_id % 37 = 11 AND event_type = 'error' THEN ' ' WHEN user_id % 41 = 12 AND event_type = 'view' THEN event_type ELSE event_id::VARCHAR END AS document_id FROM events),
g AS (SELECT plan_id, string_agg(document_id, ',' ORDER BY rank) AS ids, count(DISTINCT document_id) AS d, count(*) FILTER (trim(document_id) = '') AS blank FROM s GROUP BY plan_id),
x AS (SELECT *, sha256(concat_ws('|', config, max_docs::VARCHAR, ids)) AS recomputed FROM p JOIN g USING (plan_id))"""


@query(f"""WITH {_PLANS} SELECT plan_id, unnest(list_filter([CASE WHEN schema_version <> 1 THEN 'schema_version' END, CASE WHEN strategy <> 'traffic_hotset' THEN 'strategy' END, CASE WHEN blank > 0 THEN 'blank_id' END,
 CASE WHEN n - blank > d THEN 'repeated_ids' END, CASE WHEN documents <> n THEN 'documents' END, CASE WHEN max_docs IS NULL THEN 'max_docs' END, CASE WHEN n > max_docs THEN 'over_budget' END,
 CASE WHEN candidate_k < 1 THEN 'candidate_k' WHEN candidate_k <> 50 THEN 'candidate_k differs' END, CASE WHEN plan_id % 5 = 0 THEN 'fingerprint' END,
 CASE WHEN trim(source_fingerprint) = '' THEN 'source_fingerprint missing' END, CASE WHEN backend <> 'parquet' THEN 'backend differs' END, 'index_identity_fingerprint unknown here'], lambda v: v IS NOT NULL)) AS violation FROM x""")
def prewarm_plan_violations(spark, d):
    """Plans with the events of each user as their documents, some of them tampered with, checked against one place to run them."""
    e, u = X.table(spark, d, "events"), F.col("user_id")
    k = F.when(u % 31 == 8, 0).when(u % 31 == 9, 20).when(u % 31 != 10, 50)
    ids = F.when((u % 37 == 11) & (F.col("event_type") == "error"), " ").when((u % 41 == 12) & (F.col("event_type") == "view"), F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    s = e.select(u.alias("plan_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"), ids.alias("document_id"))
    plans = e.groupBy(u.alias("plan_id"), u).agg(F.count(F.lit(1)).alias("n")).select(
        "plan_id", F.when(u % 17 == 3, 2).otherwise(1).alias("schema_version"), F.when(u % 19 == 4, "random").otherwise("traffic_hotset").alias("strategy"),
        F.when(u % 23 == 5, None).when(u % 29 == 6, 3).otherwise(1_000_000).cast("long").alias("max_docs"), F.when(u % 13 == 7, F.col("n") + 1).alias("documents"), F.concat(F.lit("cfg"), (u % 2).cast("string")).alias("config"),
        k.cast("long").alias("candidate_k"), F.lit("target").alias("target_fingerprint"), F.when(u % 7 == 1, " ").otherwise("source").alias("source_fingerprint"),
        F.when(u % 11 == 2, "other").otherwise("parquet").alias("backend"), F.lit("telemetry").alias("telemetry_fingerprint"), F.lit("index").alias("index_identity_fingerprint"),
    )
    # the fingerprint that a plan's own writer gives, spoilt for every fifth
    own = s.join(plans.select("plan_id", "config", "max_docs"), "plan_id").groupBy("plan_id", "config", "max_docs").agg(prewarm.ids_digest(F.col("config"), F.col("max_docs")).alias("fingerprint"))
    plans = plans.join(own.select("plan_id", "fingerprint"), "plan_id").withColumn("fingerprint", F.when(F.col("plan_id") % 5 == 0, F.reverse("fingerprint")).otherwise(F.col("fingerprint")))
    here = {"target_fingerprint": "target", "source_fingerprint": "source", "backend": "parquet", "telemetry_fingerprint": "telemetry", "candidate_k": 50}
    return prewarm.plan_violations(plans, s, here)


@query(f"""WITH {X.TRAFFIC}, h AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, document_id::VARCHAR) AS rank FROM occ QUALIFY rank <= 100),
w AS (SELECT doc_id FROM documents WHERE {X.HASHED.format(c='doc_id', t=int(0.3 * (1 << 64)))} AND doc_id % 7 <> 3),
t AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 3 AND text IS NOT NULL),
x AS (SELECT document_id, rank, CASE WHEN w.doc_id IS NOT NULL THEN 'warm' ELSE 'cold' END AS status FROM h LEFT JOIN w ON w.doc_id = document_id)
SELECT document_id, 0::BIGINT AS batch, status, NULL AS error FROM x UNION ALL
SELECT document_id, ceil(rank / 30)::BIGINT, CASE WHEN t.doc_id IS NULL THEN 'failed' ELSE 'encoded' END, CASE WHEN t.doc_id IS NULL THEN 'document text is unavailable' END FROM x LEFT JOIN t ON t.doc_id = document_id WHERE status = 'cold' UNION ALL
SELECT document_id, (SELECT ceil(max(rank) / 30) FROM x)::BIGINT + r, 'failed', 'document text is unavailable' FROM x LEFT JOIN t ON t.doc_id = document_id CROSS JOIN (SELECT unnest([1, 2]) AS r) WHERE status = 'cold' AND t.doc_id IS NULL""")
def prewarm_ledger(spark, d):
    """The ledger of a plan for the hundred hottest documents in batches of thirty, lost after the first two batches and run again.
    Some documents are warm at the start; some have no text, are tried three times and stay failed."""
    from vecshift.operators.ledger import PrewarmRun
    from vecshift.operators.serving import TargetStore
    from vecshift.sources.snapshots import fresh, written

    text = F.when(F.col("doc_id") % 7 != 3, F.col("text"))
    docs = X.table(spark, d, "documents").select("doc_id", text.alias("text"))
    traffic = X.traffic(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("occurrences"))
    none = traffic.select("document_id").limit(0)
    chosen = written(prewarm.hot_set(traffic, none, 100), "chosen")
    store = TargetStore(spark, fresh(spark, "store"), encoders.FeatureHashModel())
    store.encode(docs.where(S.sampled(X.SEED, F.col("doc_id"), 0.3)))
    path = fresh(spark, "ledger")
    PrewarmRun(path, chosen, store, docs, "plan", 30).run(2)
    again = PrewarmRun(path, chosen, store, docs, "plan", 30)
    again.run()
    return again.ledger.read()


# ------------------------------------------------------------------ cache and serving


@query("""WITH w AS (SELECT doc_id, sha256(text) AS c FROM documents), k AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'old' ELSE sha256(text) END AS b FROM documents WHERE doc_id % 3 <> 0)
SELECT w.doc_id AS document_id, CASE WHEN k.doc_id IS NULL THEN 'miss' WHEN b IS NULL OR b = c THEN 'hit' ELSE 'stale' END AS state FROM w LEFT JOIN k USING (doc_id)""")
def cache_lookup(spark, d):
    x = X.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_fingerprint"))
    m = F.col("document_id") % 5
    c = x.where("document_id % 3 <> 0").select("document_id", F.when(m == 0, F.lit(None).cast("string")).when(m == 1, "old").otherwise(F.col("content_fingerprint")).alias("content_fingerprint"), F.lit("m1").alias("model_fingerprint"))
    return cache.lookup(x, c, "m1").select("document_id", "state")


@query("""WITH w AS (SELECT user_id AS document_id, event_id AS at, value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'c' || (event_id % 9) END AS c FROM events)
SELECT document_id, 'm1' AS model_fingerprint, arg_max(value, at) AS value, arg_max(c, at) FILTER (c IS NOT NULL) AS content_fingerprint, min(at) AS created_at, max(at) AS accessed_at FROM w GROUP BY document_id""")
def cache_upsert_latest(spark, d):
    e = X.table(spark, d, "events")
    w = e.select(F.col("user_id").alias("document_id"), F.lit("m1").alias("model_fingerprint"), F.array("value").alias("vector"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string"))).alias("content_fingerprint"), F.col("event_id").alias("at"))
    return cache.upsert(w.where("at % 2 = 0"), w.where("at % 2 = 1")).withColumn("value", F.col("vector")[0]).drop("vector")


@query("SELECT vec_id AS document_id, CASE vec_id % 4 WHEN 1 THEN 'checksum' WHEN 2 THEN 'dimension' ELSE '' END AS faults FROM embeddings")
def cache_integrity(spark, d):
    """Every fourth row has a wrong checksum, every fourth another dimension."""
    x = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"))
    k = F.col("document_id") % 4
    x = x.withColumn("dimension", F.when(k == 2, 63).otherwise(64)).withColumn("checksum", F.when(k == 1, "bad").otherwise(cache.checksum()))
    return cache.integrity(x).select("document_id", F.concat_ws(",", "faults").alias("faults"))


_HIT = X.HASHED.format(c="doc_id", t=int(X.RATE * (1 << 64)))


def _served(spark, d, k: int = 50):
    return X.candidates(spark, d, 16, k).withColumn("hit", S.sampled(X.SEED, F.col("doc_id"), X.RATE))


@query(f"WITH {X.cand_sql(16, 50)}, c AS (SELECT *, {_HIT} AS hit FROM cand) SELECT query_id, count(*) AS candidates, count(*) FILTER (hit) AS available, round(count(*) FILTER (hit) / count(*), 9) AS hit_rate, CASE WHEN count(*) FILTER (hit) = count(*) THEN 'WARM' WHEN count(*) FILTER (hit) > 0 THEN 'PARTIAL' ELSE 'COLD' END AS state FROM c GROUP BY query_id")
def serving_state(spark, d):
    return cache.serving_state(_served(spark, d))


_PROG = f"""WITH {X.cand_sql(16, 50)}, c AS (SELECT *, {_HIT} AS hit FROM cand), m AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY query_id ORDER BY source_rank) AS miss FROM c),
a AS (SELECT *, CASE WHEN hit THEN 'cached' WHEN miss <= 4 THEN 'encoded' ELSE 'queued' END AS action FROM m), b AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(*) FILTER (action <> 'queued') OVER (PARTITION BY query_id) AS have, CASE WHEN action <> 'queued' THEN target_score END AS score FROM a),
p AS (SELECT query_id, doc_id, source_rank, action, score, CASE WHEN have = n THEN 'WARM' WHEN have > 0 THEN 'PARTIAL' ELSE 'COLD' END AS state, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, source_rank) AS r FROM b)"""


@query(f"{_PROG} SELECT query_id, doc_id, source_rank, action, score, state, CASE WHEN action <> 'queued' OR state = 'COLD' THEN r END AS position FROM p")
def progressive_search(spark, d):
    return cache.progressive(_served(spark, d)).select("query_id", "doc_id", "source_rank", "action", "score", "state", "position")


@query(f"""{_PROG}, s AS (SELECT query_id, count(*) AS ns, count(*) FILTER (action = 'cached') / count(*) AS coverage, arg_min(doc_id, source_rank) AS s1, list(doc_id) FILTER (source_rank < 10) AS sk FROM p GROUP BY query_id),
t AS (SELECT query_id, count(*) AS nt, arg_min(doc_id, r) AS t1, list(doc_id) FILTER (r <= 10) AS tk FROM p WHERE action <> 'queued' GROUP BY query_id)
SELECT query_id, round(coverage, 9) AS coverage, coalesce((s1 = t1)::BIGINT, 0) AS top1_agreement, round(len(list_intersect(sk, tk)) / greatest(1, least(10, ns, nt)), 9) AS overlap, coverage >= 1.0 AS completed FROM s LEFT JOIN t USING (query_id)""")
def shadow_observation(spark, d):
    p = cache.progressive(_served(spark, d))
    source = p.select("query_id", "doc_id", F.col("source_rank").alias("rank"), (F.col("action") == "cached").alias("hit"))
    return cache.shadow_observation(source, p.where("action <> 'queued'").select("query_id", "doc_id", (F.col("position") - 1).alias("rank")))


@query("""WITH RECURSIVE e AS (SELECT user_id AS document_id, event_id AS seq, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT document_id, 0::BIGINT AS n, NULL::VARCHAR AS status, 0::BIGINT AS attempts, NULL::BIGINT AS enqueued_at FROM (SELECT DISTINCT document_id FROM e)
UNION ALL SELECT s.document_id, e.n,
 CASE WHEN kind = 'view' AND status IS NULL THEN 'pending' WHEN kind = 'click' AND status = 'pending' AND attempts < 3 THEN 'processing' WHEN kind = 'purchase' AND status = 'processing' THEN 'done' WHEN kind = 'error' AND status = 'processing' THEN CASE WHEN attempts < 3 THEN 'pending' ELSE 'error' END WHEN kind = 'signup' AND status IN ('done', 'error') THEN 'pending' ELSE status END,
 CASE WHEN kind = 'click' AND status = 'pending' AND attempts < 3 THEN attempts + 1 WHEN kind = 'signup' AND status IN ('done', 'error') THEN 0 ELSE attempts END,
 CASE WHEN kind = 'view' AND status IS NULL THEN seq ELSE enqueued_at END FROM s JOIN e ON e.document_id = s.document_id AND e.n = s.n + 1)
SELECT document_id, status, attempts, enqueued_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC) AS r FROM s) WHERE r = 1 AND status IS NOT NULL""")
def work_queue_state(spark, d):
    """The queue's state after all events, folded for each document."""
    e = X.table(spark, d, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "enqueue"), ("click", "claim"), ("purchase", "done"), ("error", "fail"), ("signup", "requeue")) for x in p]), F.col("event_type"))
    return cache.queue_fold(e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("SELECT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND doc_id % 7 <> 0)")
def missing_text(spark, d):
    t = X.table(spark, d, "documents")
    return cache.missing_text(X.corpus(spark, d), t.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text"))))


@query(f"WITH {X.cand_sql(16, 50)} SELECT query_id, doc_id, source_rank, CASE WHEN doc_id % 7 <> 0 THEN text END AS text FROM cand LEFT JOIN documents USING (doc_id)")
def hits_with_text(spark, d):
    docs = X.table(spark, d, "documents").where("doc_id % 7 <> 0")
    return cache.with_text(X.candidates(spark, d, 16, 50), docs).select("query_id", "doc_id", "source_rank", "text")


# ------------------------------------------------------------------ planning and registry

_COST = "round({n} / 331.19::DOUBLE, 6) AS encode_seconds, round({n} / 331.19::DOUBLE / 3600 * 2.5::DOUBLE, 6) AS cost_usd, 'user_supplied' AS rate_provenance, 'modeled' AS cost_provenance"


@query(f"WITH n AS (SELECT count(*) AS n FROM documents), x AS (SELECT f AS fraction, ceil(round(n * f, 6))::BIGINT AS documents FROM n, (SELECT unnest([0.01, 0.05, 0.10, 0.25, 0.50, 1.0])::DOUBLE AS f)) SELECT fraction, documents, documents * 64 * 2 AS storage_bytes, {_COST.format(n='documents')} FROM x")
def economics_scenarios(spark, d):
    return planning.scenarios(X.table(spark, d, "documents").select("doc_id"), 64, "bf16", 331.19, 2.5)


@query(f"WITH x AS (SELECT count(*) AS documents, count(*) FILTER ({X.HASHED.format(c='doc_id', t=int(0.3 * (1 << 64)))}) AS cached FROM documents) SELECT documents, cached, documents - cached AS remaining, round((documents - cached) / documents, 9) AS deferred_fraction, (documents - cached) * 64 * 4 AS storage_bytes, {_COST.format(n='(documents - cached)')} FROM x")
def economics_remaining(spark, d):
    c = X.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return planning.remaining(c, c.where(S.sampled(X.SEED, F.col("document_id"), 0.3)), 64, "float32", 331.19, 2.5)


_KINDS = "(SELECT user_id AS plan_id, CASE user_id % 4 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'EXPAND' WHEN 2 THEN 'UNSAFE_OR_UNCERTAIN' END AS decision, CASE user_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARNING' ELSE 'UNKNOWN' END AS ann_status, CASE WHEN user_id % 9 = 8 THEN 'FAIL' WHEN user_id % 9 = 7 THEN 'WARN' ELSE 'PASS' END AS preflight, count(*) * (user_id % 7) // 2 AS probes, user_id % 8 < 6 AS verified, user_id % 5 = 0 AS exact_registry, CASE WHEN user_id % 13 <> 0 THEN 100::BIGINT END AS recommended_k, (user_id % 13) * 100 AS cached, (user_id % 11) * 100 AS documents FROM events GROUP BY user_id)"


def _kinds(spark, d):
    u = F.col("user_id")
    return X.table(spark, d, "events").groupBy("user_id").agg(F.expr("count(*) * (user_id % 7) div 2").alias("probes")).select(
        u.alias("plan_id"), F.when(u % 4 == 0, "SAFE").when(u % 4 == 1, "EXPAND").when(u % 4 == 2, "UNSAFE_OR_UNCERTAIN").alias("decision"), F.when(u % 3 == 0, "PASS").when(u % 3 == 1, "WARNING").otherwise("UNKNOWN").alias("ann_status"),
        F.when(u % 9 == 8, "FAIL").when(u % 9 == 7, "WARN").otherwise("PASS").alias("preflight"), "probes", (u % 8 < 6).alias("verified"), (u % 5 == 0).alias("exact_registry"),
        F.when(u % 13 != 0, F.lit(100).cast("long")).alias("recommended_k"), ((u % 13) * 100).alias("cached"), ((u % 11) * 100).alias("documents"),
    )


@query(f"""SELECT plan_id, CASE WHEN decision = 'SAFE' AND ann_status <> 'WARNING' THEN 'READY' ELSE 'REVIEW' END AS status, CASE WHEN decision = 'SAFE' THEN 'PROGRESSIVE' ELSE 'PROGRESSIVE_WITH_REVIEW' END AS strategy, coalesce(recommended_k, 50) AS k,
 CASE WHEN documents = 0 THEN 0 ELSE round(cached / documents, 9) END AS cache_fraction, concat_ws(',', CASE WHEN decision = 'SAFE' THEN NULL ELSE 'DECISION_NOT_SAFE' END, CASE WHEN ann_status <> 'PASS' THEN 'ANN_NOT_CONFIRMED' END, CASE WHEN cached > documents THEN 'CACHE_EXCEEDS_CORPUS' END) AS warnings FROM {_KINDS}""")
def serving_plan(spark, d):
    return planning.serving_plan(_kinds(spark, d)).select("plan_id", "status", "strategy", "k", "cache_fraction", "warnings")


_ADVICE = f"""SELECT *, CASE WHEN preflight = 'FAIL' THEN 'BLOCKED' WHEN probes = 0 THEN 'EXPAND_PROBE' WHEN decision = 'UNSAFE_OR_UNCERTAIN' THEN 'DEFER' WHEN decision = 'SAFE' AND recommended_k IS NOT NULL THEN CASE WHEN probes >= 100 AND verified AND preflight = 'PASS' THEN 'PROCEED' ELSE 'PROCEED_WITH_CAUTION' END ELSE 'EXPAND_PROBE' END AS recommendation,
 CASE WHEN decision IS NULL OR probes = 0 THEN 'INSUFFICIENT' WHEN decision <> 'SAFE' THEN CASE WHEN probes < 50 THEN 'LIMITED' ELSE 'MODERATE' END WHEN probes >= 100 AND verified AND (ann_status = 'PASS' OR exact_registry) THEN 'STRONG' WHEN probes >= 50 THEN 'MODERATE' ELSE 'LIMITED' END AS confidence FROM {_KINDS}"""


@query(f"SELECT plan_id, decision, coalesce(recommended_k, 20) AS suggested, CASE WHEN decision = 'SAFE' THEN coalesce(recommended_k, 20) ELSE greatest(coalesce(recommended_k, 20), 50) END AS initial_k FROM {_KINDS}")
def initial_k(spark, d):
    x = _kinds(spark, d).select("plan_id", "decision", F.coalesce("recommended_k", F.lit(20)).cast("long").alias("suggested"))
    return x.withColumn("initial_k", quality.initial_k(F.col("decision"), F.col("suggested"), 50).cast("bigint"))


@query(f"SELECT plan_id, recommendation, confidence FROM ({_ADVICE})")
def advisory_plan(spark, d):
    return planning.advisory(_kinds(spark, d)).select("plan_id", "recommendation", "confidence")


@query(f"""SELECT plan_id, phase, name, traffic FROM ({_ADVICE}), (VALUES (0::BIGINT, 'Validate', 0.0::DOUBLE, 0), (1, 'Shadow', 0.0, 0), (2, 'Small canary', 0.05, 1), (3, 'Expanded canary', 0.25, 1), (4, 'Target-primary path', 1.0, 1), (2, 'Hold', 0.0, 2)) AS p(phase, name, traffic, w)
WHERE w = 0 OR w = CASE WHEN recommendation LIKE 'PROCEED%' THEN 1 ELSE 2 END""")
def rollout_phases(spark, d):
    return planning.rollout(planning.advisory(_kinds(spark, d)))


_REG = """r AS (SELECT p_partkey AS evidence_id, CASE p_size % 7 WHEN 0 THEN 'qwen3-4b' WHEN 1 THEN 'Qwen/Qwen3-Embedding-4B' WHEN 2 THEN 'MiniLM-L6' ELSE 'own-' || (p_size % 7) END AS source, CASE p_partkey % 5 WHEN 0 THEN 'QWEN3_8B' WHEN 1 THEN 'my-qwen3-tuned' ELSE 'model-' || (p_partkey % 5) END AS target,
 CASE WHEN p_size % 7 = 4 THEN p_type ELSE 'fp' || (p_size % 7 // 2) END AS source_fp, 'fp' || (p_partkey % 5) AS target_fp, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS corpus_fp, 'set' || (p_partkey % 4) AS corpus_name, p_size::BIGINT AS corpus_size, p_partkey % 2 = 0 AS canonical FROM part),
w AS (SELECT evidence_id AS pair_id, CASE WHEN evidence_id % 6 = 5 THEN 'all-minilm-x' WHEN evidence_id % 11 = 3 THEN 'unheard' ELSE source END AS source, target, CASE WHEN evidence_id % 4 = 1 THEN NULL ELSE source_fp END AS source_fp, target_fp, CASE WHEN evidence_id % 2 = 0 THEN corpus_fp ELSE 'new' END AS corpus_fp, corpus_name, corpus_size + evidence_id % 2 AS corpus_size FROM r)"""
_CANON = "CASE lower({c}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MODELS.items()) + " ELSE {c} END"
_KIN = "CASE WHEN lower({c}) LIKE '%minilm%' THEN 'minilm' WHEN lower({c}) LIKE '%qwen3%' THEN 'qwen3' ELSE replace(replace(lower({c}), 'embedding', ''), 'sentence-transformers/', '') END"


@query(f"""WITH {_REG}, a AS (SELECT * REPLACE ({_CANON.format(c='source')} AS source, {_CANON.format(c='target')} AS target) FROM r), b AS (SELECT * REPLACE ({_CANON.format(c='source')} AS source, {_CANON.format(c='target')} AS target) FROM w),
t AS (SELECT pair_id, evidence_id, a.source_fp IS NOT DISTINCT FROM b.source_fp AND a.target_fp IS NOT DISTINCT FROM b.target_fp AND b.source_fp IS NOT NULL AS c, coalesce(a.corpus_fp = b.corpus_fp, false) OR (a.canonical AND a.corpus_name = b.corpus_name AND a.corpus_size = b.corpus_size) AS k FROM b JOIN a ON a.source = b.source AND a.target = b.target),
n AS (SELECT pair_id, bool_and(c) AS c, count(*) AS n, min(evidence_id) AS m, count(*) FILTER (k) AS kn, min(evidence_id) FILTER (k) AS km FROM t GROUP BY pair_id),
f AS (SELECT {_KIN.format(c='source')} AS fs, {_KIN.format(c='target')} AS ft, count(*) AS fn, min(evidence_id) AS fm FROM a GROUP BY ALL)
SELECT b.pair_id, CASE WHEN c AND kn > 0 THEN 'EXACT' WHEN c THEN 'PRIOR' WHEN n IS NOT NULL OR fn IS NOT NULL THEN 'RELATED' ELSE 'NONE' END AS tier, CASE WHEN c AND kn > 0 THEN kn ELSE coalesce(n, fn, 0) END AS records, CASE WHEN c AND kn > 0 THEN km ELSE coalesce(m, fm) END AS first_evidence
FROM b LEFT JOIN n USING (pair_id) LEFT JOIN f ON fs = {_KIN.format(c='b.source')} AND ft = {_KIN.format(c='b.target')}""")
def registry_match(spark, d):
    p, s, t, k = X.table(spark, d, "part"), F.col("p_size") % 7, F.col("p_partkey") % 5, F.col("p_partkey")
    source = F.when(s == 0, "qwen3-4b").when(s == 1, "Qwen/Qwen3-Embedding-4B").when(s == 2, "MiniLM-L6").otherwise(F.concat(F.lit("own-"), s.cast("string")))
    target = F.when(t == 0, "QWEN3_8B").when(t == 1, "my-qwen3-tuned").otherwise(F.concat(F.lit("model-"), t.cast("string")))
    r = p.select(
        k.alias("evidence_id"), source.alias("source"), target.alias("target"), F.when(s == 4, F.col("p_type")).otherwise(F.concat(F.lit("fp"), F.expr("p_size % 7 div 2").cast("string"))).alias("source_fp"), F.concat(F.lit("fp"), t.cast("string")).alias("target_fp"),
        F.when(k % 3 > 0, F.col("p_brand")).alias("corpus_fp"), F.concat(F.lit("set"), (k % 4).cast("string")).alias("corpus_name"), F.col("p_size").cast("long").alias("corpus_size"), (k % 2 == 0).alias("canonical"),
    )
    k = F.col("evidence_id")
    w = r.select(
        k.alias("pair_id"), F.when(k % 6 == 5, "all-minilm-x").when(k % 11 == 3, "unheard").otherwise(F.col("source")).alias("source"), "target", F.when(k % 4 != 1, F.col("source_fp")).alias("source_fp"), "target_fp",
        F.when(k % 2 == 0, F.col("corpus_fp")).otherwise("new").alias("corpus_fp"), "corpus_name", (F.col("corpus_size") + k % 2).alias("corpus_size"),
    )
    return planning.registry_match(w, r)


def _evidence(spark, d):
    u = F.col("p_partkey")
    gap = F.map_from_arrays(F.array(F.lit(10), F.lit(50), F.lit(200)), F.array(F.lit(0.05), (u % 3) / 100.0, F.lit(0.001)))
    cont = F.map_from_arrays(F.array(F.lit(10), F.when(u % 5 == 0, 70).otherwise(50)), F.array((u % 4) / 4.0, F.when(u % 6 == 0, 1.5).otherwise(0.5)))
    return X.table(spark, d, "part").select(
        u.alias("evidence_id"), gap.alias("candidate_gap"), cont.alias("containment"), F.when(u % 7 == 0, F.lit(None).cast("int")).when(u % 3 <= 1, 50).otherwise(200).alias("observed_depth"),
        F.sha2("p_name", 256).alias("recomputed"), F.when(u % 8 == 0, "x").otherwise(F.sha2("p_name", 256)).alias("fingerprint"),
    )


@query("""WITH e AS (SELECT p_partkey AS evidence_id, [10, 50, 200] AS gk, [0.05::DOUBLE, (p_partkey % 3) / 100.0::DOUBLE, 0.001] AS gv, [10, CASE WHEN p_partkey % 5 = 0 THEN 70 ELSE 50 END] AS ck, [(p_partkey % 4) / 4.0::DOUBLE, CASE WHEN p_partkey % 6 = 0 THEN 1.5 ELSE 0.5 END] AS cv,
 CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 <= 1 THEN 50 ELSE 200 END AS od, sha256(p_name) AS again, CASE WHEN p_partkey % 8 = 0 THEN 'x' ELSE sha256(p_name) END AS fp FROM part)
SELECT evidence_id, violation FROM e, (SELECT unnest(['fingerprint', 'observed_depth', 'depths', 'containment']) AS violation) WHERE CASE violation WHEN 'fingerprint' THEN fp <> again WHEN 'observed_depth' THEN list_min(list_transform(list_filter([1, 2, 3], lambda i: gv[i] <= 0.01), lambda i: gk[i])) IS DISTINCT FROM od
 WHEN 'depths' THEN len(list_filter(ck, lambda k: NOT list_contains(gk, k))) > 0 ELSE len(list_filter(cv, lambda c: c < 0 OR c > 1)) > 0 END""")
def evidence_violations(spark, d):
    return planning.evidence_violations(_evidence(spark, d))


@query("SELECT k, count(*) AS records FROM (SELECT p_partkey, unnest([10::BIGINT, 50, 200]) AS k FROM part) GROUP BY k")
def priority_depths(spark, d):
    return planning.priority_depths(_evidence(spark, d))


@query("""WITH x AS (SELECT p_partkey AS evidence_id, unnest([10::BIGINT, 50]) AS k, p_retailprice AS v FROM part), y AS (SELECT evidence_id, k, CASE evidence_id % 5 WHEN 3 THEN v * 1.001::DOUBLE WHEN 4 THEN v * (1 + 1e-12) ELSE v END AS r FROM x WHERE evidence_id % 5 <> 2)
SELECT evidence_id, k, CASE WHEN r IS NULL THEN 'missing' WHEN abs(v - r) <= greatest(1e-12, 1e-10 * greatest(abs(v), abs(r))) THEN 'match' ELSE 'differs' END AS status FROM x LEFT JOIN y USING (evidence_id, k)""")
def semantic_provenance(spark, d):
    p = X.table(spark, d, "part")
    x = p.select(F.col("p_partkey").alias("evidence_id"), F.explode(F.array(F.lit(10), F.lit(50))).alias("k"), F.col("p_retailprice").alias("value"))
    m = F.col("evidence_id") % 5
    kept = x.where(m != 2).withColumn("value", F.when(m == 3, F.col("value") * 1.001).when(m == 4, F.col("value") * (1 + 1e-12)).otherwise(F.col("value")))
    return planning.semantic_provenance(x, kept).select("evidence_id", "k", "status")


@query("SELECT count(*) AS records, count(DISTINCT p_partkey) AS distinct_ids, count(*) = max(p_partkey) AS count_ok, count(*) = count(DISTINCT p_partkey) AS unique_ok FROM part")
def registry_audit(spark, d):
    return planning.registry_audit(X.table(spark, d, "part").select(F.col("p_partkey").alias("evidence_id")), F.max("evidence_id"))


_FILES = """b AS (SELECT substr(p_brand, 7)::BIGINT AS b, sha256(string_agg(p_partkey || '|' || p_name || chr(10), '' ORDER BY p_partkey)) AS sha FROM part GROUP BY p_brand)"""


def _files(spark, d):
    """A manifest of a file for each brand, and the folder: some files are changed, not there, or not listed."""
    from vecshift.operators import provenance
    from vecshift.sources.snapshots import fresh

    p = X.table(spark, d, "part").select(F.substring("p_brand", 7, 9).cast("long").alias("b"), "p_partkey", F.concat_ws("|", "p_partkey", "p_name").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda r: F.concat(r["line"], F.lit("\n")))
    manifest = p.groupBy("b").agg(F.sha2(F.array_join(lines, ""), 256).alias("sha256"))
    manifest = manifest.where("b % 7 <> 3").select(F.col("b").cast("string").alias("name"), F.when(F.col("b") % 7 == 4, "?").otherwise(F.col("sha256")).alias("sha256"))
    path = fresh(spark, "evidence")
    kept = p.where("b % 7 <> 2").withColumn("line", F.when(F.col("b") % 7 == 1, F.upper("line")).otherwise(F.col("line")))
    kept.repartition("b").sortWithinPartitions("b", "p_partkey").select("b", "line").write.partitionBy("b").text(path)
    return manifest, provenance.folder(spark, path, "b=([0-9]+)/part-").where("name <> ''")


@query(f"WITH {_FILES} SELECT b::VARCHAR AS subject, CASE b % 7 WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' WHEN 3 THEN 'extra' ELSE 'no digest' END AS problem FROM b WHERE b % 7 IN (1, 2, 3, 4)")
def registry_files(spark, d):
    from vecshift.operators import provenance

    return provenance.file_violations(*_files(spark, d))


@query(f"WITH {_FILES}, c AS (SELECT p_partkey AS id, substr(p_brand, 7)::BIGINT AS b FROM part) SELECT id, CASE WHEN b % 7 IN (3, 4) THEN 'unstated' WHEN b % 7 = 2 OR id % 10 = 0 THEN 'not retained' WHEN b % 7 = 1 THEN 'changed' ELSE 'ok' END AS status FROM c")
def external_provenance(spark, d):
    """The artifact that each part names, against the retained files."""
    from vecshift.operators import provenance

    manifest, files = _files(spark, d)
    c = X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substring("p_brand", 7, 9).alias("name")).join(F.broadcast(manifest), "name", "left")
    artifact = F.when(F.col("id") % 10 == 0, F.concat("name", F.lit("/gone"))).otherwise(F.col("name"))
    sha = F.when(F.col("sha256") != "?", F.col("sha256"))
    return provenance.artifact_status(c.select("id", artifact.alias("artifact"), sha.alias("sha256")), files).select("id", "status")


_CELL_ROWS = "SELECT l_returnflag AS source, l_linestatus AS target, l_shipmode_ AS dataset, l_discount AS gap, l_tax <= 0.03 AS ci, l_quantity > 25 AS compatible, CASE WHEN l_discount <= 0.04 THEN 'safe' ELSE 'EXPAND' END AS prediction, l_quantity <= 25 AND l_discount <= 0.04 AS false_safe FROM (SELECT *, 'set' || (l_partkey % 5) AS l_shipmode_ FROM lineitem)"
_MEASURED = "count(*) {f} AS cells, count(*) FILTER (gap <= 0.01 {k}) AS point_estimate, count(*) FILTER (ci {k}) AS ci_certified, count(*) FILTER (compatible {k}) AS compatible, count(*) FILTER (upper(prediction) = 'SAFE' {k}) AS safe, count(*) FILTER (false_safe {k}) AS false_safe"


def _counted(scope: str) -> str:
    k = "AND dataset <> 'set1'" if scope == "kept" else ""
    f = "FILTER (dataset <> 'set1')" if k else ""
    return f"SELECT coalesce(source || '->' || target, source, '') AS grp, '{scope}' AS scope, {_MEASURED.format(f=f, k=k)} FROM x GROUP BY GROUPING SETS ((), (source, target), (source))"


@query(f"""WITH x AS ({_CELL_ROWS}), c AS ({_counted("all")} UNION ALL {_counted("kept")}), u AS (UNPIVOT c ON cells, point_estimate, ci_certified, compatible, safe, false_safe INTO NAME measure VALUE value)
SELECT grp, measure, scope, value AS stated, value - CASE WHEN grp LIKE 'A%' AND measure = 'safe' THEN 1 ELSE 0 END AS value, CASE WHEN grp LIKE 'A%' AND measure = 'safe' THEN 'differs' ELSE 'match' END AS status
FROM (SELECT grp, measure, scope, value + CASE WHEN grp LIKE 'A%' AND measure = 'safe' THEN 1 ELSE 0 END AS value FROM u)
UNION ALL SELECT 'Z', 'cells', 'all', 7, NULL, 'underived'""")
def count_provenance(spark, d):
    """Counts that a registry states for its retained cells, over all, by source, and by source and target, derived again from the cells.
    The statements are counted one by one; some are wrong, and one is of a group without cells."""
    from vecshift.operators import provenance

    l = X.table(spark, d, "lineitem")  # noqa: E741
    safe, ok = F.col("l_discount") <= 0.04, F.col("l_quantity") > 25
    rows = l.select(
        F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"), F.concat(F.lit("set"), (F.col("l_partkey") % 5).cast("string")).alias("dataset"), F.col("l_discount").alias("gap"),
        (F.col("l_tax") <= 0.03).alias("ci"), ok.alias("compatible"), F.when(safe, "safe").otherwise("EXPAND").alias("prediction"), (~ok & safe).alias("false_safe"),
    )
    held = {"cells": F.lit(True), "point_estimate": F.col("gap") <= 0.01, "ci_certified": F.col("ci"), "compatible": F.col("compatible"), "safe": F.col("prediction") == "safe", "false_safe": F.col("false_safe")}
    facts = [F.struct(F.lit(m).alias("measure"), F.lit(s).alias("scope"), (h if s == "all" else h & (F.col("dataset") != "set1")).alias("held")) for m, h in held.items() for s in ("all", "kept")]
    one = rows.withColumn("f", F.explode(F.array(*facts))).withColumn("grp", F.explode(F.array(F.lit(""), F.col("source"), F.concat_ws("->", "source", "target"))))
    claims = one.groupBy("grp", F.col("f.measure").alias("measure"), F.col("f.scope").alias("scope")).agg(F.count_if(F.col("f.held")).alias("stated"))
    wrong = F.col("grp").startswith("A") & (F.col("measure") == "safe")
    claims = claims.withColumn("stated", F.col("stated") + F.when(wrong, 1).otherwise(0))
    claims = claims.unionByName(spark.range(1).select(F.lit("Z").alias("grp"), F.lit("cells").alias("measure"), F.lit("all").alias("scope"), F.lit(7).cast("long").alias("stated")))
    return provenance.count_provenance(claims, provenance.derived_counts(rows, [["source"], ["source", "target"]], F.col("dataset") == "set1"))


@query("""SELECT p_partkey, sha256('{"dimension":' || p_size || ',"model_id":"' || p_name || '","revision":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || '}') AS fingerprint FROM part""")
def contract_fingerprint(spark, d):
    p = X.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("model_id"), F.col("p_size").alias("dimension"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("revision"))
    return p.select("p_partkey", planning.contract_fingerprint(["model_id", "revision", "dimension"]).alias("fingerprint"))


@query("SELECT doc_id, sha256(text) AS content, sha256(lang || '|' || source || '|' || n_chars) AS config FROM documents")
def content_fingerprint(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content"), S.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars")).alias("config"))


@query("SELECT event_id, n * CASE u WHEN 'm' THEN 60 WHEN 'H' THEN 3600 WHEN 'd' THEN 86400 WHEN 'W' THEN 604800 WHEN 'x' THEN NULL ELSE 1 END::DOUBLE AS seconds, lower(event_type) LIKE 'p%' AS is_p FROM (SELECT event_id, event_type, (event_id % 50) AS n, ['s', 'm', 'H', 'd', 'W', '', 'x'][event_id % 7 + 1] AS u FROM events)")
def duration_parse(spark, d):
    e = X.table(spark, d, "events")
    unit = F.element_at(F.array(*map(F.lit, ["s", "m", "H", "d", "W", "", "x"])), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", S.seconds(F.concat((F.col("event_id") % 50).cast("string"), unit)).alias("seconds"), F.lower("event_type").startswith("p").alias("is_p"))


@query(r"""SELECT doc_id, left(regexp_replace(regexp_replace('password=p' || doc_id || ' bearer x Api-Key=k' || doc_id || ',pg://u:s3cret@h/' || lang || ' ' || coalesce(text, ''),
 '(?i)(api[_-]?key|token|password|secret)=([^\s,;]+)', '\1=<redacted>', 'g'), '(?i)(://[^:/\s]+:)[^@/\s]+(@)', '\1<redacted>\2', 'g'), 2000) AS clean FROM documents""")
def secret_redaction(spark, d):
    """Documents behind a line of secrets, redacted and cut."""
    x, i = X.table(spark, d, "documents"), F.col("doc_id").cast("string")
    text = F.concat(F.lit("password=p"), i, F.lit(" bearer x Api-Key=k"), i, F.lit(",pg://u:s3cret@h/"), F.col("lang"), F.lit(" "), F.coalesce("text", F.lit("")))
    return x.select("doc_id", S.redact(text).alias("clean"))


# ------------------------------------------------------------------ encoders and digests


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), h AS (SELECT doc_id, ('0x' || substr(sha256(t), 1, 8))::BIGINT % 16 AS slot, CASE WHEN ('0x' || substr(sha256(t), 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END AS s FROM t),
w AS (SELECT doc_id, slot, sum(s)::BIGINT AS w FROM h GROUP BY ALL HAVING sum(s) <> 0) SELECT doc_id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w""")
def feature_hash_embedding(spark, d):
    return encoders.feature_hash(X.table(spark, d, "documents"))


@query()
def hash_embedding_rows(spark, d):
    """Seeded Gaussian token embeddings of all documents."""
    return encoders.encode(X.table(spark, d, "documents").select("doc_id", "text"), encoders.HashModel())


# ------------------------------------------------------------------ stored index

_CELLS = f"""{X.EMB}, l AS (SELECT label, i, round(avg(v[i]), 9) AS x FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, list(x ORDER BY i) AS cv FROM l GROUP BY label),
n AS (SELECT doc_id, v, cell FROM d, c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(list_cosine_similarity(v, cv), 9) DESC, cell) = 1)"""


def _label_index(spark, d):
    """An index whose cells are the labels' mean vectors, of all vectors, in two versions: built from most of them, the rest appended."""
    from vecshift.sources.index import VectorIndex
    from vecshift.sources.snapshots import fresh

    e = X.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    centroids = np.array([[p.x for p in r.c] for r in mean.orderBy("label").collect()])  # a row for each label
    later = F.col("doc_id") % 5 == 3
    ix = VectorIndex.build(X.corpus(spark, d).where(~later), fresh(spark, "index"), "cosine", probes=3, centroids=centroids)
    return ix.append(X.corpus(spark, d).where(later))


@query(f"WITH {_CELLS} SELECT cell, count(*) AS vectors, count(*) AS stated, min(doc_id) AS smallest, max(doc_id) AS largest, sum(doc_id)::BIGINT AS ids, 2 AS version FROM n GROUP BY cell")
def index_cells(spark, d):
    """What lies in each cell of a stored index after an append, and what its manifest says."""
    ix = _label_index(spark, d)
    stored = ix.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"), F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.sum("doc_id").alias("ids"))
    return stored.join(F.broadcast(ix.counts().withColumnRenamed("vectors", "stated")), "cell").withColumn("version", F.lit(ix.version))


@query(f"""WITH {_CELLS}, w AS (SELECT query_id, cell FROM q, c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, cv), 9) DESC, cell) <= 3)
SELECT query_id, doc_id, round(list_cosine_similarity(q.v, n.v), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM q JOIN w USING (query_id) JOIN n USING (cell) QUALIFY rank < 10""")
def index_search(spark, d):
    """Ten nearest vectors out of the three cells nearest each query, from a stored index."""
    return _label_index(spark, d).search(X.queries(spark, d), 10)


@query(f"""WITH {_CELLS}, w AS (SELECT query_id, cell FROM q, c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, cv), 9) DESC, cell) <= 3),
g AS (SELECT query_id, doc_id FROM q JOIN w USING (query_id) JOIN n USING (cell) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, n.v), 9) DESC, doc_id) <= 10),
x AS (SELECT query_id, doc_id FROM q, d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, d.v), 9) DESC, doc_id) <= 10),
o AS (SELECT x.query_id, count(g.doc_id) / count(*) AS overlap FROM x LEFT JOIN g USING (query_id, doc_id) GROUP BY x.query_id),
f AS (SELECT round(avg(overlap), 9) AS fidelity, count(*) AS queries FROM o) SELECT *, CASE WHEN queries = 0 THEN 'UNKNOWN' WHEN fidelity >= 0.95 THEN 'PASS' ELSE 'WARNING' END AS status FROM f""")
def index_recall_audit(spark, d):
    """How much of the exact ten nearest a stored index finds in the three cells nearest each query."""
    found = _label_index(spark, d).search(X.queries(spark, d), 10)
    return retrieval.fidelity(found, X.native(spark, d, 10), 10)


# ------------------------------------------------------------------ serving


def _round_sql(n: int, have: str, budget: int = 4) -> str:
    """SQL of round n, before which the documents of `have` have vectors; e<n> are those encoded in it."""
    return f"""m{n} AS (SELECT c.*, t.doc_id IS NOT NULL AS has, h.doc_id IS NOT NULL AS hit, sum(CASE WHEN h.doc_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY source_rank) AS turn FROM cand c LEFT JOIN txt t USING (doc_id) LEFT JOIN {have} h USING (doc_id)),
e{n} AS (SELECT DISTINCT doc_id FROM m{n} WHERE has AND NOT hit AND turn <= {budget}),
a{n} AS (SELECT {n} AS round, query_id, doc_id, source_rank, CASE WHEN hit THEN 'cached' WHEN e.doc_id IS NULL THEN 'queued' WHEN turn <= {budget} THEN 'encoded' ELSE 'shared' END AS action FROM m{n} LEFT JOIN e{n} e USING (doc_id))"""


_ROUNDS = f"""WITH {X.EMB}, cand AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, d.v), 9) DESC, doc_id) - 1 AS source_rank FROM q CROSS JOIN d QUALIFY source_rank < 20),
txt AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM txt WHERE doc_id IN (SELECT doc_id FROM d)) GROUP BY ALL),
w AS (SELECT doc_id, ('0x' || substr(sha256(t), 1, 8))::BIGINT % 16 AS slot, sum(CASE WHEN substr(sha256(t), 9, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN n ELSE -n END)::DOUBLE AS w FROM tok GROUP BY ALL),
u AS (SELECT doc_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w WHERE w <> 0),
sc AS (SELECT query_id, c.doc_id, round(coalesce(sum(a.w * b.w), 0), 9) + 0.0::DOUBLE AS score FROM cand c LEFT JOIN u a ON a.doc_id = query_id LEFT JOIN u b ON b.doc_id = c.doc_id AND a.slot = b.slot GROUP BY ALL),
none AS (SELECT doc_id FROM txt WHERE false),
{_round_sql(1, "none")}, {_round_sql(2, "e1")},
drained AS (SELECT doc_id FROM e1 UNION SELECT doc_id FROM e2 UNION SELECT doc_id FROM a1 JOIN txt USING (doc_id)),
{_round_sql(3, "drained")},
r AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3),
s AS (SELECT r.*, count(*) FILTER (action <> 'queued') OVER b AS have, count(*) OVER b AS n, CASE WHEN action <> 'queued' AND has_query THEN score END AS score FROM r JOIN sc USING (query_id, doc_id) JOIN (SELECT query_id, true AS has_query FROM q) USING (query_id) WINDOW b AS (PARTITION BY round, query_id)),
f AS (SELECT *, CASE WHEN have = n THEN 'WARM' WHEN have > 0 THEN 'PARTIAL' ELSE 'COLD' END AS state FROM s)
SELECT round, query_id, doc_id, source_rank, action, state, score, CASE WHEN action <> 'queued' OR state = 'COLD' THEN row_number() OVER (PARTITION BY round, query_id ORDER BY score DESC NULLS LAST, source_rank) END AS position FROM f"""


@query(_ROUNDS)
def search_rounds(spark, d):
    """Three search rounds of all queries with a budget of four documents each; before the third the queue is drained. The new space is
    the feature hash of the documents' texts; vectors without a document can't be encoded."""
    from vecshift.operators.serving import TargetStore
    from vecshift.sources.snapshots import fresh, written

    store = TargetStore(spark, fresh(spark, "store"), encoders.FeatureHashModel())
    c, q = X.corpus(spark, d), X.queries(spark, d)
    docs = written(X.table(spark, d, "documents").select("doc_id", "text").join(c.select("doc_id"), "doc_id", "left_semi"), "documents")
    texts = q.select("query_id").join(docs.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    target = encoders.encode(texts, store.model, "query_id")
    top = written(retrieval.topk(c, q, 20).select("query_id", "doc_id", F.col("rank").alias("source_rank")), "candidates")
    out = []
    for i in (1, 2, 3):
        if i == 3:
            store.drain(docs)
        r = store.search(top, target, docs, 4).hits
        out.append(r.select(F.lit(i).alias("round"), "query_id", "doc_id", "source_rank", "action", "state", (F.col("score") + 0.0).alias("score"), "position"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH h AS (SELECT sha256(doc_id::VARCHAR || chr(31) || text) AS h FROM documents), l AS (SELECT substr(h, 1, 6) AS l, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1), p AS (SELECT substr(l, 1, 3) AS b, sha256(string_agg(d, '' ORDER BY l)) AS d, sum(n) AS n FROM l GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest, sum(n)::BIGINT AS "rows" FROM p""")
def dataset_digest(spark, d):
    return planning.dataset_digest(X.table(spark, d, "documents"), "doc_id", "text")


@query()
def ordered_dataset_fingerprint(spark, d):
    """Order-sensitive rolling digest of the documents in id order."""
    return planning.rolling_digest(X.table(spark, d, "documents"), "doc_id", "text", "lang")
