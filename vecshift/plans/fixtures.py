"""How the test tables stand in for the engine's inputs.

`embeddings` is the corpus in the target space; its leading `s` dimensions are the source space. Queries are the rows
whose vec_id is divisible by 20, against all rows (each query's own row stays in the pool). Relevance is an equal label.
`events` is the traffic log: user_id names a document, value a latency, event_type a status. `documents` are texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshift.functions.scalar import epoch, sampled
from vecshift.operators import quality, retrieval
from vecshift.sources.readers import vectors
from vecshift.sources.snapshots import written

SEED, RATE, DEPTH = 42, 0.5, 500


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d) -> DataFrame:
    return vectors(spark, f"{d}/embeddings.parquet")


def queries(spark, d) -> DataFrame:
    return corpus(spark, d).where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def cut(df: DataFrame, s: int) -> DataFrame:
    return df.withColumn("v", F.slice("v", 1, s))


def candidates(spark, d, s: int = 16, k: int = DEPTH) -> DataFrame:
    """query_id, doc_id, source_rank, target_score; written once, as most queries read it in several branches."""
    c, q = corpus(spark, d), queries(spark, d)
    top = retrieval.topk(cut(c, s), cut(q, s), k).select("query_id", "doc_id", F.col("rank").alias("source_rank"))
    return written(retrieval.pair_scores(top, q, c), "candidates")


def native(spark, d, k: int = DEPTH) -> DataFrame:
    return written(retrieval.topk(corpus(spark, d), queries(spark, d), k), "native")


def qrels(spark, d) -> quality.LabelQrels:
    """Graded relevance: an equal label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return quality.LabelQrels(e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), e)


def traffic(spark, d) -> DataFrame:
    """fp, document_id, query_id, at, miss, latency_ms, status."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "timeout").otherwise("completed")
    return e.select(
        F.concat(F.lit("cfg"), (F.col("user_id") % 2).cast("string")).alias("fp"), F.col("user_id").alias("document_id"), F.col("event_id").alias("query_id"), "ts", epoch("ts").alias("at"),
        (F.col("event_type") == "error").alias("miss"), F.col("value").alias("latency_ms"), status.alias("status"), "event_type",
    )


def warm(spark, d) -> DataFrame:
    """Documents whose target vectors are cached."""
    return traffic(spark, d).select("document_id").distinct().where(sampled(SEED, F.col("document_id"), RATE))


#: SQL of the same fixtures.
EMB = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT vec_id AS query_id, v, label AS ql FROM e WHERE vec_id % 20 = 0),
d AS (SELECT vec_id AS doc_id, v, label AS dl FROM e)"""


def cand_sql(s: int = 16, k: int = DEPTH) -> str:
    return f"""{EMB},
sp AS (SELECT query_id, doc_id, round(list_cosine_similarity(q.v[1:{s}], d.v[1:{s}]), 9) AS source_score, round(list_cosine_similarity(q.v, d.v), 9) AS target_score FROM q CROSS JOIN d),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_score DESC, doc_id) - 1 AS source_rank, row_number() OVER (PARTITION BY query_id ORDER BY target_score DESC, doc_id) - 1 AS native_rank FROM sp),
cand AS (SELECT query_id, doc_id, source_rank, target_score FROM sr WHERE source_rank < {k}),
nat AS (SELECT query_id, doc_id, native_rank AS rank FROM sr WHERE native_rank < {k}),
qr AS (SELECT query_id, doc_id, 1 AS relevance FROM q JOIN d ON ql = dl),
ks AS (SELECT unnest([10, 20, 50, 100, 200, 500])::BIGINT AS k),
pre AS (SELECT k, query_id, doc_id, source_rank, target_score, row_number() OVER (PARTITION BY k, query_id ORDER BY target_score DESC, source_rank) AS pos FROM cand JOIN ks ON source_rank < k),
ideal AS (SELECT query_id, sum(1.0 / log2(p + 1)) AS ideal FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS p FROM qr) WHERE p <= 10 GROUP BY query_id)"""


HASHED = "('0x' || substr(sha256('42:' || {c}::VARCHAR), 1, 16))::UBIGINT < {t}::UBIGINT"
TRAFFIC = f"""tr AS (SELECT 'cfg' || (user_id % 2) AS fp, user_id AS document_id, event_id AS query_id, ts, epoch_us(ts) / 1e6 AS "at", event_type = 'error' AS miss, value AS latency_ms,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'timeout' ELSE 'completed' END AS status, event_type FROM events),
warm AS (SELECT DISTINCT document_id FROM tr WHERE {HASHED.format(c='document_id', t=int(RATE * (1 << 64)))}),
occ AS (SELECT document_id, count(*) AS occurrences FROM tr GROUP BY ALL)"""
