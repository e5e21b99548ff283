"""Readers and writers. Every reader has a fixed schema; strict ones fail on the first bad row when the result is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENTS = "id string, text string"
QUERIES = "id string, query_id string, text string, query string"
STAGE_FIELDS = "source_encode_ms double, ann_ms double, target_encode_ms double, lookup_ms double, sync_encode_ms double, score_ms double, topk_ms double, total_ms double"


def strict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df, whose use fails with the check's name on the first row that breaks it (evaluated in the scan, no extra job)."""
    fail = F.lit(None).cast("string")
    for name, ok in checks.items():
        fail = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(fail)
    return df.where(F.when(fail.isNotNull(), F.raise_error(fail).cast("boolean")).otherwise(True))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def documents(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text", unique: bool = True) -> DataFrame:
    """doc_id, text from JSON lines. Bad JSON, missing or blank ids and texts, repeated ids, and an empty file are errors."""
    raw = spark.read.schema(f"`{id_field}` string, `{text_field}` string").option("mode", "FAILFAST").json(path)
    x = strict(raw.select(F.col(id_field).alias("doc_id"), F.col(text_field).alias("text")), {"blank text": F.length(F.trim("text")) > 0, "missing id": F.length(F.trim("doc_id")) > 0})
    if unique:
        if x.limit(1).count() == 0:
            raise ValueError(f"no documents in {path}")
        if twice := duplicates(x, "doc_id").limit(5).collect():
            raise ValueError(f"repeated ids: {[r.doc_id for r in twice]}")
    return x


def queries(spark: SparkSession, path: str, text_first: bool = True) -> DataFrame:
    """query_id, text, position. The id is id, query_id or the line number; the text is text or query (or the other way)."""
    raw = spark.read.schema(QUERIES).option("mode", "FAILFAST").json(path)
    order = F.monotonically_increasing_id()  # grows with the place in the file
    x = raw.withColumn("position", order)
    line = F.row_number().over(Window.orderBy("position"))  # query sets are small next to the corpus
    names = ("text", "query") if text_first else ("query", "text")
    x = x.select(F.coalesce("id", "query_id", line.cast("string")).alias("query_id"), F.coalesce(*names).alias("text"), "position")
    return strict(x, {"blank query": F.length(F.trim("text")) > 0})


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance from one nested JSON object {query: {doc: grade}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    x = raw.select(F.explode("m").alias("query_id", "d")).select("query_id", F.explode("d").alias("doc_id", "relevance"))
    r = F.col("relevance")
    return strict(x, {"invalid relevance": (r >= 0) & (r == F.floor(r))}).withColumn("relevance", r.cast("int"))


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, rank from JSON lines {id, ranked_ids | ranking | results}; items are ids or objects with an id."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    j = lambda p: F.get_json_object("value", p)
    lists = F.coalesce(j("$.ranked_ids"), j("$.ranking"), j("$.results"))
    items = F.from_json(lists, "array<string>")
    one = F.coalesce(F.get_json_object("item", "$.id"), F.col("item"))
    return raw.select(F.coalesce(j("$.id"), j("$.query_id")).alias("query_id"), F.posexplode(items).alias("rank", "item")).select("query_id", one.alias("doc_id"), "rank")


def access_trace(spark: SparkSession, path: str) -> DataFrame:
    """document_id, count; a missing count is 1, counts below 1 are errors."""
    raw = spark.read.schema("document_id string, count long").option("mode", "FAILFAST").json(path)
    x = raw.select("document_id", F.coalesce("count", F.lit(1)).alias("count"))
    return strict(x, {"count below 1": F.col("count") >= 1, "missing id": F.length("document_id") > 0}).groupBy("document_id").agg(F.sum("count").alias("count"))


def latency_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The log's good rows, and one row with the number of bad lines (tolerant: bad lines are counted, not fatal)."""
    schema = f"mode string, k int, nprobe int, {STAGE_FIELDS}, candidate_ids array<string>, _bad string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    return raw.where("_bad IS NULL").drop("_bad"), raw.agg(F.count("_bad").alias("bad_lines"), F.count(F.lit(1)).alias("lines"))


def registry(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.json(path).orderBy(key)


def vectors(spark: SparkSession, path: str, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """doc_id, v (doubles) from a Parquet index."""
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(column).cast("array<double>").alias("v"))


def write_index(df: DataFrame, path: str, cells: str | None = None) -> None:
    """A vector index as Parquet; partitioned by its coarse cell where it has one, so that probes prune partitions."""
    w = df.write.mode("overwrite")
    (w.partitionBy(cells) if cells else w).parquet(path)


def write_shard(df: DataFrame, path: str) -> None:
    """An embedding shard: float32 vectors with a checksum each; the commit protocol makes it appear as a whole."""
    v = F.transform("v", lambda x: x.cast("float"))
    df.select("doc_id", v.alias("v")).withColumn("checksum", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)).write.mode("errorifexists").parquet(path)


def read_shard(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.parquet(path)
    same = F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256) == F.col("checksum")
    return strict(x, {"checksum mismatch": same}).drop("checksum")


def fetch(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a store by id; ids that it does not have are an error."""
    x = ids.join(store.withColumn("__there", F.lit(True)), key, "left")
    return strict(x, {"missing document": F.coalesce("__there", F.lit(False))}).drop("__there")


def jdbc_vectors(spark: SparkSession, url: str, table: str, key: str, vector: str, page: int = 1_000_000, **options) -> DataFrame:
    """doc_id, v from a relational store with a vector type, a page of the key a task; null ids and vectors are left out."""
    from vecshift.sources.jdbc import JdbcStore

    r = JdbcStore(spark, url, table, key, vector, **options).rows([f"CAST({vector} AS text) AS v"], page)
    return r.where("v IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.from_json("v", "array<double>").alias("v"))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report table as Markdown; a report is small, and one of more than `most` rows is an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write the table with write_report instead")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
