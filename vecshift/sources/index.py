"""A stored vector index: vectors by coarse cell in a versioned table, with centroids, metric and counts in its manifest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshift.functions.scalar import METRICS, norm, vector_ok
from vecshift.operators import retrieval

from .snapshots import Conflict, Snapshots

SCHEMA = "doc_id long, v array<double>, cell int"
#: Metrics an index can have; distances are for searches without one.
INDEX_METRICS = ("cosine", "dot")


def faults(corpus: DataFrame, metric: str, dimension: int) -> DataFrame:
    """One row: vectors, and how many have no id, a wrong dimension or a component that isn't finite, or (for cosine) no length."""
    fine = vector_ok("v", dimension)
    zero = fine & (norm("v") <= 1e-12) if metric == "cosine" else F.lit(False)
    return corpus.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("doc_id").isNull()).alias("null_ids"), F.count_if(~fine).alias("bad_vectors"), F.count_if(zero).alias("zero_vectors"))


class VectorIndex:
    """Build, append, load, search. Rows (doc_id, v) with distinct ids; vectors are kept at unit length for cosine. With `cells`, and
    at least 39 and four times as many vectors, they lie in that many cells, of which a search reads those nearest its queries;
    without, in one cell, and search is exact. Every change is a new version; an older one can still be loaded."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.store = Snapshots(spark, path, SCHEMA, "cell")
        m = self.store.manifest(version)
        if not m["version"]:
            raise FileNotFoundError(f"no index in {path}")
        self.spark, self.path, self.version, self.meta = spark, path, m["version"], m["notes"]
        self._centroids = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str | None = None, dimension: int | None = None, version: int | None = None) -> VectorIndex:
        """The stored index; another metric or dimension than expected is an error."""
        out = cls(spark, path, version)
        if metric is not None and METRICS.get(metric.lower()) != out.meta["metric"]:
            raise ValueError(f"the index has metric {out.meta['metric']}, not {metric}")
        if dimension is not None and dimension != out.meta["dimension"]:
            raise ValueError(f"the index has dimension {out.meta['dimension']}, not {dimension}")
        return out

    @classmethod
    def build(cls, corpus: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, probes: int = 64, centroids: np.ndarray | None = None) -> VectorIndex:
        """centroids: given ones (a matrix) instead of trained ones."""
        kind = METRICS.get(metric.lower())
        if kind not in INDEX_METRICS:
            raise ValueError(f"an index has metric cosine or dot, not {metric}")
        for name, n in (("cells", cells), ("probes", probes)):
            if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 1):
                raise ValueError(f"{name} must be a positive integer")
        spark = corpus.sparkSession
        head = corpus.where("v IS NOT NULL").select(F.size("v").alias("n")).first()
        if head is None or head.n < 1:
            raise ValueError("an index needs vectors")
        store = Snapshots(spark, path, SCHEMA, "cell")
        if store.versions():
            raise FileExistsError(f"there is an index in {path}; append to it, or build elsewhere")
        rows, size = _checked(corpus, kind, head.n)
        if centroids is None:
            n = retrieval.ivf_cells(size, cells)
            centroids = retrieval.ivf_train(rows, n) if n else np.ones((1, head.n))
        where = f"{store.path}/centroids"
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, v array<double>").coalesce(1).write.parquet(where)
        notes = {"format": 1, "metric": kind, "dimension": head.n, "cells": len(centroids), "probes": min(probes, len(centroids)), "size": 0, "counts": {}}
        _append(store, rows, centroids, lambda m: m["notes"] or notes)
        return cls(spark, path)

    @property
    def centroids(self) -> np.ndarray:
        if self._centroids is None:
            rows = self.spark.read.schema("cell int, v array<double>").parquet(f"{self.store.path}/centroids").orderBy("cell").collect()  # as many as cells
            self._centroids = np.array([r.v for r in rows])
        return self._centroids

    def rows(self) -> DataFrame:
        """doc_id, v, cell of this version."""
        return self.store.read(self.version)

    def append(self, corpus: DataFrame) -> VectorIndex:
        """The index with these vectors too, in the cells it has. Ids that it holds are an error; so is an append by somebody else while
        this one was being checked."""
        rows, _ = _checked(corpus, self.meta["metric"], self.meta["dimension"])
        held = self.rows().select("doc_id").join(rows.select("doc_id"), "doc_id", "left_semi").limit(5).collect()
        if held:
            raise ValueError(f"ids that the index has: {[r.doc_id for r in held]}")

        def notes(m: dict) -> dict:
            if m["version"] != self.version:
                raise Conflict(f"the index is at version {m['version']}, this append was checked against {self.version}")
            return m["notes"]

        _append(self.store, rows, self.centroids, notes)
        return VectorIndex(self.spark, self.path)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of queries (query_id, v) of the index's dimension; a vector that is none, or has no length, is an
        error where it is used."""
        dim, zero = self.meta["dimension"], norm("v") <= 1e-12
        bad = ~vector_ok("v", dim) | (zero if self.meta["metric"] == "cosine" else F.lit(False))
        queries = queries.where(F.when(bad, F.raise_error(F.concat(F.lit("invalid query vector of "), F.col("query_id").cast("string"))).cast("boolean")).otherwise(True))
        if self.meta["cells"] == 1:
            return retrieval.topk(self.rows(), queries, k, self.meta["metric"])
        probes = min(probes or self.meta["probes"], self.meta["cells"])
        return retrieval.ivf_search(self.rows(), queries, k, self.meta["cells"], probes, self.centroids, self.meta["metric"])

    def counts(self) -> DataFrame:
        """cell, vectors, as the manifest has them."""
        return self.spark.createDataFrame([(int(c), n) for c, n in self.meta["counts"].items()], "cell int, vectors long")

    def audit(self) -> DataFrame:
        """Cells whose vectors are not as many as the manifest says, or lie in another cell than the one nearest to them: cell, stated,
        stored, misplaced."""
        placed = retrieval.ivf_assign(self.rows().select(F.struct("doc_id", "cell").alias("doc"), "v"), self.centroids).select("doc.cell", F.col("cell").alias("nearest"))
        stored = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("nearest") != F.col("cell")).alias("misplaced"))
        x = self.counts().withColumnRenamed("vectors", "stated").join(stored, "cell", "full").fillna(0)
        return x.where("stated <> stored OR misplaced > 0")


def _checked(corpus: DataFrame, metric: str, dimension: int) -> tuple[DataFrame, int]:
    """Rows fit for an index, of unit length for cosine, and their number."""
    rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("v").cast("array<double>").alias("v"))
    f = faults(rows, metric, dimension).first()
    wrong = {k: n for k, n in f.asDict().items() if k != "vectors" and n}
    if wrong or not f.vectors:
        raise ValueError(f"vectors that an index of dimension {dimension} can't hold: {wrong}" if wrong else "no vectors")
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated ids: {[r.doc_id for r in twice]}")
    if metric == "cosine":
        rows = rows.withColumn("__n", norm("v")).select("doc_id", F.expr("transform(v, x -> x / __n)").alias("v"))
    return rows, f.vectors


def _append(store: Snapshots, rows: DataFrame, centroids: np.ndarray, notes) -> int:
    # one file for each small cell and several for a large one: Spark evens the partitions out by size
    part = store.write(retrieval.ivf_assign(rows, centroids).hint("rebalance", F.col("cell")))
    added = store.parts([part]).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as cells, from file footers

    def counted(m: dict) -> dict:
        old = notes(m)
        counts = {int(c): n for c, n in old["counts"].items()}
        for r in added:
            counts[r.cell] = counts.get(r.cell, 0) + r.n
        return {**old, "size": sum(counts.values()), "counts": dict(sorted(counts.items()))}

    return store.add(part, counted)
