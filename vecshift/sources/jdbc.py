"""Vectors and texts in a relational store, over JDBC: searched there, read in even ranges of the key, fetched by id."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecshift.functions.scalar import METRICS

#: Distance operators of PostgreSQL's vector type (fixed values).
OPERATORS = {"cosine": "<=>", "dot": "<#>", "l2": "<->"}


def pgvector(metric: str) -> Callable[[str, list[float]], str]:
    """SQL of the distance of a vector column from a query."""
    return lambda column, q: f"{column} {OPERATORS[metric]} '[{','.join(map(repr, q))}]'::vector"


class JdbcStore:
    """A table with a key and a vector or a text column; names may be quoted. Rows without a key are left out, a repeated key is an error where it is seen.

    distance: a function that gives the SQL of a distance (smaller is nearer); `score` turns it into a number where larger is better."""

    def __init__(self, spark: SparkSession, url: str, table: str, key: str, vector: str | None = None, text: str | None = None, metric: str = "cosine", distance: Callable[[str, list[float]], str] | None = None, score: Callable[[Column], Column] | None = None, **options):
        for name in filter(None, (table, key, vector, text)):
            if not re.fullmatch(r'([A-Za-z_]\w*|"[^"]+")(\.([A-Za-z_]\w*|"[^"]+"))?', name):
                raise ValueError(f"not a name of a table or column: {name}")
        self.spark, self.url, self.table, self.key, self.vector, self.text, self.options = spark, url, table, key, vector, text, options
        self.metric = METRICS[metric.lower()]
        self.distance = distance or pgvector(self.metric)
        self.score = score or (lambda d: 1 - d if self.metric == "cosine" else -d)

    def _query(self, sql: str) -> DataFrame:
        x = self.spark.read.format("jdbc").options(url=self.url, dbtable=f"({sql}) q", **self.options).load()
        return x.toDF(*[c.lower() for c in x.columns])

    def size(self) -> int:
        return int(self._query(f"SELECT COUNT(*) AS n FROM {self.table}").first()[0])

    @staticmethod
    def _literal(x) -> str:
        return repr(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    def pages(self, rows: int) -> list:
        """The last key of every page of so many rows, in key order. One query a page, each of which skips to where the last one ended and
        gives one key; so pages are even however the keys are spread."""
        if rows < 1:
            raise ValueError("a page has one row at least")
        out: list = []
        while True:
            after = f" AND {self.key} > {self._literal(out[-1])}" if out else ""
            page = f"SELECT {self.key} AS k FROM {self.table} WHERE {self.key} IS NOT NULL{after} ORDER BY {self.key} FETCH FIRST {rows} ROWS ONLY"
            last = self._query(f"SELECT MAX(k) AS k FROM ({page}) p").first()[0]
            if last is None:
                return out
            out.append(last)

    def rows(self, columns: list[str] | None = None, page: int = 1_000_000) -> DataFrame:
        """The table, a page a task: key as doc_id, and the columns."""
        ends = self.pages(page)
        names = [self.key, *(columns if columns is not None else filter(None, (self.vector, self.text)))]
        sql = ", ".join([f"{names[0]} AS doc_id", *names[1:]])
        if not ends:
            return self._query(f"SELECT {sql} FROM {self.table} WHERE {self.key} IS NOT NULL")
        lows = [None, *ends[:-1]]
        where = [f"doc_id <= {self._literal(b)}" + (f" AND doc_id > {self._literal(a)}" if a is not None else "") for a, b in zip(lows, ends, strict=True)]
        x = self.spark.read.jdbc(self.url, f"(SELECT {sql} FROM {self.table} WHERE {self.key} IS NOT NULL) q", predicates=where, properties={k: str(v) for k, v in self.options.items()})
        return x.toDF(*[c.lower() for c in x.columns])

    def ids(self, page: int = 1_000_000) -> DataFrame:
        return self.rows([], page)

    def repeated(self, page: int = 1_000_000) -> DataFrame:
        """Keys that, as text, occur more than once."""
        return self.ids(page).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def fetch(self, ids: DataFrame, at_once: int = 500) -> DataFrame:
        """Rows (doc_id, text or vector) of these ids, which ask for as many queries as there are blocks of `at_once` of them; each block is
        a task. For ids that are a large part of the table, join `rows` instead. Ids that the store lacks give no row."""
        wanted = sorted({r.doc_id for r in ids.select("doc_id").where("doc_id IS NOT NULL").toLocalIterator()})
        blocks = [wanted[i : i + at_once] for i in range(0, len(wanted), at_once)] or [[]]
        names = [self.key, *filter(None, (self.vector, self.text))]
        sql = f"(SELECT {', '.join([f'{names[0]} AS doc_id', *names[1:]])} FROM {self.table}) q"
        where = [f"doc_id IN ({', '.join(map(self._literal, b))})" if b else "1 = 0" for b in blocks]
        x = self.spark.read.jdbc(self.url, sql, predicates=where, properties={k: str(v) for k, v in self.options.items()})
        return x.toDF(*[c.lower() for c in x.columns])

    def search(self, queries: list[tuple[object, list[float]]], k: int) -> DataFrame:
        """query_id, doc_id, score, rank of a bounded list of queries. Each is one ordered and limited query of the store, which its own
        index answers, run by a task of its own; k rows of each come back. Ties go by the key. A key that comes twice, or a distance
        that is not finite, is an error."""
        if isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise ValueError("k must be a positive integer")
        parts = []
        for name, q in queries:
            q = [float(x) for x in q]
            if not q or not all(map(math.isfinite, q)):
                raise ValueError(f"invalid query vector of {name}")
            d = self.distance(self.vector, q)
            found = self._query(f"SELECT {self.key} AS doc_id, {d} AS distance FROM {self.table} WHERE {self.vector} IS NOT NULL AND {self.key} IS NOT NULL ORDER BY distance, {self.key} FETCH FIRST {k} ROWS ONLY")
            parts.append(found.select(F.lit(name).alias("query_id"), "doc_id", F.col("distance").cast("double").alias("distance")))
        if not parts:
            raise ValueError("no queries")
        x = reduce(DataFrame.unionByName, parts)
        bad = F.isnan("distance") | (F.abs("distance") == float("inf")) | F.col("distance").isNull()
        twice = F.count(F.lit(1)).over(Window.partitionBy("query_id", F.col("doc_id").cast("string"))) > 1
        wrong = F.when(bad, F.lit("a distance is not finite")).when(twice, F.lit("a key comes twice"))
        x = x.withColumn("wrong", wrong).where(F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong")).cast("boolean")).otherwise(True))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id")) - 1
        return x.select("query_id", "doc_id", self.score(F.col("distance")).alias("score"), rank.alias("rank"))
