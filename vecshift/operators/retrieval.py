"""Exact and approximate vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshift.functions.scalar import METRICS, vector_ok

#: Bytes of query vectors that one pass over the corpus carries; more queries mean more passes.
QUERY_BYTES = 8 << 20
#: The most results (queries times k) that a task keeps, and half as many as it holds besides; scores go by half that number as well.
CELLS = 1 << 20
#: Rows of a batch that a task returns.
OUT_ROWS = 1 << 16
DIGITS = 9


def ship(spark) -> None:
    """Let Python workers import this package."""
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(vectors, queries), higher is better, rounded so that ties are ties on every engine."""
    if metric == "cosine":
        x, q = _unit(x), _unit(q)
    if metric in ("cosine", "dot"):
        s = x @ q.T
        return np.round(s, DIGITS, out=s)
    if not len(x) or not len(q):
        return np.zeros((len(x), len(q)))
    if len(x) < len(q):  # no cancellation near 0
        d = np.stack([np.square(q - v).sum(1) for v in x])
    else:
        d = np.stack([np.square(x - v).sum(1) for v in q], axis=1)
    return np.round(-d if metric == "squared_l2" else -np.sqrt(d), DIGITS)


def _block_size(dim: int, k: int) -> int:
    """Queries of a block: their vectors take QUERY_BYTES at most, their results CELLS, and their numbers 16 bits."""
    return max(1, min(QUERY_BYTES // (8 * max(dim, 1)), CELLS // k, 1 << 16))


class _Best:
    """The best k results of each of a block of queries, out of scores that come a few vectors at a time. A score is looked at again only
    if it reaches the query's k-th so far, so memory follows the results (CELLS at most) and not the scores; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.held = [(np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0))]
        self.size, self.most = 0, n * k + max(CELLS // 2, n)

    def add(self, x: np.ndarray, doc: np.ndarray, q: np.ndarray, metric: str, asks: np.ndarray | None = None, qid: np.ndarray | None = None) -> None:
        """Vectors x with ids doc against queries q, which are those at `asks` of the block (all of them without). qid: ids that the
        queries don't take for a result."""
        step = max(1, CELLS // (2 * max(1, len(q))))
        for lo in range(0, len(x), step):
            s, d = scores(x[lo : lo + step], q, metric), doc[lo : lo + step]
            if qid is not None:
                s[d[:, None] == qid[None, :]] = -np.inf
            row, col = np.nonzero(s >= (self.floor if asks is None else self.floor[asks]))
            v = s[row, col]
            if not (fine := np.isfinite(v)).all():
                row, col, v = row[fine], col[fine], v[fine]
            self.held.append(((col if asks is None else asks[col]).astype(np.uint16), d[row], v))
            self.size += len(v)
            if self.size > self.most:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query in the block, id and score of what is kept, by query. Nothing but ties at a query's k-th is sorted."""
        q, d, s = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held.clear()
        order = np.argsort(q, kind="stable")  # a radix sort
        q, d, s = q[order], d[order], s[order]
        n, k = len(self.floor), self.k
        count = np.bincount(q, minlength=n)
        start = np.cumsum(count) - count
        full = np.flatnonzero(count >= k)
        full = full[np.argsort(count[full], kind="stable")]
        while len(full):  # as many queries as a matrix of CELLS scores holds, one at least
            fit = np.searchsorted(count[full] * np.arange(1, len(full) + 1), CELLS, "right")
            some, full = np.split(full, [max(1, fit)])
            place = np.arange(count[some[-1]])
            m = s[np.minimum(start[some][:, None] + place, len(s) - 1)]
            m[place >= count[some][:, None]] = -np.inf
            m.partition(len(place) - k, axis=1)
            self.floor[some] = m[:, len(place) - k]
        floor = self.floor[q]
        keep, tie = s > floor, np.flatnonzero(s == floor)
        tie = tie[np.lexsort((d[tie], q[tie]))]
        count = np.bincount(q[tie], minlength=n)
        turn = np.arange(len(tie)) - (np.cumsum(count) - count)[q[tie]]
        keep[tie[turn < (k - np.bincount(q[keep], minlength=n))[q[tie]]]] = True
        q, d, s = q[keep], d[keep], s[keep]
        self.held, self.size = [(q, d, s)], len(q)
        return q, d, s

    def batches(self, qid: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, d, s = self.cut()
        order = np.lexsort((d, -s, q))  # by query and place
        for lo in range(0, len(q), OUT_ROWS):
            at = order[lo : lo + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(qid[q[at]]), pa.array(d[at]), pa.array(s[at])], ["query_id", "doc_id", "score"])


def topk(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", drop_self: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank (0-based); ties go to the smaller doc_id.

    corpus (doc_id, v) and queries (query_id, v) with double vectors of one dimension; zero vectors are dropped for
    cosine, null or non-finite ones always. The corpus is never shuffled: each partition multiplies its vectors with a
    block of queries (QUERY_BYTES and CELLS // k at most) in steps of CELLS // 2 scores, keeps its own top k, and only those rows
    meet in the final ranking. A task's memory is bounded by these figures, whatever the rows, the queries and k's share of them.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    metric = METRICS[metric.lower()]
    spark = corpus.sparkSession
    ship(spark)
    head = queries.limit(1).collect()
    dim = len(head[0]["v"]) if head else 0
    fine = lambda c: vector_ok("v", dim) & (F.expr("exists(v, x -> abs(x) > 1e-12)") if metric == "cosine" else F.lit(True))
    corpus = corpus.where(fine("v")).select(F.col("doc_id").cast("long").alias("doc_id"), "v")
    out = None
    for ids, block in _query_blocks(queries.where(fine("v")), _block_size(dim, k)):
        held = spark.sparkContext.broadcast((ids, _unit(block) if metric == "cosine" else block))

        def part(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            best = _Best(len(qid), k)
            for b in batches:
                doc, x = b.column(0).to_numpy(), _matrix(b.column(1))
                if metric == "cosine":
                    x = _unit(x)
                best.add(x, doc, q, "dot" if metric == "cosine" else metric, qid=qid if drop_self else None)
            yield from best.batches(qid)

        rows = corpus.mapInArrow(part, "query_id long, doc_id long, score double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of bounded size, fetched one after the other."""
    ids, rows = [], []
    for r in queries.select(F.col("query_id").cast("long").alias("query_id"), "v").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.v)
        if len(ids) == size:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def pair_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, name: str = "target_score") -> DataFrame:
    """pairs (query_id, doc_id, ...) with their cosine in another space; two equi-joins, then JVM arithmetic."""
    from vecshift.functions.scalar import cosine

    x = pairs.join(queries.select("query_id", F.col("v").alias("__q")), "query_id").join(corpus.select("doc_id", F.col("v").alias("__d")), "doc_id")
    return x.withColumn(name, F.round(cosine("__q", "__d"), DIGITS)).drop("__q", "__d")


def rerank(candidates: DataFrame) -> DataFrame:
    """Position by target score; ties keep the source order; unscored candidates are dropped, a NaN score is an error."""
    w = Window.partitionBy("query_id").orderBy(F.desc("target_score"), "source_rank")
    score = F.when(F.isnan("target_score"), F.raise_error(F.lit("NaN target score"))).otherwise(F.col("target_score"))
    return candidates.withColumn("target_score", score).where("target_score IS NOT NULL").withColumn("position", F.row_number().over(w))


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, share of b's first k that a's first k holds."""
    x = a.where(F.col("rank") < k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    y = b.where(F.col("rank") < k).select("query_id", "doc_id")
    return y.join(x, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("overlap"))


def fidelity(approximate: DataFrame, exact: DataFrame, k: int, least: float = 0.95) -> DataFrame:
    x = overlap_at(approximate, exact, k).agg(F.round(F.avg("overlap"), 9).alias("fidelity"), F.count(F.lit(1)).alias("queries"))
    return x.withColumn("status", F.when(F.col("queries") == 0, "UNKNOWN").when(F.col("fidelity") >= least, "PASS").otherwise("WARNING"))


def index_health(index: DataFrame, dim: int) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("doc_id").isNull()).alias("null_ids"), F.count_if(F.col("v").isNull()).alias("null_vectors"), F.countDistinct("doc_id").alias("distinct_ids"),
        F.count_if(F.size("v") != dim).alias("wrong_dimension"), F.count_if(~vector_ok("v", dim) & F.col("v").isNotNull()).alias("invalid_vectors"),
    )


def ivf_assign(corpus: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """Rows (doc_id, v, cell), one for each of the nearest cells (cosine)."""
    ship(corpus.sparkSession)
    held = corpus.sparkSession.sparkContext.broadcast(centroids)
    ident, kind = corpus.columns[0], corpus.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            s = scores(_matrix(b.column(1)), c, "cosine")
            near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], [ident, "v", "cell"])

    return corpus.select(ident, "v").mapInArrow(run, f"{ident} {kind}, v array<double>, cell int")


def ivf_train(corpus: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Spherical k-means centroids from a bounded sample by hash of the id; the index itself covers every row."""
    rows = corpus.orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(sample).select("v").collect()
    x = np.array([r.v for r in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].mean(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return c


def ivf_probes(corpus: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, least: float = 0.92, sample: int = 2000) -> int:
    """The fewest probes whose mean recall at k against exact search reaches `least`, measured on a bounded sample of the
    queries by hash of the id (all of them where there are no more); the slack to 0.9 is several of its standard errors."""
    some = queries.orderBy(F.xxhash64(F.lit(1), "query_id")).limit(sample)
    cells = ivf_assign(corpus, centroids).select("doc_id", "cell")
    found = topk(corpus, some, k).select("query_id", "doc_id").join(cells, "doc_id").groupBy("query_id", "cell").count().collect()  # sample * k rows at most
    if not found:
        return len(centroids)
    rows = some.select("query_id", "v").collect()
    near = np.argsort(-scores(np.array([r.v for r in rows], np.float64), centroids, "cosine"), axis=1, kind="stable")
    place = {r.query_id: 1 + np.argsort(x) for r, x in zip(rows, near, strict=True)}  # by cell: its turn
    hits = np.bincount([place[r.query_id][r.cell] for r in found], [r["count"] for r in found], len(centroids) + 1)
    return int(np.searchsorted(np.cumsum(hits) / hits.sum(), least - 1e-12))


def ivf_search(corpus: DataFrame, queries: DataFrame, k: int, cells: int, probes: int, centroids: np.ndarray | None = None, metric: str = "cosine") -> DataFrame:
    """Approximate top-k: each vector is scored by the queries that probe its cell only. The corpus stays where it is: a partition
    multiplies the vectors of one cell with a block of that cell's queries and keeps its own top k, so that no cell, however
    large, makes pairs or meets in one task. A corpus that has a column `cell` (see `sources.index`) is not assigned anew, and
    where it is stored by cell, the cells that no query probes are pruned while the query runs. metric: of the scores; cells are
    always those of the nearest directions."""
    spark, metric = corpus.sparkSession, METRICS[metric.lower()]
    c = ivf_train(corpus, cells) if centroids is None else centroids
    q = ivf_assign(queries, c, probes)
    dim, out, stored = c.shape[1], None, "cell" in corpus.columns
    if stored:
        wanted = q.select("cell").distinct().where("cell >= 0")  # as many rows as there are centroids; the filter lets Spark prune by it
        corpus = corpus.join(F.broadcast(wanted), "cell", "left_semi")
    rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "v", F.col("cell").cast("int").alias("cell") if stored else F.lit(None).cast("int").alias("cell"))
    grouped = q.groupBy("query_id").agg(F.first("v").alias("v"), F.collect_list("cell").alias("near"))
    for ids, block, near in _probing_blocks(grouped, _block_size(dim, k)):
        held = spark.sparkContext.broadcast((ids, _unit(block) if metric == "cosine" else block, near, c))

        def part(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q, near, c = held.value
            best = _Best(len(qid), k)
            for b in batches:
                x = _matrix(b.column(1))
                own = b.column(2).to_numpy(zero_copy_only=False) if stored else scores(x, c, "cosine").argmax(1)
                doc = b.column(0).to_numpy()
                if metric == "cosine":
                    x = _unit(x)
                for cell in np.unique(own):
                    asks = np.flatnonzero(near[:, int(cell)]) if cell < near.shape[1] else np.zeros(0, np.int64)
                    if len(asks):
                        mine = np.flatnonzero(own == cell)
                        best.add(x[mine], doc[mine], q[asks], "dot" if metric == "cosine" else metric, asks)
            yield from best.batches(qid)

        found = rows.mapInArrow(part, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _probing_blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries with the cells they probe, in blocks of bounded size: ids, vectors, and whether each probes each cell."""
    ids, rows, near = [], [], []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        probed = np.zeros((len(ids), 1 + max(map(max, near))), bool)
        for i, x in enumerate(near):
            probed[i, x] = True
        return np.array(ids), np.array(rows, np.float64), probed

    for r in queries.select(F.col("query_id").cast("long").alias("query_id"), "v", "near").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.v)
        near.append(r.near)
        if len(ids) == size:
            yield block()
            ids, rows, near = [], [], []
    if ids:
        yield block()


def ivf_cells(rows: int, wanted: int | None) -> int | None:
    """The number of cells for a coarse index, or none where the corpus is too small for it and is searched exactly."""
    return wanted if wanted and rows >= max(39, 4 * wanted) else None


def search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", cells: int | None = None, probes: int = 64) -> DataFrame:
    """Exact search, or coarse-cell search where cells are asked for and the corpus is large enough."""
    n = ivf_cells(corpus.count(), cells) if cells else None
    return ivf_search(corpus, queries, k, n, min(probes, n)) if n else topk(corpus, queries, k, metric)


def ordered_union(candidates: DataFrame) -> DataFrame:
    """doc_id, position: the documents of all candidate lists, each at its first place in (query_id, source_rank) order."""
    first = candidates.groupBy("doc_id").agg(F.min(F.struct("query_id", "source_rank")).alias("first"))
    return first.select("doc_id", F.col("first.query_id").alias("query_id"), F.col("first.source_rank").alias("source_rank"))
