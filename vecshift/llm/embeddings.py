"""Embedding near-dedup by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted, and quantised to width WIDTH; DEPTH such cells make the
bucket key of one table. Vectors that share a bucket in any table are compared by exact double-precision cosine.
Depth and number of tables follow the number of vectors, so that a bucket holds a few unrelated vectors at any size
while a pair exactly at the threshold is met with probability RECALL.

Equal vectors are one class with a weight, so a group of copies costs one vector. A bucket with more than BLOCK
classes is dealt into sub-blocks and its block pairs are compared by matrix products, each in a task of its own; no
bucket is capped; small buckets are compared many at a time. A pair counts in the first table in which it shares a bucket, so links are exact per found pair.
Tasks return link counts and a spanning forest, never pairs.

Edge cases: a null vector, one with null or non-finite parts, a zero or empty one, links with nothing. Every other vector
can link, whatever its magnitude. Vectors of different lengths never link. A null vec_id links with nothing, has component_id null and is kept. Rows are
compared by their vectors alone, also where several share an id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, bounded_map, materialize, mix, ready
from .graph import forest, smallest_ids

THRESHOLD, WIDTH, RECALL, BLOCK, SMALL, SEED = 0.95, 1.5, 0.97, 1024, 32, 11


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance share a cell of one projection."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Depth and number of tables for n vectors."""
    near, far = same_cell(math.sqrt(2 - 2 * threshold)), same_cell(math.sqrt(2))
    depth = max(6, math.ceil(math.log(max(n, 2)) / -math.log(far)) + 2)  # so that few unrelated vectors meet in a bucket
    return depth, math.ceil(math.log(1 - RECALL) / math.log(1 - near**depth))


@lru_cache(maxsize=4)
def _directions(dim: int, depth: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, depth, tables])
    return rng.standard_normal((dim, depth * tables)), rng.uniform(0, WIDTH, depth * tables)


def bucket_keys(unit: np.ndarray, depth: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket keys."""
    a, shift = _directions(unit.shape[1], depth, tables)
    out = np.empty((len(unit), tables), np.uint64)
    for lo in range(0, len(unit), 512):
        cells = np.floor((unit[lo : lo + 512] @ a + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, depth)
        key = np.full((len(cells), tables), unit.shape[1], np.uint64)
        for k in range(depth):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
        out[lo : lo + 512] = key
    return out


def _units(raw: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest part first, so that no square over- or underflows."""
    x = np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in raw]).astype(np.float64).reshape(len(raw), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packer(kind: str):
    """id and the vector's bytes, null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1):
                x = np.zeros(0, kind) if v.values is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False) + np.array(0, kind)
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows, some whole runs of equal keys at a time, with the runs' edges."""
    held: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        cols = [t[k].to_numpy() for k in keys]
        return t, np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1, [len(t)]])

    for b in batches:
        if not b.num_rows:
            continue
        same = held and all(held[-1].column(k)[held[-1].num_rows - 1] == b.column(k)[b.num_rows - 1] for k in keys)
        held.append(b)
        if same:
            continue
        t, edge = cut(held)
        if len(edge) > 2:
            yield t.slice(0, edge[-2]).combine_chunks(), edge[:-1]
            held = t.slice(edge[-2]).combine_chunks().to_batches()
    if held:
        yield cut(held)


def _small(u: np.ndarray, start: np.ndarray, size: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within many runs of the same small size."""
    a, b = [], []
    upper = np.triu(np.ones((size, size), bool), 1)
    for lo in range(0, len(start), max(1, (1 << 19) // (size * u.shape[1]))):
        at = start[lo : lo + max(1, (1 << 19) // (size * u.shape[1]))][:, None] + np.arange(size)
        x = u[at]
        k, i, j = np.nonzero((x @ x.transpose(0, 2, 1) >= threshold) & upper)
        a.append(at[k, i])
        b.append(at[k, j])
    return np.concatenate(a), np.concatenate(b)


def _large(u: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, seen: np.ndarray | None) -> np.ndarray:
    """Whether each left row links with each right row here first: not in a table before, whose keys `seen` has."""
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), 256):
        own = left[lo : lo + 256]
        hit = u[own] @ u[right].T >= threshold
        if seen is not None and hit.any():
            for k in range(seen.shape[1]):
                hit &= seen[own, k][:, None] != seen[right, k][None, :]
        out[lo : lo + 256] = hit
    return out


def _spread(hit: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id within reach for the rows and columns of a link matrix, given their ids."""
    a, b, most = own.copy(), other.copy(), np.iinfo(np.int64).max
    while True:
        x, y = a.copy(), b.copy()
        for lo in range(0, len(a), 256):
            part = hit[lo : lo + 256]
            x[lo : lo + 256] = np.minimum(x[lo : lo + 256], np.where(part, b[None, :], most).min(1, initial=most))
            y = np.minimum(y, np.where(part, x[lo : lo + 256][:, None], most).min(0, initial=most))
        if (x == a).all() and (y == b).all():
            return a, b
        a, b = x, y


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    ready(vectors.sparkSession)
    part = vectors.schema[column].dataType
    single = isinstance(part, T.ArrayType) and isinstance(part.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"  # bytes as they came; cosines are taken in double precision
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    packed = materialize(base.mapInArrow(_packer(kind), "vec_id long, v binary").withColumn("digest", F.expr("CASE WHEN vec_id IS NOT NULL THEN sha2(v, 256) END")), "vectors")
    classes = materialize(packed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.min("v").alias("v")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, total = classes.count(), packed.count()
    depth, tables = plan(n, threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x.as_buffer()) for x in b.column(2)])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                for lo in range(0, len(at), 256):
                    own = at[lo : lo + 256]
                    keys = bucket_keys(_units(b.column(2).take(pa.array(own)), kind), depth, tables).view(np.int64)
                    where = pa.array(np.repeat(own, tables))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(keys.ravel()), *(b.column(k).take(where) for k in range(3))], ["t", "key", "cid", "m", "v"]
                    )

    rows = classes.select("cid", "m", "v").mapInArrow(deal, "t int, key long, cid long, m long, v binary")
    keys = materialize(rows.select("t", "key"), "bucket_rows")
    sizes = materialize(keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    hot = sizes.where(F.col("size") > max(BLOCK, n * tables // HOT_SHARE))  # fewer than HOT_SHARE buckets
    full = bounded_map(vectors.sparkSession, sizes, hot, rows, ["t", "key"], "inner")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = full.withColumn("s", parts).withColumn("a", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("s")).cast("int"))
    dealt = dealt.withColumn("b", F.explode(F.expr("sequence(0, s - 1)")))
    dealt = dealt.select("t", "key", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "cid", "m", "v")

    blocks = dealt.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in _runs(batches, ["t", "key", "x", "y"]):
            ids, m, side, table, x, y = (t[c].to_numpy() for c in ("cid", "m", "a", "t", "x", "y"))
            links, child, parent = np.zeros(len(ids), np.int64), [], []
            size, width = np.diff(edge), np.array([len(v.as_buffer()) for v in t["v"]])
            for w in np.unique(width[edge[:-1]]):  # vectors of one length share no bucket with others
                mine = np.flatnonzero(width[edge[:-1]] == w)
                rows = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in mine])
                u, at = _units(t["v"].take(pa.array(rows)).combine_chunks(), kind), np.full(len(ids), -1)
                at[rows] = np.arange(len(rows))
                small = mine[(size[mine] <= SMALL) & (x[edge[mine]] == y[edge[mine]])]
                pairs = [_small(u, at[edge[small[size[small] == n]]], n, threshold) for n in np.unique(size[small]) if n > 1]
                if pairs and sum(len(p[0]) for p in pairs):
                    i, j = (np.concatenate(z) for z in zip(*pairs, strict=True))
                    used, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
                    seen, p, q = bucket_keys(u[used], depth, tables), inv[: len(i)], inv[len(i) :]
                    new = np.ones(len(i), bool)
                    for k in range(tables):
                        new &= (seen[p, k] != seen[q, k]) | (k >= table[rows[i]])
                    i, j = rows[i[new]], rows[j[new]]
                    links += np.bincount(i, m[j], len(ids)).astype(np.int64) + np.bincount(j, m[i], len(ids)).astype(np.int64)
                    c, p = forest(len(ids), i, j, ids)
                    child.append(c)
                    parent.append(p)
                for k in np.setdiff1d(mine, small):
                    own = np.arange(edge[k], edge[k + 1])
                    a, b = x[own[0]], y[own[0]]
                    left, right = (own[side[own] == a], own[side[own] == b]) if a != b else (own, own)
                    v = u[at[own]]
                    seen = bucket_keys(v, depth, tables)[:, : table[own[0]]] if table[own[0]] else None
                    hit = _large(v, left - own[0], right - own[0], threshold, seen)
                    if a == b:
                        np.fill_diagonal(hit, False)
                    else:
                        links[right] += (m[left].astype(float) @ hit).astype(np.int64)
                    links[left] += (hit @ m[right].astype(float)).astype(np.int64)
                    for z, low in zip((left, right), _spread(hit, ids[left], ids[right]), strict=True):
                        child.append(ids[z][low < ids[z]])
                        parent.append(low[low < ids[z]])
            some = np.flatnonzero(links)
            c, p = (np.concatenate([*z, np.zeros(0, np.int64)]) for z in (child, parent))
            first = np.arange(len(some) + len(c)) < len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], c])), pa.array(np.concatenate([links[some], np.zeros(len(c), np.int64)])), pa.array(np.concatenate([np.zeros(len(some), np.int64), p]), mask=first)], ["cid", "n", "parent"])

    found = materialize(blocks.mapInArrow(compare, "cid long, n long, parent long"), "links")
    label = smallest_ids(classes, found.where("parent IS NOT NULL").select(F.col("cid").alias("child"), "parent"))
    links = found.where("parent IS NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    per_class = classes.select("digest", "cid", "m").join(links, "cid", "left").join(label, "cid")
    per_class = materialize(per_class.select("digest", "m", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "per_class")
    big = per_class.where(F.col("m") > total // HOT_SHARE)
    out = bounded_map(vectors.sparkSession, per_class, big, packed.where("digest IS NOT NULL").select("vec_id", "digest"), ["digest"], "inner")
    out = out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = packed.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
