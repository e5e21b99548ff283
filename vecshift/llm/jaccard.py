"""Exact n-gram Jaccard join by a token-group matrix.

1. Equal shingle sets are one class, whatever the number of copies.
2. A fixed-size table of quantised shingle counts over the whole corpus (CELLS bytes) orders shingles from rare to
   frequent; any consistent order gives the same links, so collisions in it cost time only.
3. Similar classes (one min-hash and nearly one size) form groups. Where a group has more than BIG members, its members are
   first compared on whole sets in blocks of GROUP, once for each of HASHES min-hashes with blocks dealt anew; what
   that links is one unit from then on. So a cluster of near copies costs work in proportion to its size. All other groups are
   cut into units of about GROUP members.
4. The matrix holds for each unit the union of its members' rarest shingles (prefixes) with the best position and the sizes
   seen there. Linked units query the matrix as a whole, all other classes one by one; the number of hits, their positions
   and the sizes bound the overlap that the query can have with any member. Only units whose bound reaches the threshold are
   opened, in blocks of GROUP members and QUERIES queries that are compared on whole sets. Nothing is opened inside a linked unit.
5. Compared blocks return spanning forests, never pairs; components come from those.

The search is exact: only links inside one component are left out. Let prefixes be the first n - ceil(t n) + 1 shingles, o
the overlap that two sets of sizes n >= s need. Of the shared shingles in order, the r-th stands at most n - o places
later in the larger set and s - o in the smaller one; so at least o - ceil(t n) + 1 shared shingles lie in both prefixes.
A unit is opened when at least so many of the query's prefix lie in its union, for the smallest o of its members, and the
first of them leaves room for o. Where the query is a unit of several sizes, the bound is that of its largest size, less one for rounding.

Edge cases: a text with fewer than `n` words is one shingle; null, empty and white-space texts have n_shingles 0 and
link with nothing. A null id links with nothing and has component_id null. Rows are linked by
their texts alone, also where several share an id.
An empty table gives an empty result; extra columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, bounded_map, buffers, discard, grams, hashes, kept, materialize, merge_bits, mix, pieces, ready, spans, tidy
from .graph import components, forest, smallest_ids

CELLS, PARTS, FAN = 1 << 22, 64, 64
GROUP, QUERIES, BIG, HASHES = 256, 1024, 64, 3
_ODD = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each row."""
    data, off = buffers(texts)
    for lo, hi, d, o in pieces(data, off):
        s, e, first = spans(d, o)
        h = hashes(d, s, e)
        for i in range(hi - lo):
            w = h[first[i] : first[i + 1]]
            yield lo + i, np.unique(grams(w, n)) if len(w) >= n else grams(w, len(w)) if len(w) else w


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of an order-free set hash; equal sets agree, and n_shingles is kept beside it."""
    with np.errstate(over="ignore"):
        x = mix(s + np.uint64(0x1234567))
        y = mix(x)
        out = np.array([x.sum() ^ (y.sum() * np.uint64(3)) + np.uint64(len(s)), mix(y + np.uint64(0x7654321)).sum()], np.uint64)
    a, b = mix(out).view(np.int64)
    return int(a), int(b)


def merge_counts(parts: DataFrame) -> np.ndarray:
    """Sums the byte-planed count blocks (block, src, v) of all tasks, FAN tasks at a time, to CELLS log-quantised bytes."""
    schema = "block int, src int, v binary"

    def add(t: pa.Table) -> pa.Table:
        total = sum(_unpack(v) for v in t["v"].to_pylist())
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "src": pa.array([t["src"][0].as_py() // FAN], pa.int32()), "v": pa.array([_pack(total)], pa.binary())})

    tasks = (parts.agg(F.max("src")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("fan", F.floor(F.col("src") / FAN)).groupBy("block", "fan").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
        parts = materialize(parts, "counts")
    out = np.zeros(CELLS, np.int64)
    width = CELLS // PARTS
    for r in parts.collect():  # PARTS rows, CELLS numbers: a fixed size
        out[r.block * width : (r.block + 1) * width] = _unpack(bytes(r.v))
    return np.minimum(255, 8 * np.log2(out + 1.0)).astype(np.uint8)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(x.astype(np.int64), (1 << 48) - 1).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), 1)


def _unpack(v: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(v), np.uint8).reshape(6, -1)
    return sum(planes[k].astype(np.int64) << (8 * k) for k in range(6))


#: A row with its rarest shingles counts as this many narrow ones.
WIDE = 8


def similarity_classes(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; documents link when 100 * intersection >= percent * union of their shingle sets."""
    spark = ready(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept("jaccard")
        count, src = np.zeros(CELLS, np.int32), TaskContext.get().partitionId()
        none = None
        for b in batches:
            size, sig = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 2), np.int64)
            for i, s in shingle_sets(b.column(1), n):
                size[i] = len(s)
                if len(s):
                    sig[i] = _digest(s)
                    count[(s >> np.uint64(42)).view(np.int64)] += 1
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array([none] * k, pa.int32()), pa.array([none] * k, pa.int32()), pa.array([none] * k, pa.binary())], ["doc_id", "n", "d", "e", "block", "src", "v"]
            )
        width = CELLS // PARTS
        for p in range(PARTS):
            own = count[p * width : (p + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([none], pa.int64())] * 4, pa.array([p], pa.int32()), pa.array([src], pa.int32()), pa.array([_pack(own)], pa.binary())], ["doc_id", "n", "d", "e", "block", "src", "v"]
                )

    signed = materialize(base.mapInArrow(tidy(sign), "doc_id long, n long, d long, e long, block int, src int, v binary"), "signed")
    docs_signed = signed.where("block IS NULL").select("doc_id", "n", "d", "e")
    live = docs_signed.where("n > 0 AND doc_id IS NOT NULL")
    documents = docs_signed.count()
    classes = live.groupBy("d", "e", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes", documents)  # written once: a number of its own for each
    total = classes.count()
    rare = spark.sparkContext.broadcast(merge_counts(signed.where("block IS NOT NULL").select("block", "src", "v")).tobytes())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(rare.value, np.uint8)
        for b in batches:
            at, size, sig, near, toks = [], [], [], [], []
            ids = b.column(0)
            for i, s in shingle_sets(b.column(1), n):
                if not len(s) or not ids[i].is_valid:
                    continue
                m = len(s)
                p = m - -(-percent * m // 100) + 1
                rank = (order[(s >> np.uint64(42)).view(np.int64)].astype(np.uint64) << np.uint64(56)) | (s & np.uint64((1 << 56) - 1))
                first = s[np.argpartition(rank, p - 1)[:p]] if p < m else s
                first = first[np.argsort(rank[np.searchsorted(s, first)], kind="stable")]
                at.append(i)
                size.append(m)
                sig.append(_digest(s))
                near.append([int((s * x).min() >> np.uint64(1)) for x in _ODD[:HASHES]])
                toks.append(first.view(np.int64))
            if at:
                lens = np.cumsum([0, *map(len, toks)])
                lists = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(toks)))
                d, e = (pa.array(x, pa.int64()) for x in zip(*sig, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(size, pa.int64()), d, e, pa.array(near, pa.list_(pa.int64())), lists], ["rep", "n", "d", "e", "near", "toks"])

    made = base.mapInArrow(tidy(prefixes), "rep long, n long, d long, e long, near array<long>, toks array<long>")
    named = classes.select("cid", "d", "e", "n", "rep")
    reps = materialize(made.join(named, ["d", "e", "n", "rep"]).select("cid", "rep", "n", "near", "toks"), "prefixes")
    band = F.floor(F.log("n") / F.lit(0.1))

    def sets_of(work: DataFrame) -> DataFrame:
        """Whole sets of the classes of a written work table: a fixed-size bit set of their ids keeps the others out of the scan."""
        wanted = spark.sparkContext.broadcast(bit_set(work.select("rep")))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(wanted.value, np.uint8)
            for b in batches:
                j = _place(b.column(0))
                at = np.flatnonzero((bits[j >> 3] >> (j & 7).astype(np.uint8)) & 1)
                own = b.take(pa.array(at))
                at, sig, sets = [], [], []
                for i, s in shingle_sets(own.column(1), n):
                    if len(s):
                        at.append(i)
                        sig.append(_digest(s))
                        sets.append(s.tobytes())
                if at:
                    d, e = (pa.array(x, pa.int64()) for x in zip(*sig, strict=True))
                    yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(at)), d, e, pa.array(sets, pa.binary())], ["rep", "d", "e", "s"])

        found = base.where("doc_id IS NOT NULL").mapInArrow(tidy(whole), "rep long, d long, e long, s binary")
        asked = named.drop("n").join(work.select("cid").distinct(), "cid", "left_semi")
        return found.join(asked, ["d", "e", "rep"]).select("cid", "s").dropDuplicates(["cid"])

    def compared(work: DataFrame, name: str) -> DataFrame:
        """Spanning forests of the blocks of a written work table (cid, rep, gid, block, chunk, role)."""
        blocks = work.drop("rep").join(sets_of(work), "cid").select("gid", "block", "chunk", "role", "cid", "s")
        blocks = blocks.repartition("gid", "block", "chunk").sortWithinPartitions("gid", "block", "chunk")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in by_group(batches, ["gid", "block", "chunk"]):
                c, p = linked(t, percent)
                if len(c):
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(p)], ["child", "parent"])

        return materialize(blocks.mapInArrow(tidy(run), "child long, parent long"), name)

    # large groups: what they link inside becomes one unit
    often = lambda x: F.col(x) > max(BIG, HASHES * total // HOT_SHARE)
    keyed = reps.select("cid", "rep", band.alias("band"), F.posexplode("near").alias("k", "x")).select("cid", "rep", "k", F.xxhash64("k", "x", "band").alias("gid"))
    large = materialize(keyed.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where(f"members > {BIG}"), "large_groups", total)
    inside = bounded_map(spark, large, large.where(often("members")), keyed, ["gid"], "inner")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("cid", "k"), F.ceil(F.col("members") / GROUP)).cast("int"))
    inside = materialize(inside.select("cid", "rep", "gid", "block", F.lit(0).alias("chunk"), F.lit(2).alias("role")), "inside", HASHES * total)
    known = compared(inside, "inside_links")
    units = components(known).select(F.col("child").alias("cid"), "root")
    units = materialize(units.unionByName(units.select(F.col("root").alias("cid"), "root").distinct()), "units", total)

    gkey = F.xxhash64(F.lit(0), F.get("near", F.lit(0)), band)
    grouped = bounded_map(spark, large, large.where(often("members")), reps.withColumn("gid", gkey), ["gid"])
    salt = F.pmod(F.xxhash64("cid"), F.greatest(F.lit(1), F.ceil(F.coalesce("members", F.lit(1)) / GROUP)))
    grouped = grouped.select("cid", "rep", "n", "toks", F.xxhash64("gid", salt).alias("gid")).join(units, "cid", "left")
    grouped = materialize(grouped.select("cid", "rep", "n", "toks", F.coalesce("root", "gid").alias("gid"), F.coalesce("root", "cid").alias("qid")), "grouped", WIDE * total)
    discard(reps)

    # one exchange serves the matrix and the queries that meet it, as both need the same columns of it; qid is the class where none is linked
    tokens = grouped.select("n", "gid", "qid", F.posexplode("toks").alias("pos", "tok"))
    tokens = tokens.where("n IS NOT NULL AND gid IS NOT NULL AND qid IS NOT NULL AND tok IS NOT NULL").repartition("tok")
    found = tokens.groupBy("tok", "gid", "qid").agg(F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    matrix = found.groupBy("tok", "gid").agg(F.max("rest").alias("rest"), F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max"), F.min("qid").alias("c_min"), F.max("qid").alias("c_max"))
    asking = found.groupBy("tok", "qid").agg(F.max("rest").alias("q_rest"), F.min("n_min").alias("q_min"), F.max("n_max").alias("q_max"))
    least = lambda q: F.greatest("n_min", F.expr(f"({percent} * {q} + 99) div 100"))
    met = asking.join(matrix, "tok").where("qid <> gid AND (c_min <> c_max OR c_min <> qid) AND n_min <= q_max").where(F.col("n_max") >= least("q_min"))
    bound = met.groupBy("qid", "gid").agg(F.count(F.lit(1)).alias("same"), *[F.min(c).alias(c) for c in ("q_min", "n_min")], *[F.max(c).alias(c) for c in ("q_max", "q_rest", "rest")])
    bound = bound.withColumn("low", least("q_min")).withColumn("high", least("q_max")).withColumn("need", F.expr(f"({percent} * (q_min + low) + {99 + percent}) div {100 + percent}"))
    one_size = F.col("same") >= F.col("need") - F.expr(f"({percent} * q_min + 99) div 100") + 1
    sizes = F.col("same") * (100 * (100 + percent)) > F.expr(f"{percent} * (100 * high - {percent} * q_max)")
    bound = bound.where(F.when(F.col("q_min") == F.col("q_max"), one_size).otherwise(sizes)).where(F.least("q_rest", "rest") >= F.col("need"))
    opened = materialize(bound.select("qid", "gid"), "opened")

    # blocks of the members of opened units, and of the queries that opened them
    ids = grouped.select("cid", "rep", "gid", "qid").distinct()
    queries = materialize(ids.drop("gid").join(opened, "qid").select("cid", "rep", "gid"), "queries")
    members = materialize(ids.drop("qid").join(opened.select("gid").distinct(), "gid", "left_semi"), "members", total)
    asked = queries.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    asked = materialize(asked.join(members.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks")), "gid"), "asked", total)
    hot = asked.where(F.greatest(F.col("chunks") * QUERIES, F.col("blocks") * GROUP) > max(QUERIES, total // HOT_SHARE))
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    members = bounded_map(spark, asked, hot, members, ["gid"], "inner").select("cid", "rep", "gid", own("blocks").alias("block"), each("chunks").alias("chunk"), F.lit(1).alias("role"))
    queries = bounded_map(spark, asked, hot, queries, ["gid"], "inner").select("cid", "rep", "gid", each("blocks").alias("block"), own("chunks").alias("chunk"), F.lit(0).alias("role"))
    links = known.unionByName(compared(materialize(members.unionByName(queries), "work"), "links"))
    discard(grouped)

    label = classes.select("cid", "d", "e", "n", "copies").join(smallest_ids(classes, links), "cid")
    label = materialize(label, "labels", total)
    hot = label.where(F.col("copies") > max(1, documents // HOT_SHARE))
    out = bounded_map(spark, label, hot, live, ["d", "e", "n"], "inner").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(docs_signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


BITS = 1 << 21


def _place(ids: pa.Array) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(8 * BITS - 1)).view(np.int64)


def bit_set(ids: DataFrame) -> bytes:
    """BITS bytes with a bit for each id; a fixed size, false hits only let more rows through."""
    return merge_bits(ids, BITS, _place)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = b.slice(lo, hi - lo)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def linked(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between the queries (role 0) and the members (role 1) of one block; role 2 is both."""
    ids, first = np.unique(t["cid"].to_numpy(), return_index=True)
    row = np.searchsorted(ids, t["cid"].to_numpy())
    sets = [np.frombuffer(t["s"][int(i)].as_buffer(), np.uint64) for i in first]
    role = t["role"].to_numpy()
    mem, qry = np.unique(row[role > 0]), np.unique(row[role != 1])
    size = np.array([len(s) for s in sets], np.int64)
    if not len(mem) or not len(qry):
        return ids[:0], ids[:0]
    if len(mem) * len(qry) <= 4:
        a, b = np.repeat(qry, len(mem)), np.tile(mem, len(qry))
        same = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if i != j else 0 for i, j in zip(a, b, strict=True)])
        hit = (a != b) & ((100 + percent) * same >= percent * (size[a] + size[b]))
        a, b = a[hit], b[hit]
    else:
        same = overlaps([sets[i] for i in qry], [sets[i] for i in mem])
        i, j = np.nonzero(((100 + percent) * same >= percent * (size[qry][:, None] + size[mem][None, :])) & (qry[:, None] != mem[None, :]))
        a, b = qry[i], mem[j]
    if not len(a):
        return ids[:0], ids[:0]
    used, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    return forest(len(used), inv[: len(a)], inv[len(a) :], ids[used])


def overlaps(x: list[np.ndarray], y: list[np.ndarray], cells: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of all x with all y, by products over slices of the shared tokens: `cells` numbers at a time."""
    tok = [np.concatenate(s) for s in (x, y)]
    row = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    vocab = np.intersect1d(*tok)
    at = []
    for k in (0, 1):
        p = np.minimum(np.searchsorted(vocab, tok[k]), max(len(vocab) - 1, 0))
        hit = vocab[p] == tok[k] if len(vocab) else np.zeros(len(p), bool)
        p, r = p[hit], row[k][hit]
        order = np.argsort(p, kind="stable")
        at.append((p[order], r[order]))
    same = np.zeros((len(x), len(y)))
    step = max(1, cells // (len(x) + len(y)))
    for lo in range(0, len(vocab), step):
        part = []
        for (p, r), s in zip(at, (x, y), strict=True):
            i, j = np.searchsorted(p, [lo, lo + step])
            m = np.zeros((len(s), min(step, len(vocab) - lo)), np.float32)
            m[r[i:j], p[i:j] - lo] = 1
            part.append(m)
        same += part[0] @ part[1].T
    return same
