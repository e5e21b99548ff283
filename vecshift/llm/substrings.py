"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at line ends, after words that end in . ! or ? (with any symbols behind), and, so that
text without such marks has sentences too, inside sentences of over LONG words before words whose hash is divisible
by CUT (a cut that depends on the words alone, so that equal passages are cut alike wherever they stand). From every sentence
starts one span: the fewest consecutive sentences, SPAN at least, that hold LEAST words or more (so that a short shared line, such
as a licence line of one or two short sentences, is no passage). All spans are hashed
(words lower-cased) and joined over the corpus; the occurrence with the smallest (id, position) of a repeated span is the
first and stays, the sentences of every other occurrence go.

Edge cases: null and empty texts stay as they are; a text whose sentences all go becomes empty and stays as a row in
`dedup_spans` (its `text` is then ""); white space around removed sentences goes with them. Spans are compared within
one text too. Rows that repeat an id (and null ids) are told apart by the id and a hash of the text; of rows equal in both one is
the first, and all spans of the others go. An empty table gives an empty result; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, bounded_map, buffers, hashes, kept, materialize, merge_bits, mix, pieces, ready, spans, tidy

SPAN, LEAST, LONG, CUT = 2, 16, 12, 4
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "\"')]}*#$%&|<>,;:"]] = True


def sentences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word numbers at which sentences begin, in ascending order (every row with words begins one)."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    last = ends - 1
    look = last.copy()
    step = np.arange(n)
    while len(step := step[_SYMBOL[data[look[step]]] & (look[step] > starts[step])]):  # over closing symbols
        look[step] -= 1
    stop = _END[data[look]]
    gap = np.zeros(n, bool)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    gap[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) | stop[:-1]
    gap[0] = True
    gap[first[:-1][first[:-1] < first[1:]]] = True
    at = np.flatnonzero(gap)
    size = np.diff(np.append(at, n))
    long = np.repeat(size > LONG, size)
    gap |= long & (h % np.uint64(CUT) == 0)
    return np.flatnonzero(gap)


_M = np.uint64((1 << 61) - 1)
#: Base of the polynomial and its inverse.
_BASE = 0x0F3A5C917D2E6B84
_POWERS: dict[int, np.ndarray] = {}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of numbers below that."""
    low = np.uint64((1 << 32) - 1)
    ah, al, bh, bl = a >> np.uint64(32), a & low, b >> np.uint64(32), b & low
    mid, bottom = ah * bl + al * bh, al * bl
    x = (ah * bh << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (bottom >> np.uint64(61)) + (bottom & _M)
    x = (x >> np.uint64(61)) + (x & _M)
    return np.where(x >= _M, x - _M, x)


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), and more, modulo 2^61 - 1."""
    x = _POWERS.get(base)
    if x is None:
        x = np.ones(1, np.uint64)
    while len(x) < n:
        x = np.concatenate([x, _product(x, np.uint64(pow(base, len(x), int(_M))))])
    _POWERS[base] = x
    return x


def running(h: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... words' hashes, each times its power of the base, modulo a prime; so stretches of words are compared
    by a polynomial that no repeated pattern makes vanish."""
    x = (h >> np.uint64(61)) + (h & _M)
    x = _product(np.where(x >= _M, x - _M, x), _power(_BASE, len(h))[: len(h)])
    half = np.uint64((1 << 31) - 1)
    top, low = np.cumsum(x >> np.uint64(31)) % _M, np.cumsum(x & half) % _M  # of parts small enough that no sum overflows
    total = _product(top, np.uint64(1 << 31)) + low
    return np.concatenate([np.zeros(1, np.uint64), np.where(total >= _M, total - _M, total)])


def stretch_hash(run: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words lo .. hi - 1, wherever they stand."""
    a, b = run[hi], run[lo]
    inverse = _power(pow(_BASE, -1, int(_M)), len(run))
    with np.errstate(over="ignore"):
        return mix(_product(np.where(a >= b, a - b, a + _M - b), inverse[lo]) + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_spans(data, starts, ends, h, first) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row with words: row, sentence starts (word numbers, with the end), first and last+1 sentence of its spans as
    (begin, end) arrays, and the spans' hashes."""
    cut = sentences(data, starts, ends, h, first)
    run = running(h)
    at = np.searchsorted(cut, first)
    for i in range(len(first) - 1):
        a, b = at[i], at[i + 1]
        if a == b:
            continue
        edge = np.append(cut[a:b], first[i + 1])
        m = b - a
        end = np.maximum(np.searchsorted(edge, edge[:-1] + LEAST), np.arange(m) + SPAN)
        ok = end <= m
        begin, end = np.flatnonzero(ok), end[ok]
        lo, hi = edge[begin], edge[end]
        key = stretch_hash(run, lo, hi)
        yield i, edge, np.stack([begin, end]), key


def _each(texts: pa.Array) -> Iterator[tuple]:
    data, off = buffers(texts)
    for lo, _, d, o in pieces(data, off):
        s, e, first = spans(d, o)
        for i, edge, span, key in row_spans(d, s, e, hashes(d, s, e), first):
            yield lo + i, d, o[i], o[i + 1], s, e, edge, span, key


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated passages taken out of `text`; same columns, same rows."""
    ready(docs.sparkSession)
    row = lambda k, t: F.md5(F.concat(F.coalesce(F.col(k).cast("string"), F.lit("\0")), F.lit("\x1f"), F.col(t)))
    rid = row(key, text)
    twice = materialize(docs.where(F.length(text) > 0).groupBy(rid.alias("__rid")).count().where("count > 1"), "repeated_rows")
    if twice.isEmpty():
        return _dedup(docs, key, text)
    # rows equal in id and text: written once with a number, the smallest of which is the first
    safe = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    rid = row(f"__c{docs.columns.index(key)}", f"__c{docs.columns.index(text)}")
    rows = safe.withColumn("__rid", F.when(F.length(f"__c{docs.columns.index(text)}") > 0, rid)).withColumn("__m", F.monotonically_increasing_id())
    hot = twice.where(F.col("count") > max(1, docs.count() // HOT_SHARE))
    keyed = rows.where("__rid IS NOT NULL")
    copies = materialize(bounded_map(docs.sparkSession, twice, hot, keyed, ["__rid"], "inner").drop("count"), "copies")
    first = materialize(copies.groupBy("__rid").agg(F.min("__m").alias("__first")), "first_copies")
    numbered = bounded_map(docs.sparkSession, first, first.join(hot, "__rid", "left_semi"), copies, ["__rid"], "inner")
    plain = lambda df: df.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
    once = materialize(plain(rows.where("__rid IS NULL")).unionByName(plain(keyed.join(twice, "__rid", "left_anti"))).unionByName(plain(numbered.where("__m = __first"))), "rows")
    others = plain(numbered.where("__m <> __first"))
    at, names = docs.columns.index(text), docs.columns

    def all_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = {i: range(span.shape[1]) for i, *_, span, _ in _each(b.column(at))}
            cols = list(b.columns)
            cols[at] = _without(b.column(at), {i: span for i, span in gone.items() if len(span)})
            yield pa.RecordBatch.from_arrays(cols, names)

    return _dedup(once, key, text).unionByName(others.mapInArrow(tidy(all_spans), docs.schema))


def _without(texts: pa.Array, gone: dict[int, list[int]]) -> pa.Array:
    """texts without the sentences of the given spans, which are named by their number among the text's spans or, in a
    list, by their first sentence."""
    some = sorted(gone)
    new: dict[int, str] = {}
    for k, d, o, p, s, e, edge, span, _ in _each(texts.take(pa.array(some, pa.int64()))):
        i = some[k]
        out = np.zeros(len(edge) - 1, bool)
        end = dict(zip(span[0].tolist(), span[1].tolist(), strict=True))
        for x in end if isinstance(gone[i], range) else gone[i]:
            out[x : end[x]] = True
        # keep the bytes from each kept sentence's first word up to the next sentence, less white space at the seams
        keep = np.flatnonzero(~out)
        runs = np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1) if len(keep) else []
        parts = []
        for r in runs:
            w0, w1 = edge[r[0]], edge[r[-1] + 1]
            lo = o if r[0] == 0 else s[w0]
            hi = p if r[-1] == len(edge) - 2 else e[w1 - 1]
            sep = b"" if not parts else b"\n" if (d[e[w0 - 1] : s[w0]] == 10).any() else b" "
            parts.append(sep + d[lo:hi].tobytes())
        new[i] = b"".join(parts).decode("utf-8", "replace")
    return pa.array([new.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type) if new else texts


def _dedup(docs: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rid = F.xxhash64(F.col(key).cast("string"), F.col(text))
    ident = lambda k: F.coalesce(F.col(k).cast("long"), F.lit(-(1 << 63)))
    base = docs.select(ident(key).alias("id"), rid.alias("rid"), F.col(text).alias("t"))  # a row is known by both

    def span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("substrings")
        for b in batches:
            rows, keys, pos = [], [], []
            for i, *_, span, k in _each(b.column(2)):
                if len(k):
                    rows.append(np.full(len(k), i))
                    keys.append(k.view(np.int64))
                    pos.append(span[0].astype(np.int32))
            if rows:
                where = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(0).take(where), b.column(1).take(where), pa.array(np.concatenate(pos))], ["h", "id", "rid", "pos"])

    found = base.mapInArrow(tidy(span_rows), "h long, id long, rid long, pos int")
    repeated = found.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "rid", "pos")).alias("f")).where("k > 1")
    repeated = materialize(repeated.select("h", "k", *[F.col(f"f.{c}").alias(f"f_{c}") for c in ("id", "rid", "pos")]), "repeated")
    total = repeated.agg(F.sum("k")).first()[0] or 0
    wanted = spark.sparkContext.broadcast(_bits(repeated.select("h")))

    # spans of very frequent passages (fewer than HOT_SHARE of them) are settled in the scan itself, one row for each text
    often = repeated.where(F.col("k") > max(1, total // HOT_SHARE)).select("h", "f_id", "f_rid", "f_pos").orderBy("h").toArrow()
    hot = spark.sparkContext.broadcast(tuple(often[c].to_numpy() for c in ("h", "f_id", "f_rid", "f_pos")))

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        hot_h, hot_id, hot_rid, hot_pos = hot.value
        for b in span_rows(batches):
            h, own, rid, pos = (b.column(k).to_numpy() for k in range(4))
            j = h & (8 * BITS - 1)
            at = np.flatnonzero((bits[j >> 3] >> (j & 7).astype(np.uint8)) & 1)
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(hot_h, h[at]), max(len(hot_h) - 1, 0))
            known = hot_h[k] == h[at] if len(hot_h) else np.zeros(len(at), bool)
            first = known & (hot_id[k] == own[at]) & (hot_rid[k] == rid[at]) & (hot_pos[k] == pos[at]) if len(hot_h) else known
            rest = at[~known]
            if len(rest):
                none = pa.nulls(len(rest), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(h[rest]), pa.array(own[rest]), pa.array(rid[rest]), pa.array(pos[rest]), none], ["h", "id", "rid", "pos", "gone"])
            mine = at[known & ~first]
            if len(mine):
                edge = np.flatnonzero(np.append(True, (np.diff(own[mine]) != 0) | (np.diff(rid[mine]) != 0)))  # a text's spans follow one another
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(mine)), pa.int32()), pa.array(pos[mine]))
                text_of, n = mine[edge], len(edge)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(own[text_of]), pa.array(rid[text_of]), pa.nulls(n, pa.int32()), lists], ["h", "id", "rid", "pos", "gone"])

    again = materialize(base.mapInArrow(tidy(repeats), "h long, id long, rid long, pos int, gone array<int>"), "again")
    later = again.where("h IS NOT NULL").join(repeated, "h").where("id <> f_id OR rid <> f_rid OR pos <> f_pos").select("id", "rid", F.array("pos").alias("gone"))
    # the spans to take out, gathered for each text: at most a few for each of its own sentences
    gone = later.unionByName(again.where("h IS NULL").select("id", "rid", "gone")).groupBy("id", "rid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("__gone"))
    gone = materialize(gone, "gone")
    at = docs.columns.index(text)
    width = len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drop = b.column(width).to_pylist()
            cols = list(b.columns[:width])
            cols[at] = _without(cols[at], {i: x for i, x in enumerate(drop) if x})
            yield pa.RecordBatch.from_arrays(cols, names)

    names = docs.columns
    safe = docs.toDF(*[f"__c{i}" for i in range(width)])
    own = f"__c{docs.columns.index(key)}"
    keyed = safe.withColumn("id", ident(own)).withColumn("rid", F.xxhash64(F.col(own).cast("string"), F.col(f"__c{at}")))
    joined = keyed.join(gone.hint("shuffle_hash"), ["id", "rid"], "left").select(*safe.columns, "__gone")
    return joined.mapInArrow(tidy(cut), docs.schema)


BITS = 1 << 23


def _bits(h: DataFrame) -> bytes:
    """BITS bytes with a bit for each hash's low bits; a fixed size, false hits only let more rows through."""
    return merge_bits(h, BITS, lambda x: x.to_numpy(zero_copy_only=False) & (8 * BITS - 1))
