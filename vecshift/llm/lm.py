"""Language-model scoring with a log-frequency Bloom filter that holds quantised counts of word pairs.

Counting: documents are dealt into chunks of CHUNK bytes of text and written once. Each chunk hands on, for each hash
bucket, its distinct words and pairs with their counts in the training part, as one compressed block; buckets follow the
number of input partitions, so each is merged in bounded memory.

Filter: a pair of count level q (two levels for each doubling) is held as q members (pair, 1) .. (pair, q); its level is read
back by repeated membership probes, (pair, 1), (pair, 2), ... up to the first that is not held. The filter consists of segments by the
pair's leading bits, of BITS for each member; their number follows the bytes of text alone, so scores don't depend on how rows are dealt.
A corpus of T bytes in R rows has at most (T + 3 R) / 2 pairs and one and a half members for each; while a filter of
so many members is below SHIPPED bytes, its segments are written, gathered and broadcast to the workers, which probe them
chunk by chunk. Beyond that nothing is broadcast: a bucket's segments are probed where they were built, for the distinct pairs that the
chunks sent there. Both ways give equal scores, and all pairs are held, however rare. A probe is false with a probability of about
a hundredth; so an unseen pair may count as seen once, and a level may come out one higher. Levels are never too low.

Probability of word w after u: (1 - l) * base(w) + l * count(u, w) / count(u), with the smallest count of the pair's level, so
probabilities sum to no more than one but for false probes. l depends on the level of count(u); it comes from one
expectation step over all training tokens with their own occurrence taken out, of the pair, the word and the context.

Base: exact unigram probabilities; the words' counts are exact and come back by the same buckets.

Edge cases: a null text is empty and has one token, the end. With no training rows every count is 0 (N = 0, V = 0) and
both scores are n_tokens * log10(0.1 / 0.1) = 0. A null id falls in the training part. Repeated rows are scored one
by one. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, crc_mod, discard, hashes, materialize, mix, pieces, ready, spans

#: Bits of the filter for each member, membership bits, and bits of the line that holds all of a member's bits.
BITS, PROBES, LINE, LEVELS = 12, 7, 512, 96
#: Bytes of text that are looked up at a time (one document at least).
CHUNK = 1 << 20
#: Bytes of text for each segment of the filter, and the most bytes of a filter that is broadcast.
SEGMENT, SHIPPED = 1 << 19, 64 << 20
TRAIN, SCORE, HELD = 1, 2, 4
END, BEGIN = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0xBE61BE61BE61BE61)


def level(c) -> np.ndarray:
    """1 for a count of 1, two levels for each doubling."""
    return 1 + np.floor(2 * np.log2(np.maximum(c, 1)) + 1e-9).astype(np.int64)


def low(q):
    """The smallest count of a level."""
    return np.ceil(2.0 ** ((np.asarray(q) - 1) / 2) - 1e-9)


def tokens(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for _, _, d, o in pieces(data, off):
        s, e, first = spans(d, o)
        h = hashes(d, s, e)
        rows = len(o) - 1
        edge = first + np.arange(rows + 1)
        tok = np.empty(len(h) + rows, np.uint64)
        where = np.ones(len(tok), bool)
        where[edge[1:] - 1] = False
        tok[where] = h
        tok[~where] = END
        prev = np.empty_like(tok)
        prev[1:] = tok[:-1]
        prev[edge[:-1]] = BEGIN
        yield tok, prev, edge


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(u * np.uint64(0x9FB21C651E98DF25) + (w ^ (w >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFFFFFF0000)


def _code(x: np.ndarray) -> bytes:
    """The non-empty byte planes of ascending numbers' gaps (or of counts), after a byte that tells which they are."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = planes.any(1)
    used[0] |= not used.any()
    return np.packbits(used).tobytes() + planes[used].tobytes()


def _read(v: bytes) -> np.ndarray:
    used = np.unpackbits(np.frombuffer(v[:1], np.uint8)).astype(bool)
    got = np.frombuffer(v, np.uint8, offset=1).reshape(int(used.sum()), -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, used] = got.T
    return out.view("<u8").ravel()


class Segment:
    """A part of the filter: level q of a key as members 1 .. q, each within one line of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.lines = bits, np.uint64(8 * len(bits) // LINE)

    @classmethod
    def of(cls, key: np.ndarray, q: np.ndarray, bits: int = BITS) -> Segment:
        lines = -(-max(1, bits * int(q.sum())) // LINE)
        out, full = cls(np.empty(lines * LINE // 8, np.uint8)), np.zeros(lines * LINE, bool)
        for j in range(1, int(q.max(initial=0)) + 1):
            for at in out._places(key[q >= j], j):
                full[at] = True
        out.bits = np.packbits(full, bitorder="little")
        return out

    def _places(self, key: np.ndarray, j: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            m = mix(key + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j))
            line = (((m >> np.uint64(32)) * self.lines) >> np.uint64(32)) * np.uint64(LINE)
            r = mix(m)
        for i in range(PROBES):
            yield (line + ((r >> np.uint64(9 * i)) & np.uint64(LINE - 1))).view(np.int64)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes; 0 for keys that are not held."""
        out, left, j = np.zeros(len(key), np.int64), np.arange(len(key)), 1
        while len(left) and j < LEVELS:
            held = np.ones(len(left), bool)
            for at in self._places(key[left], j):
                held &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)
            left = left[held]
            out[left] = j
            j += 1
        return out


def by_segment(h: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """The segments of ascending keys."""
    number = h >> np.uint64(shift)
    cut = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(h)]
    for i, j in zip(cut, cut[1:], strict=False):
        if i < j:
            yield int(number[i]), slice(i, j)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, role, text) as chunks: number, ids, roles, bytes and offsets of the texts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for b in batches:
        data, off = buffers(b.column(2))
        role = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for lo, hi, d, o in pieces(data, off, CHUNK):
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column(0).slice(lo, hi - lo))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (role[lo:hi], d, o)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *blobs], ["chunk", "ids", "role", "data", "off"])
            number += 1


def _chunk_tokens(data: bytes, off: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's tokens, pairs, and the rows' token offsets."""
    tok, both, edge = [], [], [np.zeros(1, np.int64)]
    for t, prev, e in tokens(np.frombuffer(data, np.uint8), np.frombuffer(off, np.int64)):
        tok.append(t)
        both.append(pair(prev, t))
        edge.append(e[1:] + edge[-1][-1])
    return np.concatenate(tok), np.concatenate(both), np.concatenate(edge)


def chunk_blocks(buckets: int):
    """The distinct words (kind 0) and pairs (kind 1) of each chunk by bucket, with their counts in its training rows."""
    shift = np.uint64(64 - int(math.log2(buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one chunk at a time in memory
                number, role, data, off = (b.column(i)[k].as_py() for i in range(4))
                tok, both, edge = _chunk_tokens(data, off)
                learn = np.repeat(np.frombuffer(role, np.uint8) & TRAIN > 0, np.diff(edge))
                for kind, x in ((0, tok), (1, both)):
                    h, at = np.unique(x, return_inverse=True)
                    c = np.bincount(at[learn], minlength=len(h))
                    cut = np.searchsorted(h >> shift, np.arange(buckets + 1))
                    own = [(n, _code(np.diff(h[i:j], prepend=np.uint64(0))), _code(c[i:j])) for n, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]
                    n, hs, cs = zip(*own, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), pa.array(n, pa.int32()), pa.array([number] * len(n)), pa.array(hs, pa.binary()), pa.array(cs, pa.binary())], ["kind", "bucket", "chunk", "h", "c"])

    return run


def _answer(t: pa.Table, bits: int, shift: int, ship: bool) -> pa.Table:
    """One bucket's answer to each chunk: exact counts of its words, levels of its pairs from the bucket's segments of the
    filter; the first row carries the bucket's sums. Where the filter is shipped, the segments themselves (chunk -1)."""
    kind = t["kind"][0].as_py()
    keys = [np.cumsum(_read(v.as_py()), dtype=np.uint64) for v in t["h"]]
    h, at = np.unique(np.concatenate(keys), return_inverse=True)
    value = c = np.bincount(at, np.concatenate([_read(v.as_py()) for v in t["c"]]), len(h)).astype(np.int64)
    bucket, chunk = t["bucket"].to_pylist(), t["chunk"].to_pylist()
    if kind:
        value, made = np.zeros(len(h), np.int64), []
        for number, part in by_segment(h, shift):
            own, q = h[part], np.minimum(level(c[part]), LEVELS - 1)
            seen = c[part] > 0
            segment = Segment.of(own[seen], q[seen], bits)
            if ship:
                made.append((number, segment.bits.tobytes()))
            else:
                value[part] = segment.levels(own)
        if ship:
            bucket, told = (list(x) for x in zip(*made, strict=True))
            chunk = [-1] * len(made)
    if not (kind and ship):
        cut = np.cumsum([0, *map(len, keys)])
        told = [_code(value[at[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    rest = [0] * (len(told) - 1)
    sums = [int(c.sum()), int((c > 0).sum()), 0 if kind else int(c[h == END].sum())]
    cols = {"kind": pa.array([kind] * len(told), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "told": pa.array(told, pa.binary())}
    return pa.table(cols | {n: pa.array([x, *rest], pa.int64()) for n, x in zip(("total", "size", "ends"), sums, strict=True)})


_LOW = low(np.arange(LEVELS))


def _terms(c: np.ndarray, q: np.ndarray, edge: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' counts rounded down and the contexts' counts, from the tokens' counts and the pairs' levels."""
    up = np.empty(len(c), np.int64)
    up[1:] = c[:-1]
    up[edge[:-1]] = rows
    return np.where(q > 0, np.minimum(_LOW[q], up), 0), up


def _levels(up: np.ndarray) -> np.ndarray:
    return np.where(up > 0, np.minimum(level(up), LEVELS - 1), 0)


def score_texts(docs: DataFrame, train_on=None, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. train_on: a condition on docs or a table of texts;
    by default the rows that are not held out."""
    spark = ready(docs.sparkSession)
    held_out = crc_mod(F.col(key), 10) == 0
    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    role = F.when(held_out, HELD + SCORE).otherwise(SCORE)
    learn = ~held_out if train_on is None else train_on if not isinstance(train_on, DataFrame) else F.lit(False)
    role = role + F.when(learn, TRAIN).otherwise(0)
    rows_in = docs.select(F.col(key).alias("doc_id"), role.alias("role"), F.col(text).alias("text"))
    if isinstance(train_on, DataFrame):
        rows_in = rows_in.unionByName(train_on.select(F.lit(None).cast(kind).alias("doc_id"), F.lit(TRAIN).alias("role"), F.col(text).alias("text")))
    buckets = 2 << math.ceil(math.log2(max(1, rows_in.rdd.getNumPartitions())))  # an input partition's n-grams each, at any size
    parts = materialize(rows_in.mapInArrow(chunks, f"chunk long, ids array<{kind}>, role binary, data binary, off binary"), "lm_chunks")
    held = parts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("size", F.length("data")), ("rows", F.size("ids")))]).first()
    segments = 2 << math.ceil(math.log2(max(1, held["size"] / SEGMENT)))
    buckets, shift = min(buckets, segments), 64 - (segments.bit_length() - 1)
    ship = bits / 8 * 1.5 * (held["size"] + 3 * held["rows"]) / 2 + segments * LINE / 8 <= SHIPPED
    blocks = parts.select("chunk", "role", "data", "off").mapInArrow(chunk_blocks(buckets), "kind int, bucket int, chunk long, h binary, c binary")
    answers = materialize(blocks.groupBy("kind", "bucket").applyInArrow(lambda t: _answer(t, bits, shift, ship), "kind int, bucket int, chunk long, told binary, total long, size long, ends long"), "lm_answers")
    whole = spark.sparkContext.broadcast({r.bucket: bytes(r.told) for r in answers.where("chunk = -1").select("bucket", "told").toLocalIterator()}) if ship else None  # SHIPPED bytes at most
    s = answers.where("kind = 0").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "size", "ends")]).first()
    total, ends, norm = s.total, s.ends, s.total + 0.1 * (s["size"] + 1)
    base = lambda c: (c + 0.1) / norm

    def look_up(mine: pa.Table, told: pa.Table) -> pa.Table:
        """A chunk's counts by token, and what its training rows tell about the weights."""
        ids, role, data, off = (mine[c][0] for c in ("ids", "role", "data", "off"))
        tok, both, edge = _chunk_tokens(data.as_py(), off.as_py())
        got = [[], []]
        told = told.sort_by("bucket")
        for k, v in zip(told["kind"].to_pylist(), told["told"], strict=True):
            got[k].append(_read(v.as_py()))
        if whole is not None:
            pairs = np.unique(both)
            got[1] = [Segment(np.frombuffer(whole.value[k], np.uint8)).levels(pairs[part]) for k, part in by_segment(pairs, shift)]
        c, q = (np.concatenate(v)[np.unique(x, return_inverse=True)[1]].astype(np.int64) for v, x in zip(got, (tok, both), strict=True))
        n, up = _terms(c, q, edge, ends)
        learn = np.repeat(np.frombuffer(role.as_py(), np.uint8) & TRAIN > 0, np.diff(edge))
        n, up, w = n[learn], up[learn] - 1, base(c[learn] - 1)
        a, at = np.maximum(n - 1, 0) / np.maximum(up, 1), _levels(up)
        sums = [np.bincount(at, x, LEVELS).astype(float) for x in (a / (a + w), np.ones(len(a)))]
        cols = [pa.array([x], pa.binary()) for x in (role.as_py(), edge.tobytes(), _code(c), q.astype(np.uint8).tobytes())]
        return pa.table([mine["ids"].combine_chunks(), *cols, *[pa.array([x.tolist()]) for x in sums]], ["ids", "role", "edge", "c", "q", "win", "n"])

    both = parts.groupBy("chunk").cogroup(answers.where("chunk >= 0").select("kind", "bucket", "chunk", "told").groupBy("chunk"))
    found = materialize(both.applyInArrow(look_up, f"ids array<{kind}>, role binary, edge binary, c binary, q binary, win array<double>, n array<double>"), "lm_counts")
    discard(parts)
    discard(answers)
    weight = np.zeros(LEVELS)
    sums = found.select(F.posexplode(F.arrays_zip("win", "n")).alias("k", "z")).groupBy("k").agg(F.sum("z.win").alias("w"), F.sum("z.n").alias("n"))
    for r in sums.collect():  # LEVELS rows
        weight[r.k] = min(r.w / r.n, 0.99) if r.k and r.n else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                role, edge, c, q = (b.column(i)[k].as_py() for i in range(1, 5))
                role, edge = np.frombuffer(role, np.uint8), np.frombuffer(edge, np.int64)
                c, q = _read(c).astype(np.int64), np.frombuffer(q, np.uint8)
                n, up = _terms(c, q, edge, ends)
                w, p = weight[_levels(up)], base(c)
                total_of = lambda y: np.add.reduceat(y, edge[:-1])  # noqa: E731, B023
                own = pa.array(role & SCORE > 0)
                cols = [b.column(0)[k].values, pa.array(role & HELD > 0), pa.array(np.diff(edge)), pa.array(total_of((c > 0).astype(np.int64))), pa.array(total_of(np.log10(p))), pa.array(total_of(np.log10((1 - w) * p + w * n / np.maximum(up, 1))))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]).filter(own)

    out = found.select("ids", "role", "edge", "c", "q").mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
