"""What the operators of this subpackage share: written intermediate tables, Arrow text kernels, hashing.

A word is a run of bytes other than the six ASCII white-space bytes; since these never occur inside a
multi-byte UTF-8 sequence, splitting bytes and splitting characters agree, so all text kernels work on
the UTF-8 buffers of whole Arrow batches and never touch single Python strings.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of text that one kernel call works on; bounds the NumPy temporaries of a task.
CHUNK_BYTES = 2 << 20
#: A key with more than rows / HOT_SHARE rows counts as hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 2000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this Python worker keeps between the tasks of an operator. Workers are reused, so one that goes on to another operator
    lets go of what the last one kept, and gives the memory that its tasks have left back to the system."""
    if operator not in _KEPT:
        _KEPT.clear()
        _KEPT[operator] = {}
        release()
    return _KEPT[operator]


def release() -> None:
    """Give memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """run, an Arrow batch function, whose worker gives memory back when the task ends; idle workers then hold little."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session; a folder of our own only where it is unset and the master is one
    machine. On a cluster without the setting this is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]+(,[^\]]+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        where = getattr(spark.sparkContext, "_vecshift_dir", None)
        if where is None:
            where = spark.sparkContext._vecshift_dir = tempfile.mkdtemp(prefix="vecshift-")
    return where.rstrip("/")


#: A written table of narrow rows whose number is known gets a file for this many of them, and a few more.
FILE_ROWS, FILES = 200_000, 12


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors. rows: a bound of the
    number of rows, if known; their table is then written in as many files as it takes, not in one for each shuffle partition."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(FILES + rows // FILE_ROWS)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecshift_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `materialize` that no later job reads."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._vecshift_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that one task turns into bits.
BIT_ROWS = 20_000_000


def merge_bits(ids: DataFrame, size: int, place) -> bytes:
    """A set of size bytes with a bit at place(ids) for each row of a one-column written table. Every task hands on one bit set;
    their number follows the rows, and they are merged part by part."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(8 * size, bool)
        for b in batches:
            bits[place(b.column(0))] = True
        full = np.packbits(bits, bitorder="little").reshape(256, -1)
        for k in np.flatnonzero(full.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([full[k].tobytes()], pa.binary())], ["k", "v"])

    def join(t: pa.Table) -> pa.Table:
        v = np.zeros(size // 256, np.uint8)
        for x in t["v"]:
            v |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"k": pa.array([t["k"][0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    out = np.zeros((256, size // 256), np.uint8)
    parts = ids.coalesce(16 + ids.count() // BIT_ROWS).mapInArrow(tidy(collect), "k int, v binary")
    for r in parts.groupBy("k").applyInArrow(join, "k int, v binary").collect():  # at most 256 rows, size bytes
        out[r.k] = np.frombuffer(bytes(r.v), np.uint8)
    return out.tobytes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, m: int):
    """crc32 of the id's decimal text, modulo m; -1 for a null id."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % m, F.lit(-1))


# ---------------------------------------------------------------- Arrow text kernels

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi at a time with at most about limit bytes (one row at least): lo, hi, bytes, offsets."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: start bytes, end bytes, and for each row the number of its first word (one entry more)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    b, e = off[:-1][full], off[1:][full] - 1
    first[b] = inside[b]
    last[e] = inside[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 512


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span (A-Z lower-cased): eight bytes at a time are mixed into the state of all spans that have them.
    A step isn't linear in what it takes in, so no pattern of letters makes spans alike."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    own = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", own, strides=(1,))  # the eight bytes from each place on
    size = (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        live, at, left = np.arange(len(starts)), starts, size
        while len(live):
            word = eight[at]
            short = left < 8
            word[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[live] = mix(h[live] * _MULT[4] ^ word)
            more = (left > 8) & (size[live] <= LONG_SPAN)
            live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(own[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


_MULT = np.array([0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words of one row's word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = np.full(m, n, np.uint64)
        for k in range(n):
            x = x * _MULT[4] + h[k : k + m] * _MULT[k % 4]
            x ^= x >> np.uint64(29)
    return mix(x)


def bounded_map(spark: SparkSession, table_df: DataFrame, hot_rows: DataFrame, full: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """full joined with table_df on key: the rows with hot keys by a broadcast of the hot_rows part of the table
    (fewer than HOT_SHARE rows by construction), all others by a shuffle in which no key is hot."""
    hot = F.broadcast(hot_rows)
    return full.join(hot, key, "left_semi").join(hot, key).unionByName(full.join(hot, key, "left_anti").join(table_df, key, how))


def root_env() -> str:
    return os.environ.get("PYTHONPATH", "")
