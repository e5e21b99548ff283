"""Language identification, words first, with backoff to character n-grams.

A known word adds its log frequency in each language. An unseen word adds the mean log frequency of its known
character n-grams of the longest length of which it has any (ORDER down to 1, with word boundaries marked). The model
is fitted on labelled rows: all of them, or a sample by hash of the id of about SAMPLE_ROWS rows (the documented
bound), dealt evenly over the languages, so that all rows of a rare one are learned from. All words and n-grams of the sample are held.

Edge cases: a null text, and one without any letter, is `und` with score 0; so is every text if there is nothing to
learn from. A text all of whose words are unknown in every length gets the most frequent language, with score
1 / languages. Ties go to the language that sorts first. An empty table gives an empty result; extra columns are
ignored by `language_id` and kept by `keep_identified`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, crc_mod, hashes, kept, ready, tidy

SAMPLE_ROWS, ORDER = 10_000, 4
CACHE_WORDS = 200_000
#: Words that count in full; in longer texts every word counts for less, so that the score stays a graded one.
FULL_WORDS = 12
_WORD = re.compile(r"[^\W\d_]+")


def _parts(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _hash(grams: pa.Array) -> np.ndarray:
    data, off = buffers(grams)
    return hashes(data, off[:-1], off[1:], lower=False)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, c); n = 0 for words."""
    kept("language")
    for b in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        rows: Counter = Counter()
        for lang, c in words.items():
            for w, k in c.items():
                rows[lang, 0, w] += k
                for n in range(1, ORDER + 1):
                    for g in _parts(w, n):
                        rows[lang, n, g] += k
        if rows:
            lang, n, g = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(n, pa.int32()), pa.array(g), pa.array(rows.values(), pa.int64())], ["lang", "n", "gram", "c"])


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_ROWS) -> dict:
    """A model of bounded size from labelled rows (rows with null text or language are left out): the languages, the words and
    n-grams of each length as Arrow arrays in the order of their hashes, these hashes, a row of log frequencies for each of them, and
    the most frequent language."""
    rows = ready(labelled.sparkSession) and labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    size = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}  # a row for each language
    quota, line = sample / max(1, len(size)), F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit(""))), F.lit(1 << 30))
    if over := {x: int(quota / n * (1 << 30)) for x, n in size.items() if n > quota}:
        most = F.create_map(*[F.lit(y) for x in over.items() for y in x])
        rows = rows.where(line < F.coalesce(F.get(F.map_values(F.map_filter(most, lambda k, _: k == F.col("l"))), F.lit(0)), F.lit(1 << 30)))
    counts = rows.select("l", "t").mapInArrow(tidy(_counts), "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    found = counts.toArrow().combine_chunks()  # the sample's own words and n-grams: bounded by SAMPLE_ROWS
    langs = sorted(found["lang"].unique().to_pylist())
    lang, n, c = pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy(), found["n"].to_numpy(), found["c"].to_numpy()
    grams, keys, logs = [], [], []
    for k in range(ORDER + 1):
        mine = np.flatnonzero(n == k)
        coded = found["gram"].take(pa.array(mine)).combine_chunks().dictionary_encode()
        count = np.zeros((len(coded.dictionary), len(langs)))
        count[coded.indices.to_numpy(), lang[mine]] = c[mine]
        h = _hash(coded.dictionary)
        order = np.argsort(h, kind="stable")
        grams.append(coded.dictionary.take(pa.array(order)))
        keys.append(h[order])
        logs.append(np.log10((count[order] + 0.5) / (count.sum(0) + 0.5 * 1e5)))
    common = max(range(len(langs)), key=lambda i: (size[langs[i]], -i), default=0)
    return {"langs": langs, "grams": grams, "keys": keys, "logs": np.concatenate(logs), "common": common}


class Scorer:
    """Scores batches of texts with a model; keeps the rows of words it has met, at most about CACHE_WORDS of them."""

    def __init__(self, model: dict):
        self.langs, self.n, self.common = model["langs"], len(model["langs"]), model["common"]
        self.grams, self.keys, self.logs = model["grams"], model["keys"], model["logs"]
        self.start = np.cumsum([0, *map(len, self.keys)])  # by n-gram length (0: words) where its rows in self.logs begin
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1 << 16, self.n + 1))  # the last column: 1 if the word has a letter

    def _find(self, grams: list[str], n: int) -> np.ndarray:
        """The row in self.logs of each gram of this length, -1 where it is not known: by hash, then by the gram itself."""
        if not grams or not len(self.keys[n]):
            return np.full(len(grams), -1)
        asked = pa.array(grams, self.grams[n].type)
        h = _hash(asked)
        p = np.minimum(np.searchsorted(self.keys[n], h), len(self.keys[n]) - 1)
        same = pc.equal(self.grams[n].take(pa.array(p)), asked).to_numpy(zero_copy_only=False)
        return np.where(same, self.start[n] + p, -1)

    def _learn(self, words: list[str]) -> None:
        """A word's row is that of the word itself, or the mean over its known n-grams of the longest length of which it has any."""
        lo, hi = len(self.row), len(self.row) + len(words)
        if hi > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(hi, len(self.rows)), self.n + 1))])
        left = np.arange(len(words))
        for n in (0, *range(ORDER, 0, -1)):
            parts = [[words[i]] if n == 0 else _parts(words[i], n) for i in left]
            owner = np.repeat(left, np.fromiter(map(len, parts), np.int64, len(parts)))
            found = self._find([g for x in parts for g in x], n)
            owner, found = owner[found >= 0], found[found >= 0]
            some, start, size = np.unique(owner, return_index=True, return_counts=True)
            if len(some):
                self.rows[lo + some, :-1] = np.add.reduceat(self.logs[found], start, axis=0) / size[:, None]
            left = np.setdiff1d(left, some, assume_unique=True)
        self.rows[lo:hi, -1] = [w.isalpha() or any(map(str.isalpha, w)) for w in words]
        self.row.update(zip(words, range(lo, hi), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.n:
            return [("und", 0.0)] * len(texts)
        counts = [Counter(_WORD.findall(t.lower())) if t else {} for t in texts]
        used = set().union(*counts) if counts else set()
        new = used - self.row.keys()
        if len(self.row) + len(new) > CACHE_WORDS:
            self._reset()
            new = used
        if new:
            self._learn(list(new))
        size = np.fromiter(map(len, counts), np.int64, len(counts))
        total = int(size.sum())
        at = np.fromiter((self.row[w] for c in counts for w in c), np.int64, total)
        n = np.fromiter((k for c in counts for k in c.values()), float, total)
        out, some = [("und", 0.0)] * len(texts), np.flatnonzero(size)
        if not len(some):
            return out
        sums = np.add.reduceat(self.rows[at] * n[:, None], (np.cumsum(size) - size)[some], axis=0)
        words = sums[:, -1]
        s = sums[:, :-1] * np.minimum(1.0, FULL_WORDS / np.maximum(words, 1))[:, None]
        p = np.exp((s - s.max(1, keepdims=True)) * math.log(10))
        p /= p.sum(1, keepdims=True)
        best = np.where(s.any(1), p.argmax(1), self.common)
        for k, i in enumerate(some.tolist()):
            if words[k]:
                out[i] = (self.langs[best[k]], float(p[k, best[k]]))
        return out


def _predict(model, keep_from: float | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language")
        score = Scorer(model.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                found = score(b.column(at).to_pylist())
                if keep_from is not None:
                    yield b.filter(pa.array([x != "und" and s >= keep_from for x, s in found], pa.bool_()))
                else:
                    lang, s = zip(*found, strict=True) if found else ((), ())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(s, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, train: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score. train: which rows may be learned from; by default those whose crc32 of the
    id modulo 3 is not 1."""
    held = crc_mod(F.col(key), 3) == 1
    spark = ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs.where(~held if train is None else train), key, text, lang))
    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), F.col(text)).mapInArrow(tidy(_predict(model, None, 2)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose language is identified with at least this score, with all their columns."""
    spark = ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, key, text, lang))
    return docs.mapInArrow(tidy(_predict(model, least, docs.columns.index(text))), docs.schema)
