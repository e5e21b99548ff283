"""Text encoders as Arrow-batched functions and as a pure SQL feature hash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


class EmbeddingModel:
    """Extension point: a picklable object with a dimension, a fingerprint and a batch `encode`."""

    dimension: int
    name = "model"

    def encode(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def fingerprint(self) -> str:
        return hashlib.sha256(f"{self.name}|{self.dimension}".encode()).hexdigest()


class HashModel(EmbeddingModel):
    """Mean of one seeded Gaussian vector per token, L2-normalised; texts without tokens are one fixed vector."""

    name = "hash"

    def __init__(self, dimension: int = 64, seed: int = 42):
        self.dimension, self.seed, self._rows = dimension, seed, {}

    def _row(self, token: str) -> np.ndarray:
        if token not in self._rows:
            if len(self._rows) > 200_000:
                self._rows.clear()
            h = hashlib.sha256(f"{self.seed}:{token}".encode()).digest()
            self._rows[token] = np.random.default_rng(int.from_bytes(h[:8], "big")).standard_normal(self.dimension)
        return self._rows[token]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            tokens = _TOKEN.findall((t or "").lower()) or [""]
            out[i] = np.mean([self._row(x) for x in tokens], axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def __getstate__(self):
        return {"dimension": self.dimension, "seed": self.seed, "_rows": {}}


class FeatureHashModel(EmbeddingModel):
    """The vectors of `feature_hash`: of each token's count, by one bit of its SHA-256 positive or negative, in the slot that
    further bits name; unit length. A text without tokens, or whose tokens cancel out, is the zero vector."""

    name = "feature-hash"

    def __init__(self, dimension: int = 16):
        self.dimension, self._slots = dimension, {}

    def _slot(self, token: str) -> tuple[int, int]:
        if token not in self._slots:
            if len(self._slots) > 200_000:
                self._slots.clear()
            h = hashlib.sha256(token.encode()).hexdigest()
            self._slots[token] = int(h[:8], 16) % self.dimension, 1 if int(h[8], 16) < 8 else -1
        return self._slots[token]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for slot, sign in map(self._slot, _TOKEN.findall((t or "").lower())):
                out[i, slot] += sign
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def __getstate__(self):
        return {"dimension": self.dimension, "_slots": {}}


def encode(docs: DataFrame, model: EmbeddingModel, key: str = "doc_id", text: str = "text", batch: int = 512) -> DataFrame:
    """key, v: one Arrow batch at a time; rows stay in their partitions."""
    from vecshift.operators.retrieval import ship

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                yield pd.DataFrame({key: part[key], "v": list(model.encode(part[text].fillna("").tolist()))})

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, v array<double>")


def encode_rows(docs: DataFrame, model: EmbeddingModel, key: str = "doc_id", text: str = "text", batch: int = 512) -> DataFrame:
    """All columns of docs but the text, with v and error. What can't be encoded is a row with an error and no vector: a text that is null,
    a document that the model fails on by itself, a vector that isn't finite or has another dimension. Errors name the
    kind of fault, never the text."""
    from vecshift.operators.retrieval import ship

    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema) + ", v array<double>, error string"

    def tried(texts: list[str]) -> list[tuple]:
        try:
            found = np.asarray(model.encode(texts), np.float64)
            if found.shape != (len(texts), model.dimension):
                raise ValueError("shape")
            return [(v, None) if np.isfinite(v).all() else (None, "vector is not finite") for v in found]
        except Exception as e:  # a model may fail in any way; one document must not take the others along
            if len(texts) == 1:
                return [(None, f"{type(e).__name__} during encoding")]
            return tried(texts[: len(texts) // 2]) + tried(texts[len(texts) // 2 :])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                given = part[text].tolist()
                some = [i for i, t in enumerate(given) if isinstance(t, str)]
                got: list[tuple] = [(None, "document text is unavailable")] * len(given)
                for i, x in zip(some, tried([given[i] for i in some]) if some else [], strict=True):
                    got[i] = x
                yield part[rest].assign(v=pd.Series([x[0] for x in got], index=part.index, dtype=object), error=pd.Series([x[1] for x in got], index=part.index, dtype=object))

    return docs.select(*rest, text).mapInPandas(run, out)


def encode_missing(docs: DataFrame, cache: DataFrame, model: EmbeddingModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the documents that the cache does not hold for this model and content, each once; a repeated run finds nothing to do.
    What can't be encoded is left out."""
    return attempts(docs, cache, model, key, text).where("error IS NULL").drop("error")


def attempts(docs: DataFrame, cache: DataFrame, model: EmbeddingModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, v, error, content_fingerprint, model_fingerprint of the documents that the cache does not hold."""
    fp = model.fingerprint()
    have = cache.where(F.col("model_fingerprint") == fp).select(F.col(key).alias("__k"), F.col("content_fingerprint").alias("__c"))
    todo = docs.select(key, text, F.sha2(F.col(text), 256).alias("content_fingerprint")).dropDuplicates([key, "content_fingerprint"])
    todo = todo.join(have, (F.col(key) == F.col("__k")) & (F.col("__c").isNull() | (F.col("__c") == F.col("content_fingerprint"))), "left_anti")
    return encode_rows(todo, model, key, text).select(key, "v", "error", "content_fingerprint", F.lit(fp).alias("model_fingerprint"))


def feature_hash(docs: DataFrame, dimension: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, slot, weight: signed feature hashing in SQL alone. A token adds +1 or -1 (by one bit of its SHA-256) to the slot
    that further bits name; weights are L2-normalised for each text."""
    tokens = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("n"))
    h = F.sha2("t", 256)
    slot = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dimension
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)
    w = tokens.groupBy(key, slot.cast("int").alias("slot")).agg(F.sum(sign * F.col("n")).alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum((F.col("w") * F.col("w")).cast("double")).over(Window.partitionBy(key)))  # at most `dimension` rows a key
    return w.select(key, "slot", F.round(F.col("w") / norm, 9).alias("weight"))
