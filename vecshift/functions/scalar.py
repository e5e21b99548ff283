"""Scalar functions of the engine as Column expressions (all JVM-side)."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of vector metrics (fixed values).
METRICS = {
    "cosine": "cosine",
    "cos": "cosine",
    "dot": "dot",
    "dotproduct": "dot",
    "dot_product": "dot",
    "ip": "dot",
    "inner_product": "dot",
    "l2": "l2",
    "euclidean": "l2",
    "squared_l2": "squared_l2",
}
#: Model names in lower case that stand for one canonical name (fixed values).
MODELS = {
    "minilm_l6": "sentence-transformers/all-MiniLM-L6-v2",
    "minilm-l6": "sentence-transformers/all-MiniLM-L6-v2",
    "minilm-l6-v2": "sentence-transformers/all-MiniLM-L6-v2",
    "sentence-transformers/all-minilm-l6-v2": "sentence-transformers/all-MiniLM-L6-v2",
    "qwen3-0.6b": "Qwen/Qwen3-Embedding-0.6B",
    "qwen3_0_6b": "Qwen/Qwen3-Embedding-0.6B",
    "qwen/qwen3-embedding-0.6b": "Qwen/Qwen3-Embedding-0.6B",
    "qwen3-4b": "Qwen/Qwen3-Embedding-4B",
    "qwen3_4b": "Qwen/Qwen3-Embedding-4B",
    "qwen/qwen3-embedding-4b": "Qwen/Qwen3-Embedding-4B",
    "qwen3-8b": "Qwen/Qwen3-Embedding-8B",
    "qwen3_8b": "Qwen/Qwen3-Embedding-8B",
    "qwen/qwen3-embedding-8b": "Qwen/Qwen3-Embedding-8B",
}
#: Names of model families, which any model name that holds them belongs to (fixed values).
FAMILIES = ["minilm", "qwen3"]
#: Parts of names of environment variables that hold secrets, patterns of secrets in free text, what replaces them, and how much
#: of a text is kept (fixed values).
SECRET_NAMES = ("KEY", "TOKEN", "PASSWORD", "SECRET", "DSN")
SECRETS = [
    (r"(?i)(api[_-]?key|token|password|secret)=([^\s,;]+)", "$1=<redacted>"),
    (r"(?i)(://[^:/\s]+:)[^@/\s]+(@)", "$1<redacted>$2"),
]
REDACTED, REDACTED_CHARS = "<redacted>", 2000


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (z, x) -> z + x)")


def norm(a: str) -> Column:
    return F.expr(f"sqrt(aggregate({a}, 0D, (z, x) -> z + cast(x as double) * x))")


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (z, x) -> z + x))")


def unit(a: str) -> Column:
    """L2-normalised copy; the norm is computed once per row."""
    return F.expr(f"element_at(transform(array(sqrt(aggregate({a}, 0D, (z, x) -> z + cast(x as double) * x))), n -> transform({a}, x -> cast(x as double) / n)), 1)")


def vector_ok(a: str, dim: int) -> Column:
    """One-dimensional, of this dimension, finite, no nulls."""
    return F.expr(f"coalesce(size({a}) = {dim} AND NOT exists({a}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')), false)")


def similarity(metric: str, value: Column, backend: str = "exact") -> Column:
    """A backend's raw distance or score as a number where higher is better."""
    m = METRICS[metric.lower()]
    if backend == "pgvector":
        return 1 - value if m == "cosine" else -value
    if backend == "pinecone":
        return -value * value if m == "l2" else value
    if backend == "milvus":
        return -value if m in ("l2", "squared_l2") else value
    if backend == "weaviate":
        return -value
    return -value if m in ("l2", "squared_l2") else value


def metric_name(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in METRICS.items()], F.lit("unknown"))


def canonical_model(c: Column) -> Column:
    """The canonical name of a model; a name without one stands for itself."""
    names = F.create_map(*[F.lit(x) for p in MODELS.items() for x in p])
    return F.coalesce(names[F.lower(F.trim(c))], F.trim(c))


def model_family(c: Column) -> Column:
    """The family a model name holds; a name without a family is one of its own."""
    name = F.replace(F.replace(F.lower(c), F.lit("embedding"), F.lit("")), F.lit("sentence-transformers/"), F.lit(""))
    out = name
    for family in reversed(FAMILIES):
        out = F.when(name.contains(family), family).otherwise(out)
    return out


def hash_unit(seed: int, c: Column) -> Column:
    """First 64 bits of SHA-256 of "seed:id" as an exact integer below 2^64."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def sampled(seed: int, c: Column, rate: float) -> Column:
    """Deterministic sampling: the hash fraction lies below the rate."""
    return hash_unit(seed, c) < F.lit(str(int(rate * (1 << 64)))).cast("decimal(20,0)")


def seconds(c: Column) -> Column:
    """Durations such as 90, 90s, 1.5h, 24H, 2d, 1w in seconds (a bare number is seconds); null where malformed."""
    x, form = F.lower(F.trim(c)), r"^(\d+(?:\.\d+)?)([smhdw]?)$"
    n, u = F.regexp_extract(x, form, 1), F.regexp_extract(x, form, 2)
    size = F.when(u == "m", 60).when(u == "h", 3600).when(u == "d", 86400).when(u == "w", 604800).otherwise(1)
    return F.when(n != "", n.cast("double") * size)


def environment_secrets(environment: Mapping[str, str]) -> list[str]:
    """Values of at least four characters whose variable's name says that they are secret, and the passwords in those that are URLs;
    whole values first, as they are replaced in this order."""
    out = []
    for name, value in environment.items():
        if len(value) >= 4 and any(x in name.upper() for x in SECRET_NAMES):
            inner = re.search(r"://[^:/\s]+:([^@/\s]+)@", value)
            out += [value, *([inner.group(1)] if inner else [])]
    return out


def redact(c: Column, environment: Mapping[str, str] | None = None) -> Column:
    """A text without what looks like a secret, cut to REDACTED_CHARS. Secrets of `environment` (such as os.environ) are replaced too, by a
    function whose closure holds them, so that no plan, log or UI shows them."""
    if environment is not None and (held := environment_secrets(environment)):

        @F.pandas_udf("string")
        def hide(texts: pd.Series) -> pd.Series:
            for x in held:
                texts = texts.str.replace(x, REDACTED, regex=False)
            return texts

        c = hide(c)
    for pattern, put in SECRETS:
        c = F.regexp_replace(c, pattern, put)
    return F.substring(c, 1, REDACTED_CHARS)


def fingerprint(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def epoch(ts: str = "ts") -> Column:
    """Epoch seconds of a (zone-less, UTC) timestamp, to the microsecond."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def minute(ts: str = "ts") -> Column:
    return (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 60_000_000) * 60).cast("long")


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version-5 UUID in the given namespace (hex digits without dashes)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    v = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(v.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
