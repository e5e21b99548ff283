"""Costs, serving and advisory plans, registry matching and evidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshift.functions.scalar import canonical_model, model_family

FRACTIONS = (0.01, 0.05, 0.10, 0.25, 0.50, 1.0)
#: Bytes of lines that one task hashes in an ordered digest.
PART_BYTES = 128 << 20
#: Bytes of a vector component by type name (fixed values).
WIDTHS = {"float16": 2, "bfloat16": 2, "bf16": 2, "float32": 4, "float64": 8, "int8": 1, "uint8": 1}


def economics(n_docs: Column, dim: int, dtype: str, docs_per_s: float | None, usd_per_hour: float | None) -> list[Column]:
    """Storage, time and cost of encoding so many documents; an unknown rate leaves null."""
    rate, price = F.lit(docs_per_s).cast("double"), F.lit(usd_per_hour).cast("double")
    s = n_docs / F.when(rate > 0, rate)
    return [
        (n_docs * dim * WIDTHS[dtype]).cast("long").alias("storage_bytes"), F.round(s, 6).alias("encode_seconds"), F.round(s / 3600 * price, 6).alias("cost_usd"),
        F.when(rate.isNull(), "unknown").otherwise("user_supplied").alias("rate_provenance"), F.when(rate.isNull() | price.isNull(), "unknown").otherwise("modeled").alias("cost_provenance"),
    ]


def scenarios(corpus: DataFrame, dim: int, dtype: str = "float32", docs_per_s: float | None = None, usd_per_hour: float | None = None) -> DataFrame:
    """One row for each fraction of the corpus; documents = ceil(n * fraction)."""
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    x = n.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in FRACTIONS])))
    docs = F.ceil(F.round(F.col("n") * F.col("fraction"), 6)).cast("long")
    return x.select("fraction", docs.alias("documents"), *economics(docs, dim, dtype, docs_per_s, usd_per_hour))


def remaining(corpus: DataFrame, cached: DataFrame, dim: int, dtype: str, docs_per_s: float | None, usd_per_hour: float | None) -> DataFrame:
    """Work left after the cache, and the share of all work that is deferred."""
    c = cached.select("document_id").distinct().withColumn("__c", F.lit(1))
    x = corpus.join(c, "document_id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count("__c").alias("cached"))
    left = F.col("documents") - F.col("cached")
    return x.select("documents", "cached", left.alias("remaining"), F.round(left / F.greatest(F.lit(1), F.col("documents")), 9).alias("deferred_fraction"), *economics(left, dim, dtype, docs_per_s, usd_per_hour))


def serving_plan(rows: DataFrame, fallback_k: int = 50) -> DataFrame:
    """rows (decision, ann_status, cached, documents, recommended_k where known) with status, strategy, k, cache_fraction, warnings.

    READY: a SAFE decision, and ANN fidelity not known to be low. A missing decision counts as not SAFE."""
    safe = F.coalesce(F.col("decision") == "SAFE", F.lit(False))
    warn = F.array_compact(
        F.array(
            F.when(~safe, F.lit("DECISION_NOT_SAFE")),
            F.when(F.col("ann_status").isin("WARNING", "UNKNOWN"), F.lit("ANN_NOT_CONFIRMED")),
            F.when(F.col("cached") > F.col("documents"), F.lit("CACHE_EXCEEDS_CORPUS")),
        )
    )
    ready = safe & F.col("ann_status").isin("PASS", "UNKNOWN")
    known = F.col("recommended_k") if "recommended_k" in rows.columns else F.lit(None)
    share = F.when(F.col("documents") > 0, F.col("cached") / F.col("documents")).otherwise(0.0)
    return (
        rows.withColumn("status", F.when(ready, "READY").otherwise("REVIEW"))
        .withColumn("strategy", F.when(safe, "PROGRESSIVE").otherwise("PROGRESSIVE_WITH_REVIEW"))
        .withColumn("k", F.coalesce(known.cast("long"), F.lit(fallback_k).cast("long")))
        .withColumn("cache_fraction", F.round(share, 9))
        .withColumn("warnings", F.concat_ws(",", warn))
    )


def confidence(decision: Column, probes: Column, verified: Column, ann: Column, exact_registry: Column) -> Column:
    """INSUFFICIENT without a decision or a probe; a decision that is not SAFE is at most MODERATE, from 50 probes on; STRONG
    takes a verified source contract, 100 probes, and confirmed ANN fidelity or an exact registry match."""
    some = F.when(probes >= 50, "MODERATE").otherwise("LIMITED")
    strong = (decision == "SAFE") & (probes >= 100) & verified & ((ann == "PASS") | exact_registry)
    return F.when(decision.isNull() | (probes == 0), "INSUFFICIENT").when(strong, "STRONG").otherwise(some)


def advisory(rows: DataFrame) -> DataFrame:
    """rows (preflight, decision, recommended_k, probes, verified, ann_status, exact_registry) with recommendation and confidence."""
    full = (F.col("probes") >= 100) & F.col("verified") & (F.col("preflight") == "PASS")
    rec = (
        F.when(F.col("preflight") == "FAIL", "BLOCKED")
        .when(F.col("decision").isNull() | (F.col("probes") == 0) | (F.col("decision") == "EXPAND"), "EXPAND_PROBE")
        .when(F.col("decision") == "UNSAFE_OR_UNCERTAIN", "DEFER")
        .when(F.col("recommended_k").isNull(), "EXPAND_PROBE")
        .when(full, "PROCEED")
        .otherwise("PROCEED_WITH_CAUTION")
    )
    sure = confidence(F.col("decision"), F.col("probes"), F.col("verified"), F.col("ann_status"), F.col("exact_registry"))
    return rows.withColumn("recommendation", rec).withColumn("confidence", sure)


#: Phases of a rollout with their share of traffic: for all plans, for those that go on, for the others (fixed values).
PHASES = [(0, "Validate", 0.0), (1, "Shadow", 0.0)]
GO_ON = [(2, "Small canary", 0.05), (3, "Expanded canary", 0.25), (4, "Target-primary path", 1.0)]
HOLD = [(2, "Hold", 0.0)]


def rollout(rows: DataFrame, key: str = "plan_id") -> DataFrame:
    """key, phase, name, traffic: the phases of each plan by its recommendation."""
    phases = lambda x: F.array(*[F.struct(F.lit(n).alias("phase"), F.lit(name).alias("name"), F.lit(t).alias("traffic")) for n, name, t in x])
    own = F.when(F.col("recommendation").isin("PROCEED", "PROCEED_WITH_CAUTION"), phases(PHASES + GO_ON)).otherwise(phases(PHASES + HOLD))
    return rows.select(key, F.explode(own).alias("p")).select(key, "p.phase", "p.name", "p.traffic")


CONTRACT = ("model_id", "revision", "pooling", "normalize", "dimension", "dtype", "query_instruction", "document_instruction", "max_length", "prefix", "trust")


def contract_fingerprint(cols: list[str]) -> Column:
    """SHA-256 of the contract's JSON with sorted keys and no blanks; nulls are written."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})) - 6), F.lit("null"))) for c in sorted(cols)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def registry_match(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Best tier of evidence for each wanted transition, how many records have it, and the smallest evidence_id of these.

    wanted (pair_id, source, target, source_fp, target_fp, corpus_fp, corpus_name, corpus_size); registry the same without
    pair_id, with evidence_id and canonical (whether its corpus was built the canonical way). Names are made canonical here.

    EXACT: the names match, all records of the transition have both contract fingerprints, and a record has the corpus, by its
    fingerprint or by name, size and canonical construction; the records with the corpus count. PRIOR: the same without
    the corpus. RELATED: the names alone, or, where no record has the names, both families. NONE: else.

    The registry is aggregated by each kind of key first, so that every join meets one row a key at most."""
    names, fps = ["source", "target"], ["source_fp", "target_fp"]
    clean = lambda df: df.withColumns({c: canonical_model(F.col(c)) for c in names})
    w, r = clean(wanted), clean(registry)
    kin = lambda df: df.withColumns({f"__{c}": model_family(F.col(c)) for c in names})
    count = lambda x: [F.count(F.lit(1)).alias(f"{x}_n"), F.min("evidence_id").alias(f"{x}_id")]
    same = [F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(f"all_{c}") for c in fps]
    by_name = r.groupBy(*names).agg(*count("name"), *same)
    by_family = kin(r).groupBy("__source", "__target").agg(*count("family"))
    whole = r.where("canonical")
    size = ["corpus_name", "corpus_size"]
    x = w.join(by_name, names, "left").join(r.groupBy(*names, "corpus_fp").agg(*count("print")), [*names, "corpus_fp"], "left")
    x = x.join(whole.groupBy(*names, *size).agg(*count("built")), [*names, *size], "left")
    x = x.join(whole.groupBy(*names, *size, "corpus_fp").agg(*count("both")), [*names, *size, "corpus_fp"], "left")
    x = kin(x).join(by_family, ["__source", "__target"], "left")
    n = lambda c: F.coalesce(f"{c}_n", F.lit(0))
    contracts = F.coalesce((F.col("source_fp") == F.col("all_source_fp")) & (F.col("target_fp") == F.col("all_target_fp")), F.lit(False))
    corpus = n("print") + n("built") - n("both")
    tier = F.when(contracts & (corpus > 0), "EXACT").when(contracts, "PRIOR").when(F.coalesce("name_n", "family_n").isNotNull(), "RELATED").otherwise("NONE")
    records = F.when(F.col("tier") == "EXACT", corpus).otherwise(F.coalesce("name_n", "family_n", F.lit(0)))
    first = F.when(F.col("tier") == "EXACT", F.least("print_id", "built_id")).otherwise(F.coalesce("name_id", "family_id"))
    return x.withColumn("tier", tier).select("pair_id", "tier", records.cast("long").alias("records"), first.alias("first_evidence"))


def priority_depths(evidence: DataFrame) -> DataFrame:
    """k by ascending value: observed depths and the depths of the gap maps."""
    keys = F.array_distinct(F.concat(F.map_keys("candidate_gap"), F.when(F.col("observed_depth").isNull(), F.array().cast("array<int>")).otherwise(F.array("observed_depth"))))
    return evidence.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("records"))


def evidence_violations(evidence: DataFrame, eps: float = 0.01) -> DataFrame:
    """evidence_id, violation: fingerprint, observed_depth, depths, containment."""
    gaps = F.map_entries("candidate_gap")
    first = F.array_min(F.transform(F.filter(gaps, lambda e: e["value"] <= eps), lambda e: e["key"]))
    outside = F.exists(F.map_values("containment"), lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c > 1))
    checks = F.array_compact(
        F.array(
            F.when(F.col("fingerprint") != F.col("recomputed"), F.lit("fingerprint")),
            F.when(~first.eqNullSafe(F.col("observed_depth")), F.lit("observed_depth")),
            F.when(F.size(F.array_except(F.map_keys("containment"), F.map_keys("candidate_gap"))) > 0, F.lit("depths")),
            F.when(outside, F.lit("containment")),
        )
    )
    return evidence.select("evidence_id", F.explode(checks).alias("violation"))


def semantic_provenance(claims: DataFrame, retained: DataFrame, rel: float = 1e-10, abs_: float = 1e-12) -> DataFrame:
    """Claims (evidence_id, k, value) against retained rows (evidence_id, k, value): equi-join, then a tolerance."""
    x = claims.join(retained.select("evidence_id", "k", F.col("value").alias("kept")), ["evidence_id", "k"], "left")
    near = F.abs(F.col("value") - F.col("kept")) <= F.greatest(F.lit(abs_), rel * F.greatest(F.abs("value"), F.abs("kept")))
    return x.withColumn("status", F.when(F.col("kept").isNull(), "missing").when(near, "match").otherwise("differs"))


def registry_audit(evidence: DataFrame, expected: int | Column) -> DataFrame:
    """Counts of the registry against the expected number of records, a number or an aggregate over it."""
    return evidence.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("evidence_id").alias("distinct_ids"), (F.count(F.lit(1)) == expected).alias("count_ok"), (F.count(F.lit(1)) == F.countDistinct("evidence_id")).alias("unique_ok"))


def dataset_digest(rows: DataFrame, key: str, *cols: str) -> DataFrame:
    """Order-free digest of a dataset: SHA-256 over the sorted row hashes of each bucket of six hexadecimal digits, then over
    the buckets of three digits, then over these; so no row holds more than 4096 digests but for equal leading digits.
    (An order-sensitive rolling digest has to see all rows one after the other; see `rolling_digest`.)"""
    h = rows.select(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (key, *cols)]), 256).alias("h"))
    leaf = h.groupBy(F.substring("h", 1, 6).alias("l")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    part = leaf.groupBy(F.substring("l", 1, 3).alias("b")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("l", "d"))), lambda r: r["d"])), 256).alias("d"), F.sum("n").alias("n"))
    return part.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda r: r["d"])), 256).alias("digest"), F.sum("n").alias("rows"))


class _Sha256:
    """SHA-256 whose state can be handed on to another process, which hashlib's can't: the same OpenSSL's functions, called directly."""

    SIZE = 112  # of SHA256_CTX

    def __init__(self, state: bytes | None = None):
        import _hashlib
        import ctypes

        self.lib, self.size = ctypes.CDLL(_hashlib.__file__), ctypes.c_size_t
        self.state = ctypes.create_string_buffer(state or bytes(self.SIZE), self.SIZE)
        self.out = ctypes.create_string_buffer(32)
        if state is None:
            self.lib.SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.state, data, self.size(len(data)))

    def hexdigest(self) -> str:
        end = _Sha256(self.state.raw)
        self.lib.SHA256_Final(self.out, end.state)
        return self.out.raw.hex()


def _hash_on(part: DataFrame, state: bytes) -> tuple[bytes, int]:
    """The state after the lines of part, in their order, and their number; part lies in one partition."""

    def run(batches):
        import pyarrow as pa

        h, n = _Sha256(state), 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                lines = b.column(0).slice(lo, 64).to_pylist()
                h.update("".join(x + "\n" for x in lines).encode())
                n += len(lines)
        yield pa.RecordBatch.from_pydict({"state": pa.array([h.state.raw], pa.binary()), "n": pa.array([n], pa.int64())})

    rows = part.mapInArrow(run, "state binary, n long").collect()  # one row
    return (bytes(rows[0].state), rows[0].n) if rows else (state, 0)


def rolling_digest(rows: DataFrame, order: str, *cols: str) -> DataFrame:
    """Order-sensitive digest: SHA-256 fed with the canonical rows in order. The rows are dealt by ranges of the order, of about PART_BYTES
    each; as every byte's turn comes after those before it, the ranges are hashed one after the other, each by a task that gets
    the state (112 bytes) of the one before. So no task reads more than its range, whatever the rows."""
    from vecshift.operators.retrieval import ship
    from vecshift.sources.snapshots import written

    spark = rows.sparkSession
    ship(spark)
    line = F.to_json(F.struct(*[F.col(c) for c in sorted({order, *cols})]), {"ignoreNullFields": "false"})
    lines = rows.select(F.col(order).alias("at"), line.alias("line"))
    size = lines.agg(F.sum(F.octet_length("line") + 1).alias("n")).first().n or 0
    dealt = lines.repartitionByRange(max(1, -(-size // PART_BYTES)), "at").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "lines", "part")
    h, n = _Sha256(), 0
    state = h.state.raw
    for r in dealt.select("part").distinct().orderBy("part").collect():  # a number for each range
        state, k = _hash_on(dealt.where(F.col("part") == r.part).coalesce(1).sortWithinPartitions("at").select("line"), state)
        n += k
    return spark.createDataFrame([(_Sha256(state).hexdigest(), n)], "digest string, rows long")
