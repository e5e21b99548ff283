"""The engine's front door: analyse, evaluate, plan, prewarm and serve a migration.

Inputs and results are DataFrames. Corpora are (doc_id, v), queries (query_id, v), documents (doc_id, text), traffic
(document_id, occurrences). Nothing runs before a result is used, apart from counts that choose a branch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshift.functions.encoders import EmbeddingModel, encode
from vecshift.operators import cache, planning, prewarm, probe, quality, retrieval, serving
from vecshift.operators.ledger import PrewarmRun
from vecshift.sources.index import VectorIndex
from vecshift.sources.snapshots import Snapshots, written


@dataclass
class Analysis:
    """per_query features, one summary row (means, decision, recommended depth), and the stability curve."""

    per_query: DataFrame
    summary: DataFrame
    curve: DataFrame
    grid: list[int] = field(default_factory=list)


def analyze(source_corpus: DataFrame, source_queries: DataFrame, target_corpus: DataFrame, target_queries: DataFrame, grid=quality.GRID, metric: str = "cosine") -> Analysis:
    """Whether the old space's candidate lists can be rescored by the new one, and how deep they must be."""
    ks = quality.k_grid(grid, source_corpus.count())
    if not ks:
        raise ValueError("the corpus is smaller than every depth")
    top = retrieval.topk(source_corpus, source_queries, max(ks), metric).select("query_id", "doc_id", F.col("rank").alias("source_rank"))
    cand = retrieval.pair_scores(top, target_queries, target_corpus)
    per = probe.features(cand) if max(ks) >= 500 else probe.short_pool_features(cand, ks)
    curve = probe.curve(probe.stability(cand, ks))
    summary = probe.aggregated(per).withColumn("decision", probe.decision()).join(probe.recommended_k(curve, max(ks)))
    return Analysis(per, summary, curve, ks)


def evaluate(source_corpus, source_queries, target_corpus, target_queries, qrels: DataFrame, native: DataFrame | None = None, grid=quality.GRID, quality_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Quality row and gap curve from two spaces; native: a saved target ranking instead of an exact search."""
    ks = quality.k_grid(grid, source_corpus.count())
    source = retrieval.topk(source_corpus, source_queries, max(ks)).select("query_id", "doc_id", "rank")
    native = native if native is not None else retrieval.topk(target_corpus, target_queries, max(ks)).select("query_id", "doc_id", "rank")
    scored = retrieval.pair_scores(source.select("query_id", "doc_id"), target_queries, target_corpus)
    return quality.evaluate(source, native, qrels, scored, ks, quality_k)


def plan(analysis: Analysis, documents: DataFrame, cached: DataFrame, dim: int, dtype: str = "float32", ann: DataFrame | None = None, preflight: str = "PASS", verified: bool = False, exact_registry: bool = False, docs_per_s: float | None = None, usd_per_hour: float | None = None) -> DataFrame:
    """One advisory row: recommendation, confidence, readiness, warnings, remaining work and its cost."""
    spark = documents.sparkSession
    ann = ann.select(F.col("status").alias("ann_status")) if ann is not None else spark.createDataFrame([("UNKNOWN",)], "ann_status string")
    left = planning.remaining(documents.select(F.col("doc_id").alias("document_id")), cached, dim, dtype, docs_per_s, usd_per_hour)
    x = analysis.summary.select("decision", "recommended_k", F.col("queries").alias("probes")).join(ann).join(left)
    x = x.withColumn("preflight", F.lit(preflight)).withColumn("verified", F.lit(verified)).withColumn("exact_registry", F.lit(exact_registry))
    return planning.serving_plan(planning.advisory(x))


@dataclass
class PrewarmPlan:
    """The chosen documents with their ranks, what the plan expects, and the identities it is bound to (see `prewarm.BINDINGS`)."""

    chosen: DataFrame
    summary: DataFrame
    fingerprint: DataFrame
    cap: int
    config: str = ""
    bindings: dict = field(default_factory=dict)

    def save(self, path: str) -> str:
        """Writes the plan, and gives its fingerprint."""
        print_ = self.fingerprint.first().fingerprint
        header = {"schema_version": prewarm.SCHEMA_VERSION, "strategy": prewarm.STRATEGY, "cap": self.cap, "config": self.config, "fingerprint": print_, "summary": self.summary.first().asDict(), **self.bindings}
        Snapshots(self.chosen.sparkSession, path, prewarm.CHOSEN).append(self.chosen, header)
        return print_

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PrewarmPlan:
        """A saved plan; one whose contents don't have its fingerprint any more is an error."""
        stored = Snapshots(spark, path, prewarm.CHOSEN)
        header, chosen = stored.manifest()["notes"], stored.read()
        if not header:
            raise FileNotFoundError(f"no plan in {path}")
        print_ = prewarm.plan_fingerprint(chosen, header["config"], header["cap"])
        if print_.first().fingerprint != header["fingerprint"]:
            raise ValueError("the plan's fingerprint doesn't match its contents")
        summary = spark.createDataFrame([header["summary"]])
        return cls(chosen, summary, print_, header["cap"], header["config"], {k: header[k] for k in (*prewarm.BINDINGS, "candidate_k") if k in header})

    def violations(self, current: dict) -> list[str]:
        """What keeps the plan from being run where the identities are these."""
        row = {"plan_id": 0, "schema_version": prewarm.SCHEMA_VERSION, "strategy": prewarm.STRATEGY, "max_docs": self.cap, "documents": None, "config": self.config, "candidate_k": None, **dict.fromkeys(prewarm.BINDINGS), **self.bindings, "fingerprint": self.fingerprint.first().fingerprint}
        plans = self.chosen.sparkSession.createDataFrame([row], prewarm.PLANS)
        found = prewarm.plan_violations(plans, self.chosen.select(F.lit(0).cast("long").alias("plan_id"), "rank", "document_id"), current)
        return sorted(r.violation for r in found.collect())  # at most one of each kind


def prewarm_plan(traffic: DataFrame, warm: DataFrame, config: str, max_docs: int = prewarm.MAX_DOCS, target: float | None = None, bindings: dict | None = None, **budget) -> PrewarmPlan:
    """The cold documents to encode first; budget: gb, dim, width, budget_s, docs_per_s."""
    cap, _ = prewarm.caps(max_docs, **budget)
    chosen = written(prewarm.hot_set(traffic, warm, cap, target), "chosen")  # what is warm changes while the plan runs
    return PrewarmPlan(chosen, prewarm.summary(traffic, warm, chosen, target, cap), prewarm.plan_fingerprint(chosen, config, cap), cap, config, dict(bindings or {}))


class MigrationSession:
    """A corpus, its old index, a target model, and the folder that holds the target vectors encoded so far and the work queue."""

    def __init__(self, documents: DataFrame, source_index: DataFrame, model: EmbeddingModel, store: str):
        self.spark: SparkSession = documents.sparkSession
        self.documents, self.index, self.model, self.path = documents, source_index, model, store
        self.store = serving.TargetStore(self.spark, store, model)

    def vectors(self) -> DataFrame:
        """Target vectors encoded so far, of every content and model."""
        return self.store.vectors.read()

    def current(self) -> DataFrame:
        """doc_id, v: the vectors of this model for what the documents hold now; a changed document has none until encoded."""
        return self.store.current(self.documents)

    def warm(self) -> DataFrame:
        """document_id of the documents whose current content is encoded by this model."""
        return self.current().select(F.col("doc_id").alias("document_id"))

    def encode(self, ids: DataFrame | None = None) -> int:
        """Encodes what is missing (of these document_ids), and returns how many; a repeat does nothing."""
        docs = self.documents if ids is None else self.documents.join(ids.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
        return self.store.encode(docs)[1]

    def export_target(self) -> DataFrame:
        """The whole target index."""
        self.encode()
        return self.current()

    def round(self, source_queries: DataFrame, texts: DataFrame, k: int = 50, budget: int = 4) -> serving.Round:
        """Candidates from the old index, up to `budget` misses of each query encoded now, the rest queued; see `serving`. source_queries
        (query_id, v), texts (query_id, text)."""
        index = self.index
        top = index.search(source_queries, k) if isinstance(index, VectorIndex) else retrieval.topk(index, source_queries, k)
        return self.store.search(top.select("query_id", "doc_id", F.col("rank").alias("source_rank")), encode(texts, self.model, "query_id"), self.documents, budget)

    def search(self, source_queries: DataFrame, texts: DataFrame, k: int = 50, budget: int = 4) -> DataFrame:
        """The hits of a round with their texts: reranked by what the new space holds for the present contents, source order where it
        holds nothing."""
        return cache.with_text(self.round(source_queries, texts, k, budget).hits, self.documents)

    def drain(self, limit: int | None = None) -> tuple[int, int]:
        """Encodes the next documents of the queue: how many were encoded, how many failed."""
        return self.store.drain(self.documents, limit)

    def status(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("document_id")).join(self.warm().withColumn("w", F.lit(1)), "document_id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count("w").alias("warm"))

    def prewarm(self, traffic: DataFrame, **kwargs) -> tuple[PrewarmPlan, int]:
        p = prewarm_plan(traffic, self.warm(), self.model.fingerprint(), **kwargs)
        return p, self.encode(p.chosen.select("document_id"))

    def run_plan(self, plan: PrewarmPlan, ledger: str, current: dict, batch: int = 10_000, max_batches: int | None = None) -> DataFrame:
        """Runs a plan that is valid here, batch by batch, and gives its status row; a run that was lost goes on where it stopped."""
        if wrong := plan.violations({**current, "target_fingerprint": self.model.fingerprint()}):
            raise ValueError(f"the plan can't be run here: {', '.join(wrong)}")
        run = PrewarmRun(ledger, plan.chosen, self.store, self.documents, plan.fingerprint.first().fingerprint, batch)
        run.run(max_batches)
        return run.status()


def migrate(session: MigrationSession, source_queries: DataFrame, texts: DataFrame, limit: int | None = None, seed: int = 42, **plan_options) -> tuple[Analysis, DataFrame]:
    """Probe with the session's model over its whole corpus, then the plan. limit: probe so many queries with distinct texts, drawn by
    hash with the seed; all queries without it."""
    if limit is not None:
        drawn = written(probe.probe_order(texts.withColumn("position", F.col("query_id")), seed, limit).select("query_id", "text"), "probes")
        source_queries, texts = source_queries.join(drawn.select("query_id"), "query_id", "left_semi"), drawn
    target = session.export_target()
    a = analyze(session.index, source_queries, target, encode(texts, session.model, "query_id"))
    return a, plan(a, session.documents, session.warm(), session.model.dimension, **plan_options)
