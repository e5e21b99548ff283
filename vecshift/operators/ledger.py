"""Running a prewarm plan batch by batch, with a ledger that says of every planned document what became of it.

The ledger is a versioned table. Its first version holds the plan's documents as they were at the start, warm or cold; every further one
adds a batch: the documents of some ranks, encoded or failed, with the kind of fault. Vectors are stored before their batch is
entered. A run that is lost resumes at the ranks that no entry covers; documents whose vectors are there already are entered
without being encoded again, so the ledger and the store end up as if nothing had happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshift.operators.serving import TargetStore
from vecshift.sources.snapshots import Snapshots

LEDGER = "document_id long, batch int, status string, error string"


class PrewarmRun:
    """chosen (document_id, rank from 1, occurrences); batch: how many ranks are encoded at a time. Without further faults, `run` makes
    one pass over the plan and then max_attempts - 1 over what has failed."""

    def __init__(self, path: str, chosen: DataFrame, store: TargetStore, documents: DataFrame, fingerprint: str, batch: int = 10_000, max_attempts: int = 3):
        if batch < 1:
            raise ValueError("a batch has one rank at least")
        self.chosen, self.store, self.documents, self.fingerprint, self.batch, self.most = chosen, store, documents, fingerprint, batch, max_attempts
        self.ledger = Snapshots(store.spark, path, LEDGER)
        notes = self.ledger.manifest()["notes"]
        if notes and (notes["plan"], notes["batch"]) != (fingerprint, batch):
            raise ValueError("the ledger is of another plan, or of other batches")

    def _warm(self, planned: DataFrame) -> DataFrame:
        """document_id of the planned documents that have a vector of their present text."""
        docs = self.documents.join(planned.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
        return self.store.current(docs).select(F.col("doc_id").alias("document_id"))

    def _entered(self, batch: int, rows: DataFrame, left: list[int]) -> None:
        notes = {"plan": self.fingerprint, "batch": self.batch, "left": left, "last": batch}
        self.ledger.append(rows.select("document_id", F.lit(batch).alias("batch"), "status", "error"), notes)

    def start(self) -> None:
        """Enters the plan, once."""
        if self.ledger.versions():
            return
        warm = self._warm(self.chosen).withColumn("w", F.lit(1))
        rows = self.chosen.join(warm, "document_id", "left").withColumn("status", F.when(F.col("w").isNull(), "cold").otherwise("warm"))
        last = self.chosen.agg(F.max("rank").alias("n")).first().n or 0
        self._entered(0, rows.withColumn("error", F.lit(None).cast("string")), list(range(1, -(-last // self.batch) + 1)))

    def step(self) -> bool:
        """Encodes and enters the next batch; false if none is left."""
        notes = self.ledger.manifest()["notes"]
        if notes["left"]:
            number, left = notes["left"][0], notes["left"][1:]
            ranks = F.col("rank").between((number - 1) * self.batch + 1, number * self.batch)
            planned = self.chosen.where(ranks).select("document_id")
            cold = self.ledger.read().where("batch = 0 AND status = 'cold'").select("document_id")
            todo = planned.join(cold, "document_id", "left_semi")
        else:
            number, left, todo = notes["last"] + 1, [], self.failed().where(F.col("attempts") < self.most).select("document_id")
            if todo.isEmpty():
                return False
        # a document that the table lacks counts as one without text
        docs = todo.join(self.documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id", "left")
        failed, _ = self.store.encode(docs.select(F.col("document_id").alias("doc_id"), "text"))
        errors = failed.groupBy("document_id").agg(F.first("error").alias("error"))
        rows = todo.join(errors, "document_id", "left").withColumn("status", F.when(F.col("error").isNull(), "encoded").otherwise("failed"))
        self._entered(number, rows, left)
        return True

    def run(self, max_batches: int | None = None) -> None:
        self.start()
        n = 0
        while (max_batches is None or n < max_batches) and self.step():
            n += 1

    def latest(self) -> DataFrame:
        """document_id, batch, status, error: the last entry of each planned document."""
        last = self.ledger.read().groupBy("document_id").agg(F.max(F.struct("batch", "status", "error")).alias("l"))
        return last.select("document_id", "l.*")

    def failed(self) -> DataFrame:
        """document_id, attempts of the documents whose last attempt failed."""
        x = self.ledger.read().groupBy("document_id").agg(F.count_if(F.col("status") == "failed").alias("attempts"), F.max(F.struct("batch", "status")).alias("l"))
        return x.where("l.status = 'failed'").select("document_id", "attempts")

    def status(self) -> DataFrame:
        """One row: planned, already_warm, encoded, failed, remaining, status, coverage (occurrences of the planned documents that are
        warm now)."""
        left = bool((self.ledger.manifest()["notes"] or {"left": [1]})["left"])
        x = self.chosen.select("document_id", "occurrences").join(self.latest(), "document_id", "left")
        warm = self._warm(self.chosen).withColumn("there", F.lit(True))
        x = x.join(warm, "document_id", "left").agg(
            F.count(F.lit(1)).alias("planned"), F.count_if(F.col("status") == "warm").alias("already_warm"), F.count_if(F.col("status") == "encoded").alias("encoded"),
            F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("there").isNull()).alias("remaining"),
            F.round(F.coalesce(F.sum(F.when(F.col("there"), F.col("occurrences"))), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("occurrences"), F.lit(0))), 9).alias("coverage"),
        )
        done = F.when((F.col("planned") == F.col("already_warm")), "NOOP").when((F.col("remaining") == 0) & (F.col("failed") == 0), "COMPLETED").otherwise("PARTIAL")
        return x.withColumn("status", F.lit("INTERRUPTED") if left else done)
