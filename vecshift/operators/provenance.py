"""Whether a registry's files are those that its manifest names, and whether its numbers follow from the rows it retains.

Each check gives rows of what is wrong (subject, problem), so an empty table means that all is well."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a registry may say that an artifact is (fixed values).
RETAINED = ("retained_external", "packaged", "derived_from_retained_external")
#: What counts: a gap of this or less.
EPSILON = 0.01


def digest_ok(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def folder(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """name, bytes, sha256 of every file below a folder. The name is the path below the folder, or what the first group of the pattern
    `name` finds in that. Files are read in parallel, one a row, so a file has 2 GB at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # the scan skips empty files, which Spark's own listing has
    plain = F.regexp_replace("path", _ROOT, "/").alias("path")
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").select(plain)
    held = files.select(plain, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    both = listed.join(held, "path", "left").fillna({"bytes": 0, "sha256": hashlib.sha256(b"").hexdigest()})
    below = F.regexp_replace("path", F.lit("^" + _quoted(path)), F.lit(""))
    return both.select((F.regexp_extract(below, name, 1) if name else below).alias("name"), "bytes", "sha256")


_ROOT = r"^[a-z0-9]+:/*"


def _quoted(path: str) -> str:
    return re.escape(re.sub(_ROOT, "/", path).rstrip("/") + "/")


def file_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (name, sha256) against files (name, sha256): what is missing, extra, changed, listed twice, or has no digest. Three
    joins on the name; neither side is collected."""
    m, f = manifest.select("name", "sha256"), files.select("name", F.col("sha256").alias("found"))
    say = lambda x, why: x.select(F.col("name").alias("subject"), F.lit(why).alias("problem"))
    shaped = m.where(digest_ok("sha256"))
    return (
        say(m.where(~digest_ok("sha256")), "no digest")
        .unionByName(say(m.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "listed twice"))
        .unionByName(say(m.join(f, "name", "left_anti"), "missing"))
        .unionByName(say(f.join(m, "name", "left_anti"), "extra"))
        .unionByName(say(shaped.join(f, "name").where(F.lower("sha256") != F.col("found")).distinct(), "changed"))
    )


def record_violations(records: DataFrame, stated: int | None = None, kind: str = "records") -> DataFrame:
    """records (id, sha256, status) of one kind: ids that are blank or repeated, digests that are none, unknown states of retention, and
    another number of records than the manifest states."""
    say = lambda x, why: x.select(F.col("id").cast("string").alias("subject"), F.lit(why).alias("problem"))
    out = say(records.where(F.coalesce(F.trim("id"), F.lit("")) == ""), "no id")
    out = out.unionByName(say(records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND trim(id) <> ''"), "repeated id"))
    out = out.unionByName(say(records.where(F.col("sha256").isNotNull() & ~digest_ok("sha256")), "not a digest"))
    out = out.unionByName(say(records.where(~F.coalesce(F.col("status").isin(*RETAINED), F.lit(False))), "status of retention unknown"))
    if stated is not None:
        n = records.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != stated)
        out = out.unionByName(n.select(F.lit(kind).alias("subject"), F.format_string(f"{stated} stated, %d found", "n").alias("problem")))
    return out


def artifact_status(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims (id, artifact, sha256) with status: `unstated` (no artifact or digest) and `not retained` are warnings, `changed` is an error,
    `ok` is checked. An artifact that several claims name is read once."""
    f = files.select(F.col("name").alias("artifact"), F.col("sha256").alias("__found"))
    x = claims.join(f, "artifact", "left")
    said = (F.coalesce(F.trim("artifact"), F.lit("")) != "") & (F.coalesce(F.trim("sha256"), F.lit("")) != "")
    status = F.when(~said, "unstated").when(F.col("__found").isNull(), "not retained").when(F.col("__found") == F.lower("sha256"), "ok").otherwise("changed")
    return x.withColumn("status", status).drop("__found")


#: What can be counted over retained rows, and the columns and the condition it takes.
MEASURES = {
    "cells": "true",
    "point_estimate": "gap <= {eps}",
    "ci_certified": "ci",
    "compatible": "compatible",
    "safe": "upper(prediction) = 'SAFE'",
    "false_safe": "false_safe",
}


def derived_counts(rows: DataFrame, groups: list[list[str]], excluded: Column | None = None, eps: float = EPSILON) -> DataFrame:
    """grp, measure, scope, value: counts of the retained rows over all of them and over each set of columns of `groups`, for the measures
    that the rows have columns for; scope `all`, and `kept` without the excluded rows. One pass with grouping sets and
    partial aggregates, whatever the number of groups; a group is named by its values, joined by `->`, a null being (none)."""
    keys = sorted({c for g in groups for c in g})
    have = {m: e for m, e in MEASURES.items() if all(c in rows.columns for c in _columns(e))}
    x = rows.withColumn("__kept", ~F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(True))
    held = lambda m: F.coalesce(F.expr(have[m].format(eps=eps)), F.lit(False))
    counts = [F.count_if(held(m) & (F.col("__kept") if scope == "kept" else F.lit(True))).alias(f"{scope}:{m}") for m in have for scope in ("all", "kept")]
    sets = [[F.col(c) for c in g] for g in [[], *groups]]
    wide = x.groupingSets(sets, *map(F.col, keys)).agg(F.grouping_id().alias("__set"), *counts) if keys else x.agg(F.lit(0).cast("long").alias("__set"), *counts)
    # grouping_id has a bit for each key that a row's set leaves out, the last key's being the lowest
    parts = [F.when(F.col("__set").bitwiseAND(1 << (len(keys) - 1 - i)) == 0, F.coalesce(F.col(k).cast("string"), F.lit("(none)"))) for i, k in enumerate(keys)]
    wide = wide.withColumn("grp", F.concat_ws("->", *parts) if parts else F.lit(""))
    names = [f"{scope}:{m}" for m in have for scope in ("all", "kept")]
    long = wide.select("grp", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"`{n}`").alias("value")) for n in names])).alias("c"))
    return long.select("grp", F.substring_index("c.n", ":", -1).alias("measure"), F.substring_index("c.n", ":", 1).alias("scope"), "c.value")


def _columns(expression: str) -> list[str]:
    return [c for c in ("gap", "ci", "compatible", "prediction", "false_safe") if re.search(rf"\b{c}\b", expression)]


def count_provenance(claims: DataFrame, derived: DataFrame) -> DataFrame:
    """claims (id, grp, measure, scope, stated) with what the retained rows give, and status match, differs, or underived."""
    x = claims.join(derived, ["grp", "measure", "scope"], "left")
    return x.withColumn("status", F.when(F.col("value").isNull(), "underived").when(F.col("value") == F.col("stated"), "match").otherwise("differs"))


def verify_folder(spark: SparkSession, path: str) -> DataFrame:
    """A registry folder: `manifest.json` ({files: {name: {sha256}}, record_count, profile_count}), `evidence.jsonl` and `profiles.jsonl`
    with {id, provenance: {artifact_sha256, status}}. All that is wrong with its files, its counts, and its records."""
    head = spark.read.schema("files map<string, struct<sha256: string>>, record_count long, profile_count long").option("multiLine", True).json(f"{path}/manifest.json")
    manifest = head.select(F.explode("files").alias("name", "f")).select("name", "f.sha256")
    n = head.first()
    out = file_violations(manifest, folder(spark, path).where("name <> 'manifest.json'"))
    for kind, stated in (("evidence", n.record_count), ("profiles", n.profile_count)):
        raw = spark.read.schema("id string, provenance struct<artifact_sha256: string, status: string>").option("mode", "PERMISSIVE").json(f"{path}/{kind}.jsonl")
        records = raw.select("id", F.col("provenance.artifact_sha256").alias("sha256"), F.col("provenance.status").alias("status"))
        out = out.unionByName(record_violations(records, stated, kind))
    return out
