"""Tables with versions: Parquet parts that never change, and for each version one small file that names the parts it has.

A writer puts its rows into a part of its own and then publishes the next version's file by a rename that doesn't overwrite; so a
version is there as a whole or not at all, readers of an older version are not disturbed, and of two writers that publish the
same number one is told and tries the next. What a lost writer leaves is a part that no version names. The rename is
atomic where the file system's is (HDFS and local disks are; an object store needs a committer that makes it so)."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published a version since the one this change was made from."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where it is unset and the master is
    a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]+(,[^\]]+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        where = getattr(spark.sparkContext, "_vecshift_folder", None)
        if where is None:
            where = spark.sparkContext._vecshift_folder = tempfile.mkdtemp(prefix="vecshift-")
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, and not again if executors are lost. partition: a column it is stored by."""
    path = fresh(df.sparkSession, name)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str | None = None):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition
        self.columns = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(",")]
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        log = self._at("versions")
        fs = log.getFileSystem(self._conf)
        names = [x.getPath().getName() for x in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one) says: its number, the one it was made from, its parts, and its writer's notes."""
        have = self.versions()
        if version is None and not have:
            return {"version": 0, "parts": [], "notes": {}}
        version = have[-1] if version is None else version
        if version not in have:
            raise ValueError(f"no version {version} in {self.path}")
        file = self._at(f"versions/{version:012d}.json")
        stream = file.getFileSystem(self._conf).open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self.parts(self.manifest(version)["parts"])

    def parts(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.option("basePath", f"{self.path}/parts").schema(f"{self.schema}, part string")
        return rows.parquet(*[f"{self.path}/{n}" for n in names]).select(*self.columns)

    def write(self, df: DataFrame) -> str:
        """Rows as a part that no version names yet."""
        name = f"parts/part={uuid.uuid4().hex}"
        out = df.select(*self.columns).write
        (out.partitionBy(self.partition) if self.partition else out).parquet(f"{self.path}/{name}")
        return name

    def publish(self, parts: list[str], base: int, notes: dict) -> int:
        """Version base + 1, if nobody else has made it."""
        file, draft = self._at(f"versions/{base + 1:012d}.json"), self._at(f"versions/.{uuid.uuid4().hex}")
        out = file.getFileSystem(self._conf).create(draft, True)
        out.write(bytearray(json.dumps({"version": base + 1, "base": base, "parts": parts, "notes": notes}).encode()))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(file.toUri(), self._conf).rename(draft, file, never)
        except Exception as e:
            file.getFileSystem(self._conf).delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} of {self.path} exists") from e
            raise
        return base + 1

    def append(self, df: DataFrame, notes=None) -> int:
        """The version that has these rows too. Appends of several writers all stay: who comes second is put after the first. notes: a
        dict, or a function of the manifest before that gives one."""
        return self.add(self.write(df), notes)

    def add(self, part: str, notes=None) -> int:
        while True:
            now = self.manifest()
            says = notes(now) if callable(notes) else notes or now["notes"]
            try:
                return self.publish([*now["parts"], part], now["version"], says)
            except Conflict:
                if self.versions()[-1] <= now["version"]:
                    raise

    def replace(self, df: DataFrame, base: int, notes: dict | None = None) -> int:
        """The version with these rows only, if base is still the last one."""
        return self.publish([self.write(df)], base, notes if notes is not None else self.manifest(base)["notes"])
