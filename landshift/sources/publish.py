"""Publishing results and cases together or not at all.

A publish writes its new rows under a folder of its own and then, as the last step, one small log entry that names the
folder. Readers see the folders that the log names and nothing else, so a publish that died in between left nothing
behind for them. Entries are numbered; an entry is written aside and renamed without overwriting, so of two
publishers that read the same state one fails and has to look again. Only the log passes through the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

PARTS = ("results", "cases")


class PublishConflict(RuntimeError):
    """Another publish took the log entry; read the state and publish again."""


class BrokenStore(RuntimeError):
    """The log names a folder whose tables are missing or don't have the rows that were published."""


class BundleStore:
    """Bundles of one result and one case each, under ``root`` on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, key: str = "bundle_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def log(self) -> list[dict]:
        """Entries in order: number, folder, rows of each table."""
        out = []
        for name in self._names("log"):
            if name.endswith(".json"):
                path = self._path(f"log/{name}")
                stream = path.getFileSystem(self._conf).open(path)
                try:
                    out.append(json.loads(bytes(stream.readAllBytes())))
                finally:
                    stream.close()
        return out

    def unpublished(self) -> list[str]:
        """Folders that no entry names: publishes that died, or that still run."""
        named = {e["folder"] for e in self.log()}
        return [f for f in self._names("data") if f not in named]

    def read(self, part: str) -> DataFrame | None:
        """All published rows of ``results`` or ``cases``; null before the first publish."""
        folders = [e["folder"] for e in self.log()]
        return self.spark.read.parquet(*[f"{self.root}/data/{f}/{part}" for f in folders]) if folders else None

    def check(self) -> None:
        """Counts every published table and compares it with its entry."""
        for entry in self.log():
            for part in PARTS:
                path = self._path(f"data/{entry['folder']}/{part}")
                there = path.getFileSystem(self._conf).exists(path)
                if not there or self.spark.read.parquet(path.toString()).count() != entry["rows"][part]:
                    raise BrokenStore(f"{entry['folder']}/{part} is not what entry {entry['number']} published")

    def plan(self, results: DataFrame, cases: DataFrame) -> DataFrame:
        """(key, state) of every given bundle: STORED (already published, its stored rows stay as they are), RESULT_MISSING or
        CASE_MISSING (refused), or NEW. Null keys are refused as RESULT_MISSING or CASE_MISSING; repeated rows of a key are DUPLICATE."""
        key = self.key
        halves = [df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((results, "_r"), (cases, "_c"))]
        both = halves[0].join(halves[1], key, "full_outer")
        stored = self.read("results")
        old = stored.select(key, F.lit(True).alias("_old")) if stored is not None else None
        both = both.join(old, key, "left") if old is not None else both.withColumn("_old", F.lit(None).cast("boolean"))
        state = (
            F.when(F.col("_old"), "STORED").when(F.col("_r").isNull(), "RESULT_MISSING").when(F.col("_c").isNull(), "CASE_MISSING")
            .when((F.col("_r") > 1) | (F.col("_c") > 1), "DUPLICATE").otherwise("NEW"))
        return both.select(key, state.alias("state"))

    def publish(self, results: DataFrame, cases: DataFrame) -> DataFrame:
        """Publishes the new whole bundles in one step; returns the states of all given ones, stored under the new folder.

        Publishing the same bundles again changes nothing. Nothing is published when no bundle is new.
        """
        number = len(self.log()) + 1
        folder = f"{number:08d}-{uuid.uuid4().hex}"
        states = f"{self.root}/data/{folder}/states"
        self.plan(results, cases).write.parquet(states)
        planned = self.spark.read.parquet(states)
        new = planned.where("state = 'NEW'").select(self.key)
        rows = {}
        for part, df in zip(PARTS, (results, cases)):
            path = f"{self.root}/data/{folder}/{part}"
            df.join(new, self.key, "left_semi").write.option("compression", "zstd").parquet(path)
            rows[part] = self.spark.read.parquet(path).count()
        if rows["results"]:
            self._commit(number, {"number": number, "folder": folder, "rows": rows})
        return planned

    def _commit(self, number: int, entry: dict) -> None:
        """The one step that makes a publish visible."""
        aside, final = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{number:08d}.json")
        stream = aside.getFileSystem(self._conf).create(aside, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(aside, final, options)
        except Exception as taken:
            if aside.getFileSystem(self._conf).exists(final):
                raise PublishConflict(f"entry {number} is taken") from taken
            raise
