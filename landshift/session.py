"""Session helpers: checkpoint folder, lineage cuts, adaptive settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("landshift")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the session. A temporary one serves a local master only: on a cluster every
    executor would write to a disk of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = named or tempfile.mkdtemp(prefix="landshift-ckpt-")
        spark.sparkContext.setCheckpointDir(named)
        current = spark.sparkContext.getCheckpointDir()
    return named or current


#: Whether the shuffle files of a statement go when it ends; else they stay until the driver happens to collect garbage.
RELEASE = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
#: Files of wide rows take less space; what the planner may broadcast keeps the usual codec, as its files tell the size.
COMPACT = ("spark.sql.parquet.compression.codec", "zstd")
STEP = "step"


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Statements made here run with a setting of their own."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store the rows as a table in the shared checkpoint folder and read them back.

    A lost executor then costs only its own tasks, and the planner knows the real size, so small
    intermediate tables are broadcast and large ones are not. Shuffles that led to the table are deleted.
    """
    return store(df)[0]


def store(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """Like ``cut_lineage``; also returns aggregates observed while writing, without another job."""
    spark = df.sparkSession
    path = scratch_path(spark, STEP)
    watch = Observation()
    watched = df.observe(watch, *[m.alias(name) for name, m in measures.items()]) if measures else df
    with configured(spark, *RELEASE):
        watched.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), watch.get if measures else {}


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``store`` wrote and that no plan reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith(f"landshift-{STEP}-"):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint root, for stream sinks and state."""
    return f"{checkpoint_root(spark).rstrip('/')}/landshift-{name}-{uuid.uuid4().hex}"
