"""Session settings that results depend on, and the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Results depend on these: timestamps without a zone, and GB charsets
#: in encode() and decode(), which replace what they can't read.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map={**SETTINGS, **settings})
    return (builder.master(master) if master else builder).getOrCreate()


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names for all executors; a temporary one is made only where none is set
    and the master is local."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not path and held.isDefined():
        return held.get()
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = path or f"file://{tempfile.mkdtemp(prefix='docev-')}"
    if not held.isDefined():
        context.setCheckpointDir(path)
    return path


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared(frame.sparkSession)
    return frame.checkpoint()


class Scratch:
    """Tables in the shared folder that cut lineage and go as soon as no later step reads them, with the shuffles that
    made them."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared(spark)}/docev-{name}-{uuid.uuid4().hex}", 0
        self.names: dict[int, str] = {}

    def table(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path, before = f"{self.root}/{self.count}", self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            frame.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)
        held = self.spark.read.schema(frame.schema).parquet(path)
        self.names[id(held)] = path
        return held

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.names.pop(id(frame)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
