"""Streams that run to the end of what has arrived: event tables in, Parquet out, state in a checkpoint that a later run goes on from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh path in ``base``, else in the folder that spark.checkpoint.dir names. Where neither is set, Spark on one machine gets
    a temporary folder; a cluster can't share one, so there it is an error."""
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or give a base folder")
        base = "file://" + tempfile.mkdtemp(prefix="talentgrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, path: str, at: str, files: int | None = None) -> DataFrame:
    """A stream of a Parquet table with its event time ``at`` as a timestamp, as watermarks need it; ``files`` at once, all by
    default. Files that come later belong to the next run."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern, since a stream reads a table of one file only by a pattern
    return (source.option("maxFilesPerTrigger", files) if files else source).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def run(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process everything that has arrived and wait; the sink's rows so far. Called again with the same folders it takes up only what
    is new, with the state and watermark of the run before, even if that one was cut off."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def processed(spark: SparkSession, path: str, at: str, plan: Callable[[DataFrame], DataFrame], name: str, base: str | None = None, files: int | None = None) -> DataFrame:
    """The rows of plan over the stream of a table, run once in fresh folders."""
    place = folder(spark, name, base)
    return run(plan(arriving(spark, path, at, files)), f"{place}/sink", f"{place}/state")
