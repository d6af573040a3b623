"""Run a streaming transformation to the end over a table, for tests and queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def drain(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """The result of ``transform`` once all files of ``path`` went through it as a stream."""
    name = "s" + uuid.uuid4().hex
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", file).parquet(folder)
    query = transform(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)
