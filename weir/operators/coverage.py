"""Scanned spans: time-grid chunks, containment, chunk results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_chunks(ranges: DataFrame, step: int, reverse: bool = False, keys: Sequence[str] = ("camera",)) -> DataFrame:
    """Cut [s, e) at multiples of ``step`` since the epoch; the first and last chunk may be partial. ``pos`` is the order of work."""
    grid = F.sequence(F.expr(f"s div {step}"), F.expr(f"(e - 1) div {step}"))
    d = ranges.where("s < e").withColumn("g", F.explode(grid))
    first, last = F.expr(f"s div {step}"), F.expr(f"(e - 1) div {step}")
    pos = (last - F.col("g")) if reverse else (F.col("g") - first)
    return d.select(*keys, F.greatest(F.col("s"), F.col("g") * step).alias("cs"), F.least(F.col("e"), (F.col("g") + 1) * step).alias("ce"), pos.alias("pos"))


def uncovered(chunks: DataFrame, merged: DataFrame, keys: Sequence[str] = ("camera",), grid: int | None = None) -> DataFrame:
    """Chunks that no merged interval contains whole.

    ``grid``: width of buckets that long intervals are spread over, so that the containment join has an
    equality on large inputs; a chunk is looked up in the bucket of its start.
    """
    m = merged.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("s").alias("__s"), F.col("e").alias("__e"))
    on = (F.col("__s") <= F.col("cs")) & (F.col("ce") <= F.col("__e"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    if grid is None:
        return chunks.join(m, on, "left_anti")
    m = m.withColumn("__g", F.explode(F.sequence(F.expr(f"__s div {grid}"), F.expr(f"__e div {grid}"))))
    c = chunks.withColumn("__c", F.expr(f"cs div {grid}"))
    return c.join(m, on & (F.col("__c") == F.col("__g")), "left_anti").drop("__c")


def chunk_results(chunks: DataFrame, keys: Sequence[str] = ("camera",)) -> DataFrame:
    """Counts of a camera's chunk states, its failed chunks in order, the earliest open one, and what may be committed."""
    failed = F.sort_array(F.collect_list(F.when(F.col("state") == "failed", F.col("cs"))))
    return chunks.groupBy(*keys).agg(
        F.count_if(F.col("state") == "ok").alias("ok"),
        F.count_if(F.col("state") == "no_footage").alias("no_footage"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.concat_ws(",", failed.cast("array<string>")).alias("failed_chunks"),
        F.min(F.when(F.col("state") == "active", F.col("cs"))).alias("earliest_active"),
        F.count_if(F.col("state").isin("ok", "no_footage")).alias("commit"),
    )
