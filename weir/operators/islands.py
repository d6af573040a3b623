"""Gaps and islands: ordered rows of a key, cut where a rule says so. All are lag, running sum and grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each key from 0; ``starts`` is true on the first row of each but the first."""
    w = W.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(starts.cast("int"), F.lit(0)))
    flagged = df.withColumn("__new", flag)
    return flagged.withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def _with_bucket(rows: DataFrame, buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys and ``__b``, nulls equal too."""
    right = buckets.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate([*keys, "__b"])})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate([*keys, "__b"])))
    return rows.join(right, on).drop(*[f"__r{i}" for i in range(len(keys) + 1)])


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: int, order: Sequence[str] = (), name: str = "session", bucket: int | None = None) -> DataFrame:
    """A row joins its predecessor's session if it comes at most ``gap`` after it (equal counts as within).

    ``bucket``: a width of time by which a key's rows are spread over tasks, for keys with more rows than one task should sort. Only
    a row a bucket is then ordered by key alone: the last time of each bucket and its number of session starts.
    """
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(time, *order)
        return number_islands(df, keys, [time, *order], F.col(time) - F.lag(time).over(w) > gap, name)
    cut = df.withColumn("__b", F.floor(F.col(time) / bucket).cast("long"))
    by_key, by_bucket = W.partitionBy(*keys).orderBy("__b"), W.partitionBy(*keys, "__b").orderBy(time, *order)
    ends = cut.groupBy(*keys, "__b").agg(F.max(time).alias("__last")).withColumn("__before", F.lag("__last").over(by_key)).drop("__last")
    rows = _with_bucket(cut, ends, keys)
    gone = F.col(time) - F.coalesce(F.lag(time).over(by_bucket), F.col("__before"))
    rows = rows.withColumn("__new", F.coalesce((gone > gap).cast("int"), F.lit(0)))
    starts = rows.groupBy(*keys, "__b").agg(F.sum("__new").alias("__n"))
    starts = starts.withColumn("__base", F.coalesce(F.sum("__n").over(by_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.sum("__new").over(by_bucket.rowsBetween(W.unboundedPreceding, 0))
    return _with_bucket(rows, starts, keys).withColumn(name, F.col("__base") + inside).select(*df.columns, name)


def contiguous_stretches(files: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", name: str = "file", tolerance: int = 3_000_000) -> DataFrame:
    """Number recordings that follow each other without a hole beyond ``tolerance``.

    The hole is measured from the end (or start, where no end is known) of the file just before. Files of
    unknown start come last and make a stretch each.
    """
    w = W.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_first(), name)
    before = F.lag(F.coalesce(F.col(end), F.col(start))).over(w)
    cut = F.col(start).isNull() | (F.col(start) - before > tolerance)
    return number_islands(files, keys, [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_first(), name], cut, "stretch")


def merge_intervals(spans: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", slack: int = 500_000) -> DataFrame:
    """Union of intervals that overlap or lie at most ``slack`` apart."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    parts = number_islands(spans, keys, [start, end], F.col(start) > reach + slack, "__part")
    return parts.groupBy(*keys, "__part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("spans")).drop("__part")
