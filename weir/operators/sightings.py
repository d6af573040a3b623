"""Sightings: detections (hits) of a target grouped into time ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.operators.islands import gap_sessions, number_islands


def class_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], cls: str = "cls", name: str = "raw_classes") -> DataFrame:
    """Class histogram of each key as an ordered string; counts are summed before they are collected, so its arrays stay short."""
    first = F.min(F.struct(*order))
    counts = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("__n"), first.alias("__f"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("m"), F.col("__f").alias("f"), F.col(cls).alias("c"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["c"], F.lit(":"), (-x["m"]).cast("string"))), ";")
    return counts.groupBy(*keys).agg(text.alias(name))


def output_columns(sightings: DataFrame) -> DataFrame:
    """Sightings as their table shows them: seconds to 0.1 and pixels whole, exact ties to the even neighbour, confidences to 0.001, in order of start and target."""
    shown = {"duration_s": F.bround("duration_s", 1), "max_conf": F.bround("max_conf", 3), "nearest_px": F.bround("nearest_px", 0)}
    return sightings.withColumns({k: v for k, v in shown.items() if k in sightings.columns}).orderBy("start_us", "target", "camera")


def source_label(src: str = "src") -> Column:
    """live, nvr or nvr+live over a group."""
    live, nvr = F.bool_or(F.col(src) == "live"), F.bool_or(F.col(src) == "nvr")
    return F.when(live & nvr, "nvr+live").when(live, "live").otherwise("nvr")


def best_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], conf: str = "conf") -> DataFrame:
    """The row of greatest confidence of each key, the first in order of equals."""
    w = W.partitionBy(*keys).orderBy(F.col(conf).desc(), *order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def camera_sightings(hits: DataFrame, gap: int, keys: Sequence[str] = ("camera", "target"), bucket: int | None = None, distance: Column | None = None) -> DataFrame:
    """Sightings over cameras: hits of a key at most ``gap`` microseconds after the one before (column ``us``).

    ``distance``: a hit's distance to the region; a sighting's ``nearest_px`` is its least one.

    ``bucket`` (microseconds) spreads a crowded key over tasks by time.
    """
    s = gap_sessions(hits, keys, "us", gap, ["frame"], bucket=bucket)
    group = [*keys, "session"]
    best = F.min_by(F.col("frame"), F.struct(-F.col("conf"), F.col("us"), F.col("frame")))
    seen = s.groupBy(*group).agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.count_distinct("frame").alias("hits"),
        F.max("conf").alias("max_conf"),
        best.alias("best_frame"),
        source_label().alias("source"),
        *([F.min(distance).alias("nearest_px")] if distance is not None else []),
    )
    classes = class_counts(s, group, ["us", "frame"])
    right = classes.withColumnsRenamed({k: f"__{k}" for k in group})
    return seen.join(right, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group))).drop(*[f"__{k}" for k in group])


def file_sightings(hits: DataFrame, timeline: DataFrame, gap: int) -> DataFrame:
    """Sightings over recordings: hits at most ``gap`` apart and in one contiguous stretch.

    ``timeline`` has file, start (null where unknown) and stretch; hits of other files are dropped.
    Times of unknown files are offsets in their own stretch.
    """
    t = F.coalesce(F.col("start"), F.lit(0)) + F.round(F.col("offset") * 1_000_000).cast("long")
    j = hits.join(timeline.select("file", "start", "stretch"), "file").withColumn("us", t)
    w = W.partitionBy("camera", "target").orderBy("stretch", "us", "frame")
    cut = (F.col("us") - F.lag("us").over(w) > gap) | (F.col("stretch") != F.lag("stretch").over(w))
    s = number_islands(j, ["camera", "target"], ["stretch", "us", "frame"], cut, "session")
    first = F.min_by(F.struct("file", "offset", "start"), F.struct("us", "frame"))
    best = F.min_by(F.col("frame"), F.struct(-F.col("conf"), F.col("us"), F.col("frame")))
    g = s.groupBy("camera", "target", "session").agg(
        first.alias("first"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.count_distinct("file", "offset").alias("hits"), F.max("conf").alias("max_conf"), best.alias("best_frame")
    )
    known = F.col("first.start").isNotNull()
    return g.select("camera", "target", F.when(known, F.col("lo")).alias("start_us"), F.when(known, F.col("hi")).alias("end_us"), (F.col("hi") - F.col("lo")).alias("duration_us"), F.col("first.file").alias("file"), F.col("first.offset").alias("offset_s"), "hits", "max_conf", "best_frame")


def dedup_sources(hits: DataFrame, order: Sequence[str] = ("us", "frame")) -> DataFrame:
    """Count a detection seen by both sources once: same target, class, rounded second and coarse box; recorded before live."""
    second = F.expr("us div 1000000 + case when us % 1000000 > 500000 or (us % 1000000 = 500000 and (us div 1000000) % 2 = 1) then 1 else 0 end")
    box = [F.floor(F.col(c).cast("bigint") / 8) for c in ("x1", "y1", "x2", "y2")]
    rank = F.when(F.col("src") == "nvr", 0).otherwise(1)
    w = W.partitionBy("camera", "target", "cls", second, *box).orderBy(rank, *order)
    return hits.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def in_range(sightings: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sightings that touch [lo, hi], both ends included."""
    return sightings.where((F.col("end_us") >= lo) & (F.col("start_us") <= hi))


def fan_out(detections: DataFrame, class_targets: DataFrame) -> DataFrame:
    """One row for each target that a detection's class stands for; ``class_targets`` has cls and an array of targets."""
    return detections.join(class_targets, "cls").withColumn("target", F.explode("targets")).drop("targets")


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, action): pictures to render anew, to keep or to remove, from the best frames of before and now."""
    j = old.select("name", F.col("frame").alias("old_frame")).join(new.select("name", F.col("frame").alias("new_frame")), "name", "full")
    action = F.when(F.col("new_frame").isNull(), "remove").when(F.col("old_frame").eqNullSafe(F.col("new_frame")), "keep").otherwise("render")
    return j.select("name", action.alias("action"))
