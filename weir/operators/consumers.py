"""Consumers of the sighting tables: snapshots compared with what is shown, shared pictures, crops, files and logs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.functions.geometry import overlaps
from weir.functions.names import crop_names


def latest(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The n rows that end last, earliest start first, dealt to tiles in turn."""
    top = rows.orderBy(F.col("end_us").desc(), *order).limit(n)
    return top.withColumn("tile", (F.row_number().over(W.orderBy("start_us", *order)) - 1) % n)


def match_tiles(rows: DataFrame, tiles: DataFrame, gap: int, order: Sequence[str]) -> DataFrame:
    """Each row with the first tile (by its number) of the same camera and target whose time it touches within ``gap``; null for new rows."""
    t = tiles.select("tile", F.col("camera").alias("__c"), F.col("target").alias("__t"), F.col("start_us").alias("__s"), F.col("end_us").alias("__e"))
    on = (F.col("camera") == F.col("__c")) & (F.col("target") == F.col("__t")) & (F.col("start_us") <= F.col("__e") + gap) & (F.col("__s") <= F.col("end_us") + gap)
    # repeated rows are told apart by their number, so that each keeps a row of its own
    numbered = rows.withColumn("__n", F.row_number().over(W.partitionBy(*rows.columns).orderBy(F.lit(0))))
    j = numbered.join(t, on, "left").groupBy(*numbered.columns).agg(F.min(F.struct("tile", "__e")).alias("m"))
    grown = F.when(F.col("m.tile").isNull(), "new").when(F.col("end_us") > F.col("m.__e"), "grown").otherwise("unchanged")
    return j.select(*rows.columns, F.col("m.tile").alias("tile"), grown.alias("change"))


def new_rows(rows: DataFrame, known: DataFrame, gap: int) -> DataFrame:
    """Rows that touch nothing known of their camera and target within ``gap``, in start order."""
    k = known.select(F.col("camera").alias("__c"), F.col("target").alias("__t"), F.col("start_us").alias("__s"), F.col("end_us").alias("__e"))
    on = (F.col("camera") == F.col("__c")) & (F.col("target") == F.col("__t")) & (F.col("start_us") <= F.col("__e") + gap) & (F.col("__s") <= F.col("end_us") + gap)
    return rows.join(k, on, "left_anti").orderBy("start_us", "camera", "target")


def overlapping_boxes(boxes: DataFrame, keys: Sequence[str], id_: str = "frame") -> DataFrame:
    """Pairs of boxes of one key that overlap, with the box around both."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = overlaps(_box("a"), _box("b")) & (F.col(f"a.{id_}") < F.col(f"b.{id_}"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    u = [F.least("a.x1", "b.x1").alias("x1"), F.least("a.y1", "b.y1").alias("y1"), F.greatest("a.x2", "b.x2").alias("x2"), F.greatest("a.y2", "b.y2").alias("y2")]
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{id_}").alias("first"), F.col(f"b.{id_}").alias("second"), *u)


def _box(alias: str) -> dict:
    return {k: F.col(f"{alias}.{k}") for k in ("x1", "y1", "x2", "y2")}


def window_of(box: tuple, width: float, height: float, pad: float, least: float) -> tuple:
    """Crop window of one box; the column form is functions.geometry.crop_window."""
    x1, y1, x2, y2 = box
    grow = max(x2 - x1, y2 - y1) * pad
    w, h = min(max(x2 - x1 + 2 * grow, least), width), min(max(y2 - y1 + 2 * grow, least), height)
    left, top = min(max((x1 + x2) / 2 - w / 2, 0.0), width - w), min(max((y1 + y2) / 2 - h / 2, 0.0), height - h)
    return tuple(int(v) for v in (left, top, left + w, top + h))


def merge_windows(boxes: list[tuple], width: float, height: float, pad: float = 0.5, least: float = 150.0) -> list[tuple]:
    """Join boxes whose windows overlap until none do; a joined window is that of the box around its parts, so joins can cause joins."""
    groups = [(b, window_of(b, width, height, pad, least)) for b in sorted(boxes)]
    again = True
    while again:
        again = False
        done: list = []
        for box, window in groups:
            hit = next((i for i, (_, w) in enumerate(done) if w[0] < window[2] and window[0] < w[2] and w[1] < window[3] and window[1] < w[3]), None)
            if hit is None:
                done.append((box, window))
                continue
            other = done.pop(hit)[0]
            union = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
            done.append((union, window_of(union, width, height, pad, least)))
            again = True
        groups = done
    return sorted(w for _, w in groups)


def crop_groups(boxes: DataFrame, keys: Sequence[str], width: float, height: float, pad: float = 0.5, least: float = 150.0) -> DataFrame:
    """Crop windows of each key, left to right. The fixpoint of merging isn't a relational expression, so groups (one picture's boxes each) go to pandas."""

    @F.pandas_udf("array<array<bigint>>")
    def windows(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: [list(w) for w in merge_windows([tuple(b) for b in g], width, height, pad, least)])

    g = boxes.groupBy(*keys).agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])).alias("__b"))
    w = g.select(*keys, F.posexplode(windows("__b")).alias("n", "w"))
    return w.select(*keys, (F.col("n") + 1).cast("long").alias("n"), *[F.col("w")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def class_sets(detections: DataFrame, wanted: Sequence[str], conf: float, skip: int, clip: str = "clip") -> DataFrame:
    """Sorted classes seen in each clip, of every ``skip``-th frame and at least ``conf``."""
    seen = detections.where((F.col("idx") % skip == 0) & (F.col("conf") >= conf) & F.col("cls").isin(*wanted))
    return seen.groupBy(clip).agg(F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"))


def pending(found: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is found but not done with an equal signature."""
    return found.join(done, list(keys), "left_anti")


def still_there(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose file is still there."""
    return rows.join(found, list(keys), "left_semi")


def classes_known(requested: DataFrame, vocabulary: DataFrame, strict: bool) -> DataFrame:
    """Requested class names with their ids. Unknown names fail the query if ``strict``, else they are left out."""
    j = requested.join(vocabulary, "cls", "left")
    if strict:
        return j.withColumn("class_id", F.coalesce("class_id", F.raise_error(F.concat(F.lit("unknown class "), F.col("cls"))).cast("long")))
    return j.where("class_id is not null")


def rename_plan(listed: DataFrame, files: DataFrame) -> DataFrame:
    """What becomes of each listed file: its new name, or NOT FOUND."""
    j = listed.join(files.select("file", F.lit(True).alias("__there")), "file", "left")
    return j.select("file", F.when(F.col("__there"), F.col("new_name")).otherwise("NOT FOUND").alias("action"))


def unfinished_runs(log: DataFrame) -> DataFrame:
    """Runs with a start but no end."""
    return log.where("type = 'start'").select("job").distinct().join(log.where("type = 'end'").select("job"), "job", "left_anti")


def throughput(log: DataFrame) -> DataFrame:
    """Frames per second of each finished job, from its first start to its last end."""
    g = log.groupBy("job").agg(
        F.min(F.when(F.col("type") == "start", F.col("us"))).alias("s"), F.max(F.when(F.col("type") == "end", F.col("us"))).alias("e"), F.sum(F.when(F.col("type") == "checkpoint", F.col("frames"))).alias("frames")
    )
    return g.where("e > s").select("job", (F.col("e") - F.col("s")).alias("elapsed_us"), (F.col("frames") / ((F.col("e") - F.col("s")) / 1e6)).alias("fps"))


def speeds(log: DataFrame, keys: Sequence[str] = ("nvr",)) -> DataFrame:
    """Mbit/s of each download (``bytes``, ``secs``, begun at ``began`` seconds), the average of the last ten, and all bytes over the time since the first start.

    Downloads run side by side, so the overall average divides by time, not by summed seconds. A download without a duration has no speed of its own.
    """
    w = W.partitionBy(*keys).orderBy("n")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    d = log.withColumn("mbps", F.when(F.col("secs") > 0, F.col("bytes") * 8 / F.col("secs") / 1e6))
    # the last ten speeds, whatever lies between them: number the downloads that have one
    d = d.withColumn("__k", F.count("mbps").over(so_far))
    ten = W.partitionBy(*keys).orderBy("__k").rangeBetween(-9, 0)
    d = d.withColumn("last_ten", F.avg("mbps").over(ten)).drop("__k")
    took = F.max(F.col("began") + F.col("secs")).over(so_far) - F.min("began").over(so_far)
    return d.withColumn("overall", F.sum("bytes").over(so_far) * 8 / F.greatest(took, F.lit(1e-6)) / 1e6)


def recent_rate(log: DataFrame, key: str, time: str, total: str, span: float, order: Sequence[str] = ()) -> DataFrame:
    """Rate of a running ``total`` over the last ``span`` of ``time`` at each row, null where no time has passed.

    The rate counts from an anchor: the latest sample at least ``span`` old, or the first where none is. So it spans at least that long once the log does.
    """
    w = W.partitionBy(key).orderBy(time)
    old = w.rangeBetween(W.unboundedPreceding, -span)
    first = W.partitionBy(key).orderBy(time, *order).rowsBetween(W.unboundedPreceding, 0)
    sample = F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(total).alias("v"))
    anchor = F.coalesce(F.max(sample).over(old), F.first(sample).over(first))
    d = log.withColumn("__a", anchor)
    took = F.col(time) - F.col("__a.t")
    return d.withColumn("recent", F.when(took > 0, (F.col(total) - F.col("__a.v")) / took)).withColumn("spanned", took).drop("__a")


def same_files(files: DataFrame) -> DataFrame:
    """Files that count as the same: equal sizes."""
    return files.groupBy("length").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("first_file")).where("files > 1")


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Batches of at most ``size`` rows of equal shape, in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def queue_order(jobs: DataFrame) -> DataFrame:
    """Order of service: least priority value first, first come first served among equals."""
    return jobs.withColumn("turn", F.row_number().over(W.partitionBy("nvr").orderBy("priority", "seq")))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both, the greatest version of each key; the new one of equals."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def frames_of_images(sightings: DataFrame, index: DataFrame) -> DataFrame:
    """The frame that each sighting's picture was made of; sightings without a picture are left out."""
    return sightings.join(index.select("image", "frame"), "image")


def whole_crops(crops: DataFrame) -> DataFrame:
    """Crops that hold a pixel; an empty one would stop a detector's run."""
    return crops.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def fan_out_pictures(pictures: DataFrame, kinds: Sequence[str] = ("raw", "overlay", "crop")) -> DataFrame:
    """(picture, kind, name): what a picture is shared as; its crops are named by their number where there are several."""
    p = pictures.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    names = F.when(F.col("kind") == "crop", crop_names(F.col("picture"), F.col("crops"))).otherwise(F.array("picture"))
    return p.select("picture", "kind", F.explode(names).alias("name")).select("picture", "kind", F.concat_ws("/", "kind", "name").alias("name"))


def transfers(matched: DataFrame, folder: str, move: bool = False) -> DataFrame:
    """(source, target, action) of matched clips: each goes to ``folder`` under its own name as soon as it is found."""
    name = F.regexp_replace(F.col("file"), r"^.*/", "")
    return matched.select(F.col("file").alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("target"), F.lit("move" if move else "copy").alias("action"))
