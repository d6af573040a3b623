"""Derived views over the star-schema tables, so that every operator has input.

No footage exists in the data folders: detections, recordings, frames and logs are
derived from ``events``, ``lineitem`` and ``embeddings`` by fixed rules. ``oracle.py`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.session import table

HOUR = 3_600_000_000


def micros(col: str):
    """Microseconds since the epoch of a time without zone (sessions run in UTC)."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of four cameras."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        (F.col("user_id") % 4).alias("camera"),
        F.when(F.col("event_type").isin("click", "view"), "engage").otherwise(F.col("event_type")).alias("target"),
        F.col("event_type").alias("cls"),
        F.col("ts").alias("t"),
        micros("ts").alias("us"),
        (F.col("value") / 500.0).alias("conf"),
        ((i * 37) % 1800).cast("double").alias("x1"),
        ((i * 53) % 1000).cast("double").alias("y1"),
        ((i * 37) % 1800 + 10 + i % 90).cast("double").alias("x2"),
        ((i * 53) % 1000 + 10 + i % 60).cast("double").alias("y2"),
        F.when(i % 3 == 0, "live").otherwise("nvr").alias("src"),
        i.alias("frame"),
    )


def doubled_hits(spark: SparkSession, sf: str) -> DataFrame:
    """All hits as recorded, and a fifth of them again as seen live 200 ms later."""
    h = hits(spark, sf).withColumn("src", F.lit("nvr"))
    late = h.where("frame % 5 = 0").withColumn("src", F.lit("live")).withColumn("us", F.col("us") + 200_000)
    late = late.withColumn("t", F.expr("t + INTERVAL '0.2' SECOND"))
    return h.unionByName(late.withColumns({c: F.col(c) + 3 for c in ("x1", "y1", "x2", "y2")}))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """One recording for each camera and hour with an event: file, camera, bucket, true start and end in microseconds."""
    h = hits(spark, sf).select("camera", F.expr(f"us div {HOUR}").alias("bucket")).distinct()
    start, end = F.col("bucket") * HOUR, F.col("bucket") * HOUR + HOUR - F.when(F.col("bucket") % 24 % 6 == 5, 5_000_000).otherwise(0)
    at = lambda us, form: F.date_format(F.timestamp_micros(us), form)
    stem = (
        F.when((F.dayofmonth(F.timestamp_micros(start)) == 15) & (F.col("bucket") % 24 == 3), F.concat(F.lit("clip_"), F.col("bucket").cast("string")))
        .when(F.col("bucket") % 2 == 0, F.concat(F.lit("rec_"), at(start, "yyyyMMddHHmmss"), F.lit("_"), at(end, "yyyyMMddHHmmss")))
        .otherwise(at(start, "yyyy-MM-dd_HHmmss"))
    )
    return h.select(F.concat(F.lit("cam"), F.col("camera").cast("string"), F.lit("/"), stem, F.lit(".mp4")).alias("file"), "camera", "bucket", start.alias("true_start"), end.alias("true_end"))


def file_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with the recording they lie in and their offset in seconds."""
    r = recordings(spark, sf).select("file", F.col("camera").alias("rc"), "bucket")
    h = hits(spark, sf).withColumn("hb", F.expr(f"us div {HOUR}"))
    j = h.join(r, (F.col("camera") == F.col("rc")) & (F.col("hb") == F.col("bucket")))
    return j.select("file", ((F.col("us") - F.col("bucket") * HOUR) / 1e6).alias("offset"), "target", "cls", "conf", "x1", "y1", "x2", "y2", "frame", "camera")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """A score for each frame of a camera's chain."""
    from pyspark.sql import Window as W

    h = hits(spark, sf)
    idx = F.row_number().over(W.partitionBy("camera").orderBy("us", "frame")) - 1
    return h.select("camera", idx.cast("long").alias("idx"), F.col("conf").alias("score"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned spans of each camera in microseconds."""
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 4).alias("camera"), micros("ts").alias("s"), (micros("ts") + 60_000_000 + F.floor(F.col("value") * 10).cast("long") * 1_000_000).alias("e"))


def clip_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled detections of clips."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("cls"), (F.col("l_discount") * 10).alias("conf"))


def downloads(spark: SparkSession, sf: str) -> DataFrame:
    """Download log, numbered in order within each recorder."""
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    n = F.row_number().over(W.partitionBy(F.col("l_suppkey") % 5).orderBy(*order))
    return li.select((F.col("l_suppkey") % 5).alias("nvr"), n.cast("long").alias("n"), F.round(F.col("l_extendedprice") * 1000).cast("long").alias("bytes"), (F.col("l_quantity") - 1).alias("secs"), (n * 2.0).alias("began"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run log records of users."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("click", "view"), "checkpoint").when(F.col("event_type") == "purchase", "end")
    return e.select(F.col("user_id").alias("job"), micros("ts").alias("us"), "event_id", kind.alias("type"), (F.col("value") * 100).alias("frames")).where("type is not null")


def raw_files(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files of four cameras with their bytes: 2 x 2 pixels a frame, some files short, some without a rate."""
    from weir.sources.frames import raw_file

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    frames = F.col("z") % 7 + 1
    there = (frames - F.when(F.col("k") % 5 == 0, 1).otherwise(0)) * 4
    byte = lambda i: F.lpad(F.hex((F.col("k") + i) % 256), 2, "0")
    pixels = F.unhex(F.when(there > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), there.cast("long") - 1), byte), "")).otherwise(""))
    content = raw_file(F.col("z") % 3 * 12.5, F.lit(2), F.lit(2), frames, F.lit(3), pixels)
    return p.select((F.col("k") % 4).alias("camera"), F.concat(F.lit("clip"), F.col("k").cast("string"), F.lit(".raw")).alias("file"), content.alias("content"))


#: Two shapes of a region, as drawn on a 1920 x 1080 frame.
REGION = [[(400, 300), (900, 250), (1000, 700), (450, 800)], [(1200, 100), (1500, 100), (1350, 400)]]
FRAME_W, FRAME_H = 1920, 1080
