"""Sightings over streams of hits.

``exact_sightings`` drops nothing, however late: each micro-batch is appended to the stored hits and the
touched cameras and targets are rebuilt. ``windowed_sightings`` keeps state only up to a watermark and is
approximate for later rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.sightings import camera_sightings


def exact_sightings(hits: DataFrame, store: str, out: str, gap: int, checkpoint: str, trigger: dict | None = None):
    """Start a query that keeps the folder ``out`` (by camera and target) equal to the batch result over all hits so far.

    A batch is written to a folder of its own number, so running it again after a failure changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = rows.select("camera", "target").distinct()
        every = spark.read.option("basePath", store).parquet(f"{store}/batch=*").drop("batch")
        again = camera_sightings(every.join(touched, ["camera", "target"], "left_semi"), gap)
        (
            again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("camera", "target").parquet(out)
        )

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_sightings(hits: DataFrame, gap: str = "3600 seconds", delay: str = "1 hour") -> DataFrame:
    """Session windows by camera and target. The window's end is a gap after the last hit; ``end`` is the last hit."""
    h = hits.withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", delay)
    g = h.groupBy("camera", "target", F.session_window("at", gap)).agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("hits"), F.max("conf").alias("max_conf"))
    return g.select("camera", "target", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "hits", "max_conf")


def chunk_counts(hits: DataFrame, step: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Hits by camera in tumbling chunks, aligned to the epoch."""
    h = hits.withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", delay)
    g = h.groupBy("camera", F.window("at", step)).agg(F.count(F.lit(1)).alias("hits"))
    return g.select("camera", F.col("window.start").cast("timestamp_ntz").alias("chunk"), "hits")


def snapshot_changes(rows: DataFrame, seen: str, out: str, gap: int, checkpoint: str, trigger: dict | None = None):
    """Follow snapshots of sightings (camera, target, start_us, end_us): each micro-batch's rows are new, grown or unchanged against all seen before.

    What was seen lies in the folder ``seen``, a folder a batch; a sighting's latest range counts. Running a batch again after a failure changes nothing.
    """
    keys = ["camera", "target"]

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        now = rows.select(*keys, "start_us", "end_us").distinct()
        try:
            before = spark.read.option("basePath", seen).parquet(f"{seen}/batch=*").where(F.col("batch") < number)
            before = before.groupBy(*keys, "start_us").agg(F.max("end_us").alias("end_us"))
        except AnalysisException:  # nothing seen yet
            before = now.limit(0)
        known = before.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start_us").alias("__s"), F.col("end_us").alias("__e"))
        on = (F.col("start_us") <= F.col("__e") + gap) & (F.col("__s") <= F.col("end_us") + gap)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        best = now.join(known, on, "left").groupBy(*keys, "start_us", "end_us").agg(F.max("__e").alias("__e"))
        change = F.when(F.col("__e").isNull(), "new").when(F.col("end_us") > F.col("__e"), "grown").otherwise("unchanged")
        best.select(*keys, "start_us", "end_us", change.alias("change")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        now.write.mode("overwrite").parquet(f"{seen}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_events(flags: DataFrame, min_frames: int, pre: int, post: int, chain: str = "camera") -> DataFrame:
    """Motion events of a stream of flags (chain, idx, motion), as ``motion.events`` gives them; an event is given once it has ended.

    Frames of a chain arrive in order. State is a few numbers a chain: the run, the session's last motion, the open event and the last event's end.
    """
    kind = flags.schema[chain].dataType.simpleString()

    def step(key, batches, state):
        import pandas as pd

        run, last, start, confirmed, ended, prior = state.get if state.exists else (0, -1, -1, -1, -1, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values("idx")
        for idx, motion in zip(rows["idx"].tolist(), rows["motion"].tolist()):
            if last >= 0 and idx - last > post:
                if confirmed >= 0:
                    out.append((key[0], start, confirmed, last + post))
                    ended = last + post
                last = start = confirmed = -1
            if not motion:
                run, prior = 0, idx
                continue
            run = run + 1 if prior == idx - 1 and run else 1
            prior = last = idx
            if run >= min_frames and confirmed < 0:
                start, confirmed = max(idx - pre + 1, ended + 1, 0), idx
        state.update((run, last, start, confirmed, ended, prior))
        yield pd.DataFrame(out, columns=[chain, "start", "confirmed_at", "end"])

    names = ("run", "last", "start", "confirmed", "ended", "prior")
    return flags.groupBy(chain).applyInPandasWithState(step, f"{chain} {kind}, start long, confirmed_at long, end long", ", ".join(f"{n} long" for n in names), "append", "NoTimeout")


def settled(chunks: DataFrame, now: str, wait_s: int = 90) -> DataFrame:
    """Chunks (with ``chunk_end``) that ended long enough ago to be fetched."""
    return chunks.where(F.col("chunk_end") + F.make_dt_interval(secs=F.lit(wait_s)) <= F.to_timestamp(F.lit(now)))


def each_batch(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 3):
    """Run ``work`` on micro-batches at most every few seconds; its batch number makes it idempotent."""
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
