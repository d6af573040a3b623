"""Motion events on a series of frame scores, as plain windows: runs, hysteresis, pre-roll, manifests, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.functions.names import natural_key, stem
from weir.operators.islands import gap_sessions, number_islands


def seconds_to_frames(seconds: Column | float, fps: Column | float) -> Column:
    """Whole frames in a time span, at least one."""
    s, f = (x if isinstance(x, Column) else F.lit(float(x)) for x in (seconds, fps))
    return F.greatest((s * f).cast("int"), F.lit(1))


def motion_flags(frames: DataFrame, threshold: float, warmup: int, skip: int = 1, chain: str = "camera") -> DataFrame:
    """Whether each frame shows motion. Frames between samples carry the last sample's decision; samples before ``warmup`` show none."""
    sampled = F.col("idx") - F.col("idx") % skip
    own = (F.col("score") >= threshold) & (F.col("idx") >= warmup)
    w = W.partitionBy(chain, sampled).orderBy("idx")
    return frames.withColumn("motion", F.first(own).over(w))


def runs(flags: DataFrame, min_frames: int, chain: str = "camera") -> DataFrame:
    """Runs of consecutive motion frames with their length; ``confirmed`` from ``min_frames`` on."""
    m = flags.where("motion")
    w = W.partitionBy(chain).orderBy("idx")
    m = m.withColumn("island", F.col("idx") - F.row_number().over(w))
    g = m.groupBy(chain, "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("frames"))
    return g.drop("island").withColumn("confirmed", F.col("frames") >= min_frames)


def events(flags: DataFrame, min_frames: int, pre: int, post: int, chain: str = "camera") -> DataFrame:
    """Events [start, end] of each chain.

    Motion frames at most ``post`` apart make a session; it becomes an event at the first frame where a run
    reaches ``min_frames``. The event starts ``pre`` frames back from there, but after the previous event, and ends ``post``
    frames after the session's last motion or with the chain.
    """
    last = flags.groupBy(chain).agg(F.max("idx").alias("chain_end"))
    m = flags.where("motion")
    w = W.partitionBy(chain).orderBy("idx")
    m = m.withColumn("island", F.col("idx") - F.row_number().over(w))
    m = m.withColumn("run", F.row_number().over(W.partitionBy(chain, "island").orderBy("idx")))
    s = gap_sessions(m, [chain], "idx", post)
    e = s.groupBy(chain, "session").agg(F.min(F.when(F.col("run") >= min_frames, F.col("idx"))).alias("confirmed_at"), F.max("idx").alias("last_motion"))
    e = e.where("confirmed_at is not null").join(last, chain)
    e = e.withColumn("end", F.least(F.col("last_motion") + post, F.col("chain_end")))
    before = F.lag("end").over(W.partitionBy(chain).orderBy("confirmed_at"))
    e = e.withColumn("start", F.greatest(F.col("confirmed_at") - pre + 1, F.coalesce(before + 1, F.lit(0)), F.lit(0)))
    return e.select(chain, "start", "confirmed_at", "end")


def segments(files: DataFrame, size: int, keys=("camera", "file")) -> DataFrame:
    """Cut files of ``frames`` frames into parts of ``size``; what is left goes to the last part. Half-open ranges."""
    parts = F.greatest(F.expr(f"frames div {size}"), F.lit(1))
    d = files.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    end = F.when(F.col("part") == F.col("parts") - 1, F.col("frames")).otherwise((F.col("part") + 1) * size)
    return d.select(*keys, "frames", (F.col("part") * size).alias("start"), end.alias("end"), "part", "parts")


def chain_offsets(files: DataFrame, chain: str, order: str) -> DataFrame:
    """Global index of each file's first frame in its chain; files follow each other in natural order."""
    w = W.partitionBy(chain).orderBy(natural_key(F.col(order)), order).rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("first_frame", F.coalesce(F.sum("frames").over(w), F.lit(0)))


def slices(events_: DataFrame, files: DataFrame, chain: str = "camera", *also: str, grid: int = 100_000) -> DataFrame:
    """Frames of each event by file: the intersection of [start, end] with the files of its chain, empty ones left out.

    Both sides are spread over ``grid`` frames wide cells, so the join has an equality within a chain; a pair meets in the first cell they share.
    """
    f = files.where("frames > 0").withColumn("after", F.col("first_frame") + F.col("frames")).withColumnRenamed(chain, "__chain")
    f = f.withColumn("__fc", F.expr(f"first_frame div {grid}")).withColumn("__cell", F.explode(F.sequence("__fc", F.expr(f"(after - 1) div {grid}"))))
    e = events_.withColumn("__ec", F.expr(f"start div {grid}")).withColumn("__at", F.explode(F.sequence("__ec", F.expr(f"`end` div {grid}"))))
    on = (F.col(chain) == F.col("__chain")) & (F.col("__at") == F.col("__cell")) & (F.col("__cell") == F.greatest("__fc", "__ec"))
    on = on & (F.col("start") < F.col("after")) & (F.col("end") + 1 > F.col("first_frame"))
    lo = F.greatest(F.col("start"), F.col("first_frame")) - F.col("first_frame")
    hi = F.least(F.col("end") + 1, F.col("after")) - F.col("first_frame")
    return e.join(f, on).select(chain, "start", "end", "file", lo.alias("lo"), hi.alias("hi"), *also)


def segment_name(file: Column, part: Column, parts: Column) -> Column:
    """A file's stem, with its part's number as wide as the number of parts where the file was cut."""
    numbered = F.concat(stem(file), F.lit("_p"), F.lpad(part.cast("string"), F.length(parts.cast("string")), "0"))
    return F.when(parts <= 1, stem(file)).otherwise(numbered)


def manifest(events_: DataFrame, files: DataFrame, chain: str = "camera") -> DataFrame:
    """(clip_name, segments): an event is named after the file (or part, where ``files`` has part and parts) it starts in, numbered there in order; its files in the chain's order."""
    cut = {"part", "parts"} <= set(files.columns)
    named = files.withColumn("segment", segment_name(F.col("file"), F.col("part") + 1, F.col("parts")) if cut else stem(F.col("file")))
    from_ = F.col("from") if "from" in files.columns else F.lit(0)
    s = slices(events_, named.withColumn("__from", from_.cast("long")), chain, "segment", "first_frame", "__from")
    ordered = F.sort_array(F.collect_list(F.struct("first_frame", "segment", "file", (F.col("lo") + F.col("__from")).alias("lo"), (F.col("hi") + F.col("__from")).alias("hi"))))
    e = s.groupBy(chain, "start", "end").agg(ordered.alias("s"))
    e = e.withColumn("owner", F.col("s")[0]["segment"]).withColumn("segments", F.transform("s", lambda x: F.struct(x["file"].alias("file"), x["lo"].alias("lo"), x["hi"].alias("hi"))))
    n = F.row_number().over(W.partitionBy(chain, "owner").orderBy("start"))
    return e.select(chain, F.concat("owner", F.lit("_"), F.lpad(n.cast("string"), 4, "0"), F.lit(".mp4")).alias("clip_name"), "start", "end", F.size("segments").alias("n_segments"), "segments")


def find_file(points: DataFrame, files: DataFrame, chain: str = "camera") -> DataFrame:
    """The file that holds a frame index; indexes beyond the last file belong to it. As-of join by union and carry."""
    marks = files.select(F.col(chain), F.col("first_frame").alias("idx"), F.lit(0).alias("__o"), F.col("file"), F.lit(None).cast(points.schema["id"].dataType).alias("id"))
    asked = points.select(F.col(chain), "idx", F.lit(1).alias("__o"), F.lit(None).cast("string").alias("file"), "id")
    w = W.partitionBy(chain).orderBy("idx", "__o").rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("file", F.last("file", ignorenulls=True).over(w))
    return both.where("__o = 1").select("id", chain, "idx", "file")


def resume(segments_: DataFrame, done: DataFrame, chain: str = "camera", file: str = "file") -> DataFrame:
    """Which segments to run: those not done, and done ones whose successor in the same file isn't done (a margin)."""
    d = done.select(F.col(file).alias("__f"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.lit(True).alias("__d"))
    j = segments_.join(d, (F.col(file) == F.col("__f")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), "left")
    j = j.withColumn("done", F.coalesce("__d", F.lit(False))).drop("__f", "__s", "__e", "__d")
    following = F.lead("done").over(W.partitionBy(chain, file).orderBy("start"))
    return j.withColumn("redo", ~F.col("done") | F.coalesce(~following, F.lit(False)))


def pack(units: DataFrame, target: int, chain: str = "camera") -> DataFrame:
    """Pack units (pos, frames) in order into pieces: a piece ends once it holds ``target`` frames or the next position isn't adjacent.

    The running sum restarts at each cut. Stretches of adjacent positions are cut first and packed side by side; within one, a
    fold keeps only the ends of its pieces (one number each), and units are numbered by the ends before them.
    """
    cut = pieces_between_gaps(units, chain).withColumnRenamed("piece", "__stretch")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "frames")))
    zero = F.lit(0).cast("long")
    fold = F.aggregate(
        ordered,
        F.struct(zero.alias("held"), F.array().cast("array<bigint>").alias("ends")),
        lambda a, u: F.when(a["held"] + u["frames"] >= target, F.struct(zero.alias("held"), F.array_append(a["ends"], u["pos"]).alias("ends"))).otherwise(F.struct((a["held"] + u["frames"]).alias("held"), a["ends"].alias("ends"))),
        lambda a: a["ends"],
    )
    ends = cut.groupBy(chain, "__stretch").agg(fold.alias("ends"), F.max("pos").alias("last"))
    ends = ends.select(chain, F.explode(F.array_union("ends", F.array("last"))).alias("__end"))
    # the pieces' ends in one order over the chain: a unit's piece is the number of ends before it
    both = units.withColumn("__e", F.lit(0)).unionByName(ends.select(chain, F.col("__end").alias("pos"), F.lit(None).cast("long").alias("frames"), F.lit(1).alias("__e")), allowMissingColumns=True)
    w = W.partitionBy(chain).orderBy("pos", "__e").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("piece", F.sum("__e").over(w).cast("long"))
    return both.where("__e = 0").select(chain, "pos", "frames", "piece")


def hard_gaps(units: DataFrame, chain: str = "camera") -> DataFrame:
    """Mark units whose position doesn't follow on the one before."""
    w = W.partitionBy(chain).orderBy("pos")
    return units.withColumn("hard_gap", F.coalesce(F.col("pos") != F.lag("pos").over(w) + 1, F.lit(False)))


def spread(units: DataFrame, workers: int, chain: str = "camera") -> DataFrame:
    """Deal ordered units (pos, frames, hard_gap) out to workers by the share of frames before them; a hard gap goes on to the next worker.

    A worker is the greatest of the share here and of any earlier share plus the gaps since, at most the last: a running maximum.
    """
    w = W.partitionBy(chain).orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    before = F.coalesce(F.sum("frames").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("frames").over(W.partitionBy(chain))
    d = units.withColumn("__gaps", F.sum(F.col("hard_gap").cast("long")).over(so_far))
    share = F.when(~F.col("hard_gap"), F.least((before * workers / total).cast("long"), F.lit(workers - 1).cast("long")))
    d = d.withColumn("__share", share - F.col("__gaps"))
    reached = F.col("__gaps") + F.greatest(F.lit(0).cast("long"), F.coalesce(F.max("__share").over(so_far), F.lit(0).cast("long")))
    return d.withColumn("worker", F.least(reached, F.lit(workers - 1).cast("long"))).drop("__gaps", "__share")


def pieces_between_gaps(units: DataFrame, chain: str = "camera") -> DataFrame:
    """Number the adjacent stretches of positions."""
    w = W.partitionBy(chain).orderBy("pos")
    return number_islands(units, [chain], ["pos"], F.col("pos") != F.lag("pos").over(w) + 1, "piece")
