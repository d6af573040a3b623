"""Readers and writers of the file formats, through Spark's own sources so that any store works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.names import VIDEO_KINDS, export_entry, is_video, natural_key, posix, stamp_to_name

HIT = "file string, offset double, target string, cls string, conf double, box array<double>"
CAMERA_HIT = "t string, target string, cls string, conf double, box array<double>, frame string, src string"
SIGHTING = "target string, start string, end string, duration_s double, file string, offset_s double, hits long, max_conf double, raw_classes string, nearest_px double, image string"
CAMERA_SIGHTING = "camera string, target string, start string, end string, duration_s double, hits long, max_conf double, raw_classes string, nearest_px double, source string, image string"
EVENT = "clip_name string, segments array<struct<file:string,start:bigint,end:bigint>>"
RUN = "run_id string, ts string, type string, job string, note string, host string, os string, cpus int, resumed boolean, prep_s double, segments_total long, segments_pending long, frames_pending long, elapsed_s double, frames_reported long, queue_backlog long, status string, events long, frames long, fps double"
DOWNLOAD = "time string, nvr string, chunk string, chunk_s double, mode string, bytes long, secs double, mbps double, slots_busy int, attempt int"
REGION = "source string, frame_width int, frame_height int, points array<array<array<int>>>"


def find_videos(spark: SparkSession, folder: str, recursive: bool = False, exclude: str | None = None, natural: bool = True) -> DataFrame:
    """Recordings of a folder (or one file): rel, length, mtime; contents aren't read. ``exclude`` leaves out a subtree."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    found = found.select("path", "length", F.unix_timestamp("modificationTime").alias("mtime")).where(is_video(F.col("path")))
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    # what follows the folder's first mention; a file named as the folder itself keeps its name
    rel = F.substring_index(posix(F.col("path")), "/", -1) if base.rsplit(".", 1)[-1].lower() in VIDEO_KINDS else F.substr(F.col("path"), F.instr(F.col("path"), F.lit(base + "/")) + F.lit(len(base) + 1))
    if exclude:
        out = exclude.rstrip("/").split(":", 1)[-1].lstrip("/")
        at = out[len(base) + 1 :] if out.startswith(base + "/") else out
        found = found.where(~F.startswith(rel, F.lit(at + "/")))
    found = found.select(rel.alias("file"), "length", "mtime")
    return found.orderBy(natural_key(F.col("file")) if natural else F.col("file"))


def read_json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; torn and blank lines are left out, or fail the query if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State in JSON; a missing or broken file counts as empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte order mark is dropped by the reader."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(path)


def read_camera_tables(spark: SparkSession, root: str, schema: str = CAMERA_SIGHTING) -> DataFrame:
    """Sighting tables of all cameras below a root; the camera is the name of its folder."""
    rows = read_csv(spark, f"{root}/*/sightings/sightings.csv", schema)
    if "camera" in rows.columns:
        rows = rows.drop("camera")
    return rows.withColumn("camera", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/sightings/sightings\.csv$", 1))


def valid_times(rows: DataFrame, form: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Rows whose start and end can be read."""
    at = lambda c: F.try_to_timestamp(F.col(c), F.lit(form)).cast("timestamp_ntz")
    return rows.withColumn("start_t", at("start")).withColumn("end_t", at("end")).where("start_t is not null and end_t is not null")


def read_region(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGION).option("multiLine", "true").json(path)


def save_region(region: DataFrame, path: str) -> None:
    region.coalesce(1).write.mode("overwrite").json(path)


def read_export_list(spark: SparkSession, path: str) -> DataFrame:
    """id, stamp and new name of each line that holds a time."""
    e = spark.read.text(path).select(export_entry(F.col("value")).alias("e")).where("e.stamp is not null")
    return e.select("e.id", "e.stamp", stamp_to_name(F.col("e.stamp")).alias("new_name"))


def append_json(rows: DataFrame, path: str) -> None:
    """Append a batch; a batch is there whole or not at all."""
    rows.write.mode("append").json(path)


def append_log(rows: DataFrame, path: str) -> bool:
    """Append records to a run log, best effort: a log that can't be written never stops the run."""
    try:
        append_json(rows, path)
        return True
    except Exception as e:  # whatever the store raises
        print(f"run log {path}: {type(e).__name__}: {str(e)[:200]}")
        return False


def replace_file(spark: SparkSession, new: str, path: str, tries: int = 50, wait: float = 0.1) -> bool:
    """Put the file ``new`` in the place of ``path`` in one step; a reader that holds the old one is waited for, then ``new`` is dropped."""
    import time

    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if "://" in path else fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.java.lang.Enum.valueOf(spark.sparkContext._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    for _ in range(tries):
        try:
            context.rename(fs.Path(new), fs.Path(path), overwrite)
            return True
        except Exception:  # held open by a reader
            time.sleep(wait)
    context.delete(fs.Path(new), True)
    return False


def rebuild_csv(rows: DataFrame, path: str) -> bool:
    """Replace a table's one file in one step: readers see the old or the new one, and a rebuild that fails leaves the old one. Missing values are empty, the file starts with a byte order mark.

    The table is written aside first, so nothing is touched before the query has succeeded.
    """
    import uuid

    spark = rows.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}.part"
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = fs.Path(aside)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        marked.coalesce(1).write.option("header", "true").option("emptyValue", "").csv(aside)
        parts = [f.getPath().toString() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")]
        return replace_file(spark, parts[0], path)
    finally:
        store.delete(folder, True)


def read_env(spark: SparkSession, path: str) -> dict[str, str]:
    """``KEY=value`` lines of a settings file; blank lines, comments and lines without a sign are left out, quotes are dropped, the last of a key counts."""
    jvm = spark.sparkContext._jvm  # names that begin with a dot are hidden from Spark's own readers
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return {}
    stream = store.open(where)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    lines = [x.strip() for x in text.splitlines()]
    pairs = [x.split("=", 1) for x in lines if x and not x.startswith("#") and "=" in x]
    return {k.strip(): v.strip().strip('"') for k, v in pairs}


def changed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """(file, change): files that are new, changed (another size or time) or gone since ``known``, both (file, length, mtime)."""
    k = known.select("file", F.col("length").alias("__l"), F.col("mtime").alias("__m"), F.lit(True).alias("__k"))
    j = found.withColumn("__f", F.lit(True)).join(k, "file", "full")
    change = F.when(F.col("__k").isNull(), "new").when(F.col("__f").isNull(), "gone").when(~(F.col("length").eqNullSafe(F.col("__l")) & F.col("mtime").eqNullSafe(F.col("__m"))), "changed")
    return j.select("file", change.alias("change")).where("change is not null")


def write_cameras(rows: DataFrame, path: str) -> None:
    """A folder for each camera, so a filter on camera reads only its own."""
    rows.write.mode("overwrite").partitionBy("camera").parquet(path)


def supersede(spark: SparkSession, path: str, rows: DataFrame, fingerprint: str) -> None:
    """Hits of each set of settings in a folder of their own; older ones stay beside."""
    rows.withColumn("fp", F.lit(fingerprint)).write.mode("append").partitionBy("fp").parquet(path)


def resolve_cameras(specs: DataFrame) -> DataFrame:
    """``nvr:1,2 nvr2:3`` as rows (nvr, channel) in order, each once."""
    s = specs.select(F.posexplode(F.split(F.trim("spec"), r"\s+")).alias("a", "item"))
    s = s.select("a", F.split("item", ":")[0].alias("nvr"), F.posexplode(F.split(F.split("item", ":")[1], ",")).alias("b", "channel"))
    first = s.groupBy("nvr", "channel").agg(F.min(F.struct("a", "b")).alias("p"))
    return first.select("nvr", F.col("channel").cast("int").alias("channel"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
