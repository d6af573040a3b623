"""Names of recordings, pictures and cameras as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file kinds that count as recordings.
VIDEO_KINDS = ("mp4", "avi", "mkv", "mov", "ts", "dav")

_PAIR = r"_(\d{14})_(\d{14})(?:_|$)"
_DATED = r"(\d{4}-\d{2}-\d{2}_\d{6})"


def is_video(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*VIDEO_KINDS)


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def recording_times(path: Column) -> Column:
    """struct(start, end) of a recording by its name; null where the name doesn't tell. A start-and-end pair goes first."""
    s = stem(path)
    pair = s.rlike(_PAIR)
    first = F.try_to_timestamp(F.regexp_extract(s, _PAIR, 1), F.lit("yyyyMMddHHmmss"))
    second = F.try_to_timestamp(F.regexp_extract(s, _PAIR, 2), F.lit("yyyyMMddHHmmss"))
    dated = F.try_to_timestamp(F.regexp_extract(s, _DATED, 1), F.lit("yyyy-MM-dd_HHmmss"))
    return F.struct(F.when(pair, first).otherwise(dated).cast("timestamp_ntz").alias("start"), F.when(pair, second).cast("timestamp_ntz").alias("end"))


def natural_key(name: Column) -> Column:
    """Sorts digits as numbers and text without case."""
    s = F.lower(name)
    digits = F.transform(F.regexp_extract_all(s, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: x.cast("decimal(38,0)"))
    return F.arrays_zip(F.split(s, "[0-9]+").alias("t"), digits.alias("n"))


def image_name(target: Column, start: Column, file: Column, offset: Column) -> Column:
    """Picture of a sighting: by its start, else by the file's stem and the offset."""
    dated = F.concat(target, F.lit("_"), F.date_format(start, "yyyyMMdd-HHmmss"))
    return F.coalesce(dated, F.concat(target, F.lit("_"), stem(file), F.lit("_"), F.format_string("%08.1f", offset), F.lit("s")))


def share_name(start: Column, camera: Column, target: Column, clashes: Column) -> Column:
    """Name of a shared picture; the target is named where a camera has several pictures of one second."""
    base = F.concat(F.date_format(start, "yyyyMMdd-HHmmss"), F.lit("-"), camera)
    return F.concat(base, F.when(clashes > 1, F.concat(F.lit("-"), target)).otherwise(""), F.lit(".jpg"))


def crop_names(name: Column, n: Column) -> Column:
    """Names of n crops of a picture: its own for one, numbered for more."""
    root = F.regexp_replace(name, r"\.jpg$", "")
    numbered = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(root, F.lit("-"), i.cast("string"), F.lit(".jpg")))
    return F.when(n == 1, F.array(name)).when(n < 1, F.array().cast("array<string>")).otherwise(numbered)


def is_default_camera(name: Column) -> Column:
    return F.rlike(name, F.lit(r"(?i)^(channel|ipcamera|camera)\s*\d+$"))


def split_list(text: Column) -> Column:
    """Comma list to trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def export_entry(line: Column) -> Column:
    """struct(id, stamp) of an export list's line: the first time, and the 17 digits before it."""
    pattern = r"^(.*?)(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
    return F.struct(F.nullif(F.regexp_extract(F.regexp_extract(line, pattern, 1), r"(\d{17})\D*$", 1), F.lit("")).alias("id"), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).alias("stamp"))


def stamp_to_name(stamp: Column) -> Column:
    """A time as part of a file name: no colons, no spaces."""
    return F.translate(F.replace(stamp, F.lit(":"), F.lit("")), " ", "_")
