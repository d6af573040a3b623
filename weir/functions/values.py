"""Durations, times, messages, fingerprints and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(text: Column) -> Column:
    """``1h30m45s`` in any subset and either case, or a bare number of minutes; null if neither."""
    text = F.lower(F.trim(text))
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    parts = part("h") * 3600 + part("m") * 60 + part("s")
    bare = text.rlike(r"^\d+(\.\d+)?$")
    minutes = F.nullif(F.regexp_extract(text, r"^(\d+(\.\d+)?)$", 1), F.lit("")).cast("double")
    return F.when(bare, minutes * 60).when(text.rlike(r"^(\d+h)?(\d+m)?(\d+s)?$") & (F.length(text) > 0), parts)


def parse_start(text: Column, today: Column) -> Column:
    """A start time in one of three full forms, or a time of day on ``today`` (a date); null otherwise."""
    text = F.trim(text)
    full = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")]
    day = [F.try_to_timestamp(F.concat(F.date_format(today, "yyyy-MM-dd"), F.lit(" "), text), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")]
    return F.coalesce(*full, *day).cast("timestamp_ntz")


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding of exact ties to the even neighbour."""
    return F.bround(value, digits)


def iso_millis(us: Column) -> Column:
    """Microseconds since the epoch as text, cut (not rounded) to milliseconds."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def clock(seconds: Column) -> Column:
    """h:mm:ss of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    """Bar of ``width`` characters."""
    full = F.floor(done * width / F.greatest(total, F.lit(1))).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Time left at the average pace; null before anything is done."""
    return F.when(done > 0, elapsed * (total - done) / done)


def megabits(size: Column, seconds: Column) -> Column:
    """Mbit/s of bytes and seconds; seconds are floored so that none divide by zero."""
    return size * 8 / F.greatest(seconds, F.lit(1e-6)) / 1e6


def motion_fingerprint(files: Column, region: Column, settings: dict[str, Column]) -> Column:
    """sha256 of what decides a motion scan's work: its files (structs of path, size and mtime, in their order), the region's file and settings.

    Paths count with forward slashes and times in whole seconds, so a state stays valid on another machine; the number of workers isn't part of it.
    """
    one = lambda f: F.concat_ws("|", F.translate(f["path"], "\\", "/"), f["size"].cast("string"), F.floor(f["mtime"]).cast("long").cast("string"))
    parts = [F.concat(F.lit(k + "="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in sorted(settings.items()) if k != "workers"]
    region = F.when(region.isNull(), F.lit("no region")).otherwise(F.concat(F.lit("region "), one(region)))
    return F.sha2(F.array_join(F.concat(F.transform(files, one), F.array(region, *parts)), "\n"), 256)


def setting(spark, key: str, env_file: str | None = None, default: str | None = None) -> str | None:
    """A setting from an env file (text lines ``KEY=value``), else the environment, else the default; empty values count as unset."""
    import os

    found: dict[str, str] = {}
    if env_file:
        from weir.sources.files import read_env

        found = read_env(spark, env_file)
    return found.get(key) or os.environ.get(key) or default


def budget(message: Column) -> Column:
    """struct(cost, budget) of a base64 JSON message."""
    body = F.from_json(F.decode(F.unbase64(message), "utf-8"), "costAmount double, budgetAmount double")
    return F.struct(body["costAmount"].alias("cost"), body["budgetAmount"].alias("budget"))


def fingerprint(settings: dict[str, Column]) -> Column:
    """sha256 over the settings in the order of their names; an engine counts as the model it was built from."""
    parts = [F.concat(F.lit(k + "="), F.coalesce(F.regexp_replace(v.cast("string"), r"\.engine$", ".pt"), F.lit("null"))) for k, v in sorted(settings.items())]
    return F.sha2(F.array_join(F.array(*parts), "\n"), 256)
