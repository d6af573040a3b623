"""Session helpers: one place for the settings every query relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "weir", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC time and adaptive execution, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever folder the driver was started in.

    Executors that share the repository's path find it there; elsewhere the
    package is expected on the workers (``--py-files``).
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below the cluster's checkpoint folder, in a temporary one only for a local session."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weir-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
