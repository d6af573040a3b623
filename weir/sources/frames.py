"""Frames of recordings through a plug-in reader, over files read by Spark's binary source.

A reader turns a file's bytes into a header and frames; ``RawReader`` reads an uncompressed format, a codec takes its place by the same two
methods. What is relational (probing, chaining, cutting, point lookups) is here: files are rows (file, content).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.operators.motion import chain_offsets

FPS, WARM_UP = 25.0, 50  #: rate where the header has none; frames decoded and dropped before a seek's target
PIXELS, ROWS = 1 << 20, 10_000  #: frames that are handed on together, whatever files they come from


class RawReader:
    """``RAWV fps width height frames every`` in a line (fps 0: unknown; every so many frames a keyframe), then a byte a pixel."""

    def header(self, content: bytes) -> tuple[float, int, int, int, int]:
        line, _, _ = content.partition(b"\n")
        kind, fps, width, height, frames, every = line.decode("ascii").split(" ")
        if kind != "RAWV":
            raise ValueError("not raw frames")
        return float(fps) or FPS, int(width), int(height), int(frames), int(every)

    def frames(self, content: bytes, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(index, pixels) from ``start`` on; a file that ends early gives fewer frames than its header says."""
        _, width, height, count, _ = self.header(content)
        at = content.index(b"\n") + 1
        for i in range(start, count):
            raw = content[at + i * width * height : at + (i + 1) * width * height]
            if len(raw) < width * height:
                return
            yield i, np.frombuffer(raw, dtype=np.uint8).reshape(height, width)


def raw_file(fps: Column, width: Column, height: Column, frames: Column, every: Column, pixels: Column) -> Column:
    """Bytes of a raw file from columns; ``pixels`` is binary."""
    head = F.concat_ws(" ", F.lit("RAWV"), *[c.cast("string") for c in (fps, width, height, frames, every)])
    return F.concat(F.encode(F.concat(head, F.lit("\n")), "utf-8"), pixels)


def probe(files: DataFrame, reader=RawReader) -> DataFrame:
    """(file, fps, width, height, frames, duration): fps is 25 where the header has none; all null where the header can't be read."""

    @F.pandas_udf("fps double, width long, height long, frames long")
    def head(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append(reader().header(bytes(c))[:4])
            except Exception:
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["fps", "width", "height", "frames"]).astype({"fps": "float64", "width": "Int64", "height": "Int64", "frames": "Int64"})

    p = files.select(*[c for c in files.columns if c != "content"], head("content").alias("h")).select("*", "h.*").drop("h")
    return p.withColumn("fps", F.nanvl("fps", F.lit(None))).withColumn("duration", F.col("frames") / F.col("fps"))


def chain(probed: DataFrame, keys: str = "camera") -> DataFrame:
    """Probed files as one chain of frames in natural order, with ``first_frame``. Unreadable files or another resolution than the chain's first file fail the query."""
    w = W.partitionBy(keys)
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct("width", "height"))
    c = chain_offsets(probed, keys, "file").withColumns({"__least": F.min(size).over(w), "__most": F.max(size).over(w), "__bad": F.count_if(F.col("frames").isNull()).over(w)})
    fails = F.when(F.col("__bad") > 0, F.raise_error(F.lit("a file of the chain can't be opened"))).when(F.col("__least") != F.col("__most"), F.raise_error(F.lit("all files of a chain must have one resolution")))
    return c.withColumn("first_frame", F.coalesce(fails.cast("long"), F.col("first_frame"))).drop("__least", "__most", "__bad")


def frame_batches(reader=RawReader):
    """Batches of (camera, file, content, first_frame, start, end) -> batches of frames, up to ``PIXELS`` or ``ROWS`` of them in one."""
    names = ["camera", "idx", "file", "frame", "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            camera, file, content, *columns = batch.columns
            first, start, end = (c.to_pylist() for c in columns)
            at, idx, frame, held, size = [], [], [], [], 0

            def rows() -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *held], dtype=np.int32)))
                of = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([camera.take(of), pa.array(idx, pa.int64()), file.take(of), pa.array(frame, pa.int64()), pixels], names=names)

            for r in range(batch.num_rows):
                begin, base = start[r] or 0, first[r]
                for i, pixels in reader().frames(content[r].as_py(), max(0, begin - WARM_UP)):
                    if end[r] is not None and i >= end[r]:
                        break
                    if i < begin:
                        continue
                    at.append(r)
                    idx.append(None if base is None else base + i - begin)
                    frame.append(i)
                    held.append(pixels.reshape(-1))
                    size += pixels.size
                    if size >= PIXELS or len(at) >= ROWS:
                        yield rows()
                        at, idx, frame, held, size = [], [], [], [], 0
            yield rows()

    return run


def read_frames(files: DataFrame, reader=RawReader) -> DataFrame:
    """Frames of rows (camera, file, content, first_frame, and optionally start and end in the file): camera, idx, file, frame, pixels.

    A seek decodes from ``WARM_UP`` frames before its target and drops them. Short files give the frames they have.
    """
    cut = files if "start" in files.columns else files.withColumn("start", F.lit(0).cast("long")).withColumn("end", F.lit(None).cast("long"))
    kind = files.schema["camera"].dataType.simpleString()
    return cut.select("camera", "file", "content", "first_frame", "start", "end").mapInArrow(frame_batches(reader), f"camera {kind}, idx long, file string, frame long, pixels array<int>")


def keyframes(files: DataFrame, reader=RawReader) -> DataFrame:
    """(file, offset, pixels) of every keyframe, offsets in seconds from the file's first frame."""

    @F.pandas_udf("array<struct<offset:double,pixels:array<int>>>")
    def keys(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            fps, *_, every = reader().header(bytes(c))
            out.append([{"offset": i / fps, "pixels": p.reshape(-1).tolist()} for i, p in reader().frames(bytes(c)) if i % every == 0])
        return pd.Series(out)

    return files.select("file", F.explode(keys("content")).alias("k")).select("file", "k.offset", "k.pixels")


def grab_keyframe(found: DataFrame, asked: DataFrame, before: float = 0.5) -> DataFrame:
    """The first keyframe from ``before`` seconds ahead of each asked (id, file, offset); null past the last keyframe."""
    a = asked.select("id", "file", F.col("offset").alias("__at"))
    j = a.join(found.select(F.col("file").alias("__f"), "offset", "pixels"), (F.col("file") == F.col("__f")) & (F.col("offset") >= F.col("__at") - before), "left")
    return j.groupBy("id", "file").agg(F.min(F.struct("offset", "pixels")).alias("k")).select("id", "file", "k.offset", "k.pixels")
