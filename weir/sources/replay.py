"""A data source that replays a table of frames in chunks, in batch or as a stream.

It stands where a recorder's download or live reader would: each partition reads one chunk, and
``keyframesOnly`` is applied inside the reader. Vendor readers implement ``read_chunk``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "chunk int, offset double, keyframe boolean, value double"


def read_chunk(chunk: int, frames: int, every: int, keyframes: bool) -> Iterator[tuple]:
    """Frames of a chunk: (chunk, offset, keyframe, value)."""
    for i in range(frames):
        key = i % every == 0
        if key or not keyframes:
            yield chunk, i / 25.0, key, float((chunk * 31 + i * 17) % 100)


class _Chunk(InputPartition):
    def __init__(self, chunk: int):
        self.chunk = chunk


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.chunks, self.frames = int(options.get("chunks", 4)), int(options.get("frames", 50))
        self.every, self.keyframes = int(options.get("every", 25)), options.get("keyframesonly", "false") == "true"

    def partitions(self):
        return [_Chunk(i) for i in range(self.chunks)]

    def read(self, partition):
        yield from read_chunk(partition.chunk, self.frames, self.every, self.keyframes)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.r = _Reader(options)

    def initialOffset(self):
        return {"chunk": 0}

    def read(self, start):
        at = start["chunk"]
        if at >= self.r.chunks:
            return iter(()), start
        return iter(list(read_chunk(at, self.r.frames, self.r.every, self.r.keyframes))), {"chunk": at + 1}

    def readBetweenOffsets(self, start, end):
        for chunk in range(start["chunk"], end["chunk"]):
            yield from read_chunk(chunk, self.r.frames, self.r.every, self.r.keyframes)


class ReplaySource(DataSource):
    """``spark.dataSource.register(ReplaySource)``, then format("replay")."""

    @classmethod
    def name(cls):
        return "replay"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options)
