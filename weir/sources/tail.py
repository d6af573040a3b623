"""A stream source over growing files: only bytes added since the last look are read.

A torn last line waits for the next look; a file that shrinks or is replaced starts over with the next ``generation``. Files lie on a
store that driver and executors both see. ``spark.dataSource.register(TailSource)``, then ``readStream.format("tail").option("path", glob)``.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def read_lines(path: str, start: int, end: int | None = None) -> tuple[list[str], int]:
    """Whole lines from byte ``start`` (to ``end``), and the byte after the last of them."""
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read() if end is None else f.read(end - start)
    whole = data[: data.rfind(b"\n") + 1]
    return [x.decode("utf-8", "replace") for x in whole.splitlines()], start + len(whole)


def advance(state: dict, paths: list[str]) -> dict:
    """The state after another look: per file its generation, inode and how far whole lines reach; nothing is read that was read before."""
    out = dict(state)
    for path in paths:
        try:
            st = os.stat(path)
        except OSError:  # between a move and the new file
            continue
        generation, inode, at = state.get(path, (0, st.st_ino, 0))
        if inode != st.st_ino or st.st_size < at:
            generation, at = generation + 1, 0
        if st.st_size > at:
            _, at = read_lines(path, at)
        out[path] = (generation, st.st_ino, at)
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"files": json.dumps(advance(json.loads(start["files"]), sorted(glob.glob(self.path))), sort_keys=True)}
        return iter(list(self.readBetweenOffsets(start, end))), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        for path, (generation, inode, to) in sorted(after.items()):
            old = before.get(path, (generation, inode, 0))
            at = old[2] if old[0] == generation else 0
            if to > at:
                lines, _ = read_lines(path, at, to)
                for line in lines:
                    yield path, generation, line


class TailSource(DataSource):
    """(file, generation, line) of growing files."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, generation int, line string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)
