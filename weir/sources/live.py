"""Chunk downloads and live streams behind plug-in readers: retries, reconnects, event times, batches.

Nothing here decodes video: a reader is a function that yields frames. Clocks and sleeps are parameters, so that tests don't wait.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIES, FIRST_WAIT, GROWTH = 3, 5.0, 3  #: waits of 5, 15 and 45 seconds
BACKOFF, LONGEST_BACKOFF = 5.0, 60.0


def with_retries(fetch: Callable, *args, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """(result, attempts): an error or False is tried again after growing waits; None (no footage) is a result."""
    for attempt in range(retries + 1):
        try:
            got = fetch(*args)
        except Exception as e:  # a reader's hiccup counts as a failed download
            print(f"download {args}: {type(e).__name__}: {str(e)[:200]}")
            got = False
        if got is not False or attempt == retries:
            return got, attempt + 1
        sleep(FIRST_WAIT * GROWTH**attempt)
    raise AssertionError


def fetch_chunks(chunks: DataFrame, fetch: Callable[[str, int, int], list | None | bool], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Each chunk (camera, cs, ce) with its state (ok, no_footage, failed), attempts and frames (offset, value).

    A failed chunk is a row, not an error, so it isn't committed and others are. Chunks are spread over tasks; a lost executor's chunks are fetched again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for camera, cs, ce in zip(pdf["camera"], pdf["cs"], pdf["ce"]):
                got, attempts = with_retries(fetch, camera, cs, ce, retries=retries, sleep=sleep)
                state = "failed" if got is False else "ok" if got else "no_footage"
                rows.append((camera, cs, ce, state, attempts, [(float(o), float(v)) for o, v in got or []]))
            yield pd.DataFrame(rows, columns=["camera", "cs", "ce", "state", "attempts", "frames"])

    kind = chunks.schema["camera"].dataType.simpleString()
    return chunks.select("camera", "cs", "ce").mapInPandas(run, f"camera {kind}, cs long, ce long, state string, attempts int, frames array<struct<offset:double,value:double>>")


def settled_first(chunks: DataFrame, now_us: int, wait_us: int = 90_000_000, forward: bool = True) -> DataFrame:
    """Chunks that ended at least ``wait_us`` ago, in the order of service: the camera furthest behind in the scan's direction first."""
    return chunks.where(F.col("ce") + wait_us <= now_us).orderBy(F.col("cs").asc() if forward else F.col("cs").desc(), "camera")


def live_frames(connect: Callable[[], Iterable[tuple[float, object]]], stop: Callable[[], bool], now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[float, object]]:
    """(event time, frame) of a stream that is connected again whenever it ends, after 5 to 60 seconds.

    The first frame's arrival sets a connection's clock; later frames keep the stream's own spacing.
    """
    wait = BACKOFF
    while not stop():
        began = None
        try:
            for offset, frame in connect():
                if stop():
                    return
                if began is None:
                    began, wait = now() - offset, BACKOFF
                yield began + offset, frame
        except Exception as e:
            print(f"live: {type(e).__name__}: {str(e)[:200]}")
        if stop():
            return
        sleep(wait)
        wait = min(wait * 2, LONGEST_BACKOFF)


def in_batches(rows: Iterable[tuple[float, object]], size: int, idle: float = 0.5) -> Iterator[list]:
    """Batches of (arrival, row): one is full at ``size`` rows, and given as it is once ``idle`` seconds pass without another."""
    held: list = []
    last = None
    for at, row in rows:
        if held and at - last >= idle:
            yield held
            held = []
        held.append(row)
        last = at
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held
