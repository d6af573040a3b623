"""Window formulas against small state machines, and their boundary rows."""

import random

from pyspark.sql import functions as F

from weir.operators import motion
from weir.operators.islands import contiguous_stretches, gap_sessions, merge_intervals
from weir.operators.sightings import camera_sightings


def machine(flags, least, pre, post):
    """Events of a flag series, frame by frame."""
    out, run, quiet, start, last_end = [], 0, 0, None, -1
    for i, m in enumerate(flags):
        run = run + 1 if m else 0
        if start is None:
            if run >= least:
                start, quiet = (max(i - pre + 1, last_end + 1, 0), i), 0
        elif m:
            quiet = 0
        else:
            quiet += 1
            if quiet >= post:
                out.append((*start, i))
                last_end, start = i, None
    if start is not None:
        out.append((*start, len(flags) - 1))
    return out


def test_events_equal_the_state_machine(spark):
    rng, rows, want = random.Random(3), [], []
    for chain in range(60):
        flags = [rng.random() < 0.35 for _ in range(rng.randint(1, 120))]
        rows += [(chain, i, m) for i, m in enumerate(flags)]
        want += [(chain, *e) for e in machine(flags, 3, 4, 6)]
    df = spark.createDataFrame(rows, "camera long, idx long, motion boolean")
    got = motion.events(df, 3, 4, 6).select("camera", "start", "confirmed_at", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_gap_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0), (1, 10), (1, 21), (2, 0)], "k int, us long")
    got = {(r.k, r.us): r.session for r in gap_sessions(df, ["k"], "us", 10).collect()}
    assert got == {(1, 0): 0, (1, 10): 0, (1, 21): 1, (2, 0): 0}


def test_sessions_spread_by_time_are_the_same(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0, 1, 2, None]), rng.randint(-500, 2000), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, us long, id long")
    for gap in (0, 3, 40, 300):
        plain = {r.id: r.session for r in gap_sessions(df, ["k"], "us", gap, ["id"]).collect()}
        assert plain == {r.id: r.session for r in gap_sessions(df, ["k"], "us", gap, ["id"], bucket=50).collect()}


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, us long")
    assert gap_sessions(df, ["k"], "us", 10).count() == 0
    assert merge_intervals(spark.createDataFrame([], "k int, s long, e long"), ["k"]).count() == 0


def test_merge_equals_a_sweep(spark):
    rng = random.Random(5)
    rows = [(k, s, s + rng.randint(0, 9)) for k in range(20) for s in (rng.randint(0, 80) for _ in range(12))]
    want = []
    for k in range(20):
        cur = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if cur and s <= cur[1] + 2:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                want.append((k, cur))
    got = merge_intervals(spark.createDataFrame(rows, "k int, s long, e long"), ["k"], slack=2).collect()
    assert sorted((r.k, r.s, r.e) for r in got) == sorted((k, *c) for k, c in want)


def test_stretches(spark):
    rows = [("a", 0, 10), ("b", 13, None), ("c", 17, 20), ("u", None, None), ("v", None, None), ("d", 23, 30)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, file string, start long, end long")
    got = {r.file: r.stretch for r in contiguous_stretches(df, ["k"], tolerance=3).collect()}
    assert got["a"] == got["b"] == 0 and got["c"] == 1 and got["d"] == 1 and {got["u"], got["v"]} == {2, 3}


def test_best_hit_is_the_first_of_equals(spark):
    rows = [(1, "t", "a", 5, 0.5, "live", 7), (1, "t", "b", 6, 0.5, "nvr", 8), (1, "t", "b", 7, 0.4, "nvr", 9)]
    df = spark.createDataFrame(rows, "camera int, target string, cls string, us long, conf double, src string, frame long")
    (r,) = camera_sightings(df, 1).collect()
    assert (r.best_frame, r.raw_classes, r.source, r.hits) == (7, "b:2;a:1", "nvr+live", 3)


def test_resume_keeps_finished_segments_beyond_a_gap(spark):
    seg = spark.createDataFrame([(1, "f", i * 10, i * 10 + 10) for i in range(5)], "camera int, file string, start long, end long")
    got = {r.start: r.redo for r in motion.resume(seg, seg.where("start not in (10)")).collect()}
    assert got == {0: True, 10: True, 20: False, 30: False, 40: False}


def test_carry_between_samples(spark):
    df = spark.createDataFrame([(1, i, 1.0 if i % 2 == 0 else 0.0) for i in range(8)], "camera int, idx long, score double")
    got = [r.motion for r in motion.motion_flags(df, 0.5, 4, 4).orderBy("idx").collect()]
    assert got == [False] * 4 + [True] * 4
    assert spark.range(1).select(motion.seconds_to_frames(0.01, 25.0)).first()[0] == 1


def test_pieces_cut_at_gaps(spark):
    df = spark.createDataFrame([(1, p, 10) for p in (0, 1, 2, 5, 6)], "camera int, pos long, frames long")
    got = {r.pos: r.piece for r in motion.pack(df, 20).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 5: 2, 6: 2}
    assert {r.pos: r.piece for r in motion.pieces_between_gaps(df).select("pos", F.col("piece")).collect()} == {0: 0, 1: 0, 2: 0, 5: 1, 6: 1}
