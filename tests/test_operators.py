"""Files, streams, crops and array operators on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.functions import geometry, names, values
from weir.operators import consumers, coverage, vision
from weir.sources import files


def test_json_lines_skip_torn_and_blank_lines(spark, tmp_path):
    p = tmp_path / "hits.jsonl"
    p.write_text(json.dumps({"file": "a", "offset": 1.0, "conf": 0.5}) + "\n\n" + '{"file": "b", "off')
    assert [r.file for r in files.read_json_lines(spark, str(p), files.HIT).where("file is not null").collect()] == ["a"]
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(p), files.HIT, strict=True).collect()


def test_found_videos(spark, tmp_path):
    for n in ("clip10.MP4", "clip2.mp4", "notes.txt", "out/x.mp4", "sub/y.dav"):
        f = tmp_path / n
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"123")
    flat = files.find_videos(spark, str(tmp_path))
    assert [r.file for r in flat.collect()] == ["clip2.mp4", "clip10.MP4"]
    deep = files.find_videos(spark, str(tmp_path), recursive=True, exclude=str(tmp_path / "out"))
    assert {r.file for r in deep.collect()} == {"clip2.mp4", "clip10.MP4", "sub/y.dav"}


def test_camera_tables_and_rebuild(spark, tmp_path):
    row = spark.sql("SELECT 'dog' AS target, '2024-01-01 00:00:00' AS start, 'never' AS end")
    files.rebuild_csv(row, str(tmp_path / "nvr_ch1/sightings/sightings.csv"))
    files.rebuild_csv(row.withColumn("end", F.lit("2024-01-01 00:01:00")), str(tmp_path / "nvr_ch2/sightings/sightings.csv"))
    rows = spark.read.option("header", "true").csv(str(tmp_path / "*/sightings/sightings.csv"))
    assert files.valid_times(rows).count() == 1


def test_state_missing_or_broken_is_empty(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "none.json"), "fingerprint string").count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert files.read_or_empty(spark, str(tmp_path / "bad.json"), "fingerprint string").where("fingerprint is not null").count() == 0


def test_export_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("x 12345678901234567  2024-01-02 03:04:05 y\nnothing\n")
    assert [tuple(r) for r in files.read_export_list(spark, str(tmp_path / "l.txt")).collect()] == [("12345678901234567", "2024-01-02 03:04:05", "2024-01-02_030405")]


def test_names(spark):
    df = spark.sql("SELECT * FROM VALUES ('a/b_20240101000000_20240101010000_x.mp4'), ('2024-01-02_030405.avi'), ('odd.mp4') AS t(f)")
    got = {r.f: r.r for r in df.select("f", names.recording_times(F.col("f")).alias("r")).collect()}
    assert got["a/b_20240101000000_20240101010000_x.mp4"].end.hour == 1 and got["2024-01-02_030405.avi"].start.minute == 4 and got["odd.mp4"].start is None
    one = spark.range(1).select(names.split_list(F.lit(" a, ,b ")).alias("l"), names.suffix(F.lit("x/y.MP4")).alias("s"), values.clock(F.lit(3725)).alias("c")).first()
    assert (one.l, one.s, one.c) == (["a", "b"], ".mp4", "1:02:05")


def test_windows_merge_to_a_fixpoint():
    boxes = [(0, 0, 10, 10), (200, 0, 210, 10), (100, 0, 110, 10), (900, 900, 950, 950)]
    got = consumers.merge_windows(boxes, 1920, 1080)
    assert len(got) == 2
    for a in got:
        for b in got:
            assert a == b or not (a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3])
    assert consumers.merge_windows(boxes[::-1], 1920, 1080) == got


def test_window_column_equals_plain_form(spark):
    boxes = [(0.0, 0.0, 10.0, 10.0), (1800.0, 1000.0, 1919.0, 1079.0), (5.0, 5.0, 1900.0, 900.0)]
    df = spark.createDataFrame(boxes, "x1 double, y1 double, x2 double, y2 double")
    w = geometry.crop_window({c: F.col(c) for c in df.columns}, 1920, 1080)
    got = [tuple(r.w) for r in df.select(w.alias("w")).collect()]
    assert got == [consumers.window_of(b, 1920, 1080, 0.5, 150.0) for b in boxes]


def test_uncovered_with_and_without_grid(spark):
    c = spark.createDataFrame([(1, i * 10, i * 10 + 10) for i in range(30)], "camera int, cs long, ce long")
    m = spark.createDataFrame([(1, 5, 95), (1, 120, 121), (1, 200, 300)], "camera int, s long, e long")
    plain = sorted(map(tuple, coverage.uncovered(c, m).collect()))
    assert plain == sorted(map(tuple, coverage.uncovered(c, m, grid=40).collect())) and len(plain) == 12
    back = coverage.plan_chunks(spark.createDataFrame([(1, 5, 25)], "camera int, s long, e long"), 10, reverse=True)
    assert sorted((r.pos, r.cs, r.ce) for r in back.collect()) == [(0, 20, 25), (1, 10, 20), (2, 5, 10)]


def test_unknown_class_policies(spark):
    asked = spark.sql("SELECT 'cat' AS cls UNION ALL SELECT 'unicorn'")
    vocabulary = spark.sql("SELECT 'cat' AS cls, 15L AS class_id")
    assert consumers.classes_known(asked, vocabulary, strict=False).count() == 1
    with pytest.raises(Exception, match="unicorn"):
        consumers.classes_known(asked, vocabulary, strict=True).collect()


def test_blur_and_mask(spark):
    x = np.random.default_rng(0).random(40)
    got = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(vision.blur(F.col("v"), 1.5)).first()[0]
    assert np.allclose(got, np.convolve(x, vision.gaussian_kernel(1.5), mode="same"))
    mask = vision.region_mask(20, 20, [[(5, 5), (15, 5), (15, 15), (5, 15)]])
    assert mask.sum() == 255 * 100
    image = np.full((20, 20, 3), 200, np.uint8)
    assert (vision.censor(image, mask, "black")[6, 6] == 0).all() and (vision.censor(image, mask, "black")[0, 0] == 200).all()
    assert vision.censor(image, mask, "crop", (5, 5, 15, 15)).shape == (10, 10, 3)
    assert vision.letterbox(image, 32).shape == (32, 32, 3)


def test_background_model():
    m = vision.BackgroundModel()
    still = np.full(10, 100.0)
    assert m.score(still) == 0.0 and m.score(still) == 0.0
    moved = still.copy()
    moved[:3] = 255
    assert m.score(moved) == pytest.approx(0.3)


def test_detector_plug_in(spark):
    def detector(frames):
        return frames.map(lambda f: [{"cls": "dot", "conf": 0.9, "box": [0.0, 0.0, 1.0, 1.0]}] * int(f > 1))

    detector.__annotations__ = {}
    import pandas as pd

    def typed(frames: pd.Series) -> pd.Series:
        return detector(frames)

    df = spark.createDataFrame([(1, 1), (2, 2)], "id int, pixels int")
    assert [r.id for r in vision.detect(df, typed).collect()] == [2]


def test_exact_stream_keeps_late_hits(spark, tmp_path):
    from weir.operators.sightings import camera_sightings
    from weir.streaming.sightings import exact_sightings

    schema = "camera int, target string, cls string, us long, conf double, src string, frame long"
    src, late = str(tmp_path / "in"), [(1, "t", "a", 5, 0.9, "live", 2)]
    spark.createDataFrame([(1, "t", "a", 0, 0.5, "nvr", 1), (1, "t", "a", 10, 0.5, "nvr", 3), (2, "t", "a", 0, 0.5, "nvr", 4)], schema).write.parquet(src)

    def run():
        q = exact_sightings(spark.readStream.schema(schema).parquet(src), str(tmp_path / "store"), str(tmp_path / "out"), 6, str(tmp_path / "ck"))
        q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).select("camera", "start_us", "end_us", "hits", "best_frame").collect()
        return sorted(map(tuple, got))

    assert run() == [(1, 0, 0, 1, 1), (1, 10, 10, 1, 3), (2, 0, 0, 1, 4)]
    spark.createDataFrame(late, schema).write.mode("append").parquet(src)
    want = camera_sightings(spark.read.parquet(src), 6).select("camera", "start_us", "end_us", "hits", "best_frame").collect()
    assert run() == sorted(map(tuple, want)) == [(1, 0, 10, 3, 2), (2, 0, 0, 1, 4)]


def test_replay_stream(spark, tmp_path):
    from weir.sources.replay import ReplaySource

    spark.dataSource.register(ReplaySource)
    df = spark.readStream.format("replay").option("chunks", "2").option("frames", "10").load()
    q = df.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("replayed").count() == 20


def test_growing_files_are_tailed(spark, tmp_path):
    from weir.sources.tail import TailSource, advance, read_lines

    f = tmp_path / "hits.jsonl"
    f.write_bytes(b"a\nb\ntor")
    one = advance({}, [str(f), str(tmp_path / "none")])
    assert read_lines(str(f), 0) == (["a", "b"], 4) and one[str(f)][0::2] == (0, 4)
    with open(f, "ab") as more:
        more.write(b"n\nc\n")
    two = advance(one, [str(f)])
    assert two[str(f)][0::2] == (0, 11) and read_lines(str(f), 4, 11)[0] == ["torn", "c"]
    f.write_bytes(b"x\n")  # shrunk: starts over
    assert advance(two, [str(f)])[str(f)][0::2] == (1, 2)
    (tmp_path / "new").write_bytes(b"y\nz\nlonger than before\n")
    (tmp_path / "new").rename(f)  # replaced
    assert advance(two, [str(f)])[str(f)][0] == 1
    spark.dataSource.register(TailSource)
    q = spark.readStream.format("tail").option("path", str(tmp_path / "*.jsonl")).load().writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        with open(f, "ab") as more:
            more.write(b"last\npart")
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.line for r in spark.table("tailed").collect()] == ["y", "z", "longer than before", "last"]


def test_retries_and_chunk_states(spark):
    from weir.sources import live

    waits, calls = [], []

    def flaky(*args):
        calls.append(args)
        if len(calls) < 3:
            raise OSError("busy")
        return [(0.0, 1.0)]

    assert live.with_retries(flaky, "cam", 0, 1, sleep=waits.append) == ([(0.0, 1.0)], 3) and waits == [5.0, 15.0]
    waits.clear()
    assert live.with_retries(lambda: False, sleep=waits.append) == (False, 4) and waits == [5.0, 15.0, 45.0]
    assert live.with_retries(lambda: None, sleep=waits.append) == (None, 1)

    def fetch(camera, cs, ce):
        return False if cs == 1 else None if cs == 2 else [(0.0, float(cs))]

    chunks = spark.createDataFrame([("a", i, i + 1) for i in range(4)], "camera string, cs long, ce long")
    got = {r.cs: (r.state, r.attempts, len(r.frames)) for r in live.fetch_chunks(chunks, fetch, sleep=lambda s: None).collect()}
    assert got == {0: ("ok", 1, 1), 1: ("failed", 4, 0), 2: ("no_footage", 1, 0), 3: ("ok", 1, 1)}
    assert [r.cs for r in live.settled_first(chunks, 3, 0, forward=False).collect()] == [2, 1, 0]


def test_live_streams_reconnect_and_batch():
    from weir.sources import live

    streams = iter([[(10.0, "a"), (10.4, "b")], OSError("gone"), [(0.0, "c")]])
    clock, waits = iter([100.0, 200.0]), []

    def connect():
        got = next(streams)
        if isinstance(got, Exception):
            raise got
        return got

    frames = list(live.live_frames(connect, lambda: len(waits) >= 3, now=lambda: next(clock), sleep=waits.append))
    assert frames == [(100.0, "a"), (pytest.approx(100.4), "b"), (200.0, "c")] and waits == [5.0, 10.0, 5.0]
    rows = [(0.0, 1), (0.1, 2), (0.2, 3), (0.3, 4), (1.0, 5), (1.1, 6)]
    assert list(live.in_batches(rows, 3)) == [[1, 2, 3], [4], [5, 6]]


def raw(fps, w, h, n, every, there=None):
    return b"RAWV %s %d %d %d %d\n" % (str(fps).encode(), w, h, n, every) + bytes(range(w * h * (n if there is None else there)))


def test_frames_of_a_chain(spark):
    from weir.sources import frames

    rows = [("c", "clip10.raw", raw(0, 2, 1, 3, 2)), ("c", "clip9.raw", raw(12.5, 2, 1, 4, 2, 3)), ("d", "x.raw", raw(25, 2, 1, 70, 10))]
    files = spark.createDataFrame(rows, "camera string, file string, content binary")
    p = frames.probe(files)
    assert {r.file: (r.fps, r.frames, r.duration) for r in p.collect()} == {"clip10.raw": (25.0, 3, 0.12), "clip9.raw": (12.5, 4, 0.32), "x.raw": (25.0, 70, 2.8)}
    c = frames.chain(p).select("file", "first_frame")
    assert {r.file: r.first_frame for r in c.collect()} == {"clip9.raw": 0, "clip10.raw": 4, "x.raw": 0}
    got = frames.read_frames(files.join(c, "file")).where("camera = 'c'").orderBy("idx").collect()
    assert [(r.idx, r.file, r.frame, r.pixels) for r in got] == [(0, "clip9.raw", 0, [0, 1]), (1, "clip9.raw", 1, [2, 3]), (2, "clip9.raw", 2, [4, 5]), (4, "clip10.raw", 0, [0, 1]), (5, "clip10.raw", 1, [2, 3]), (6, "clip10.raw", 2, [4, 5])]
    cut = files.where("camera = 'd'").selectExpr("*", "0L AS first_frame", "60L AS start", "62L AS end")
    assert [(r.idx, r.frame, r.pixels) for r in frames.read_frames(cut).collect()] == [(0, 60, [120, 121]), (1, 61, [122, 123])]
    k = frames.keyframes(files)
    assert sorted(r.offset for r in k.where("file = 'clip9.raw'").collect()) == [0.0, 0.16]
    asked = spark.createDataFrame([(1, "x.raw", 0.95), (2, "x.raw", 99.0)], "id int, file string, offset double")
    assert {r.id: r.offset for r in frames.grab_keyframe(k, asked).collect()} == {1: 0.8, 2: None}
    bad = spark.createDataFrame([("c", "a.raw", raw(25, 2, 1, 1, 1)), ("c", "b.raw", raw(25, 1, 2, 1, 1)), ("d", "torn.raw", b"RAW")], "camera string, file string, content binary")
    assert frames.probe(bad).where("file = 'torn.raw'").first().frames is None
    for camera, why in (("c", "resolution"), ("d", "opened")):
        with pytest.raises(Exception, match=why):
            frames.chain(frames.probe(bad.where(f"camera = '{camera}'"))).collect()


def test_frames_of_many_files_go_on_together():
    import pyarrow as pa

    from weir.sources import frames

    n = 6000
    batch = pa.RecordBatch.from_pydict(
        {"camera": ["c"] * n, "file": [f"{i}.raw" for i in range(n)], "content": [raw(25, 2, 1, 3, 1, i % 4) for i in range(n)], "first_frame": [3 * i for i in range(n)], "start": pa.array([0] * n), "end": pa.array([None] * n, pa.int64())}
    )
    got = list(frames.frame_batches()(iter([batch])))
    rows = [r for b in got for r in b.to_pylist()]
    assert len(got) <= 2 and [(r["idx"], r["file"], r["frame"], r["pixels"]) for r in rows] == [(3 * i + k, f"{i}.raw", k, [2 * k, 2 * k + 1]) for i in range(n) for k in range(min(3, i % 4))]


def test_a_failing_rebuild_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    assert files.rebuild_csv(spark.sql("SELECT 1 AS a, 'x' AS b"), path)
    assert (tmp_path / "t.csv").read_bytes() == b"\xef\xbb\xbfa,b\n1,x\n"
    with pytest.raises(Exception):
        files.rebuild_csv(spark.sql("SELECT raise_error('no') AS a"), path)
    assert (tmp_path / "t.csv").read_bytes() == b"\xef\xbb\xbfa,b\n1,x\n"
    files.rebuild_csv(spark.sql("SELECT 2 AS a, CAST(NULL AS STRING) AS b"), path)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.csv"]
    assert [tuple(r) for r in files.read_csv(spark, path, "a int, b string").collect()] == [(2, None)]


def test_small_sinks_and_state(spark, tmp_path):
    rows = spark.sql("SELECT 'r' AS run_id, 'start' AS type")
    assert files.append_log(rows, str(tmp_path / "log")) and files.append_log(rows, str(tmp_path / "log"))
    assert files.read_json_lines(spark, str(tmp_path / "log"), files.RUN).count() == 2
    (tmp_path / "file").write_text("x")
    assert not files.append_log(rows, str(tmp_path / "file" / "log"))
    files.supersede(spark, str(tmp_path / "hits"), rows, "one")
    files.supersede(spark, str(tmp_path / "hits"), rows, "two")
    assert {r.fp for r in spark.read.parquet(str(tmp_path / "hits")).collect()} == {"one", "two"}
    region = spark.sql("SELECT 'a' AS source, 4 AS frame_width, 3 AS frame_height, array(array(array(1, 2))) AS points")
    files.save_region(region, str(tmp_path / "region"))
    assert [tuple(r) for r in files.read_region(spark, str(tmp_path / "region")).collect()] == [("a", 4, 3, [[[1, 2]]])]
    files.write_cameras(spark.sql("SELECT 'c1' AS camera, 1 AS x UNION ALL SELECT 'c2', 2"), str(tmp_path / "cams"))
    assert spark.read.parquet(str(tmp_path / "cams")).where("camera = 'c2'").first().x == 2


def test_settings_precedence(spark, tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\n\nKEY = \"file\"\nEMPTY=\nno sign\n")
    monkeypatch.setenv("KEY", "env")
    monkeypatch.setenv("EMPTY", "env")
    env = str(tmp_path / ".env")
    got = [values.setting(spark, "KEY", env), values.setting(spark, "KEY"), values.setting(spark, "EMPTY", env, "d"), values.setting(spark, "NONE", env, "d")]
    assert got == ["file", "env", "env", "d"]


def test_camera_tables_by_folder(spark, tmp_path):
    row = spark.sql("SELECT 'x' AS camera, 'dog' AS target, '2024-01-01 00:00:00' AS start")
    for c in ("ch 1", "ch+2"):
        (tmp_path / c / "sightings").mkdir(parents=True)
        files.rebuild_csv(row, str(tmp_path / c / "sightings/sightings.csv"))
    got = files.read_camera_tables(spark, str(tmp_path), "camera string, target string, start string")
    assert sorted((r.camera.replace("%20", " "), r.target) for r in got.collect()) == [("ch 1", "dog"), ("ch+2", "dog")]


def test_found_videos_of_odd_folders(spark, tmp_path):
    folder = tmp_path / "a+(b)"
    for n in ("out/x.mp4", "sub/out/y.mp4", "z.mp4"):
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(b"1")
    deep = files.find_videos(spark, str(folder), recursive=True, exclude=str(folder / "out"))
    assert [r.file for r in deep.collect()] == ["sub/out/y.mp4", "z.mp4"]


def test_null_targets_and_repeated_rows_stay(spark):
    from weir.operators.sightings import camera_sightings, dedup_sources

    hits = spark.createDataFrame([(1, None, "a", 0, 0.5, "nvr", 1), (1, "t", "a", 0, 0.5, "nvr", 2), (None, "t", "a", 0, 0.5, "nvr", 3)], "camera int, target string, cls string, us long, conf double, src string, frame long")
    assert camera_sightings(hits, 10).count() == 3
    rows = spark.createDataFrame([(1, "t", 0, 5), (1, "t", 0, 5), (1, "t", 90, 95)], "camera int, target string, start_us long, end_us long")
    tiles = rows.limit(1).selectExpr("1L AS tile", "*").unionByName(rows.limit(1).selectExpr("2L AS tile", "*"))
    assert sorted((r.start_us, r.tile) for r in consumers.match_tiles(rows, tiles, 1, []).collect() if r.tile) == [(0, 1), (0, 1)]
    box = [(1, "t", "a", 0, 0.5, "nvr", i, x, 0.0, 40.0, 40.0) for i, x in enumerate((-5.0, 5.0, -0.5))]
    seen = spark.createDataFrame(box, "camera int, target string, cls string, us long, conf double, src string, frame long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.frame for r in dedup_sources(seen).collect()) == [0, 1]


def test_unpadded_names_and_parts(spark):
    from weir.operators import motion

    f = spark.createDataFrame([(1, "clip10.mp4", 1000), (1, "clip9.mp4", 1000)], "camera int, file string, frames long")
    c = motion.chain_offsets(f, "camera", "file")
    e = spark.createDataFrame([(1, 950, 955, 1050)], "camera int, start long, confirmed_at long, end long")
    one = motion.manifest(e, c).first()
    assert one.clip_name == "clip9_0001.mp4" and [(x.file, x.lo, x.hi) for x in one.segments] == [("clip9.mp4", 950, 1000), ("clip10.mp4", 0, 51)]
    p = motion.segments(c, 90, ("camera", "file", "first_frame"))
    p = p.select("camera", "file", (F.col("first_frame") + F.col("start")).alias("first_frame"), (F.col("end") - F.col("start")).alias("frames"), F.col("start").alias("from"), "part", "parts")
    assert motion.manifest(e, p).first().clip_name == "clip9_p11_0001.mp4"
    assert motion.manifest(e.selectExpr("camera", "10L AS start", "11L AS confirmed_at", "20L AS end"), p).first().clip_name == "clip9_p01_0001.mp4"


def test_spread_walks_on_at_gaps(spark):
    from weir.operators import motion

    rng = np.random.default_rng(2)
    rows, want = [], {}
    for camera in range(20):
        pos, units = 0, []
        for _ in range(int(rng.integers(1, 30))):
            pos += 1 if rng.random() < 0.8 else 3
            units.append((pos, int(rng.integers(0, 50)) + 1))
        total, w, done, prior = sum(n for _, n in units), 0, 0, None
        for pos, n in units:
            gap = prior is not None and pos != prior + 1
            w = w + 1 if gap and w < 3 else max(w, min(done * 4 // total, 3))
            want[camera, pos] = w
            done, prior = done + n, pos
            rows.append((camera, pos, n))
    u = spark.createDataFrame(rows, "camera int, pos long, frames long")
    assert {(r.camera, r.pos): r.worker for r in motion.spread(motion.hard_gaps(u), 4).collect()} == want


def test_rates(spark):
    log = spark.createDataFrame([("a", 1, 100, 4.0, 0.0), ("a", 2, 100, 4.0, 1.0), ("a", 3, 100, 0.0, 2.0)], "nvr string, n int, bytes long, secs double, began double")
    got = [(r.mbps, r.last_ten, r.overall) for r in consumers.speeds(log).orderBy("n").collect()]
    assert got == [(0.0002, 0.0002, pytest.approx(0.0002)), (0.0002, 0.0002, pytest.approx(0.00032)), (None, 0.0002, pytest.approx(0.00048))]
    c = spark.createDataFrame([("k", t, v) for t, v in ((0, 0), (10, 5), (25, 9), (40, 30), (41, 31))], "key string, t long, total long")
    assert {r.t: (r.recent, r.spanned) for r in consumers.recent_rate(c, "key", "t", "total", 30).collect()} == {0: (None, 0), 10: (0.5, 10), 25: (pytest.approx(9 / 25), 25), 40: (pytest.approx(25 / 30), 30), 41: (pytest.approx(26 / 31), 31)}


def test_opening_and_mixture():
    m = np.zeros((8, 8), bool)
    m[1:5, 1:5] = True
    m[6, 6] = True
    want = m.copy()
    want[6, 6] = False
    assert (vision.opened(m) == want).all() and vision.opened(np.ones((4, 4), bool)).all()
    rng = np.random.default_rng(0)
    model = vision.MixtureModel(mask=np.arange(400).reshape(20, 20) % 20 < 10)
    still = [model.score(100 + rng.normal(0, 1, (20, 20))) for _ in range(60)]
    assert max(still[5:]) == 0
    moved = np.full((20, 20), 100.0)
    moved[5:15, 5:15] = 200
    assert model.score(moved) == pytest.approx(50 / 200) and vision.MixtureModel(downscale=2).score(moved) == 1.0
    back = vision.BackgroundModel(mask=np.arange(10) < 5)
    back.score(np.full(10, 100.0))
    assert back.score(np.r_[np.full(2, 255.0), np.full(8, 100.0)]) == pytest.approx(0.4)


def test_snapshots_as_a_stream(spark, tmp_path):
    from weir.streaming.sightings import snapshot_changes

    schema, src = "camera int, target string, start_us long, end_us long", str(tmp_path / "in")

    def look(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = snapshot_changes(spark.readStream.schema(schema).parquet(src), str(tmp_path / "seen"), str(tmp_path / "out"), 5, str(tmp_path / "ck"))
        q.awaitTermination()
        return {(r.batch, r.camera, r.start_us, r.end_us): r.change for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert look([(1, "t", 0, 10), (None, "t", 0, 1)]) == {(0, 1, 0, 10): "new", (0, None, 0, 1): "new"}
    got = look([(1, "t", 0, 20), (1, "t", 0, 10), (2, "t", 0, 10), (None, "t", 0, 1)])
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1, 0, 20): "grown", (1, 1, 0, 10): "unchanged", (1, 2, 0, 10): "new", (1, None, 0, 1): "unchanged"}
