"""Queries over the derived views, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.functions import geometry as geo
from weir.functions import names, values
from weir.operators import consumers, coverage, motion, sightings, vision
from weir.operators.islands import contiguous_stretches, merge_intervals
from weir.plans import oracle as o
from weir.plans import views
from weir.session import scratch, ship, table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
GAP = 3_600_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def time(us: str, name: str):
    return F.timestamp_micros(F.col(us)).cast("timestamp_ntz").alias(name)


def sighted(s, sf) -> DataFrame:
    return sightings.camera_sightings(views.hits(s, sf), GAP)


# sightings ------------------------------------------------------------------------------------------------


@query(f"""WITH {o.SESSIONS} SELECT camera, target, make_timestamp(start_us) AS start, make_timestamp(end_us) AS "end", (end_us - start_us) / 1e6 AS duration_s,
  hits, max_conf, best_frame, raw_classes, source FROM sightings_v""")
def sightings_camera(s, sf):
    return sighted(s, sf).select("camera", "target", time("start_us", "start"), time("end_us", "end"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), "hits", "max_conf", "best_frame", "raw_classes", "source")


@query(f"WITH {o.SESSIONS} SELECT camera, target, start_us, end_us, hits, best_frame, raw_classes FROM sightings_v")
def sightings_by_day(s, sf):
    """The same sightings, each camera's rows spread over tasks by day."""
    d = sightings.camera_sightings(views.hits(s, sf), GAP, bucket=86_400_000_000)
    return d.select("camera", "target", "start_us", "end_us", "hits", "best_frame", "raw_classes")


@query(f"WITH {o.SESSIONS} SELECT camera, target, count(*) AS sightings, sum(hits)::BIGINT AS hits, max(end_us) AS last_us FROM sightings_v GROUP BY camera, target")
def sightings_summary(s, sf):
    return sighted(s, sf).groupBy("camera", "target").agg(F.count(F.lit(1)).alias("sightings"), F.sum("hits").alias("hits"), F.max("end_us").alias("last_us"))


@query(f"WITH {o.SESSIONS} SELECT camera, target, start_us, end_us FROM sightings_v WHERE end_us >= 1704844800000000 AND start_us <= 1705017600000000")
def sightings_in_range(s, sf):
    return sightings.in_range(sighted(s, sf), 1_704_844_800_000_000, 1_705_017_600_000_000).select("camera", "target", "start_us", "end_us")


@query(f"""WITH {o.RECORDINGS} SELECT file, CASE WHEN start IS NULL THEN NULL ELSE make_timestamp(start) END AS start, CASE WHEN "end" IS NULL THEN NULL ELSE make_timestamp("end") END AS "end" FROM name_v""")
def recording_names(s, sf):
    return views.recordings(s, sf).select("file", names.recording_times(F.col("file")).alias("r")).select("file", "r.start", "r.end")


def timeline(s, sf) -> DataFrame:
    r = views.recordings(s, sf).select("file", "camera", names.recording_times(F.col("file")).alias("r"))
    r = r.select("file", "camera", F.unix_micros(F.col("r.start").cast("timestamp")).alias("start"), F.unix_micros(F.col("r.end").cast("timestamp")).alias("end"))
    return contiguous_stretches(r, ["camera"])


@query(f"""WITH {o.RECORDINGS} SELECT camera, stretch::BIGINT AS stretch, count(*) AS files, min(start) AS start_us, max(coalesce("end", start)) AS end_us FROM stretch_v GROUP BY camera, stretch""")
def recording_stretches(s, sf):
    return timeline(s, sf).groupBy("camera", "stretch").agg(F.count(F.lit(1)).alias("files"), F.min("start").alias("start_us"), F.max(F.coalesce("end", "start")).alias("end_us"))


@query(f"""WITH {o.RECORDINGS}, fh_v AS (SELECT s.file, s.camera, h.target, h.conf, h.frame, s.start, s.stretch, (h.us - s.bucket * 3600000000) / 1e6 AS "offset",
    coalesce(s.start, 0) + (h.us - s.bucket * 3600000000) AS us FROM hits_v h JOIN stretch_v s ON h.camera = s.camera AND h.us // 3600000000 = s.bucket),
  fl_v AS (SELECT *, CASE WHEN us - lag(us) OVER w > 3600000000 OR stretch <> lag(stretch) OVER w THEN 1 ELSE 0 END AS cut FROM fh_v WINDOW w AS (PARTITION BY camera, target ORDER BY stretch, us, frame)),
  fs_v AS (SELECT *, sum(cut) OVER (PARTITION BY camera, target ORDER BY stretch, us, frame) AS session FROM fl_v)
  SELECT camera, target, CASE WHEN first(start ORDER BY us, frame) IS NOT NULL THEN min(us) END AS start_us, CASE WHEN first(start ORDER BY us, frame) IS NOT NULL THEN max(us) END AS end_us,
    max(us) - min(us) AS duration_us, first(file ORDER BY us, frame) AS file, first("offset" ORDER BY us, frame) AS offset_s, count(DISTINCT (file, "offset")) AS hits, max(conf) AS max_conf,
    first(frame ORDER BY conf DESC, us, frame) AS best_frame FROM fs_v GROUP BY camera, target, session""")
def sightings_file(s, sf):
    return sightings.file_sightings(views.file_hits(s, sf), timeline(s, sf), GAP).orderBy(F.col("start_us").asc_nulls_first(), "file", "offset_s")


@query("""WITH n AS (SELECT 'Clip' || p_partkey % 97 || '_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.MP4' ELSE '.mp4' END AS name FROM part GROUP BY 1)
  SELECT name, row_number() OVER (ORDER BY regexp_extract(lower(name), 'clip([0-9]+)_', 1)::INT, regexp_extract(lower(name), '_([0-9]+)[.]', 1)::INT, name) AS rank FROM n""")
def natural_order(s, sf):
    n = table(s, sf, "part").select(F.concat(F.lit("Clip"), (F.col("p_partkey") % 97).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".MP4").otherwise(".mp4")).alias("name")).distinct()
    return n.select("name", F.row_number().over(W.orderBy(names.natural_key(F.col("name")), "name")).alias("rank"))


@query(f"""WITH {o.DOUBLED}, key_v AS (SELECT *, us // 1000000 + CASE WHEN us % 1000000 > 500000 OR us % 1000000 = 500000 AND (us // 1000000) % 2 = 1 THEN 1 ELSE 0 END AS sec FROM dup_v),
  rank_v AS (SELECT *, row_number() OVER (PARTITION BY camera, target, cls, sec, floor(trunc(x1 - 900.5) / 8), floor(trunc(y1 - 900.5) / 8), floor(trunc(x2 - 900.5) / 8), floor(trunc(y2 - 900.5) / 8) ORDER BY CASE WHEN src = 'nvr' THEN 0 ELSE 1 END, us, frame) AS rn FROM key_v)
  SELECT camera, target, cls, us, src, frame FROM rank_v WHERE rn = 1""")
def dedup_hits(s, sf):
    return sightings.dedup_sources(views.doubled_hits(s, sf).withColumns({c: F.col(c) - 900.5 for c in ("x1", "y1", "x2", "y2")})).select("camera", "target", "cls", "us", "src", "frame")


@query(f"""WITH {o.HITS}, c AS (SELECT camera, us // 86400000000 AS day, cls, count(*) AS n, min({{'us': us, 'frame': frame}}) AS f FROM hits_v GROUP BY ALL)
  SELECT camera, day, string_agg(cls || ':' || n, ';' ORDER BY n DESC, f, cls) AS raw_classes FROM c GROUP BY camera, day""")
def class_histogram(s, sf):
    return sightings.class_counts(views.hits(s, sf).withColumn("day", F.expr("us div 86400000000")), ["camera", "day"], ["us", "frame"])


@query(f"WITH {o.HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY camera, target ORDER BY conf DESC, us, frame) AS rn FROM hits_v) SELECT camera, target, us, frame, conf FROM r WHERE rn = 1")
def best_hit(s, sf):
    return sightings.best_of(views.hits(s, sf), ["camera", "target"], ["us", "frame"]).select("camera", "target", "us", "frame", "conf")


@query(f"""WITH {o.HITS}, m(cls, target2) AS (VALUES ('click', 'engage'), ('click', 'any'), ('view', 'engage'), ('purchase', 'money'), ('purchase', 'any'))
  SELECT frame, cls, m.target2 AS target FROM hits_v JOIN m USING (cls) WHERE conf >= 0.1""")
def target_fanout(s, sf):
    m = s.sql("SELECT * FROM VALUES ('click', array('engage', 'any')), ('view', array('engage')), ('purchase', array('money', 'any')) AS m(cls, targets)")
    return sightings.fan_out(views.hits(s, sf).where("conf >= 0.1").drop("target"), F.broadcast(m)).select("frame", "cls", "target")


@query(f"""WITH {o.SESSIONS}, new AS (SELECT target || '_' || camera || '_' || session AS name, best_frame AS frame FROM sightings_v WHERE session % 5 <> 4),
  old AS (SELECT target || '_' || camera || '_' || session AS name, best_frame + CASE WHEN session % 3 = 0 THEN 1 ELSE 0 END AS frame FROM sightings_v WHERE session % 7 <> 6)
  SELECT name, CASE WHEN new.frame IS NULL THEN 'remove' WHEN old.frame = new.frame THEN 'keep' ELSE 'render' END AS action FROM old FULL JOIN new USING (name)""")
def image_index_diff(s, sf):
    g = sighted(s, sf).withColumn("name", F.concat_ws("_", "target", F.col("camera").cast("string"), F.col("session").cast("string")))
    old = g.where("session % 7 <> 6").select("name", (F.col("best_frame") + F.when(F.col("session") % 3 == 0, 1).otherwise(0)).alias("frame"))
    return sightings.index_changes(old, g.where("session % 5 <> 4").select("name", F.col("best_frame").alias("frame")))


@query(f"""WITH {o.HITS} SELECT camera, count(*) AS hits, count(DISTINCT frame) AS frames, count(DISTINCT us // {GAP}) AS recordings, max(us) AS last_us FROM hits_v GROUP BY camera""")
def camera_counters(s, sf):
    h = views.hits(s, sf)
    return h.groupBy("camera").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("frame").alias("frames"), F.count_distinct(F.expr(f"us div {GAP}")).alias("recordings"), F.max("us").alias("last_us"))


@query(f"""WITH {o.FILES} SELECT camera, count(*) FILTER ((part * 7 + camera) % 3 = 0) AS segments_pending, (sum("end" - start) FILTER ((part * 7 + camera) % 3 = 0))::BIGINT AS frames_pending, count(*) AS segments_total FROM seg_v GROUP BY camera""")
def pending_totals(s, sf):
    left = (F.col("part") * 7 + F.col("camera")) % 3 == 0
    return parts(s, sf).groupBy("camera").agg(F.count_if(left).alias("segments_pending"), F.sum(F.when(left, F.col("end") - F.col("start"))).alias("frames_pending"), F.count(F.lit(1)).alias("segments_total"))


# coverage -------------------------------------------------------------------------------------------------


def ranges(s, sf) -> DataFrame:
    return views.coverage(s, sf).groupBy("camera").agg(F.min("s").alias("s"), F.max("e").alias("e"))


@query(f"WITH {o.COVERAGE} SELECT camera, cs, ce, pos FROM chunk_v")
def plan_chunks(s, sf):
    return coverage.plan_chunks(ranges(s, sf), 300_000_000)


@query(f"WITH {o.COVERAGE} SELECT camera, s, e, spans FROM merged_v")
def merge_coverage(s, sf):
    return merge_intervals(views.coverage(s, sf), ["camera"])


@query(f"WITH {o.COVERAGE} SELECT camera, cs, ce FROM chunk_v c WHERE NOT EXISTS (SELECT 1 FROM merged_v m WHERE m.camera = c.camera AND m.s <= c.cs AND c.ce <= m.e)")
def uncovered_chunks(s, sf):
    return coverage.uncovered(plan_chunks(s, sf), merge_coverage(s, sf), grid=3_600_000_000).select("camera", "cs", "ce")


@query(f"""WITH {o.COVERAGE}, st AS (SELECT *, ['ok', 'ok', 'no_footage', 'failed', 'skipped', 'ok', 'active'][pos % 7 + 1] AS state FROM chunk_v)
  SELECT camera, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'no_footage') AS no_footage, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped,
   string_agg(cs::VARCHAR, ',' ORDER BY cs) FILTER (state = 'failed') AS failed_chunks, min(cs) FILTER (state = 'active') AS earliest_active, count(*) FILTER (state IN ('ok', 'no_footage')) AS "commit" FROM st GROUP BY camera""")
def chunk_status(s, sf):
    state = F.element_at(F.array(*[F.lit(x) for x in ("ok", "ok", "no_footage", "failed", "skipped", "ok", "active")]), (F.col("pos") % 7 + 1).cast("int"))
    return coverage.chunk_results(plan_chunks(s, sf).withColumn("state", state))


# motion ---------------------------------------------------------------------------------------------------


def flags(s, sf, skip=1) -> DataFrame:
    return motion.motion_flags(views.frames(s, sf), 0.07, 10, skip)


def found_events(s, sf) -> DataFrame:
    return motion.events(flags(s, sf), 3, 4, 6)


def chain_files(s, sf) -> DataFrame:
    f = views.frames(s, sf).withColumn("file", F.concat(F.lit("cam"), F.col("camera").cast("string"), F.lit("_"), F.expr("idx div 150").cast("string"), F.lit(".mp4")))
    return motion.chain_offsets(f.groupBy("camera", "file").agg(F.count(F.lit(1)).alias("frames")), "camera", "file")


def parts(s, sf) -> DataFrame:
    return motion.segments(chain_files(s, sf), 50, ("camera", "file", "first_frame"))


def units(s, sf) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("camera").orderBy("first_frame", "part")) - 1
    u = parts(s, sf).select("camera", pos.cast("long").alias("pos"), (F.col("end") - F.col("start")).alias("frames"))
    return u.where("pos % 13 <> 7")


@query(f"""WITH {o.FRAMES}, f3 AS (SELECT camera, idx, first_value(score >= 0.07 AND idx >= 10) OVER (PARTITION BY camera, idx - idx % 3 ORDER BY idx) AS motion FROM frames_v),
  g AS (SELECT camera, idx, idx - row_number() OVER (PARTITION BY camera ORDER BY idx) AS island FROM f3 WHERE motion)
  SELECT camera, min(idx) AS first, max(idx) AS last, count(*) AS frames, count(*) >= 3 AS confirmed FROM g GROUP BY camera, island""")
def motion_runs(s, sf):
    return motion.runs(flags(s, sf, 3), 3)


@query(f"""WITH {o.FRAMES} SELECT camera, start, confirmed_at, "end" FROM mev_v""")
def motion_events(s, sf):
    return found_events(s, sf)


@query(f"""WITH {o.FILES}, p AS (SELECT *, first_frame + start AS lo0, first_frame + "end" AS hi0, regexp_replace(file, '[.]mp4$', '') || CASE WHEN parts > 1 THEN '_p' || lpad((part + 1)::VARCHAR, len(parts::VARCHAR)::INT, '0') ELSE '' END AS name FROM seg_v),
  sl AS (SELECT e.camera, e.start, e."end", p.file, p.name, p.lo0, greatest(e.start, p.lo0) - p.first_frame AS lo, least(e."end" + 1, p.hi0) - p.first_frame AS hi
    FROM mev_v e JOIN p ON e.camera = p.camera AND e.start < p.hi0 AND e."end" + 1 > p.lo0),
  m AS (SELECT camera, start, "end", count(*) AS n_segments, first(name ORDER BY lo0) AS owner, string_agg(file || '@' || lo || '-' || hi, ';' ORDER BY lo0) AS segments FROM sl GROUP BY camera, start, "end")
  SELECT camera, owner || '_' || lpad((row_number() OVER (PARTITION BY camera, owner ORDER BY start))::VARCHAR, 4, '0') || '.mp4' AS clip_name, start, "end", n_segments::INT AS n_segments, segments FROM m""")
def event_manifest(s, sf):
    p = parts(s, sf).select("camera", "file", (F.col("first_frame") + F.col("start")).alias("first_frame"), (F.col("end") - F.col("start")).alias("frames"), F.col("start").alias("from"), "part", "parts")
    m = motion.manifest(found_events(s, sf), p)
    text = F.array_join(F.transform("segments", lambda x: F.concat(x["file"], F.lit("@"), x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ";")
    return m.withColumn("segments", text)


@query(f"""WITH {o.FILES} SELECT camera, file, frames, start, "end", part, parts FROM seg_v""")
def segments(s, sf):
    return parts(s, sf).drop("first_frame")


@query(f"""WITH RECURSIVE {o.FILES}, ord AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY pos) AS rn FROM units_v),
  walk(camera, rn, pos, frames, held, piece) AS (SELECT camera, rn, pos, frames, frames, 0::BIGINT FROM ord WHERE rn = 1
    UNION ALL SELECT o.camera, o.rn, o.pos, o.frames, CASE WHEN w.held >= 300 OR o.pos <> w.pos + 1 THEN o.frames ELSE w.held + o.frames END,
      CASE WHEN w.held >= 300 OR o.pos <> w.pos + 1 THEN w.piece + 1 ELSE w.piece END FROM walk w JOIN ord o ON o.camera = w.camera AND o.rn = w.rn + 1)
  SELECT camera, pos, frames, piece FROM walk""")
def dispatch_pieces(s, sf):
    return motion.pack(units(s, sf), 300)


@query(f"""WITH RECURSIVE {o.FILES}, ord AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY pos) AS rn, sum(frames) OVER (PARTITION BY camera) AS total FROM units_v),
  walk(camera, rn, pos, frames, hard_gap, worker, done) AS (SELECT camera, rn, pos, frames, false, 0::BIGINT, frames FROM ord WHERE rn = 1
    UNION ALL SELECT o.camera, o.rn, o.pos, o.frames, o.pos <> w.pos + 1, CASE WHEN w.worker < 2 AND o.pos <> w.pos + 1 THEN w.worker + 1 ELSE greatest(w.worker, least(w.done * 3 // o.total, 2)) END::BIGINT, w.done + o.frames
    FROM walk w JOIN ord o ON o.camera = w.camera AND o.rn = w.rn + 1)
  SELECT camera, pos, frames, hard_gap, worker FROM walk""")
def worker_spread(s, sf):
    return motion.spread(motion.hard_gaps(units(s, sf)), 3).select("camera", "pos", "frames", "hard_gap", "worker")


@query(f"""WITH {o.FILES}, d AS (SELECT *, (part * 7 + camera) % 3 <> 0 AS done FROM seg_v)
  SELECT camera, file, start, "end", done, NOT done OR coalesce(NOT lead(done) OVER (PARTITION BY camera, file ORDER BY start), false) AS redo FROM d""")
def resume_segments(s, sf):
    p = parts(s, sf)
    return motion.resume(p, p.where("(part * 7 + camera) % 3 <> 0").select("file", "start", "end")).select("camera", "file", "start", "end", "done", "redo")


@query(f"""WITH {o.FILES}, q AS (SELECT frame AS id, camera, (frame * 7) % 2600 AS idx FROM hits_v)
  SELECT id, camera, idx, (SELECT f.file FROM file_v f WHERE f.camera = q.camera AND f.first_frame <= q.idx ORDER BY f.first_frame DESC LIMIT 1) AS file FROM q""")
def frame_lookup(s, sf):
    p = views.hits(s, sf).select(F.col("frame").alias("id"), "camera", ((F.col("frame") * 7) % 2600).alias("idx"))
    return motion.find_file(p, chain_files(s, sf))


# clips ----------------------------------------------------------------------------------------------------


def sets(s, sf) -> DataFrame:
    return consumers.class_sets(views.clip_frames(s, sf), ["A", "R"], 0.4, 2)


@query(f"WITH {o.CLIPS} SELECT clip, classes FROM sets_v")
def clip_classes(s, sf):
    return sets(s, sf)


@query(f"WITH {o.CLIPS} SELECT (SELECT count(*) FROM sets_v) AS matched, count(DISTINCT clip) AS clips FROM clips_v")
def clip_match_rate(s, sf):
    every = views.clip_frames(s, sf).select("clip").distinct().join(sets(s, sf), "clip", "left")
    return every.agg(F.count("classes").alias("matched"), F.count(F.lit(1)).alias("clips"))


@query(f"WITH {o.CLIPS} SELECT clip, classes FROM sets_v WHERE clip NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def pending_clips(s, sf):
    return consumers.pending(sets(s, sf), table(s, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("clip")), ["clip"])


@query("""WITH f AS (SELECT o_orderkey AS file, o_custkey AS size, epoch_us(o_orderdate) AS mtime FROM orders), d AS (SELECT file, size + CASE WHEN file % 11 = 0 THEN 1 ELSE 0 END AS size, mtime FROM f WHERE file % 4 <> 1)
  SELECT l_orderkey AS file, count(*) AS kept FROM lineitem WHERE l_orderkey IN (SELECT f.file FROM f JOIN d ON f.file = d.file AND f.size = d.size AND f.mtime = d.mtime) GROUP BY 1""")
def kept_hits(s, sf):
    f = table(s, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("size"), views.micros("o_orderdate").alias("mtime"))
    d = f.where("file % 4 <> 1").withColumn("size", F.col("size") + F.when(F.col("file") % 11 == 0, 1).otherwise(0))
    done = f.join(d, ["file", "size", "mtime"], "left_semi")
    return consumers.still_there(table(s, sf, "lineitem").select(F.col("l_orderkey").alias("file")), done, ["file"]).groupBy("file").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH f AS (SELECT o_orderkey AS file, o_custkey AS size FROM orders), d AS (SELECT file, size + CASE WHEN file % 11 = 0 THEN 1 ELSE 0 END AS size FROM f WHERE file % 4 <> 1)
  SELECT file, size FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file = f.file AND d.size = f.size)""")
def pending_files(s, sf):
    f = table(s, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("size"))
    d = f.where("file % 4 <> 1").withColumn("size", F.col("size") + F.when(F.col("file") % 11 == 0, 1).otherwise(0))
    return consumers.pending(f, d, ["file", "size"])


@query("SELECT o_custkey AS length, count(*) AS files, min(o_orderkey) AS first_file FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def same_size_files(s, sf):
    return consumers.same_files(table(s, sf, "orders").select(F.col("o_custkey").alias("length"), F.col("o_orderkey").alias("file")))


@query("""SELECT p_type AS cls, min(p_partkey) AS class_id FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part WHERE p_partkey % 3 = 0) GROUP BY p_type""")
def class_vocabulary(s, sf):
    p = table(s, sf, "part")
    vocabulary = p.groupBy(F.col("p_type").alias("cls")).agg(F.min("p_partkey").alias("class_id"))
    asked = p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("cls")).distinct().unionAll(s.sql("SELECT 'no such class' AS cls"))
    return consumers.classes_known(asked, vocabulary, strict=False)


# geometry -------------------------------------------------------------------------------------------------


@query("SELECT 400 AS bx1, 100 AS by1, 1500 AS bx2, 800 AS by2, greatest(trunc(950 - 1650.0), 0)::INT AS x1, greatest(trunc(450 - 1050.0), 0)::INT AS y1, least(trunc(950 + 1650.0), 1920)::INT AS x2, least(trunc(450 + 1050.0), 1080)::INT AS y2")
def region_crop(s, sf):
    points = F.from_json(F.lit(str([[list(p) for p in shape] for shape in views.REGION])), "array<array<array<int>>>")
    r = s.range(1).select(geo.shape_bounds(points).alias("b"))
    r = r.withColumn("c", geo.crop_box(F.col("b"), views.FRAME_W, views.FRAME_H))
    return r.select(*[F.col(f"b.{k}").alias("b" + k) for k in ("x1", "y1", "x2", "y2")], "c.*")


_EDGES = "(VALUES (0, 400.0, 300.0, 900.0, 250.0), (0, 900.0, 250.0, 1000.0, 700.0), (0, 1000.0, 700.0, 450.0, 800.0), (0, 450.0, 800.0, 400.0, 300.0), (1, 1200.0, 100.0, 1500.0, 100.0), (1, 1500.0, 100.0, 1350.0, 400.0), (1, 1350.0, 400.0, 1200.0, 100.0)) AS e(shape, ax, ay, bx, cy)"


@query(f"""WITH {o.HITS}, p AS (SELECT frame, camera, target, (x1 + x2) / 2 AS x, y2 AS y FROM hits_v),
  d AS (SELECT p.frame, e.shape, sum(CASE WHEN (CASE WHEN ay > y THEN 1 ELSE 0 END) <> (CASE WHEN cy > y THEN 1 ELSE 0 END) AND x < ax + (y - ay) * (bx - ax) / (cy - ay) THEN 1 ELSE 0 END) % 2 = 1 AS inside,
    min(sqrt(power(x - (ax + greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / ((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)))) * (bx - ax)), 2)
      + power(y - (ay + greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / ((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)))) * (cy - ay)), 2))) AS far
    FROM p, {_EDGES} GROUP BY p.frame, e.shape)
  SELECT camera, target, round(min(CASE WHEN inside THEN 0.0 ELSE far END), 3)::DOUBLE AS nearest_px FROM d JOIN p USING (frame) GROUP BY camera, target""")
def nearest_px(s, sf):
    h = views.hits(s, sf)
    d = geo.region_distance(views.REGION, (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    return h.groupBy("camera", "target").agg(F.round(F.min(d), 3).alias("nearest_px"))


@query(f"""WITH {o.HITS}, w AS (SELECT frame, x1, y1, x2, y2, least(greatest(x2 - x1 + greatest(x2 - x1, y2 - y1), 150.0), 1920.0) AS w, least(greatest(y2 - y1 + greatest(x2 - x1, y2 - y1), 150.0), 1080.0) AS h FROM hits_v),
  l AS (SELECT *, least(greatest((x1 + x2) / 2 - w / 2, 0.0), 1920.0 - w) AS l, least(greatest((y1 + y2) / 2 - h / 2, 0.0), 1080.0 - h) AS t FROM w)
  SELECT frame, trunc(l)::BIGINT AS x1, trunc(t)::BIGINT AS y1, trunc(l + w)::BIGINT AS x2, trunc(t + h)::BIGINT AS y2 FROM l""")
def crop_window(s, sf):
    h = views.hits(s, sf)
    return h.select("frame", geo.crop_window({k: F.col(k) for k in ("x1", "y1", "x2", "y2")}, views.FRAME_W, views.FRAME_H).alias("w")).select("frame", "w.*")


@query()
def crop_groups(s, sf):
    ship(s)
    h = views.hits(s, sf).withColumn("picture", F.expr("us div 3600000000"))
    return consumers.crop_groups(h.select("camera", "picture", "x1", "y1", "x2", "y2"), ["camera", "picture"], views.FRAME_W, views.FRAME_H)


@query(f"""WITH {o.HITS}, p AS (SELECT *, us // 3600000000 AS picture FROM hits_v)
  SELECT a.camera, a.picture, a.frame AS first, b.frame AS second, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2 FROM p a JOIN p b
  ON a.camera = b.camera AND a.picture = b.picture AND a.frame < b.frame AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2""")
def overlapping_boxes(s, sf):
    return consumers.overlapping_boxes(views.hits(s, sf).withColumn("picture", F.expr("us div 3600000000")).select("camera", "picture", "frame", "x1", "y1", "x2", "y2"), ["camera", "picture"])


@query(f"WITH {o.HITS} SELECT frame, x1 + 120 AS x1, y1 + 40 AS y1, x2 + 120 AS x2, y2 + 40 AS y2 FROM hits_v WHERE x2 - x1 > 15")
def shifted_boxes(s, sf):
    h = views.hits(s, sf).where("x2 - x1 > 15")
    box = geo.shift_box(F.array("x1", "y1", "x2", "y2"), F.lit(120.0), F.lit(40.0))
    return h.select("frame", box.alias("b")).select("frame", *[F.col("b")[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"""WITH {o.SESSIONS} SELECT v.camera, v.target, v.start_us, h.frame, h.x1, h.y1, h.conf FROM sightings_v v JOIN hits_v h ON h.frame = v.best_frame AND h.target = v.target""")
def boxes_of_best(s, sf):
    best = sighted(s, sf).select("camera", "target", "start_us", F.col("best_frame").alias("frame"))
    return best.join(views.hits(s, sf).select("frame", "target", "x1", "y1", "conf"), ["frame", "target"])


# consumers ------------------------------------------------------------------------------------------------


@query(f"""WITH {o.SESSIONS}, t AS (SELECT camera, target, start_us, end_us FROM sightings_v ORDER BY end_us DESC, camera, target, start_us LIMIT 4)
  SELECT *, ((row_number() OVER (ORDER BY start_us, camera, target)) - 1) % 4 AS tile FROM t""")
def wall_latest(s, sf):
    d = sighted(s, sf).select("camera", "target", "start_us", "end_us")
    return consumers.latest(d, 4, ["camera", "target", "start_us"]).select("camera", "target", "start_us", "end_us", F.col("tile").cast("long").alias("tile"))


_TILES = "tiles AS (SELECT row_number() OVER (ORDER BY start_us, camera, target) AS tile, camera, target, start_us, end_us - 60000000 AS end_us FROM sightings_v WHERE session % 4 = 1)"


def tiles(s, sf) -> DataFrame:
    t = sighted(s, sf).where("session % 4 = 1")
    n = F.row_number().over(W.orderBy("start_us", "camera", "target")).cast("long")
    return t.select(n.alias("tile"), "camera", "target", "start_us", (F.col("end_us") - 60_000_000).alias("end_us"))


@query(f"""WITH {o.SESSIONS}, {_TILES}, m AS (SELECT r.camera, r.target, r.start_us, r.end_us, min({{'tile': t.tile, 'e': t.end_us}}) FILTER (t.tile IS NOT NULL) AS m FROM sightings_v r LEFT JOIN tiles t
    ON r.camera = t.camera AND r.target = t.target AND r.start_us <= t.end_us + 10000000 AND t.start_us <= r.end_us + 10000000 GROUP BY ALL)
  SELECT camera, target, start_us, end_us, m.tile AS tile, CASE WHEN m.tile IS NULL THEN 'new' WHEN end_us > m.e THEN 'grown' ELSE 'unchanged' END AS change FROM m""")
def wall_match(s, sf):
    d = sighted(s, sf).select("camera", "target", "start_us", "end_us")
    return consumers.match_tiles(d, tiles(s, sf), 10_000_000, [])


@query(f"""WITH {o.SESSIONS}, {_TILES} SELECT camera, target, start_us, end_us FROM sightings_v r WHERE NOT EXISTS (SELECT 1 FROM tiles t
    WHERE r.camera = t.camera AND r.target = t.target AND r.start_us <= t.end_us + 10000000 AND t.start_us <= r.end_us + 10000000)""")
def wall_new(s, sf):
    return consumers.new_rows(sighted(s, sf).select("camera", "target", "start_us", "end_us"), tiles(s, sf), 10_000_000)


@query(f"""WITH {o.SESSIONS}, c AS (SELECT *, start_us // 600000000 * 600000000 AS slot FROM sightings_v WHERE contains(source, 'live') AND end_us >= 1704844800000000 AND camera IN (1, 3)),
  n AS (SELECT *, count(*) OVER (PARTITION BY camera, slot) AS clashes FROM c)
  SELECT camera, target, start_us, strftime(make_timestamp(slot), '%Y%m%d-%H%M%S') || '-nvr_ch' || camera || CASE WHEN clashes > 1 THEN '-' || target ELSE '' END || '.jpg' AS name FROM n""")
def share_names(s, sf):
    d = sighted(s, sf).where(F.contains("source", F.lit("live")) & (F.col("end_us") >= 1_704_844_800_000_000) & F.col("camera").isin(1, 3))
    d = d.withColumn("slot", F.expr("start_us div 600000000 * 600000000")).withColumn("clashes", F.count(F.lit(1)).over(W.partitionBy("camera", "slot")))
    camera = F.replace(F.concat(F.lit("nvr:"), F.col("camera").cast("string")), F.lit(":"), F.lit("_ch"))
    return d.select("camera", "target", "start_us", names.share_name(F.timestamp_micros("slot"), camera, F.col("target"), F.col("clashes")).alias("name"))


@query(f"""WITH {o.RECORDINGS} SELECT h.frame, CASE WHEN n.start IS NULL THEN h.target || '_' || regexp_replace(regexp_replace(n.file, '^.*/', ''), '[.]mp4$', '') || '_' || lpad(printf('%.1f', (h.us % 3600000000) // 100000 / 10.0), 8, '0') || 's'
    ELSE h.target || '_' || strftime(make_timestamp(h.us // 1000000 * 1000000), '%Y%m%d-%H%M%S') END AS image FROM hits_v h JOIN name_v n ON h.camera = n.camera AND h.us // 3600000000 = n.bucket""")
def image_names(s, sf):
    r = views.recordings(s, sf).select("file", F.col("camera").alias("rc"), "bucket", names.recording_times(F.col("file")).alias("r"))
    h = views.hits(s, sf).join(r, (F.col("camera") == F.col("rc")) & (F.expr(f"us div {views.HOUR}") == F.col("bucket")))
    start = F.when(F.col("r.start").isNotNull(), F.timestamp_micros("us"))
    offset = F.expr(f"us % {views.HOUR} div 100000") / 10.0
    return h.select("frame", names.image_name(F.col("target"), start, F.col("file"), offset).alias("image"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 1 THEN 'a.jpg' WHEN p_size % 5 < 1 THEN '' ELSE array_to_string([('a-' || i || '.jpg') FOR i IN range(1, p_size % 5 + 1)], ',') END AS crops FROM part")
def crop_file_names(s, sf):
    n = (F.col("p_size") % 5).cast("int")
    return table(s, sf, "part").select("p_partkey", F.array_join(names.crop_names(F.lit("a.jpg"), n), ",").alias("crops"))


# logs -----------------------------------------------------------------------------------------------------


@query(f"""WITH {o.RUNS}, g AS (SELECT job, min(us) FILTER (type = 'start') AS s, max(us) FILTER (type = 'end') AS e, sum(frames) FILTER (type = 'checkpoint') AS frames FROM runs_v GROUP BY job)
  SELECT job, e - s AS elapsed_us, round(frames / ((e - s) / 1e6), 6) AS fps FROM g WHERE e > s""")
def run_summary(s, sf):
    return consumers.throughput(views.runs(s, sf)).withColumn("fps", F.round("fps", 6))


@query(f"WITH {o.RUNS}, h AS (SELECT *, job * 4 + us // 86400000000 % 4 AS run FROM runs_v) SELECT DISTINCT run AS job FROM h WHERE type = 'start' AND run NOT IN (SELECT run FROM h WHERE type = 'end')")
def unfinished_runs(s, sf):
    return consumers.unfinished_runs(views.runs(s, sf).withColumn("job", F.expr("job * 4 + us div 86400000000 % 4")))


@query(f"""WITH {o.DOWNLOADS}, m AS (SELECT *, CASE WHEN secs > 0 THEN bytes * 8 / secs / 1e6 END AS mbps FROM begun_v),
  k AS (SELECT *, count(mbps) OVER (PARTITION BY nvr ORDER BY n) AS k FROM m)
  SELECT nvr, n, round(mbps, 9) AS mbps, round(avg(mbps) OVER (PARTITION BY nvr ORDER BY k RANGE BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS last_ten,
   round(sum(bytes) OVER w * 8 / greatest(max(began + secs) OVER w - min(began) OVER w, 1e-6) / 1e6, 4) AS overall FROM k WINDOW w AS (PARTITION BY nvr ORDER BY n)""")
def download_speed(s, sf):
    d = consumers.speeds(views.downloads(s, sf))
    return d.select("nvr", "n", F.round("mbps", 9).alias("mbps"), F.round("last_ten", 9).alias("last_ten"), F.round("overall", 4).alias("overall"))


@query(f"""WITH {o.HITS}, c AS (SELECT camera, us, frame, row_number() OVER (PARTITION BY camera ORDER BY us, frame) AS total FROM hits_v),
  a AS (SELECT *, max({{'t': us, 'f': frame, 'v': total}}) OVER (PARTITION BY camera ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1800000000 PRECEDING) AS old,
    first_value({{'t': us, 'f': frame, 'v': total}}) OVER (PARTITION BY camera ORDER BY us, frame) AS one FROM c)
  SELECT camera, us, frame, us - coalesce(old.t, one.t) AS spanned, CASE WHEN us > coalesce(old.t, one.t) THEN round((total - coalesce(old.v, one.v)) * 1e6 / (us - coalesce(old.t, one.t)), 9) END AS recent FROM a""")
def recent_rate(s, sf):
    c = views.hits(s, sf).select("camera", "us", "frame", F.row_number().over(W.partitionBy("camera").orderBy("us", "frame")).alias("total"))
    r = consumers.recent_rate(c, "camera", "us", "total", 1_800_000_000, ["frame"])
    return r.select("camera", "us", "frame", "spanned", F.round(F.col("recent") * 1e6, 9).alias("recent"))


@query("""WITH m AS (SELECT event_id, (props->>'$.k')::DOUBLE AS cost FROM events) SELECT event_id, cost, 50.0::DOUBLE AS budget FROM m WHERE cost > 50""")
def budget_exceeded(s, sf):
    e = table(s, sf, "events")
    message = F.base64(F.encode(F.concat(F.lit('{"costAmount": '), F.get_json_object("props", "$.k"), F.lit(', "budgetAmount": 50}')), "utf-8"))
    return e.select("event_id", values.budget(message).alias("b")).where("b.cost > b.budget").select("event_id", "b.cost", "b.budget")


@query("""WITH l AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 17, '0') AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders)
  SELECT id AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'NOT FOUND' ELSE replace(replace(stamp, ':', ''), ' ', '_') END AS action FROM l""")
def rename_plan(s, sf):
    k = table(s, sf, "orders")
    line = F.concat(F.lit("export "), F.lpad(F.col("o_orderkey").cast("string"), 17, "0"), F.lit("  "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("  end"))
    listed = k.select(names.export_entry(line).alias("e")).select(F.col("e.id").alias("file"), names.stamp_to_name(F.col("e.stamp")).alias("new_name"))
    files = k.where("o_orderkey % 5 <> 0").select(F.lpad(F.col("o_orderkey").cast("string"), 17, "0").alias("file"))
    return consumers.rename_plan(listed, files)


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 5400.0 WHEN 5 THEN 5400.0 WHEN 6 THEN 90.0 * 60 WHEN 1 THEN (o_custkey % 50) * 60.0 WHEN 2 THEN (o_custkey % 50) * 60.0 + 30 WHEN 3 THEN 3600.0 + 45 ELSE NULL END::DOUBLE AS seconds FROM orders""")
def parsed_durations(s, sf):
    c = (F.col("o_custkey") % 50).cast("string")
    k = F.col("o_orderkey") % 7
    text = F.when(k == 0, "1h30m").when(k == 5, "1H30M").when(k == 6, " 90m ").when(k == 1, c).when(k == 2, F.concat(c, F.lit(".5"))).when(k == 3, "1h45s").otherwise("soon")
    return table(s, sf, "orders").select("o_orderkey", values.duration_seconds(text).alias("seconds"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate WHEN 1 THEN date_trunc('minute', o_orderdate) WHEN 2 THEN TIMESTAMP '2024-02-01 07:05:00' WHEN 3 THEN o_orderdate WHEN 4 THEN NULL ELSE NULL END AS start FROM orders""")
def parsed_starts(s, sf):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.date_format("o_orderdate", " yyyy-MM-dd HH:mm:ss ")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(k == 2, "07:05")
    text = text.when(k == 3, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 4, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("yesterday")
    return table(s, sf, "orders").select("o_orderkey", values.parse_start(text, F.lit("2024-02-01").cast("date")).alias("start"))


@query(f"WITH {o.HITS} SELECT frame, strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((us // 1000 % 1000)::VARCHAR, 3, '0') AS t FROM hits_v")
def iso_times(s, sf):
    return views.hits(s, sf).select("frame", values.iso_millis(F.col("us")).alias("t"))


@query("SELECT event_id, round_even(event_id / 2.0, 0)::DOUBLE AS whole, round_even(event_id / 8.0, 2)::DOUBLE AS cents FROM events")
def half_even_rounding(s, sf):
    i = F.col("event_id")
    return table(s, sf, "events").select("event_id", values.half_even(i / 2.0).alias("whole"), values.half_even(i / 8.0, 2).alias("cents"))


@query("""SELECT c_custkey, regexp_matches(lower(n), '^(channel|ipcamera|camera)[ ]*[0-9]+$') AS is_default FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Channel ' || c_custkey WHEN 1 THEN 'IPCamera' || c_custkey WHEN 2 THEN c_name ELSE 'camera' END AS n FROM customer)""")
def default_camera_names(s, sf):
    k = F.col("c_custkey")
    n = F.when(k % 4 == 0, F.concat(F.lit("Channel "), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("IPCamera"), k.cast("string"))).when(k % 4 == 2, F.col("c_name")).otherwise("camera")
    return table(s, sf, "customer").select("c_custkey", names.is_default_camera(n).alias("is_default"))


@query("SELECT * FROM (VALUES ('hall', 1, 0, 0), ('hall', 2, 0, 1), ('yard', 3, 1, 0), ('hall', 7, 2, 1)) AS t(nvr, channel, a, b)")
def camera_spec(s, sf):
    from weir.sources.files import resolve_cameras

    return resolve_cameras(s.sql("SELECT 'hall:1,2 yard:3 hall:2,7' AS spec"))


@query(f"""WITH {o.DOWNLOADS}, q AS (SELECT nvr, n, n % 7 AS priority, n AS seq FROM down_v) SELECT nvr, seq, priority, row_number() OVER (PARTITION BY nvr ORDER BY priority, seq) AS turn FROM q""")
def service_order(s, sf):
    q = views.downloads(s, sf).select("nvr", F.col("n").alias("seq"), (F.col("n") % 7).alias("priority"))
    return consumers.queue_order(q).withColumn("turn", F.col("turn").cast("long"))


@query(f"""WITH {o.HITS} SELECT frame, camera, (row_number() OVER (PARTITION BY camera, frame % 3 ORDER BY us, frame) - 1) // 8 AS batch FROM hits_v""")
def inference_batches(s, sf):
    h = views.hits(s, sf).withColumn("shape", F.col("frame") % 3)
    return consumers.batches(h, ["camera", "shape"], ["us", "frame"], 8).select("frame", "camera", F.col("batch").cast("long").alias("batch"))


@query(f"""WITH {o.COVERAGE} SELECT camera, count(*) AS total, count(*) FILTER (pos % 3 = 0) AS done, repeat('#', (count(*) FILTER (pos % 3 = 0) * 20 // count(*))::INT) || repeat('-', 20 - (count(*) FILTER (pos % 3 = 0) * 20 // count(*))::INT) AS bar,
   round(600.0 * (count(*) - count(*) FILTER (pos % 3 = 0)) / count(*) FILTER (pos % 3 = 0), 3)::DOUBLE AS eta_s FROM chunk_v GROUP BY camera""")
def progress(s, sf):
    g = plan_chunks(s, sf).groupBy("camera").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("pos") % 3 == 0).alias("done"))
    return g.select("camera", "total", "done", values.progress_bar(F.col("done"), F.col("total")).alias("bar"), F.round(values.eta_seconds(F.lit(600.0), F.col("done"), F.col("total")), 3).alias("eta_s"))


@query("SELECT o_orderpriority, sha256('conf=0.3' || chr(10) || 'imgsz=1280' || chr(10) || 'model=yolo26x.pt' || chr(10) || 'targets=' || o_orderpriority) AS fp FROM orders GROUP BY o_orderpriority")
def job_fingerprint(s, sf):
    d = table(s, sf, "orders").select("o_orderpriority").distinct()
    fp = values.fingerprint({"targets": F.col("o_orderpriority"), "conf": F.lit("0.3"), "imgsz": F.lit(1280), "model": F.lit("yolo26x.engine")})
    return d.select("o_orderpriority", fp.alias("fp"))


@query(f"WITH {o.DOUBLED}, r AS (SELECT *, row_number() OVER (PARTITION BY camera, frame ORDER BY us DESC) AS rn FROM dup_v) SELECT camera, frame, us, src FROM r WHERE rn = 1")
def upsert_hits(s, sf):
    d = views.doubled_hits(s, sf).select("camera", "frame", "us", "src")
    return consumers.upsert(d.where("src = 'nvr'"), d.where("src = 'live'"), ["camera", "frame"], "us")


# frames as arrays -----------------------------------------------------------------------------------------


@query()
def ema_motion_score(s, sf):
    ship(s)
    e = table(s, sf, "embeddings")
    idx = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    f = e.where("label is not null").select(F.col("label").alias("camera"), idx.cast("long").alias("idx"), F.transform("embedding", lambda x: x * 100 + 128).alias("pixels"))
    return vision.background_scores(f).select("camera", "idx", F.round("score", 6).alias("score"))


@query("""WITH k AS (SELECT [exp(-0.5 * power(d / 1.0, 2)) FOR d IN range(-3, 4)] AS g), w AS (SELECT [x / list_sum(g) FOR x IN g] AS w FROM k), e AS (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
  SELECT vec_id, (i - 1)::BIGINT AS pos, round(list_sum([coalesce(CASE WHEN i + d BETWEEN 1 AND len(embedding) THEN embedding[i + d]::DOUBLE END, 0.0) * w[d + 4] FOR d IN range(-3, 4)]), 6) AS value FROM e, w""")
def array_blur(s, sf):
    b = vision.blur(F.col("embedding").cast("array<double>"), 1.0)
    return table(s, sf, "embeddings").select("vec_id", F.posexplode(b).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


@query("""SELECT vec_id, len([i FOR i IN range(1, len(embedding) + 1) IF i % 3 = 0 AND abs(embedding[i]) > 0.1]) / len([i FOR i IN range(1, len(embedding) + 1) IF i % 3 = 0]) AS score FROM embeddings""")
def foreground_share(s, sf):
    mask = F.transform("embedding", lambda x: (F.abs(x.cast("double")) > 0.1).cast("long"))
    region = F.transform("embedding", lambda x, i: ((i + 1) % 3 == 0).cast("long"))
    return table(s, sf, "embeddings").select("vec_id", vision.foreground_share(mask, region).alias("score"))


# files and frames -----------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT o_orderkey AS file, o_custkey AS length, epoch_us(o_orderdate) AS mtime FROM orders), found AS (SELECT * FROM f WHERE file % 7 <> 2),
  known AS (SELECT file, length + CASE WHEN file % 11 = 0 THEN 1 ELSE 0 END AS length, mtime + CASE WHEN file % 13 = 0 THEN 1 ELSE 0 END AS mtime FROM f WHERE file % 5 <> 1)
  SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'new' WHEN a.file IS NULL THEN 'gone' ELSE 'changed' END AS change
  FROM found a FULL JOIN known b ON a.file = b.file WHERE a.file IS NULL OR b.file IS NULL OR a.length <> b.length OR a.mtime <> b.mtime""")
def changed_files(s, sf):
    from weir.sources.files import changed_files

    f = table(s, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("length"), views.micros("o_orderdate").alias("mtime"))
    bump = lambda c, k: F.col(c) + F.when(F.col("file") % k == 0, 1).otherwise(0)
    known = f.where("file % 5 <> 1").select("file", bump("length", 11).alias("length"), bump("mtime", 13).alias("mtime"))
    return changed_files(f.where("file % 7 <> 2"), known)


@query("""WITH f AS (SELECT o_custkey, string_agg('in/' || o_orderkey || '|' || o_custkey || '|' || epoch(o_orderdate)::BIGINT, chr(10) ORDER BY o_orderkey) AS files FROM orders GROUP BY o_custkey)
  SELECT o_custkey AS job, sha256(files || chr(10) || CASE WHEN o_custkey % 2 = 0 THEN 'region r.json|1|7' ELSE 'no region' END || chr(10) || 'frame_skip=3' || chr(10) || 'threshold=' || o_custkey) AS fp FROM f""")
def motion_fingerprint(s, sf):
    k = table(s, sf, "orders")
    one = F.struct("o_orderkey", F.concat(F.lit("in\\"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("size"), (views.micros("o_orderdate") / 1e6).alias("mtime"))
    g = k.groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("files"))
    region = F.when(F.col("o_custkey") % 2 == 0, F.struct(F.lit("r.json").alias("path"), F.lit(1).alias("size"), F.lit(7.9).alias("mtime")))
    fp = values.motion_fingerprint(F.col("files"), region, {"threshold": F.col("o_custkey"), "frame_skip": F.lit(3), "workers": F.col("o_custkey") % 5})
    return g.select(F.col("o_custkey").alias("job"), fp.alias("fp"))


@query(f"WITH {o.RAW} SELECT file, fps, frames::BIGINT AS frames, frames / fps AS duration FROM raw_v")
def probed_files(s, sf):
    from weir.sources import frames

    ship(s)
    return frames.probe(views.raw_files(s, sf)).select("file", "fps", "frames", "duration")


@query(f"""WITH {o.RAW} SELECT camera, first_frame + frame AS idx, file, frame, ((k + byte0) % 256 + (k + byte0 + 1) % 256 + (k + byte0 + 2) % 256 + (k + byte0 + 3) % 256)::BIGINT AS light FROM raw_frame_v""")
def chained_frames(s, sf):
    """Every frame of every camera's chain of files, numbered through."""
    from weir.sources import frames

    ship(s)
    files = views.raw_files(s, sf)
    c = frames.chain(frames.probe(files)).select("file", "first_frame")
    f = frames.read_frames(files.join(c, "file"))
    return f.select("camera", "idx", "file", "frame", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("light"))


@query(f"""WITH {o.RAW} SELECT file, frame / fps AS "offset", ((k + byte0) % 256)::BIGINT AS first FROM raw_frame_v WHERE frame % 3 = 0""")
def keyframe_offsets(s, sf):
    from weir.sources import frames

    ship(s)
    return frames.keyframes(views.raw_files(s, sf)).select("file", "offset", F.col("pixels")[0].cast("long").alias("first"))


@query(f"""WITH {o.RAW}, q AS (SELECT k AS id, file, frames / fps / 2 AS mid FROM raw_v)
  SELECT q.id, q.file, min(f.frame / f.fps) AS "offset" FROM q LEFT JOIN raw_frame_v f ON f.file = q.file AND f.frame % 3 = 0 AND f.frame / f.fps >= q.mid - 0.05 GROUP BY q.id, q.file""")
def grabbed_keyframes(s, sf):
    from weir.sources import frames

    ship(s)
    files = views.raw_files(s, sf)
    p = frames.probe(files)
    asked = p.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("id"), "file", (F.col("duration") / 2).alias("offset"))
    return frames.grab_keyframe(frames.keyframes(files), asked, 0.05).select("id", "file", "offset")


@query(f"""WITH {o.SESSIONS}, i AS (SELECT target || '_' || camera || '_' || session AS image, best_frame AS frame FROM sightings_v WHERE session % 5 <> 4)
  SELECT camera, target, start_us, i.frame FROM sightings_v JOIN i ON i.image = target || '_' || camera || '_' || session""")
def picture_frames(s, sf):
    d = sighted(s, sf).withColumn("image", F.concat_ws("_", "target", F.col("camera").cast("string"), F.col("session").cast("string")))
    return consumers.frames_of_images(d, d.where("session % 5 <> 4").select("image", F.col("best_frame").alias("frame"))).select("camera", "target", "start_us", "frame")


@query(f"WITH {o.HITS} SELECT frame FROM hits_v WHERE least(x2, 1000) > x1 AND least(y2, 500) > y1")
def whole_crops(s, sf):
    h = views.hits(s, sf)
    return consumers.whole_crops(h.withColumns({"x2": F.least("x2", F.lit(1000.0)), "y2": F.least("y2", F.lit(500.0))})).select("frame")


@query("""WITH p AS (SELECT p_partkey || '.jpg' AS picture, p_partkey, p_size % 4 AS n FROM part)
  SELECT picture, 'raw' AS kind, 'raw/' || picture AS name FROM p UNION ALL SELECT picture, 'overlay', 'overlay/' || picture FROM p
  UNION ALL SELECT picture, 'crop', 'crop/' || CASE WHEN n = 1 THEN picture ELSE p_partkey || '-' || i || '.jpg' END FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p)""")
def picture_fan_out(s, sf):
    p = table(s, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("picture"), (F.col("p_size") % 4).cast("int").alias("crops"))
    return consumers.fan_out_pictures(p)


@query(f"WITH {o.CLIPS} SELECT 'in/' || clip || '.mp4' AS source, 'out/' || clip || '.mp4' AS target, 'copy' AS action FROM sets_v")
def clip_transfers(s, sf):
    return consumers.transfers(sets(s, sf).select(F.concat(F.lit("in/"), F.col("clip").cast("string"), F.lit(".mp4")).alias("file")), "out")


@query(f"""WITH {o.SESSIONS}, p AS (SELECT frame, (x1 + x2) / 2 AS x, y2 AS y FROM hits_v),
  d AS (SELECT p.frame, e.shape, sum(CASE WHEN (CASE WHEN ay > y THEN 1 ELSE 0 END) <> (CASE WHEN cy > y THEN 1 ELSE 0 END) AND x < ax + (y - ay) * (bx - ax) / (cy - ay) THEN 1 ELSE 0 END) % 2 = 1 AS inside,
    min(sqrt(power(x - (ax + greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / ((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)))) * (bx - ax)), 2)
      + power(y - (ay + greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / ((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)))) * (cy - ay)), 2))) AS far
    FROM p, {_EDGES} GROUP BY p.frame, e.shape),
  n AS (SELECT camera, target, session, min(CASE WHEN inside THEN 0.0 ELSE far END) AS px FROM d JOIN ses_v USING (frame) GROUP BY camera, target, session)
  SELECT camera, target, start_us, round_even((end_us - start_us) / 1e6, 1)::DOUBLE AS duration_s, hits, round_even(max_conf, 3)::DOUBLE AS max_conf, raw_classes, round_even(px, 0)::DOUBLE AS nearest_px, source FROM sightings_v JOIN n USING (camera, target, session)""")
def sightings_table(s, sf):
    """Sightings as their table shows them: rounded, with the region's distance by session, in order of start and target."""
    d = sightings.camera_sightings(views.hits(s, sf), GAP, distance=geo.region_distance(views.REGION, (F.col("x1") + F.col("x2")) / 2, F.col("y2")))
    d = sightings.output_columns(d.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / 1e6))
    return d.select("camera", "target", "start_us", "duration_s", "hits", "max_conf", "raw_classes", "nearest_px", "source")


# streams --------------------------------------------------------------------------------------------------


@query(f"""WITH {o.SESSIONS} SELECT camera, target, make_timestamp(start_us) AS start, make_timestamp(end_us) AS "end", n AS hits, max_conf FROM sightings_v JOIN (SELECT camera, target, session, count(*) AS n FROM ses_v GROUP BY ALL) USING (camera, target, session)""")
def stream_sightings(s, sf):
    from weir.streaming.run import drain
    from weir.streaming.sightings import windowed_sightings

    def through(events: DataFrame) -> DataFrame:
        h = events.select((F.col("user_id") % 4).alias("camera"), F.when(F.col("event_type").isin("click", "view"), "engage").otherwise(F.col("event_type")).alias("target"), F.col("ts").alias("t"), (F.col("value") / 500.0).alias("conf"))
        return windowed_sightings(h)

    return drain(s, f"{sf}/events.parquet", through)


@query("SELECT user_id % 4 AS camera, make_timestamp(epoch_us(ts) // 300000000 * 300000000) AS chunk, count(*) AS hits FROM events GROUP BY ALL")
def stream_chunks(s, sf):
    from weir.streaming.run import drain
    from weir.streaming.sightings import chunk_counts

    return drain(s, f"{sf}/events.parquet", lambda e: chunk_counts(e.select((F.col("user_id") % 4).alias("camera"), F.col("ts").alias("t"))))


@query("SELECT (c * 31 + i * 17) % 100::DOUBLE AS value, c::INT AS chunk, i / 25.0::DOUBLE AS \"offset\" FROM range(4) a(c), range(0, 50, 25) b(i)".replace("(c * 31 + i * 17) % 100::DOUBLE", "((c * 31 + i * 17) % 100)::DOUBLE").replace("i / 25.0::DOUBLE", "(i / 25.0)::DOUBLE"))
def replay_keyframes(s, sf):
    from weir.sources.replay import ReplaySource

    ship(s)
    s.dataSource.register(ReplaySource)
    return s.read.format("replay").option("keyframesOnly", "true").load().select("chunk", "offset", "value")


@query(f"""WITH {o.FRAMES}, x AS (SELECT camera, max(idx) AS last FROM frames_v GROUP BY camera)
  SELECT camera, start, confirmed_at, "end" FROM mev_v JOIN x USING (camera) WHERE "end" < last""")
def stream_motion_events(s, sf):
    """Motion events as a stream gives them: each once it has ended, so one that the chain's end cuts off isn't there yet."""
    from weir.streaming.run import drain
    from weir.streaming.sightings import stream_events

    ship(s)
    path = scratch(s, "frames")
    flags(s, sf).select("camera", "idx", "motion").write.parquet(path)
    ended = flags(s, sf).groupBy(F.col("camera").alias("__c")).agg(F.max("idx").alias("__last"))
    out = drain(s, f"{path}/*.parquet", lambda f: stream_events(f, 3, 4, 6), "append")
    return out.join(ended, F.col("camera") == F.col("__c")).where(F.col("end") < F.col("__last")).select("camera", "start", "confirmed_at", "end")
