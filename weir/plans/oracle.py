"""SQL views for DuckDB that state the derived tables of ``views.py`` independently."""

HITS = """hits_v AS (
  SELECT user_id % 4 AS camera, CASE WHEN event_type IN ('click', 'view') THEN 'engage' ELSE event_type END AS target, event_type AS cls,
    ts AS t, epoch_us(ts) AS us, value / 500.0 AS conf, ((event_id * 37) % 1800)::DOUBLE AS x1, ((event_id * 53) % 1000)::DOUBLE AS y1,
    ((event_id * 37) % 1800 + 10 + event_id % 90)::DOUBLE AS x2, ((event_id * 53) % 1000 + 10 + event_id % 60)::DOUBLE AS y2,
    CASE WHEN event_id % 3 = 0 THEN 'live' ELSE 'nvr' END AS src, event_id AS frame FROM events)"""

DOUBLED = (
    HITS
    + """, dup_v AS (
  SELECT camera, target, cls, us, conf, x1, y1, x2, y2, 'nvr' AS src, frame FROM hits_v
  UNION ALL SELECT camera, target, cls, us + 200000, conf, x1 + 3, y1 + 3, x2 + 3, y2 + 3, 'live', frame FROM hits_v WHERE frame % 5 = 0)"""
)

SESSIONS = (
    HITS
    + """, lag_v AS (SELECT *, us - lag(us) OVER (PARTITION BY camera, target ORDER BY us, frame) AS d FROM hits_v),
  ses_v AS (SELECT *, sum(CASE WHEN d > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera, target ORDER BY us, frame) AS session FROM lag_v),
  cnt_v AS (SELECT camera, target, session, cls, count(*) AS n, min({'us': us, 'frame': frame}) AS f FROM ses_v GROUP BY ALL),
  raw_v AS (SELECT camera, target, session, string_agg(cls || ':' || n, ';' ORDER BY n DESC, f, cls) AS raw_classes FROM cnt_v GROUP BY ALL),
  one_v AS (SELECT camera, target, session, min(us) AS start_us, max(us) AS end_us, count(DISTINCT frame) AS hits, max(conf) AS max_conf,
    first(frame ORDER BY conf DESC, us, frame) AS best_frame,
    CASE WHEN bool_or(src = 'live') AND bool_or(src = 'nvr') THEN 'nvr+live' WHEN bool_or(src = 'live') THEN 'live' ELSE 'nvr' END AS source
    FROM ses_v GROUP BY ALL),
  sightings_v AS (SELECT * FROM one_v JOIN raw_v USING (camera, target, session))"""
)

RECORDINGS = (
    HITS
    + """, bucket_v AS (SELECT DISTINCT camera, us // 3600000000 AS bucket FROM hits_v),
  rec0_v AS (SELECT *, bucket * 3600000000 AS true_start, bucket * 3600000000 + 3600000000 - CASE WHEN bucket % 24 % 6 = 5 THEN 5000000 ELSE 0 END AS true_end FROM bucket_v),
  rec_v AS (SELECT 'cam' || camera || '/' || CASE
      WHEN day(make_timestamp(true_start)) = 15 AND bucket % 24 = 3 THEN 'clip_' || bucket
      WHEN bucket % 2 = 0 THEN 'rec_' || strftime(make_timestamp(true_start), '%Y%m%d%H%M%S') || '_' || strftime(make_timestamp(true_end), '%Y%m%d%H%M%S')
      ELSE strftime(make_timestamp(true_start), '%Y-%m-%d_%H%M%S') END || '.mp4' AS file, camera, bucket, true_start, true_end FROM rec0_v),
  name_v AS (SELECT file, camera, bucket, CASE WHEN day(make_timestamp(true_start)) = 15 AND bucket % 24 = 3 THEN NULL ELSE true_start END AS start,
      CASE WHEN day(make_timestamp(true_start)) = 15 AND bucket % 24 = 3 OR bucket % 2 = 1 THEN NULL ELSE true_end END AS "end" FROM rec_v),
  cut_v AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN start IS NULL OR start - lag(coalesce("end", start)) OVER w > 3000000 THEN 1 ELSE 0 END AS cut
      FROM name_v WINDOW w AS (PARTITION BY camera ORDER BY start NULLS LAST, "end" NULLS FIRST, file)),
  stretch_v AS (SELECT *, sum(cut) OVER (PARTITION BY camera ORDER BY start NULLS LAST, "end" NULLS FIRST, file) AS stretch FROM cut_v)"""
)

FRAMES = (
    HITS
    + """, frames_v AS (SELECT camera, row_number() OVER (PARTITION BY camera ORDER BY us, frame) - 1 AS idx, conf AS score FROM hits_v),
  flag_v AS (SELECT camera, idx, first_value(score >= 0.07 AND idx >= 10) OVER (PARTITION BY camera, idx - idx % 1 ORDER BY idx) AS motion FROM frames_v),
  isl_v AS (SELECT camera, idx, idx - row_number() OVER (PARTITION BY camera ORDER BY idx) AS island FROM flag_v WHERE motion),
  run_v AS (SELECT camera, idx, island, row_number() OVER (PARTITION BY camera, island ORDER BY idx) AS run, idx - lag(idx) OVER (PARTITION BY camera ORDER BY idx) AS d FROM isl_v),
  mses_v AS (SELECT *, sum(CASE WHEN d > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY idx) AS session FROM run_v),
  mev0_v AS (SELECT camera, session, min(CASE WHEN run >= 3 THEN idx END) AS confirmed_at, max(idx) AS last_motion FROM mses_v GROUP BY ALL),
  mev1_v AS (SELECT camera, confirmed_at, least(last_motion + 6, (SELECT max(idx) FROM frames_v f WHERE f.camera = m.camera)) AS "end" FROM mev0_v m WHERE confirmed_at IS NOT NULL),
  mev_v AS (SELECT camera, greatest(confirmed_at - 4 + 1, coalesce(lag("end") OVER (PARTITION BY camera ORDER BY confirmed_at) + 1, 0), 0) AS start, confirmed_at, "end" FROM mev1_v)"""
)

#: Files of 150 frames (the last shorter) in each camera's chain; their names aren't padded.
FILES = (
    FRAMES
    + """, file_v AS (SELECT camera, 'cam' || camera || '_' || (idx // 150) || '.mp4' AS file, count(*) AS frames, min(idx) AS first_frame FROM frames_v GROUP BY ALL),
  seg_v AS (SELECT camera, file, frames, first_frame, part * 50 AS start, CASE WHEN part = parts - 1 THEN frames ELSE (part + 1) * 50 END AS "end", part, parts
    FROM (SELECT *, greatest(frames // 50, 1) AS parts, unnest(range(greatest(frames // 50, 1))) AS part FROM file_v)),
  unit_v AS (SELECT camera, row_number() OVER (PARTITION BY camera ORDER BY first_frame, part) - 1 AS pos0, "end" - start AS frames FROM seg_v),
  units_v AS (SELECT camera, pos0 AS pos, frames FROM unit_v WHERE pos0 % 13 <> 7)"""
)

COVERAGE = """cov_v AS (SELECT user_id % 4 AS camera, epoch_us(ts) AS s, epoch_us(ts) + 60000000 + floor(value * 10)::BIGINT * 1000000 AS e FROM events),
  reach_v AS (SELECT *, max(e) OVER (PARTITION BY camera ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cov_v),
  part_v AS (SELECT *, sum(CASE WHEN s > reach + 500000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM reach_v),
  merged_v AS (SELECT camera, min(s) AS s, max(e) AS e, count(*) AS spans FROM part_v GROUP BY camera, part),
  range_v AS (SELECT camera, min(s) AS s, max(e) AS e FROM cov_v GROUP BY camera),
  grid_v AS (SELECT *, unnest(range(s // 300000000, (e - 1) // 300000000 + 1)) AS g FROM range_v),
  chunk_v AS (SELECT camera, greatest(s, g * 300000000) AS cs, least(e, (g + 1) * 300000000) AS ce, g - s // 300000000 AS pos FROM grid_v)"""

CLIPS = """clips_v AS (SELECT l_orderkey AS clip, l_linenumber AS idx, l_returnflag AS cls, l_discount * 10 AS conf FROM lineitem),
  sets_v AS (SELECT clip, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM clips_v WHERE idx % 2 = 0 AND conf >= 0.4 AND cls IN ('A', 'R') GROUP BY clip)"""

DOWNLOADS = """down_v AS (SELECT l_suppkey % 5 AS nvr, row_number() OVER (PARTITION BY l_suppkey % 5 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n,
    round(l_extendedprice * 1000)::BIGINT AS bytes, l_quantity - 1 AS secs FROM lineitem),
  begun_v AS (SELECT *, n * 2.0::DOUBLE AS began FROM down_v)"""

RUNS = """runs_v AS (SELECT user_id AS job, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'checkpoint' WHEN 'view' THEN 'checkpoint' WHEN 'purchase' THEN 'end' END AS type,
    value * 100 AS frames FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase'))"""

#: Raw files of four cameras: short where the part's key is a multiple of 5, without a rate where its size is one of 3.
RAW = """raw_v AS (SELECT p_partkey AS k, p_partkey % 4 AS camera, 'clip' || p_partkey || '.raw' AS file, CASE WHEN p_size % 3 = 0 THEN 25.0 ELSE p_size % 3 * 12.5 END::DOUBLE AS fps,
    p_size % 7 + 1 AS frames, p_size % 7 + 1 - CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS there FROM part),
  raw_chain_v AS (SELECT *, coalesce(sum(frames) OVER (PARTITION BY camera ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_frame FROM raw_v),
  raw_frame_v AS (SELECT *, frame * 4 AS byte0 FROM (SELECT *, unnest(range(there)) AS frame FROM raw_chain_v))"""
