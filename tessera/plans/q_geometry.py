"""Registered queries: resize plans, boxes, token budgets, frame plans (G1-G14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import geometry as GO
from ..operators import video as VO
from . import fixtures as FX
from .registry import loader, query
from .sqlgeom import resize_sql

W = FX.with_ctes


def images(t):
    """Prompt images with per-row options: every 10th row asks for an
    explicit size, the next one carries the fine-tuning pixel budget."""
    p = FX.prompts(t)
    k = F.col("id") % 10
    return p.select("id", "source_site", "height", "width",
                    F.when(k == 0, F.floor(F.col("height") / 2) + 1).cast("bigint").alias("resized_height_req"),
                    F.when(k == 0, F.floor(F.col("width") / 2) + 1).cast("bigint").alias("resized_width_req"),
                    F.when(k == 1, F.lit(784)).cast("bigint").alias("min_pixels"),
                    F.when(k == 1, F.lit(50176)).cast("bigint").alias("max_pixels"))


IMAGES_SQL = f"""images AS (
  SELECT id, source_site, height, width,
         CASE WHEN id % 10 = 0 THEN CAST(floor(height / 2) + 1 AS BIGINT) END AS rh,
         CASE WHEN id % 10 = 0 THEN CAST(floor(width / 2) + 1 AS BIGINT) END AS rw,
         CASE WHEN id % 10 = 1 THEN CAST(784 AS BIGINT) END AS min_pixels,
         CASE WHEN id % 10 = 1 THEN CAST(50176 AS BIGINT) END AS max_pixels
  FROM prompts),
opts AS (
  SELECT *, CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN rh ELSE height END AS hh,
            CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN rw ELSE width END AS ww,
            CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN {G.MIN_PIXELS} ELSE coalesce(min_pixels, {G.MIN_PIXELS}) END AS lo,
            CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN {G.MAX_PIXELS} ELSE coalesce(max_pixels, {G.MAX_PIXELS}) END AS hi
  FROM images)"""
_R = resize_sql("hh", "ww", G.IMAGE_FACTOR, "lo", "hi")
PLAN_SQL = f""",
plan AS (SELECT id, source_site, {_R['height']} AS resized_height, {_R['width']} AS resized_width,
                {_R['reject']} AS reject, {_R['degenerate']} AS degenerate FROM opts)"""


@query("resize_plan", W(FX.PROMPTS_SQL, IMAGES_SQL) + PLAN_SQL + """
SELECT id, resized_height, resized_width, reject, degenerate FROM plan""")
def resize_plan(spark, d):
    r = GO.resize_plan(images(loader(spark, d)))
    return r.select("id", "resized_height", "resized_width", "reject", "degenerate")


_S = resize_sql("height", "width", G.IMAGE_FACTOR, G.STRICT_MIN_PIXELS, G.STRICT_MAX_PIXELS, strict=True)
STRICT_SQL = f"""strict AS (
  SELECT id, height, width, {_S['height']} AS resized_height, {_S['width']} AS resized_width,
         {_S['reject']} AS reject FROM prompts)"""


@query("resize_plan_strict", W(FX.PROMPTS_SQL, STRICT_SQL) + """
SELECT id, resized_height, resized_width, reject FROM strict""")
def resize_plan_strict(spark, d):
    r = GO.resize_plan_strict(FX.prompts(loader(spark, d)))
    return r.select("id", "resized_height", "resized_width", "reject")


def boxes(t):
    """Two boxes per prompt image; some extend past the image edge."""
    p = FX.prompts(t)
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    b = p.select("id", "height", "width", k)
    i, kk = F.col("id"), F.col("k")
    x1 = (i * 37 + kk * 101) % F.col("width")
    y1 = (i * 53 + kk * 31) % F.col("height")
    return b.select("id", F.col("k").cast("bigint").alias("k"), "height", "width",
                    x1.cast("bigint").alias("x1"), y1.cast("bigint").alias("y1"),
                    (x1 + 1 + (i * 13 + kk * 29) % (F.floor(F.col("width") / 2) + 1)).cast("bigint").alias("x2"),
                    (y1 + 1 + (i * 11 + kk * 17) % (F.floor(F.col("height") / 2) + 1)).cast("bigint").alias("y2"))


BOXES_SQL = """b0 AS (SELECT id, height, width, unnest([0, 1]) AS k FROM prompts),
boxes AS (
  SELECT id, CAST(k AS BIGINT) AS k, height, width, x1, y1,
         CAST(x1 + 1 + (id * 13 + k * 29) % (floor(width / 2) + 1) AS BIGINT) AS x2,
         CAST(y1 + 1 + (id * 11 + k * 17) % (floor(height / 2) + 1) AS BIGINT) AS y2
  FROM (SELECT *, CAST((id * 37 + k * 101) % width AS BIGINT) AS x1,
                  CAST((id * 53 + k * 31) % height AS BIGINT) AS y1 FROM b0))"""


def _rel(v, s):
    return f"CAST(least(greatest(round_even({v} / {s} * 1000, 0), 0), 1000) AS BIGINT)"


@query("bbox_relative", W(FX.PROMPTS_SQL, BOXES_SQL) + f"""
SELECT id, k, {_rel('x1', 'width')} AS rx1, {_rel('y1', 'height')} AS ry1,
       {_rel('x2', 'width')} AS rx2, {_rel('y2', 'height')} AS ry2 FROM boxes""")
def bbox_relative(spark, d):
    b = GO.boxes_relative(boxes(loader(spark, d)))
    return b.select("id", "k", "rx1", "ry1", "rx2", "ry2")


def _sc(v, o, n):
    return f"CAST(least(greatest(round_even({v} * ({n} / {o}), 0), 0), {n} - 1) AS BIGINT)"


_SB = resize_sql("b.height", "b.width", G.IMAGE_FACTOR, G.STRICT_MIN_PIXELS, G.STRICT_MAX_PIXELS, strict=True)


@query("bbox_resized", W(FX.PROMPTS_SQL, BOXES_SQL) + f""",
sb AS (SELECT b.*, {_SB['height']} AS nh, {_SB['width']} AS nw, {_SB['reject']} AS reject FROM boxes b)
SELECT id, k, {_sc('x1', 'width', 'nw')} AS sx1, {_sc('y1', 'height', 'nh')} AS sy1,
       {_sc('x2', 'width', 'nw')} AS sx2, {_sc('y2', 'height', 'nh')} AS sy2, reject
FROM sb""")
def bbox_resized(spark, d):
    b = GO.boxes_resized(boxes(loader(spark, d)))
    return b.select("id", "k", "sx1", "sy1", "sx2", "sy2", "reject")


@query("token_budget", W(FX.PROMPTS_SQL, IMAGES_SQL) + PLAN_SQL + """
SELECT source_site, count(*) FILTER (reject IS NULL AND NOT degenerate) AS n_images,
       count(*) FILTER (reject IS NOT NULL) AS n_rejected, count(*) FILTER (reject IS NULL AND degenerate) AS n_degenerate,
       CAST(coalesce(sum(floor((resized_height / 14) * (resized_width / 14) / 4))
                     FILTER (reject IS NULL AND NOT degenerate), 0) AS BIGINT) AS total_tokens
FROM plan GROUP BY source_site""")
def token_budget(spark, d):
    return GO.token_budget(GO.resize_plan(images(loader(spark, d))), ["source_site"])


# ---------------------------------------------------------------- video
def videos(t):
    """Video metadata and request options derived per document."""
    i = F.col("doc_id")
    m6 = i % 6
    fps_v = (F.when(i % 97 == 0, 0.0).when(i % 4 == 0, 24.0).when(i % 4 == 1, 30.0)
             .when(i % 4 == 2, 29.97).otherwise(25.0))
    return t("documents").select(
        i.alias("id"),
        (1 + (i * 7919) % 1800).cast("bigint").alias("total_frames"),
        fps_v.alias("video_fps"),
        (240 + (i % 5) * 120).cast("bigint").alias("height"),
        (320 + (i % 4) * 160).cast("bigint").alias("width"),
        F.when(m6 == 0, 3 + i % 9).cast("bigint").alias("nframes"),
        F.when(m6 == 1, 1.0).when(m6 == 4, 0.5).when(i % 11 == 3, 2.0).alias("fps"),
        F.when(m6 == 4, 6).cast("bigint").alias("max_frames"),
        F.when(m6 == 2, 1.5).when(m6 == 3, 100.0).alias("video_start"),
        F.when(m6 == 2, 6.25).when(i % 12 == 5, 3.0).alias("video_end"),
        F.when(i % 8 == 7, 600000).cast("bigint").alias("max_pixels"))


VIDEOS_SQL = """videos AS (
  SELECT doc_id AS id, CAST(1 + (doc_id * 7919) % 1800 AS BIGINT) AS total_frames,
         CASE WHEN doc_id % 97 = 0 THEN 0.0 WHEN doc_id % 4 = 0 THEN 24.0 WHEN doc_id % 4 = 1 THEN 30.0
              WHEN doc_id % 4 = 2 THEN 29.97 ELSE 25.0 END::DOUBLE AS video_fps,
         CAST(240 + (doc_id % 5) * 120 AS BIGINT) AS height, CAST(320 + (doc_id % 4) * 160 AS BIGINT) AS width,
         CASE WHEN doc_id % 6 = 0 THEN CAST(3 + doc_id % 9 AS BIGINT) END AS nframes,
         CASE WHEN doc_id % 6 = 1 THEN 1.0 WHEN doc_id % 6 = 4 THEN 0.5 WHEN doc_id % 11 = 3 THEN 2.0 END::DOUBLE AS fps,
         CASE WHEN doc_id % 6 = 4 THEN CAST(6 AS BIGINT) END AS max_frames,
         CASE WHEN doc_id % 6 = 2 THEN 1.5 WHEN doc_id % 6 = 3 THEN 100.0 END::DOUBLE AS video_start,
         CASE WHEN doc_id % 6 = 2 THEN 6.25 WHEN doc_id % 12 = 5 THEN 3.0 END::DOUBLE AS video_end,
         CASE WHEN doc_id % 8 = 7 THEN CAST(600000 AS BIGINT) END AS max_pixels
  FROM documents)"""

FRAMES_SQL = f""",
rng AS (
  SELECT *, video_start IS NULL AND video_end IS NULL AS none_,
         total_frames / video_fps AS dur FROM videos),
rng2 AS (
  SELECT *,
    CASE WHEN none_ THEN 0 WHEN video_start IS NOT NULL
         THEN CAST(ceil(greatest(0.0, least(video_start, dur)) * video_fps) AS BIGINT) ELSE 0 END AS start_frame,
    CASE WHEN none_ THEN total_frames - 1 WHEN video_end IS NOT NULL
         THEN CAST(least(floor(greatest(0.0, least(video_end, dur)) * video_fps), total_frames - 1) AS BIGINT)
         ELSE total_frames - 1 END AS end_frame
  FROM rng),
rng3 AS (
  SELECT *, end_frame - start_frame + 1 AS range_frames,
    CASE WHEN video_fps <= 0 THEN 'video_fps' WHEN total_frames <= 0 THEN 'total_frames'
         WHEN NOT none_ AND start_frame >= end_frame THEN 'time_range' END AS reject0
  FROM rng2),
cnt AS (
  SELECT *, CASE WHEN nframes IS NOT NULL THEN CAST(round_even(nframes / 2, 0) * 2 AS BIGINT)
    ELSE CAST(floor(least(least(greatest(range_frames / video_fps * coalesce(fps, 2.0),
                                         CAST(ceil(coalesce(min_frames, 4) / 2) * 2 AS BIGINT)),
                                CAST(floor(coalesce(max_frames, least(768, range_frames)) / 2) * 2 AS BIGINT)),
                          range_frames) / 2) * 2 AS BIGINT) END AS n0
  FROM (SELECT *, CAST(NULL AS BIGINT) AS min_frames FROM rng3)),
cnt2 AS (
  SELECT *, coalesce(reject0, CASE WHEN nframes IS NOT NULL AND fps IS NOT NULL THEN 'fps_and_nframes'
                                   WHEN n0 < 2 OR n0 > range_frames THEN 'nframes_range' END) AS reject
  FROM cnt),
cnt3 AS (
  SELECT *, CASE WHEN reject IS NULL THEN n0 END AS n_frames FROM cnt2),
pix AS (
  SELECT *, CASE WHEN n_frames IS NOT NULL THEN
      least(coalesce(CAST(max_pixels AS DOUBLE), lim), lim) END AS max_pixels_frame
  FROM (SELECT *, greatest(least({float(G.VIDEO_MAX_PIXELS)}, {G.VIDEO_TOTAL_PIXELS} / n_frames * 2),
                           CAST(floor({G.VIDEO_MIN_PIXELS} * 1.05) AS DOUBLE)) AS lim FROM cnt3))"""
_V = resize_sql("height", "width", G.IMAGE_FACTOR, G.VIDEO_MIN_PIXELS, "max_pixels_frame")


@query("frame_plan", W(VIDEOS_SQL) + FRAMES_SQL + f""",
planned AS (
  SELECT *, {_V['height']} AS resized_height, {_V['width']} AS resized_width,
         n_frames / greatest(CAST(range_frames AS DOUBLE), 1e-6) * video_fps AS sample_fps,
         unnest(CASE WHEN n_frames IS NOT NULL THEN generate_series(0, n_frames - 1)
                     ELSE [NULL::BIGINT] END) AS k
  FROM pix)
SELECT id, k, CAST(round_even(CASE WHEN k < floor(n_frames / 2)
                                   THEN start_frame + ((end_frame - start_frame) / (n_frames - 1)) * k
                                   ELSE end_frame - ((end_frame - start_frame) / (n_frames - 1)) * (n_frames - 1 - k)
                              END, 0) AS BIGINT) AS frame_index,
       n_frames, round(sample_fps, 6) AS sample_fps, round(max_pixels_frame, 3) AS max_pixels_frame,
       resized_height, resized_width, reject
FROM planned""")
def frame_plan(spark, d):
    p = VO.frame_plan(videos(loader(spark, d)))
    return p.select("id", "k", "frame_index", "n_frames", F.round("sample_fps", 6).alias("sample_fps"),
                    F.round("max_pixels_frame", 3).alias("max_pixels_frame"),
                    "resized_height", "resized_width", "reject")


INTERVAL_SQL = """, iv AS (
  SELECT id, total_frames, video_fps, total_frames / video_fps AS len,
         CAST(least(greatest(round_even(total_frames / video_fps / 2.0, 0), 4.0), 8.0) AS BIGINT) AS n
  FROM videos WHERE video_fps > 0),
ivf AS (
  SELECT id, len, CASE WHEN n = 1 THEN [0::BIGINT] ELSE list_sort(list_distinct(list_transform(
           generate_series(0, n - 1), lambda i: CASE WHEN i = n - 1 THEN total_frames - 1
                                                ELSE CAST(floor(i * ((total_frames - 1) / (n - 1))) AS BIGINT) END)))
         END AS frames
  FROM iv)"""


@query("frame_plan_interval", W(VIDEOS_SQL) + INTERVAL_SQL + """
SELECT id, CAST(k - 1 AS BIGINT) AS k, frames[k] AS frame_index, CAST(len(frames) AS BIGINT) AS n_frames,
       round(2 / (len(frames) / len), 9) AS second_per_grid, NULL AS reject
FROM (SELECT *, generate_subscripts(frames, 1) AS k FROM ivf)
UNION ALL SELECT id, NULL, NULL, 0, NULL, 'no_frame_rate' FROM videos WHERE video_fps <= 0""")
def frame_plan_interval(spark, d):
    x = VO.frames_by_interval(videos(loader(spark, d)))
    e = x.select("id", "n_frames", "second_per_grid", "reject", F.posexplode_outer("frames").alias("k", "frame_index"))
    return e.select("id", F.col("k").cast("bigint"), "frame_index", "n_frames",
                    F.round("second_per_grid", 9).alias("second_per_grid"), "reject")


@query("frame_list_pad", W(VIDEOS_SQL) + INTERVAL_SQL + """,
padded AS (SELECT id, CASE WHEN len(frames) % 2 = 1 THEN list_append(frames, frames[-1]) ELSE frames END AS f
           FROM ivf)
SELECT id, CAST(k - 1 AS BIGINT) AS k, f[k] AS frame_index FROM (SELECT *, generate_subscripts(f, 1) AS k FROM padded)""")
def frame_list_pad(spark, d):
    x = VO.frames_by_interval(videos(loader(spark, d))).withColumn("f", VO.pad_even("frames"))
    e = x.select("id", F.posexplode("f").alias("k", "frame_index"))
    return e.select("id", F.col("k").cast("bigint"), "frame_index")
