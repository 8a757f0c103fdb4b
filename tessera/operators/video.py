"""Video frame plans as Column expressions over a video-metadata table.

Input columns (nullable options): total_frames, video_fps, height, width,
nframes, fps, min_frames, max_frames, video_start, video_end, min_pixels,
max_pixels, total_pixels.  One output row per selected frame; a rejected
video keeps one row with its reason and no frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def _opt(df: DataFrame, name: str, typ: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(typ)


def frame_range(df: DataFrame) -> DataFrame:
    """Start/end frame and frame count from optional start/end seconds."""
    total, vfps = F.col("total_frames"), F.col("video_fps")
    vs, ve = _opt(df, "video_start", "double"), _opt(df, "video_end", "double")
    dur = F.try_divide(total, vfps)  # fps <= 0 is rejected below
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(x, dur))
    start = F.when(vs.isNotNull(), F.ceil(clamp(vs) * vfps)).otherwise(F.lit(0)).cast("bigint")
    end = F.when(ve.isNotNull(), F.least(F.floor(clamp(ve) * vfps), total - 1)).otherwise(total - 1).cast("bigint")
    none = vs.isNull() & ve.isNull()
    reject = (F.when(vfps <= 0, "video_fps").when(total <= 0, "total_frames")
              .when(~none & (start >= end), "time_range"))
    return (df.withColumn("start_frame", F.when(none, F.lit(0).cast("bigint")).otherwise(start))
            .withColumn("end_frame", F.when(none, total - 1).otherwise(end))
            .withColumn("range_frames", F.col("end_frame") - F.col("start_frame") + 1)
            .withColumn("reject", reject))


def frame_count(df: DataFrame) -> DataFrame:
    """Frames to sample: by ``nframes`` or by ``fps`` within
    [min_frames, max_frames], even, at most the range; out of range
    rejected."""
    total, vfps = F.col("range_frames"), F.col("video_fps")
    nfr, fps = _opt(df, "nframes", "bigint"), _opt(df, "fps", "double")
    minf, maxf = _opt(df, "min_frames", "bigint"), _opt(df, "max_frames", "bigint")
    by_n = G.round_by_factor(nfr, G.FRAME_FACTOR)
    lo = G.ceil_by_factor(F.coalesce(minf, F.lit(G.FPS_MIN_FRAMES)), G.FRAME_FACTOR)
    hi = G.floor_by_factor(F.coalesce(maxf, F.least(F.lit(G.FPS_MAX_FRAMES).cast("bigint"), total)), G.FRAME_FACTOR)
    raw = F.try_divide(total, vfps) * F.coalesce(fps, F.lit(G.FPS))
    by_fps = G.floor_by_factor(F.least(F.least(F.greatest(raw, lo), hi), total), G.FRAME_FACTOR)
    n = F.when(nfr.isNotNull(), by_n).otherwise(by_fps)
    reject = F.coalesce(F.col("reject"), F.when(nfr.isNotNull() & fps.isNotNull(), "fps_and_nframes")
                        .when((n < G.FRAME_FACTOR) | (n > total), "nframes_range"))
    return df.withColumn("n_frames", F.when(reject.isNull(), n)).withColumn("reject", reject)


def pixel_budget(df: DataFrame) -> DataFrame:
    """Per-frame pixel limit and the resized frame size."""
    n = F.col("n_frames")
    min_px = F.coalesce(_opt(df, "min_pixels", "bigint"), F.lit(G.VIDEO_MIN_PIXELS).cast("bigint"))
    tot = F.coalesce(_opt(df, "total_pixels", "bigint"), F.lit(G.VIDEO_TOTAL_PIXELS).cast("bigint"))
    lim = F.greatest(F.least(F.lit(float(G.VIDEO_MAX_PIXELS)), tot / n * G.FRAME_FACTOR),
                     F.floor(min_px * 1.05).cast("double"))
    maxp = F.least(F.coalesce(_opt(df, "max_pixels", "bigint").cast("double"), lim), lim)
    r = G.resize("height", "width", G.IMAGE_FACTOR, min_px, F.col("max_pixels_frame"))
    return (df.withColumn("max_pixels_frame", F.when(n.isNotNull(), maxp))
            .withColumn("resized_height", r["height"]).withColumn("resized_width", r["width"]))


def frame_plan(df: DataFrame) -> DataFrame:
    """G8-G11, G13: one row per selected frame (rounded linspace over the
    range, symmetric from both ends), with the sample fps and the resized
    frame size."""
    x = pixel_budget(frame_count(frame_range(df)))
    n, s, e = F.col("n_frames"), F.col("start_frame"), F.col("end_frame")
    step = (e - s) / (n - 1)
    k = F.explode(F.when(n.isNotNull(), F.sequence(F.lit(0).cast("bigint"), n - 1))
                  .otherwise(F.array(F.lit(None).cast("bigint")))).alias("k")
    x = x.withColumn("sample_fps", n / F.greatest(F.col("range_frames").cast("double"), F.lit(1e-6)) * F.col("video_fps"))
    x = x.select("*", k)
    kk = F.col("k")
    idx = F.when(kk < F.floor(n / 2), s + step * kk).otherwise(e - step * (n - 1 - kk))
    return x.withColumn("frame_index", F.rint(idx).cast("bigint"))


def frames_by_interval(df: DataFrame, interval: float = 2.0, min_frames: int = 4, max_frames: int = 8) -> DataFrame:
    """G12: round(length / interval) clamped to [min, max]; indices
    floor(i * (total-1)/(n-1)) with the last forced to total-1, distinct;
    seconds per temporal grid = temporal_patch / (count / length).  A video
    without a positive rate keeps its row, with a ``reject`` reason and no
    frames."""
    total, vfps = F.col("total_frames"), F.col("video_fps")
    length = F.try_divide(total, vfps)
    n = F.least(F.greatest(F.rint(length / interval), F.lit(float(min_frames))), F.lit(float(max_frames))).cast("bigint")
    step = (total - 1) / (n - 1)
    idx = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1),
                      lambda i: F.when(i == n - 1, total - 1).otherwise(F.floor(i * step)).cast("bigint"))
    frames = F.when(n == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_sort(F.array_distinct(idx)))
    ok = F.coalesce(vfps > 0, F.lit(False))
    x = df.withColumns({"reject": F.when(~ok, F.lit("no_frame_rate")), "frames": F.when(ok, frames)})
    fps_s = F.size("frames") / length
    return x.withColumn("n_frames", F.when(ok, F.size("frames")).otherwise(0).cast("bigint")).withColumn(
        "second_per_grid", F.when(ok, F.try_divide(F.lit(float(G.TEMPORAL_PATCH)), fps_s)))


def pad_even(frames) -> Column:
    """Repeat the last frame until the list length is even."""
    f = F.col(frames) if isinstance(frames, str) else frames
    need = G.ceil_by_factor(F.size(f), G.FRAME_FACTOR) - F.size(f)
    return F.concat(f, F.array_repeat(F.element_at(f, -1), need.cast("int")))
