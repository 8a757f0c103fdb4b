"""Resize plans, box conversion and visual-token budgets over media tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def resize_plan(df: DataFrame, h: str = "height", w: str = "width") -> DataFrame:
    """One row per image: target size, reject reason, degenerate flag.

    An explicit ``resized_height``/``resized_width`` pair replaces the
    native size (with default budgets); otherwise per-row ``min_pixels``/
    ``max_pixels`` (when present) bound the lenient rule."""
    cols = set(df.columns)
    rh = F.col("resized_height_req") if "resized_height_req" in cols else F.lit(None).cast("bigint")
    rw = F.col("resized_width_req") if "resized_width_req" in cols else F.lit(None).cast("bigint")
    explicit = rh.isNotNull() & rw.isNotNull()
    lo = F.col("min_pixels") if "min_pixels" in cols else F.lit(None).cast("bigint")
    hi = F.col("max_pixels") if "max_pixels" in cols else F.lit(None).cast("bigint")
    hh = F.when(explicit, rh).otherwise(F.col(h))
    ww = F.when(explicit, rw).otherwise(F.col(w))
    lo = F.when(explicit, F.lit(G.MIN_PIXELS)).otherwise(F.coalesce(lo, F.lit(G.MIN_PIXELS)))
    hi = F.when(explicit, F.lit(G.MAX_PIXELS)).otherwise(F.coalesce(hi, F.lit(G.MAX_PIXELS)))
    r = G.resize(hh, ww, G.IMAGE_FACTOR, lo, hi)
    return df.select("*", r["height"].alias("resized_height"), r["width"].alias("resized_width"),
                     r["reject"].alias("reject"), r["degenerate"].alias("degenerate"))


def resize_plan_strict(df: DataFrame, h: str = "height", w: str = "width",
                       min_pixels: int = G.STRICT_MIN_PIXELS, max_pixels: int = G.STRICT_MAX_PIXELS) -> DataFrame:
    r = G.resize(h, w, G.IMAGE_FACTOR, min_pixels, max_pixels, strict=True)
    return df.select("*", r["height"].alias("resized_height"), r["width"].alias("resized_width"),
                     r["reject"].alias("reject"))


BOX = ("x1", "y1", "x2", "y2")


def boxes_relative(df: DataFrame, h: str = "height", w: str = "width") -> DataFrame:
    """Absolute boxes -> 0..1000 relative coordinates."""
    return df.select("*", *[G.box_relative(c, w if c[0] == "x" else h).alias(f"r{c}") for c in BOX])


def boxes_resized(df: DataFrame, h: str = "height", w: str = "width") -> DataFrame:
    """Absolute boxes -> pixel coordinates of the strictly resized image.
    Boxes of a rejected image keep their row with its ``reject`` reason and
    null coordinates."""
    s = resize_plan_strict(df, h, w)
    return s.select("*", *[G.box_scaled(c, w if c[0] == "x" else h,
                                         "resized_width" if c[0] == "x" else "resized_height").alias(f"s{c}")
                           for c in BOX])


def token_budget(plan: DataFrame, by: list[str]) -> DataFrame:
    """Visual tokens per image (t=1, grid = size / patch, // merge^2)
    summed per group; rejected and degenerate images are counted apart."""
    ok = F.col("reject").isNull() & ~F.coalesce(F.col("degenerate"), F.lit(False))
    tok = G.visual_tokens(F.lit(1), F.col("resized_height") / G.PATCH, F.col("resized_width") / G.PATCH)
    return plan.groupBy(*by).agg(
        F.count_if(ok).cast("bigint").alias("n_images"),
        F.count_if(F.col("reject").isNotNull()).cast("bigint").alias("n_rejected"),
        F.count_if(F.col("reject").isNull() & F.col("degenerate")).cast("bigint").alias("n_degenerate"),
        F.coalesce(F.sum(F.when(ok, tok)), F.lit(0)).cast("bigint").alias("total_tokens"))
