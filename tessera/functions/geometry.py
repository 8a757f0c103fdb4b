"""Resize, box and frame arithmetic as Column expressions (no UDFs).

Rounding follows Python's ``round``: half to even (``rint``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: vision budgets (must equal the reference's) ------------
IMAGE_FACTOR = 28
MIN_PIXELS = 4 * 28 * 28
MAX_PIXELS = 16384 * 28 * 28
MAX_RATIO = 200
STRICT_MIN_PIXELS = 56 * 56
STRICT_MAX_PIXELS = 14 * 14 * 4 * 1280
VIDEO_MIN_PIXELS = 128 * 28 * 28
VIDEO_MAX_PIXELS = 768 * 28 * 28
VIDEO_TOTAL_PIXELS = int(128000 * 28 * 28 * 0.9)
FRAME_FACTOR = 2
FPS = 2.0
FPS_MIN_FRAMES = 4
FPS_MAX_FRAMES = 768
PATCH = 14
MERGE = 2
TEMPORAL_PATCH = 2


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def round_by_factor(x, f) -> Column:
    return (F.rint(_c(x) / _c(f)) * _c(f)).cast("bigint")


def ceil_by_factor(x, f) -> Column:
    return (F.ceil(_c(x) / _c(f)) * _c(f)).cast("bigint")


def floor_by_factor(x, f) -> Column:
    return (F.floor(_c(x) / _c(f)) * _c(f)).cast("bigint")


def resize(h, w, factor=IMAGE_FACTOR, min_pixels=MIN_PIXELS, max_pixels=MAX_PIXELS,
           strict: bool = False) -> dict[str, Column]:
    """Target (height, width): multiples of ``factor``, pixel count within
    [min, max], aspect kept.  Returns ``height``, ``width`` (null when
    rejected), ``reject`` reason and ``degenerate`` (a zero side, which
    the lenient rule can produce because it does not re-clamp).

    lenient: H = max(f, round(h/f)*f); strict: rejects a side < f and
    does not clamp H below by f.
    """
    h, w, f = _c(h), _c(w), _c(factor)
    lo, hi = _c(min_pixels), _c(max_pixels)
    ratio = F.try_divide(F.greatest(h, w).cast("double"), F.least(h, w).cast("double"))
    if strict:
        hb0, wb0 = round_by_factor(h, f), round_by_factor(w, f)
        reject = (F.when((h < f) | (w < f), F.lit("side_below_factor"))
                  .when(ratio.isNull() | (ratio > MAX_RATIO), F.lit("aspect_ratio")))
    else:
        hb0, wb0 = F.greatest(f.cast("bigint"), round_by_factor(h, f)), F.greatest(f.cast("bigint"), round_by_factor(w, f))
        reject = F.when(ratio.isNull() | (ratio > MAX_RATIO), F.lit("aspect_ratio"))
    area = hb0 * wb0
    b_hi = F.sqrt((h * w) / hi)
    b_lo = F.sqrt(lo / (h * w))
    H = (F.when(area > hi, floor_by_factor(h / b_hi, f))
         .when(area < lo, ceil_by_factor(h * b_lo, f)).otherwise(hb0))
    Wd = (F.when(area > hi, floor_by_factor(w / b_hi, f))
          .when(area < lo, ceil_by_factor(w * b_lo, f)).otherwise(wb0))
    ok = reject.isNull()
    H, Wd = F.when(ok, H), F.when(ok, Wd)
    return {"height": H, "width": Wd, "reject": reject, "degenerate": ok & ((H == 0) | (Wd == 0))}


def box_relative(v, size) -> Column:
    """round(v / size * 1000) clamped to [0, 1000]."""
    return F.least(F.greatest(F.rint(_c(v) / _c(size) * 1000), F.lit(0.0)), F.lit(1000.0)).cast("bigint")


def box_scaled(v, orig, new) -> Column:
    """round(v * new/orig) clamped to [0, new - 1]."""
    scale = _c(new) / _c(orig)
    return F.least(F.greatest(F.rint(_c(v) * scale), F.lit(0.0)), (_c(new) - 1).cast("double")).cast("bigint")


def visual_tokens(t, h, w, merge: int = MERGE) -> Column:
    """t*h*w // merge^2 (grid in patches)."""
    return F.floor((_c(t) * _c(h) * _c(w)) / F.lit(merge * merge)).cast("bigint")
