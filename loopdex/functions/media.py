"""Media sampling plans as native column expressions (C17-C20, K4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopdex import config as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def frame_plan(n_frames, k: int = C.FRAMES_PER_ITEM) -> Column:
    """C17: n<=k -> 0..n-1, else round-half-even(i*(n-1)/(k-1)) for i in 0..k-1."""
    n = _c(n_frames)
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                         lambda i: F.bround(i.cast("double") * (n - 1).cast("double") / F.lit(float(k - 1)), 0).cast("int"))
    few = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n <= k, few).otherwise(spread)


def resize_plan(w, h, max_side: int = C.MAX_FRAME_SIDE) -> Column:
    """STRUCT<w, h>: scaled by max_side/max(w,h) (half-even) when larger, else unchanged."""
    w, h = _c(w), _c(h)
    m = F.greatest(w, h)
    scale = F.lit(float(max_side)) / m.cast("double")
    big = m > max_side
    return F.struct(
        F.when(big, F.bround(w.cast("double") * scale, 0).cast("int")).otherwise(w).alias("w"),
        F.when(big, F.bround(h.cast("double") * scale, 0).cast("int")).otherwise(h).alias("h"),
    )


def video_duration(duration, nb_frames, rate_num, rate_den) -> Column:
    """Duration; if 0 -> nb_frames*den/num when both > 0; if still <= 0 -> 1.0."""
    d = F.coalesce(_c(duration).cast("double"), F.lit(0.0))
    nb, num, den = _c(nb_frames), _c(rate_num), _c(rate_den)
    derived = F.when((nb > 0) & (num > 0), nb.cast("double") * den.cast("double") / num.cast("double")).otherwise(F.lit(0.0))
    d1 = F.when(d == 0, derived).otherwise(d)
    return F.when(d1 <= 0, F.lit(1.0)).otherwise(d1)


def video_plan(duration, nb_frames, rate_num, rate_den, k: int = C.FRAMES_PER_ITEM) -> Column:
    """Timestamps i*d/(k-1), last clamped to max(0, d-0.01); k=1 -> [0]; printed %.3f."""
    d = video_duration(duration, nb_frames, rate_num, rate_den)
    if k == 1:
        ts = F.array(F.lit(0.0))
    else:
        ts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                         lambda i: F.when(i == k - 1, F.greatest(F.lit(0.0), d - F.lit(0.01)))
                         .otherwise(i.cast("double") * d / F.lit(float(k - 1))))
    # half-even on the binary value first, as Python/C formatting does (Java's %.3f rounds half-up)
    return F.transform(ts, lambda t: F.format_string("%.3f", F.bround(t, 3)))


def sampler_for(fmt) -> Column:
    """C20: 'video' for mp4/webm, otherwise 'frames' (missing format = gif)."""
    f = F.coalesce(_c(fmt), F.lit(C.DEFAULT_MEDIA_FORMAT))
    return F.when(f.isin(*C.VIDEO_FORMATS), F.lit("video")).otherwise(F.lit("frames"))
