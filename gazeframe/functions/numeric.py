"""Scalar helpers: nulls for not-a-number, half-even rounding, screen geometry, Hermite basis, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Inside the engine a missing measurement is NULL: NaN in any float column becomes NULL, floats become doubles."""
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.col(f"`{f.name}`").cast("double")
            cols[f.name] = F.when(~F.isnan(c), c)
    return df.withColumns(cols) if cols else df


def rj(x: Column, digits: int = 0) -> Column:
    """Rounds half to even at ``digits`` decimals: scale, round, unscale."""
    return F.rint(x * float(10**digits)) / float(10**digits) if digits else F.rint(x)


def ms_to_samples(ms: float, rate: float, least: int = 1) -> int:
    """Whole samples in ``ms`` at ``rate`` Hz, half to even."""
    return max(least, round(ms * rate / 1000.0))


def pixels_per_degree(screen_w: float, width_cm: float, distance_cm: float) -> float:
    """Pixels of a degree of visual angle: the screen's width over the angle that it fills."""
    return screen_w / (2.0 * math.degrees(math.atan(width_cm / 2.0 / distance_cm)))


def px_to_deg(px: Column, ppd: float) -> Column:
    return px / F.lit(float(ppd))


def deg_to_px(deg: Column, ppd: float) -> Column:
    return deg * F.lit(float(ppd))


def hermite(t: Column, p0: Column, p1: Column, m0: Column, m1: Column) -> Column:
    """Cubic Hermite interpolation between p0 and p1 with tangents m0 and m1."""
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * p0 + (t3 - 2 * t2 + t) * m0 + (-2 * t3 + 3 * t2) * p1 + (t3 - t2) * m1


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment; of a segment without length, from its start."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, length2), F.lit(0.0))))
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))
