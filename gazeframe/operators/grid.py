"""Gaze density over a grid of bins, and its smoothing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame
from gazeframe.operators.runs import fixation_list


def heatmap(gf: GazeFrame, bins: tuple[int, int] = (50, 50), metric: str = "samples", bounds: tuple[float, float, float, float] | None = None, selection=None, eye: str = "auto") -> DataFrame:
    """(xi, yi, value) of every bin. 'samples', 'dwell' (ms), 'count' (fixation centres) or 'proportion' (of those in range)."""
    if metric not in ("samples", "dwell", "count", "proportion"):
        raise ValueError(f"unknown metric {metric!r}")
    gf = gf.select(selection)
    x0, x1, y0, y1 = bounds or (0.0, float(gf.meta.screen_w), 0.0, float(gf.meta.screen_h))
    nx, ny = bins
    if metric == "count" and gf.has("in_fix", "fix_gavx", "fix_gavy", "fix_dur"):
        points = fixation_list(gf, ["recording_id"]).select("x", "y")
    else:
        gx, gy, _ = gf.eye_columns(eye)
        points = gf.df.select(F.col(gx).alias("x"), F.col(gy).alias("y")).dropna()
    xi = F.floor((F.col("x") - x0) * nx / (x1 - x0)).cast("int")
    yi = F.floor((F.col("y") - y0) * ny / (y1 - y0)).cast("int")
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    got = points.where(inside).groupBy(xi.alias("xi"), yi.alias("yi")).agg(F.count(F.lit(1)).alias("n"))
    spark = gf.df.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("xi"), F.floor(F.col("id") / nx).cast("int").alias("yi"))
    full = grid.join(F.broadcast(got), ["xi", "yi"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))  # at most one row a bin
    if metric == "dwell":
        value = F.col("n") / F.lit(float(gf.meta.sample_rate)) * 1000.0
    elif metric == "proportion":
        value = F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))  # bins only
    else:
        value = F.col("n")
    return full.select("xi", "yi", value.alias("value"))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    r = math.ceil(3 * sigma)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def gaussian_smooth(grid: DataFrame, sigma: float, bins: tuple[int, int]) -> DataFrame:
    """Separable Gaussian smoothing with edges repeated; sigma of 0 or less changes nothing.

    Each bin is joined with a kernel table of 2 * ceil(3 sigma) + 1 rows, first along x, then along y.
    """
    if sigma <= 0:
        return grid
    spark = grid.sparkSession
    kernel = F.broadcast(spark.createDataFrame(gaussian_kernel(sigma), "k int, w double"))
    out = grid
    for axis, n in (("xi", bins[0]), ("yi", bins[1])):
        at = F.least(F.greatest(F.col(axis) + F.col("k"), F.lit(0)), F.lit(n - 1))
        other = "yi" if axis == "xi" else "xi"
        taps = out.select("xi", "yi").join(kernel, F.lit(True)).withColumn("_at", at)
        values = out.select(F.col(axis).alias("_at"), F.col(other).alias("_o"), "value")
        out = taps.withColumn("_o", F.col(other)).join(values, ["_at", "_o"]).groupBy("xi", "yi").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return out


def to_matrix(grid: DataFrame, bins: tuple[int, int]) -> np.ndarray:
    """A grid's values as an array [xi, yi]; for drawing."""
    out = np.zeros(bins)
    for r in grid.collect():  # one row a bin
        out[r["xi"], r["yi"]] = r["value"]
    return out
