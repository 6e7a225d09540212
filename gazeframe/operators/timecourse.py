"""Time courses, analysis tables and growth curves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame, ordered, relative_time, time_window
from gazeframe.functions.aoi import AOI, first_match


def _measure(gf: GazeFrame, measure: str, eye: str) -> str:
    if measure not in ("pupil", "gaze_x", "gaze_y"):
        raise ValueError(f"unknown measure {measure!r}: 'pupil', 'gaze_x' or 'gaze_y'")
    gx, gy, pa = gf.eye_columns(eye, pupil=measure == "pupil")
    return {"pupil": pa, "gaze_x": gx, "gaze_y": gy}[measure]


def bin_centre(t: Column, bin_ms: float) -> Column:
    b = F.lit(float(bin_ms))
    return F.floor(t / b) * b + b / 2.0


def _windowed(df: DataFrame, keys, window) -> DataFrame:
    tw = time_window(window, keys)
    d = df.withColumn("_t", relative_time(df, keys))
    if tw:
        d = d.withColumns({"_s": tw[0], "_e": tw[1]}).where(F.col("_t").between(F.col("_s"), F.col("_e"))).drop("_s", "_e")
    return d.where(F.col("_t").isNotNull())


def time_bin(gf: GazeFrame, bin_ms: float = 50, measure: str = "pupil", selection=None, eye: str = "auto", group_by=None, window: tuple | None = None) -> DataFrame:
    """The mean of a measure in time bins, named by their centres; bins without valid values have none."""
    gf = gf.select(selection)
    c = _measure(gf, measure, eye)
    df, keys = gf.valid_groups(group_by)
    d = _windowed(df, keys, window).where(F.col(c).isNotNull())
    return d.groupBy(*keys, bin_centre(F.col("_t"), bin_ms).alias("time_bin")).agg(F.avg(c).alias("value"), F.count(c).alias("n"))


def proportion_of_looks(gf: GazeFrame, aois: Sequence[AOI], bin_ms: float = 50, selection=None, eye: str = "auto", group_by=None, window: tuple | None = None) -> DataFrame:
    """In each time bin, the share of valid samples in each area (the first that contains one) and outside all."""
    gf = gf.select(selection)
    gx, gy, _ = gf.eye_columns(eye)
    df, keys = gf.valid_groups(group_by)
    d = _windowed(df, keys, window).where(F.col(gx).isNotNull() & F.col(gy).isNotNull()).withColumn("_area", first_match(aois, F.col(gx), F.col(gy)))
    share = lambda k: F.avg((F.col("_area") == k).cast("double"))
    return d.groupBy(*keys, bin_centre(F.col("_t"), bin_ms).alias("time_bin")).agg(*(share(k + 1).alias(a.name) for k, a in enumerate(aois)), share(0).alias("outside"))


def prepare_analysis_data(gf: GazeFrame, measures: Sequence[str] = ("pupil",), selection=None, eye: str = "auto", group_by=None, window: tuple | None = None) -> DataFrame:
    """A long table: keys, time, number within the group, measures, event flags; rows that miss a measure go."""
    gf = gf.select(selection)
    cols = {m: _measure(gf, m, eye) for m in measures}
    df, keys = gf.valid_groups(group_by)
    d = _windowed(df, keys, window).withColumn("sample", F.row_number().over(ordered(keys)))
    flags = [c for c in ("in_fix", "in_sacc", "in_blink") if gf.has(c)]
    return d.select(*keys, F.col("_t").alias("time"), "sample", *(F.col(c).alias(m) for m, c in cols.items()), *flags).dropna(subset=list(cols))


def orthogonal_polynomials(times: np.ndarray, degree: int) -> np.ndarray:
    """Orthonormal polynomials of sorted distinct times scaled to [-1, 1], without the constant."""
    n = len(times)
    degree = min(degree, n - 1)
    if degree < 1:
        return np.zeros((n, 0))
    span = times[-1] - times[0]
    x = 2 * (times - times[0]) / span - 1
    basis = [np.full(n, n**-0.5)]
    for k in range(1, degree + 1):
        v = x**k
        for _ in range(2):  # once more against rounding
            for b in basis:
                v = v - (v @ b) * b
        basis.append(v / np.sqrt(v @ v))
    return np.stack(basis[1:], 1)


def growth_curve_data(df: DataFrame, time_col: str = "time_bin", degree: int = 3, most_times: int = 1_000_000) -> DataFrame:
    """Adds ot1, ot2, ... of each row's time. The distinct times (bins, few) are brought to the driver, in a number
    that is checked, and joined back."""
    times = df.select(F.col(time_col).cast("double").alias("t")).dropna().distinct()
    got = sorted(r[0] for r in times.limit(most_times + 1).collect())
    if len(got) > most_times:
        raise ValueError(f"more than {most_times} distinct times: bin them first")
    values = orthogonal_polynomials(np.array(got), degree)
    names = [f"ot{k + 1}" for k in range(values.shape[1])]
    if not names:
        return df
    table = df.sparkSession.createDataFrame([(t, *map(float, v)) for t, v in zip(got, values, strict=True)], "_t double, " + ", ".join(f"{n} double" for n in names))
    return df.join(table, F.col(time_col).cast("double") == F.col("_t"), "left").drop("_t")
