"""Cleaning of gaze and pupil signals. Every operator returns a new frame; those that count return (frame, counts)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.frame import RECORDING, GazeFrame, ordered, relative_time, within
from gazeframe.functions.numeric import hermite, ms_to_samples
from gazeframe.operators.detect import velocity
from gazeframe.operators.runs import with_runs


def _keyed(keys) -> Column:
    """Rows that have all keys; others stay as they are."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def velocity_filter(gf: GazeFrame, threshold_deg_s: float = 1000.0, eye: str = "auto") -> tuple[GazeFrame, DataFrame]:
    """Gaze that moves faster than the threshold becomes missing; the count is of such rows."""
    gx, gy, _ = gf.eye_columns(eye)
    d = gf.df.withColumn("_fast", F.coalesce(velocity(gx, gy, gf.meta.ppd, gf.meta.sample_rate) > float(threshold_deg_s), F.lit(False)))
    n = d.groupBy("recording_id").agg(F.sum(F.col("_fast").cast("long")).alias("removed"))
    return gf.with_df(d.withColumns({c: F.when(~F.col("_fast"), F.col(c)) for c in (gx, gy)}).drop("_fast")), n


def outlier_filter(gf: GazeFrame, bounds: tuple[float, float, float, float] | None = None, margin: float = 50.0, eye: str = "auto") -> tuple[GazeFrame, DataFrame]:
    """Gaze outside the screen, or (x0, x1, y0, y1), by more than the margin becomes missing."""
    gx, gy, _ = gf.eye_columns(eye)
    x0, x1, y0, y1 = bounds or (0, gf.meta.screen_w, 0, gf.meta.screen_h)
    x, y = F.col(gx), F.col(gy)
    far = x.isNotNull() & ((x < x0 - margin) | (x > x1 + margin) | F.coalesce((y < y0 - margin) | (y > y1 + margin), F.lit(False)))
    d = gf.df.withColumn("_far", F.coalesce(far, F.lit(False)))
    n = d.groupBy("recording_id").agg(F.sum(F.col("_far").cast("long")).alias("removed"))
    return gf.with_df(d.withColumns({c: F.when(~F.col("_far"), F.col(c)) for c in (gx, gy)}).drop("_far")), n


def _filled(d: DataFrame, c: str, longest: int, keys) -> DataFrame:
    """Linear interpolation of inner gaps of at most ``longest`` rows of one column; adds ``_gap_<c>`` on filled rows."""
    d = with_runs(d.withColumn("_m", F.col(c).isNull()), F.col("_m"), keys, "_run")
    w = ordered(keys)
    own = Window.partitionBy(*keys, "_run")
    d = d.withColumn("_p", F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_q", F.first(c, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    d = d.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_j", F.row_number().over(own.orderBy("sample_idx")))
    fill = F.col("_m") & (F.col("_n") <= longest) & F.col("_p").isNotNull() & F.col("_q").isNotNull()
    value = F.col("_p") + F.col("_j") / (F.col("_n") + 1) * (F.col("_q") - F.col("_p"))
    return d.withColumn(f"_gap_{c}", fill).withColumn(c, F.when(fill, value).otherwise(F.col(c))).drop("_m", "_run", "_p", "_q", "_n", "_j")


def interpolate_gaps(gf: GazeFrame, max_gap_ms: float = 75.0, eye: str = "auto") -> tuple[GazeFrame, DataFrame]:
    """Fills short gaps of x and of y, each by itself; the counts are of gaps and rows of x."""
    gx, gy, _ = gf.eye_columns(eye)
    longest = round(max_gap_ms * gf.meta.sample_rate / 1000.0)
    d = _filled(_filled(gf.df, gx, longest, RECORDING), gy, longest, RECORDING)
    first = F.col(f"_gap_{gx}") & ~F.coalesce(F.lag(f"_gap_{gx}").over(ordered(RECORDING)), F.lit(False))
    n = d.withColumn("_first", first).groupBy("recording_id").agg(F.sum(F.col("_first").cast("long")).alias("gaps"), F.sum(F.col(f"_gap_{gx}").cast("long")).alias("filled"))
    return gf.with_df(d.drop(f"_gap_{gx}", f"_gap_{gy}")), n


def interpolate_blinks(gf: GazeFrame, margin_ms: float = 50, method: str = "linear", eye: str = "auto") -> GazeFrame:
    """Bridges the pupil over blinks with margins, linearly or by a cubic with the slopes outside."""
    if method not in ("linear", "cubic"):
        raise ValueError(f"unknown method {method!r}: 'linear' or 'cubic'")
    if not gf.has("in_blink"):
        raise ValueError("no in_blink column to interpolate by")
    pa = gf.eye_columns(eye, pupil=True)[2]
    margin = ms_to_samples(margin_ms, gf.meta.sample_rate)
    if method == "cubic":
        return gf.with_df(_cubic(gf.df, pa, margin))
    w = ordered(RECORDING)
    wide = F.max(F.coalesce(F.col("in_blink"), F.lit(False))).over(w.rowsBetween(-margin, margin))
    d = with_runs(gf.df.withColumn("_in", wide).withColumn("_pre", F.lag(pa).over(w)).withColumn("_post", F.lead(pa).over(w)), F.col("_in"), RECORDING, "_run")
    own = Window.partitionBy("recording_id", "_run")
    span, k = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("sample_idx")) - 1
    d = d.withColumn("_a", F.min_by(F.struct("_pre"), "sample_idx").over(own).getField("_pre")).withColumn("_b", F.max_by(F.struct("_post"), "sample_idx").over(own).getField("_post"))
    d = d.withColumn("_t", k / F.greatest(span - 1, F.lit(1)))
    value = F.coalesce(F.col("_a") + F.col("_t") * (F.col("_b") - F.col("_a")), F.col("_a"), F.col("_b"), F.col(pa))
    return gf.with_df(d.withColumn(pa, F.when(F.col("_in"), value).otherwise(F.col(pa))).drop("_in", "_pre", "_post", "_run", "_a", "_b", "_t"))


def cubic_bridge(pa: np.ndarray, blink: np.ndarray, margin: int) -> np.ndarray:
    """W16's cubic on one recording. Rows within the margin of a blink form runs; a run is bridged between the rows beside it, with the
    slopes to the nearest valid rows beyond them. On the left, rows that an earlier run filled count as valid."""
    n, at = len(pa), np.arange(len(pa))
    upto = np.concatenate([[0], np.cumsum(blink)])
    wide = upto[np.minimum(at + margin + 1, n)] > upto[np.maximum(at - margin, 0)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], wide.astype(np.int8), [0]])))
    first, after = edges[::2], edges[1::2]
    beside = np.concatenate([[np.nan], pa, [np.nan]])
    left, right = beside[first], beside[after + 1]
    valid = ~np.isnan(pa)
    filled = valid.copy()
    filled[wide] |= np.repeat(~(np.isnan(left) & np.isnan(right)), after - first)
    back = np.maximum.accumulate(np.where(filled, at, -1))
    ahead = np.minimum.accumulate(np.where(valid, at, n)[::-1])[::-1]
    out = pa.astype(float).copy()
    for lo, hi, a, b in zip(first.tolist(), after.tolist(), left.tolist(), right.tolist(), strict=True):
        size = hi - lo
        if not (np.isnan(a) or np.isnan(b)):
            k, j = back[lo - 2] if lo > 1 else -1, ahead[hi + 1] if hi + 1 < n else n
            m0 = size * (a - out[k]) / (lo - 1 - k) if k >= 0 else 0.0
            m1 = size * (out[j] - b) / (j - hi) if j < n else 0.0
            out[lo:hi] = hermite(np.arange(size) / max(size - 1, 1), a, b, m0, m1)
        elif not (np.isnan(a) and np.isnan(b)):
            out[lo:hi] = b if np.isnan(a) else a
    return out


def _cubic(df: DataFrame, pa: str, margin: int) -> DataFrame:
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_idx", kind="stable")
        value = cubic_bridge(pdf["_pa"].to_numpy(float), pdf["_bl"].fillna(False).to_numpy(bool), margin)
        return pd.DataFrame({"recording_id": pdf["recording_id"], "sample_idx": pdf["sample_idx"], "_new": pd.Series(value, index=pdf.index).astype(float).where(~np.isnan(value), None)})

    got = df.select("recording_id", "sample_idx", F.col(pa).alias("_pa"), F.col("in_blink").alias("_bl")).groupBy("recording_id").applyInPandas(fill, "recording_id string, sample_idx long, _new double")
    return df.join(got, ["recording_id", "sample_idx"]).withColumn(pa, F.when(~F.isnan("_new"), F.col("_new"))).drop("_new")


def smooth_pupil(gf: GazeFrame, window_ms: float = 50, eye: str = "auto") -> GazeFrame:
    """The mean of valid pupil over a centred window; missing rows with valid neighbours get one."""
    pa = gf.eye_columns(eye, pupil=True)[2]
    h = max(1, round(window_ms * gf.meta.sample_rate / 1000.0) // 2)
    return gf.with_df(gf.df.withColumn(pa, F.avg(pa).over(ordered(RECORDING).rowsBetween(-h, h))))


def baseline_correct_pupil(gf: GazeFrame, window: tuple[float, float] = (-200.0, 0.0), method: str = "subtractive", eye: str = "auto", group_by=None) -> GazeFrame:
    """Subtracts, or takes in per cent or standard deviations of, the group's pupil within a window of ``time_rel``."""
    if method not in ("subtractive", "percent", "zscore"):
        raise ValueError(f"unknown method {method!r}: 'subtractive', 'percent' or 'zscore'")
    if not gf.has("time_rel"):
        raise ValueError("no time_rel column: give the message that starts a trial's clock")
    pa, keys = gf.eye_columns(eye, pupil=True)[2], gf.groups(group_by)
    g = within(keys)
    base = F.when(F.col("time_rel").between(float(window[0]), float(window[1])), F.col(pa))
    d = gf.df.withColumn("_n", F.count(base).over(g)).withColumn("_mean", F.avg(base).over(g))
    if method == "subtractive":
        value, go = F.col(pa) - F.col("_mean"), F.lit(True)
    elif method == "percent":
        value, go = (F.col(pa) - F.col("_mean")) / F.when(F.col("_mean") != 0, F.col("_mean")) * 100.0, F.col("_mean") != 0
    else:
        d = d.withColumn("_sd", F.stddev_samp(base).over(g))
        value, go = (F.col(pa) - F.col("_mean")) / F.when(F.col("_sd") != 0, F.col("_sd")), F.coalesce(F.col("_sd") != 0, F.lit(True))
    return gf.with_df(d.withColumn(pa, F.when(_keyed(keys) & (F.col("_n") > 0) & go, value).otherwise(F.col(pa))).drop("_n", "_mean", "_sd"))


def drift_correct(gf: GazeFrame, target: tuple[float, float] = (640, 480), use_first_fixation: bool = True, window_ms: float = 200, eye: str = "auto", group_by=None) -> GazeFrame:
    """Shifts each group's gaze so that its first fixation, or the mean of its first rows, falls on the target."""
    gx, gy, _ = gf.eye_columns(eye)
    keys = gf.groups(group_by)
    g, w = within(keys), ordered(keys)
    d = gf.df
    if use_first_fixation and gf.has("in_fix", "fix_gavx", "fix_gavy"):
        at = F.when(F.col("in_fix") & F.col("fix_gavx").isNotNull() & F.col("fix_gavy").isNotNull(), F.col("sample_idx"))
        d = d.withColumn("_x", F.min_by("fix_gavx", at).over(g)).withColumn("_y", F.min_by("fix_gavy", at).over(g))
    else:
        n = round(window_ms / 1000.0 * gf.meta.sample_rate)
        ok = (F.col("_k") <= n) & F.col(gx).isNotNull() & F.col(gy).isNotNull()
        d = d.withColumn("_k", F.row_number().over(w)).withColumn("_x", F.avg(F.when(ok, F.col(gx))).over(g)).withColumn("_y", F.avg(F.when(ok, F.col(gy))).over(g)).drop("_k")
    shift = lambda c, o, t: F.when(_keyed(keys), F.col(c) - F.coalesce(F.col(o) - float(t), F.lit(0.0))).otherwise(F.col(c))
    return gf.with_df(d.withColumn(gx, shift(gx, "_x", target[0])).withColumn(gy, shift(gy, "_y", target[1])).drop("_x", "_y"))


def to_center_coords(gf: GazeFrame) -> GazeFrame:
    """Degrees from the screen's centre, of gaze, fixation centres and saccade ends; amplitudes stay."""
    ppd, cx, cy = gf.meta.ppd, gf.meta.screen_w / 2, gf.meta.screen_h / 2
    cols = {c: (F.col(c) - cx) / ppd for c in ("gxL", "gxR", "fix_gavx", "sacc_gstx", "sacc_genx") if gf.has(c)} | {c: (F.col(c) - cy) / ppd for c in ("gyL", "gyR", "fix_gavy", "sacc_gsty", "sacc_geny") if gf.has(c)}
    return gf.with_df(gf.df.withColumns(cols))


def with_time_rel(gf: GazeFrame, trial_time_zero: str, group_by=None) -> GazeFrame:
    """Time since the group's first row one of whose messages is ``trial_time_zero``; NULL in groups without one."""
    keys = gf.groups(group_by)
    at = F.when(_keyed(keys) & F.array_contains(F.split("message", "; "), trial_time_zero), F.col("sample_idx"))
    zero = F.min_by("time", at).over(within(keys))
    return gf.with_df(gf.df.withColumn("time_rel", F.col("time").cast("double") - zero.cast("double")))


def monotone_time(gf: GazeFrame, group_by=None) -> GazeFrame:
    """The group's relative time, or the time since its first row where ``time_rel`` runs back anywhere."""
    keys = gf.groups(group_by)
    w, g = ordered(keys), within(keys)
    since = F.col("time").cast("double") - F.first("time").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")
    if not gf.has("time_rel"):
        return gf.with_df(gf.df.withColumn("plot_time", since))
    d = gf.df.withColumn("_back", F.coalesce(F.col("time_rel") < F.lag("time_rel").over(w), F.lit(False)))
    d = d.withColumn("plot_time", F.when(F.bool_or("_back").over(g), since).otherwise(relative_time(d, keys)))
    return gf.with_df(d.drop("_back"))
