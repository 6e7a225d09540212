"""Event detection: velocity, velocity-threshold and dispersion-threshold labels, blinks, microsaccades.

Whole-recording operators use windows over (recording, sample_idx); one recording is one task, many recordings are many.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.frame import RECORDING, GazeFrame, ordered, within
from gazeframe.functions.numeric import ms_to_samples
from gazeframe.operators.runs import with_runs


def five_point(c: str, keys) -> Column:
    """The 5-point difference of a column; NULL where a neighbour is."""
    w = ordered(keys)
    return (F.lead(c, 2).over(w) + F.lead(c, 1).over(w) - F.lag(c, 1).over(w) - F.lag(c, 2).over(w)) / 6.0


def velocity(gx: str, gy: str, ppd: float, rate: float, keys=RECORDING) -> Column:
    """Gaze velocity in degrees a second."""
    dx, dy = five_point(gx, keys), five_point(gy, keys)
    return F.sqrt(dx * dx + dy * dy) / F.lit(float(ppd)) * F.lit(float(rate))


def ivt_labels(df: DataFrame, vel: str, threshold: float, min_fix: int, min_sacc: int, keys=RECORDING, out: str = "label") -> DataFrame:
    """W07: 'fixation', 'saccade' or 'noise' of each row, from velocities, by two passes over runs."""
    raw = F.when(F.col(vel).isNull(), "noise").when(F.col(vel) < float(threshold), "fixation").otherwise("saccade")
    d = with_runs(df.withColumn("_raw", raw), F.col("_raw"), keys, "_r1")
    # The labels before and after a run are those next to its first and last row.
    own = Window.partitionBy(*keys, "_r1")
    w = ordered(keys)
    d = d.withColumn("_b", F.lag("_raw").over(w)).withColumn("_a", F.lead("_raw").over(w))
    n = F.count(F.lit(1)).over(own)
    before, after = F.min_by("_b", "sample_idx").over(own), F.max_by("_a", "sample_idx").over(own)
    short = (F.col("_raw") == "saccade") & (F.col("_n") < min_sacc) & (F.col("_before") == "fixation") & (F.col("_after") == "fixation")
    d = d.withColumn("_n", n).withColumn("_before", before).withColumn("_after", after)
    d = d.withColumn("_merged", F.when(F.coalesce(short, F.lit(False)), "fixation").otherwise(F.col("_raw")))
    d = with_runs(d, F.col("_merged"), keys, "_r2").withColumn("_n2", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_r2")))
    label = F.when((F.col("_merged") == "fixation") & (F.col("_n2") < min_fix), "noise").otherwise(F.col("_merged"))
    return d.withColumn(out, label).drop("_raw", "_r1", "_b", "_a", "_n", "_before", "_after", "_merged", "_r2", "_n2")


def idt_row_labels(x: np.ndarray, y: np.ndarray, ppd: float, threshold: float, min_fix: int) -> np.ndarray:
    """W08 on one recording: True on fixation rows. Greedy windows of ``min_fix`` valid rows that grow while they stay tight."""
    n, valid = len(x), ~(np.isnan(x) | np.isnan(y))
    fix = np.zeros(n, bool)
    at = np.flatnonzero(valid)
    rank = np.cumsum(valid) - 1  # of each row, the number of its last valid row
    i = 0
    while i <= n - min_fix:
        if not valid[i]:
            i += 1
            continue
        k = rank[i] + min_fix - 1
        if k >= len(at):
            break
        j, own = int(at[k]), at[rank[i] : k + 1]
        lx, hx, ly, hy = x[own].min(), x[own].max(), y[own].min(), y[own].max()
        if (hx - lx + hy - ly) / ppd > threshold:
            i += 1
            continue
        while j < n - 1:
            j += 1
            if not valid[j]:
                break  # the invalid row still belongs to the fixation
            a, b, c, d = min(lx, x[j]), max(hx, x[j]), min(ly, y[j]), max(hy, y[j])
            if (b - a + d - c) / ppd > threshold:
                j -= 1
                break
            lx, hx, ly, hy = a, b, c, d
        fix[i : j + 1] = True
        i = j + 1
    return fix


def idt_labels(df: DataFrame, gx: str, gy: str, ppd: float, threshold: float, min_fix: int, out: str = "label") -> DataFrame:
    """Dispersion-threshold labels; every row outside a fixation is 'saccade'. The one sequential operator: a
    recording at a time in Arrow batches, only key and gaze columns; labels are joined back."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_idx", kind="stable")
        fix = idt_row_labels(pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float), ppd, threshold, min_fix)
        return pd.DataFrame({"recording_id": pdf["recording_id"], "sample_idx": pdf["sample_idx"], out: np.where(fix, "fixation", "saccade")})

    got = df.select("recording_id", "sample_idx", F.col(gx).alias("_x"), F.col(gy).alias("_y")).groupBy("recording_id").applyInPandas(label, f"recording_id string, sample_idx long, {out} string")
    return df.drop(out).join(got, ["recording_id", "sample_idx"])


def event_columns(df: DataFrame, label: str, gx: str, gy: str, pa: str, vel: str, ppd: float, rate: float, prefix: str | None = None, keys=RECORDING) -> DataFrame:
    """Stamps fixation and saccade attributes on all rows of each run of equal labels."""
    p = f"{prefix}_" if prefix else ""
    d = with_runs(df, F.col(label), keys, "_run")
    own = Window.partitionBy(*keys, "_run")
    fix, sacc = F.col(label) == "fixation", F.col(label) == "saccade"
    ok = F.col(gx).isNotNull() & F.col(gy).isNotNull()
    n_ok, n = F.count(F.when(ok, 1)).over(own), F.count(F.lit(1)).over(own)
    mean = lambda c: F.avg(F.when(ok, F.col(c))).over(own)
    ava = F.try_divide(F.coalesce(F.sum(F.when(ok, F.col(pa))).over(own), F.when(n_ok > 0, F.lit(0.0))), n_ok)
    dur = F.rint(n / F.lit(float(rate)) * 1000.0).cast("int")
    at = F.when(ok, F.col("sample_idx"))
    first = lambda c: F.min_by(c, at).over(own)
    last = lambda c: F.max_by(c, at).over(own)
    d = d.withColumns({"_x1": first(gx), "_y1": first(gy), "_x2": last(gx), "_y2": last(gy), "_peak": F.greatest(F.lit(0.0), F.coalesce(F.max(vel).over(own), F.lit(0.0))), "_ok": n_ok, "_mx": mean(gx), "_my": mean(gy), "_ava": ava, "_dur": dur})
    dx, dy = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    seen = F.col("_ok") > 0
    out = {
        "in_fix": fix, "fix_gavx": F.when(fix, F.col("_mx")), "fix_gavy": F.when(fix, F.col("_my")), "fix_ava": F.when(fix & seen, F.col("_ava")), "fix_dur": F.when(fix & seen, F.col("_dur")).otherwise(0),
        "in_sacc": sacc, "sacc_gstx": F.when(sacc, F.col("_x1")), "sacc_gsty": F.when(sacc, F.col("_y1")), "sacc_genx": F.when(sacc, F.col("_x2")), "sacc_geny": F.when(sacc, F.col("_y2")),
        "sacc_dur": F.when(sacc, F.col("_dur")).otherwise(0), "sacc_ampl": F.when(sacc, F.sqrt(dx * dx + dy * dy) / F.lit(float(ppd))), "sacc_pvel": F.when(sacc & seen, F.col("_peak")),
    }
    return d.withColumns({p + k: v for k, v in out.items()}).drop("_run", "_x1", "_y1", "_x2", "_y2", "_peak", "_ok", "_mx", "_my", "_ava", "_dur")


def nan_blinks(df: DataFrame, track: str | None, rate: float, min_blink_ms: float, keys=RECORDING) -> DataFrame:
    """Runs of missing gaze of at least ``min_blink_ms`` are blinks."""
    if track is None:
        return df.withColumn("in_blink", F.lit(False)).withColumn("blink_dur", F.lit(0))
    least = ms_to_samples(min_blink_ms, rate)
    d = with_runs(df.withColumn("_m", F.col(track).isNull()), F.col("_m"), keys, "_run")
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))
    blink = F.col("_m") & (F.col("_n") >= least)
    return d.withColumn("in_blink", blink).withColumn("blink_dur", F.when(blink, F.rint(F.col("_n") / F.lit(float(rate)) * 1000.0).cast("int")).otherwise(0)).drop("_m", "_run", "_n")


def detect_events(
    gf: GazeFrame,
    method: str = "ivt",
    eye: str = "auto",
    velocity_threshold: float = 30.0,
    dispersion_threshold: float = 1.0,
    min_fixation_ms: float = 60,
    min_saccade_ms: float = 10,
    min_blink_ms: float = 80,
    pixels_per_degree: float | None = None,
    prefix: str | None = None,
) -> GazeFrame:
    """Labels fixations and saccades ('ivt' or 'idt') and writes the event columns; blinks too for sources without any."""
    if method not in ("ivt", "idt"):
        raise ValueError(f"unknown method {method!r}: 'ivt' or 'idt'")
    gx, gy, pa = gf.eye_columns(eye)
    rate, ppd = gf.meta.sample_rate, float(pixels_per_degree or gf.meta.ppd)
    min_fix, min_sacc = ms_to_samples(min_fixation_ms, rate), ms_to_samples(min_saccade_ms, rate)
    df = gf.df if gf.has(pa) else gf.df.withColumn(pa, F.lit(None).cast("double"))
    df = df.withColumn("_vel", velocity(gx, gy, ppd, rate))
    if method == "ivt":
        df = ivt_labels(df, "_vel", velocity_threshold, min_fix, min_sacc, out="_label")
    else:
        df = idt_labels(df, gx, gy, ppd, dispersion_threshold, min_fix, out="_label")
    df = event_columns(df, "_label", gx, gy, pa, "_vel", ppd, rate, prefix).drop("_vel", "_label")
    if gf.meta.source in ("smi", "tobii"):
        df = nan_blinks(df, gx if gf.has(gx) else pa if gf.has(pa) else None, rate, min_blink_ms)
    return gf.with_df(df)


def detect_microsaccades(gf: GazeFrame, eye: str = "auto", lam: float = 6.0, min_duration_ms: float = 6, max_amplitude: float = 2.0, group_by=None) -> GazeFrame:
    """Velocity outliers by an elliptic threshold of median-based deviations, per group; rows without keys have none."""
    gx, gy, _ = gf.eye_columns(eye)
    keys = gf.groups(group_by)
    rate, ppd = gf.meta.sample_rate, gf.meta.ppd
    least = ms_to_samples(min_duration_ms, rate)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    g = within(keys)
    d = gf.df.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_vx", five_point(gx, keys))
    # The test for missing neighbours looks at x; a missing y alone makes a missing vy.
    d = d.withColumn("_vy", F.when(F.col("_vx").isNotNull(), five_point(gy, keys)))
    med = lambda c: F.median(c).over(g)
    sigma = lambda c: F.greatest(F.sqrt(F.greatest(F.lit(0.0), med(F.col(c) * F.col(c)) - med(F.col(c)) * med(F.col(c)))), F.lit(1e-10))
    d = d.withColumn("_sx", sigma("_vx")).withColumn("_sy", sigma("_vy")).withColumn("_valid", F.count("_vx").over(g))
    tx, ty = F.col("_vx") / (lam * F.col("_sx")), F.col("_vy") / (lam * F.col("_sy"))
    above = keyed & (F.col("_n") >= 5) & (F.col("_valid") >= 10) & (tx * tx + ty * ty > 1.0)
    d = with_runs(d.withColumn("_above", F.coalesce(above, F.lit(False))), F.col("_above"), keys, "_run")
    own = Window.partitionBy(*keys, "_run")
    ends = own.orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("_dx", F.last(gx).over(ends) - F.first(gx).over(ends)).withColumn("_dy", F.last(gy).over(ends) - F.first(gy).over(ends))
    d = d.withColumn("_len", F.count(F.lit(1)).over(own)).withColumn("_pv", F.max(F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))).over(own))
    d = d.withColumn("_am", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    hit = F.col("_above") & (F.col("_len") >= least) & F.coalesce(F.col("_am") / F.lit(ppd) <= float(max_amplitude), F.lit(True))
    out = {"in_msacc": hit, "msacc_dx": F.when(hit, F.col("_dx")), "msacc_dy": F.when(hit, F.col("_dy")), "msacc_ampl": F.when(hit, F.col("_am")), "msacc_pvel": F.when(hit, F.coalesce("_pv", F.lit(0.0)))}
    return gf.with_df(d.withColumns(out).drop("_n", "_vx", "_vy", "_sx", "_sy", "_valid", "_above", "_run", "_dx", "_dy", "_len", "_pv", "_am"))


