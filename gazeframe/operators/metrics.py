"""Per-group metrics: data quality, areas of interest, fixations, saccades, pupil, exclusion, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.frame import RECORDING, GazeFrame, ordered, relative_time, time_window
from gazeframe.functions.aoi import AOI, any_match, explode_areas, first_match
from gazeframe.functions.numeric import rj
from gazeframe.operators.runs import onset, with_runs


def data_quality(gf: GazeFrame, eye: str = "auto", group_by=None) -> DataFrame:
    """Samples, tracking loss, blinks, pupil and duration of each group."""
    gx, _, pa = gf.eye_columns(eye)
    df, keys = gf.valid_groups(group_by)
    on = onset(F.col("in_blink"), keys) if gf.has("in_blink") else F.lit(False)
    n, valid, sr = F.count(F.lit(1)), F.count(gx), F.lit(float(gf.meta.sample_rate))
    blinks = F.sum(F.col("_on").cast("long"))
    return (
        df.withColumn("_on", on)
        .groupBy(*keys)
        .agg(
            n.alias("total_samples"),
            valid.alias("valid_samples"),
            rj((n - valid) / n * 100.0, 1).alias("tracking_loss_pct"),
            blinks.alias("blink_count"),
            rj(blinks * sr / n, 2).alias("blink_rate"),
            (rj(F.avg(pa), 1) if gf.has(pa) else F.lit(None).cast("double")).alias("mean_pupil"),
            F.rint(n / sr * 1000.0).alias("duration_ms"),
        )
    )


def group_summary(gf: GazeFrame, by: Sequence[str] | str | None = None, group_by=None, eye: str = "auto") -> DataFrame:
    """Counts and means of fixations, saccades and blinks, by further columns before the group's keys."""
    extra = [by] if isinstance(by, str) else list(by or [])
    keys = [*extra, *(k for k in gf.groups(group_by) if k not in extra)]
    gx, _, pa = gf.eye_columns(eye)
    df, keys = gf.valid_groups(keys)
    flag = lambda c: onset(F.col(c), keys) if gf.has(c) else F.lit(False)
    value = lambda c: F.col(c) if gf.has(c) else F.lit(None).cast("double")
    d = df.withColumn("_f", flag("in_fix") & value("fix_gavx").isNotNull()).withColumn("_s", flag("in_sacc") & value("sacc_pvel").isNotNull()).withColumn("_b", flag("in_blink"))
    n = F.count(F.lit(1))
    total = lambda c: F.sum(F.col(c).cast("long"))
    when = lambda c, v: F.when(F.col(c), v)
    return d.groupBy(*keys).agg(
        total("_f").alias("n_fixations"),
        rj(F.avg(when("_f", value("fix_dur").cast("double"))), 1).alias("mean_fix_dur"),
        rj(F.median(when("_f", value("fix_dur").cast("double"))), 1).alias("median_fix_dur"),
        total("_s").alias("n_saccades"),
        rj(F.avg(when("_s", value("sacc_ampl"))), 2).alias("mean_sacc_ampl"),
        rj(F.avg(when("_s", value("sacc_pvel"))), 1).alias("mean_sacc_pvel"),
        total("_b").alias("n_blinks"),
        rj(F.avg(value(pa)), 1).alias("mean_pupil"),
        rj((n - F.count(gx)) / n * 100.0, 1).alias("tracking_loss_pct"),
    )


def _clip(start: Column, end: Column, window) -> tuple[Column, Column, Column]:
    """Kept, clipped start and duration of an interval: it must strictly overlap the window and keep some length."""
    if window is None:
        return F.lit(True), start, end - start
    s, e = window
    a, b = F.greatest(start, s), F.least(end, e)
    return (end > s) & (start < e) & (b - a > 0), a, b - a


def _whole_areas(groups: DataFrame, aois: Sequence[AOI]) -> DataFrame:
    return groups.select("*", explode_areas(aois).alias("_a")).select(*groups.columns, F.col("_a.k").alias("_k"), F.col("_a.name").alias("aoi"))


def aoi_metrics(gf: GazeFrame, aois: Sequence[AOI], selection=None, eye: str = "auto", group_by=None, window: tuple | None = None) -> DataFrame:
    """Dwell time, entries and fixations of each area; every area is tested by itself.

    One pass over the samples with a mask for each area: no row is multiplied by the number of areas before the sums.
    """
    gf = gf.select(selection)
    gx, gy, _ = gf.eye_columns(eye)
    df, keys = gf.valid_groups(group_by)
    w = ordered(keys)
    tw = time_window(window, keys)
    has_fix = gf.has("in_fix", "fix_gavx", "fix_gavy", "fix_dur")
    d = df.withColumn("_t", relative_time(df, keys))
    d = d.withColumns({"_s": tw[0], "_e": tw[1]}) if tw else d
    ends = (F.col("_s"), F.col("_e")) if tw else None
    if has_fix:
        d = d.withColumn("_on", onset(F.col("in_fix"), keys) & F.col("fix_gavx").isNotNull() & F.col("fix_gavy").isNotNull())
        kept, start, dur = _clip(F.col("_t"), F.col("_t") + F.col("fix_dur"), ends)
        d = d.withColumn("_fix", F.when(F.col("_on") & kept, F.struct(F.col("sample_idx").alias("i"), start.alias("t"), dur.cast("double").alias("d"), F.col("fix_gavx").alias("x"), F.col("fix_gavy").alias("y"))))
    # Entries count over the rows inside the window only.
    inside = F.col("_t").between(*ends) if tw else F.lit(True)
    d = d.withColumn("_in", F.coalesce(inside, F.lit(False)))
    masks = {f"_m{k}": F.col("_in") & a.contains(F.col(gx), F.col(gy)) for k, a in enumerate(aois)}
    d = d.withColumns(masks)
    seen = {f"_b{k}": F.coalesce(F.last(F.when(F.col("_in"), F.col(f"_m{k}")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) for k in range(len(aois))}
    d = d.withColumns(seen)
    sr = F.lit(float(gf.meta.sample_rate))
    none = F.lit(None).cast("double")
    rows = []
    for k, a in enumerate(aois):
        m = F.col(f"_m{k}")
        if has_fix:
            hit = F.col("_fix").isNotNull() & a.contains(F.col("_fix.x"), F.col("_fix.y"))
            first = F.min(F.when(hit, F.struct("_fix.i", "_fix.t", "_fix.d")))
            n_fix, t, dd = F.count(F.when(hit, 1)), first["t"], first["d"]
        else:
            n_fix, t, dd = F.lit(0).cast("long"), F.min_by("_t", F.when(m & F.col("_t").isNotNull(), F.col("sample_idx"))), none
        rows.append(F.struct(F.lit(k + 1).alias("k"), F.lit(a.name).alias("aoi"), rj(F.sum(m.cast("long")) / sr * 1000.0, 1).alias("dwell_time_ms"), n_fix.alias("fixation_count"), rj(t, 1).alias("first_fixation_time_ms"), rj(dd, 1).alias("first_fixation_duration_ms"), F.sum((m & ~F.col(f"_b{k}")).cast("long")).alias("entry_count")).alias(f"_r{k}"))
    got = d.groupBy(*keys).agg(*rows)
    return got.select(*keys, F.explode(F.array(*(F.col(f"_r{k}") for k in range(len(aois))))).alias("r")).select(*keys, "r.aoi", "r.dwell_time_ms", "r.fixation_count", "r.first_fixation_time_ms", "r.first_fixation_duration_ms", "r.entry_count")


def labelled_fixations(gf: GazeFrame, aois: Sequence[AOI], group_by=None, window: tuple | None = None) -> tuple[DataFrame, list[str]]:
    """Fixations of each group in order, clipped to the window, with the first area that contains each (0: none).

    Times count from the group's first row. Only a missing x drops a fixation.
    """
    if not gf.has("in_fix", "fix_gavx"):
        raise ValueError("no fixation columns: detect events first")
    df, keys = gf.valid_groups(group_by)
    tw = time_window(window, keys)
    first = F.first("time").over(ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = df.withColumn("_t", F.col("time").cast("double") - first.cast("double")).withColumn("_on", onset(F.col("in_fix"), keys) & F.col("fix_gavx").isNotNull())
    d = d.withColumns({"_s": tw[0], "_e": tw[1]}) if tw else d
    kept, start, dur = _clip(F.col("_t"), F.col("_t") + F.col("fix_dur"), (F.col("_s"), F.col("_e")) if tw else None)
    d = d.where(F.col("_on") & kept)
    return d.select(*keys, "sample_idx", start.alias("onset_ms"), dur.cast("double").alias("dur_ms"), first_match(aois, F.col("fix_gavx"), F.col("fix_gavy")).alias("area")), keys


def fixation_metrics(gf: GazeFrame, aois: Sequence[AOI], selection=None, group_by=None, window: tuple | None = None) -> DataFrame:
    """First fixation, gaze duration (first visit), total time, count and revisits of each area, skipped areas too."""
    gf = gf.select(selection)
    fix, keys = labelled_fixations(gf, aois, group_by, window)
    visits = with_runs(fix, F.col("area"), keys, "_visit").where("area > 0")
    per = visits.groupBy(*keys, "area", "_visit").agg(F.sum("dur_ms").alias("d"), F.count(F.lit(1)).alias("n"), F.min(F.struct("sample_idx", "onset_ms", "dur_ms")).alias("f"))
    got = per.groupBy(*keys, "area").agg(F.min("f").alias("f"), F.min_by("d", "_visit").alias("gaze"), F.sum("d").alias("total"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    # Groups without any fixation count too: their areas are all skipped.
    groups, keys = gf.valid_groups(group_by)
    every = _whole_areas(groups.select(*keys).distinct(), aois)
    out = every.join(got.withColumnRenamed("area", "_k"), [*keys, "_k"], "left")
    return out.select(
        *keys,
        "aoi",
        F.col("f.dur_ms").alias("first_fixation_duration"),
        F.col("f.onset_ms").alias("first_fixation_onset"),
        F.col("gaze").alias("gaze_duration"),
        F.coalesce("total", F.lit(0.0)).alias("total_time"),
        F.coalesce("n", F.lit(0)).alias("fixation_count"),
        F.greatest(F.coalesce("v", F.lit(0)) - 1, F.lit(0)).alias("revisits"),
        F.col("n").isNull().alias("skipped"),
    )


def saccade_metrics(gf: GazeFrame, selection=None, eye: str = "auto", group_by=None, window: tuple | None = None) -> DataFrame:
    """A row for each saccade that starts in the window and has two valid samples: ends, size, speed, curvature."""
    gf = gf.select(selection)
    if not gf.has("in_sacc"):
        raise ValueError("no saccade columns: detect events first")
    gx, gy, _ = gf.eye_columns(eye)
    df, keys = gf.valid_groups(group_by)
    tw = time_window(window, keys)
    d = df.withColumn("_t", relative_time(df, keys))
    d = d.withColumns({"_s": tw[0], "_e": tw[1]}) if tw else d
    d = with_runs(d.withColumn("_p", F.coalesce("in_sacc", F.lit(False))), F.col("_p"), keys).where("_p")
    own = Window.partitionBy(*keys, "_run")
    at = F.when(F.col(gx).isNotNull() & F.col(gy).isNotNull(), F.col("sample_idx"))
    d = d.withColumn("_at", at).withColumns({"_xs": F.min_by(gx, "_at").over(own), "_ys": F.min_by(gy, "_at").over(own), "_xe": F.max_by(gx, "_at").over(own), "_ye": F.max_by(gy, "_at").over(own)})
    dx, dy = F.col("_xe") - F.col("_xs"), F.col("_ye") - F.col("_ys")
    d = d.withColumn("_px", F.sqrt(dx * dx + dy * dy))
    off = F.when(F.col("_px") > 1e-6, F.abs(dx * (F.col("_ys") - F.col(gy)) - (F.col("_xs") - F.col(gx)) * dy) / F.col("_px")).otherwise(0.0)
    attr = lambda c: F.min_by(c, "_at") if gf.has(c) else F.lit(None).cast("double")
    got = d.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("n"), F.count("_at").alias("ok"), F.min("sample_idx").alias("i"), F.min_by("_t", "sample_idx").alias("t"), F.first("_xs").alias("xs"), F.first("_ys").alias("ys"), F.first("_xe").alias("xe"), F.first("_ye").alias("ye"),
        F.first("_px").alias("px"), F.max(F.when(F.col("_at").isNotNull(), off)).alias("curve"), attr("sacc_ampl").alias("ampl"), attr("sacc_pvel").alias("pvel"), *((F.first("_s").alias("s"), F.first("_e").alias("e")) if tw else ()),
    )
    got = got.where((F.col("ok") >= 2) & (F.col("t").between(F.col("s"), F.col("e")) if tw else F.lit(True)))
    return got.select(
        *keys,
        F.row_number().over(Window.partitionBy(*keys).orderBy("i")).alias("saccade_idx"),
        rj(F.col("n") * F.lit(1000.0 / gf.meta.sample_rate), 2).alias("duration"),
        rj(F.col("xs"), 2).alias("start_x"), rj(F.col("ys"), 2).alias("start_y"), rj(F.col("xe"), 2).alias("end_x"), rj(F.col("ye"), 2).alias("end_y"),
        rj(F.col("ampl"), 4).alias("amplitude_deg"), rj(F.col("pvel"), 4).alias("peak_velocity"), rj(F.col("curve"), 4).alias("max_curvature_px"),
        rj(F.when(F.col("px") > 1e-6, F.col("curve") / F.col("px")).otherwise(0.0), 4).alias("curvature_ratio"),
    )


def pupil_peak_metrics(gf: GazeFrame, selection=None, eye: str = "auto", group_by=None, window: tuple | None = None) -> DataFrame:
    """Mean, largest and least pupil and the time of the first largest, of each group."""
    gf = gf.select(selection)
    pa = gf.eye_columns(eye, pupil=True)[2]
    df, keys = gf.valid_groups(group_by)
    tw = time_window(window, keys)
    d = df.withColumn("_t", relative_time(df, keys))
    d = d.withColumns({"_s": tw[0], "_e": tw[1]}) if tw else d.withColumn("_s", F.lit(0.0))
    ok = F.col("_t").isNotNull() & F.col(pa).isNotNull() & (F.col("_t").between(F.col("_s"), F.col("_e")) if tw else F.lit(True))
    v = F.when(ok, F.col(pa))
    peak = F.max_by("_t", F.when(ok, F.struct(F.col(pa).alias("p"), (-F.col("sample_idx")).alias("i"))))
    return d.groupBy(*keys).agg(
        rj(F.avg(v), 4).alias("mean_pupil"), rj(F.max(v), 4).alias("max_pupil"), rj(F.min(v), 4).alias("min_pupil"), rj(peak, 1).alias("max_pupil_time"), rj(peak - F.first("_s"), 1).alias("time_to_peak")
    )


def exclude_trials(gf: GazeFrame, max_tracking_loss: float = 50.0, max_blink_count: int | None = None, min_duration_ms: float | None = None, eye: str = "auto", group_by=None) -> tuple[GazeFrame, DataFrame, DataFrame]:
    """A10: the frame without bad groups, the bad groups, and (n_before, n_excluded, n_after). Rows without keys stay."""
    keys = gf.groups(group_by)
    q = data_quality(gf, eye, keys)
    bad = F.col("tracking_loss_pct") > float(max_tracking_loss)
    if max_blink_count is not None:
        bad = bad | (F.col("blink_count") > max_blink_count)
    if min_duration_ms is not None:
        bad = bad | (F.col("duration_ms") < float(min_duration_ms))
    q = q.withColumn("_bad", bad)
    out = q.where("_bad").select(*keys)
    report = q.agg(F.count(F.lit(1)).alias("n_before"), F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)).alias("n_excluded")).withColumn("n_after", F.col("n_before") - F.col("n_excluded"))
    return gf.with_df(gf.df.join(out, keys, "left_anti")), out, report


def dwell_totals(gf: GazeFrame, aois: Sequence[AOI], selection=None, eye: str = "auto") -> DataFrame:
    """Milliseconds in each area over the whole selection; areas are tested apart."""
    gf = gf.select(selection)
    gx, gy, _ = gf.eye_columns(eye)
    sums = gf.df.agg(*(F.coalesce(F.sum(a.contains(F.col(gx), F.col(gy)).cast("long")), F.lit(0)).alias(f"_{k}") for k, a in enumerate(aois)))
    sr = F.lit(float(gf.meta.sample_rate))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(a.name).alias("aoi"), (F.col(f"_{k}") / sr * 1000.0).alias("dwell_ms")) for k, a in enumerate(aois)))).alias("r")).select("r.*")


def area_membership(gf: GazeFrame, aois: Sequence[AOI], eye: str = "auto") -> DataFrame:
    """For each area, how many rows it contains; overlapping areas count a row twice."""
    gx, gy, _ = gf.eye_columns(eye)
    d = gf.df.select(gx, gy, explode_areas(aois).alias("a"))
    return d.where(any_match(aois, F.col("a.k"), F.col(gx), F.col(gy))).groupBy(F.col("a.name").alias("aoi")).agg(F.count(F.lit(1)).alias("n"))


def recording_summary(gf: GazeFrame) -> DataFrame:
    """Samples, duration, trials and events of each recording."""
    d = gf.df
    flags = {n: c for n, c in (("n_fixations", "in_fix"), ("n_saccades", "in_sacc"), ("n_blinks", "in_blink")) if gf.has(c)}
    d = d.withColumns({f"_{n}": onset(F.col(c), RECORDING) for n, c in flags.items()})
    trials = F.countDistinct("trial") if gf.has("trial") else F.lit(0)
    return d.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_samples"), (F.count(F.lit(1)) / F.lit(float(gf.meta.sample_rate)) / 60.0).alias("minutes"), trials.alias("n_trials"), *(F.sum(F.col(f"_{n}").cast("long")).alias(n) for n in flags)
    )


def direction_histogram(saccades: DataFrame, bins: int = 36) -> DataFrame:
    """How many saccades go into each of ``bins`` half-open directions on [-pi, pi), from their ``angle``."""
    import math

    width = 2 * math.pi / bins
    k = F.floor((F.col("angle") + math.pi) / width).cast("int")
    return saccades.where(F.col("angle").isNotNull()).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("bin").between(0, bins - 1))


def trial_keys(gf: GazeFrame, split_by: str | Sequence[str] = "trial") -> DataFrame:
    """The sorted distinct segments of a frame."""
    keys = [split_by] if isinstance(split_by, str) else list(split_by)
    return gf.df.select(*keys).dropna().distinct().orderBy(*keys)


