"""Small fixtures with known values, plain-loop oracles on seeded signals, and invariance under partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame, RecordingMeta
from gazeframe.functions.aoi import AOI, Circle, Ellipse, Polygon, Rect, first_match
from gazeframe.functions.numeric import hermite, ms_to_samples, nan_to_null, pixels_per_degree, rj
from gazeframe.operators import annotate as A
from gazeframe.operators import detect as D
from gazeframe.operators import grid as G
from gazeframe.operators import metrics as M
from gazeframe.operators import runs as R
from gazeframe.operators import sequence as Q
from gazeframe.operators import signal as X
from gazeframe.operators import timecourse as C

META = RecordingMeta(sample_rate=1000.0)


def table(spark, rows, schema, parts=3, meta=META):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return GazeFrame.from_dataframe(df, meta)


def signal(seed, n=160, hole=0.15):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 6, n) + (rng.random(n) < 0.06) * rng.normal(0, 120, n)) + 500
    y = np.cumsum(rng.normal(0, 6, n)) + 400
    p = 900 + rng.normal(0, 10, n)
    lost = rng.random(n) < hole
    x[lost] = y[lost] = np.nan
    y[rng.random(n) < 0.03] = np.nan
    p[rng.random(n) < hole] = np.nan
    return x, y, p, rng.random(n) < 0.2


def signals(spark, seeds=(1, 2), parts=3):
    rows, own = [], {}
    for s in seeds:
        x, y, p, b = signal(s)
        own[f"r{s}"] = (x, y, p, b)
        rows += [(f"r{s}", i, float(i), 1 + i // 80, float(x[i]), float(y[i]), float(p[i]), bool(b[i])) for i in range(len(x))]
    return table(spark, rows, "recording_id string, sample_idx long, time double, trial long, gxL double, gyL double, paL double, in_blink boolean", parts), own


def column(gf, c, rid):
    got = [r[0] for r in gf.df.where(F.col("recording_id") == rid).orderBy("sample_idx").select(c).collect()]
    return np.array([np.nan if v is None else v for v in got], float)


# -------------------------------------------------------------------------------------------------- scalars and shapes


def test_numeric(spark):
    assert abs(pixels_per_degree(1920, 53, 60) - 40.286285291135876) < 1e-12
    assert abs(pixels_per_degree(1280, 30, 50) - 38.325087712484105) < 1e-12
    assert ms_to_samples(0.1, 60) == 1 and ms_to_samples(62.5, 1000) == 62
    d = spark.createDataFrame([(0.25, float("nan"))], "a double, b double")
    assert nan_to_null(d).first().b is None
    r = d.select(rj(F.col("a"), 1).alias("x"), hermite(F.lit(0.5), F.lit(1.0), F.lit(3.0), F.lit(0.0), F.lit(0.0)).alias("h")).first()
    assert r.x == 0.2 and r.h == 2.0


def test_areas(spark):
    rng = np.random.default_rng(0)
    pts = [(float(a), float(b)) for a, b in rng.uniform(0, 100, (300, 2))] + [(10.0, 20.0), (30.0, 40.0), (None, 5.0)]
    v = ((10.0, 10.0), (90.0, 20.0), (50.0, 50.0), (80.0, 90.0), (20.0, 80.0))
    shapes = [Rect("r", 20, 30, 20, 20), Circle("c", 50, 50, 20), Ellipse("e", 60, 40, 30, 10), Polygon("p", v), Polygon("n", v[:2])]
    df = spark.createDataFrame(pts, "x double, y double").select("x", "y", *(s.contains(F.col("x"), F.col("y")).alias(s.name) for s in shapes), first_match(shapes, F.col("x"), F.col("y")).alias("k"))

    def poly(x, y):
        inside, j = False, len(v) - 1
        for i in range(len(v)):
            (xi, yi), (xj, yj) = v[i], v[j]
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                inside = not inside
            j = i
        return inside

    for r in df.collect():
        if r.x is None:
            assert not (r.r or r.c or r.e or r.p) and r.k == 0
            continue
        want = [10 <= r.x <= 30 and 20 <= r.y <= 40, (r.x - 50) ** 2 + (r.y - 50) ** 2 <= 400, ((r.x - 60) / 30) ** 2 + ((r.y - 40) / 10) ** 2 <= 1, poly(r.x, r.y), False]
        assert [r.r, r.c, r.e, r.p, r.n] == want
        assert r.k == next((i + 1 for i, w in enumerate(want) if w), 0)

    class Half(AOI):
        def test(self, x, y):
            return x < 50

    assert df.where(Half("h").contains(F.col("x"), F.col("y"))).count() == sum(p[0] is not None and p[0] < 50 for p in pts)


def test_selection_and_eye(spark):
    gf, _ = signals(spark)
    assert gf.select(2).df.count() == 160 and gf.select({"trial": [1], "recording_id": "r1"}).df.count() == 80 and gf.select(F.col("time") < 3).df.count() == 6
    with pytest.raises(ValueError):
        gf.select({"nothing": 1})
    with pytest.raises(TypeError):
        gf.select("x")
    with pytest.raises(ValueError):
        GazeFrame.from_dataframe(gf.df.drop("sample_idx"))
    assert gf.eye() == "L"
    only_right = gf.with_df(gf.df.withColumn("gxR", F.col("gxL")).withColumn("gxL", F.lit(None).cast("double")))
    assert only_right.eye() == "R" and only_right.eye("left") == "L"


def test_eye_is_looked_for_once(spark):
    df = spark.createDataFrame([(i, None, float(i), None, None) for i in range(40)], "sample_idx long, gxL double, gxR double, paL double, paR double").repartition(8)
    gf = GazeFrame.from_dataframe(df)
    sc = spark.sparkContext
    sc.setJobGroup("eyes", "eyes")
    try:
        assert [gf.eye() for _ in range(5)] == ["R"] * 5
        first = len(sc.statusTracker().getJobIdsForGroup("eyes"))
        assert [gf.eye("auto"), gf.eye("right"), gf.eye_columns()[0]] == ["R", "R", "gxR"]
        assert first and len(sc.statusTracker().getJobIdsForGroup("eyes")) == first
        assert gf.eye(pupil=True) == "L" and gf.select(F.col("gxR") < 0).eye() == "L"
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)



# ------------------------------------------------------------------------------------------------------------- runs


def test_runs_and_accessors(spark):
    rows = [("a", i, 10.0 * i, None if i in (3, 4) else 1 + i // 5, f, 5.0 if f else None, 7 if f else 0, m) for i, (f, m) in enumerate(zip([1, 1, 0, 1, 1, 1, 0, 0, 1, 0], ["x; y", "", "z", " q ; ", "", "", "", "x", "", ""]))]
    gf = table(spark, [(*r[:4], bool(r[4]), *r[5:]) for r in rows], "recording_id string, sample_idx long, time double, trial long, in_fix boolean, fix_gavx double, fix_dur int, message string")
    got = R.contiguous_runs(gf.df, F.col("in_fix"), min_len=2).orderBy("start_idx").collect()
    assert [(r.start_idx, r.end_idx, r.n) for r in got] == [(0, 1, 2), (3, 5, 3)]
    f = R.fixations(gf).orderBy("sttime").collect()
    assert [(r.sttime, r.entime, r.duration, r.gavx) for r in f] == [(0.0, 10.0, 7.0, 5.0), (30.0, 50.0, 7.0, 5.0), (80.0, 80.0, 7.0, 5.0)]
    assert R.saccades(gf).count() == 0 and R.blinks(gf).count() == 0
    assert {r.trial: r.n for r in R.counts(gf, "in_fix").collect()} == {1: 1, 2: 2}  # a run over a border counts in both
    assert sorted(r.message for r in A.messages(gf).collect()) == ["q", "x", "x", "y", "z"]
    s = A.message_summary(gf).collect()
    assert (s[0].message, s[0]["count"]) == ("x", 2)


def test_message_summary_by_first_word(spark):
    gf = table(spark, [("a", i, float(i), f"TRIAL {i}{'0' * (i % 3)}") for i in range(8)], "recording_id string, sample_idx long, time double, message string")
    r = A.message_summary(gf).collect()
    assert len(r) == 1 and (r[0].message, r[0]["count"], r[0].example) == ("TRIAL", 8, "TRIAL 500")


# ----------------------------------------------------------------------------------------------------------- detection


def loop_velocity(x, y, ppd, sr):
    v = np.full(len(x), np.nan)
    for i in range(2, len(x) - 2):
        dx = (x[i + 2] + x[i + 1] - x[i - 1] - x[i - 2]) / 6
        dy = (y[i + 2] + y[i + 1] - y[i - 1] - y[i - 2]) / 6
        v[i] = math.sqrt(dx * dx + dy * dy) / ppd * sr
    return v


def loop_ivt(v, thr, min_fix, min_sacc):
    lab = ["noise" if math.isnan(a) else "fixation" if a < thr else "saccade" for a in v]

    def spans(kind):
        i = 0
        while i < len(lab):
            j = i
            while j < len(lab) and lab[j] == kind:
                j += 1
            if j > i:
                yield i, j
            i = max(j, i + 1)

    for i, j in list(spans("saccade")):
        if j - i < min_sacc and i > 0 and j < len(lab) and lab[i - 1] == lab[j] == "fixation":
            lab[i:j] = ["fixation"] * (j - i)
    for i, j in list(spans("fixation")):
        if j - i < min_fix:
            lab[i:j] = ["noise"] * (j - i)
    return lab


@pytest.mark.parametrize("parts", [1, 7])
def test_velocity_and_ivt(spark, parts):
    gf, own = signals(spark, parts=parts)
    df = gf.df.withColumn("v", D.velocity("gxL", "gyL", 40.0, 1000.0))
    df = D.ivt_labels(df, "v", 150.0, 3, 4)
    for rid, (x, y, _, _) in own.items():
        rows = df.where(F.col("recording_id") == rid).orderBy("sample_idx").collect()
        v = loop_velocity(x, y, 40.0, 1000.0)
        assert np.allclose([np.nan if r.v is None else r.v for r in rows], v, equal_nan=True)
        assert [r.label for r in rows] == loop_ivt(v, 150.0, 3, 4)


def loop_idt(x, y, ppd, thr, k):
    n, lab, i = len(x), [False] * len(x), 0
    ok = lambda j: not (math.isnan(x[j]) or math.isnan(y[j]))
    spread = lambda js: (max(x[j] for j in js) - min(x[j] for j in js) + max(y[j] for j in js) - min(y[j] for j in js)) / ppd
    while i <= n - k:
        if not ok(i):
            i += 1
            continue
        js = [j for j in range(i, n) if ok(j)][:k]
        if len(js) < k:
            break
        if spread(js) > thr:
            i += 1
            continue
        end = js[-1]
        while end < n - 1:
            if not ok(end + 1):
                end += 1
                break
            if spread([*js, end + 1]) > thr:
                break
            end += 1
            js.append(end)
        for j in range(i, end + 1):
            lab[j] = True
        i = end + 1
    return lab


def test_idt(spark):
    for seed in range(12):
        x, y, _, _ = signal(seed, 90)
        assert D.idt_row_labels(x, y, 40.0, 1.0, 5).tolist() == loop_idt(x, y, 40.0, 1.0, 5)
    gf, own = signals(spark)
    df = D.idt_labels(gf.df, "gxL", "gyL", 40.0, 1.0, 5)
    for rid, (x, y, _, _) in own.items():
        got = [r.label == "fixation" for r in df.where(F.col("recording_id") == rid).orderBy("sample_idx").collect()]
        assert got == loop_idt(x, y, 40.0, 1.0, 5)


@pytest.mark.parametrize("method", ["ivt", "idt"])
def test_synthetic_fixations(spark, method):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(500):
        x = 500.0 if i < 200 else 500 + (i - 199) * 15 if i < 220 else 800.0 if i < 420 else float("nan")
        rows.append(("a", i, float(i), x + rng.normal(0, 0.05), float("nan") if math.isnan(x) else 500 + rng.normal(0, 0.05), 1000.0))
    gf = table(spark, rows, "recording_id string, sample_idx long, time double, gxL double, gyL double, paL double", meta=RecordingMeta(source="tobii", sample_rate=1000.0))
    got = D.detect_events(gf, method, "left")
    f = R.fixations(got).orderBy("sttime").collect()
    assert len(f) >= 2 and 490 < f[0].gavx < 510 and 499 < f[0].gavy < 501 and abs(f[0].ava - 1000) < 1e-6
    assert R.saccades(got).count() >= 1
    assert [(r.sttime, r.duration) for r in R.blinks(got).collect()] == [(420.0, 80.0)]
    assert "model_in_fix" in D.detect_events(gf, method, "left", prefix="model").df.columns
    with pytest.raises(ValueError):
        D.detect_events(gf, "other")


def test_event_columns(spark):
    x = [1.0, None, 3.0, 5.0, 9.0, None, None]
    lab = ["fixation"] * 3 + ["saccade"] * 3 + ["fixation"]
    rows = [("a", i, float(i), x[i], x[i], None if i == 2 else 10.0, float(i), lab[i]) for i in range(7)]
    df = D.event_columns(spark.createDataFrame(rows, "recording_id string, sample_idx long, time double, gx double, gy double, pa double, v double, l string"), "l", "gx", "gy", "pa", "v", 2.0, 1000.0)
    r = df.orderBy("sample_idx").collect()
    assert (r[0].fix_gavx, r[0].fix_ava, r[0].fix_dur, r[2].in_fix) == (2.0, 5.0, 3, True)  # a missing pupil still divides
    assert (r[4].sacc_gstx, r[4].sacc_genx, r[5].sacc_dur, r[3].sacc_pvel) == (5.0, 9.0, 3, 5.0) and abs(r[3].sacc_ampl - math.sqrt(32) / 2) < 1e-12
    assert r[6].in_fix and r[6].fix_gavx is None and r[6].fix_dur == 0


def loop_microsaccades(x, y, lam, least, most, ppd):
    n = len(x)
    vx, vy = np.full(n, np.nan), np.full(n, np.nan)
    for i in range(2, n - 2):
        near = [x[i - 2], x[i - 1], x[i + 1], x[i + 2]]
        if not any(map(math.isnan, near)):
            vx[i] = (near[3] + near[2] - near[1] - near[0]) / 6
            vy[i] = (y[i + 2] + y[i + 1] - y[i - 1] - y[i - 2]) / 6
    hit = np.zeros(n, bool)
    if n < 5 or np.sum(~np.isnan(vx)) < 10:
        return hit
    s = [max(math.sqrt(max(0.0, np.nanmedian(v**2) - np.nanmedian(v) ** 2)), 1e-10) for v in (vx, vy)]
    above = (vx / (lam * s[0])) ** 2 + (vy / (lam * s[1])) ** 2 > 1
    i = 0
    while i < n:
        if not above[i]:
            i += 1
            continue
        j = i
        while j < n and above[j]:
            j += 1
        ampl = math.hypot(x[j - 1] - x[i], y[j - 1] - y[i])
        if j - i >= least and not ampl / ppd > most:
            hit[i:j] = True
        i = j
    return hit


def test_microsaccades(spark):
    gf, own = signals(spark)
    got = D.detect_microsaccades(gf, "left", lam=2.0, min_duration_ms=2, max_amplitude=5.0)
    for rid, (x, y, _, _) in own.items():
        want = np.concatenate([loop_microsaccades(x[a : a + 80], y[a : a + 80], 2.0, 2, 5.0, gf.meta.ppd) for a in (0, 80)])
        assert column(got, F.col("in_msacc").cast("int"), rid).astype(bool).tolist() == want.tolist() and want.any()


# -------------------------------------------------------------------------------------------------------------- signal


def loop_gaps(v, longest):
    out, i, n = v.copy(), 0, len(v)
    while i < n:
        if not math.isnan(v[i]):
            i += 1
            continue
        j = i
        while j < n and math.isnan(v[j]):
            j += 1
        if j - i <= longest and i > 0 and j < n:
            for k in range(i, j):
                out[k] = v[i - 1] + (k - i + 1) / (j - i + 1) * (v[j] - v[i - 1])
        i = j
    return out


def loop_linear(pa, blink, margin):
    n, wide = len(pa), np.zeros(len(pa), bool)
    for i in np.flatnonzero(blink):
        wide[max(0, i - margin) : i + margin + 1] = True
    out, i = pa.copy(), 0
    while i < n:
        if not wide[i]:
            i += 1
            continue
        j = i
        while j < n and wide[j]:
            j += 1
        a, b = pa[i - 1] if i else np.nan, pa[j] if j < n else np.nan
        for k in range(i, j):
            if not math.isnan(a) and not math.isnan(b):
                out[k] = a + (k - i) / max(j - i - 1, 1) * (b - a)
            elif not math.isnan(a):
                out[k] = a
            elif not math.isnan(b):
                out[k] = b
        i = j
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_signal_loops(spark, parts):
    gf, own = signals(spark, parts=parts)
    gaps, n = X.interpolate_gaps(gf, 2.0, "left")
    lin, cub = X.interpolate_blinks(gf, 2, "linear", "left"), X.interpolate_blinks(gf, 2, "cubic", "left")
    smooth = X.smooth_pupil(gf, 7, "left")
    slow, m = X.velocity_filter(gf, 150.0, "left")
    near, _ = X.outlier_filter(gf, (400, 600, 350, 450), 20, "left")
    counts = {r.recording_id: (r.gaps, r.filled) for r in n.collect()}
    for rid, (x, y, p, b) in own.items():
        want = loop_gaps(x, 2)
        assert np.allclose(column(gaps, "gxL", rid), want, equal_nan=True) and np.allclose(column(gaps, "gyL", rid), loop_gaps(y, 2), equal_nan=True)
        assert counts[rid][1] == int(np.sum(np.isnan(x) & ~np.isnan(want))) >= counts[rid][0] > 0
        assert np.allclose(column(lin, "paL", rid), loop_linear(p, b, 2), equal_nan=True)
        assert np.allclose(column(cub, "paL", rid), X.cubic_bridge(p, b, 2), equal_nan=True)
        h = 3
        mean = [np.nanmean(w) if not np.isnan(w := p[max(0, i - h) : i + h + 1]).all() else np.nan for i in range(len(p))]
        assert np.allclose(column(smooth, "paL", rid), mean, equal_nan=True)
        fast = np.nan_to_num(loop_velocity(x, y, gf.meta.ppd, 1000.0), nan=0) > 150
        assert np.allclose(column(slow, "gxL", rid), np.where(fast, np.nan, x), equal_nan=True)
        far = ~np.isnan(x) & ((x < 380) | (x > 620) | (y < 330) | (y > 470))
        assert np.allclose(column(near, "gyL", rid), np.where(far, np.nan, y), equal_nan=True)
    assert sum(r.removed for r in m.collect()) > 0
    with pytest.raises(ValueError):
        X.interpolate_blinks(gf, method="other")


def test_cubic_bridge():
    p = np.array([0.0, 1.0, np.nan, np.nan, 4.0, 5.0])
    out = X.cubic_bridge(p, np.array([0, 0, 1, 1, 0, 0], bool), 0)
    assert out[2] == 1.0 and out[3] == 4.0  # the ends of a span are the values beside it
    assert X.cubic_bridge(np.array([np.nan, np.nan, 3.0]), np.array([1, 1, 0], bool), 0).tolist() == [3.0, 3.0, 3.0]


def test_baseline_drift_and_times(spark):
    rows = [("a", i, float(i), None if i == 9 else 1 + i // 5, float(i), 10.0 + i, 100.0 + i, "go; x" if i in (2, 7) else "", i in (1, 2), 3.0 if i in (1, 2) else None, 4.0 if i in (1, 2) else None) for i in range(10)]
    gf = table(spark, rows, "recording_id string, sample_idx long, time double, trial long, gxL double, gyL double, paL double, message string, in_fix boolean, fix_gavx double, fix_gavy double")
    rel = X.with_time_rel(gf, "go")
    assert column(rel, "time_rel", "a").tolist()[:9] == [-2, -1, 0, 1, 2, -2, -1, 0, 1]
    sub = X.baseline_correct_pupil(rel, (-2, -1), eye="left")
    assert column(sub, "paL", "a").tolist() == [-0.5, 0.5, 1.5, 2.5, 3.5, -0.5, 0.5, 1.5, 2.5, 109.0]
    pct = X.baseline_correct_pupil(rel, (-2, -1), "percent", "left")
    assert abs(column(pct, "paL", "a")[4] - (104 - 100.5) / 100.5 * 100) < 1e-9
    z = X.baseline_correct_pupil(rel, (-2, -2), "zscore", "left")
    assert np.isnan(column(z, "paL", "a")[:9]).all()  # one sample has no deviation
    d = X.drift_correct(gf, (1, 2), eye="left")
    assert column(d, "gxL", "a").tolist() == [-2, -1, 0, 1, 2, 5, 6, 7, 8, 9]
    w = X.drift_correct(gf, (0, 0), use_first_fixation=False, window_ms=2, eye="left")
    assert column(w, "gxL", "a").tolist() == [-0.5, 0.5, 1.5, 2.5, 3.5, -0.5, 0.5, 1.5, 2.5, 9]
    assert abs(column(X.to_center_coords(gf), "gxL", "a")[0] + 960 / gf.meta.ppd) < 1e-9
    with pytest.raises(ValueError):
        X.baseline_correct_pupil(gf)
    back = rel.with_df(rel.df.withColumn("time_rel", F.when(F.col("trial") == 1, -F.col("time_rel")).otherwise(F.col("time_rel"))))
    assert column(X.monotone_time(back), "plot_time", "a").tolist()[:7] == [0, 1, 2, 3, 4, -2, -1]


# ------------------------------------------------------------------------------------------------------------- metrics


def fixation_rows(spark):
    """Fixations in A, A and B, outside, B, A; of 10 samples each with a gap between; one trial without any."""
    seq = [(20, 20), (50, 50), (500, 500), (80, 80), (20, 20)]
    rows, i = [], 0
    for x, y in seq:
        for k in range(10):
            rows.append(("a", i, 100.0 + i, 1, float(x), float(y), True, float(x), float(y), 10))
            i += 1
        for k in range(2):
            rows.append(("a", i, 100.0 + i, 1, None, None, False, None, None, 0))
            i += 1
    rows += [("a", i + k, 100.0 + i + k, 2, 1.0, 1.0, False, None, None, 0) for k in range(3)]
    return table(spark, rows, "recording_id string, sample_idx long, time double, trial long, gxL double, gyL double, in_fix boolean, fix_gavx double, fix_gavy double, fix_dur int")


AB = [Rect("A", 30, 30, 60, 60), Rect("B", 70, 70, 60, 60)]


def test_aoi_and_fixation_metrics(spark):
    gf = fixation_rows(spark)
    m = {(r.trial, r.aoi): r for r in M.aoi_metrics(gf, AB, eye="left").collect()}
    a, b = m[1, "A"], m[1, "B"]
    assert (a.dwell_time_ms, a.fixation_count, a.first_fixation_time_ms, a.first_fixation_duration_ms, a.entry_count) == (30.0, 3, 0.0, 10.0, 3)
    assert (b.dwell_time_ms, b.fixation_count, b.first_fixation_time_ms, b.entry_count) == (20.0, 2, 12.0, 2)  # overlapping areas count twice
    assert (m[2, "A"].fixation_count, m[2, "A"].first_fixation_time_ms, m[2, "A"].entry_count) == (0, None, 1)
    w = {r.aoi: r for r in M.aoi_metrics(gf.select(1), AB, eye="left", window=(5, 50)).collect()}
    assert (w["A"].dwell_time_ms, w["A"].first_fixation_time_ms, w["A"].first_fixation_duration_ms, w["A"].fixation_count) == (18.0, 5.0, 5.0, 3)
    bare = gf.with_df(gf.df.drop("in_fix", "fix_gavx", "fix_gavy", "fix_dur"))
    assert {r.aoi: r.first_fixation_time_ms for r in M.aoi_metrics(bare.select(1), AB, eye="left").collect()} == {"A": 0.0, "B": 12.0}
    f = {(r.trial, r.aoi): r for r in M.fixation_metrics(gf, AB).collect()}
    assert (f[1, "A"].gaze_duration, f[1, "A"].total_time, f[1, "A"].fixation_count, f[1, "A"].revisits, f[1, "A"].first_fixation_onset) == (20.0, 30.0, 3, 1, 0.0)
    assert (f[1, "B"].gaze_duration, f[1, "B"].fixation_count, f[1, "B"].revisits, f[1, "B"].first_fixation_onset) == (10.0, 1, 0, 36.0)
    assert f[2, "A"].skipped and f[2, "A"].total_time == 0.0 and f[2, "A"].first_fixation_duration is None
    assert {r.aoi: r.dwell_ms for r in M.dwell_totals(gf, AB, eye="left").collect()} == {"A": 33.0, "B": 20.0}
    t = {(r.from_aoi, r.to_aoi): r.value for r in Q.transitions(gf, AB, normalize=False).collect()}
    assert t == {("A", "A"): 1.0, ("A", "B"): 0.0, ("B", "A"): 1.0, ("B", "B"): 0.0}  # the one outside breaks a pair
    assert Q.transition_entropy(Q.transitions(gf, AB, normalize=False)).first().entropy == 1.0
    assert Q.aoi_sequence(gf, AB).first().sequence == "AABA"
    s = Q.scanpath_similarity(gf, AB, None, 1).first()
    assert (s.distance, s.similarity) == (0, 1.0)
    assert Q.scanpath_similarity(gf, AB, 2, 2).first().similarity == 1.0
    looks = {r.time_bin: r for r in C.proportion_of_looks(gf.select(1), AB, 30, eye="left").collect()}
    assert (looks[15.0].A, looks[15.0].outside) == (20 / 26, 6 / 26)
    with pytest.raises(ValueError):
        Q.aoi_sequence(gf, AB * 14)


def test_saccade_and_pupil_metrics(spark):
    x = [0.0, 10.0, 20.0, None, 40.0]
    y = [0.0, 3.0, 0.0, None, 0.0]
    rows = [("a", i, float(i), 1, x[i], y[i], 5.0 if i in (1, 4) else 1.0, True, 0.5, 100.0) for i in range(5)] + [("a", 9, 9.0, 1, 1.0, 1.0, None, True, 0.1, 1.0), ("a", 7, 7.0, 1, 1.0, 1.0, None, False, None, None)]
    gf = table(spark, rows, "recording_id string, sample_idx long, time double, trial long, gxL double, gyL double, paL double, in_sacc boolean, sacc_ampl double, sacc_pvel double")
    s = M.saccade_metrics(gf, eye="left").collect()
    assert len(s) == 1 and (s[0].saccade_idx, s[0].duration, s[0].end_x, s[0].max_curvature_px, s[0].curvature_ratio, s[0].amplitude_deg) == (1, 5.0, 40.0, 3.0, 0.075, 0.5)
    assert M.saccade_metrics(gf, eye="left", window=(1, 9)).count() == 0
    p = M.pupil_peak_metrics(gf, eye="left").first()
    assert (p.max_pupil, p.max_pupil_time, p.time_to_peak, p.min_pupil, p.mean_pupil) == (5.0, 1.0, 1.0, 1.0, 2.6)  # the first of equal peaks
    assert M.pupil_peak_metrics(gf, eye="left", window=(50, 60)).first().mean_pupil is None
    v = R.saccade_vectors(gf.with_df(gf.df.withColumns({"sacc_gstx": F.lit(0.0), "sacc_gsty": F.lit(0.0), "sacc_genx": F.lit(0.0), "sacc_geny": F.lit(-5.0)}))).first()
    assert v.angle == 0.0 and v.amplitude == 5.0  # up


def test_quality_exclusion_and_summary(spark):
    rows = [("a", i, float(i), None if i > 17 else 1 + i // 9, None if i < 7 else 1.0, 2.0, i in (3, 4, 6)) for i in range(20)]
    gf = table(spark, rows, "recording_id string, sample_idx long, time double, trial long, gxL double, paL double, in_blink boolean")
    q = {r.trial: r for r in M.data_quality(gf, "left").collect()}
    assert (q[1].total_samples, q[1].valid_samples, q[1].tracking_loss_pct, q[1].blink_count, q[1].blink_rate, q[1].duration_ms) == (9, 2, 77.8, 2, 222.22, 9.0)
    kept, bad, report = M.exclude_trials(gf, 50.0, eye="left")
    assert [r.trial for r in bad.collect()] == [1] and kept.df.count() == 11  # rows without a trial stay
    assert tuple(report.first()) == (2, 1, 1)
    s = M.recording_summary(gf).first()
    assert (s.n_samples, s.n_trials, s.n_blinks) == (20, 2, 2)
    g = M.group_summary(gf, eye="left")
    assert {r.trial: r.n_blinks for r in g.collect()} == {1: 2, 2: 0}


def test_time_courses_and_growth(spark):
    gf, own = signals(spark)
    t = C.time_bin(gf, 20, "pupil", eye="left", group_by=["recording_id"])
    x, y, p, b = own["r1"]
    want = {20 * k + 10.0: np.nanmean(p[20 * k : 20 * k + 20]) for k in range(8)}
    assert all(abs(r.value - want[r.time_bin]) < 1e-9 for r in t.where("recording_id = 'r1'").collect())
    with pytest.raises(ValueError):
        C.time_bin(gf, 20, "velocity")
    g = C.growth_curve_data(t, degree=3)
    m = np.array([[r.ot1, r.ot2, r.ot3] for r in g.where("recording_id = 'r1'").orderBy("time_bin").collect()])
    assert np.allclose(m.T @ m, np.eye(3)) and np.allclose(m.mean(0), 0)
    d = C.prepare_analysis_data(gf, ("pupil", "gaze_x"), eye="left", group_by=["recording_id"])
    assert d.where("recording_id = 'r1'").count() == int(np.sum(~np.isnan(p) & ~np.isnan(x)))
    assert d.where("recording_id = 'r1'").agg(F.max("sample")).first()[0] <= 160


def test_grid(spark):
    rows = [("a", i, float(i), float(i % 10) * 10, 5.0) for i in range(40)] + [("a", 50, 50.0, 100.0, 5.0), ("a", 51, 51.0, -1.0, 5.0), ("a", 52, 52.0, None, 1.0)]
    gf = table(spark, rows, "recording_id string, sample_idx long, time double, gxL double, gyL double")
    h = G.heatmap(gf, (5, 2), bounds=(0, 100, 0, 10), eye="left")
    assert G.to_matrix(h, (5, 2))[:, 1].tolist() == [8.0] * 5 and h.count() == 10  # the last edge is outside
    assert abs(G.heatmap(gf, (5, 2), "proportion", (0, 100, 0, 10), eye="left").agg(F.sum("value")).first()[0] - 1) < 1e-12
    s = G.to_matrix(G.gaussian_smooth(h, 1.0, (5, 2)), (5, 2))
    k = np.array([w for _, w in G.gaussian_kernel(1.0)])
    pad = np.pad(G.to_matrix(h, (5, 2)), ((3, 3), (3, 3)), "edge")
    want = np.array([[(k[:, None] * k[None, :] * pad[i : i + 7, j : j + 7]).sum() for j in range(2)] for i in range(5)])
    assert np.allclose(s, want) and G.gaussian_smooth(h, 0, (5, 2)) is h


# ---------------------------------------------------------------------------------------------------------- annotation


def test_joins(spark):
    s = spark.createDataFrame([("a", i, float(10 * i), "") for i in range(12)], "recording_id string, sample_idx long, time double, message string")
    e = spark.createDataFrame([("a", 0, 5, 45, 1.0), ("a", 1, 30, 60, 2.0), ("a", 2, 90, 80, 3.0), ("a", 3, 70, 7000, 4.0)], "recording_id string, event_seq long, sttime long, entime long, v double")
    got = A.stamp_events(s, e, "on", {"v": "v"}, 100, bucket_ms=16).orderBy("sample_idx").collect()
    assert [r.v for r in got] == [None, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0] + [None] * 5 and [r.on for r in got] == [r.v is not None for r in got]
    m = spark.createDataFrame([("a", 0, 20, "p"), ("a", 1, 20, "q"), ("a", 2, 25, "lost"), ("a", 3, 999, "late")], "recording_id string, event_seq long, sttime long, message string")
    assert {r.sample_idx: r.message for r in A.attach_messages(s, m).collect() if r.message} == {2: "p; q"}
    assert {r.sample_idx: r.message for r in A.attach_messages(s, m, nearest_after=True).collect() if r.message} == {2: "p; q", 3: "lost"}


def test_variables(spark):
    msgs = ["!V TRIAL_VAR cond a b", "!V TRIAL_VAR item 1", " !V TRIAL_VAR cond  c ", "!V TRIAL_VAR", "!V TRIAL_VAR cond d", "other"]
    ev = spark.createDataFrame([("r", i, i * 10, 24, m) for i, m in enumerate(msgs)], "recording_id string, event_seq long, sttime long, type short, message string")
    v = A.parse_variables(ev).orderBy("event_seq").collect()
    assert [(r.variable, r.value) for r in v] == [("cond", "a b"), ("item", "1"), ("cond", " c"), ("", ""), ("cond", "d")]
    t = A.trial_table(A.parse_variables(ev), None, ["cond", "item"]).orderBy("trial").collect()
    assert [(r.trial, r.cond, r["item"]) for r in t] == [(1, "a b", "1"), (2, "c", ""), (3, "d", "")]
    t = A.trial_table(A.parse_variables(ev), "item", ["cond"]).collect()
    assert [(r.trial, r.trial_label, r.cond) for r in t] == [(1, "1", "d")]


def test_stimuli(spark):
    n = spark.createDataFrame([("A.png",), ("cat.JPG",), ("none",)], "file string")
    s = spark.createDataFrame([("A.png", "1"), ("a.gif", "2"), ("CAT.png", "3")], "name string, content string")
    assert {r.file: r.stimulus for r in A.match_stimuli(n, s).collect()} == {"A.png": "1", "cat.JPG": "3", "none": None}


def test_messages_to_the_next_sample_in_long_recordings(spark):
    """the time grows with a recording's rows, not with their square."""
    import time

    from gazeframe.operators.annotate import attach_messages

    n = 40_000
    samples = spark.range(n).selectExpr("'r' as recording_id", "id as sample_idx", "cast(id * 2 as double) as time", "'' as message")
    asked = spark.range(n).selectExpr("'r' as recording_id", "id as event_seq", "id * 2 + 1 as sttime", "cast(id as string) as message")
    began = time.perf_counter()
    got = {r.sample_idx: r.message for r in attach_messages(samples, asked, nearest_after=True).collect()}
    assert time.perf_counter() - began < 30
    assert len(got) == n and got[0] == "" and all(got[k] == str(k - 1) for k in range(1, n))
