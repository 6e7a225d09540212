"""The registered queries of the library's operators over the plain tables, and SQL for the same rows.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame
from gazeframe.functions.aoi import first_match
from gazeframe.functions.numeric import deg_to_px, px_to_deg, rj, segment_distance
from gazeframe.operators import annotate as A
from gazeframe.operators import detect as D
from gazeframe.operators import grid as G
from gazeframe.operators import metrics as M
from gazeframe.operators import plotdata as P
from gazeframe.operators import runs as R
from gazeframe.operators import sequence as Q
from gazeframe.operators import signal as X
from gazeframe.operators import timecourse as C
from gazeframe.plans.samples import AREAS, SAMPLES_SQL, VELOCITY_SQL, area_sql, events_samples, first_area_sql, frame, runs_sql, stamp_sql, stamped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LABEL = "CASE WHEN in_fix THEN 'fixation' WHEN in_sacc THEN 'saccade' ELSE 'noise' END"
_STAMPED = f"{SAMPLES_SQL}, {VELOCITY_SQL}, {stamp_sql('t', 'v', _LABEL)}"
_K = "recording_id, trial"
_W = "(PARTITION BY recording_id, trial ORDER BY sample_idx)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return rj(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def _r6(c: str) -> str:
    return f"round_even(({c}) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE"


def _rj(c: str, d: int) -> str:
    return f"round_even(({c}) * {10.0**d}::DOUBLE, 0) / {10.0**d}::DOUBLE"


def _on(flag: str, w: str = _W) -> str:
    return f"(coalesce({flag}, false) AND NOT coalesce(lag(coalesce({flag}, false)) OVER {w}, false))"


# ------------------------------------------------------------------------------------------------------------- metrics


@query("a01_counts", f"WITH {SAMPLES_SQL}, o AS (SELECT *, {_on('in_fix')} AS o FROM s) SELECT {_K}, sum(o::INT)::BIGINT AS n FROM o GROUP BY {_K}")
def a01(spark, d):
    return R.counts(frame(spark, d), "in_fix")


@query(
    "a02_data_quality",
    f"""WITH {SAMPLES_SQL}, o AS (SELECT *, {_on("in_blink")} AS o FROM s)
SELECT {_K}, count(*)::BIGINT AS total_samples, count(gx)::BIGINT AS valid_samples, {_rj("(count(*) - count(gx)) / count(*) * 100.0::DOUBLE", 1)} AS tracking_loss_pct, sum(o::INT)::BIGINT AS blink_count,
  {_rj("sum(o::INT)::DOUBLE * 60.0::DOUBLE / count(*)", 2)} AS blink_rate, {_rj("avg(pa)", 1)} AS mean_pupil, round_even(count(*) / 60.0::DOUBLE * 1000.0::DOUBLE, 0) AS duration_ms FROM o GROUP BY {_K}""",
)
def a02(spark, d):
    return M.data_quality(frame(spark, d), "left")


@query(
    "a03_group_summary",
    f"""WITH {_STAMPED}, o AS (SELECT *, {_on("in_fix")} AND fix_gavx IS NOT NULL AS f, {_on("in_sacc")} AND sacc_pvel IS NOT NULL AS sc, {_on("in_blink")} AS b FROM t)
SELECT {_K}, sum(f::INT)::BIGINT AS n_fixations, {_rj("avg(fix_dur::DOUBLE) FILTER (WHERE f)", 1)} AS mean_fix_dur, {_rj("median(fix_dur::DOUBLE) FILTER (WHERE f)", 1)} AS median_fix_dur, sum(sc::INT)::BIGINT AS n_saccades,
  {_rj("avg(sacc_ampl) FILTER (WHERE sc)", 2)} AS mean_sacc_ampl, {_rj("avg(sacc_pvel) FILTER (WHERE sc)", 1)} AS mean_sacc_pvel, sum(b::INT)::BIGINT AS n_blinks, {_rj("avg(pa)", 1)} AS mean_pupil,
  {_rj("(count(*) - count(gx)) / count(*) * 100.0::DOUBLE", 1)} AS tracking_loss_pct FROM o GROUP BY {_K}""",
)
def a03(spark, d):
    return M.group_summary(stamped(spark, d), eye="left")


#: Two days, cut out of the samples' time since the start.
_WINDOW = (86_400_000.0, 259_200_000.0)


def _aoi_metrics_sql(window) -> str:
    s, e = window or (None, None)
    inside = f"_t BETWEEN {s}::DOUBLE AND {e}::DOUBLE" if window else "true"
    kept = f"_t + fix_dur > {s} AND _t < {e} AND least(_t + fix_dur, {e}::DOUBLE) - greatest(_t, {s}::DOUBLE) > 0" if window else "true"
    t, dur = (f"greatest(_t, {s}::DOUBLE)", f"least(_t + fix_dur, {e}::DOUBLE) - greatest(_t, {s}::DOUBLE)") if window else ("_t", "(_t + fix_dur) - _t")
    parts = []
    for a in AREAS:
        parts.append(
            f"""SELECT {_K}, '{a.name}' AS aoi, {_rj("sum((_in AND " + area_sql(a.name) + ")::INT) / 60.0::DOUBLE * 1000.0::DOUBLE", 1)} AS dwell_time_ms, count(*) FILTER (WHERE _f AND {area_sql(a.name, "fix_gavx", "fix_gavy")})::BIGINT AS fixation_count,
 {_rj(f"arg_min({t}, sample_idx) FILTER (WHERE _f AND {area_sql(a.name, 'fix_gavx', 'fix_gavy')})", 1)} AS first_fixation_time_ms, {_rj(f"arg_min({dur}, sample_idx) FILTER (WHERE _f AND {area_sql(a.name, 'fix_gavx', 'fix_gavy')})", 1)} AS first_fixation_duration_ms,
 coalesce((SELECT sum(({area_sql(a.name)} AND NOT coalesce(p, false))::INT) FROM (SELECT gx, gy, lag({area_sql(a.name)}) OVER (ORDER BY sample_idx) AS p FROM q q2 WHERE q2.recording_id = q.recording_id AND q2.trial = q.trial AND _in)), 0)::BIGINT AS entry_count FROM q GROUP BY {_K}"""
        )
    parts = [p.split("\n coalesce((SELECT")[0] for p in parts]  # entries come from a table of their own
    entries = " UNION ALL ".join(f"SELECT {_K}, '{a.name}' AS aoi, sum(({area_sql(a.name)} AND NOT p)::INT)::BIGINT AS entry_count FROM (SELECT *, coalesce(lag({area_sql(a.name)}) OVER {_W}, false) AS p FROM q WHERE _in) GROUP BY {_K}" for a in AREAS)
    return f"""WITH {_STAMPED}, q0 AS (SELECT *, time - first_value(time) OVER {_W} AS _t, {_on("in_fix")} AND fix_gavx IS NOT NULL AND fix_gavy IS NOT NULL AS _o FROM t),
q AS (SELECT *, {inside} AS _in, _o AND {kept} AS _f FROM q0), m AS ({" UNION ALL ".join(p.rstrip().rstrip(",") + f" FROM q GROUP BY {_K}" for p in parts)}), n AS ({entries})
SELECT m.recording_id, m.trial, m.aoi, dwell_time_ms, fixation_count, first_fixation_time_ms, first_fixation_duration_ms, coalesce(entry_count, 0)::BIGINT AS entry_count FROM m LEFT JOIN n ON m.recording_id = n.recording_id AND m.trial = n.trial AND m.aoi = n.aoi"""


@query("a04_aoi_metrics", _aoi_metrics_sql(None))
def a04(spark, d):
    return M.aoi_metrics(stamped(spark, d), AREAS, eye="left")


@query("a04_aoi_metrics_window", _aoi_metrics_sql(_WINDOW))
def a04w(spark, d):
    return M.aoi_metrics(stamped(spark, d), AREAS, eye="left", window=_WINDOW)


def _fix_sql(window, keys: str = _K) -> str:
    """Labelled fixations: x (keys, sample_idx, onset, dur, area)."""
    w = f"(PARTITION BY {keys} ORDER BY sample_idx)"
    s, e = window or (None, None)
    t, dur = (f"greatest(_t, {s}::DOUBLE)", f"least(_t + fix_dur, {e}::DOUBLE) - greatest(_t, {s}::DOUBLE)") if window else ("_t", "(_t + fix_dur) - _t")
    kept = f"AND _t + fix_dur > {s} AND _t < {e} AND {dur} > 0" if window else ""
    return f"""{_STAMPED}, x0 AS (SELECT *, time - first_value(time) OVER {w} AS _t, {_on("in_fix", w)} AND fix_gavx IS NOT NULL AS _o FROM t),
x AS (SELECT {keys}, sample_idx, {t} AS onset, {dur} AS dur, {first_area_sql("fix_gavx", "fix_gavy")} AS area FROM x0 WHERE _o {kept})"""


def _fixation_metrics_sql(window) -> str:
    names = ", ".join(f"({k + 1}, '{a.name}')" for k, a in enumerate(AREAS))
    return f"""WITH {_fix_sql(window)}, {runs_sql("y", "x", "area", _K)}, vs AS (SELECT {_K}, area, _run, sum(dur) AS d, count(*) AS n, min(sample_idx) AS i, arg_min(onset, sample_idx) AS o, arg_min(dur, sample_idx) AS fd FROM y WHERE area > 0 GROUP BY {_K}, area, _run),
g AS (SELECT {_K}, area, arg_min(fd, i) AS fd, arg_min(o, i) AS o, arg_min(d, _run) AS gaze, sum(d) AS total, sum(n) AS n, count(*) AS nv FROM vs GROUP BY {_K}, area),
e AS (SELECT DISTINCT {_K} FROM t), a(k, aoi) AS (VALUES {names})
SELECT e.recording_id, e.trial, aoi, {_r6("fd")} AS first_fixation_duration, {_r6("o")} AS first_fixation_onset, {_r6("gaze")} AS gaze_duration, {_r6("coalesce(total, 0.0::DOUBLE)")} AS total_time, coalesce(n, 0)::BIGINT AS fixation_count,
  greatest(coalesce(nv, 0) - 1, 0)::BIGINT AS revisits, n IS NULL AS skipped FROM e CROSS JOIN a LEFT JOIN g ON e.recording_id = g.recording_id AND e.trial = g.trial AND a.k = g.area"""


@query("a05_fixation_metrics", _fixation_metrics_sql(None))
def a05(spark, d):
    return rounded(M.fixation_metrics(stamped(spark, d), AREAS), "first_fixation_duration", "first_fixation_onset", "gaze_duration", "total_time")


@query("a05_fixation_metrics_window", _fixation_metrics_sql(_WINDOW))
def a05w(spark, d):
    return rounded(M.fixation_metrics(stamped(spark, d), AREAS, window=_WINDOW), "first_fixation_duration", "first_fixation_onset", "gaze_duration", "total_time")


#: Saccades over the rows that aren't purchases, so that runs are long enough to have curvature.
def _long_saccades(spark, d) -> GazeFrame:
    gf = frame(spark, d)
    gf = gf.with_df(gf.df.withColumn("in_fix", F.col("message") == "purchase").withColumn("in_sacc", F.col("message").isin("view", "click", "error")))
    label = F.when(F.col("in_fix"), "fixation").when(F.col("in_sacc"), "saccade").otherwise("noise")
    df = gf.df.withColumn("_label", label).withColumn("_vel", D.velocity("gxL", "gyL", 40.0, 60.0))
    return gf.with_df(D.event_columns(df, "_label", "gxL", "gyL", "paL", "_vel", 40.0, 60.0).drop("_label", "_vel"))


_LONG_LABEL = "CASE WHEN message = 'purchase' THEN 'fixation' WHEN message IN ('view', 'click', 'error') THEN 'saccade' ELSE 'noise' END"
_LONG = f"{SAMPLES_SQL}, {VELOCITY_SQL}, {stamp_sql('t', 'v', _LONG_LABEL)}"


@query(
    "a06_saccade_metrics",
    f"""WITH {_LONG}, {runs_sql("r", "t", "in_sacc", _K)}, p AS (SELECT *, time - first_value(time) OVER {_W} AS _t FROM r), q AS (SELECT * FROM p WHERE in_sacc),
e AS (SELECT *, arg_min(gx, sample_idx) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) OVER o AS xs, arg_min(gy, sample_idx) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) OVER o AS ys,
  arg_max(gx, sample_idx) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) OVER o AS xe, arg_max(gy, sample_idx) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) OVER o AS ye FROM q WINDOW o AS (PARTITION BY {_K}, _run)),
l AS (SELECT *, sqrt((xe - xs) * (xe - xs) + (ye - ys) * (ye - ys)) AS px FROM e),
g AS (SELECT {_K}, _run, count(*) AS n, count(*) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) AS ok, min(sample_idx) AS i, arg_min(_t, sample_idx) AS t, min(xs) AS xs, min(ys) AS ys, min(xe) AS xe, min(ye) AS ye, min(px) AS px,
  max(CASE WHEN px > 1e-6 THEN abs((xe - xs) * (ys - gy) - (xs - gx) * (ye - ys)) / px ELSE 0.0::DOUBLE END) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) AS cu,
  arg_min(sacc_ampl, sample_idx) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) AS am, arg_min(sacc_pvel, sample_idx) FILTER (WHERE gx IS NOT NULL AND gy IS NOT NULL) AS pv FROM l GROUP BY {_K}, _run)
SELECT {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY i)::INT AS saccade_idx, {_rj("n * (1000.0::DOUBLE / 60.0::DOUBLE)", 2)} AS duration, {_rj("xs", 2)} AS start_x, {_rj("ys", 2)} AS start_y, {_rj("xe", 2)} AS end_x, {_rj("ye", 2)} AS end_y,
  {_rj("am", 4)} AS amplitude_deg, {_rj("pv", 4)} AS peak_velocity, {_rj("cu", 4)} AS max_curvature_px, {_rj("CASE WHEN px > 1e-6 THEN cu / px ELSE 0.0::DOUBLE END", 4)} AS curvature_ratio FROM g WHERE ok >= 2""",
)
def a06(spark, d):
    return M.saccade_metrics(_long_saccades(spark, d), eye="left")


@query(
    "a07_pupil_peak_metrics",
    f"""WITH {SAMPLES_SQL}, q AS (SELECT *, time - first_value(time) OVER {_W} AS _t FROM s), e AS (SELECT DISTINCT {_K} FROM s), v AS (SELECT * FROM q WHERE pa IS NOT NULL AND _t BETWEEN {_WINDOW[0]}::DOUBLE AND {_WINDOW[1]}::DOUBLE),
k AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY pa DESC, sample_idx) AS r FROM v)
SELECT e.recording_id, e.trial, {_rj("avg(pa)", 4)} AS mean_pupil, {_rj("max(pa)", 4)} AS max_pupil, {_rj("min(pa)", 4)} AS min_pupil, {_rj("min(_t) FILTER (WHERE r = 1)", 1)} AS max_pupil_time, {_rj(f"min(_t) FILTER (WHERE r = 1) - {_WINDOW[0]}::DOUBLE", 1)} AS time_to_peak
FROM e LEFT JOIN k ON e.recording_id = k.recording_id AND e.trial = k.trial GROUP BY e.recording_id, e.trial""",
)
def a07(spark, d):
    return M.pupil_peak_metrics(frame(spark, d), eye="left", window=_WINDOW)


_BIN = 86_400_000.0


@query(
    "a08_time_bin",
    f"""WITH {SAMPLES_SQL}, q AS (SELECT *, time - first_value(time) OVER {_W} AS _t FROM s)
SELECT {_K}, floor(_t / {_BIN}::DOUBLE) * {_BIN}::DOUBLE + {_BIN / 2}::DOUBLE AS time_bin, {_r6("avg(pa)")} AS value, count(pa)::BIGINT AS n FROM q WHERE pa IS NOT NULL GROUP BY ALL""",
)
def a08(spark, d):
    return rounded(C.time_bin(frame(spark, d), _BIN, "pupil", eye="left"), "value")


@query(
    "a09_proportion_of_looks",
    f"""WITH {SAMPLES_SQL}, q AS (SELECT *, time - first_value(time) OVER {_W} AS _t, {first_area_sql("gx", "gy")} AS area FROM s)
SELECT {_K}, floor(_t / {_BIN}::DOUBLE) * {_BIN}::DOUBLE + {_BIN / 2}::DOUBLE AS time_bin, {", ".join(f"{_r6(f'avg((area = {k + 1})::INT)')} AS {a.name}" for k, a in enumerate(AREAS))}, {_r6("avg((area = 0)::INT)")} AS outside
FROM q WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY {_K}, 3""",
)
def a09(spark, d):
    return rounded(C.proportion_of_looks(frame(spark, d), AREAS, _BIN, eye="left"), *(a.name for a in AREAS), "outside")


_BAD = f"""{SAMPLES_SQL}, o AS (SELECT *, {_on("in_blink")} AS o FROM s), g AS (SELECT {_K}, {_rj("(count(*) - count(gx)) / count(*) * 100.0::DOUBLE", 1)} AS loss, sum(o::INT) AS b FROM o GROUP BY {_K}), bad AS (SELECT * FROM g WHERE loss > 25.0 OR b > 12)"""


@query("a10_exclude_trials", f"WITH {_BAD} SELECT recording_id, count(*)::BIGINT AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.recording_id = s.recording_id AND bad.trial = s.trial) GROUP BY recording_id")
def a10(spark, d):
    kept = M.exclude_trials(frame(spark, d), 25.0, max_blink_count=12, eye="left")[0]
    return kept.df.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))


@query("a10_exclusion_report", f"WITH {_BAD} SELECT (SELECT count(*) FROM g)::BIGINT AS n_before, (SELECT count(*) FROM bad)::BIGINT AS n_excluded, ((SELECT count(*) FROM g) - (SELECT count(*) FROM bad))::BIGINT AS n_after")
def a10r(spark, d):
    return M.exclude_trials(frame(spark, d), 25.0, max_blink_count=12, eye="left")[2]


def _noted(spark, d) -> GazeFrame:
    gf = frame(spark, d)
    note = F.when(F.col("sample_idx") % 7 == 0, F.concat(F.col("message"), F.lit(" "), (F.col("sample_idx") % 50).cast("string"), F.lit("; start "))).when(F.col("sample_idx") % 7 == 1, F.lit("")).otherwise(F.col("message"))
    return gf.with_df(gf.df.withColumn("message", note))


_NOTED = f"{SAMPLES_SQL}, u AS (SELECT * EXCLUDE (message), CASE WHEN sample_idx % 7 = 0 THEN message || ' ' || (sample_idx % 50)::VARCHAR || '; start ' WHEN sample_idx % 7 = 1 THEN '' ELSE message END AS message FROM s), m AS (SELECT recording_id, time, trim(unnest(string_split(message, '; '))) AS message FROM u WHERE message <> '')"


@query("w05_messages", f"WITH {_NOTED} SELECT recording_id, {_r6('time')} AS time, message FROM m WHERE message <> ''")
def w05(spark, d):
    return rounded(A.messages(_noted(spark, d)), "time")


@query(
    "a11_message_summary",
    f"""WITH {_NOTED}, c AS (SELECT message, count(*) AS n, regexp_extract(message, '^(\\S*)', 1) AS w FROM m WHERE message <> '' GROUP BY message), few AS (SELECT count(DISTINCT w) < 0.5 * count(*) AS f FROM c)
SELECT CASE WHEN f THEN w ELSE message END AS message, arg_max(c.message, lpad(length(c.message)::VARCHAR, 9, '0') || c.message) AS example, sum(n)::BIGINT AS count FROM c, few GROUP BY 1""",
)
def a11(spark, d):
    return A.message_summary(_noted(spark, d))


_HEAT = "WITH {body}, p AS (SELECT floor({x} * 20 / 1920.0::DOUBLE)::INT AS xi, floor({y} * 12 / 1080.0::DOUBLE)::INT AS yi, count(*) AS n FROM {table} WHERE {x} >= 0 AND {x} < 1920 AND {y} >= 0 AND {y} < 1080 GROUP BY ALL), g AS (SELECT x::INT AS xi, y::INT AS yi FROM range(20) a(x), range(12) b(y)) SELECT g.xi, g.yi, {value} AS value FROM g LEFT JOIN p ON g.xi = p.xi AND g.yi = p.yi"
_FIXPOINTS = f"{_STAMPED}, {runs_sql('z', 't', 'in_fix')}, fp AS (SELECT recording_id, _run, arg_min(fix_gavx, sample_idx) AS x, arg_min(fix_gavy, sample_idx) AS y FROM z WHERE in_fix GROUP BY recording_id, _run)"


def _heat(metric: str):
    if metric == "count":
        sql = _HEAT.format(body=_FIXPOINTS, x="x", y="y", table="fp", value="coalesce(n, 0)::DOUBLE")
    else:
        value = {"samples": "coalesce(n, 0)::DOUBLE", "dwell": _r6("coalesce(n, 0) / 60.0::DOUBLE * 1000.0::DOUBLE"), "proportion": _r6("coalesce(n, 0) / (SELECT sum(n) FROM p)::DOUBLE")}[metric]
        sql = _HEAT.format(body=SAMPLES_SQL, x="gx", y="gy", table="s", value=value)

    @query(f"a12_heatmap_{metric}", sql)
    def f(spark, d):
        gf = stamped(spark, d) if metric == "count" else frame(spark, d)
        return rounded(G.heatmap(gf, (20, 12), metric, eye="left"), "value")


for _m in ("samples", "dwell", "count", "proportion"):
    _heat(_m)

_KERNEL = G.gaussian_kernel(1.2)


@query(
    "c08_gaussian_smooth",
    "WITH h AS ("
    + _HEAT.format(body=SAMPLES_SQL, x="gx", y="gy", table="s", value="coalesce(n, 0)::DOUBLE")
    + f"), k(k, w) AS (VALUES {', '.join(f'({k}, {w!r}::DOUBLE)' for k, w in _KERNEL)}), a AS (SELECT h.xi, h.yi, sum(w * v.value) AS value FROM h CROSS JOIN k JOIN h v ON v.xi = least(greatest(h.xi + k, 0), 19) AND v.yi = h.yi GROUP BY ALL) SELECT a.xi, a.yi, {_r6('sum(w * v.value)')} AS value FROM a CROSS JOIN k JOIN a v ON v.yi = least(greatest(a.yi + k, 0), 11) AND v.xi = a.xi GROUP BY a.xi, a.yi",
)
def c08(spark, d):
    return rounded(G.gaussian_smooth(G.heatmap(frame(spark, d), (20, 12), eye="left"), 1.2, (20, 12)), "value")


@query("a13_dwell_totals", f"WITH {SAMPLES_SQL} " + " UNION ALL ".join(f"SELECT '{a.name}' AS aoi, {_r6(f'sum({area_sql(a.name)}::INT) / 60.0::DOUBLE * 1000.0::DOUBLE')} AS dwell_ms FROM s" for a in AREAS))
def a13(spark, d):
    return rounded(M.dwell_totals(frame(spark, d), AREAS, eye="left"), "dwell_ms")


_VECTORS = f"""{_LONG}, {runs_sql("r", "t", "in_sacc", _K)}, b AS (SELECT {_K}, _run, arg_min(sacc_gstx, sample_idx) AS x1, arg_min(sacc_gsty, sample_idx) AS y1, arg_min(sacc_genx, sample_idx) AS x2, arg_min(sacc_geny, sample_idx) AS y2, min(sample_idx) AS start_idx FROM r WHERE in_sacc GROUP BY {_K}, _run),
vec AS (SELECT {_K}, x1, y1, x2, y2, start_idx, atan2(x2 - x1, y1 - y2) AS angle, sqrt((x2 - x1) * (x2 - x1) + (y1 - y2) * (y1 - y2)) AS amplitude FROM b WHERE x1 IS NOT NULL AND y1 IS NOT NULL)"""


@query("w12_saccade_vectors", f"WITH {_VECTORS} SELECT {_K}, {', '.join(_r6(c) + ' AS ' + c for c in ('x1', 'y1', 'x2', 'y2', 'angle', 'amplitude'))}, start_idx FROM vec")
def w12s(spark, d):
    return rounded(R.saccade_vectors(_long_saccades(spark, d)), "x1", "y1", "x2", "y2", "angle", "amplitude")


@query("a14_direction_histogram", f"WITH {_VECTORS}, h AS (SELECT floor((angle + pi()) / (2 * pi() / 36))::INT AS bin, count(*)::BIGINT AS n FROM vec GROUP BY 1) SELECT bin, n FROM h WHERE bin BETWEEN 0 AND 35")
def a14(spark, d):
    return M.direction_histogram(R.saccade_vectors(_long_saccades(spark, d)))


_WR = "(PARTITION BY recording_id ORDER BY sample_idx)"


@query(
    "a15_recording_summary",
    f"WITH {SAMPLES_SQL}, o AS (SELECT *, {_on('in_fix', _WR)} AS f, {_on('in_sacc', _WR)} AS sa, {_on('in_blink', _WR)} AS b FROM s) SELECT recording_id, count(*)::BIGINT AS n_samples, {_r6('count(*) / 60.0::DOUBLE / 60.0::DOUBLE')} AS minutes, count(DISTINCT trial)::BIGINT AS n_trials, sum(f::INT)::BIGINT AS n_fixations, sum(sa::INT)::BIGINT AS n_saccades, sum(b::INT)::BIGINT AS n_blinks FROM o GROUP BY recording_id",
)
def a15(spark, d):
    return rounded(M.recording_summary(frame(spark, d)), "minutes")


# -------------------------------------------------------------------------------------------- selections and predicates


@query("p01_selection", f"WITH {SAMPLES_SQL} SELECT trial, count(*)::BIGINT AS n FROM s WHERE message IN ('view', 'error') AND trial BETWEEN 3 AND 40 GROUP BY trial")
def p01(spark, d):
    return frame(spark, d).select({"message": ["view", "error"], "trial": range(3, 41)}).df.groupBy("trial").agg(F.count(F.lit(1)).alias("n"))


@query("p10_first_match", f"WITH {SAMPLES_SQL} SELECT {first_area_sql('gx', 'gy')} AS area, count(*)::BIGINT AS n FROM s GROUP BY 1")
def p10(spark, d):
    return frame(spark, d).df.groupBy(first_match(AREAS, F.col("gxL"), F.col("gyL")).alias("area")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_area_membership", f"WITH {SAMPLES_SQL} " + " UNION ALL ".join(f"SELECT '{a.name}' AS aoi, count(*)::BIGINT AS n FROM s WHERE {area_sql(a.name)}" for a in AREAS))
def p11(spark, d):
    return M.area_membership(frame(spark, d), AREAS, "left")


for _a in AREAS:

    def _area_query(a):
        @query(f"p{ {'Rect': '06', 'Circle': '07', 'Ellipse': '08', 'Polygon': '09'}[type(a).__name__] }_in_{type(a).__name__.lower()}", f"WITH {SAMPLES_SQL} SELECT recording_id, sum({area_sql(a.name)}::INT)::BIGINT AS n FROM s GROUP BY recording_id")
        def f(spark, d):
            return frame(spark, d).df.groupBy("recording_id").agg(F.sum(a.contains(F.col("gxL"), F.col("gyL")).cast("long")).alias("n"))

    _area_query(_a)


@query("p13_variables", f"WITH {SAMPLES_SQL} SELECT {_K}, arg_min('c' || (sample_idx % 3)::VARCHAR, sample_idx) AS cond FROM s GROUP BY {_K}")
def p13(spark, d):
    gf = frame(spark, d)
    return A.variables(gf.with_df(gf.df.withColumn("cond", F.concat(F.lit("c"), (F.col("sample_idx") % 3).cast("string"))))).select("recording_id", "trial", "cond")


@query("p15_segments", f"WITH {SAMPLES_SQL} SELECT DISTINCT trial FROM s WHERE trial IS NOT NULL")
def p15(spark, d):
    return M.trial_keys(frame(spark, d))


# ------------------------------------------------------------------------------------------------------ runs and events


@query("w01_contiguous_runs", f"WITH {SAMPLES_SQL}, {runs_sql('r', 's', 'in_fix')} SELECT recording_id, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx, count(*)::BIGINT AS n FROM r WHERE in_fix GROUP BY recording_id, _run HAVING count(*) >= 2")
def w01(spark, d):
    return R.contiguous_runs(frame(spark, d).df, F.col("in_fix"), min_len=2)


def _event_sql(flag: str, dur: str, cols: dict[str, str]) -> str:
    return f"WITH {_STAMPED}, {runs_sql('z', 't', flag)} SELECT recording_id, {_r6('arg_min(time, sample_idx)')} AS sttime, {_r6('arg_max(time, sample_idx)')} AS entime, {dur} AS duration{''.join(f', {_r6(f'arg_min({c}, sample_idx)')} AS {n}' for n, c in cols.items())} FROM z WHERE {flag} GROUP BY recording_id, _run"


_FIX = {"gavx": "fix_gavx", "gavy": "fix_gavy", "ava": "fix_ava"}
_SACC = {"gstx": "sacc_gstx", "gsty": "sacc_gsty", "genx": "sacc_genx", "geny": "sacc_geny", "ampl": "sacc_ampl", "pvel": "sacc_pvel"}


@query("w02_fixations", _event_sql("in_fix", "arg_min(fix_dur, sample_idx)::DOUBLE", _FIX))
def w02(spark, d):
    return rounded(R.fixations(stamped(spark, d)), "sttime", "entime", *_FIX)


@query("w03_saccades", _event_sql("in_sacc", "arg_min(sacc_dur, sample_idx)::DOUBLE", _SACC))
def w03(spark, d):
    return rounded(R.saccades(stamped(spark, d)), "sttime", "entime", *_SACC)


@query("w04_blinks", _event_sql("in_blink", "round_even(arg_max(time, sample_idx) - arg_min(time, sample_idx) + 1, 0)", {}))
def w04(spark, d):
    return rounded(R.blinks(frame(spark, d)), "sttime", "entime")


@query("w06_velocity", f"WITH {SAMPLES_SQL}, {VELOCITY_SQL} SELECT recording_id, sample_idx, {_r6('vel')} AS vel FROM v")
def w06(spark, d):
    return frame(spark, d).df.withColumn("vel", r6(D.velocity("gxL", "gyL", 40.0, 60.0))).select("recording_id", "sample_idx", "vel")


_IVT = (600.0, 2, 3)
_IVT_SQL = f"""{SAMPLES_SQL}, {VELOCITY_SQL}, l0 AS (SELECT *, CASE WHEN vel IS NULL THEN 'noise' WHEN vel < {_IVT[0]} THEN 'fixation' ELSE 'saccade' END AS raw FROM v), {runs_sql("l1", "l0", "raw")},
l2 AS (SELECT recording_id, _run, min(raw) AS raw, count(*) AS n FROM l1 GROUP BY recording_id, _run), l3 AS (SELECT *, lag(raw) OVER w AS b, lead(raw) OVER w AS a FROM l2 WINDOW w AS (PARTITION BY recording_id ORDER BY _run)),
l4 AS (SELECT l1.* EXCLUDE (_run), CASE WHEN l1.raw = 'saccade' AND n < {_IVT[2]} AND b = 'fixation' AND a = 'fixation' THEN 'fixation' ELSE l1.raw END AS merged FROM l1 JOIN l3 USING (recording_id, _run)), {runs_sql("l5", "l4", "merged")},
iv AS (SELECT * EXCLUDE (_run), CASE WHEN merged = 'fixation' AND count(*) OVER (PARTITION BY recording_id, _run) < {_IVT[1]} THEN 'noise' ELSE merged END AS label FROM l5)"""


@query("w07_ivt_labels", f"WITH {_IVT_SQL} SELECT recording_id, sample_idx, label FROM iv")
def w07(spark, d):
    df = frame(spark, d).df.withColumn("vel", D.velocity("gxL", "gyL", 40.0, 60.0))
    return D.ivt_labels(df, "vel", *_IVT).select("recording_id", "sample_idx", "label")


@query(
    "w08_idt_labels",
    f"""WITH RECURSIVE {SAMPLES_SQL}, r AS (SELECT *, gx IS NOT NULL AND gy IS NOT NULL AS ok, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) - 1 AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM s),
p AS (SELECT a.recording_id, a.k AS i, b.k AS j, a.n, b.ok, count(*) FILTER (WHERE b.ok) OVER w AS c, ((max(b.gx) FILTER (WHERE b.ok) OVER w - min(b.gx) FILTER (WHERE b.ok) OVER w) + max(b.gy) FILTER (WHERE b.ok) OVER w - min(b.gy) FILTER (WHERE b.ok) OVER w) / 40.0::DOUBLE AS spread
  FROM r a JOIN r b ON a.recording_id = b.recording_id AND b.k >= a.k WHERE a.ok AND a.k + 3 <= a.n WINDOW w AS (PARTITION BY a.recording_id, a.k ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT recording_id, i, n, min(j) AS j FROM p WHERE c = 3 AND ok GROUP BY ALL), good AS (SELECT o.* FROM o JOIN p USING (recording_id, i, j) WHERE p.spread <= 30),
stop AS (SELECT good.recording_id, good.i, arg_min(CASE WHEN p.ok THEN p.j - 1 ELSE p.j END, p.j) AS e FROM good JOIN p ON p.recording_id = good.recording_id AND p.i = good.i AND p.j > good.j AND (NOT p.ok OR p.spread > 30) GROUP BY ALL),
win AS (SELECT good.recording_id, good.i, coalesce(e, n - 1) AS e FROM good LEFT JOIN stop USING (recording_id, i)), nxt AS (SELECT r.recording_id, r.k, win.e FROM r LEFT JOIN win ON win.recording_id = r.recording_id AND win.i = r.k),
walk AS (SELECT recording_id, k, e FROM nxt WHERE k = 0 UNION ALL SELECT nxt.recording_id, nxt.k, nxt.e FROM walk JOIN nxt ON nxt.recording_id = walk.recording_id AND nxt.k = coalesce(walk.e, walk.k) + 1)
SELECT r.recording_id, r.sample_idx, CASE WHEN max(walk.k) IS NOT NULL THEN 'fixation' ELSE 'saccade' END AS label FROM r LEFT JOIN walk ON walk.recording_id = r.recording_id AND r.k BETWEEN walk.k AND walk.e GROUP BY r.recording_id, r.sample_idx""",
)
def w08(spark, d):
    return D.idt_labels(frame(spark, d).df, "gxL", "gyL", 40.0, 30.0, 3).select("recording_id", "sample_idx", "label")


_EVENT_COLS = ("fix_gavx", "fix_gavy", "fix_ava", "sacc_gstx", "sacc_gsty", "sacc_genx", "sacc_geny", "sacc_ampl", "sacc_pvel")
_EVENT_SELECT = f"recording_id, sample_idx, in_fix, fix_dur, in_sacc, sacc_dur, {', '.join(_r6(c) + ' AS ' + c for c in _EVENT_COLS)}"


@query("w09_detect_events", f"WITH {_IVT_SQL}, {stamp_sql('t', 'iv', 'label')} SELECT {_EVENT_SELECT} FROM t")
def w09(spark, d):
    gf = frame(spark, d)
    got = D.detect_events(gf, "ivt", "left", velocity_threshold=_IVT[0], min_fixation_ms=1000 * _IVT[1] / 60, min_saccade_ms=1000 * _IVT[2] / 60, pixels_per_degree=40.0)
    return rounded(got.df.select("recording_id", "sample_idx", "in_fix", "fix_dur", "in_sacc", "sacc_dur", *_EVENT_COLS), *_EVENT_COLS)


@query(
    "w10_nan_blinks",
    f"WITH {SAMPLES_SQL}, {runs_sql('r', 's', 'gx IS NULL')}, n AS (SELECT *, count(*) OVER (PARTITION BY recording_id, _run) AS n FROM r) SELECT recording_id, sample_idx, gx IS NULL AND n >= 2 AS in_blink, CASE WHEN gx IS NULL AND n >= 2 THEN round_even(n / 60.0::DOUBLE * 1000.0::DOUBLE, 0)::INT ELSE 0 END AS blink_dur FROM n",
)
def w10(spark, d):
    return D.nan_blinks(frame(spark, d).df, "gxL", 60.0, 33.3).select("recording_id", "sample_idx", "in_blink", "blink_dur")


@query(
    "w11_microsaccades",
    f"""WITH {SAMPLES_SQL}, a AS (SELECT *, count(*) OVER (PARTITION BY {_K}) AS n, (lead(gx, 2) OVER w + lead(gx, 1) OVER w - lag(gx, 1) OVER w - lag(gx, 2) OVER w) / 6.0 AS vx, (lead(gy, 2) OVER w + lead(gy, 1) OVER w - lag(gy, 1) OVER w - lag(gy, 2) OVER w) / 6.0 AS vy0 FROM s WINDOW w AS {_W}),
b AS (SELECT *, CASE WHEN vx IS NOT NULL THEN vy0 END AS vy FROM a),
c AS (SELECT *, count(vx) OVER g AS ok, greatest(sqrt(greatest(0.0::DOUBLE, median(vx * vx) OVER g - median(vx) OVER g * median(vx) OVER g)), 1e-10::DOUBLE) AS sx, greatest(sqrt(greatest(0.0::DOUBLE, median(vy * vy) OVER g - median(vy) OVER g * median(vy) OVER g)), 1e-10::DOUBLE) AS sy FROM b WINDOW g AS (PARTITION BY {_K})),
e AS (SELECT *, coalesce(n >= 5 AND ok >= 10 AND (vx / (1.5 * sx)) * (vx / (1.5 * sx)) + (vy / (1.5 * sy)) * (vy / (1.5 * sy)) > 1.0, false) AS above FROM c), {runs_sql("f", "e", "above", _K)},
h AS (SELECT *, last_value(gx) OVER o - first_value(gx) OVER o AS dx, last_value(gy) OVER o - first_value(gy) OVER o AS dy, count(*) OVER o AS len, max(sqrt(vx * vx + vy * vy)) OVER o AS pv FROM f WINDOW o AS (PARTITION BY {_K}, _run ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, above AND len >= 2 AND coalesce(sqrt(dx * dx + dy * dy) / 40.286285291135876::DOUBLE <= 20.0, true) AS hit FROM h)
SELECT recording_id, sample_idx, hit AS in_msacc, {_r6("CASE WHEN hit THEN dx END")} AS msacc_dx, {_r6("CASE WHEN hit THEN dy END")} AS msacc_dy, {_r6("CASE WHEN hit THEN sqrt(dx * dx + dy * dy) END")} AS msacc_ampl, {_r6("CASE WHEN hit THEN coalesce(pv, 0.0) END")} AS msacc_pvel FROM k""",
)
def w11(spark, d):
    got = D.detect_microsaccades(frame(spark, d), "left", lam=1.5, min_duration_ms=33.3, max_amplitude=20.0).df
    return rounded(got.select("recording_id", "sample_idx", "in_msacc", "msacc_dx", "msacc_dy", "msacc_ampl", "msacc_pvel"), "msacc_dx", "msacc_dy", "msacc_ampl", "msacc_pvel")


@query(
    "w12_fixation_list",
    f"WITH {_STAMPED}, {runs_sql('z', 't', 'in_fix', _K)}, g AS (SELECT {_K}, arg_min(fix_gavx, sample_idx) AS x, arg_min(fix_gavy, sample_idx) AS y, arg_min(fix_dur, sample_idx)::DOUBLE AS dur, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx FROM z WHERE in_fix GROUP BY {_K}, _run) SELECT {_K}, {_r6('x')} AS x, {_r6('y')} AS y, dur, start_idx, end_idx, row_number() OVER (PARTITION BY {_K} ORDER BY start_idx)::INT AS ordinal FROM g WHERE x IS NOT NULL AND y IS NOT NULL",
)
def w12f(spark, d):
    return rounded(R.fixation_list(stamped(spark, d)), "x", "y")


@query("w24_intervals", f"WITH {SAMPLES_SQL}, {runs_sql('r', 's', 'in_blink', _K)} SELECT {_K}, {_r6('arg_min(time, sample_idx)')} AS t_start, {_r6('arg_max(time, sample_idx)')} AS t_stop FROM r WHERE in_blink GROUP BY {_K}, _run")
def w24(spark, d):
    return rounded(R.intervals(frame(spark, d), "in_blink"), "t_start", "t_stop")


# --------------------------------------------------------------------------------------------------------------- signal


@query("w13_velocity_filter", f"WITH {SAMPLES_SQL}, {VELOCITY_SQL.replace('40.0::DOUBLE', '40.286285291135876::DOUBLE')} SELECT recording_id, sample_idx, CASE WHEN coalesce(vel > 700.0, false) THEN NULL ELSE gx END AS gx, CASE WHEN coalesce(vel > 700.0, false) THEN NULL ELSE gy END AS gy FROM v")
def w13(spark, d):
    return X.velocity_filter(frame(spark, d), 700.0, "left")[0].df.select("recording_id", "sample_idx", F.col("gxL").alias("gx"), F.col("gyL").alias("gy"))


@query("w13_velocity_filter_count", f"WITH {SAMPLES_SQL}, {VELOCITY_SQL.replace('40.0::DOUBLE', '40.286285291135876::DOUBLE')} SELECT recording_id, sum(coalesce(vel > 700.0, false)::INT)::BIGINT AS removed FROM v GROUP BY recording_id")
def w13n(spark, d):
    return X.velocity_filter(frame(spark, d), 700.0, "left")[1]


_FAR = "gx IS NOT NULL AND (gx < 250 OR gx > 1550 OR coalesce(gy < 250 OR gy > 850, false))"


@query("w14_outlier_filter", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, CASE WHEN {_FAR} THEN NULL ELSE gx END AS gx, CASE WHEN {_FAR} THEN NULL ELSE gy END AS gy FROM s")
def w14(spark, d):
    return X.outlier_filter(frame(spark, d), (300, 1500, 300, 800), 50, "left")[0].df.select("recording_id", "sample_idx", F.col("gxL").alias("gx"), F.col("gyL").alias("gy"))


def _gap_sql(c: str, n: int) -> str:
    return f"""{runs_sql(f"g{c}", "s", f"{c} IS NULL")}, f{c} AS (SELECT *, last_value({c} IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value({c} IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q,
 count(*) OVER (PARTITION BY recording_id, _run) AS n, row_number() OVER (PARTITION BY recording_id, _run ORDER BY sample_idx) AS j FROM g{c}),
o{c} AS (SELECT recording_id, sample_idx, CASE WHEN {c} IS NULL AND n <= {n} AND p IS NOT NULL AND q IS NOT NULL THEN p + j / (n + 1)::DOUBLE * (q - p) ELSE {c} END AS {c} FROM f{c})"""


@query("w15_interpolate_gaps", f"WITH {SAMPLES_SQL}, {_gap_sql('gx', 2)}, {_gap_sql('gy', 2)} SELECT recording_id, sample_idx, {_r6('gx')} AS gx, {_r6('gy')} AS gy FROM ogx JOIN ogy USING (recording_id, sample_idx)")
def w15(spark, d):
    got = X.interpolate_gaps(frame(spark, d), 33.3, "left")[0].df
    return got.select("recording_id", "sample_idx", r6("gxL").alias("gx"), r6("gyL").alias("gy"))


@query(
    "w16_interpolate_blinks",
    f"""WITH {SAMPLES_SQL}, m AS (SELECT *, max(in_blink::INT) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS ext, lag(pa) OVER {_WR} AS pre, lead(pa) OVER {_WR} AS post FROM s), {runs_sql("r", "m", "ext")},
b AS (SELECT *, count(*) OVER o AS n, row_number() OVER (PARTITION BY recording_id, _run ORDER BY sample_idx) - 1 AS k, first_value(pre) OVER w AS a, last_value(post) OVER w AS z FROM r WINDOW o AS (PARTITION BY recording_id, _run), w AS (PARTITION BY recording_id, _run ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT recording_id, sample_idx, {_r6("CASE WHEN ext THEN coalesce(a + k / greatest(n - 1, 1)::DOUBLE * (z - a), a, z, pa) ELSE pa END")} AS pa FROM b""",
)
def w16(spark, d):
    return X.interpolate_blinks(frame(spark, d), 16.7, "linear", "left").df.select("recording_id", "sample_idx", r6("paL").alias("pa"))


_PER = "PARTITION BY recording_id ORDER BY k"


@query(
    "w16_interpolate_blinks_cubic",
    f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS k, max(in_blink::INT) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS wide FROM s),
{runs_sql("u", "r", "wide")}, b AS (SELECT recording_id, _run, min(k) AS f, max(k) AS l, max(k) - min(k) + 1 AS size FROM u WHERE wide GROUP BY ALL),
an AS (SELECT b.*, p.pa AS a, q.pa AS z FROM b LEFT JOIN r p ON p.recording_id = b.recording_id AND p.k = f - 1 LEFT JOIN r q ON q.recording_id = b.recording_id AND q.k = l + 1),
h AS (SELECT u.recording_id, u.k, u.pa, CASE WHEN an.f IS NULL THEN u.pa ELSE coalesce(z, a, u.pa) END AS v FROM u LEFT JOIN an ON u.wide AND an.recording_id = u.recording_id AND an._run = u._run),
sl AS (SELECT recording_id, k, coalesce((pa - last_value(v IGNORE NULLS) OVER b) / (k - last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b), 0) AS down,
  coalesce((first_value(pa IGNORE NULLS) OVER a - pa) / (first_value(CASE WHEN pa IS NOT NULL THEN k END IGNORE NULLS) OVER a - k), 0) AS up
  FROM h WINDOW b AS ({_PER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({_PER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT an.*, coalesce(p.down, 0) * size AS m0, coalesce(q.up, 0) * size AS m1 FROM an LEFT JOIN sl p ON p.recording_id = an.recording_id AND p.k = f - 1 LEFT JOIN sl q ON q.recording_id = an.recording_id AND q.k = l + 1),
t AS (SELECT u.recording_id, u.sample_idx, u.pa, c.*, (u.k - f) / greatest(size - 1, 1)::DOUBLE AS x FROM u LEFT JOIN c ON u.wide AND c.recording_id = u.recording_id AND c._run = u._run)
SELECT recording_id, sample_idx, {_r6("CASE WHEN f IS NULL OR a IS NULL AND z IS NULL THEN pa WHEN a IS NULL THEN z WHEN z IS NULL THEN a ELSE (2 * x * x * x - 3 * x * x + 1) * a + (x * x * x - 2 * x * x + x) * m0 + (3 * x * x - 2 * x * x * x) * z + (x * x * x - x * x) * m1 END")} AS pa FROM t""",
)
def w16c(spark, d):
    return X.interpolate_blinks(frame(spark, d), 16.7, "cubic", "left").df.select("recording_id", "sample_idx", r6("paL").alias("pa"))


@query("w17_smooth_pupil", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, {_r6('avg(pa) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS pa FROM s")
def w17(spark, d):
    return X.smooth_pupil(frame(spark, d), 80, "left").df.select("recording_id", "sample_idx", r6("paL").alias("pa"))


def _relative(spark, d) -> GazeFrame:
    return X.with_time_rel(frame(spark, d), "purchase")


_REL = f"{SAMPLES_SQL}, q AS (SELECT *, time - arg_min(time, sample_idx) FILTER (WHERE list_contains(string_split(message, '; '), 'purchase')) OVER (PARTITION BY {_K}) AS time_rel FROM s)"
_BASE = "time_rel BETWEEN -864000000.0::DOUBLE AND 864000000.0::DOUBLE"


@query("w21_time_rel", f"WITH {_REL} SELECT recording_id, sample_idx, {_r6('time_rel')} AS time_rel FROM q")
def w21(spark, d):
    return _relative(spark, d).df.select("recording_id", "sample_idx", r6("time_rel").alias("time_rel"))


def _baseline(method: str, value: str):
    @query(
        f"w18_baseline_{method}",
        f"WITH {_REL}, b AS (SELECT *, count(pa) FILTER (WHERE {_BASE}) OVER g AS n, avg(pa) FILTER (WHERE {_BASE}) OVER g AS m, stddev_samp(pa) FILTER (WHERE {_BASE}) OVER g AS sd FROM q WINDOW g AS (PARTITION BY {_K})) SELECT recording_id, sample_idx, {_r6(value)} AS pa FROM b",
    )
    def f(spark, d):
        got = X.baseline_correct_pupil(_relative(spark, d), (-864e6, 864e6), method, "left").df
        return got.select("recording_id", "sample_idx", r6("paL").alias("pa"))


_baseline("subtractive", "CASE WHEN n > 0 THEN pa - m ELSE pa END")
_baseline("percent", "CASE WHEN n > 0 AND m <> 0 THEN (pa - m) / m * 100.0::DOUBLE ELSE pa END")
_baseline("zscore", "CASE WHEN n > 0 AND coalesce(sd <> 0, true) THEN (pa - m) / sd ELSE pa END")


@query("w19_drift_correct", f"WITH {_STAMPED}, o AS (SELECT *, arg_min(fix_gavx, sample_idx) FILTER (WHERE in_fix AND fix_gavx IS NOT NULL AND fix_gavy IS NOT NULL) OVER g AS x, arg_min(fix_gavy, sample_idx) FILTER (WHERE in_fix AND fix_gavx IS NOT NULL AND fix_gavy IS NOT NULL) OVER g AS y FROM t WINDOW g AS (PARTITION BY {_K})) SELECT recording_id, sample_idx, {_r6('gx - coalesce(x - 640.0::DOUBLE, 0)')} AS gx, {_r6('gy - coalesce(y - 480.0::DOUBLE, 0)')} AS gy FROM o")
def w19(spark, d):
    return X.drift_correct(stamped(spark, d), eye="left").df.select("recording_id", "sample_idx", r6("gxL").alias("gx"), r6("gyL").alias("gy"))


@query("w19_drift_correct_window", f"WITH {SAMPLES_SQL}, k AS (SELECT *, row_number() OVER {_W} AS k FROM s), o AS (SELECT *, avg(gx) FILTER (WHERE k <= 12 AND gx IS NOT NULL AND gy IS NOT NULL) OVER g AS x, avg(gy) FILTER (WHERE k <= 12 AND gx IS NOT NULL AND gy IS NOT NULL) OVER g AS y FROM k WINDOW g AS (PARTITION BY {_K})) SELECT recording_id, sample_idx, {_r6('gx - coalesce(x - 640.0::DOUBLE, 0)')} AS gx, {_r6('gy - coalesce(y - 480.0::DOUBLE, 0)')} AS gy FROM o")
def w19w(spark, d):
    return X.drift_correct(frame(spark, d), use_first_fixation=False, eye="left").df.select("recording_id", "sample_idx", r6("gxL").alias("gx"), r6("gyL").alias("gy"))


@query("w20_center_coords", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, {_r6('(gx - 960) / 40.286285291135876::DOUBLE')} AS gx, {_r6('(gy - 540) / 40.286285291135876::DOUBLE')} AS gy FROM s")
def w20(spark, d):
    return X.to_center_coords(frame(spark, d)).df.select("recording_id", "sample_idx", r6("gxL").alias("gx"), r6("gyL").alias("gy"))


@query("w22_monotone_time", f"WITH {_REL}, b AS (SELECT *, CASE WHEN trial % 2 = 0 THEN -time_rel ELSE time_rel END AS tr FROM q), l AS (SELECT *, coalesce(tr < lag(tr) OVER {_W}, false) AS back, time - first_value(time) OVER {_W} AS since FROM b) SELECT recording_id, sample_idx, {_r6(f'CASE WHEN bool_or(back) OVER (PARTITION BY {_K}) THEN since WHEN count(tr) OVER (PARTITION BY {_K}) > 0 THEN tr ELSE since END')} AS plot_time FROM l")
def w22(spark, d):
    gf = _relative(spark, d)
    gf = gf.with_df(gf.df.withColumn("time_rel", F.when(F.col("trial") % 2 == 0, -F.col("time_rel")).otherwise(F.col("time_rel"))))
    return X.monotone_time(gf).df.select("recording_id", "sample_idx", r6("plot_time").alias("plot_time"))


# ------------------------------------------------------------------------------------------------- sequences, statistics


def _transition_sql(value: str) -> str:
    names = ", ".join(f"({k + 1}, '{a.name}')" for k, a in enumerate(AREAS))
    return f"""{_fix_sql(None, "recording_id")}, p AS (SELECT area, lead(area) OVER {_WR} AS b FROM x), c AS (SELECT area, b, count(*) AS n FROM p WHERE area > 0 AND b > 0 GROUP BY ALL), a(k, aoi) AS (VALUES {names}),
g AS (SELECT f.aoi AS from_aoi, t.aoi AS to_aoi, coalesce(n, 0)::DOUBLE AS n FROM a f CROSS JOIN a t LEFT JOIN c ON c.area = f.k AND c.b = t.k), mx AS (SELECT from_aoi, to_aoi, {value} AS value FROM g)"""


_SHARE = "CASE WHEN sum(n) OVER (PARTITION BY from_aoi) > 0 THEN n / sum(n) OVER (PARTITION BY from_aoi) ELSE 0.0::DOUBLE END"


@query("c01_transition_matrix", f"WITH {_transition_sql(_SHARE)} SELECT from_aoi, to_aoi, {_r6('value')} AS value FROM mx")
def c01(spark, d):
    return rounded(Q.transitions(stamped(spark, d), AREAS), "value")


@query("c01_transition_counts", f"WITH {_transition_sql('n')} SELECT from_aoi, to_aoi, value FROM mx")
def c01n(spark, d):
    return Q.transitions(stamped(spark, d), AREAS, normalize=False)


@query("c02_transition_entropy", f"WITH {_transition_sql('n')}, pe AS (SELECT value / (SELECT sum(value) FROM mx) AS p FROM mx WHERE value > 0) SELECT {_r6('coalesce(-sum(p * log2(p)), 0.0::DOUBLE)')} AS entropy FROM pe")
def c02(spark, d):
    return rounded(Q.transition_entropy(Q.transitions(stamped(spark, d), AREAS, normalize=False)), "entropy")


_SEQ = f"{_fix_sql(None, 'recording_id')}, sq AS (SELECT recording_id, coalesce(string_agg(chr(64 + area), '' ORDER BY sample_idx) FILTER (WHERE area > 0), '') AS sequence FROM x GROUP BY recording_id)"


@query("c03_aoi_sequence", f"WITH {_SEQ} SELECT recording_id, sequence FROM sq")
def c03(spark, d):
    return Q.aoi_sequence(stamped(spark, d), AREAS)


@query("c04_levenshtein", f"WITH {_SEQ} SELECT a.recording_id, levenshtein(a.sequence, b.sequence)::INT AS distance FROM sq a JOIN sq b ON b.recording_id = 'r' || (substr(a.recording_id, 2)::BIGINT + 1)::VARCHAR")
def c04(spark, d):
    a = Q.aoi_sequence(stamped(spark, d), AREAS)
    b = a.select(F.concat(F.lit("r"), (F.expr("cast(substring(recording_id, 2) as bigint)") - 1).cast("string")).alias("recording_id"), F.col("sequence").alias("other"))
    return a.join(b, "recording_id").select("recording_id", F.levenshtein("sequence", "other").alias("distance"))


@query(
    "c05_scanpath_similarity",
    f"WITH {_SEQ}, b AS (SELECT (SELECT sequence FROM sq WHERE recording_id = 'r3') AS sequence1, (SELECT sequence FROM sq WHERE recording_id = 'r5') AS sequence2) SELECT levenshtein(sequence1, sequence2)::INT AS distance, {_rj('1 - levenshtein(sequence1, sequence2) / greatest(length(sequence1), length(sequence2))::DOUBLE', 4)} AS similarity, sequence1, sequence2 FROM b",
)
def c05(spark, d):
    return Q.scanpath_similarity(stamped(spark, d), AREAS, 3, 5)


@query("c06_prepare_analysis_data", f"WITH {SAMPLES_SQL}, q AS (SELECT *, time - first_value(time) OVER {_W} AS _t, row_number() OVER {_W} AS sample FROM s) SELECT {_K}, {_r6('_t')} AS time, sample::INT AS sample, pa AS pupil, gx AS gaze_x, in_fix, in_sacc, in_blink FROM q WHERE pa IS NOT NULL AND gx IS NOT NULL")
def c06(spark, d):
    return rounded(C.prepare_analysis_data(frame(spark, d), ("pupil", "gaze_x"), eye="left"), "time")


def _growth_sql() -> str:
    """Gram and Schmidt over the distinct times, one degree after the other."""
    steps = ["d0 AS (SELECT time_bin, 2 * (time_bin - min(time_bin) OVER ()) / (max(time_bin) OVER () - min(time_bin) OVER ()) - 1 AS x, 1 / sqrt(count(*) OVER ())::DOUBLE AS o0 FROM (SELECT DISTINCT time_bin FROM b))"]
    for k in (1, 2, 3):
        less = " - ".join([f"x ** {k}", *(f"o{m} * sum(x ** {k} * o{m}) OVER ()" for m in range(k))])
        steps.append(f"e{k} AS (SELECT *, {less} AS v FROM d{k - 1}), d{k} AS (SELECT * EXCLUDE (v), v / sqrt(sum(v * v) OVER ()) AS o{k} FROM e{k})")
    return ", ".join(steps)


@query("c07_growth_curve", f"""WITH b AS ({ORACLES["a08_time_bin"]}), {_growth_sql()} SELECT b.*, {", ".join(f"{_r6(f'o{k}')} AS ot{k}" for k in (1, 2, 3))} FROM b JOIN d3 USING (time_bin)""")
def c07(spark, d):
    got = C.growth_curve_data(C.time_bin(frame(spark, d), _BIN, eye="left"), degree=3)
    return rounded(got, "value", "ot1", "ot2", "ot3")


# ----------------------------------------------------------------------------------------------- raw events and messages


def _raw_events(spark, d) -> DataFrame:
    """``events`` as raw messages: variables, areas, screen and images, all from fixed rules."""
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("value").cast("int").cast("string")
    i = F.col("event_id")
    text = (
        F.when(i % 5 == 0, F.concat(F.lit("!V TRIAL_VAR "), F.col("event_type"), F.lit(" "), v, F.lit(" ms")))
        .when(i % 5 == 1, F.concat(F.lit("!V IAREA RECTANGLE 1 "), v, F.lit(" 20 300 "), F.when(i % 10 == 1, v).otherwise(F.lit("x")), F.lit(" big box")))
        .when(i % 5 == 2, F.concat(F.lit("DISPLAY_COORDS 0 0 "), v, F.lit(" 767")))
        .when(i % 5 == 3, F.concat(F.lit("!V IMGLOAD FILL images/"), F.col("event_type"), F.lit(".png")))
        .otherwise(F.lit("note"))
    )
    return e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("recording_id"), i.alias("event_seq"), i.alias("sttime"), F.lit(24).cast("short").alias("type"), text.alias("message"))


_RAW = """ev AS (SELECT 'r' || user_id::VARCHAR AS recording_id, event_id AS event_seq, event_id AS sttime, event_type, trunc(value)::INT::VARCHAR AS v, event_id AS i FROM events),
raw AS (SELECT *, CASE i % 5 WHEN 0 THEN '!V TRIAL_VAR ' || event_type || ' ' || v || ' ms' WHEN 1 THEN '!V IAREA RECTANGLE 1 ' || v || ' 20 300 ' || CASE WHEN i % 10 = 1 THEN v ELSE 'x' END || ' big box' WHEN 2 THEN 'DISPLAY_COORDS 0 0 ' || v || ' 767' WHEN 3 THEN '!V IMGLOAD FILL images/' || event_type || '.png' ELSE 'note' END AS message FROM ev)"""


@query("c09_parse_variables", f"WITH {_RAW} SELECT recording_id, event_seq, sttime, event_type AS variable, v || ' ms' AS value FROM raw WHERE i % 5 = 0")
def c09(spark, d):
    return A.parse_variables(_raw_events(spark, d))


_TRIALS = f"""{_RAW}, tv AS (SELECT *, v || ' ms' AS value, sum((event_type = 'view')::INT) OVER (PARTITION BY recording_id ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS trial FROM raw WHERE i % 5 = 0)"""


@query(
    "c10_trial_table",
    f"""WITH {_TRIALS} SELECT recording_id, trial, min(sttime) AS sttime_min, max(sttime) AS sttime_max, arg_max(value, event_seq) FILTER (WHERE event_type = 'view') AS trial_label,
{", ".join(f"coalesce(arg_max(trim(value), event_seq) FILTER (WHERE event_type = '{c}'), '') AS {c}" for c in ("click", "error", "purchase", "signup"))} FROM tv WHERE trial > 0 GROUP BY recording_id, trial""",
)
def c10(spark, d):
    return A.trial_table(A.parse_variables(_raw_events(spark, d)), "view", ["click", "error", "purchase", "signup"])


_AUTO = ("click", "error", "purchase", "signup", "view")


@query(
    "c10_trial_table_auto",
    f"""WITH RECURSIVE {_RAW}, v AS (SELECT *, v || ' ms' AS value, row_number() OVER (PARTITION BY recording_id ORDER BY event_seq) AS k FROM raw WHERE i % 5 = 0),
f AS (SELECT recording_id, k, 1::BIGINT AS trial, [event_type] AS seen FROM v WHERE k = 1 UNION ALL
  SELECT v.recording_id, v.k, CASE WHEN list_contains(f.seen, v.event_type) THEN f.trial + 1 ELSE f.trial END, CASE WHEN list_contains(f.seen, v.event_type) THEN [v.event_type] ELSE list_append(f.seen, v.event_type) END
  FROM f JOIN v ON v.recording_id = f.recording_id AND v.k = f.k + 1)
SELECT recording_id, trial, min(sttime) AS sttime_min, max(sttime) AS sttime_max, {", ".join(f"coalesce(arg_max(trim(value), event_seq) FILTER (WHERE event_type = '{c}'), '') AS {c}" for c in _AUTO)} FROM v JOIN f USING (recording_id, k) GROUP BY recording_id, trial""",
)
def c10a(spark, d):
    return A.trial_table(A.parse_variables(_raw_events(spark, d)), None, ["click", "error", "purchase", "signup", "view"])


@query("c11_parse_aois", f"WITH {_RAW} SELECT recording_id, sttime, CASE WHEN i % 10 = 1 THEN 1 ELSE 0 END AS aoi_index, CASE WHEN i % 10 = 1 THEN v::INT ELSE 0 END AS left, CASE WHEN i % 10 = 1 THEN 20 ELSE 0 END AS top, CASE WHEN i % 10 = 1 THEN 300 ELSE 0 END AS right, CASE WHEN i % 10 = 1 THEN v::INT ELSE 0 END AS bottom, CASE WHEN i % 10 = 1 THEN 'big box' ELSE '' END AS label FROM raw WHERE i % 5 = 1")
def c11(spark, d):
    return A.parse_aois(_raw_events(spark, d))


@query("c12_screen_size", f"WITH {_RAW} SELECT recording_id, arg_min(v::INT, event_seq) + 1 AS screen_w, 768 AS screen_h FROM raw WHERE i % 5 = 2 GROUP BY recording_id")
def c12(spark, d):
    return A.screen_size(_raw_events(spark, d))


@query("c13_segment_distance", f"WITH {SAMPLES_SQL}, z AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((gx - 100) * 1600 + (gy - 900) * -700) / (1600.0::DOUBLE * 1600 + 700.0::DOUBLE * 700))) AS t FROM s WHERE gx IS NOT NULL AND gy IS NOT NULL) SELECT recording_id, sample_idx, {_r6('sqrt((gx - (100 + t * 1600)) * (gx - (100 + t * 1600)) + (gy - (900 - t * 700)) * (gy - (900 - t * 700)))')} AS distance FROM z")
def c13(spark, d):
    df = frame(spark, d).df.dropna(subset=["gxL", "gyL"])
    return df.select("recording_id", "sample_idx", r6(segment_distance(F.col("gxL"), F.col("gyL"), F.lit(100.0), F.lit(900.0), F.lit(1700.0), F.lit(200.0))).alias("distance"))


@query("c14_image_loads", f"WITH {_RAW} SELECT recording_id, sttime, 'FILL' AS mode, NULL::DOUBLE AS x, NULL::DOUBLE AS y, event_type || '.png' AS file FROM raw WHERE i % 5 = 3")
def c14(spark, d):
    return A.image_loads(_raw_events(spark, d))


# ---------------------------------------------------------------------------------------------------------------- joins

_HOUR = 3_600_000


def _intervals(spark, d) -> DataFrame:
    e = events_samples(spark, d).where(F.col("message") == "purchase")
    st = F.floor(F.col("time"))
    return e.select("recording_id", F.col("sample_idx").alias("event_seq"), st.alias("sttime"), (st + (F.col("sample_idx") % 9 - 1) * 24 * _HOUR).alias("entime"), (F.col("sample_idx") * 1.0).alias("gavx"))


@query(
    "j01_interval_join",
    f"""WITH {SAMPLES_SQL}, e AS (SELECT recording_id AS r, sample_idx AS seq, floor(time)::BIGINT AS st, floor(time)::BIGINT + (sample_idx % 9 - 1) * 24 * {_HOUR} AS en FROM s WHERE message = 'purchase'),
j AS (SELECT recording_id, sample_idx, max(seq) AS seq FROM s JOIN e ON r = recording_id AND en >= st AND en - st <= {144 * _HOUR} AND time >= st AND time <= en GROUP BY ALL) SELECT s.recording_id, s.sample_idx, j.seq IS NOT NULL AS in_fix, j.seq::DOUBLE AS fix_gavx FROM s LEFT JOIN j ON s.recording_id = j.recording_id AND s.sample_idx = j.sample_idx""",
)
def j01(spark, d):
    got = A.stamp_events(events_samples(spark, d), _intervals(spark, d), "in_fix", {"fix_gavx": "gavx"}, 144 * _HOUR, bucket_ms=24 * _HOUR)
    return got.select("recording_id", "sample_idx", "in_fix", "fix_gavx")


def _notes(spark, d) -> DataFrame:
    e = events_samples(spark, d)
    return e.select("recording_id", F.col("sample_idx").alias("event_seq"), (F.col("time") + F.when(F.col("sample_idx") % 3 == 0, 5).otherwise(0)).alias("sttime"), F.concat(F.lit("m"), F.col("sample_idx").cast("string")).alias("message"))


@query("j02_point_join", f"WITH {SAMPLES_SQL}, e AS (SELECT recording_id AS r, sample_idx AS seq, time + CASE WHEN sample_idx % 3 = 0 THEN 5 ELSE 0 END AS st FROM s), f AS (SELECT recording_id, time, min(sample_idx) AS i FROM s GROUP BY ALL), j AS (SELECT r, i, string_agg('m' || seq::VARCHAR, '; ' ORDER BY seq) AS m FROM e JOIN f ON r = recording_id AND st = time GROUP BY ALL) SELECT s.recording_id, s.sample_idx, coalesce(m, '') AS message FROM s LEFT JOIN j ON s.recording_id = r AND s.sample_idx = i")
def j02(spark, d):
    return A.attach_messages(events_samples(spark, d), _notes(spark, d)).select("recording_id", "sample_idx", "message")


@query("j02_nearest_after", f"WITH {SAMPLES_SQL}, e AS (SELECT recording_id AS r, sample_idx AS seq, time + CASE WHEN sample_idx % 3 = 0 THEN 5 ELSE 0 END AS st FROM s), f AS (SELECT recording_id, time, min(sample_idx) AS i FROM s GROUP BY ALL), a AS (SELECT e.r, e.seq, arg_min(f.i, f.time) AS i FROM e JOIN f ON r = recording_id AND f.time >= st GROUP BY ALL), j AS (SELECT r, i, string_agg('m' || seq::VARCHAR, '; ' ORDER BY seq) AS m FROM a GROUP BY ALL) SELECT s.recording_id, s.sample_idx, coalesce(m, '') AS message FROM s LEFT JOIN j ON s.recording_id = r AND s.sample_idx = i")
def j02n(spark, d):
    return A.attach_messages(events_samples(spark, d), _notes(spark, d), nearest_after=True).select("recording_id", "sample_idx", "message")


@query("s11_sample_rate", f"WITH {SAMPLES_SQL}, k AS (SELECT *, row_number() OVER {_WR} AS k FROM s), d AS (SELECT recording_id, time - lag(time) OVER {_WR} AS d FROM k WHERE k <= 1000) SELECT recording_id, coalesce(round_even(1000.0::DOUBLE / median(d) FILTER (WHERE d > 0), 0), 1000.0::DOUBLE) AS sample_rate FROM d GROUP BY recording_id")
def s11(spark, d):
    return A.estimate_sample_rate(events_samples(spark, d))


@query("f02_degrees", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, {_r6('gx / 40.286285291135876::DOUBLE')} AS deg, {_r6('gx / 40.286285291135876::DOUBLE * 40.286285291135876::DOUBLE')} AS px FROM s")
def f02(spark, d):
    ppd = frame(spark, d).meta.ppd
    return frame(spark, d).df.select("recording_id", "sample_idx", r6(px_to_deg(F.col("gxL"), ppd)).alias("deg"), r6(deg_to_px(px_to_deg(F.col("gxL"), ppd), ppd)).alias("px"))


@query("u01_union_by_name", f"WITH {SAMPLES_SQL} SELECT label, count(*)::BIGINT AS n, count(pa)::BIGINT AS n_pupil FROM (SELECT 'a' AS label, pa FROM s UNION ALL SELECT 'b' AS label, NULL AS pa FROM s) GROUP BY label")
def u01(spark, d):
    a = events_samples(spark, d).withColumn("label", F.lit("a"))
    b = events_samples(spark, d).drop("paL").withColumn("label", F.lit("b"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("paL").alias("n_pupil"))


@query("r04_row_slice", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, gx FROM s WHERE sample_idx BETWEEN 500 AND 900")
def r04(spark, d):
    return frame(spark, d).select(F.col("sample_idx").between(500, 900)).df.select("recording_id", "sample_idx", F.col("gxL").alias("gx"))


# ------------------------------------------------------------------------------------------------- raw events of a kind


def _binary_events(spark, d) -> tuple[DataFrame, DataFrame]:
    """Saccades and blinks without ends, as binary recordings have them, and samples that miss gaze now and then."""
    s = events_samples(spark, d)
    t = F.floor(F.col("time") / 3_600_000)
    base = s.select("recording_id", F.col("sample_idx").alias("event_seq"), t.alias("sttime"), F.when(F.col("message") == "purchase", t + F.col("sample_idx") % 90).otherwise(t).alias("entime"), F.when(F.col("message") == "purchase", 6).otherwise(4).cast("short").alias("type"), (F.col("sample_idx") % 2).cast("short").alias("eye"))
    events = base.join(s.select(F.col("sample_idx").alias("event_seq"), F.col("message").alias("m")), "event_seq").where(F.col("m").isin("purchase", "signup")).drop("m")
    return events, s.select("recording_id", "sample_idx", t.alias("time"), "gxL")


_BLINKS = """
z AS (SELECT *, floor(time / 3600000)::BIGINT AS h FROM s), sa AS (SELECT recording_id AS r, h AS st, h + sample_idx % 90 AS en FROM z WHERE message = 'purchase'),
bl AS (SELECT recording_id, sample_idx AS seq, h AS st, sample_idx % 2 AS eye FROM z WHERE message = 'signup'),
b1 AS (SELECT recording_id, seq, bl.st, eye, greatest(bl.st, coalesce(max(en), bl.st)) AS lim FROM bl LEFT JOIN sa ON r = recording_id AND sa.st <= bl.st GROUP BY recording_id, seq, bl.st, eye),
b2 AS (SELECT b1.recording_id, seq, st, eye, greatest(st, coalesce(max(h), st)) AS en FROM b1 LEFT JOIN z ON z.recording_id = b1.recording_id AND z.gx IS NULL AND h <= lim GROUP BY b1.recording_id, seq, st, eye),
b3 AS (SELECT recording_id, eye, en, min(st) AS st FROM b2 GROUP BY ALL),
b4 AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY recording_id, eye ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM b3),
b5 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id, eye ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM b4)"""


@query("j05_blink_recovery", f"WITH {SAMPLES_SQL}, {_BLINKS} SELECT recording_id, min(st)::BIGINT AS sttime, max(en)::BIGINT AS entime, eye::SMALLINT AS eye, (max(en) - min(st) + 1)::BIGINT AS duration FROM b5 GROUP BY recording_id, eye, g")
def j05(spark, d):
    events, samples = _binary_events(spark, d)
    return A.parse_blinks(events, samples).select("recording_id", "sttime", "entime", "eye", "duration")


@query("p14_parse_saccades", f"WITH {SAMPLES_SQL}, z AS (SELECT *, floor(time / 3600000)::BIGINT AS h FROM s) SELECT recording_id, sample_idx AS event_seq, h AS sttime, (h + sample_idx % 90)::BIGINT AS entime, (sample_idx % 90 + 1)::BIGINT AS duration FROM z WHERE message = 'purchase'")
def p14(spark, d):
    return A.parse_saccades(_binary_events(spark, d)[0]).select("recording_id", "event_seq", "sttime", "entime", "duration")


# ------------------------------------------------------------------------------------------------- text of recordings


def _asc_lines(spark, d) -> DataFrame:
    """``events`` as lines of a vendor's text: samples of one or two eyes, messages, fixations and saccades."""
    e = events_samples(spark, d)
    i, t = F.col("sample_idx"), F.col("sample_idx").cast("string")
    n = lambda c: F.coalesce(F.format_string("%.1f", rj(F.col(c), 1)), F.lit("."))
    line = (
        F.when(i % 11 == 0, F.concat(F.lit("MSG\t"), t, F.lit(" TRIALID "), t))
        .when(i % 11 == 7, F.concat(F.lit("MSG\t"), t, F.lit(" TRIAL_RESULT 0")))
        .when(i % 11 == 3, F.concat(F.lit("EFIX R   "), t, F.lit("\t"), (i + 4).cast("string"), F.lit("\t5\t  "), n("gxL"), F.lit("\t 20.5\t 900")))
        .when(i % 2 == 0, F.concat_ws("\t", t, n("gxL"), n("gyL"), n("paL"), n("paL"), n("gxL"), n("gyL"), F.lit("...")))
        .otherwise(F.concat_ws("\t", t, n("gxL"), n("gyL"), n("paL"), F.lit("...")))
    )
    # Exploding one element keeps the optimizer from writing the made-up line out in each use.
    return e.select("recording_id", i.alias("n"), F.explode(F.array(line)).alias("line"))


_ASC = f"""{SAMPLES_SQL}, mk AS (SELECT *, CASE WHEN sample_idx % 11 = 0 THEN 1 WHEN sample_idx % 11 = 7 THEN 0 END AS m FROM s),
ln AS (SELECT *, CASE WHEN last_value(m IGNORE NULLS) OVER w = 1 THEN sum((m IS NOT NULL AND m = 1)::INT) OVER w END AS tr FROM mk WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_R1 = "round_even({0} * 10.0::DOUBLE, 0) / 10.0::DOUBLE"


@query(
    "s06_ascii_samples",
    f"""WITH {_ASC} SELECT recording_id, sample_idx, sample_idx AS time, tr::BIGINT AS trial, CASE WHEN sample_idx % 2 = 0 AND pa IS NOT NULL THEN {_R1.format("gx")} END AS "gxL", CASE WHEN sample_idx % 2 = 0 AND pa IS NOT NULL THEN {_R1.format("gy")} END AS "gyL",
 CASE WHEN sample_idx % 2 = 0 AND pa IS NOT NULL THEN {_R1.format("pa")} END AS "paL", CASE WHEN sample_idx % 2 = 0 AND pa IS NOT NULL THEN {_R1.format("pa")} ELSE {_R1.format("gx")} END AS "gxR", CASE WHEN sample_idx % 2 = 0 AND pa IS NOT NULL THEN {_R1.format("gx")} ELSE {_R1.format("gy")} END AS "gyR",
 CASE WHEN sample_idx % 2 = 0 AND pa IS NOT NULL THEN {_R1.format("gy")} ELSE {_R1.format("pa")} END AS "paR" FROM ln WHERE sample_idx % 11 NOT IN (0, 3, 7)""",
)
def s06(spark, d):
    from gazeframe.sources.eyelink_text import classify, samples_of

    return samples_of(classify(_asc_lines(spark, d)))


@query("s06_ascii_events", f"WITH {_ASC} SELECT recording_id, sample_idx AS event_seq, CASE WHEN sample_idx % 11 = 3 THEN 8 ELSE 24 END::SMALLINT AS type, sample_idx AS sttime, CASE WHEN sample_idx % 11 = 3 THEN sample_idx + 4 ELSE sample_idx END AS entime, CASE sample_idx % 11 WHEN 0 THEN 'TRIALID ' || sample_idx::VARCHAR WHEN 7 THEN 'TRIAL_RESULT 0' ELSE '' END AS message, CASE WHEN sample_idx % 11 = 3 THEN {_R1.format('gx')} END AS gavx FROM ln WHERE sample_idx % 11 IN (0, 3, 7)")
def s06e(spark, d):
    from gazeframe.sources.eyelink_text import classify, events_of

    return events_of(classify(_asc_lines(spark, d))).select("recording_id", "event_seq", "type", "sttime", "entime", "message", "gavx")


@query("k02_sample_lines", f"""WITH {SAMPLES_SQL} SELECT recording_id, sample_idx AS ts, sample_idx::VARCHAR || chr(9) || {" || chr(9) || ".join(f"CASE WHEN {c} IS NULL THEN '      .' ELSE lpad(printf('%.1f', {_rj(c, 1)}), greatest(7, length(printf('%.1f', {_rj(c, 1)})))::INT, ' ') END" for c in ("gx", "gy", "pa"))} || chr(9) || '...' AS line FROM s""")
def k02(spark, d):
    from gazeframe.sources.eyelink_text import ascii_lines, classify, events_of, recordings_of

    s = events_samples(spark, d)
    raw = classify(_asc_lines(spark, d))
    whole = A.RawRecording(s.select("recording_id", "sample_idx", F.col("sample_idx").alias("time"), "trial", "gxL", "gyL", "paL"), events_of(raw), recordings_of(raw))
    return ascii_lines(whole, include_events=False, include_messages=False).select("recording_id", "ts", "line")


@query("k02_message_lines", f"WITH {_ASC} SELECT recording_id, sample_idx AS ts, 0.0::DOUBLE AS priority, 'MSG' || chr(9) || sample_idx::VARCHAR || CASE WHEN sample_idx % 11 = 0 THEN ' TRIALID ' || sample_idx::VARCHAR ELSE ' TRIAL_RESULT 0' END AS line FROM ln WHERE sample_idx % 11 IN (0, 7) AND sample_idx BETWEEN 1 AND 3600000")
def k02m(spark, d):
    from gazeframe.sources.eyelink_text import ascii_lines, classify, events_of, recordings_of, samples_of

    raw = classify(_asc_lines(spark, d))
    return ascii_lines(A.RawRecording(samples_of(raw), events_of(raw), recordings_of(raw)), include_events=False, include_samples=False, longest=_HOUR).select("recording_id", "ts", "priority", "line")


@query("k03_smi_lines", f"""WITH {SAMPLES_SQL} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS n, sample_idx::BIGINT * 1000 || chr(9) || 'SMP' || chr(9) || trial || repeat(chr(9) || '0.00', 6) || chr(9) || printf('%.2f', coalesce(gx, 0.0)) || chr(9) || printf('%.2f', coalesce(gy, 0.0)) || chr(9) || '0' || chr(9) || '0' || chr(9) || message || chr(9) || '0' || chr(9) AS line FROM s""")
def k03(spark, d):
    from gazeframe.sources.smi import smi_text_lines

    gf = frame(spark, d)
    gf = gf.with_df(gf.df.drop("paL").withColumn("time", F.col("sample_idx").cast("double")))
    return smi_text_lines(gf, "x").where("n > 0")


# ------------------------------------------------------------------------------------------------------------ chart data


@query("plot_scanpath", f"WITH {SAMPLES_SQL}, v AS (SELECT * FROM s WHERE gx IS NOT NULL AND gy IS NOT NULL) SELECT {_K}, sample_idx, gx AS x, gy AS y, CASE WHEN sample_idx = min(sample_idx) OVER g THEN 'first' WHEN sample_idx = max(sample_idx) OVER g THEN 'last' END AS mark FROM v WINDOW g AS (PARTITION BY {_K})")
def plot_scanpath(spark, d):
    return P.scanpath(frame(spark, d), "left")


@query("plot_gaze", f"WITH {SAMPLES_SQL} SELECT {_K}, sample_idx, {_r6(f'time - first_value(time) OVER {_W}')} AS t, gx AS x, gy AS y FROM s")
def plot_gaze(spark, d):
    return rounded(P.gaze_trace(frame(spark, d), "left"), "t")


@query("plot_fixations", f"WITH {_STAMPED}, {runs_sql('z', 't', 'in_fix', _K)}, g AS (SELECT {_K}, arg_min(fix_gavx, sample_idx) AS x, arg_min(fix_gavy, sample_idx) AS y, arg_min(fix_dur, sample_idx)::DOUBLE AS dur, min(sample_idx) AS start_idx FROM z WHERE in_fix GROUP BY {_K}, _run) SELECT {_K}, start_idx, {_r6(f'coalesce(dur / max(dur) OVER (PARTITION BY {_K}), 0.0::DOUBLE) * 40.0 + 5.0')} AS size FROM g WHERE x IS NOT NULL AND y IS NOT NULL")
def plot_fixations(spark, d):
    return rounded(P.fixation_bubbles(stamped(spark, d)), "size").select("recording_id", "trial", "start_idx", "size")


@query("plot_velocity", f"WITH {_LONG}, {runs_sql('r', 't', 'in_sacc', _K)}, p AS (SELECT *, time - first_value(time) OVER {_W} AS _t FROM r) SELECT {_K}, {_r6('arg_min(_t, sample_idx)')} AS t, {_r6('arg_min(sacc_pvel, sample_idx)')} AS pvel FROM p WHERE in_sacc GROUP BY {_K}, _run HAVING arg_min(sacc_pvel, sample_idx) IS NOT NULL")
def plot_velocity(spark, d):
    return rounded(P.saccade_velocities(_long_saccades(spark, d)), "t", "pvel")


@query("plot_sequence", "WITH " + SAMPLES_SQL + f", k AS (SELECT DISTINCT {_K} FROM s ORDER BY {_K} LIMIT 20), q AS (SELECT s.* FROM s JOIN k USING ({_K})), " + ", ".join(runs_sql(n, "q", f, _K) for n, f in (("r1", "in_fix"), ("r2", "in_sacc"), ("r3", "in_blink"))) + " " + " UNION ALL ".join(f"SELECT {_K}, {_r6('arg_min(time, sample_idx)')} AS t_start, {_r6('arg_max(time, sample_idx)')} AS t_stop, '{k}' AS kind FROM {n} WHERE {f} GROUP BY {_K}, _run" for n, f, k in (("r1", "in_fix", "fixation"), ("r2", "in_sacc", "saccade"), ("r3", "in_blink", "blink"))))
def plot_sequence(spark, d):
    return rounded(P.sequence_bars(frame(spark, d)), "t_start", "t_stop")


# The queries of readers and writers are registered in a module of their own.
from gazeframe.plans import file_queries, live_queries  # noqa: E402, F401
