"""Sample tables derived from plain event tables, in Spark and in SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame, RecordingMeta
from gazeframe.functions.aoi import Circle, Ellipse, Polygon, Rect

META = RecordingMeta(source="generic", sample_rate=60.0)
#: Edges lie off the values that means of the data can take, so that rounding decides no membership.
AREAS = [Rect("Left", 480.13, 271.37, 959.71, 540.53), Circle("Disc", 1440, 540, 300), Ellipse("Oval", 700, 500, 400, 250), Polygon("Poly", ((200, 200), (900, 100), (1200, 600), (800, 900), (300, 700)))]


def events_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples: one recording and trial for each user, ordered by event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bad = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("recording_id"),
        F.col("event_id").alias("sample_idx"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000.0)).alias("time"),
        F.col("user_id").alias("trial"),
        F.lit("p").alias("participant"),
        F.when(~bad, F.col("value") * 4).alias("gxL"),
        F.when(~bad, k * 10.8).alias("gyL"),
        F.when(~bad, F.col("value") + 1000).alias("paL"),
        F.col("event_type").alias("message"),
        F.col("event_type").isin("view", "click").alias("in_fix"),
        (F.col("event_type") == "purchase").alias("in_sacc"),
        bad.alias("in_blink"),
    )


#: The same table for SQL; ``vel``, ``label`` and stamped columns follow in the queries' own steps.
SAMPLES_SQL = """
s AS (SELECT 'r' || user_id::VARCHAR AS recording_id, event_id AS sample_idx, epoch_us(ts) / 1000.0::DOUBLE AS time, user_id AS trial,
  CASE WHEN event_type <> 'error' THEN value * 4 END AS gx, CASE WHEN event_type <> 'error' THEN (props->>'$.k')::DOUBLE * 10.8::DOUBLE END AS gy,
  CASE WHEN event_type <> 'error' THEN value + 1000 END AS pa, event_type AS message,
  event_type IN ('view', 'click') AS in_fix, event_type = 'purchase' AS in_sacc, event_type = 'error' AS in_blink FROM events)"""


def frame(spark: SparkSession, sf_dir: str) -> GazeFrame:
    return GazeFrame(events_samples(spark, sf_dir), META)


def stamped(spark: SparkSession, sf_dir: str) -> GazeFrame:
    """The frame with attributes of its own fixation and saccade runs, as detection would write them."""
    from gazeframe.operators.detect import event_columns, velocity

    gf = frame(spark, sf_dir)
    label = F.when(F.col("in_fix"), "fixation").when(F.col("in_sacc"), "saccade").otherwise("noise")
    d = gf.df.withColumn("_label", label).withColumn("_vel", velocity("gxL", "gyL", 40.0, 60.0))
    return gf.with_df(event_columns(d, "_label", "gxL", "gyL", "paL", "_vel", 40.0, 60.0).drop("_label", "_vel"))


_W = "OVER (PARTITION BY recording_id ORDER BY sample_idx)"
VELOCITY_SQL = """
v0 AS (SELECT *, (lead(gx, 2) OVER w + lead(gx, 1) OVER w - lag(gx, 1) OVER w - lag(gx, 2) OVER w) / 6.0 AS dx, (lead(gy, 2) OVER w + lead(gy, 1) OVER w - lag(gy, 1) OVER w - lag(gy, 2) OVER w) / 6.0 AS dy
  FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)),
v AS (SELECT * EXCLUDE (dx, dy), sqrt(dx * dx + dy * dy) / 40.0::DOUBLE * 60.0::DOUBLE AS vel FROM v0)"""


def runs_sql(name: str, source: str, value: str, keys: str = "recording_id") -> str:
    """``source`` with _run, the number of the maximal run of equal ``value`` within ``keys``."""
    return f"""
{name}_0 AS (SELECT *, {value} AS _v FROM {source}),
{name}_1 AS (SELECT *, CASE WHEN _v IS DISTINCT FROM lag(_v) OVER (PARTITION BY {keys} ORDER BY sample_idx) OR row_number() OVER (PARTITION BY {keys} ORDER BY sample_idx) = 1 THEN 1 ELSE 0 END AS _c FROM {name}_0),
{name} AS (SELECT * EXCLUDE (_v, _c), sum(_c) OVER (PARTITION BY {keys} ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _run FROM {name}_1)"""


def stamp_sql(name: str, source: str, label: str) -> str:
    """W09 in SQL: ``source`` must have gx, gy, pa, vel."""
    own = "(PARTITION BY recording_id, _run)"
    ok = "gx IS NOT NULL AND gy IS NOT NULL"
    return (
        runs_sql(f"{name}_r", source, label)
        + f""",
{name}_a AS (SELECT *, {label} AS _l, count(*) FILTER (WHERE {ok}) OVER {own} AS _ok, count(*) OVER {own} AS _n, avg(gx) FILTER (WHERE {ok}) OVER {own} AS _mx, avg(gy) FILTER (WHERE {ok}) OVER {own} AS _my,
  coalesce(sum(pa) FILTER (WHERE {ok}) OVER {own}, 0) AS _pa, arg_min(gx, sample_idx) FILTER (WHERE {ok}) OVER {own} AS _x1, arg_min(gy, sample_idx) FILTER (WHERE {ok}) OVER {own} AS _y1,
  arg_max(gx, sample_idx) FILTER (WHERE {ok}) OVER {own} AS _x2, arg_max(gy, sample_idx) FILTER (WHERE {ok}) OVER {own} AS _y2, greatest(0.0::DOUBLE, coalesce(max(vel) OVER {own}, 0.0)) AS _peak FROM {name}_r),
{name} AS (SELECT recording_id, sample_idx, time, trial, gx, gy, pa, message, in_blink, _l = 'fixation' AS in_fix, CASE WHEN _l = 'fixation' THEN _mx END AS fix_gavx, CASE WHEN _l = 'fixation' THEN _my END AS fix_gavy,
  CASE WHEN _l = 'fixation' AND _ok > 0 THEN _pa / _ok END AS fix_ava, CASE WHEN _l = 'fixation' AND _ok > 0 THEN round_even(_n / 60.0::DOUBLE * 1000.0::DOUBLE, 0)::INT ELSE 0 END AS fix_dur,
  _l = 'saccade' AS in_sacc, CASE WHEN _l = 'saccade' THEN _x1 END AS sacc_gstx, CASE WHEN _l = 'saccade' THEN _y1 END AS sacc_gsty, CASE WHEN _l = 'saccade' THEN _x2 END AS sacc_genx, CASE WHEN _l = 'saccade' THEN _y2 END AS sacc_geny,
  CASE WHEN _l = 'saccade' THEN round_even(_n / 60.0::DOUBLE * 1000.0::DOUBLE, 0)::INT ELSE 0 END AS sacc_dur, CASE WHEN _l = 'saccade' THEN sqrt((_x2 - _x1) * (_x2 - _x1) + (_y2 - _y1) * (_y2 - _y1)) / 40.0::DOUBLE END AS sacc_ampl,
  CASE WHEN _l = 'saccade' AND _ok > 0 THEN _peak END AS sacc_pvel FROM {name}_a)"""
    )


def area_sql(name: str, x: str = "gx", y: str = "gy") -> str:
    """An area's test in SQL, NULL as false."""
    a = next(a for a in AREAS if a.name == name)
    if isinstance(a, Rect):
        t = f"{x} BETWEEN {a.cx - a.width / 2}::DOUBLE AND {a.cx + a.width / 2}::DOUBLE AND {y} BETWEEN {a.cy - a.height / 2}::DOUBLE AND {a.cy + a.height / 2}::DOUBLE"
    elif isinstance(a, Circle):
        t = f"({x} - {a.cx}) * ({x} - {a.cx}) + ({y} - {a.cy}) * ({y} - {a.cy}) <= {a.radius**2}::DOUBLE"
    elif isinstance(a, Ellipse):
        t = f"(({x} - {a.cx}) / {a.rx}::DOUBLE) * (({x} - {a.cx}) / {a.rx}::DOUBLE) + (({y} - {a.cy}) / {a.ry}::DOUBLE) * (({y} - {a.cy}) / {a.ry}::DOUBLE) <= 1.0"
    else:
        v = [(float(p), float(q)) for p, q in a.vertices]
        parts = [f"(({yi}::DOUBLE > {y}) <> ({yj}::DOUBLE > {y}) AND {x} < ({xj}::DOUBLE - {xi}::DOUBLE) * ({y} - {yi}::DOUBLE) / ({yj}::DOUBLE - {yi}::DOUBLE) + {xi}::DOUBLE)::INT" for (xi, yi), (xj, yj) in zip(v, [v[-1], *v[:-1]], strict=True) if yi != yj]
        t = f"({' + '.join(parts)}) % 2 = 1"
    return f"coalesce({t}, false)"


def first_area_sql(x: str, y: str) -> str:
    return "CASE " + " ".join(f"WHEN {area_sql(a.name, x, y)} THEN {k + 1}" for k, a in enumerate(AREAS)) + " ELSE 0 END"
