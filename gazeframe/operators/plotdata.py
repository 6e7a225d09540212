"""The data behind each chart; drawing is left to the caller. Frames can be cut to a selection first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame, ordered, relative_time
from gazeframe.operators.runs import fixation_list, intervals, with_runs


def gaze_trace(gf: GazeFrame, eye: str = "auto", group_by=None) -> DataFrame:
    """(keys, sample_idx, t, x, y): gaze over each group's relative time."""
    gx, gy, _ = gf.eye_columns(eye)
    df, keys = gf.valid_groups(group_by)
    return df.select(*keys, "sample_idx", relative_time(df, keys).alias("t"), F.col(gx).alias("x"), F.col(gy).alias("y"))


def pupil_trace(gf: GazeFrame, eye: str = "auto", group_by=None) -> DataFrame:
    """(keys, sample_idx, t, pupil)."""
    pa = gf.eye_columns(eye, pupil=True)[2]
    df, keys = gf.valid_groups(group_by)
    return df.select(*keys, "sample_idx", relative_time(df, keys).alias("t"), F.col(pa).alias("pupil"))


def scanpath(gf: GazeFrame, eye: str = "auto", group_by=None) -> DataFrame:
    """(keys, sample_idx, x, y, mark): each group's valid gaze as a line; its ends are marked 'first' and 'last'."""
    gx, gy, _ = gf.eye_columns(eye)
    df, keys = gf.valid_groups(group_by)
    d = df.where(F.col(gx).isNotNull() & F.col(gy).isNotNull())
    w = ordered(keys)
    back = Window.partitionBy(*keys).orderBy(F.desc("sample_idx"))
    mark = F.when(F.row_number().over(w) == 1, "first").when(F.row_number().over(back) == 1, "last")
    return d.select(*keys, "sample_idx", F.col(gx).alias("x"), F.col(gy).alias("y"), mark.alias("mark"))


def fixation_bubbles(gf: GazeFrame, group_by=None) -> DataFrame:
    """Fixations with a size of 5 and up to 40 more, by their share of the group's longest."""
    keys = gf.groups(group_by)
    d = fixation_list(gf, group_by)
    longest = F.max("dur").over(Window.partitionBy(*keys))
    return d.withColumn("size", F.coalesce(F.try_divide(F.col("dur"), longest), F.lit(0.0)) * 40.0 + 5.0)


def saccade_velocities(gf: GazeFrame, group_by=None) -> DataFrame:
    """(keys, t, pvel): onset and peak velocity of each saccade."""
    df, keys = gf.valid_groups(group_by)
    d = df.withColumn("_t", relative_time(df, keys)).withColumn("_p", F.coalesce("in_sacc", F.lit(False)))
    runs = with_runs(d, F.col("_p"), keys).where("_p")
    got = runs.groupBy(*keys, "_run").agg(F.min_by("_t", "sample_idx").alias("t"), F.min_by(F.struct("sacc_pvel"), "sample_idx").getField("sacc_pvel").alias("pvel"))
    return got.where("pvel is not null").drop("_run")


def sequence_bars(gf: GazeFrame, most_groups: int = 20, group_by=None) -> DataFrame:
    """(keys, kind, t_start, t_stop): event bars of the first ``most_groups`` groups in key order."""
    _, keys = gf.valid_groups(group_by)
    first = gf.df.select(*keys).dropna().distinct().orderBy(*keys).limit(most_groups)
    own = gf.with_df(gf.df.join(F.broadcast(first), keys))  # at most ``most_groups`` rows
    parts = [intervals(own, flag, group_by).withColumn("kind", F.lit(kind)) for flag, kind in (("in_fix", "fixation"), ("in_sacc", "saccade"), ("in_blink", "blink")) if gf.has(flag)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def facets(gf: GazeFrame, split_by: str, most: int = 4) -> DataFrame:
    """The first ``most`` sorted distinct values to make panels of."""
    return gf.df.select(split_by).dropna().distinct().orderBy(split_by).limit(most)
