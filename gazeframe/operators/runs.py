"""Gaps and islands: onsets and maximal runs of equal values over an ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.frame import RECORDING, GazeFrame, ordered
from gazeframe.functions.numeric import rj


def onset(flag: Column, keys: Sequence[str]) -> Column:
    """A01's onsets: a true row after a false one, or at the group's start. NULL is false."""
    v = F.coalesce(flag, F.lit(False))
    return v & ~F.coalesce(F.lag(v).over(ordered(keys)), F.lit(False))


def run_id(value: Column, keys: Sequence[str]) -> Column:
    """A number that is equal on the rows of one maximal run of equal values. Needs two steps: see :func:`with_runs`."""
    w = ordered(keys)
    change = (~value.eqNullSafe(F.lag(value).over(w))).cast("int")
    return change


def with_runs(df: DataFrame, value: Column, keys: Sequence[str], name: str = "_run") -> DataFrame:
    """Adds the run's number within the group."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_v", value).withColumn("_change", run_id(F.col("_v"), keys))
    return out.withColumn(name, F.sum("_change").over(w)).drop("_v", "_change")


def contiguous_runs(df: DataFrame, predicate: Column, keys: Sequence[str] = RECORDING, min_len: int = 1) -> DataFrame:
    """(keys, start_idx, end_idx, n) of the maximal runs of rows on which ``predicate`` holds."""
    v = F.coalesce(predicate, F.lit(False))
    runs = with_runs(df.withColumn("_p", v), F.col("_p"), keys).where("_p")
    out = runs.groupBy(*keys, "_run").agg(F.min("sample_idx").alias("start_idx"), F.max("sample_idx").alias("end_idx"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_len).drop("_run")


def counts(gf: GazeFrame, flag: str, group_by=None) -> DataFrame:
    """The number of onsets of ``flag`` in each group."""
    df, keys = gf.valid_groups(group_by)
    return df.withColumn("_on", onset(F.col(flag), keys)).groupBy(*keys).agg(F.sum(F.col("_on").cast("int")).alias("n"))


def _events(gf: GazeFrame, flag: str, duration: str, columns: dict[str, str], prefix: str | None) -> DataFrame:
    """One row for each run of ``flag`` over a recording, with the values of its first row."""
    p = f"{prefix}_" if prefix else ""
    flag, duration = p + flag, p + duration
    if not gf.has(flag):
        spark = gf.df.sparkSession
        return spark.createDataFrame([], "recording_id string, sttime double, entime double, duration double")
    v = F.coalesce(F.col(flag), F.lit(False))
    runs = with_runs(gf.df.withColumn("_p", v), F.col("_p"), RECORDING).where("_p")
    present = {n: p + c for n, c in columns.items() if gf.has(p + c)}
    first = lambda c: F.min_by(F.struct(c), "sample_idx").getField(c)
    aggs = [F.min_by("time", "sample_idx").cast("double").alias("sttime"), F.max_by("time", "sample_idx").cast("double").alias("entime")]
    if gf.has(duration):
        aggs.append(first(duration).cast("double").alias("duration"))
    aggs += [first(c).alias(n) for n, c in present.items()]
    out = runs.groupBy("recording_id", "_run").agg(*aggs).drop("_run")
    if not gf.has(duration):
        out = out.withColumn("duration", rj(F.col("entime") - F.col("sttime") + 1))
    return out.select("recording_id", "sttime", "entime", "duration", *present)


def fixations(gf: GazeFrame, prefix: str | None = None) -> DataFrame:
    """Fixations as rows."""
    return _events(gf, "in_fix", "fix_dur", {"gavx": "fix_gavx", "gavy": "fix_gavy", "ava": "fix_ava"}, prefix)


def saccades(gf: GazeFrame, prefix: str | None = None) -> DataFrame:
    """Saccades as rows."""
    return _events(gf, "in_sacc", "sacc_dur", {"gstx": "sacc_gstx", "gsty": "sacc_gsty", "genx": "sacc_genx", "geny": "sacc_geny", "ampl": "sacc_ampl", "pvel": "sacc_pvel"}, prefix)


def blinks(gf: GazeFrame, prefix: str | None = None) -> DataFrame:
    """Blinks as rows."""
    return _events(gf, "in_blink", "blink_dur", {}, prefix)


def intervals(gf: GazeFrame, flag: str, group_by=None) -> DataFrame:
    """(keys, t_start, t_stop) of a flag's runs within each group, for bars and bands of charts."""
    df, keys = gf.valid_groups(group_by)
    runs = with_runs(df.withColumn("_p", F.coalesce(F.col(flag), F.lit(False))), F.col("_p"), keys).where("_p")
    return runs.groupBy(*keys, "_run").agg(F.min_by("time", "sample_idx").alias("t_start"), F.max_by("time", "sample_idx").alias("t_stop")).drop("_run")


def fixation_list(gf: GazeFrame, group_by=None) -> DataFrame:
    """Fixations of each group with a valid centre: position, duration, first and last row, ordinal."""
    df, keys = gf.valid_groups(group_by)
    runs = with_runs(df.withColumn("_p", F.coalesce(F.col("in_fix"), F.lit(False))), F.col("_p"), keys).where("_p")
    first = lambda c: F.min_by(F.struct(c), "sample_idx").getField(c)
    got = runs.groupBy(*keys, "_run").agg(first("fix_gavx").alias("x"), first("fix_gavy").alias("y"), first("fix_dur").cast("double").alias("dur"), F.min("sample_idx").alias("start_idx"), F.max("sample_idx").alias("end_idx"))
    got = got.where(F.col("x").isNotNull() & F.col("y").isNotNull()).drop("_run")
    return got.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("start_idx")))


def saccade_vectors(gf: GazeFrame, group_by=None) -> DataFrame:
    """Saccades of each group with valid ends; the angle is 0 upwards and grows clockwise (screen y turned over)."""
    df, keys = gf.valid_groups(group_by)
    runs = with_runs(df.withColumn("_p", F.coalesce(F.col("in_sacc"), F.lit(False))), F.col("_p"), keys).where("_p")
    first = lambda c: F.min_by(F.struct(c), "sample_idx").getField(c)
    ends = {"x1": "sacc_gstx", "y1": "sacc_gsty", "x2": "sacc_genx", "y2": "sacc_geny"}
    got = runs.groupBy(*keys, "_run").agg(*(first(c).alias(n) for n, c in ends.items()), F.min("sample_idx").alias("start_idx")).drop("_run").dropna(subset=list(ends))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y1") - F.col("y2")
    return got.withColumn("angle", F.atan2(dx, dy)).withColumn("amplitude", F.sqrt(dx * dx + dy * dy))
