"""Tobii exports: tab-separated text with named columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame, RecordingMeta
from gazeframe.sources.files import lines

# The export's column names.
TIME, EVENT, VALUE, STIMULUS, SUBJECT = "Recording timestamp [ms]", "Event", "Event value", "Presented Stimulus name", "Participant name"
EYES = {"L": ("Validity left", "Gaze point left X [DACS px]", "Gaze point left Y [DACS px]", "Pupil diameter left [mm]"), "R": ("Validity right", "Gaze point right X [DACS px]", "Gaze point right Y [DACS px]", "Pupil diameter right [mm]")}


def read_tobii(spark: SparkSession, paths: str | Sequence[str], screen_res: tuple[int, int] = (1920, 1080), screen_width_cm: float = 53.0, viewing_distance_cm: float = 60.0) -> GazeFrame:
    """Rows with a timestamp as samples of trial 1. An event and its value, or else the stimulus, is the message; an eye
    that is called invalid is missing. The rate is 1000 over the median positive step."""
    d = lines(spark, paths).where(F.trim("line") != "").withColumn("p", F.split("line", "\t", -1))
    # Each file's first line names its columns: a map from name to place goes to all its rows.
    first = d.groupBy("recording_id").agg(F.min_by("p", "n").alias("_h"), F.min("n").alias("_n"))
    d = d.join(first, "recording_id").where(F.col("n") > F.col("_n"))
    place = lambda c: F.array_position(F.transform("_h", F.trim), c).cast("int")
    field = lambda c: F.when(place(c) > 0, F.trim(F.coalesce(F.get("p", place(c) - 1), F.lit("")))).otherwise("")
    num = lambda c: F.regexp_replace(field(c), ",", ".").try_cast("double")
    event, value, stimulus = field(EVENT), field(VALUE), field(STIMULUS)
    message = F.when(event != "", F.when(value == "", event).otherwise(F.concat(event, F.lit(": "), value))).when(stimulus != "", F.concat(F.lit("Stimulus: "), stimulus)).otherwise("")
    gaze = {}
    for e, (valid, x, y, pupil) in EYES.items():
        ok = F.lower(field(valid)) != "invalid"
        gaze |= {f"gx{e}": F.when(ok, num(x)), f"gy{e}": F.when(ok, num(y)), f"pa{e}": F.when(ok, num(pupil))}
    none = F.lit(None).cast("double")
    out = d.select("recording_id", F.col("n").alias("sample_idx"), num(TIME).alias("time"), F.lit(1).cast("long").alias("trial"), field(SUBJECT).alias("participant"), *(gaze[c].alias(c) for c in ("gxL", "gyL", "paL", "gxR", "gyR", "paR")), *(none.alias(c) for c in ("pupxL", "pupyL", "pupxR", "pupyR")), message.alias("message"), (event != "").alias("is_event")).where("time is not null")
    step = F.col("time") - F.lag("time").over(Window.partitionBy("recording_id").orderBy("sample_idx"))
    median = out.select("recording_id", step.alias("s")).where("s > 0").groupBy("recording_id").agg(F.median("s").alias("m")).orderBy("recording_id").limit(1).collect()
    rate = 1000.0 / median[0][1] if median else 1000.0
    return GazeFrame(out, RecordingMeta("tobii", rate, screen_res[0], screen_res[1], screen_width_cm, viewing_distance_cm))


def event_rows(gf: GazeFrame):
    """(recording_id, time, type, message) of the explicit events."""
    return gf.df.where("is_event").select("recording_id", "time", F.lit("MSG").alias("type"), "message")
