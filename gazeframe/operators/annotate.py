"""From raw recordings to annotated samples: event filters, interval and point joins, blink recovery, trial variables.

Raw events carry ``recording_id`` and ``event_seq`` (file order); samples carry ``recording_id`` and ``sample_idx``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe import schema as S
from gazeframe.frame import RECORDING, GazeFrame, RecordingMeta, ordered
from gazeframe.functions.numeric import nan_to_null
from gazeframe.operators.signal import with_time_rel

#: Width of the time buckets on which intervals meet samples.
BUCKET_MS = 1024


@dataclass(frozen=True)
class RawRecording:
    """What a vendor's file holds before annotation."""

    samples: DataFrame
    events: DataFrame
    recordings: DataFrame | None = None
    preamble: Mapping[str, str] | None = None
    meta: RecordingMeta = RecordingMeta()


# ------------------------------------------------------------------------------------------------------ event filters


def parse_saccades(events: DataFrame) -> DataFrame:
    """Ends of saccades with inclusive durations."""
    return _ended(events, S.END_SACC, ["gstx", "gsty", "genx", "geny", "havx", "havy", "gavx", "gavy", "ampl", "pvel", "svel", "evel", "hstx", "hsty", "henx", "heny"])


def parse_fixations(events: DataFrame) -> DataFrame:
    """Ends of fixations with inclusive durations."""
    return _ended(events, S.END_FIX, ["hstx", "hsty", "gstx", "gsty", "gavx", "gavy", "ava", "havx", "havy"])


def _ended(events: DataFrame, kind: int, cols: list[str]) -> DataFrame:
    e = events.where(F.col("type") == kind)
    present = [c for c in (*cols, "eye") if c in events.columns]
    return e.select("recording_id", "event_seq", "sttime", "entime", (F.col("entime") - F.col("sttime") + 1).alias("duration"), *present)


def parse_messages(events: DataFrame) -> DataFrame:
    """Messages, NUL characters and surrounding blanks gone."""
    return events.where(F.col("type") == S.MESSAGE).select("recording_id", "event_seq", "sttime", F.trim(F.translate("message", "\x00", "")).alias("message"), *(["eye"] if "eye" in events.columns else []))


def parse_blinks(events: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Blinks. Where every blink's end equals its start (binary recordings) ends are recovered: the last
    missing gaze sample up to the latest end of the saccades that begin at or before it; repeats and neighbours merge.

    The latest such end is a running maximum over saccades and blinks in time order, the last missing sample a running
    maximum over samples: no range join.
    """
    rid = Window.partitionBy("recording_id")
    own = events.where(F.col("type") == S.END_BLINK).select("recording_id", F.struct("event_seq", "sttime", "entime", "eye", F.bool_and(F.col("sttime") == F.col("entime")).over(rid).alias("binary")).alias("b"))
    none = F.lit(None).cast(own.schema["b"].dataType)
    # Saccades before blinks at one time, as a saccade that begins with the blink encloses it.
    w = rid.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = events.where(F.col("type") == S.END_SACC).select("recording_id", F.col("sttime").alias("at"), F.lit(0).alias("side"), F.col("entime").alias("en"), none.alias("b"))
    q = own.select("recording_id", F.col("b.sttime").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("en"), "b")
    blinks = s.unionByName(q).withColumn("limit", F.max("en").over(w)).where("side = 1")
    limit = F.greatest(F.col("b.sttime"), F.coalesce("limit", F.col("b.sttime")))
    blinks = blinks.select("recording_id", limit.alias("limit"), "b")
    found = F.col("limit")
    if samples is not None:
        gaze = [c for c in ("gxL", "gxR") if c in samples.columns]
        # The first eye with any gaze tells what is missing; recordings without any keep the saccade's end.
        track, has = F.lit(None).cast("double"), F.lit(False)
        for c in reversed(gaze):
            some = F.count(c).over(rid) > 0
            track, has = F.when(some, F.col(c)).otherwise(track), has | some
        t = samples.select("recording_id", F.col("time").cast("long").alias("at"), track.alias("x"), has.alias("has")).where("has and x is null")
        miss = t.select("recording_id", "at", F.lit(0).alias("side"), F.col("at").alias("miss"), F.lit(True).alias("has"), F.lit(None).cast("long").alias("limit"), none.alias("b"))
        gazed = samples.groupBy("recording_id").agg(F.greatest(*(F.count(c) for c in gaze), F.lit(0)).alias("n")).where("n > 0") if gaze else samples.select("recording_id").limit(0)
        mark = gazed.select("recording_id", F.lit(None).cast("long").alias("at"), F.lit(-1).alias("side"), F.lit(None).cast("long").alias("miss"), F.lit(True).alias("has"), F.lit(None).cast("long").alias("limit"), none.alias("b"))
        ask = blinks.select("recording_id", F.col("limit").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("miss"), F.lit(None).cast("boolean").alias("has"), "limit", "b")
        blinks = mark.unionByName(miss).unionByName(ask).withColumn("last", F.max("miss").over(w)).withColumn("has", F.max("has").over(rid)).where("side = 1")
        found = F.when(F.coalesce("has", F.lit(False)), F.greatest(F.col("b.sttime"), F.coalesce("last", F.col("b.sttime")))).otherwise(F.col("limit"))
    b = blinks.select("recording_id", "b.event_seq", "b.sttime", "b.eye", "b.binary", F.when(F.col("b.binary"), found).otherwise(F.col("b.entime")).alias("entime"))
    # Only binary recordings' blinks merge: others are islands of their own.
    first = b.groupBy("recording_id", "eye", "entime", "binary", F.when(~F.col("binary"), F.col("event_seq")).alias("alone")).agg(F.min("sttime").alias("sttime"))
    o = Window.partitionBy("recording_id", "eye").orderBy("sttime", "entime", "alone")
    reach = F.max("entime").over(o.rowsBetween(Window.unboundedPreceding, -1))
    island = first.withColumn("_new", F.coalesce(~F.col("binary") | (F.col("sttime") > reach + 1), F.lit(True)).cast("int")).withColumn("_i", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = island.groupBy("recording_id", "eye", "_i").agg(F.min("sttime").alias("sttime"), F.max("entime").alias("entime")).select("recording_id", "sttime", "entime", "eye")
    out = out.withColumn("duration", F.col("entime") - F.col("sttime") + 1)
    return out.withColumn("event_seq", F.row_number().over(rid.orderBy("eye", "sttime")).cast("long"))


# -------------------------------------------------------------------------------------------------------------- joins


def stamp_events(samples: DataFrame, events: DataFrame, flag: str, columns: Mapping[str, str], longest: int | None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Writes an event's columns on the samples with sttime <= time <= entime; of several, the last in file order.

    Samples and events meet on time buckets, an equi-join; an event's buckets are bounded by ``longest``, beyond which (or
    with a negative duration) it is implausible and left out. ``columns``: sample column to event column.
    """
    span = F.col("entime") - F.col("sttime")
    e = events.where(F.col("sttime").isNotNull() & (span >= 0))
    e = e.where(span <= longest) if longest is not None else e
    e = e.select("recording_id", "event_seq", "sttime", "entime", *{c for c in columns.values() if c not in ("sttime", "entime", "event_seq")})
    e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("sttime") / bucket_ms), F.floor(F.col("entime") / bucket_ms))))
    s = samples.select("recording_id", "sample_idx", F.col("time").alias("_t"), F.floor(F.col("time") / bucket_ms).alias("_b"))
    hit = s.join(e, ["recording_id", "_b"]).where((F.col("_t") >= F.col("sttime")) & (F.col("_t") <= F.col("entime")))
    last = hit.groupBy("recording_id", "sample_idx").agg(F.max_by(F.struct(*(F.col(c).alias(n) for n, c in columns.items())), "event_seq").alias("_e"))
    out = samples.drop(flag, *columns).join(last, ["recording_id", "sample_idx"], "left")
    return out.withColumn(flag, F.col("_e").isNotNull()).withColumns({n: F.col(f"_e.{n}") for n in columns}).drop("_e")


def attach_messages(samples: DataFrame, messages: DataFrame, nearest_after: bool = False) -> DataFrame:
    """Joins each message to the first sample at exactly its time, several by "; " in file order; others are lost.

    ``nearest_after`` keeps those too, at the first sample after them: an as-of join by a running minimum.
    """
    w = Window.partitionBy("recording_id", "time").orderBy("sample_idx")
    first = samples.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("recording_id", "sample_idx", F.col("time").cast("double").alias("at"))
    if nearest_after:
        ask = messages.select("recording_id", F.col("sttime").cast("double").alias("at"), F.lit(None).cast("long").alias("sample_idx"), "event_seq", "message", F.lit(0).alias("side"))
        have = first.select("recording_id", "at", "sample_idx", F.lit(None).cast("long").alias("event_seq"), F.lit(None).cast("string").alias("message"), F.lit(1).alias("side"))
        # Backwards in time: a frame to the end of the partition would be gone through anew for each row.
        o = Window.partitionBy("recording_id").orderBy(F.desc_nulls_last("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = ask.unionByName(have).withColumn("sample_idx", F.last("sample_idx", ignorenulls=True).over(o)).where("side = 0").dropna(subset=["sample_idx"])
    else:
        placed = messages.withColumn("at", F.col("sttime").cast("double")).join(first, ["recording_id", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_seq", "message"))), lambda x: x["message"]), "; ")
    got = placed.groupBy("recording_id", "sample_idx").agg(text.alias("_m"))
    return samples.drop("message").join(got, ["recording_id", "sample_idx"], "left").withColumn("message", F.coalesce("_m", F.lit(""))).drop("_m")


# ---------------------------------------------------------------------------------------------------- trial variables


def parse_variables(events: DataFrame) -> DataFrame:
    """(recording, seq, sttime, variable, value) of the messages that hold TRIAL_VAR."""
    m = parse_messages(events).where(F.contains("message", F.lit("TRIAL_VAR")))
    body = F.trim(F.regexp_replace("message", r"^\s*!V\s*TRIAL_VAR\s*", ""))
    parts = F.split(body, " ", 2)
    return m.select("recording_id", "event_seq", "sttime", F.get(parts, F.lit(0)).alias("variable"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"))


def trial_numbers(variables: DataFrame, trial_marker: str | None = None) -> DataFrame:
    """The trial of each variable row. With a marker, each of its rows starts a trial (rows before the first are
    trial 0). Without one, a trial starts where a name comes back: a fold over a recording's variables, which are
    few (names by trials), in one grouped function."""
    if trial_marker is not None:
        w = Window.partitionBy("recording_id").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return variables.withColumn("trial", F.sum((F.col("variable") == trial_marker).cast("long")).over(w))

    def fold(pdf):
        pdf = pdf.sort_values("event_seq", kind="stable")
        seen, trial, out = set(), 1, []
        for name in pdf["variable"]:
            if name in seen:
                trial += 1
                seen = set()
            seen.add(name)
            out.append(trial)
        return pdf[["recording_id", "event_seq"]].assign(trial=out)

    got = variables.select("recording_id", "event_seq", "variable").groupBy("recording_id").applyInPandas(fold, "recording_id string, event_seq long, trial long")
    return variables.join(got, ["recording_id", "event_seq"])


def trial_table(variables: DataFrame, trial_marker: str | None = None, names: list[str] | None = None) -> DataFrame:
    """One row for each trial, a column for each variable (the last value wins, "" where it is absent)."""
    v = trial_numbers(variables, trial_marker).where("trial > 0")
    last = F.max_by(F.trim("value"), "event_seq")
    times = v.groupBy("recording_id", "trial").agg(F.min("sttime").alias("sttime_min"), F.max("sttime").alias("sttime_max"))
    if trial_marker is not None:
        label = v.where(F.col("variable") == trial_marker).groupBy("recording_id", "trial").agg(F.max_by("value", "event_seq").alias("trial_label"))
        times = times.join(label, ["recording_id", "trial"], "left")
        v = v.where(F.col("variable") != trial_marker)
    pivot = v.groupBy("recording_id", "trial").pivot("variable", names).agg(last) if names else v.groupBy("recording_id", "trial").pivot("variable").agg(last)
    cols = [c for c in pivot.columns if c not in ("recording_id", "trial")]
    out = times.join(pivot, ["recording_id", "trial"], "left")
    return out.fillna("", subset=cols) if cols else out


def join_variables(samples: DataFrame, trials: DataFrame) -> DataFrame:
    """Adds the variables of a sample's trial; names that samples already have get a number."""
    cols = {}
    for c in trials.columns:
        if c in ("recording_id", "trial", "sttime_min", "sttime_max"):
            continue
        name, k = c, 1
        while name in samples.columns or name in cols.values():
            name, k = f"{c}_{k}", k + 1
        cols[c] = name
    return samples.join(trials.select("recording_id", "trial", *(F.col(f"`{c}`").alias(n) for c, n in cols.items())), ["recording_id", "trial"], "left")


def parse_aois(events: DataFrame) -> DataFrame:
    """C11: rectangles from ``!V IAREA RECTANGLE index left top right bottom label`` messages; zeros where they don't parse."""
    m = parse_messages(events).where(F.startswith("message", F.lit("!V IAREA RECTANGLE")))
    parts = F.split(F.trim(F.expr("replace(message, '!V IAREA RECTANGLE', '')")), " ", -1)
    d = m.withColumn("_p", parts)
    number = [F.get("_p", F.lit(i)).try_cast("int") for i in range(5)]
    ok = number[0].isNotNull()
    for n in number[1:]:
        ok = ok & n.isNotNull()
    zero = lambda c: F.when(ok, c).otherwise(0)
    label = F.when(ok & (F.size("_p") > 5), F.array_join(F.slice("_p", 6, F.greatest(F.size("_p") - 5, F.lit(1))), " ")).otherwise("")
    names = ["aoi_index", "left", "top", "right", "bottom"]
    return d.select("recording_id", "sttime", *(zero(c).alias(n) for n, c in zip(names, number, strict=True)), label.alias("label"))


def screen_size(events: DataFrame) -> DataFrame:
    """(recording, screen_w, screen_h) from the first DISPLAY_COORDS message, 1920 x 1080 if it doesn't parse."""
    m = parse_messages(events).where(F.startswith("message", F.lit("DISPLAY_COORDS")))
    first = m.groupBy("recording_id").agg(F.min_by("message", "event_seq").alias("m"))
    p = F.split("m", r"\s+")
    right, bottom = F.get(p, F.lit(3)).try_cast("int"), F.get(p, F.lit(4)).try_cast("int")
    ok = right.isNotNull() & bottom.isNotNull()
    return first.select("recording_id", F.when(ok, right + 1).otherwise(1920).alias("screen_w"), F.when(ok, bottom + 1).otherwise(1080).alias("screen_h"))


def image_loads(events: DataFrame) -> DataFrame:
    """C14: (recording, sttime, mode, x, y, file) of ``!V IMGLOAD`` messages: FILL, CENTER, TOP_LEFT or plain coordinates."""
    m = parse_messages(events).where(F.contains("message", F.lit("IMGLOAD")))
    p = F.split(F.trim(F.regexp_replace("message", r"^.*IMGLOAD\s+", "")), r"\s+")
    head = F.upper(F.get(p, F.lit(0)))
    named = head.isin("FILL", "CENTER", "TOP_LEFT")
    x = F.when(named, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(0))).try_cast("double")
    y = F.when(named, F.get(p, F.lit(3))).otherwise(F.get(p, F.lit(1))).try_cast("double")
    path = F.when(named, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(2)))
    return m.select("recording_id", "sttime", F.when(named, head).otherwise("AT").alias("mode"), x.alias("x"), y.alias("y"), F.regexp_extract(path, r"([^/\\]*)$", 1).alias("file"))


def match_stimuli(names: DataFrame, stimuli: DataFrame, column: str = "file") -> DataFrame:
    """Stimuli by exact name, else by stem in lower case."""
    stem = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    s = stimuli.select(F.col("name").alias("_n"), F.col("content").alias("stimulus"), stem("name").alias("_s"))
    n = names.withColumn("_k", F.monotonically_increasing_id())
    exact = n.join(s, n[column] == s["_n"]).select("_k", "stimulus", F.lit(0).alias("_r"), "_n")
    loose = n.join(s, stem(n[column]) == s["_s"]).select("_k", "stimulus", F.lit(1).alias("_r"), "_n")
    best = exact.unionByName(loose).groupBy("_k").agg(F.min_by("stimulus", F.struct("_r", "_n")).alias("stimulus"))
    return n.join(best, "_k", "left").drop("_k")


# ----------------------------------------------------------------------------------------------------------- messages


def messages(gf: GazeFrame) -> DataFrame:
    """(recording, time, message) of the samples' messages, split at "; "."""
    d = gf.df.where(F.coalesce(F.col("message"), F.lit("")) != "")
    e = d.select("recording_id", "sample_idx", "time", F.posexplode(F.split("message", "; ")).alias("k", "message"))
    return e.withColumn("message", F.trim("message")).where("message <> ''").select("recording_id", "time", "message")


def message_summary(gf: GazeFrame) -> DataFrame:
    """(message, example, count) by message, or by first word where messages have few of them; most frequent first."""
    per = messages(gf).groupBy("message").agg(F.count(F.lit(1)).alias("count")).withColumn("word", F.regexp_extract("message", r"^(\S*)", 1))
    sizes = per.agg(F.countDistinct("word").alias("w"), F.count(F.lit(1)).alias("m"))
    d = per.crossJoin(F.broadcast(sizes)).withColumn("few", F.col("w") < 0.5 * F.col("m"))  # one row
    key = F.when(F.col("few"), F.col("word")).otherwise(F.col("message"))
    return d.groupBy(key.alias("message")).agg(F.max_by("message", F.struct(F.length("message"), F.col("message"))).alias("example"), F.sum("count").alias("count")).orderBy(F.desc("count"), "message")


def variables(gf: GazeFrame) -> DataFrame:
    """The trial variables: the first row of each trial without the samples' own columns."""
    own = [c for c in gf.df.columns if c not in S.SAMPLE_COLUMNS]
    d = gf.df.where(F.col("trial").isNotNull()).withColumn("_k", F.row_number().over(ordered(("recording_id", "trial"))))
    return d.where("_k = 1").select("recording_id", "trial", *own)


def estimate_sample_rate(samples: DataFrame) -> DataFrame:
    """(recording, sample_rate): 1000 over the median positive step of the first 1000 rows; 1000 without any."""
    w = ordered(RECORDING)
    d = samples.withColumn("_k", F.row_number().over(w)).where("_k <= 1000")
    step = F.col("time").cast("double") - F.lag("time").over(w).cast("double")
    d = d.withColumn("_d", step)
    rate = F.rint(1000.0 / F.median(F.when(F.col("_d") > 0, F.col("_d"))))
    return d.groupBy("recording_id").agg(F.coalesce(rate, F.lit(1000.0)).alias("sample_rate"))


# --------------------------------------------------------------------------------------------------------- the builder


def annotate(raw: RawRecording, include_variables: bool = True, trial_time_zero: str | None = None, nearest_after: bool = False) -> GazeFrame:
    """The canonical sample table of raw recordings, as one lazy plan; metadata take one small aggregate."""
    d = nan_to_null(raw.samples)
    have = set(d.columns)
    for c in (*S.GAZE, *S.RAW_PUPIL):
        if c not in have:
            d = d.withColumn(c, F.lit(None).cast("double"))
    d = d.withColumn("participant", F.col("participant") if "participant" in have else F.lit("")).withColumn("time", F.col("time").cast("double"))
    d = d.select("recording_id", "sample_idx", "time", "trial", "participant", *S.GAZE, *S.RAW_PUPIL)
    e = nan_to_null(raw.events)
    d = stamp_events(d, parse_fixations(e), "in_fix", {"fix_gavx": "gavx", "fix_gavy": "gavy", "fix_ava": "ava", "fix_dur": "duration"}, 30_000)
    d = stamp_events(d, parse_saccades(e), "in_sacc", {"sacc_gstx": "gstx", "sacc_gsty": "gsty", "sacc_genx": "genx", "sacc_geny": "geny", "sacc_dur": "duration", "sacc_ampl": "ampl", "sacc_pvel": "pvel"}, 5_000)
    d = stamp_events(d, parse_blinks(e, d), "in_blink", {"blink_dur": "duration"}, None)
    d = attach_messages(d, parse_messages(e), nearest_after)
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("fix_dur", "sacc_dur", "blink_dur")}).select(*S.SAMPLES.names)
    if include_variables:
        v = parse_variables(e)
        names = sorted({r[0] for r in v.select("variable").distinct().collect()})  # variable names
        if names:
            d = join_variables(d, trial_table(v, names=names))
    size = screen_size(e).limit(1).collect()
    rates = [r[0] for r in raw.recordings.where("sample_rate > 0").orderBy("recording_id", "time").limit(1).select("sample_rate").collect()] if raw.recordings is not None else []
    rate = float(rates[0]) if rates else float((estimate_sample_rate(nan_to_null(raw.samples)).orderBy("recording_id").limit(1).collect() or [(None, 1000.0)])[0][1])
    meta = RecordingMeta(source=raw.meta.source, sample_rate=rate, screen_w=size[0]["screen_w"] if size else 1920, screen_h=size[0]["screen_h"] if size else 1080, screen_width_cm=raw.meta.screen_width_cm, viewing_distance_cm=raw.meta.viewing_distance_cm)
    gf = GazeFrame(d, meta)
    return with_time_rel(gf, trial_time_zero) if trial_time_zero is not None else gf


