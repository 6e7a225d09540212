"""EyeLink text recordings: a line classifier and a chronological writer, both in DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeframe import schema as S
from gazeframe.frame import RecordingMeta
from gazeframe.operators.annotate import RawRecording, parse_blinks, parse_fixations, parse_messages, parse_saccades
from gazeframe.sources.files import lines

_EVENT_FLOATS = [f.name for f in S.EVENTS.fields if f.dataType.simpleString() == "double"]


def token(parts: Column, k: int) -> Column:
    return F.get(parts, F.lit(k))


def number(t: Column) -> Column:
    """A float, NULL for a token that is empty, of dots and capitals, or otherwise no number."""
    return F.when(~F.coalesce(t, F.lit("")).rlike("^[.A-Z]*$"), t.try_cast("double"))


def eye_code(t: Column) -> Column:
    return F.when(t == "R", S.RIGHT).when(t == "L", S.LEFT).otherwise(S.BINOCULAR).cast("short")


def classify(text: DataFrame, start_marker: str = S.TRIAL_START_MARKER, end_marker: str = S.TRIAL_END_MARKER) -> DataFrame:
    """Adds a line's kind, tokens, message and trial. A trial is counted at each message that begins with the start
    marker; lines outside a start and an end have none."""
    # Exploding one element makes the tokens a column that is split once, not an expression repeated in each use.
    d = text.select("*", F.explode(F.array(F.split(F.trim("line"), r"[ \t]+"))).alias("p"))
    head = token(F.col("p"), 0)
    kind = (
        F.when(F.startswith("line", F.lit("**")), "preamble")
        .when(F.col("line").rlike("^[0-9]"), "sample")
        .when(head.isin("MSG", "EFIX", "ESACC", "EBLINK", "INPUT", "START", "END"), head)
    )
    d = d.withColumn("kind", kind)
    d = d.withColumn("text", F.when(F.col("kind") == "MSG", F.regexp_extract("line", r"^MSG\s+\d+\s?(.*)$", 1)))
    mark = F.when(F.startswith("text", F.lit(start_marker)), 1).when(F.startswith("text", F.lit(end_marker)), 0)
    w = Window.partitionBy("recording_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_m", mark)
    count, inside = F.sum(F.when(F.col("_m") == 1, 1).otherwise(0)).over(w), F.last("_m", ignorenulls=True).over(w)
    return d.withColumn("trial", F.when(inside == 1, count).cast("long")).drop("_m")


def samples_of(d: DataFrame) -> DataFrame:
    """Sample lines: both eyes from seven tokens whose fifth is a number; a single eye is the right one."""
    p = F.col("p")
    d = d.where((F.col("kind") == "sample") & (F.size("p") >= 4) & token(p, 0).try_cast("long").isNotNull())
    both = (F.size("p") >= 7) & token(p, 4).try_cast("double").isNotNull()
    first = {"gxL": 1, "gyL": 2, "paL": 3}
    right = {"gxR": (4, 1), "gyR": (5, 2), "paR": (6, 3)}
    return d.select(
        "recording_id", F.col("n").alias("sample_idx"), token(p, 0).try_cast("long").alias("time"), "trial",
        *(F.when(both, number(token(p, k))).alias(c) for c, k in first.items()), *(F.when(both, number(token(p, a))).otherwise(number(token(p, b))).alias(c) for c, (a, b) in right.items()),
    )


def events_of(d: DataFrame) -> DataFrame:
    """Messages, ends of fixations, saccades and blinks, and inputs, in the raw events' columns."""
    p = F.col("p")
    least = {"MSG": 2, "EFIX": 8, "ESACC": 11, "EBLINK": 5, "INPUT": 3}
    enough = F.lit(False)
    for k, n in least.items():
        enough = enough | ((F.col("kind") == k) & (F.size("p") >= n))
    d = d.where(enough)
    kind = F.col("kind")
    code = F.when(kind == "MSG", S.MESSAGE).when(kind == "EFIX", S.END_FIX).when(kind == "ESACC", S.END_SACC).when(kind == "EBLINK", S.END_BLINK).otherwise(S.INPUT).cast("short")
    span = kind.isin("EFIX", "ESACC", "EBLINK")
    st = F.when(span, token(p, 2)).otherwise(token(p, 1)).try_cast("long")
    en = F.when(span, token(p, 3)).otherwise(token(p, 1)).try_cast("long")
    at = lambda k, i: F.when(kind == k, number(token(p, i)))
    fix = {"gavx": 5, "gavy": 6, "ava": 7}
    sacc = {"gstx": 5, "gsty": 6, "genx": 7, "geny": 8, "ampl": 9, "pvel": 10}
    cols = {c: at("EFIX", i) for c, i in fix.items()} | {c: at("ESACC", i) for c, i in sacc.items()}
    values = {
        "recording_id": F.col("recording_id"), "event_seq": F.col("n"), "time": F.when(span, en).otherwise(st), "type": code, "sttime": st, "entime": en, "eye": F.when(span, eye_code(token(p, 1))).otherwise(F.lit(S.BINOCULAR).cast("short")),
        "input": F.when(kind == "INPUT", token(p, 2).try_cast("int")).otherwise(0), "message": F.coalesce("text", F.lit("")),
    } | cols
    return d.select(*((values[f.name] if f.name in values else F.lit(0 if f.name not in _EVENT_FLOATS else None)).cast(f.dataType).alias(f.name) for f in S.EVENTS.fields)).where("sttime is not null")


def recordings_of(d: DataFrame) -> DataFrame:
    """START and END lines; text files don't tell the rate there, so it is 0."""
    p = F.col("p")
    d = d.where(F.col("kind").isin("START", "END") & (F.size("p") >= 2))
    eye = F.when(F.array_contains(p, "LEFT") & F.array_contains(p, "RIGHT"), S.BINOCULAR).when(F.array_contains(p, "RIGHT"), S.RIGHT).otherwise(S.LEFT)
    values = {"recording_id": F.col("recording_id"), "time": token(p, 1).try_cast("long"), "sample_rate": F.lit(0.0), "state": F.when(F.col("kind") == "START", S.RECORDING_START).otherwise(S.RECORDING_END), "record_type": F.lit(3), "eye": eye, "trial": F.col("trial")}
    return d.select(*((values[f.name] if f.name in values else F.lit(0)).cast(f.dataType).alias(f.name) for f in S.RECORDINGS.fields))


def read_eyelink_text(spark: SparkSession, paths: str | Sequence[str], load_samples: bool = True, start_marker: str = S.TRIAL_START_MARKER, end_marker: str = S.TRIAL_END_MARKER) -> RawRecording:
    """Samples, events and recording blocks of text recordings; ``load_samples=False`` leaves samples out."""
    d = classify(lines(spark, paths), start_marker, end_marker)
    s = samples_of(d)
    return RawRecording(s if load_samples else s.limit(0), events_of(d), recordings_of(d), None, RecordingMeta(source="eyelink"))


# --------------------------------------------------------------------------------------------------------------- writer


def fixed1(c: Column, width: int = 7) -> Column:
    """One decimal, half to even, right-aligned; a dot for a missing value; inf and nan as C spells them."""
    t = F.replace(F.lower(F.format_string("%.1f", F.rint(c.cast("double") * 10.0) / 10.0)), F.lit("infinity"), F.lit("inf"))
    return F.when(c.isNull(), F.lpad(F.lit("."), width, " ")).otherwise(F.lpad(t, F.greatest(F.lit(width), F.length(t)), " "))


def eye_letter(c: Column) -> Column:
    return F.when(c == S.RIGHT, "R").otherwise("L")


def eye_name(c: Column) -> Column:
    """A single eye's name, or both with a tab."""
    return F.when(c == S.RIGHT, "RIGHT").when(c == S.BINOCULAR, "LEFT\tRIGHT").otherwise("LEFT")


def _line(d: DataFrame, ts: Column, priority: float, seq: Column, text: Column, sub: int = 0) -> DataFrame:
    return d.select("recording_id", ts.cast("long").alias("ts"), F.lit(float(priority)).alias("priority"), seq.cast("long").alias("seq"), F.lit(sub).alias("sub"), text.alias("line"))


def _beside(d: DataFrame, of: DataFrame) -> DataFrame:
    """``d`` with what ``of`` has for its recording, if anything; a recording without a name is one too."""
    return d.join(of.withColumnRenamed("recording_id", "_of"), F.col("recording_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def ascii_lines(raw: RawRecording, include_samples: bool = True, include_events: bool = True, include_messages: bool = True, longest: int | None = None) -> DataFrame:
    """(recording_id, ts, priority, seq, sub, line): what the writer puts in time order. Messages and starts come before
    the sample of their time (0), ends after it (1); a union of formatted lines that one sort merges. A recording without a START
    is written from its first line, one without an END to its last, or (``longest``) to so many ms after its start. A sample without a
    time has a NULL line, as it has no place in the order."""
    e, r = raw.events, raw.recordings
    start = F.min(F.when((F.col("state") == S.RECORDING_START) & F.col("sample_rate").between(100, 2000), F.col("time")))
    low = r.groupBy("recording_id").agg(F.coalesce(start, F.min("time")).alias("low"))
    high = _beside(r, low).where((F.col("state") == S.RECORDING_END) & (F.col("time") > F.col("low"))).groupBy("recording_id").agg((F.max("time") + 5000).alias("high"))
    bounds = _beside(low, high)
    open_end = F.lit(2**63 - 1) if longest is None else F.coalesce("low", F.lit(0)) + longest
    bounded = lambda d: _beside(d, bounds).withColumns({"low": F.coalesce("low", F.lit(-(2**63))), "high": F.coalesce("high", open_end)})
    e = bounded(e)
    st, en, eye, seq = F.col("sttime"), F.col("entime"), eye_letter(F.col("eye")), F.col("event_seq")
    parts: list[DataFrame] = []
    if include_events:
        first = r.withColumn("_k", F.row_number().over(Window.partitionBy("recording_id", "trial").orderBy("time"))).where((F.col("_k") == 1) & (F.col("state") == S.RECORDING_START))
        rate, name = F.format_string("%.2f", F.col("sample_rate").cast("double")), eye_name(F.col("eye"))
        pupil = F.when(F.col("pupil_type") == 1, "DIAMETER").otherwise("AREA")
        tail = F.concat(name, F.lit("\tRATE\t"), rate, F.lit("\tTRACKING\tCR\tFILTER\t2"))
        block = [F.concat(F.lit("START\t"), F.col("time").cast("string"), F.lit(" \t"), name, F.lit("\tSAMPLES\tEVENTS")), F.lit("PRESCALER\t1"), F.lit("VPRESCALER\t1"), F.concat(F.lit("PUPIL\t"), pupil), F.concat(F.lit("EVENTS\tGAZE\t"), tail), F.concat(F.lit("SAMPLES\tGAZE\t"), tail)]
        parts += [_line(first, F.col("time"), 0, F.lit(-1), t, k) for k, t in enumerate(block)]
        parts.append(_line(e.where((F.col("type") == S.INPUT) & (F.col("input") > 0) & (st > 0) & (st <= F.col("high"))), st, 0, seq, F.concat_ws("\t", F.lit("INPUT"), st.cast("string"), F.col("input").cast("string"))))
        for code, word in ((S.START_SACC, "SSACC"), (S.START_FIX, "SFIX"), (S.START_BLINK, "SBLINK")):
            parts.append(_line(e.where((F.col("type") == code) & st.between(F.col("low"), F.col("high"))), st, 0, seq, F.concat(F.rpad(F.concat(F.lit(word + " "), eye), 9, " "), st.cast("string"))))
        ended = lambda d: bounded(d).where((st >= F.col("low")) & (en <= F.col("high")))
        span = lambda word: F.concat_ws("\t", F.concat(F.rpad(F.concat(F.lit(word + " "), eye), 9, " "), st.cast("string")), en.cast("string"), (en - st + 1).cast("string"))
        f61 = lambda c: F.format_string("%6.1f", F.coalesce(c, F.lit(0.0)))
        rd = lambda c, d=1: F.rint(F.coalesce(F.col(c), F.lit(0.0)) * 10.0**d) / 10.0**d
        sa = ended(parse_saccades(raw.events))
        dx, dy = rd("genx") - rd("gstx"), rd("geny") - rd("gsty")
        ampl = F.when(F.coalesce(F.col("ampl"), F.lit(0.0)) != 0, F.col("ampl")).otherwise(F.rint(F.sqrt(dx * dx + dy * dy) / 10.0 * 100.0) / 100.0)
        parts.append(_line(sa, en, 1, seq, F.concat_ws("\t", span("ESACC"), *(f61(rd(c)) for c in ("gstx", "gsty", "genx", "geny")), F.format_string("%6.2f", ampl), F.format_string("%6.0f", F.rint(F.coalesce("pvel", F.lit(0.0)))))))
        fx = ended(parse_fixations(raw.events))
        parts.append(_line(fx, en, 1, seq, F.concat_ws("\t", span("EFIX"), f61(rd("gavx")), f61(rd("gavy")), F.format_string("%6d", F.rint(F.coalesce("ava", F.lit(0.0))).cast("long")))))
        parts.append(_line(ended(parse_blinks(raw.events, raw.samples)), en, 1, seq, span("EBLINK")))
        last = raw.samples.groupBy("recording_id").agg((F.max("time") + 1).alias("t"))
        end = F.concat(F.lit("END\t"), F.col("t").cast("long").cast("string"), F.lit("\tSAMPLES\tEVENTS\tRES\t0.0\t0.0"))
        parts.append(_line(last, F.col("t"), 0, F.lit(-2), end))
    if include_messages:
        m = bounded(parse_messages(raw.events)).where((st > 0) & (st <= F.col("high")) & ~F.col("message").rlike(r"[\p{Cc}&&[^\n\t]]"))
        m = m.select("recording_id", "sttime", "event_seq", F.posexplode(F.split("message", "\n")).alias("sub", "part")).where((F.col("sub") == 0) | (F.trim("part") != ""))
        text = F.when(F.col("sub") == 0, F.concat(F.lit("MSG\t"), st.cast("string"), F.lit(" "), F.col("part"))).otherwise(F.col("part"))
        parts.append(m.select("recording_id", st.alias("ts"), F.lit(0.0).alias("priority"), seq.alias("seq"), F.col("sub"), text.alias("line")))
    if include_samples:
        s = raw.samples
        for c in ("gxL", "gyL", "paL", "gxR", "gyR", "paR"):
            s = s if c in s.columns else s.withColumn(c, F.lit(None).cast("double"))
        # An eye is written if it has an x; where neither has one, by its y and pupil, and as dots where there is nothing at all.
        has = lambda *c: F.count(F.coalesce(*c)) > 0
        eye = lambda e: F.when(has("gxL", "gxR"), has(f"gx{e}")).otherwise(has(f"gy{e}", f"pa{e}"))
        s = bounded(_beside(s, s.groupBy("recording_id").agg(eye("L").alias("l"), eye("R").alias("r")))).where(F.col("time").isNull() | F.col("time").between(F.col("low"), F.col("high")))
        group = lambda e: F.concat_ws("\t", *(fixed1(F.col(f"{c}{e}")) for c in ("gx", "gy", "pa")))
        body = F.when(F.col("l") & F.col("r"), F.concat_ws("\t", group("L"), group("R"))).when(F.col("r"), group("R")).otherwise(group("L"))
        parts.append(_line(s, F.col("time"), 0.5, F.col("sample_idx"), F.concat(F.col("time").cast("long").cast("string"), F.lit("\t"), body, F.lit("\t..."))))
    if not parts:
        raise ValueError("nothing to write: samples, events and messages are all left out")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_eyelink_text(raw: RawRecording, path: str, preamble: str = "", **include: bool | int | None) -> None:
    """A text file for each recording below ``path/recording_id=...``: a header, then all lines in time order.

    Recordings are sorted apart: rows are dealt out by recording and sorted within it.
    """
    body = ascii_lines(raw, **include).where("line is not null")
    head = [x if x.startswith("**") else f"** {x}" for x in preamble.splitlines() if x.strip() and not x.startswith(("ENDP", "SR_RESEARCH"))]
    head = ["** CONVERTED BY gazeframe", *head, "**", ""]
    ids = body.select("recording_id").distinct()
    top = ids.select("recording_id", F.lit(-1).cast("long").alias("ts"), F.lit(0.0).alias("priority"), F.posexplode(F.array(*(F.lit(x) for x in head))).alias("seq", "line")).withColumn("sub", F.lit(0))
    every = body.unionByName(top.withColumn("seq", F.col("seq").cast("long")).select(*body.columns))
    ordered = every.repartition("recording_id").sortWithinPartitions("recording_id", "ts", "priority", "seq", "sub")
    ordered.select("recording_id", "line").write.mode("overwrite").partitionBy("recording_id").text(path)
