"""SMI recordings: tab-separated exports read and written by DataFrame functions, binary files decoded one per task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame, RecordingMeta
from gazeframe.sources.files import contents, lines

_EYE = ("Raw X", "Raw Y", "Dia X", "Dia Y", "CR1 X", "CR1 Y", "POR X", "POR Y")
_SAMPLES = "recording_id string, sample_idx long, time double, trial long, participant string, gxL double, gyL double, paL double, gxR double, gyR double, paR double, pupxL double, pupyL double, pupxR double, pupyR double, message string"


def _header(first: DataFrame) -> tuple[dict[str, list[str]], list[str], str]:
    """The header of the first recording: values by key, columns, and the recording's name. A few dozen lines."""
    heads = first.where(F.startswith(F.trim("line"), F.lit("##")) | (F.split("line", "\t")[0] == "Time"))
    top = heads.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("own")).orderBy("recording_id").limit(1).collect()  # a header's lines
    if not top:
        raise ValueError("no header: not an SMI text export")
    own = top[0]["own"]
    values = {}
    for r in own:
        t = r["line"].strip()
        if t.startswith("##"):
            key, _, rest = t.lstrip("#").strip().partition(":")
            values[key.strip()] = [x.strip() for x in rest.split("\t") if x.strip()]
    cols = next((r["line"] for r in own if r["line"].startswith("Time\t")), None)
    if cols is None:
        raise ValueError("no line of column names: not an SMI text export")
    return values, [c.strip() for c in cols.split("\t")], top[0]["recording_id"]


def read_smi_text(spark: SparkSession, paths: str | Sequence[str]) -> GazeFrame:
    """Sample rows of text exports, each with its own header's columns: gaze from POR, else raw; pupil from both diameters; zeros
    are missing; times in ms; a trigger is a message. Geometry comes from the header, 30 cm and 50 cm without it."""
    text = lines(spark, paths)
    head, _, _ = _header(text)
    # Columns and subject are those of the recording's own header; geometry and rate are the first recording's.
    own = text.where(F.startswith("line", F.lit("Time\t"))).groupBy("recording_id").agg(F.min_by("line", "n").alias("names"))
    subjects = text.where(F.ltrim("line").rlike("^#+ *Subject:")).groupBy("recording_id").agg(F.min_by(F.trim(F.regexp_extract("line", r"Subject:\s*(.*)$", 1)), "n").alias("subject"))
    own = own.join(subjects, "recording_id", "left").select("recording_id", F.coalesce("subject", F.lit("")).alias("subject"), F.transform(F.split("names", "\t"), lambda c: F.trim(F.regexp_replace(c, r"[\r\n]", ""))).alias("names"))
    last = lambda k, default: (head.get(k) or [default])[-1]
    p = F.split(F.trim("line"), "\t", -1)
    field = lambda c: F.trim(F.get(F.col("p"), (F.array_position("names", c) - 1).cast("int")))
    num = lambda c: field(c).try_cast("double")
    d = text.join(F.broadcast(own), "recording_id").withColumn("p", p).where(field("Type") == "SMP")
    zero = lambda x, y, v: F.when(~((F.coalesce(x, F.lit(0.0)) == 0) & (F.coalesce(y, F.lit(0.0)) == 0)), v)
    out: dict[str, Column] = {}
    for e in "LR":
        rx, ry, px, py = (num(f"{e} {c} [px]") for c in ("Raw X", "Raw Y", "POR X", "POR Y"))
        por = F.array_contains("names", f"{e} POR X [px]")
        gx, gy = F.when(por, px).otherwise(rx), F.when(por, py).otherwise(ry)
        dx, dy = num(f"{e} Dia X [px]"), num(f"{e} Dia Y [px]")
        pa = (dx + F.coalesce(dy, dx)) / 2.0
        out |= {f"gx{e}": zero(gx, gy, gx), f"gy{e}": zero(gx, gy, gy), f"pa{e}": F.when(pa != 0, pa), f"pupx{e}": zero(rx, ry, rx), f"pupy{e}": zero(rx, ry, ry)}
    trigger = F.coalesce(field("Trigger"), F.lit("0"))
    d = d.select(
        "recording_id", F.col("n").alias("sample_idx"), (num("Time") / 1000.0).alias("time"), field("Trial").try_cast("long").alias("trial"), F.col("subject").alias("participant"),
        *(out[c].alias(c) for c in ("gxL", "gyL", "paL", "gxR", "gyR", "paR", "pupxL", "pupyL", "pupxR", "pupyR")), F.when(trigger.isin("0", ""), "").otherwise(trigger).alias("message"),
    )
    area, size = head.get("Calibration Area", []), head.get("Stimulus Dimension [mm]", [])
    w, h = (int(area[-2]), int(area[-1])) if len(area) >= 2 else (1280, 1024)
    mm = float(size[-2]) if len(size) >= 2 else 0.0
    away = float(last("Head Distance [mm]", 0) or 0)
    rate = float(last("Sample Rate", 0) or 0)
    meta = RecordingMeta("smi", rate or 50.0, w, h, mm / 10 if mm > 0 else 30.0, away / 10 if away > 0 else 50.0)
    return GazeFrame(d, meta)


# ---- binary files. Places within a record of 106 bytes, from its start; doubles are little-endian.
RECORD = 106
TIME_AT, TRIGGER_AT = 4, 102
DOUBLES = {"px": 24, "py": 32, "dx": 40, "dy": 48, "cx": 56, "cy": 64, "gx": 72, "gy": 80}
RATE_AT, RATE_NEEDS = 0x2D2, 0x2DC


def decode_idf(content: bytes) -> tuple[pd.DataFrame, float]:
    """Samples of one binary recording and its rate. Records are found by three steady timestamps in a row."""
    start = content.find(b"TimeSt")
    if start < 0:
        raise ValueError("no column names: not an SMI recording")
    end = start
    while end < len(content) and 0x20 <= content[end] <= 0x7E:
        end += 1
    names = content[start:end].decode("ascii").split()
    right = any(n.startswith("R") for n in names)
    pos = end
    while pos < len(content) and content[pos] == 0:
        pos += 1
    stamp = lambda o: int.from_bytes(content[o + TIME_AT : o + TIME_AT + 4], "little")
    first = None
    for o in range(pos, min(pos + 64, len(content) - 4 * RECORD - 1) + 1, 4):
        t = [stamp(o + k * RECORD) for k in range(3)]
        a, b = ((t[k + 1] - t[k]) % 2**32 for k in (0, 1))
        if t[0] > 1_000_000 and a > 0 and b > 0 and abs(b - a) < 0.05 * a:
            first = o
            break
    if first is None:
        raise ValueError("no records found: use the text export")
    n = (len(content) - first) // RECORD
    kind = np.dtype({"names": ["t", "trig", *DOUBLES], "formats": ["<u4", ("u1", 2), *["<f8"] * len(DOUBLES)], "offsets": [TIME_AT, TRIGGER_AT, *DOUBLES.values()], "itemsize": RECORD})
    rec = np.frombuffer(content, kind, n, first)
    raw = rec["t"].astype(np.int64)
    time = (raw + np.concatenate([[0], np.cumsum(np.diff(raw) < 0)]) * 2**32) / 256_000.0
    low, high = rec["trig"][:, 0].astype(int), rec["trig"][:, 1].astype(int)
    trigger = (high >> 4) * 1000 + (high & 15) * 100 + (low >> 4) * 10 + (low & 15)
    v = {k: rec[k].copy() for k in DOUBLES}
    pupil = (v["dx"] + v["dy"]) / 2
    left = (np.arange(n) % 2 == 0) | (not right)
    lost, dark = (v["gx"] == 0) & (v["gy"] == 0), pupil == 0
    out = {"time": time, "trial": 1, "participant": ""}
    for e, own in (("L", left), ("R", ~left)):
        keep = lambda x, bad, own=own: np.where(own & ~bad, x, np.nan)
        out |= {f"gx{e}": keep(v["gx"], lost), f"gy{e}": keep(v["gy"], lost), f"pa{e}": keep(pupil, dark), f"pupx{e}": keep(v["px"], dark | (v["px"] == 0)), f"pupy{e}": keep(v["py"], dark | (v["py"] == 0))}
        out |= {f"diax{e}": keep(v["dx"], dark), f"diay{e}": keep(v["dy"], dark), f"crx{e}": keep(v["cx"], v["cx"] == 0), f"cry{e}": keep(v["cy"], v["cy"] == 0)}
    out["message"] = np.where(trigger > 0, trigger.astype(str), "")
    rate = int.from_bytes(content[RATE_AT : RATE_AT + 4], "little", signed=True) if len(content) > RATE_NEEDS else 0
    if not 0 < rate <= 2000:
        step = np.diff(pd.unique(time[:2000]))
        step = step[step > 0]
        rate = round(1000.0 / float(np.median(step))) if len(step) else 50
    return pd.DataFrame(out), float(rate)


_DIAGNOSTICS = ("diaxL", "diayL", "diaxR", "diayR", "crxL", "cryL", "crxR", "cryR")


def read_smi_binary(spark: SparkSession, paths: str | Sequence[str], diagnostics: bool = False) -> GazeFrame:
    """Binary recordings, one task a file; the rate of the first sets the frame's. 30 cm and 60 cm are taken."""
    files = contents(spark, paths)
    schema = _SAMPLES + ", " + ", ".join(f"{c} double" for c in _DIAGNOSTICS) + ", _rate double"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, content in zip(pdf["recording_id"], pdf["content"], strict=True):
                d, rate = decode_idf(bytes(content))
                d.insert(0, "recording_id", rid)
                d.insert(1, "sample_idx", range(len(d)))
                d["_rate"] = rate
                yield d

    d = files.mapInPandas(decode, schema)
    # Only the first file is decoded for its rate.
    paths = [paths] if isinstance(paths, str) else list(paths)
    first = sorted(spark.read.format("binaryFile").load(paths).inputFiles())[:1]
    got = contents(spark, [unquote(first[0])]).mapInPandas(lambda it: (x.head(1) for x in decode(it)), schema).select("_rate").limit(1).collect() if first else []
    meta = RecordingMeta("smi", got[0][0] if got else 50.0, 1280, 1024, 30.0, 60.0)
    d = d.drop("_rate", *(() if diagnostics else _DIAGNOSTICS))
    from gazeframe.functions.numeric import nan_to_null

    return GazeFrame(nan_to_null(d), meta)


def trigger_events(gf: GazeFrame) -> DataFrame:
    """(recording_id, time, type, message) of the samples that carry a trigger."""
    return gf.df.where(F.col("message") != "").select("recording_id", "time", F.lit("MSG").alias("type"), "message")


def smi_text_lines(gf: GazeFrame, subject: str = "") -> DataFrame:
    """(recording_id, n, line): the header, the column names and the sample rows of a tab-separated export.

    An eye has its group of columns if any recording has data of it; missing values are 0.00; times are whole microseconds.
    """
    m, d = gf.meta, gf.df
    have = lambda c: c in d.columns
    probe = [c for c in ("gxL", "gxR", "pupxL", "pupxR") if have(c)]
    counts = d.agg(*(F.count(c).alias(c) for c in probe)).first()
    eyes = [e for e in "LR" if any(counts[c] for c in probe if c.endswith(e))]
    width = round(m.screen_width_cm * 10)
    rate = str(int(m.sample_rate)) if float(m.sample_rate).is_integer() else f"{m.sample_rate:.4f}"
    kinds = [{"L": "LEFT", "R": "RIGHT"}[e] for e in eyes] + ["RAW", "DIAMETER", "CR", "POR", "QUALITY", "TRIGGER", "MSG", "FRAMECOUNTER"]
    top = [
        "## [BeGaze TXT Export]", "## ", "## Subject:\t{subject}", f"## Sample Rate:\t{rate}", f"## Calibration Area:\t{m.screen_w}\t{m.screen_h}", f"## Stimulus Dimension [mm]:\t{width}\t{round(m.screen_width_cm * 10 * m.screen_h / m.screen_w)}",
        f"## Head Distance [mm]:\t{round(m.viewing_distance_cm * 10)}", "## [Filter Settings]", "## Heuristic:\tFalse", "## Heuristic Stage:\t0", "## Bilateral:\tTrue", "## Gaze Cursor Filter:\tTrue", "## Saccade Length [px]:\t80", "## Filter Depth [ms]:\t20",
        "## Format:\t" + ", ".join(kinds), "## ", "\t".join(["Time", "Type", "Trial", *(f"{e} {c} [px]" for e in eyes for c in _EYE), "Timing", "Pupil Confidence", "Trigger", "Frame", "Aux1"]),
    ]
    name = F.lit(subject) if subject else F.col("recording_id")
    ids = d.select("recording_id").distinct()
    head = ids.select("recording_id", F.posexplode(F.array(*(F.replace(F.lit(x), F.lit("{subject}"), name) for x in top))).alias("n", "line")).withColumn("n", F.col("n").cast("long") - 1000)
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c) if have(c) else F.lit(None).cast("double"), F.lit(0.0)))
    group = {"Raw X": "pupx", "Raw Y": "pupy", "Dia X": "diax", "Dia Y": "diay", "CR1 X": "crx", "CR1 Y": "cry", "POR X": "gx", "POR Y": "gy"}
    trigger = F.when(F.coalesce("message", F.lit("")) == "", "0").otherwise(F.col("message")) if have("message") else F.lit("0")
    row = F.concat_ws("\t", F.rint(F.col("time") * 1000.0).cast("long").cast("string"), F.lit("SMP"), F.coalesce(F.col("trial"), F.lit(0)).cast("string") if have("trial") else F.lit("0"), *(two(f"{group[c]}{e}") for e in eyes for c in _EYE), F.lit("0"), F.lit("0"), trigger, F.lit("0"), F.lit(""))
    k = F.row_number().over(Window.partitionBy("recording_id").orderBy("sample_idx")).cast("long")
    return head.select("recording_id", "n", "line").unionByName(d.select("recording_id", k.alias("n"), row.alias("line")))


def write_smi_text(gf: GazeFrame, path: str, subject: str = "") -> None:
    """A text export for each recording below ``path/recording_id=...``."""
    out = smi_text_lines(gf, subject).repartition("recording_id").sortWithinPartitions("recording_id", "n")
    out.select("recording_id", "line").write.mode("overwrite").partitionBy("recording_id").text(path)
