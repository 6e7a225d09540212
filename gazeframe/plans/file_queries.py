"""Registered queries of readers, writers and their helpers: tables become vendor files in the shared folder, which are read back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame
from gazeframe.functions.aoi import AOI
from gazeframe.functions.numeric import hermite, rj
from gazeframe.operators import annotate as A
from gazeframe.operators import metrics as M
from gazeframe.plans.queries import _ASC, _R1, _RAW, _TRIALS, ORACLES, _asc_lines, _r6, _raw_events, query
from gazeframe.plans.samples import SAMPLES_SQL, events_samples, frame
from gazeframe.sources.files import FORMATS, detect_format, image_size, list_files, read_stimuli
from gazeframe.sources.read import from_raw, read, write_text
from gazeframe.sources.smi import read_smi_text
from gazeframe.sources.tobii import EVENT, EYES, STIMULUS, SUBJECT, TIME, VALUE


def _folder(spark: SparkSession) -> str:
    """A fresh folder that all machines share; its files go when the application ends. Where spark.checkpoint.dir is unset, only a
    local session gets /tmp/checkpoints."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = "file:///tmp/checkpoints"
    path = f"{top.rstrip('/')}/gazeframe-files-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _files(text: DataFrame, ext: str) -> str:
    """Writes (rec, n, line) as a file ``rec.ext`` for each of the few recordings; the folder."""
    spark, path = text.sparkSession, _folder(text.sparkSession)
    text.repartition("rec").sortWithinPartitions("rec", "n").select("rec", "line").write.partitionBy("rec").text(path)
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(new(f"{path}/rec=*/part-*")):
        rec = part.getPath().getParent().getName().removeprefix("rec=")
        fs.rename(part.getPath(), new(f"{path}/{rec}.{ext}"))
        fs.delete(new(f"{path}/rec={rec}"), True)
    return path


def _events(spark: SparkSession, d: str) -> DataFrame:
    """``events`` dealt over three recordings, with whole numbers for gaze and pupil; all zero for an error."""
    bad = F.col("event_type") == "error"
    zero = lambda c: F.when(bad, 0).otherwise(c).cast("long")
    i = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("rec"), i.alias("n"), "user_id", F.col("event_type").alias("kind"),
        zero(i % 1900 + 1).alias("x"), zero(i % 1000 + 1).alias("y"), zero(F.floor("value") + 1).alias("d"), zero(F.floor("value") + 3).alias("e"),
    )


_G = """g AS (SELECT 'g' || (user_id % 3)::VARCHAR AS rec, event_id AS n, user_id, event_type AS kind, CASE WHEN event_type <> 'error' THEN event_id % 1900 + 1 END::DOUBLE AS x,
  CASE WHEN event_type <> 'error' THEN event_id % 1000 + 1 END::DOUBLE AS y, CASE WHEN event_type <> 'error' THEN floor(value) + 1 END::DOUBLE AS d FROM events)"""


def _head(e: DataFrame, of: dict[str, list[str]]) -> DataFrame:
    """(rec, n, line) of the lines that each recording's file begins with."""
    recs = e.select("rec").distinct()
    top = F.array(*(F.lit(x) for x in of["g0"]))
    for rec in ("g1", "g2"):
        top = F.when(F.col("rec") == rec, F.array(*(F.lit(x) for x in of[rec]))).otherwise(top)
    return recs.select("rec", F.posexplode(top).alias("n", "line")).select("rec", (F.col("n") - 100).cast("long").alias("n"), "line")


def _smi(spark: SparkSession, d: str) -> str:
    """Exports whose columns differ: of the left eye, and (g2) of the right eye in another order."""
    e = _events(spark, d)
    top = lambda rec, names: ["## [BeGaze TXT Export]", f"## Subject:\tP{rec}", "## Sample Rate:\t500", "## Calibration Area:\t1280\t1024", "\t".join(names)]
    left = ["Time", "Type", "Trial", "L Dia X [px]", "L Dia Y [px]", "L POR X [px]", "L POR Y [px]", "Trigger"]
    right = ["Time", "Type", "Trial", "R POR X [px]", "R POR Y [px]", "R Dia X [px]", "Trigger"]
    kind, trigger = F.when(F.col("n") % 50 == 0, "MSG").otherwise("SMP"), F.when(F.col("kind") == "purchase", "7").otherwise("0")
    row = lambda *c: F.concat_ws("\t", (F.col("n") * 2000).cast("string"), kind, *(F.col(x).cast("string") for x in c), trigger)
    body = e.select("rec", "n", F.when(F.col("rec") == "g2", row("user_id", "x", "y", "d")).otherwise(row("user_id", "d", "e", "x", "y")).alias("line"))
    return _files(_head(e, {"g0": top(0, left), "g1": top(1, left), "g2": top(2, right)}).unionByName(body), "txt")


_SMI = f"{_G}, smi AS (SELECT * FROM g WHERE n % 50 <> 0)"


@query(
    "s07_smi_text",
    f"""WITH {_SMI} SELECT rec AS recording_id, rec AS participant, n * 2.0::DOUBLE AS time, user_id AS trial, CASE WHEN rec <> 'g2' THEN x END AS "gxL", CASE WHEN rec <> 'g2' THEN y END AS "gyL", CASE WHEN rec <> 'g2' THEN d + 1 END AS "paL",
 CASE WHEN rec = 'g2' THEN x END AS "gxR", CASE WHEN rec = 'g2' THEN y END AS "gyR", CASE WHEN rec = 'g2' THEN d END AS "paR", CASE WHEN kind = 'purchase' THEN '7' ELSE '' END AS message FROM smi""",
)
def s07(spark, d):
    return read(spark, _smi(spark, d), ext="txt").df.select("recording_id", "participant", "time", "trial", "gxL", "gyL", "paL", "gxR", "gyR", "paR", "message")


@query("s03_read_files", f"WITH {_SMI}, l(rec, label, id) AS (VALUES ('g0', 'a', 'g0#1'), ('g0', 'b', 'g0#2'), ('g2', 'c', 'g2')) SELECT id AS recording_id, label AS participant, count(*)::BIGINT AS n, sum(x) AS x FROM smi JOIN l USING (rec) GROUP BY id, label")
def s03(spark, d):
    path = _smi(spark, d)
    gf = read(spark, [f"{path}/{r}.txt" for r in ("g0", "g0", "g2")], participant_labels=["a", "b", "c"])
    return gf.df.groupBy("recording_id", "participant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("gxL", "gxR")).alias("x"))


@query("s07_smi_subjects", f"WITH {_SMI} SELECT rec AS recording_id, 'P' || rec[2] AS participant, count(*)::BIGINT AS n FROM smi GROUP BY rec")
def s07s(spark, d):
    return read_smi_text(spark, list_files(spark, _smi(spark, d), "txt")).df.groupBy("recording_id", "participant").agg(F.count(F.lit(1)).alias("n"))


@query("s04_list_files", f"WITH {_G} SELECT DISTINCT rec || '.txt' AS name, 'smi' AS format FROM g")
def s04(spark, d):
    paths = list_files(spark, _smi(spark, d), ["TXT", "tsv"], recursive=True)
    return spark.createDataFrame([(p.rsplit("/", 1)[-1], detect_format(p)) for p in paths], "name string, format string")


@query("s01_formats", "SELECT * FROM (VALUES ('.edf', 'eyelink'), ('.asc', 'eyelink'), ('.idf', 'smi'), ('.txt', 'smi'), ('.tsv', 'tobii')) AS t(ext, format)")
def s01(spark, d):
    return spark.createDataFrame([(e, detect_format(f"/x/y{e.upper()}")) for e in FORMATS if len(e) == 4], "ext string, format string")


@query("s12_read_stimuli", f"WITH {_G}, t AS (SELECT rec, length((n * 2000)::VARCHAR || '.SMP.' || user_id::VARCHAR || '.' || coalesce(d, 0)::BIGINT::VARCHAR || CASE WHEN rec = 'g2' THEN '' ELSE '.' || coalesce(d + 2, 0)::BIGINT::VARCHAR END || '.' || coalesce(x, 0)::BIGINT::VARCHAR || '.' || coalesce(y, 0)::BIGINT::VARCHAR || '.0.') AS l FROM g) SELECT rec || '.txt' AS name, sum(l)::BIGINT AS n FROM t GROUP BY rec")
def s12(spark, d):
    got = read_stimuli(spark, _smi(spark, d), ["txt"])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("^[0-9]"))
    return got.select("name", F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x) + 1).alias("n"))


@query("k01_round_trip", f"WITH {_SMI} SELECT n * 2.0::DOUBLE AS time, user_id AS trial, x AS \"gxL\", y AS \"gyL\" FROM smi WHERE rec = 'g1'")
def k01(spark, d):
    path, out = _smi(spark, d), _folder(spark)
    write_text(spark, f"{path}/g1.txt", out)
    return read_smi_text(spark, f"{out}/recording_id=g1").df.select("time", "trial", "gxL", "gyL")


def _tobii(spark: SparkSession, d: str) -> str:
    e = _events(spark, d)
    valid, x, y, pupil = EYES["L"]
    cells = {
        TIME: F.col("n").cast("string"), EVENT: F.when(F.col("kind") == "purchase", "Buy").otherwise(""), VALUE: F.when(F.col("n") % 2 == 0, F.col("user_id").cast("string")).otherwise(""),
        STIMULUS: F.when(F.col("kind") == "view", "pic").otherwise(""), SUBJECT: F.lit("someone"), valid: F.when(F.col("kind") == "error", "INVALID").otherwise("Valid"),
        x: F.concat(F.col("x").cast("string"), F.lit(",5")), y: F.col("y").cast("string"), pupil: F.col("d").cast("string"),
    }
    names, other = list(cells), [SUBJECT, x, y, valid, pupil, STIMULUS, VALUE, EVENT, TIME]
    row = lambda of: F.concat_ws("\t", *(cells[c] for c in of))
    body = e.select("rec", "n", F.when(F.col("rec") == "g0", row(names)).otherwise(row(other)).alias("line"))
    return _files(_head(e, {"g0": ["\t".join(names)], "g1": ["\t".join(other)], "g2": ["\t".join(other)]}).unionByName(body), "tsv")


@query(
    "s10_tobii",
    f"""WITH {_G} SELECT rec AS recording_id, n::DOUBLE AS time, 1::BIGINT AS trial, x + 0.5 AS "gxL", y AS "gyL", d AS "paL",
 CASE WHEN kind = 'purchase' THEN 'Buy' || CASE WHEN n % 2 = 0 THEN ': ' || user_id::VARCHAR ELSE '' END WHEN kind = 'view' THEN 'Stimulus: pic' ELSE '' END AS message FROM g""",
)
def s10(spark, d):
    return read(spark, _tobii(spark, d), ext=".tsv").df.select("recording_id", "time", "trial", "gxL", "gyL", "paL", "message")


_GASC = _ASC.replace("'r' || user_id::VARCHAR AS recording_id", "'g' || (user_id % 3)::VARCHAR AS recording_id")


def _asc_files(spark: SparkSession, d: str) -> str:
    rec = F.concat(F.lit("g"), (F.expr("substring(recording_id, 2)").cast("long") % 3).cast("string"))
    return _files(_asc_lines(spark, d).select(rec.alias("rec"), "n", "line"), "asc")


@query(
    "s17_annotated",
    f"""WITH {_GASC}, sm AS (SELECT * FROM ln WHERE sample_idx % 11 NOT IN (0, 3, 7)), fx AS (SELECT recording_id AS r, sample_idx AS st, {_R1.format("gx")} AS v FROM ln WHERE sample_idx % 11 = 3),
ms AS (SELECT e.recording_id AS r, e.sample_idx AS q, min(sm.sample_idx) AS i, CASE WHEN e.sample_idx % 11 = 0 THEN 'TRIALID ' || e.sample_idx::VARCHAR ELSE 'TRIAL_RESULT 0' END AS m
  FROM ln e JOIN sm ON sm.recording_id = e.recording_id AND sm.sample_idx > e.sample_idx WHERE e.sample_idx % 11 IN (0, 7) GROUP BY ALL),
mm AS (SELECT r, i, string_agg(m, '; ' ORDER BY q) AS m FROM ms GROUP BY ALL)
SELECT recording_id, recording_id AS participant, sample_idx::DOUBLE AS time, tr::BIGINT AS trial, CASE WHEN sample_idx % 2 = 0 AND pa IS NOT NULL THEN {_R1.format("pa")} ELSE {_R1.format("gx")} END AS "gxR", st IS NOT NULL AS in_fix, v AS fix_gavx,
  CASE WHEN st IS NOT NULL THEN 5 ELSE 0 END AS fix_dur, false AS in_blink, coalesce(mm.m, '') AS message
FROM sm LEFT JOIN fx ON fx.r = recording_id AND sample_idx BETWEEN st AND st + 4 LEFT JOIN mm ON mm.r = recording_id AND mm.i = sample_idx""",
)
def s17(spark, d):
    gf = read(spark, _asc_files(spark, d), ext="ASC", include_variables=False, nearest_after=True)
    return gf.df.select("recording_id", "participant", "time", "trial", "gxR", "in_fix", "fix_gavx", "fix_dur", "in_blink", "message")


@query("s05_read_eyelink", f"WITH {_GASC} SELECT recording_id, count(*)::BIGINT AS n, max(tr)::BIGINT AS trials FROM ln WHERE sample_idx % 11 NOT IN (0, 3, 7) GROUP BY recording_id")
def s05(spark, d):
    from gazeframe.sources.read import read_eyelink

    raw = read_eyelink(spark, list_files(spark, _asc_files(spark, d), "asc"))
    return raw.samples.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.max("trial").alias("trials"))


def _asc_raw(spark: SparkSession, d: str) -> A.RawRecording:
    from gazeframe.sources.eyelink_text import classify, events_of, recordings_of, samples_of

    raw = classify(_asc_lines(spark, d))
    return A.RawRecording(samples_of(raw), events_of(raw), recordings_of(raw))


@query(
    "k02_event_lines",
    f"""WITH {_ASC} SELECT recording_id, sample_idx + 4 AS ts, 'EFIX R   ' || sample_idx::VARCHAR || chr(9) || (sample_idx + 4)::VARCHAR || chr(9) || '5' || chr(9) || printf('%6.1f', coalesce({_R1.format("gx")}, 0.0::DOUBLE)) || chr(9) || '  20.5' || chr(9) || '   900' AS line
 FROM ln WHERE sample_idx % 11 = 3 UNION ALL SELECT recording_id, max(sample_idx) + 1 AS ts, 'END' || chr(9) || (max(sample_idx) + 1)::VARCHAR || chr(9) || 'SAMPLES' || chr(9) || 'EVENTS' || chr(9) || 'RES' || chr(9) || '0.0' || chr(9) || '0.0' AS line FROM ln WHERE sample_idx % 11 NOT IN (0, 3, 7) GROUP BY recording_id""",
)
def k02e(spark, d):
    from gazeframe.sources.eyelink_text import ascii_lines

    return ascii_lines(_asc_raw(spark, d), include_samples=False, include_messages=False).select("recording_id", "ts", "line")


@query("k02c_eye_names", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, CASE sample_idx % 3 WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'LEFT' || chr(9) || 'RIGHT' ELSE 'LEFT' END AS name, CASE sample_idx % 3 WHEN 1 THEN 'R' ELSE 'L' END AS letter FROM s")
def k02c(spark, d):
    from gazeframe import schema as S
    from gazeframe.sources.eyelink_text import eye_letter, eye_name

    eye = F.element_at(F.array(F.lit(S.LEFT), F.lit(S.RIGHT), F.lit(S.BINOCULAR)), (F.col("sample_idx") % 3 + 1).cast("int"))
    return events_samples(spark, d).select("recording_id", "sample_idx", eye_name(eye).alias("name"), eye_letter(eye).alias("letter"))


@query("r02_line_order", f"WITH {_ASC} SELECT recording_id, sample_idx AS ts, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS k FROM ln WHERE sample_idx % 11 <> 3 AND sample_idx > 0")
def r02(spark, d):
    from pyspark.sql import Window

    from gazeframe.sources.eyelink_text import ascii_lines

    got = ascii_lines(_asc_raw(spark, d), include_events=False)
    return got.select("recording_id", "ts", F.row_number().over(Window.partitionBy("recording_id").orderBy("ts", "priority", "seq", "sub")).cast("long").alias("k"))


@query("p03_auto_eye", ORACLES["a02_data_quality"])
def p03(spark, d):
    gf = frame(spark, d)
    return M.data_quality(gf.with_df(gf.df.withColumnsRenamed({"gxL": "gxR", "gyL": "gyR", "paL": "paR"}).withColumn("gxL", F.lit(None).cast("double"))))


@query("p12_drop_diagnostics", f'WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, gx AS "gxL" FROM s')
def p12(spark, d):
    gf = frame(spark, d)
    extra = gf.df.select("recording_id", "sample_idx", "gxL").withColumns({c: F.lit(1.0) for c in ("diaxL", "diayL", "crxL", "cryR")}).withColumn("is_event", F.lit(False))
    return from_raw(gf.with_df(extra)).df


@query("s19_from_dataframe", f"WITH {SAMPLES_SQL} SELECT 'recording' AS recording_id, count(*)::BIGINT AS n, count(gx)::BIGINT AS n_valid FROM s")
def s19(spark, d):
    plain = events_samples(spark, d).select("sample_idx", F.coalesce("gxL", F.lit(float("nan"))).alias("gxL"))
    return GazeFrame.from_dataframe(plain).df.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.count("gxL").alias("n_valid"))


@query(
    "j03_join_variables",
    f"""WITH {SAMPLES_SQL}, {_TRIALS}, tt AS (SELECT recording_id, trial, arg_max(value, event_seq) FILTER (WHERE event_type = 'view') AS trial_label, coalesce(arg_max(trim(value), event_seq) FILTER (WHERE event_type = 'click'), '') AS click FROM tv WHERE trial > 0 GROUP BY recording_id, trial)
SELECT s.recording_id, s.sample_idx, tt.trial_label, tt.click FROM s LEFT JOIN tt ON s.recording_id = tt.recording_id AND s.sample_idx % 4 = tt.trial""",
)
def j03(spark, d):
    samples = events_samples(spark, d).withColumn("trial", F.col("sample_idx") % 4)
    return A.join_variables(samples, A.trial_table(A.parse_variables(_raw_events(spark, d)), "view", ["click"])).select("recording_id", "sample_idx", "trial_label", "click")


@query("j08_match_stimuli", f"WITH {_RAW} SELECT recording_id, sttime, event_type || '.png' AS file, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'error' THEN 'D' END AS stimulus FROM raw WHERE i % 5 = 3")
def j08(spark, d):
    stimuli = spark.createDataFrame([("view.png", b"A"), ("CLICK.JPG", b"B"), ("error.bmp", b"C"), ("error.png", b"D")], "name string, content binary")
    names = A.image_loads(_raw_events(spark, d)).select("recording_id", "sttime", "file")
    return A.match_stimuli(names, stimuli).withColumn("stimulus", F.col("stimulus").cast("string"))


@query("f03_hermite", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, {_r6('0.84375::DOUBLE * gx + 0.140625::DOUBLE * 10 + 0.15625::DOUBLE * gy + -0.046875::DOUBLE * pa')} AS value FROM s")
def f03(spark, d):
    value = hermite(F.lit(0.25), F.col("gxL"), F.col("gyL"), F.lit(10.0), F.col("paL"))
    return events_samples(spark, d).select("recording_id", "sample_idx", rj(value, 6).alias("value"))


class Band(AOI):
    """An area of the caller's own: everything between two heights."""

    def test(self, x, y):
        return y.between(300.0, 600.0)


@query("x01_own_area", f"WITH {SAMPLES_SQL} SELECT recording_id, sample_idx, coalesce(gy BETWEEN 300 AND 600, false) AS inside FROM s")
def x01(spark, d):
    return events_samples(spark, d).select("recording_id", "sample_idx", Band("middle").contains(F.col("gxL"), F.col("gyL")).alias("inside"))


@query("s13_image_size", "SELECT event_id, (event_id % 1900 + 1)::INT AS width, (event_id % 1000 + 1)::INT AS height FROM events")
def s13(spark, d):
    i = F.col("event_id")
    w, h = (i % 1900 + 1).cast("int"), (i % 1000 + 1).cast("int")
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    little = lambda c: F.concat(*(F.substring(big(c), k, 2) for k in (7, 5)))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w), big(h))
    gif = F.concat(F.lit("474946383961"), little(w), little(h))
    bmp = F.concat(F.lit("424D" + "00" * 16), little(w), F.lit("0000"), little(h), F.lit("0000"))
    content = F.unhex(F.when(i % 3 == 0, png).when(i % 3 == 1, gif).otherwise(bmp))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", image_size(content).alias("s")).select("event_id", "s.width", "s.height")

