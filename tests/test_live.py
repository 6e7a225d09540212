import datetime as dt

from pyspark.sql import functions as F

from gazeframe.streaming.live import event_runs, quality, time_bins


def _rows(k):
    t0 = dt.datetime(2024, 1, 1)
    return [("ab"[i % 2], i, float(i), t0 + dt.timedelta(milliseconds=100 * i), None if i % 7 == 0 else float(i), 900.0 + i, (i // 6) % 2 == 0) for i in range(60 * k, 60 * (k + 1))]


SCHEMA = "recording_id string, sample_idx long, time double, ts timestamp, gxL double, paL double, in_fix boolean"


def _run(spark, tmp_path, make, mode, name):
    src = f"{tmp_path}/{name}"
    for k in range(2):
        spark.createDataFrame(_rows(k), SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}_cp").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name), spark.createDataFrame([*_rows(0), *_rows(1)], SCHEMA)


def test_time_bins(spark, tmp_path):
    got, batch = _run(spark, tmp_path, lambda s: time_bins(s, "gxL", width="1 second", late="0 seconds"), "append", "bins")
    want = {(r.recording_id, r.w.start): (r.v, r.n) for r in batch.where("gxL is not null").groupBy("recording_id", F.window("ts", "1 second").alias("w")).agg(F.avg("gxL").alias("v"), F.count("gxL").alias("n")).collect()}
    rows = got.collect()
    assert rows and all(want[r.recording_id, r.start] == (r.value, r.n) for r in rows)


def test_quality(spark, tmp_path):
    got, batch = _run(spark, tmp_path, quality, "complete", "quality")
    assert {r.recording_id: (r.total_samples, r.valid_samples) for r in got.collect()} == {r[0]: (r[1], r[2]) for r in batch.groupBy("recording_id").agg(F.count(F.lit(1)), F.count("gxL")).collect()}


def test_event_runs(spark, tmp_path):
    got, batch = _run(spark, tmp_path, lambda s: event_runs(s, "in_fix"), "append", "runs")
    want = []
    for rid in "ab":
        run = None
        for r in sorted((r for r in batch.collect() if r.recording_id == rid), key=lambda r: r.sample_idx):
            if run and not r.in_fix:
                want.append((rid, *run))
                run = None
            if r.in_fix:
                run = (run[0], r.time, run[2] + 1) if run else (r.time, r.time, 1)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_open_run_ends_when_idle(spark, tmp_path):
    """The open run of a recording without further samples is emitted, once, when the stream's time has gone on; others stay open."""
    src, t0 = f"{tmp_path}/idle", dt.datetime(2024, 1, 1)
    schema = "recording_id string, sample_idx long, time double, ts timestamp, in_fix boolean"
    row = lambda rid, i, s: (rid, i, 2.0 * i, t0 + dt.timedelta(seconds=s), True)
    spark.createDataFrame([row("a", 0, 0), row("a", 1, 1)], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = event_runs(stream, "in_fix", ts="ts", late="0 seconds", idle="1 minute").writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", f"{tmp_path}/idle_cp").start()
    try:
        q.processAllAvailable()
        assert spark.table("idle").count() == 0
        for i in range(2):
            spark.createDataFrame([row("b", i, 300 + i)], schema).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        assert [tuple(r) for r in spark.table("idle").collect()] == [("a", 0.0, 2.0, 2)]
    finally:
        q.stop()
