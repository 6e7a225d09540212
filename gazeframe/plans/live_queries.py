"""Registered queries of the live operators: samples arrive in two parts, and the stream stops and goes on from its checkpoint between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.plans.file_queries import _folder
from gazeframe.plans.queries import _r6, query, rounded
from gazeframe.plans.samples import SAMPLES_SQL, events_samples, runs_sql
from gazeframe.streaming.live import event_runs, quality, time_bins


def _live(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What ``make`` gives on the samples as a stream: appended rows, or the last complete table."""
    top = _folder(spark)
    rows = events_samples(spark, d).withColumn("ts", F.timestamp_millis(F.floor("time").cast("long")))
    half = rows.agg(F.avg("sample_idx")).first()[0] or 0
    for part in (F.col("sample_idx") < half, F.col("sample_idx") >= half):
        rows.where(part).write.mode("append").parquet(f"{top}/in")
        out = make(spark.readStream.schema(rows.schema).parquet(f"{top}/in"))
        sink = out.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
        if mode == "append":
            run = sink.format("parquet").option("path", f"{top}/out").start()
        else:
            run = sink.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{top}/out")).start()
        run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


@query("live_time_bins", f"""WITH {SAMPLES_SQL}
SELECT recording_id, floor(time / 3600000.0::DOUBLE)::BIGINT * 3600000000 AS start_us, {_r6("avg(gx)")} AS value, count(*)::BIGINT AS n FROM s WHERE gx IS NOT NULL GROUP BY ALL""")  # fmt: skip
def live_time_bins(spark, d):
    got = _live(spark, d, lambda s: time_bins(s, "gxL", width="1 hour"), "complete")
    return rounded(got.select("recording_id", F.unix_micros("start").alias("start_us"), "value", "n"), "value")


@query("live_quality", f"""WITH {SAMPLES_SQL}
SELECT recording_id, count(*)::BIGINT AS total_samples, count(gx)::BIGINT AS valid_samples, round_even((count(*) - count(gx)) / count(*) * 1000.0::DOUBLE, 0) / 10.0::DOUBLE AS tracking_loss_pct, {_r6("avg(pa)")} AS mean_pupil
FROM s GROUP BY recording_id""")  # fmt: skip
def live_quality(spark, d):
    return rounded(_live(spark, d, quality, "complete"), "mean_pupil")


@query("live_event_runs", f"""WITH {SAMPLES_SQL}, {runs_sql("r", "s", "in_fix")},
l AS (SELECT *, max(sample_idx) OVER (PARTITION BY recording_id) AS last FROM r)
SELECT recording_id, arg_min(time, sample_idx) AS sttime, arg_max(time, sample_idx) AS entime, count(*)::BIGINT AS n
FROM l WHERE in_fix GROUP BY recording_id, _run HAVING max(sample_idx) < any_value(last)""")  # fmt: skip
def live_event_runs(spark, d):
    """Runs that have ended: the one that a recording's last sample is in stays open."""
    return _live(spark, d, lambda s: event_runs(s, "in_fix", max_gap_ms=float("inf")), "append")
