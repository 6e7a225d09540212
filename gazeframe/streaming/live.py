"""Live recordings: the batch operators' results are the specification; these are their forms on streams.

* :func:`time_bins`: A08 as a tumbling event-time window with a watermark for late samples;
* :func:`quality`: running A02 counts of each recording;
* :func:`event_runs`: W02-W04's runs of a flag, held as state for each recording until they end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def time_bins(samples: DataFrame, measure: str, ts: str = "ts", width: str = "1 second", late: str = "10 seconds", keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """(keys, start, value, n): the mean and count of a measure's valid samples in each window."""
    w = F.window(ts, width)
    got = samples.withWatermark(ts, late).where(F.col(measure).isNotNull()).groupBy(w, *keys).agg(F.avg(measure).alias("value"), F.count(measure).alias("n"))
    return got.select(*keys, F.col("window.start").alias("start"), "value", "n")


def quality(samples: DataFrame, gx: str = "gxL", pa: str = "paL", keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Running counts, tracking loss and mean pupil of each group; for update or complete output."""
    n, valid = F.count(F.lit(1)), F.count(gx)
    return samples.groupBy(*keys).agg(n.alias("total_samples"), valid.alias("valid_samples"), (F.rint((n - valid) / n * 1000.0) / 10.0).alias("tracking_loss_pct"), F.avg(pa).alias("mean_pupil"))


def event_runs(samples: DataFrame, flag: str, max_gap_ms: float = 1000.0, ts: str | None = None, late: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """(recording_id, sttime, entime, n): runs of ``flag``, emitted when a row without it, or a gap in time, ends them.

    State is one open run for each recording. Samples of a recording have to come in order of ``sample_idx``, up to the order within
    one batch. With a column ``ts`` of event times the run of a recording that has no more samples is emitted, and its state goes,
    once the watermark (the stream's latest time less ``late``) is ``idle`` beyond its last sample; samples behind the watermark are
    left out. Without ``ts`` such a run stays open.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out, run = [(key[0], *run[:3])], None
        else:
            pdf = pd.concat(list(batches)).sort_values("sample_idx")
            for t, on, ms in zip(pdf["time"], pdf["_flag"], pdf["_ms"], strict=True):
                if run and (not on or t - run[1] > max_gap_ms):
                    out.append((key[0], *run[:3]))
                    run = None
                if on:
                    run = [run[0], t, run[2] + 1, max(run[3], ms)] if run else [t, t, 1, ms]
        if run:
            state.update(tuple(run))
            if ts is not None:
                state.setTimeoutTimestamp(int(max(run[3] + wait, state.getCurrentWatermarkMs() + 1)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["recording_id", "sttime", "entime", "n"])

    at = F.lit(0) if ts is None else F.coalesce(F.unix_millis(ts), F.lit(0))
    rows = samples if ts is None else samples.withWatermark(ts, late)
    rows = rows.select("recording_id", "sample_idx", F.col("time").cast("double").alias("time"), F.coalesce(F.col(flag), F.lit(False)).alias("_flag"), at.cast("long").alias("_ms"), *([F.col(ts).alias("_ts")] if ts else []))
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return rows.groupBy("recording_id").applyInPandasWithState(step, "recording_id string, sttime double, entime double, n long", "sttime double, entime double, n long, last long", "append", timeout)
