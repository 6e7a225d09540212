"""GazeFrame: an immutable sample table with its recording's metadata; the entry point of the library."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gazeframe.functions.numeric import nan_to_null, pixels_per_degree

#: Windows over a whole recording, and the keys of per-trial results.
RECORDING = ("recording_id",)
TRIAL = ("recording_id", "trial")
_LEFT, _RIGHT = ("left", "L", "l"), ("right", "R", "r")


@dataclass(frozen=True)
class RecordingMeta:
    source: str = "generic"
    sample_rate: float = 1000.0
    screen_w: int = 1920
    screen_h: int = 1080
    screen_width_cm: float = 53.0
    viewing_distance_cm: float = 60.0

    @property
    def ppd(self) -> float:
        return pixels_per_degree(self.screen_w, self.screen_width_cm, self.viewing_distance_cm)


@dataclass(frozen=True)
class GazeFrame:
    """``df`` has the columns of :data:`gazeframe.schema.SAMPLES`, or some of them; ``sample_idx`` orders a recording."""

    df: DataFrame
    meta: RecordingMeta = RecordingMeta()
    _eyes: dict[bool, str] = field(default_factory=dict, init=False, repr=False, compare=False)

    @staticmethod
    def from_dataframe(df: DataFrame, meta: RecordingMeta | None = None, **fields) -> GazeFrame:
        """Any table with ``sample_idx``: fills in ``recording_id`` and turns NaN into NULL."""
        if "sample_idx" not in df.columns:
            raise ValueError("a sample table needs sample_idx, a total order within a recording")
        if "recording_id" not in df.columns:
            df = df.withColumn("recording_id", F.lit("recording"))
        return GazeFrame(nan_to_null(df), replace(meta or RecordingMeta(), **fields))

    def with_df(self, df: DataFrame) -> GazeFrame:
        return replace(self, df=df)

    def has(self, *columns: str) -> bool:
        return all(c in self.df.columns for c in columns)

    def select(self, selection: int | Mapping | Column | None = None) -> GazeFrame:
        """All, one trial, rows that equal or are in the given values, or any condition. NULL never matches."""
        if selection is None:
            return self
        if isinstance(selection, Column):
            return self.with_df(self.df.where(selection))
        if isinstance(selection, int) and not isinstance(selection, bool):
            return self.with_df(self.df.where(F.col("trial") == selection))
        if not isinstance(selection, Mapping):
            raise TypeError("a selection is None, a trial number, a mapping of columns to values, or a condition")
        df = self.df
        for name, want in selection.items():
            if name not in df.columns:
                raise ValueError(f"no column {name!r} to select by")
            if isinstance(want, range) and want.step == 1:
                df = df.where(F.col(name).between(want.start, want.stop - 1))
            elif isinstance(want, (list, tuple, set, frozenset, range)):
                df = df.where(F.col(name).isin(list(want)))
            else:
                df = df.where(F.col(name) == want)
        return self.with_df(df)

    def eye(self, eye: str = "auto", pupil: bool = False) -> str:
        """P03: 'L' or 'R'. 'auto' takes the first eye with any valid value, left if neither has. It looks for one such value, reads
        no more partitions than that needs, and looks once for each frame, however many operators ask."""
        if eye in _LEFT:
            return "L"
        if eye in _RIGHT:
            return "R"
        if eye != "auto":
            raise ValueError(f"unknown eye {eye!r}")
        if pupil not in self._eyes:
            found = (c for c in (("paL", "paR") if pupil else ("gxL", "gxR")) if self.has(c))
            self._eyes[pupil] = next((c[-1] for c in found if self.df.select(c).dropna().take(1)), "L")
        return self._eyes[pupil]

    def eye_columns(self, eye: str = "auto", pupil: bool = False) -> tuple[str, str, str]:
        """Gaze x, gaze y and pupil columns of the eye."""
        e = self.eye(eye, pupil)
        return f"gx{e}", f"gy{e}", f"pa{e}"

    def groups(self, group_by: str | Sequence[str] | None) -> list[str]:
        """Key columns: the trials of each recording unless said otherwise."""
        keys = list(TRIAL) if group_by is None else [group_by] if isinstance(group_by, str) else list(group_by)
        missing = [k for k in keys if k not in self.df.columns]
        if missing:
            raise ValueError(f"no columns {missing} to group by")
        return keys

    def valid_groups(self, group_by: str | Sequence[str] | None) -> tuple[DataFrame, list[str]]:
        """Rows with every key, and the keys."""
        keys = self.groups(group_by)
        return self.df.dropna(subset=keys), keys


def ordered(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("sample_idx")


def within(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def relative_time(df: DataFrame, keys: Sequence[str]) -> Column:
    """``time_rel`` where the group has any, else the time since the group's first row."""
    first = F.first("time").over(ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    since = F.col("time").cast("double") - first.cast("double")
    if "time_rel" not in df.columns:
        return since
    return F.when(F.count("time_rel").over(within(keys)) > 0, F.col("time_rel")).otherwise(since)


def time_window(window: tuple | None, keys: Sequence[str]) -> tuple[Column, Column] | None:
    """A pair of numbers, or of columns that are read from the group's first row."""
    if window is None:
        return None
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.first(x).over(w).cast("double") if isinstance(x, str) else F.lit(float(x)) for x in window]
    return ends[0], ends[1]
