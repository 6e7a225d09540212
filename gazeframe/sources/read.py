"""The facades: read recordings of any format, one or many, and write them back as text."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gazeframe.frame import GazeFrame
from gazeframe.functions.numeric import nan_to_null
from gazeframe.operators.annotate import RawRecording, annotate
from gazeframe.sources.eyelink_binary import read_eyelink_binary
from gazeframe.sources.eyelink_text import read_eyelink_text, write_eyelink_text
from gazeframe.sources.files import FORMATS, READERS, detect_format, extension, list_files, recording_ids
from gazeframe.sources.smi import read_smi_binary, read_smi_text, write_smi_text
from gazeframe.sources.tobii import read_tobii


def read_eyelink(spark: SparkSession, paths: str | Sequence[str], **options) -> RawRecording:
    """Raw EyeLink recordings, binary or text by extension."""
    first = paths if isinstance(paths, str) else paths[0]
    readers = {".edf": read_eyelink_binary, ".asc": read_eyelink_text}
    if extension(first) not in readers:
        raise ValueError(f"not an EyeLink recording: {first}")
    return readers[extension(first)](spark, paths, **options)


def read_smi(spark: SparkSession, paths: str | Sequence[str], **options) -> GazeFrame:
    first = paths if isinstance(paths, str) else paths[0]
    if extension(first) == ".csv":
        raise ValueError("comma-separated SMI files aren't supported: use the .txt export or the .idf recording")
    return (read_smi_binary if extension(first) == ".idf" else read_smi_text)(spark, paths, **options)


def from_raw(raw: RawRecording | GazeFrame, **options) -> GazeFrame:
    """The canonical table; vendors without events only have their columns completed."""
    if isinstance(raw, RawRecording):
        return annotate(raw, **options)
    drop = [c for c in raw.df.columns if c.startswith(("dia", "cr")) or c == "is_event"]
    return raw.with_df(nan_to_null(raw.df.drop(*drop)))


def read_files(spark: SparkSession, paths: Sequence[str], participant_labels: Sequence[str] | None = None, **options) -> GazeFrame:
    """Many files of one format in one scan. ``participant`` is the file's name, or the label given for it; files of equal
    names, and a file that is given twice, are recordings of their own."""
    if not paths:
        raise ValueError("no files to read")
    kinds = {detect_format(p) for p in paths}
    if len(kinds) > 1:
        raise ValueError(f"files of several formats: {sorted(kinds)}")
    gf = _read(spark, list(paths), kinds.pop(), **options)
    ids, names = recording_ids(paths), [recording_ids([p])[0] for p in paths]
    label = F.col("recording_id")
    if participant_labels is not None or ids != names:
        labels = names if participant_labels is None else participant_labels
        label = F.element_at(F.create_map(*(F.lit(x) for pair in zip(ids, labels, strict=True) for x in pair)), F.col("recording_id"))
    return gf.with_df(gf.df.withColumn("participant", label))


def union(frames: Sequence[GazeFrame]) -> GazeFrame:
    """Frames below each other by column name; differing rates are warned of and the first is kept."""
    out = frames[0]
    if len({f.meta.sample_rate for f in frames}) > 1:
        warnings.warn("sample rates differ; the first is kept", stacklevel=2)
    for f in frames[1:]:
        out = out.with_df(out.df.unionByName(f.df, allowMissingColumns=True))
    return replace(out)


def _read(spark: SparkSession, paths: list[str], fmt: str, **options) -> GazeFrame:
    if fmt in READERS:
        return READERS[fmt](spark, paths, **options)
    if fmt == "eyelink":
        more = {k: options.pop(k) for k in ("include_variables", "trial_time_zero", "nearest_after") if k in options}
        return from_raw(read_eyelink(spark, paths, **options), **more)
    return from_raw((read_smi if fmt == "smi" else read_tobii)(spark, paths, **options))


def read(spark: SparkSession, path: str | Sequence[str], ext: str | None = None, recursive: bool = False, **options) -> GazeFrame:
    """A recording, a list of them, or (with ``ext``) all below a directory, as annotated samples."""
    if not isinstance(path, str):
        return read_files(spark, path, **options)
    if ext is not None:
        return read_files(spark, list_files(spark, path, ext, recursive), **options)
    return _read(spark, [path], detect_format(path), **options)


def write_text(spark: SparkSession, path: str, out: str, ext: Sequence[str] | None = None, recursive: bool = False, **options) -> None:
    """Writes recordings as their vendor's text; a directory's EyeLink and SMI recordings if ``path`` has no extension."""
    if extension(path) not in FORMATS:
        for e in ext or (".edf", ".idf"):
            if files := list_files(spark, path, e, recursive):
                _write(spark, files, f"{out.rstrip('/')}/{e.strip('.')}", **options)
        return
    _write(spark, [path], out, **options)


def _write(spark: SparkSession, paths: list[str], out: str, **options) -> None:
    fmt = detect_format(paths[0])
    if fmt == "eyelink":
        write_eyelink_text(read_eyelink(spark, paths), out, **options)
    elif fmt == "smi":
        write_smi_text(read_smi(spark, paths), out, **options)
    else:
        raise ValueError(f"{fmt} recordings aren't written: they are text already")
