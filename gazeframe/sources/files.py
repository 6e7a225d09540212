"""Where recordings come from: formats by extension, listings, whole files with their lines in order."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions of the vendors' files.
FORMATS = {".edf": "eyelink", ".asc": "eyelink", ".idf": "smi", ".txt": "smi", ".tsv": "tobii"}
#: Readers by format; further formats are added by :func:`register`.
READERS: dict[str, Callable] = {}


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[1].lower()}" if "." in name else ""


def detect_format(path: str) -> str:
    """The format of a path by its extension."""
    ext = extension(path)
    if ext not in FORMATS:
        raise ValueError(f"no reader for {ext or 'files without an extension'}: {', '.join(FORMATS)}")
    return FORMATS[ext]


def register(ext: str, fmt: str, reader: Callable) -> None:
    """Adds a reader ``(spark, paths, **options) -> GazeFrame`` for an extension."""
    FORMATS[ext.lower()] = fmt
    READERS[fmt] = reader


def list_files(spark: SparkSession, directory: str, ext: str | Sequence[str], recursive: bool = False) -> list[str]:
    """The sorted paths below a directory with one of the extensions, whatever their case.

    Only names are read, by Spark's own listing, so that any store that Spark reads will do.
    """
    wanted = tuple(e.lower() if e.startswith(".") else f".{e.lower()}" for e in ([ext] if isinstance(ext, str) else ext))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(bool(recursive)).lower()).load(directory).select("path")
    return sorted(r[0] for r in found.collect() if r[0].lower().endswith(wanted))


def recording_name(path="_metadata.file_path"):
    """A file's name without folder and extension."""
    base = F.regexp_extract(F.url_decode(F.regexp_replace(F.col(path), r"\+", "%2B")), r"([^/]+)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def recording_ids(paths: Sequence[str]) -> list[str]:
    """A name for each path: the file's, with its number among the files of that name if there are several (rec#1, rec#2)."""
    names = [_base(p) for p in paths]
    many, seen, out = Counter(names), Counter(), []
    for n in names:
        seen[n] += 1
        out.append(f"{n}#{seen[n]}" if many[n] > 1 else n)
    return out


def _base(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", unquote(path))


def keyed(files: DataFrame, path: str, paths: Sequence[str]) -> DataFrame:
    """Adds recording_id, one for each file that was read: its name, or its numbered name where names repeat. A file that is given
    several times is as many recordings."""
    spark = files.sparkSession
    found = {_plain(f) for f in files.inputFiles()}
    qualify = lambda p: (w := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(w).toString()
    given = [q for p in paths if (q := _plain(qualify(p))) in found]
    order = given + sorted(found - set(given))
    ids = recording_ids(order)
    if len(set(map(_base, order))) == len(order):
        return files.withColumn("recording_id", recording_name(path))
    by: dict[str, list[str]] = {}
    for p, i in zip(order, ids, strict=True):
        by.setdefault(p, []).append(i)
    table = F.create_map(*(x for p, own in by.items() for x in (F.lit(p), F.array(*map(F.lit, own)))))
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(F.col(path), r"\+", "%2B")), "^file:/+", "file:/")
    return files.withColumn("recording_id", F.explode(F.element_at(table, plain)))


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(recording_id, n, line) of text files. A file is read by one task, so that its lines keep their order; many files
    are read by many tasks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.text(list(dict.fromkeys(paths)), wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    text = keyed(files, "_path", paths)
    return text.select("recording_id", F.posexplode(F.split("value", "\n", -1)).alias("n", "line")).select("recording_id", F.col("n").cast("long").alias("n"), F.regexp_replace("line", "\r$", "").alias("line"))


def contents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(recording_id, content) of binary files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).select("path", "content")
    return keyed(files, "path", paths).select("recording_id", "content")


def read_stimuli(spark: SparkSession, directory: str, extensions: Sequence[str] = ("png", "jpg", "jpeg", "bmp", "gif", "wav")) -> DataFrame:
    """(name, path, content, text) of media files below a directory, hidden ones left out; text of txt and csv only."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    f = f.withColumn("name", name).withColumn("_e", ext).where(F.col("_e").isin([e.lower().lstrip(".") for e in extensions]) & ~F.startswith("name", F.lit(".")))
    return f.select("name", "path", "content", F.when(F.col("_e").isin("txt", "csv"), F.decode("content", "UTF-8")).alias("text"))


def image_size(content) -> F.Column:
    """struct(width, height) from the leading bytes of a PNG, GIF or BMP, or a JPEG's first frame header; NULL for others."""
    h = F.hex(F.substring(content, 1, 32))
    at = lambda i, n: F.substring(h, 2 * i + 1, 2 * n)
    big = lambda i, n: F.conv(at(i, n), 16, 10).cast("int")
    little = lambda i, n: F.conv(F.concat(*(at(i + k, 1) for k in range(n - 1, -1, -1))), 16, 10).cast("long").cast("int")
    whole = F.hex(content)
    # A JPEG's frame header: FFC0..FFC3, two bytes of length, one of precision, then height and width. Byte-aligned.
    frame = F.regexp_extract(whole, r"^FFD8(?:FF(?!C[0-3])[0-9A-F]{2}(?:[0-9A-F]{2})*?)*?FFC[0-3][0-9A-F]{4}[0-9A-F]{2}([0-9A-F]{8})", 1)
    jpeg = lambda i: F.conv(F.substring(frame, i, 4), 16, 10).cast("int")
    pair = lambda w, hh: F.struct(w.alias("width"), F.abs(hh).alias("height"))
    return (
        F.when(F.startswith(h, F.lit("89504E47")), pair(big(16, 4), big(20, 4)))
        .when(F.startswith(h, F.lit("47494638")), pair(little(6, 2), little(8, 2)))
        .when(F.startswith(h, F.lit("424D")), pair(little(18, 4), little(22, 4)))
        .when(F.startswith(h, F.lit("FFD8")) & (frame != ""), pair(jpeg(5), jpeg(1)))
    )
