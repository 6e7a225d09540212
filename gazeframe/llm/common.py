"""What the text operators share: shared storage, Arrow plumbing, byte tokenizers and vectorised hashing."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that Spark hands to Python: keeps a batch of long texts within a worker's memory.
BATCH_ROWS = 256
#: Texts are hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 20

#: ASCII lower-casing as a byte table; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z, keeps 0-9, a-z and bytes of 128 and more, and turns the rest into blanks: words are maximal runs.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all machines share. Where it is unset, a local session gets
    /tmp/checkpoints; a cluster, whose machines don't share that, is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/gazeframe-{uuid.uuid4().hex}"


def materialize(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage in a way that survives lost executors. The files go
    when the application ends, or with ``release(held)``, if the caller gave a list that their path is added to."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def release(spark: SparkSession, held: list[str]) -> None:
    """Deletes materialized files that nothing reads any more."""
    for path in held:
        fs, where = _files(spark, path)
        fs.delete(where, True)
    held.clear()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added until no column of ``df`` is called so."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches; a no-op once set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that an operator's output columns would clash with."""
    drop = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    return df.drop(*drop) if drop else df


def map_texts(docs: DataFrame, columns: list[str], added: list[tuple[str, str]], work: Callable[[pa.RecordBatch], dict], keep: bool = True) -> DataFrame:
    """Runs ``work`` on Arrow batches and appends the columns that it returns, in one Python pass.

    ``work`` gets a batch and returns {name: values}; rows stay in place. With ``keep=False`` only ``columns`` are carried along.
    """
    small_batches(docs.sparkSession)
    base = without(docs if keep else docs.select(*columns), *(n for n, _ in added))
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in added)])
    arrow = to_arrow_schema(schema)
    width = len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = work(b)
                new = [x if isinstance(x := got[n], pa.Array) and x.type == arrow.field(width + i).type else pa.array(x, type=arrow.field(width + i).type) for i, (n, _) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(n for n, _ in added)])

    return base.mapInArrow(run, schema)


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    for x in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        v = x.as_py()
        yield b"" if v is None else v


def text_column(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------------------------------------------- vectorised hashing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(PIECE_BYTES + (1 << 16), int(_BASE))
_INV = _powers(PIECE_BYTES + (1 << 16), pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(raw: bytes, table: bytes = WORD_BYTES) -> np.ndarray:
    """64-bit hashes of the words of one text, in order. Long texts go by pieces that end at a word's end."""
    low = raw.translate(table)
    if len(low) <= PIECE_BYTES:
        return _piece(low)
    out, at = [], 0
    while at < len(low):
        end = at + PIECE_BYTES
        if end < len(low):
            cut = low.rfind(b" ", at, end)
            if cut <= at:  # one word longer than a piece
                cut = low.find(b" ", end)
                cut = len(low) if cut < 0 else cut
                word = low[at:cut].strip(b" ")
                out.append(np.array([int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")], np.uint64) if word else np.zeros(0, np.uint64))
                at = cut
                continue
            end = cut
        out.append(_piece(low[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _piece(low: bytes) -> np.ndarray:
    if not low:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(low, np.uint8)
    on = np.empty(len(b) + 2, bool)
    on[0] = on[-1] = False
    np.not_equal(b, 32, out=on[1:-1])
    edge = np.flatnonzero(on[1:] != on[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * _POW[: len(b)], out=acc[1:])
    h = (acc[end] - acc[start]) * _INV[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words, in order; a text of fewer words, but not none, is one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = words[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = out * np.uint64(0xD1342543DE82EF95) + words[i : i + n]
    return mix(out)
