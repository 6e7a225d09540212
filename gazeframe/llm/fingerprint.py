"""Document fingerprints by consistent weighted sampling: gamma-distributed samples of weighted terms.

Method. A text's terms are its lower-cased words, weighted by how often they occur; a text without words has its runs of
characters between white space as terms. ``samples`` consistent weighted samples, 16 bits of each, make the fingerprint: the
share of equal samples of two fingerprints estimates the generalised Jaccard similarity of the texts' word counts
(standard error at most 0.5 / sqrt(samples)).

The edited text, and the order. A document's next is the one of the next lower id (null ids last); after the last comes
the first; equal ids follow each other by their texts' hash, highest first. The edited text has the last floor(n / 3) code points
replaced by the next document's first as many, or all.

Scale. Rows are cut into ranges of (id, hash of the text), about ``rows_per_range`` rows or, in large tables, ``range_chars``
characters each: a range partitioning of these keys alone gives the highest key of each range. Rows move once, to their range;
those of a range's highest key are copied to the end of the next higher range, whose last row needs them. Each task then reads
its ranges in order (Spark's sort spills) and keeps one document in hand. The keys of the ranges are all that the driver sees.

Defined cases: a null text is empty. An empty text's fingerprint is all zeros; two empty texts are alike. In a table of
one row that row is its own next. Repeated rows follow each other and stay in one range. Ids may be of any type that
Spark orders; null and equal ids are spread over ranges by their texts. An empty table gives an empty result. Input columns named like an output
column are replaced; other names don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gazeframe.llm.common import LOWER, fresh, mix, small_batches, without, word_hashes
from gazeframe.llm.cws import values, variates

#: Numbers of occurrences up to this have tabled values within a batch.
OFTEN = 4


class Sampler:
    """Signatures of texts; the values of words met before are remembered within a bound."""

    def __init__(self, samples: int, held: int = 60_000):
        self.samples, self.held = samples, held
        self.clear()

    def clear(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values = np.zeros((0, OFTEN, self.samples), np.float32)

    def _value(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return values(*variates(terms, self.samples), np.log(tf).astype(np.float32)[None, :])[0].T

    def prepare(self, terms: np.ndarray) -> None:
        """Takes the values of distinct sorted ``terms`` that are not known."""
        if len(self.known) > self.held:
            self.clear()
        new = terms[~np.isin(terms, self.known)] if len(self.known) else terms
        if not len(new):
            return
        got = np.empty((len(new), OFTEN, self.samples), np.float32)
        for i in range(0, len(new), 1024):
            r, c, b = variates(new[i : i + 1024], self.samples)
            for k in range(OFTEN):
                got[i : i + 1024, k] = values(r, c.copy(), b, np.float32(np.log(k + 1)))[0].T
        known = np.concatenate([self.known, new])
        order = np.argsort(known)
        self.values = np.concatenate([self.values, got]) if len(self.values) else got
        self.place = np.concatenate([self.place, np.arange(len(self.place), len(self.place) + len(new))])[order]
        self.known = known[order]

    def signature(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """16 bits of each sample; ``terms`` distinct and prepared."""
        if not len(terms):
            return np.zeros(self.samples, np.uint16)
        at = self.place[np.searchsorted(self.known, terms)]
        best = np.full(self.samples, np.inf, np.float32)
        for i in range(0, len(at), 4096):
            best = np.minimum(best, self.values[at[i : i + 4096], np.minimum(tf[i : i + 4096], OFTEN) - 1].min(0)) if (tf[i : i + 4096] <= OFTEN).all() else self._mixed(best, terms[i : i + 4096], at[i : i + 4096], tf[i : i + 4096])
        # A sample's least value tells its term and step apart; its bits are the sample's identity.
        return (mix(best.view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)

    def _mixed(self, best: np.ndarray, terms: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        few = tf <= OFTEN
        if few.any():
            best = np.minimum(best, self.values[at[few], tf[few] - 1].min(0))
        return np.minimum(best, self._value(terms[~few], tf[~few]).min(0))


def term_hashes(raw: bytes) -> np.ndarray:
    """Hashes of a text's terms, in order."""
    h = word_hashes(raw)
    return h if len(h) else word_hashes(raw, LOWER_SPACES)


#: Lower-cases A-Z and turns ASCII white space into blanks.
LOWER_SPACES = bytes(32 if 9 <= b <= 13 else LOWER[b] for b in range(256))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _fingerprints(sampler: Sampler, texts: list[bytes]) -> list[np.ndarray]:
    counted = [np.unique(term_hashes(x), return_counts=True) for x in texts]
    if counted:
        sampler.prepare(np.unique(np.concatenate([t for t, _ in counted])))
    return [sampler.signature(t, n) for t, n in counted]


_ADDED = [("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]


def fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", samples: int = 64, rows_per_range: int = 1000, range_chars: int = 1 << 28) -> DataFrame:
    """``docs`` with its columns but the text, and ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    small_batches(docs.sparkSession)
    base = without(docs, *(n for n, _ in _ADDED))
    body, order, where, last, place = fresh(base, "_text", "_order", "_range", "_halo", "_place")
    kept = [c for c in base.columns if c != text]
    own = F.coalesce(F.col(text), F.lit(""))
    rows = base.select(*(F.col(f"`{c}`") for c in kept), own.alias(body), F.xxhash64(own).alias(order))
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(body)), F.lit(0))).first()
    # Many small ranges for few rows; beyond that, ranges of bounded size.
    ranges = max(1, min(4096, n // rows_per_range), chars // range_chars)
    keys = rows.select(F.col(doc_id).alias("i"), F.col(order).alias("h")).repartitionByRange(ranges, "i", "h").select(F.spark_partition_id().alias("p"), F.struct("i", "h").alias("k"))
    tops = sorted((r[0], r[1]["i"], r[1]["h"]) for r in keys.groupBy("p").agg(F.max("k")).collect()) if n else []
    kind = base.schema[doc_id].dataType
    at, top = _place(F.struct(F.col(doc_id).alias("i"), F.col(order).alias("h")), [F.struct(F.lit(i).cast(kind).alias("i"), F.lit(h).cast("long").alias("h")) for _, i, h in tops])
    # A row goes to its range; one with its range's highest key also to the end of the next range, after the last to the first.
    spot = lambda r, h: F.struct(r.alias("r"), F.lit(h).alias("h"))
    spots = F.when(top, F.array(spot(at, 0), spot(F.pmod(at + 1, F.lit(max(1, len(tops)))), 1))).otherwise(F.array(spot(at, 0)))
    moved = rows.withColumn(place, F.explode(spots)).select(*(f"`{c}`" for c in kept), body, order, F.col(place)["r"].alias(where), F.col(place)["h"].alias(last))
    ordered = moved.repartition(where).sortWithinPartitions(where, last, F.col(doc_id).desc_nulls_last(), F.col(order).desc(), body)

    schema = T.StructType([*(base.schema[c] for c in kept), *(T.StructField(c, T._parse_datatype_string(k)) for c, k in _ADDED)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        carry = None  # the last row's (columns, text, signature, range, halo)
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(body).to_pylist()
            spots, halos = b.column(where).to_pylist(), b.column(last).to_pylist()
            signs = _fingerprints(sampler, [t.encode() for t in texts])
            seq = [(None, t, s, r, h) for t, s, r, h in zip(texts, signs, spots, halos, strict=True)]
            cols = pa.RecordBatch.from_arrays([b.column(c) for c in kept], names=kept)
            if carry is not None:
                seq, cols = [carry[1], *seq], pa.concat_batches([carry[0], cols]) if hasattr(pa, "concat_batches") else pa.Table.from_batches([carry[0], cols]).combine_chunks().to_batches()[0]
            pairs = [i for i in range(len(seq) - 1) if not seq[i][4] and seq[i][3] == seq[i + 1][3]]
            if pairs:
                edited = [edit(seq[i][1], seq[i + 1][1]).encode() for i in pairs]
                es = _fingerprints(sampler, edited)
                new = [
                    [len(seq[i][1]) for i in pairs],
                    [hashlib.sha256(e).hexdigest() for e in edited],
                    [seq[i][2].astype(">u2").tobytes().hex() for i in pairs],
                    [e.astype(">u2").tobytes().hex() for e in es],
                    [likeness(seq[i][2], e) for i, e in zip(pairs, es, strict=True)],
                    [likeness(seq[i][2], seq[i + 1][2]) for i in pairs],
                ]
                got = cols.take(pa.array(pairs))
                yield pa.RecordBatch.from_arrays([*got.columns, *(pa.array(x, arrow.field(len(kept) + k).type) for k, x in enumerate(new))], names=arrow.names)
            carry = (cols.slice(cols.num_rows - 1, 1), seq[-1])

    return ordered.mapInArrow(run, schema)


def _place(key: Column, tops: list[Column]) -> tuple[Column, Column]:
    """The place of the first of the ascending ``tops`` that is at or above the key, and whether it equals the key: the block
    of tops is found first, then the top within it."""
    if not tops:
        return F.lit(0), F.lit(False)
    size = math.isqrt(len(tops) - 1) + 1
    blocks = [tops[i : i + size] for i in range(0, len(tops), size)]
    below = lambda of: F.size(F.filter(of, lambda t: t < key))
    block = below(F.array(*(b[-1] for b in blocks)))
    inner = F.get(F.array(*(F.array(*b) for b in blocks)), block)
    within = below(inner)
    return block * size + within, F.get(inner, within) == key
