"""Benchmark decontamination with an FM-index over each shard of the training words.

Method. The words of about ``shard_words`` words of documents are turned into numbers; words that no benchmark item holds
become separators, each a symbol of its own that no phrase can match. The shard's suffix array (prefix doubling over the
suffixes that still tie) gives its Burrows-Wheeler transform, held in a wavelet matrix with packed bits and block counts.
All benchmark phrases are searched backwards at once through wavelet ranks; occurrences are located by walking back to
sampled suffix positions, and their spans of words are merged.

Scale. A shard is built and dropped within one task; no document row is shuffled. Benchmark phrases are sent to the tasks
in slices of at most ``slice_chars`` characters (checked against the table's size), one scan for each slice, whose spans
are merged with those found before: a benchmark of any size is searched whole.

Defined cases: a null text has no words; an item without words, or null, has no phrase; a null item id counts as the empty
string; items with equal ids are one item with the phrases of all. Repeated documents are judged alike. An empty table of
either kind gives clean documents. A document longer than a shard makes its shard longer: it is never cut.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gazeframe.llm.common import WORD_BYTES, bytes_of, small_batches, without


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of one text, as UTF-8."""
    return raw.translate(WORD_BYTES).split()


class WaveletMatrix:
    """Ranks and accesses of symbols below 2 ** levels, for arrays of positions at once."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), max(1, levels)
        self.bits, self.counts, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            on = bit.astype(bool)
            self.zeros.append(int(self.n - on.sum()))
            s = np.concatenate([s[~on], s[on]])

    def ones(self, row: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[row][block] + np.bitwise_count(self.bits[row][block] & mask).astype(np.int64)

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of symbol c's rows comes to lie; differences of two such are ranks."""
        for row in range(self.levels):
            one = self.ones(row, i)
            i = np.where((c >> (self.levels - 1 - row)) & 1, self.zeros[row] + one, i - one)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i and where they come to lie."""
        c = np.zeros(len(i), np.int64)
        for row in range(self.levels):
            on = ((self.bits[row][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            one = self.ones(row, i)
            c = c * 2 + on
            i = np.where(on, self.zeros[row] + one, i - one)
        return c, i


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes; symbol 0 is a separator that differs from every other. The last symbol must be 0."""
    n = len(symbols)
    counts = np.bincount(symbols)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    rank = first[symbols].astype(np.int64)
    sep = np.flatnonzero(symbols == 0)
    rank[sep] = np.arange(len(sep))
    tied = np.flatnonzero((symbols != 0) & (counts[symbols] > 1))
    k = 1
    while len(tied):
        key = rank[tied] * n + rank[tied + k]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        group = key // n  # the rank so far, also the group's first place
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        run = np.maximum.accumulate(np.where(new_key, place, 0))
        rank[tied] = group + run - start
        alone = new_key & np.concatenate([new_key[1:], [True]])
        tied = tied[~alone]
        k *= 2
    return rank


class FMIndex:
    """Counts and locates phrases in a sequence of symbols in which 0 separates."""

    def __init__(self, symbols: np.ndarray, sigma: int, step: int = 16):
        symbols = np.append(symbols, 0).astype(np.int64)
        n = len(symbols)
        rank = suffix_ranks(symbols)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        before = np.where(suffix > 0, symbols[suffix - 1], 0)
        self.wavelet = WaveletMatrix(before, int(sigma).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        self.origin = self.wavelet.descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        # Sampled: every step-th position, and those that a separator precedes, from which no step back is defined.
        marked = (suffix % step == 0) | (before == 0)
        packed = np.packbits(marked, bitorder="little")
        self.marks = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.mark_counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])
        self.samples = suffix[marked]

    def back(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[c] + self.wavelet.descend(c, i) - self.origin[c]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, right-aligned in a matrix padded with 0 on the left; empty ranges where absent."""
        width = phrases.shape[1] if phrases.size else 0
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        alive = np.arange(len(phrases))
        for j in range(width - 1, -1, -1):
            go = lengths[alive] > width - 1 - j
            now = alive[go]
            c = phrases[now, j]
            if j == width - 1:
                low[now], high[now] = self.first[c], self.first[c + 1]
            else:
                low[now], high[now] = self.back(c, low[now]), self.back(c, high[now])
            found = low[now] < high[now]
            gone = now[~found]
            low[gone] = high[gone] = 0
            alive = np.concatenate([alive[~go], now[found]])
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            on = ((self.marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            if on.any():
                i = at[on]
                mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
                k = self.mark_counts[i >> 6] + np.bitwise_count(self.marks[i >> 6] & mask).astype(np.int64)
                out[todo[on]] = self.samples[k] + steps
            todo, at = todo[~on], at[~on]
            if len(todo):
                c, down = self.wavelet.access(at)
                at = self.first[c] + down - self.origin[c]
            steps += 1
        return out


def phrases_of(items: list[tuple[str, bytes]], window: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, list[np.ndarray], list[str]]:
    """Vocabulary, distinct phrases (right-aligned), their lengths, the items of each, and the items' names."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    found: dict[tuple[int, ...], set[int]] = {}
    for name, raw in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + window]), set()).add(number[name])
    phrases = np.zeros((len(found), window), np.int64)
    lengths = np.zeros(len(found), np.int64)
    for k, p in enumerate(found):
        phrases[k, window - len(p) :] = p
        lengths[k] = len(p)
    return vocabulary, phrases, lengths, [np.array(sorted(x), np.int64) for x in found.values()], names


def _scan_shard(texts: list[bytes], vocabulary: dict, phrases: np.ndarray, lengths: np.ndarray, owners: list[np.ndarray]):
    """For a shard: words by document, merged spans as (document, start, end) arrays, pairs of document and item."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for k, raw in enumerate(texts):
        w = words_of(raw)
        sizes[k] = len(w)
        parts.append(np.fromiter(map(vocabulary.get, w, repeat(0)), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))  # phrases don't cross documents
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    none = np.zeros(0, np.int64)
    if not len(phrases) or not flat.any():
        return sizes, (none, none, none), (none, none)
    # Runs of separators count as one: only the words that some item holds, and one separator after each run, are indexed.
    keep = (flat != 0) | np.concatenate([[False], flat[:-1] != 0])
    where = np.flatnonzero(keep)
    index = FMIndex(flat[keep], int(max(vocabulary.values())))
    low, high = index.search(phrases, lengths)
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return sizes, (none, none, none), (none, none)
    n = high[hit] - low[hit]
    which = np.repeat(hit, n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hit], n)
    start = where[index.locate(rows)]
    doc = np.searchsorted(begin, start, side="right") - 1
    edge = np.bincount(start, minlength=len(flat) + 1) - np.bincount(start + lengths[which], minlength=len(flat) + 1)
    inside = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(inside))
    s, e = turn[::2], turn[1::2]
    sd = np.searchsorted(begin, s, side="right") - 1
    many = np.array([len(owners[k]) for k in which])
    pairs = np.unique(np.stack([np.repeat(doc, many), np.concatenate([owners[k] for k in which])]), axis=1)
    return sizes, (sd, s - begin[sd], e - begin[sd]), (pairs[0], pairs[1])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_FOUND = [("n_words", "long"), ("_spans", "array<long>"), ("_items", "array<string>")]


def _scan(docs: DataFrame, text: str, items: list[tuple[str, bytes]], window: int, shard_words: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(phrases_of(items, window))
    before = "_spans" in docs.columns
    base = without(docs, *(n for n, _ in _FOUND)) if not before else docs.drop("n_words")
    schema = T.StructType([*(f for f in base.schema.fields if f.name not in ("_spans", "_items")), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in _FOUND)])
    arrow = to_arrow_schema(schema)
    kept = [f.name for f in schema.fields[: -len(_FOUND)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, phrases, lengths, owners, names = sent.value

        def flush(held: list[pa.RecordBatch], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            sizes, (d, s, e), (pd, pi) = _scan_shard(texts, vocabulary, phrases, lengths, owners)
            spans: dict[int, list[int]] = {}
            for k, a, b in zip(d.tolist(), s.tolist(), e.tolist(), strict=True):
                spans.setdefault(k, []).extend((a, b))
            items_of: dict[int, list[str]] = {}
            for k, i in zip(pd.tolist(), pi.tolist(), strict=True):
                items_of.setdefault(k, []).append(names[i])
            at = 0
            for b in held:
                got_s = [spans.get(at + k, []) for k in range(b.num_rows)]
                got_i = [items_of.get(at + k, []) for k in range(b.num_rows)]
                if before:
                    old_s, old_i = b.column("_spans").to_pylist(), b.column("_items").to_pylist()
                    got_s = [[x for p in merge_spans([*zip(o[::2], o[1::2], strict=True), *zip(g[::2], g[1::2], strict=True)]) for x in p] if o and g else o or g for o, g in zip(old_s, got_s, strict=True)]
                    got_i = [sorted({*o, *g}) if o and g else o or g for o, g in zip(old_i, got_i, strict=True)]
                new = [pa.array(sizes[at : at + b.num_rows]), pa.array(got_s, pa.list_(pa.int64())), pa.array(got_i, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(x.cast(arrow.field(len(kept) + k).type) for k, x in enumerate(new))], names=arrow.names)
                at += b.num_rows

        held, texts, many = [], [], 0
        for b in batches:
            held.append(b)
            for raw in bytes_of(b.column(text)):
                texts.append(raw)
                many += len(raw) // 6
            if many >= shard_words:
                yield from flush(held, texts)
                held, texts, many = [], [], 0
        if held:
            yield from flush(held, texts)

    return base.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    share: int = 20,
    shard_words: int = 500_000,
    slice_chars: int = 8_000_000,
) -> DataFrame:
    """``docs`` with its columns and ``n_words, n_hit, n_items, items_sha256, contaminated, items, spans``.

    ``spans``: merged [start, end) word spans to remove. A document is contaminated if words are hit and they are at least
    one ``share``-th of its words.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.length("t") + F.length("i") + 16), F.lit(0))).first()[0]
    slices = max(1, -(-int(total) // slice_chars))
    out = without(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "_spans", "_items")
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k)
        out = _scan(out, text, [(r["i"], r["t"].encode()) for r in part.collect()], window, shard_words)
    at = F.transform(F.expr("sequence(0, cast(size(_spans) div 2 as int) - 1, 1)"), lambda i: F.struct(F.get("_spans", i * 2).alias("start"), F.get("_spans", i * 2 + 1).alias("end")))
    spans = F.when(F.size("_spans") > 0, at).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
    out = out.withColumn("spans", spans).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    joined = F.array_join(F.array_sort("_items"), ",")
    out = out.withColumn("items", F.array_sort("_items")).withColumn("n_items", F.size("_items").cast("long")).withColumn("items_sha256", F.sha2(joined.cast("binary"), 256))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    kept = [c for c in out.columns if c not in ("_spans", "_items", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")]
    return out.select(*kept, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 13, share: int = 20) -> list[tuple]:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text by trying every place: for tests."""
    out = []
    for text in texts:
        words = words_of((text or "").encode())
        hit, seen = set(), set()
        for name, t in items:
            w = words_of((t or "").encode())
            for p in {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ():
                for i in range(len(words) - len(p) + 1):
                    if tuple(words[i : i + len(p)]) == p:
                        hit.update(range(i, i + len(p)))
                        seen.add(name)
        digest = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
        out.append((len(words), len(hit), len(seen), digest, bool(hit) and share * len(hit) >= len(words)))
    return out
