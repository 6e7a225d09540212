"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Method. A text's terms are its runs of five words (lower-cased, punctuation aside; a shorter text is one run). A run's
weight is (1 + ln tf) x idf, where idf = 1 + ``alpha`` ln((1 + N) / (1 + df)) / ln(2 + N): common runs count less, but even a
passage that every document holds keeps a weight, so that large groups of copies don't lose theirs. Document
frequencies are counted over all documents in a count-mean-min sketch of fixed size. ``bands x rows`` samples make a signature,
which is cut into bands of ``rows`` samples in two ways; texts that share any of these are candidates, whose weighted Jaccard similarity is then taken exactly from the texts. Classes
are the connected components of the pairs at ``threshold`` or more.

Candidates. Equal word sequences are one node from the start. A band's bucket of at most ``small`` nodes gives all its
pairs; a larger one gives each node with the bucket's most shared node (that whose bands are in the largest buckets: a
group's centre), which joins a group of copies in as many rows as it has nodes. Larger buckets that are in several classes
even so are treated by their size. Up to ``BLOCK`` nodes, one task compares the nodes' ``wide`` samples in memory, takes the
exact similarity of the pairs of different classes that agree well enough from the texts beside them, and gives the links that
join classes: never more than it has nodes, however many pairs it went through. Beyond, the nodes are banded anew with more samples to a band
(``DEEPER``: fewer unlike nodes meet, and so many bands that nodes alike at the threshold meet with a probability of 0.997 or
more), and these buckets are treated in the same way, until none is left: a bucket of more than ``BLOCK`` nodes that still
holds several classes after the last banding is compared in pairs of blocks. A pair is passed over if it agrees in fewer samples
than two texts at the threshold do, less 3.5 standard deviations; every other pair is verified from the texts.

Scale. Signatures are taken in the tasks that read the texts. What is shuffled: sketches, (band, node) rows, and the texts
of candidates, picked in the scan by a bitmap of fixed size (a false hit costs a row, no result). A pair's texts meet by
(centre, salt), so that a centre with a third of all rows is spread out. Joins on bands are sort-merge joins, which
adaptive execution splits where a bucket is large. A task holds at most two blocks. Only nodes of mixed buckets of more than
``BLOCK`` nodes go to the next banding, by n bands each, not to a comparison of all with all. Classes are found by label
propagation with pointer jumps, every step written to the shared folder and deleted after use. Nothing unbounded is collected.

Defined cases: a null text is empty. Texts without words are alike only if they are equal. Repeated rows, and rows with
equal ids, are in one class if their texts are. A class is named by its least id (nulls aside). An empty table gives an
empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm.common import bytes_of, fresh, map_texts, materialize, mix, release, shingles, small_batches, word_hashes
from gazeframe.llm.cws import jaccard, sample

WIDTH, DEPTH, SLICES = 1 << 18, 2, 64
#: How much the IDF weighs: factors from 1 (a run that all documents hold) to 1 + ALPHA (one of its own).
ALPHA = 0.5
#: Bits of the bitmap of candidates.
BITMAP = 1 << 23
#: Nodes of a block and, of the pairs of two blocks, those that are compared at once.
BLOCK, AT_ONCE = 2048, 1 << 20
#: Bytes of a block's texts, roughly: a bucket of more is compared by pairs of blocks, too.
TEXTS = 1 << 25
#: Samples to a band and bands, from one banding of large mixed buckets to the next: at 0.8, two texts share a band with a probability
#: of 0.9987 and 0.998 (in the first banding, of 0.9982 by either of its two cuts).
DEEPER = ((8, 36), (12, 90))
_ROW = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _cells(terms: np.ndarray, row: int) -> np.ndarray:
    return ((terms * _ROW[row]) >> np.uint64(46)).astype(np.int64)


def node_of(raw: bytes, words: np.ndarray) -> bytes:
    """16 bytes that equal texts share: of the words, or of the text itself if it has none."""
    return hashlib.blake2b(words.tobytes() if len(words) else b"text" + raw, digest_size=16).digest()


class Idf:
    """idf from the sketch of document frequencies."""

    def __init__(self, sketch: np.ndarray, docs: int, alpha: float):
        self.sketch, self.docs, self.alpha = sketch, docs, alpha
        self.noise = sketch.sum(1) / sketch.shape[1]

    def __call__(self, terms: np.ndarray) -> np.ndarray:
        df = np.minimum(*(self.sketch[r][_cells(terms, r)] - self.noise[r] for r in range(DEPTH)))
        df = np.clip(df, 1, max(self.docs, 1))
        return 1 + self.alpha * np.log((1 + self.docs) / (1 + df)) / np.log(2 + self.docs)


def weighted(words: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and their weights."""
    terms, tf = np.unique(shingles(words), return_counts=True)
    return terms, (1 + np.log(tf)) * idf(terms)


def count_sketch(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Document frequencies of all documents' shingles, hashed to DEPTH x WIDTH cells, and the number of documents."""
    small_batches(docs.sparkSession)
    step = DEPTH * WIDTH // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        for b in batches:
            n += b.num_rows
            held, many = [], 0
            for raw in bytes_of(b.column(0)):
                held.append(np.unique(shingles(word_hashes(raw))))
                many += len(held[-1])
                if many > 1 << 19:
                    _add(got, held)
                    held, many = [], 0
            _add(got, held)
        if n:
            flat = got.reshape(-1)
            parts = [flat[i * step : (i + 1) * step].astype(np.int32 if flat.max(initial=0) < 2**31 else np.int64) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(SLICES), -1], pa.int32()), pa.array([*(p.astype(np.int64).tobytes() if p.dtype == np.int64 else p.tobytes() for p in parts), np.array([n], np.int64).tobytes()], pa.binary())], names=["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                wide = k < 0 or len(x) == step * 8
                v = np.frombuffer(x, np.int64 if wide else np.int32).astype(np.int64)
                total[k] = v if k not in total else total[k] + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "cells"])

    # Added up in two steps, so that no task gets a part of the sketch from more than some 256 others.
    parts = docs.select(text).mapInArrow(count, "slice int, cells binary")
    group = F.shiftright(F.spark_partition_id(), 8)
    for keys in ((F.col("slice"), group), (F.col("slice"),)):
        parts = parts.repartition(*keys).mapInArrow(add, "slice int, cells binary")
    out, n = np.zeros(DEPTH * WIDTH, np.int64), 0
    for k, x in parts.collect():
        v = np.frombuffer(x, np.int64)
        if k < 0:
            n += int(v[0])
        else:
            out[k * step : (k + 1) * step] += v
    return out.reshape(DEPTH, WIDTH), n


def _add(got: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        terms = np.concatenate(held)
        for r in range(DEPTH):
            got[r] += np.bincount(_cells(terms, r), minlength=WIDTH)


def signatures(docs: DataFrame, sent, text: str, doc_id: str, bands: int, rows: int) -> DataFrame:
    """(id, node, n1, bands, sketch) of each document; n1: the node's first bits, sketch: a byte of each sample."""
    salt = np.arange(1, 2 * bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)

    def work(b: pa.RecordBatch) -> dict:
        seen: dict[bytes, tuple] = {}
        got = []
        for raw in bytes_of(b.column("_text")):
            words = word_hashes(raw)
            node = node_of(raw, words)
            if node not in seen:
                if len(words):
                    terms, w = weighted(words, sent.value)
                    s = sample(terms, np.log(w), bands * rows)
                    # Each sample is in two bands: with its neighbours, and with those at a distance of ``bands``.
                    s = np.concatenate([s.reshape(bands, rows), s.reshape(rows, bands).T])
                    h = salt.copy()
                    for k in range(rows):
                        h = mix(h * np.uint64(3) + s[:, k])
                    seen[node] = (h.view(np.int64).tolist(), (s[:bands] & np.uint64(127)).astype(np.int8).reshape(-1).tolist())
                else:
                    seen[node] = ([], [])
            got.append((node, *seen[node]))
        n1 = np.frombuffer(b"".join(g[0][:8] for g in got), np.int64) & (BITMAP - 1)
        return {"node": [g[0] for g in got], "n1": pa.array(n1), "bands": [g[1] for g in got], "sketch": [g[2] for g in got]}

    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *_key(text))
    return map_texts(src, ["_id", "_text"], [("node", "binary"), ("n1", "long"), ("bands", "array<long>"), ("sketch", "array<tinyint>")], work).drop("_text")


def _key(text: str) -> tuple:
    """128 bits of a text's bytes, as two columns; null is not the empty text."""
    return F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), F.col(text)).alias("_k2")


def _agreeing(least: int):
    return F.aggregate(F.zip_with("x.sketch", "y.sketch", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v) >= least


def candidate_pairs(buckets: DataFrame, small: int, agree: int) -> DataFrame:
    """Distinct (a, b, na, nb) of different labels from (bucket, node, n1, sketch, rank, label) rows, rank: the nodes' order of
    centrality, least first; label: the class so far."""
    sized = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("centre")).where("n > 1")
    rows = buckets.join(sized.hint("shuffle_merge"), "bucket")
    one = F.struct("node", "n1", "sketch", "rank", "label")
    few = rows.where(F.col("n") <= small).select("bucket", one.alias("x"))
    pairs = few.join(few.select("bucket", F.col("x").alias("y")).hint("shuffle_merge"), "bucket").where(F.col("x.rank") < F.col("y.rank"))
    many = rows.where(F.col("n") > small)
    stars = many.where(F.col("rank") == F.col("centre")).select("bucket", one.alias("x")).join(many.where(F.col("rank") != F.col("centre")).select("bucket", one.alias("y")).hint("shuffle_merge"), "bucket")
    both = pairs.select("x", "y").unionByName(stars.select("x", "y")).where((F.col("x.label") != F.col("y.label")) & _agreeing(agree))
    return both.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.col("y.n1").alias("na"), F.col("x.n1").alias("nb")).distinct()


def _bitmap(spark: SparkSession, pairs: DataFrame) -> np.ndarray:
    """The candidates' bits."""
    bits = pairs.select(F.explode(F.array("na", "nb")).alias("i")).groupBy((F.shiftright("i", 6)).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(i & 63 as int)))").alias("m"))
    out = np.zeros(BITMAP // 64, np.int64)
    for w, m in bits.collect():
        out[w] = m
    return out.view(np.uint64)


def _texts(docs: DataFrame, bits_of: DataFrame, text: str, held: list[str] | None = None) -> DataFrame:
    """(node, raw) of the nodes of ``bits_of`` (na, nb), and of a few others by false hits."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_bitmap(spark, bits_of))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            nodes, texts = [], []
            for raw in bytes_of(b.column(0)):
                node = node_of(raw, word_hashes(raw))
                i = int.from_bytes(node[:8], "little") & (BITMAP - 1)
                if int(bits.value[i >> 6]) >> (i & 63) & 1 and node not in seen:
                    nodes.append(node)
                    texts.append(raw)
                    if len(seen) < 100_000:
                        seen.add(node)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(texts, pa.binary())], names=["node", "raw"])

    small_batches(spark)
    # Equal word sequences may differ in their bytes; any of them will do, the least is as good as any.
    return materialize(docs.select(text).mapInArrow(pick, "node binary, raw binary").groupBy("node").agg(F.min("raw").alias("raw")), held)


def verify(docs: DataFrame, pairs: DataFrame, sent, text: str, threshold: float, texts: DataFrame | None = None, held: list[str] | None = None) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are at least ``threshold`` alike; ``texts``: (node, raw), if they are at hand."""
    texts = _texts(docs, pairs, text, held) if texts is None else texts
    n = pairs.count()
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(max(64, n // 20_000))).cast("int"))
    left = salted.join(texts.select(F.col("node").alias("a"), F.col("raw").alias("ta")).hint("shuffle_merge"), "a")
    right = salted.select("b", "salt").distinct().join(texts.select(F.col("node").alias("b"), F.col("raw").alias("tb")).hint("shuffle_merge"), "b")
    met = left.join(right.hint("shuffle_merge"), ["b", "salt"]).select("a", "b", "ta", "tb")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = [], []
            for na, nb, ta, tb in zip(*(batch.column(i) for i in range(4)), strict=True):
                nb = nb.as_py()
                if last[0] != nb:
                    last = (nb, weighted(word_hashes(tb.as_py()), sent.value))
                if jaccard(*weighted(word_hashes(ta.as_py()), sent.value), *last[1]) >= threshold:
                    a.append(na.as_py())
                    b.append(nb)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return met.mapInArrow(alike, "a binary, b binary")


def components(links: DataFrame, held: list[str] | None = None) -> DataFrame:
    """(node, label) of every node of ``links``; label: the least node that it is connected with. The steps' files are
    deleted; those of the result and the edges are added to ``held``."""
    spark, steps = links.sparkSession, []
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), held)
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), held)
    while True:
        sent = edges.join(labels.hint("shuffle_merge"), edges.a == labels.node).select(F.col("b").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        low = sent.unionByName(own).groupBy("node").agg(F.min("label").alias("low"), F.max("old").alias("old"))
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        before, steps = steps, []
        new = materialize(low.join(hop.hint("shuffle_merge"), "low").select("node", F.least("low", "next").alias("label"), (F.least("low", "next") != F.col("old")).alias("moved")), steps)
        release(spark, before)
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            if held is not None:
                held.extend(steps)
            return labels


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    threshold: float = 0.8,
    bands: int = 12,
    rows: int = 4,
    alpha: float = ALPHA,
    small: int = 48,
    wide: int = 240,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, class_id, representative) of each document; class_id: the least id of its class. Where an id is null or has
    several texts, different classes may bear one name: ``drop_near_duplicates`` tells them apart."""
    out = _classes(docs, text, doc_id, threshold, bands, rows, alpha, small, wide, block)
    return out.select(F.col("_id").alias("doc_id"), "class_id", F.col("_id").eqNullSafe(F.col("class_id")).alias("representative"))


def _least(samples: int, threshold: float) -> int:
    """Samples that two texts at the threshold agree in, less 3.5 standard deviations."""
    return int(samples * threshold - 3.5 * (samples * threshold * (1 - threshold)) ** 0.5)


def _classes(docs: DataFrame, text: str, doc_id: str, threshold: float, bands: int, rows: int, alpha: float, small: int, wide: int, block: int) -> DataFrame:
    """(_id, _k1, _k2, node, label, class_id) of each document; label: the class itself, class_id: its name."""
    spark, held = docs.sparkSession, []
    keep = lambda df: materialize(df, held)
    sketch, n_docs = count_sketch(docs, text)
    sent = spark.sparkContext.broadcast(Idf(sketch, n_docs, alpha))
    sig = materialize(signatures(docs, sent, text, doc_id, bands, rows))

    # One row for each node: equal texts are merged before they move.
    info = sig.where(F.size("bands") > 0).drop("_id", "_k1", "_k2").dropDuplicates(["node"])
    flat = info.select("node", F.explode("bands").alias("bucket"))
    sizes = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keep(flat.join(sizes.hint("shuffle_merge"), "bucket"))
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame")).join(info.drop("bands").hint("shuffle_merge"), "node")
    rank = F.struct((-F.col("fame")).alias("f"), F.xxhash64("node").alias("h"), F.col("node").alias("k"))
    buckets = keep(shared.drop("n").join(fame.hint("shuffle_merge"), "node").select("bucket", "node", "n1", "sketch", rank.alias("rank")))

    labels, links, tried, near = None, None, None, None
    deeper, agree, wide = list(DEEPER), _least(bands * rows, threshold), max(wide, bands * rows)

    def take(pairs: DataFrame, texts: DataFrame | None) -> None:
        """Verifies the pairs that are new and joins the classes that they link."""
        nonlocal tried
        low, high = F.least("a", "b"), F.greatest("a", "b")
        named = pairs.withColumns({"low": low, "high": high})
        new = keep(named if tried is None else named.join(tried.hint("shuffle_merge"), ["low", "high"], "left_anti"))
        tried = new.select("low", "high") if tried is None else tried.unionByName(new.select("low", "high"))
        if not new.limit(1).count():
            return
        join(keep(verify(docs, new.select("a", "b", "na", "nb"), sent, text, threshold, texts, held)))

    def join(found: DataFrame) -> None:
        """Joins the classes that ``found`` links."""
        nonlocal labels, links
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            labels = components(links, held)

    while True:
        take(candidate_pairs(_labelled(buckets, labels), small, agree), near)
        mixed = keep(_mixed(buckets, labels, small))
        if not mixed.limit(1).count():
            break
        if near is None:
            near = _texts(docs, mixed.select(F.col("n1").alias("na"), F.col("n1").alias("nb")), text, held)
            wider = keep(near.mapInArrow(_widen(sent, wide), "node binary, wide binary"))
        last = not deeper
        join(keep(_compared(mixed, wider, near, sent, block, agree, bands * rows, wide, threshold, last)))
        left = keep(_mixed(mixed, labels, block))
        if last or not left.limit(1).count():
            break
        buckets = keep(_banded(left, wider, wide, *deeper.pop(0)))

    nodes = sig.groupBy("node").agg(F.min("_id").alias("least"))
    if labels is None:
        classes = nodes.select("node", F.col("node").alias("label"), F.col("least").alias("class_id"))
    else:
        tagged = nodes.join(labels.hint("shuffle_merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = tagged.groupBy("label").agg(F.min("least").alias("class_id"))
        classes = tagged.join(named.hint("shuffle_merge"), "label").select("node", "label", "class_id")
    classes = materialize(classes)
    release(spark, held)
    return sig.select("_id", "_k1", "_k2", "node").join(classes.hint("shuffle_merge"), "node")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with their nodes' classes so far."""
    if labels is None:
        return buckets.withColumn("label", F.col("node"))
    return buckets.drop("label").join(labels.hint("shuffle_merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _mixed(buckets: DataFrame, labels: DataFrame | None, small: int) -> DataFrame:
    """The rows of buckets of more than ``small`` nodes that are in several classes, with their labels so far and ``n``."""
    of = _labelled(buckets.drop("n"), labels)
    mixed = of.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l"), F.max("label").alias("h")).where((F.col("n") > small) & (F.col("l") != F.col("h")))
    return of.join(mixed.select("bucket", "n").hint("shuffle_merge"), "bucket")


def _widen(sent, wide: int):
    """Makes the function that takes ``wide`` samples of texts, a byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for raw in bytes_of(b.column(1)):
                terms, w = weighted(word_hashes(raw), sent.value)
                got.append((sample(terms, np.log(w), wide) & np.uint64(127)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["node", "wide"])

    return run


def _banded(rows: DataFrame, wider: DataFrame, wide: int, size: int, bands: int) -> DataFrame:
    """The nodes of ``rows`` in buckets of ``size`` of the ``wide`` samples each, buckets of one node left out."""
    rng = np.random.default_rng(size)
    picks = np.array([np.sort(rng.choice(wide, size, replace=False)) for _ in range(bands)])
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, wide)
            h = np.broadcast_to(salt, (len(s), bands)).copy()
            for k in range(size):
                h = mix(h * np.uint64(3) + s[:, picks[:, k]])
            got = pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * bands, h.view(np.int64).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=["node", "keys"])

    nodes = rows.select("node", "n1", "sketch", "rank").dropDuplicates(["node"])
    flat = nodes.select("node").join(wider.hint("shuffle_merge"), "node").mapInArrow(keys, "node binary, keys array<long>").select("node", F.explode("keys").alias("bucket"))
    many = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return flat.join(many.hint("shuffle_merge"), "bucket").join(nodes.hint("shuffle_merge"), "node").select("bucket", "node", "n1", "sketch", "rank")


def agreeing_pairs(x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, first: int, agree: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of ``x`` and ``y`` with different labels that agree in ``agree`` of the ``first`` samples and in
    ``least`` of all."""
    step = max(1, AT_ONCE // max(len(y), 1))
    got = []
    across = np.ascontiguousarray(y[:, :first].T)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        same = np.zeros((len(part), len(y)), np.uint8)
        for k in range(first):
            same += part[:, k, None] == across[k]
        p, q = np.nonzero((same >= agree) & (lx[i : i + step, None] != ly))
        for j in range(0, len(p), 1 << 16):
            a, b = p[j : j + (1 << 16)], q[j : j + (1 << 16)]
            ok = (part[a] == y[b]).sum(1) >= least
            got.append((a[ok] + i, b[ok]))
    return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))


def joining_links(texts: list[bytes], label: np.ndarray, p: np.ndarray, q: np.ndarray, idf, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (p[k], q[k]) of texts that are at least ``threshold`` alike and join two classes: a pair whose classes are
    one already, by ``label`` or by the links before it, is passed over. Every other pair's similarity is taken from the texts."""
    used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    p_at, q_at = at[: len(p)], at[len(p) :]
    terms, weights = zip(*(weighted(word_hashes(texts[k]), idf) for k in used.tolist()), strict=True) if len(used) else ((), ())
    lengths, total = np.array([len(t) for t in terms], np.int64), np.array([w.sum() for w in weights])
    own = np.unique(np.concatenate(terms), return_inverse=True)[1] if len(used) else np.zeros(0, np.int64)
    ids = np.split(own, np.cumsum(lengths)[:-1]) if len(used) else []
    dense = np.zeros(own.max(initial=-1) + 1)
    parent = list(range(int(label.max(initial=-1)) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    of = label[used].tolist()
    order = np.argsort(p_at, kind="stable")
    got: list[tuple[int, int]] = []
    for rows in np.split(order, np.flatnonzero(np.diff(p_at[order])) + 1) if len(order) else []:
        a, others = int(p_at[rows[0]]), q_at[rows].tolist()
        dense[ids[a]] = weights[a]
        step = max(1, AT_ONCE // int(lengths[others].max()))
        for k in range(0, len(others), step):
            mine = root(of[a])
            part = [b for b in others[k : k + step] if root(of[b]) != mine]
            if not part:
                continue
            least = np.minimum(dense[np.concatenate([ids[b] for b in part])], np.concatenate([weights[b] for b in part]))
            least = np.add.reduceat(least, np.concatenate([[0], np.cumsum(lengths[part])[:-1]]))
            # Sums in another order may differ in their last digits: near the threshold the pair's own sum decides.
            for i in np.flatnonzero(least / (total[a] + total[part] - least) >= threshold - 1e-9).tolist():
                b = part[i]
                one, two = root(of[a]), root(of[b])
                if one != two and jaccard(terms[a], weights[a], terms[b], weights[b]) >= threshold:
                    parent[two] = one
                    got.append((a, b))
        dense[ids[a]] = 0
    links = used[np.array(got, np.int64).reshape(-1, 2)]
    return links[:, 0], links[:, 1]


def _compared(mixed: DataFrame, wider: DataFrame, near: DataFrame, sent, most: int, agree: int, first: int, wide: int, threshold: float, last: bool) -> DataFrame:
    """The (a, b) that join the classes of nodes that share a bucket of at most ``most`` rows, agree well enough and are alike by
    their texts; with ``last`` also those of larger buckets. Larger buckets, and those of many long texts, are compared by pairs of
    blocks. Each pair is looked at in one of its buckets."""
    least = _least(wide, threshold)
    own = mixed if last else mixed.where(F.col("n") <= most)
    of = own.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("mine"))  # a bucket for each band at most
    data = wider.join(near.select("node", "raw").hint("shuffle_merge"), "node")
    sizes = own.select("bucket", "n", "node").join(near.select("node", F.length("raw").alias("size")).hint("shuffle_merge"), "node").groupBy("bucket").agg(F.ceil(F.greatest(F.max("n") / most, F.sum("size") / TEXTS)).cast("int").alias("g"))
    own = own.select("bucket", "node", "label").join(sizes.hint("shuffle_merge"), "bucket").join(of.hint("shuffle_merge"), "node").join(data.hint("shuffle_merge"), "node")
    own = own.withColumn("at", F.pmod(F.xxhash64("node", F.lit(7)), F.col("g")).cast("int"))
    columns = ["bucket", "at", "node", "label", "mine", "wide", "raw"]
    # A bucket of one block is its only pair; of more, each block meets each.
    one = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), *columns)

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        bucket, i, j = (k.as_py() for k in key)
        label = np.unique(np.array(t.column("label").to_pylist(), object), return_inverse=True)[1]
        s = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint8).reshape(t.num_rows, wide)
        at = t.column("at").to_numpy()
        x, y = np.flatnonzero(at == i), np.flatnonzero(at == j)
        p, q = agreeing_pairs(s[x], s[y], label[x], label[y], first, agree, least)
        p, q = x[p], y[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        if len(p):
            ok = _first_common(t.column("mine").to_pylist(), p, q) == bucket
            p, q = joining_links(t.column("raw").to_pylist(), label, p[ok], q[ok], sent.value, threshold)
        names = t.column("node")
        return pa.table([pa.chunked_array([names.take(pa.array(k)).combine_chunks()], pa.binary()) for k in (p, q)], names=["a", "b"])

    return one.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")


def _first_common(lists: list[list[int]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least number that the lists p[k] and q[k] share, for each k; they do share one."""
    most = max(map(len, lists))
    low = np.iinfo(np.int64).min
    x = np.array([[*v, *[low] * (most - len(v))] for v in lists], np.int64)
    out = np.zeros(len(p), np.int64)
    for k in range(0, len(p), 1 << 13):
        a, b = x[p[k : k + (1 << 13)]], x[q[k : k + (1 << 13)]]
        both = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] != low)).any(2)
        out[k : k + (1 << 13)] = np.where(both, a, np.iinfo(np.int64).max).min(1)
    return out


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, bands: int = 12, rows: int = 4, alpha: float = ALPHA, small: int = 48, wide: int = 240, block: int = BLOCK) -> DataFrame:
    """One document of each class: that with the least id (nulls last), then the least node and text. Rows with null or
    equal ids are told apart by their texts; of rows with equal ids and texts one stays. All columns stay as they are."""
    got = _classes(docs, text, doc_id, threshold, bands, rows, alpha, small, wide, block)
    first = got.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "node", "_k1", "_k2")).alias("f"))
    ids, k1, k2, x1, x2 = fresh(docs, "_kept", "_k1", "_k2", "_x1", "_x2")
    kept = first.select(F.col("f._id").alias(ids), F.col("f._k1").alias(x1), F.col("f._k2").alias(x2))
    one, two = _key(text)
    own = docs.withColumns({k1: one, k2: two})
    same = own[doc_id].eqNullSafe(kept[ids]) & (own[k1] == kept[x1]) & (own[k2] == kept[x2])
    return own.join(kept.hint("shuffle_merge"), same, "left_semi").dropDuplicates([doc_id, k1, k2]).drop(k1, k2)
