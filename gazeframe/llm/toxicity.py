"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes, calibration.

Method. A text is the vector of all its lower-cased words that any labelled example holds, weighted by ``ln(1 + count)``, by IDF over
all documents, and by ``1 + max(0, chi-square - 3.84)`` of the word with the label among the examples: words that go with a label beyond
chance pull harder, all others count by their TF-IDF, and none is left out. Examples lie in blocks; for each of the words that most
examples hold the index has the blocks' weights as a matrix and the largest weight in each block; the other words have posting lists. A
batch of queries first adds up the lists: the k-th best of these sums is a floor of the k-th best cosine. A block is taken only by
queries whose bound there (its best sum and the largest weights) reaches their floor, all of them in one matrix product: the k
nearest are exact. Votes are weighted by distance; a logistic curve fitted on the examples' own leave-one-out votes
calibrates them. A text without a word of any example has no neighbour and gets the smoothed rate of the examples without one.

Scale. Labelled examples: at most about ``examples`` rows, chosen by a hash of the id with a rate from the exact count; their
index is the only thing sent to tasks, bounded by the examples' words. Scoring moves no row.

Defined cases: null and empty texts have no word and get that base rate. An id that is labelled more than once counts
with its largest label. Without any label, all scores are 0. Repeated rows are scored alike; equal cosines go to the example that comes first.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import WORD_BYTES, bytes_of, map_texts, small_batches

#: Chi-square that one label in twenty goes beyond by chance.
CHANCE = 3.84
#: Words whose weights lie in a matrix, the most held ones; the others are in lists. That changes speed only.
COMMON = 1024
#: Queries that go through the index at once.
QUERIES = 64


def words_of(raw: bytes, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the text's known words, ascending, and how often each occurs."""
    count = Counter(raw.translate(WORD_BYTES).split())
    t = np.fromiter(map(words.get, count, repeat(-1)), np.int64, len(count))
    n = np.fromiter(count.values(), np.float64, len(count))
    by = np.argsort(t, kind="stable")[int((t < 0).sum()) :]
    return t[by].astype(np.int32), n[by]


def association(vectors: list[np.ndarray], labels: np.ndarray, n_words: int) -> np.ndarray:
    """Chi-square of each word's presence with the label."""
    ones, n1, n = np.zeros(n_words), int(labels.sum()), len(labels)
    held = np.zeros(n_words)
    for t, y in zip(vectors, labels.tolist(), strict=True):
        held[t] += 1
        ones[t] += y
    cross = ones * (n - n1) - (held - ones) * n1
    return n * cross**2 / np.maximum(held * (n - held) * n1 * (n - n1), 1)


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [start, end), and their lengths."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum())), n


class BlockMaxIndex:
    """Exact k nearest unit vectors by cosine. ``vectors``: (words, weights) of each example, words ascending."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_words: int, block: int = 64, common: int = COMMON):
        # Examples with the same strongest word lie together, so that bounds differ between blocks.
        order = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), i))
        self.order, self.size, self.blocks = np.array(order, np.int64), block, max(1, -(-len(order) // block))
        word = np.concatenate([np.zeros(0, np.int32), *(vectors[i][0] for i in order)]).astype(np.int32)
        held = np.bincount(word, minlength=n_words)
        by = np.argsort(word, kind="stable")
        del word
        self.weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])[by]
        self.at = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])[by]
        self.first = np.concatenate([[0], np.cumsum(held)])
        self.row = np.full(n_words, -1, np.int32)
        top = np.argsort(-held, kind="stable")[:common]
        self.row[top] = np.arange(len(top))

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the common words, a row each, and the largest of each block; made anew wherever it is needed."""
        top = np.flatnonzero(self.row >= 0)
        common = np.zeros((len(top), self.blocks * self.size))
        for t in top.tolist():
            own = slice(self.first[t], self.first[t + 1])
            common[self.row[t], self.at[own]] = self.weight[own]
        return common, common.reshape(len(top), self.blocks, self.size).max(2)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "matrix"}

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (words, weights) example numbers and cosines, best first; ties by number. ``skip``: an example that each leaves out."""
        out = []
        for i in range(0, len(queries), QUERIES):
            out += self._batch(queries[i : i + QUERIES], k, None if skip is None else np.array(skip[i : i + QUERIES]))
        return out

    def _batch(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        m, width = len(queries), self.blocks * self.size
        common, largest = self.matrix
        word, weight = (np.concatenate([q[j] for q in queries]) for j in (0, 1))
        query = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        own = self.row[word] >= 0
        dense = np.zeros((m, len(common)))
        dense[query[own], self.row[word[own]]] = weight[own]
        place, n = _spread(self.first[word[~own]], self.first[word[~own] + 1])
        sums = np.bincount(np.repeat(query[~own] * width, n) + self.at[place], np.repeat(weight[~own], n) * self.weight[place], minlength=m * width).astype(float, copy=False).reshape(m, width)
        if skip is not None:
            place = np.full(int(max(self.order.max(initial=0), skip.max())) + 1, -1)
            place[self.order] = np.arange(len(self.order))
            gone = np.flatnonzero(place[skip] >= 0)
            sums[gone, place[skip[gone]]] = -np.inf
        floor = np.partition(sums, width - k, axis=1)[:, width - k] if width > k else np.zeros(m)
        bound = sums.reshape(m, self.blocks, self.size).max(2) + dense @ largest
        taken = (bound > 0) & (bound >= np.maximum(floor, 0)[:, None] - 1e-9)
        for b in range(self.blocks):
            rows, part = np.flatnonzero(taken[:, b]), slice(b * self.size, (b + 1) * self.size)
            if len(rows):
                sums[rows, part] += dense[rows] @ common[:, part]
        sums.reshape(m, self.blocks, self.size)[~taken] = 0  # below the floor
        out = []
        for s, f in zip(sums, np.maximum(floor - 1e-9, 1e-10).tolist(), strict=True):
            found = np.flatnonzero(s >= f)
            cosine = np.round(s[found], 10)
            if len(found) > k:  # all that reach the k-th, ties among them
                near = cosine >= np.partition(cosine, len(found) - k)[len(found) - k]
                found, cosine = found[near], cosine[near]
            by = np.lexsort((self.order[found], -cosine))
            by = by[cosine[by] > 0][:k]
            out.append((self.order[found[by]], np.minimum(cosine[by], 1.0)))
        return out


class Model:
    """Words, weights, the examples' index and labels, and the calibration."""

    def __init__(self, words: dict[bytes, int], df: np.ndarray, n_docs: int, texts: list[bytes], labels: np.ndarray, ids: list[str], k: int):
        self.words, self.labels, self.ids, self.k = words, labels, ids, k
        counts = [words_of(x, words) for x in texts]
        idf = 1 + np.log((1 + n_docs) / (1 + df))
        self.weight = idf * (1 + np.maximum(association([t for t, _ in counts], labels, len(words)) - CHANCE, 0))
        vectors = [self.vector(*c) for c in counts]
        del counts
        self.index = BlockMaxIndex(vectors, len(words))
        bare = [y for v, y in zip(vectors, labels.tolist(), strict=True) if not len(v[0])]
        self.base = (sum(bare) + 0.5 * (len(labels) > 0)) / (len(bare) + 1 + (len(labels) > 0) * 10)
        self.slope, self.shift = 4.0, -2.0
        votes, ys = [], []
        for i, near in enumerate(self.index.nearest(vectors, k, skip=list(range(len(vectors))))):
            if len(near[0]):
                votes.append(self.vote(*near))
                ys.append(labels[i])
        self.index.__dict__.pop("matrix", None)  # 50 MB that only queries need
        if votes:
            self.slope, self.shift = _logistic(np.array(votes), np.array(ys, float))

    def vector(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.log1p(counts) * self.weight[words]
        return words, w / (np.sqrt((w * w).sum()) or 1.0)

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (1.05 - cosine)
        return float((w * self.labels[near]).sum() / w.sum())

    def score(self, texts: list[bytes]) -> list[tuple[float, list[str]]]:
        """For each text the score and the nearest examples' ids."""
        if not len(self.labels):
            return [(0.0, [])] * len(texts)
        out = []
        for near, cosine in self.index.nearest([self.vector(*words_of(x, self.words)) for x in texts], self.k):
            p = 1 / (1 + np.exp(-(self.slope * self.vote(near, cosine) + self.shift))) if len(near) else self.base
            out.append((float(p), [self.ids[i] for i in near[:5].tolist()]))
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, held near 4 and -2 by a weak prior."""
    w, start = np.array([4.0, -2.0]), np.array([4.0, -2.0])
    X = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ w))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + 0.5 * np.eye(2), X.T @ (p - y) + 0.5 * (w - start))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(max(w[0], 0.1)), float(w[1]))


def _document_frequencies(docs: DataFrame, text: str, words: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How many of all documents hold each word, and the number of documents."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, df = sent.value, np.zeros(len(sent.value) + 1, np.int64)
        for b in batches:
            df[-1] += b.num_rows
            for raw in bytes_of(b.column(0)):
                held = set(raw.translate(WORD_BYTES).split())
                t = np.fromiter(map(words.get, held, repeat(-1)), np.int64, len(held))
                df[t[t >= 0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["t", "n"])

    df = np.zeros(len(words) + 1, np.int64)
    got = docs.select(text).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # the examples' words at most
    df[got.column("t").to_numpy()] = got.column("n").to_numpy()
    sent.destroy()
    return df[:-1], int(df[-1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", examples: int = 6000, k: int = 15) -> Model:
    """Learns from labelled rows that satisfy ``learn`` (a condition on the labels' id)."""
    own = labels.where(learn & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    n = own.count()
    picked = own.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < min(1.0, examples / max(n, 1)) * 1_000_000)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(picked), "_id")  # about ``examples`` rows
    got = sorted({(str(r[0]), r[2], r[1].encode()) for r in rows.select("_id", "_t", "_y").toLocalIterator()})
    texts, ys, ids = [t for _, _, t in got], np.array([y for _, y, _ in got], np.int64), [i for i, _, _ in got]
    words = {w: i for i, w in enumerate(sorted({w for raw in texts for w in raw.translate(WORD_BYTES).split()}))}
    df, n_docs = _document_frequencies(docs, text, words)
    return Model(words, df, n_docs, texts, ys, ids, k)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, out: tuple[str, str, str] = ("tox_score", "tox_predicted", "tox_evidence")) -> DataFrame:
    """``docs`` with its columns, the score, 1 where it reaches ``threshold``, and the nearest examples' ids."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(b: pa.RecordBatch) -> dict:
        got = sent.value.score(list(bytes_of(b.column(text))))
        return {out[0]: [s for s, _ in got], out[1]: [int(s >= threshold) for s, _ in got], out[2]: [e for _, e in got]}

    return map_texts(docs, [text], [(out[0], "double"), (out[1], "int"), (out[2], "array<string>")], work)
