"""Language-model scoring with a log-bilinear neural model, trained here in numpy by noise-contrastive estimation.

Method. A token's probability is that of its class after the classes of the two tokens before it, times its share of its
class. The end of a text and the ``frequent`` most frequent words are classes of their own; other words are classed
by their first two bytes. Classes are predicted by a log-bilinear model: the predicted vector is the sum of the context
classes' vectors, each times its position's matrix; a class scores its product with the class's vector plus a bias. The
model learns to tell classes from noise of their unigram distribution, whose expectation is taken over all classes. For scoring, all contexts' products with all
classes are taken in batches and normalised exactly. Within a class, a word has its count's share of what a
Good-Turing estimate (the mass of words counted once) leaves to known words; the rest is the unknown words'.

Scale. Counts cover every token of the training documents: each task counts its texts within bounded memory, and Spark
adds the counts up by word. The whole vocabulary stays distributed: only the at most ``head`` most frequent words, those
above a count taken from the distribution of counts, are sent to the tasks; the other words' rows, one for each
document and word, are joined with the vocabulary. A word that is in many documents is in the head, so that no key
of that join is hot. The network is trained on every place of all training documents: tasks count (context, class) places, Spark
adds them up by context, and the driver gets one row of counts for each of the at most classes ** 2 contexts.

Defined cases: a null text is empty: one end token. Without training documents every word is unknown. Repeated rows are
scored alike, each by itself. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import LOWER, bytes_of, map_texts, materialize, small_batches, without

#: Stands for the end of a text; no word holds a blank.
END = b"\n"
#: Distinct words that a task counts before it hands them on.
HELD = 250_000
#: Places that a task counts before it hands them on.
PLACES = 1 << 21


def tokens(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, then the end."""
    out = raw.translate(LOWER).split()
    out.append(END)
    return out


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all tokens of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def hand_on() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
            counts.clear()

        for b in batches:
            for raw in bytes_of(b.column(0)):
                counts.update(tokens(raw))
                if len(counts) >= HELD:
                    yield from hand_on()
        yield from hand_on()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The head of the vocabulary, the classes, and what is known of the classes' words."""

    def __init__(self, head: list[tuple[bytes, int]], prefixes: list[tuple[bytes, int, int]], total: int, distinct: int, frequent: int, buckets: int):
        """``head``: words and counts, most frequent first. ``prefixes``: (two bytes, tokens, words counted once)."""
        self.total, self.distinct = total, distinct
        words = [w for w, _ in head if w != END]
        own = words[:frequent]
        mass = {p: n for p, n, _ in prefixes}
        once = {p: n for p, _, n in prefixes}
        count = dict(head)
        for w in own:
            mass[w[:2]] = mass.get(w[:2], 0) - count[w]
            once[w[:2]] = once.get(w[:2], 0) - (count[w] == 1)
        mass.pop(END[:2], None)
        kept = sorted((p for p in mass if mass[p] > 0), key=lambda p: (-mass[p], p))[: buckets - 1]
        # Classes: 0 before the text, 1 its end, then words of their own, then prefixes, and last all other prefixes.
        self.own = {END: 1} | {w: 2 + i for i, w in enumerate(own)}
        self.bucket = {p: 2 + len(own) + i for i, p in enumerate(kept)}
        self.other = 2 + len(own) + len(kept)
        self.classes = self.other + 1
        self.mass, self.once = np.zeros(self.classes), np.zeros(self.classes)
        for w, k in self.own.items():
            self.mass[k] = count.get(w, 0)
        for p in mass:
            k = self.bucket.get(p, self.other)
            self.mass[k] += mass[p]
            self.once[k] += once.get(p, 0)
        unknown = (self.once + 0.5) / (self.mass + 1)
        self.log_unknown = np.log10(np.minimum(unknown, 1.0))
        self.log_known = np.log10(np.maximum(1 - unknown, 1e-12)) - np.log10(np.maximum(self.mass, 1))  # plus that of the count
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.head_class = np.array([self.class_of(w) for w, _ in head], np.int64)
        c = np.array([n for _, n in head], float)
        self.head_base = np.log10(c + 0.5)
        self.head_share = np.array([0.0 if w in self.own else float(np.log10(n) + self.log_known[k]) for (w, n), k in zip(head, self.head_class.tolist(), strict=True)])

    def class_of(self, word: bytes) -> int:
        k = self.own.get(word)
        return self.bucket.get(word[:2], self.other) if k is None else k

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, Counter]:
        """Of a text's tokens: places in the head (-1 for others), classes, and counts of the others."""
        toks = tokens(raw)
        at = np.fromiter(map(self.index.get, toks, repeat(-1)), np.int64, len(toks))
        classes = self.head_class[at] if len(self.head_class) else np.zeros(len(at), np.int64)
        rare: Counter = Counter()
        for i in np.flatnonzero(at < 0).tolist():
            rare[toks[i]] += 1
            classes[i] = self.class_of(toks[i])
        return at, classes, rare


def contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes two places and one place before each."""
    before = np.concatenate([[0, 0], classes])
    return before[:-2], before[1:-1]


class LogBilinear:
    """Two context positions; vectors of classes as context and as target are separate."""

    def __init__(self, classes: int, unigram: np.ndarray, dim: int = 48, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.noise = (unigram + 1e-3 * max(unigram.sum(), 1.0) / classes) / (unigram.sum() + 1e-3 * max(unigram.sum(), 1.0))
        self.noise[0] = 0
        self.noise /= self.noise.sum()
        f = lambda *s: (rng.normal(0, 0.1, s)).astype(np.float32)
        self.p = {"R": f(classes, dim), "Q": f(classes, dim), "C1": np.eye(dim, dtype=np.float32), "C2": np.eye(dim, dtype=np.float32), "b": np.log(np.maximum(self.noise, 1e-12)).astype(np.float32)}

    def fit(self, context: np.ndarray, counts: np.ndarray, epochs: int = 40, batch: int = 1024, noises: int = 96, rate: float = 0.02, seed: int = 0) -> LogBilinear:
        """Noise-contrastive estimation on counts of classes by context (two places before, one before); a batch of contexts
        counts each of its places, against ``noises`` expected noise classes a place."""
        rng, p, m, s, k = np.random.default_rng(seed), self.p, {}, {}, 0
        prior = (noises * np.maximum(self.noise, 1e-12)).astype(np.float32)
        log_noise = np.log(prior)
        steps = -(-len(context) // batch)
        total, mean = epochs * steps, counts.sum(dtype=np.float64) / steps
        for _ in range(epochs):
            order = rng.permutation(len(context))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                (w2, w1), n = context[at].T, counts[at]
                r2, r1 = p["R"][w2], p["R"][w1]
                q = r2 @ p["C2"] + r1 @ p["C1"]
                real = 1 / (1 + np.exp(np.clip(log_noise - q @ p["Q"].T - p["b"], -60, 60)))
                g = ((real * (n + n.sum(1)[:, None] * prior) - n) / mean).astype(np.float32)
                gq = g @ p["Q"]
                grad = {"Q": g.T @ q, "b": g.sum(0), "C2": r2.T @ gq, "C1": r1.T @ gq, "R": np.zeros_like(p["R"])}
                np.add.at(grad["R"], w2, gq @ p["C2"].T)
                np.add.at(grad["R"], w1, gq @ p["C1"].T)
                k += 1
                lr = rate * (1 - k / (total + 1))
                for name, d in grad.items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    s[name] = 0.99 * s.get(name, 0) + 0.01 * d * d
                    p[name] -= (lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(s[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return self

    def table(self) -> np.ndarray:
        """log10 probabilities of all classes after all contexts, normalised: (before last, last, class), one flat array."""
        n = len(self.p["R"])
        far, near = self.p["R"] @ self.p["C2"], self.p["R"] @ self.p["C1"]
        out = np.empty((n, n, n), np.float32)
        for i in range(n):
            s = (far[i] + near) @ self.p["Q"].T + self.p["b"]
            s[:, 0] = -np.inf  # no token is of the class before the text
            s -= s.max(1, keepdims=True)
            out[i] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return out.reshape(-1)


_TABLES: dict[str, np.ndarray] = {}


def _table_of(key: str, net: LogBilinear) -> np.ndarray:
    """A worker computes the table once."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = net.table()
    return _TABLES[key]


def learn(docs: DataFrame, fit: Column, text: str = "text", doc_id: str = "doc_id", head: int = 150_000, frequent: int = 160, buckets: int = 94, seed: int = 0) -> tuple[DataFrame, Vocabulary, LogBilinear]:
    """The vocabulary as a table (word, c), its head and classes, and the trained network."""
    spark = docs.sparkSession
    rows = docs.where(fit)
    vocabulary = materialize(count_words(rows, text))
    # Counts up to 64 singly, then by factors of 2 ** 0.25: the least count that at most ``head`` words reach.
    step = F.when(F.col("c") <= 64, F.col("c")).otherwise(F.floor(F.log2("c") * 4) - 24 + 64).cast("long")
    hist = sorted(vocabulary.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
    total, distinct = sum(r["c"] for r in hist), sum(r["n"] for r in hist)
    least, n = None, 0
    for r in hist:
        n += r["n"]
        if n > head:
            break
        least = r["s"]
    # The end is always in the head: it is a class of its own, whose count must be known.
    in_head = F.expr("word = X'0A'") if least is None else (step >= least) | F.expr("word = X'0A'")
    top = [(bytes(r[0]), int(r[1])) for r in vocabulary.where(in_head).collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    two = F.expr("substring(word, 1, 2)")
    prefixes = [(bytes(r[0]), int(r[1]), int(r[2])) for r in vocabulary.groupBy(two.alias("p")).agg(F.sum("c"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0))).collect()]
    words = Vocabulary(top, prefixes, total, distinct, frequent, buckets)

    context, counts = count_places(rows, words, text)
    net = LogBilinear(words.classes, words.mass, seed=seed)
    if len(context):
        net.fit(context, counts, seed=seed)
    return vocabulary, words, net


def count_places(docs: DataFrame, words: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (classes two places and one place before) and, for each, how often every class follows, over all tokens."""
    spark, k = docs.sparkSession, words.classes
    small_batches(spark)
    sent = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = 0

        def hand_on() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code // k), pa.array(code % k), pa.array(n.astype(np.int64))], names=["context", "y", "n"])

        for b in batches:
            for raw in bytes_of(b.column(0)):
                c = sent.value.encode(raw)[1]
                x2, x1 = contexts(c)
                held.append((x2 * k + x1) * k + c)
                many += len(c)
                if many >= PLACES:
                    yield hand_on()
                    held, many = [], 0
        if held:
            yield hand_on()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for y, n in zip(b.column(1), b.column(2), strict=True):
                row = np.zeros(k, np.float32)
                row[y.values.to_numpy()] = n.values.to_numpy()
                rows.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["context", "counts"])

    added = docs.select(text).mapInArrow(count, "context long, y long, n long").groupBy("context", "y").agg(F.sum("n").alias("n"))
    lists = added.groupBy("context").agg(F.collect_list(F.struct("y", "n")).alias("l")).select("context", "l.y", "l.n")  # at most k each
    got = sorted((r[0], bytes(r[1])) for r in lists.mapInArrow(pack, "context long, counts binary").collect())
    code = np.array([c for c, _ in got], np.int64)
    return np.stack([code // k, code % k], 1), np.frombuffer(b"".join(n for _, n in got), np.float32).reshape(-1, k)


_ADDED = [("n_tokens", "long"), ("_known", "long"), ("_base", "double"), ("_score", "double"), ("_rare", "array<struct<w:binary,n:int,k:int>>")]


def score_texts(docs: DataFrame, model: tuple[DataFrame, Vocabulary, LogBilinear], text: str = "text") -> DataFrame:
    """``docs`` with its columns but the text, and ``n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities)."""
    vocabulary, words, net = model
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((words, net))
    key = uuid.uuid4().hex

    def work(b: pa.RecordBatch) -> dict:
        words, net = sent.value
        table, k = _table_of(key, net), words.classes
        got: list[tuple] = []
        for raw in bytes_of(b.column(text)):
            at, c, rare = words.encode(raw)
            x2, x1 = contexts(c)
            inside = at[at >= 0]
            score = float(table[(x2 * k + x1) * k + c].sum(dtype=np.float64)) + float(words.head_share[inside].sum())
            got.append((len(at), len(inside), float(words.head_base[inside].sum()), score, [{"w": w, "n": n, "k": words.class_of(w)} for w, n in rare.items()]))
        return {n: [g[i] for g in got] for i, (n, _) in enumerate(_ADDED)}

    base = without(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score", "_row", *(n for n, _ in _ADDED))
    first = materialize(map_texts(base.withColumn("_row", F.monotonically_increasing_id()), [text], _ADDED, work).drop(text))
    rare = first.select("_row", F.explode("_rare").alias("r")).select("_row", "r.w", "r.n", "r.k")
    joined = rare.join(vocabulary.hint("shuffle_merge"), rare.w == vocabulary.word, "left")
    logs = lambda x: F.element_at(F.array(*(F.lit(float(v)) for v in x)), F.col("k") + 1)
    seen = F.col("c").isNotNull()
    more = joined.groupBy("_row").agg(
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("_more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("_more_base"),
        F.sum(F.col("n") * F.when(seen, F.log10(F.col("c").cast("double")) + logs(words.log_known)).otherwise(logs(words.log_unknown))).alias("_more_score"),
    )
    out = first.drop("_rare").join(more, "_row", "left")
    per_token = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kept = [c for c in base.columns if c.lower() != text.lower()]
    return out.select(
        *kept,
        "n_tokens",
        (F.col("_known") + zero("_more_known")).cast("long").alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"),
        (F.col("_base") + zero("_more_base") - F.col("n_tokens") * per_token).cast("double").alias("base_score"),
        (F.col("_score") + zero("_more_score")).cast("double").alias("score"),
    )
