"""Language identification with a bidirectional gated recurrent network over bytes, trained here in numpy.

Method. A segment is a word: a run of letters, at most ``SEGMENT`` bytes of it at a time (a longer run is cut into
consecutive segments, all of them read). The bytes of a segment feed a gated recurrent unit forwards and another backwards;
a softmax over both states labels every byte position with a language. The network is trained by backpropagation through
time on words of documents whose language is known. A document's probabilities are the mean over all its letter positions.

Scale. As states start anew at each segment, equal segments have equal labels: each task keeps the summed labels of the
segments that it has met in a bounded memo and runs the network once for each new one, many of one length at a time. Rows
stay in their tasks: nothing is shuffled. Training reads at most ``per_language`` documents of each language, chosen
by a hash of the id with a rate from exact counts, and ``words`` words of each, spread over the whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Without any labelled document all
texts are ``und``. Ties between languages go to the first in text order. Repeated rows are judged alike. Input columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import bytes_of, map_texts

SEGMENT = 32
#: Letters and bytes of other scripts; A-Z lower-cased; all else ends a segment.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MEMO = 150_000


def has_letter(raw: bytes) -> bool:
    if len(raw) != len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")):
        return True
    return any(c.isalpha() for c in raw.translate(None, bytes(range(128))).decode("utf-8", "ignore"))


def segments(raw: bytes) -> list[bytes]:
    words = raw.translate(LETTERS).split()
    if max(map(len, words), default=0) <= SEGMENT:
        return words
    return [w[i : i + SEGMENT] for w in words for i in range(0, len(w), SEGMENT)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    """Two gated recurrent units over bytes and a softmax at every position."""

    def __init__(self, classes: int, hidden: int = 24, embed: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.h, self.c = hidden, classes
        self.p: dict[str, np.ndarray] = {"E": rng.normal(0, 0.3, (256, embed))}
        for d in "fb":
            self.p |= {f"W{d}": rng.normal(0, embed**-0.5, (embed, 3 * hidden)), f"U{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"a{d}": np.zeros(3 * hidden)}
        self.p |= {"V": rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, classes)), "v": np.zeros(classes)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _run(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, batch, hidden) in reading order of direction ``d``; with ``keep`` what the backward pass needs."""
        h, H = np.zeros((ids.shape[0], self.h), np.float32), self.h
        table, u = self.p["E"] @ self.p[f"W{d}"] + self.p[f"a{d}"], self.p[f"U{d}"]
        steps = range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1)
        out, tape = np.empty((ids.shape[1], len(h), H), np.float32), []
        for t in steps:
            x, r = table[ids[:, t]], h @ u
            zr = _sigmoid(x[:, : 2 * H] + r[:, : 2 * H])
            z, g = zr[:, :H], zr[:, H:]
            n = np.tanh(x[:, 2 * H :] + g * r[:, 2 * H :])
            new = n + z * (h - n)
            if keep:
                tape.append((t, h, z, g, n, r[:, 2 * H :]))
            out[t] = h = new
        return out, tape

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """(batch, steps, classes) for segments of equal length."""
        f, b = self._run(ids, "f", False)[0], self._run(ids, "b", False)[0]
        logit = f @ self.p["V"][: self.h] + b @ self.p["V"][self.h :] + self.p["v"]
        e = np.exp(logit - logit.max(-1, keepdims=True))
        return (e / e.sum(-1, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        H, n, steps = self.h, ids.shape[0], ids.shape[1]
        runs = {d: self._run(ids, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], -1)
        logit = both @ self.p["V"] + self.p["v"]
        e = np.exp(logit - logit.max(-1, keepdims=True))
        prob = e / e.sum(-1, keepdims=True)
        rows = np.arange(n)
        loss = float(-np.log(prob[:, rows, labels] + 1e-9).mean())
        err = prob
        err[:, rows, labels] -= 1
        err /= n * steps
        grad = {"V": np.tensordot(both, err, ([0, 1], [0, 1])), "v": err.sum((0, 1)), "E": np.zeros_like(self.p["E"])}
        back = err @ self.p["V"].T
        for d in "fb":
            u, w = self.p[f"U{d}"], self.p[f"W{d}"]
            gu, gt = np.zeros_like(u), np.zeros((256, 3 * H), np.float32)
            dh = np.zeros((n, H), np.float32)
            for t, h, z, g, m, rn in reversed(runs[d][1]):
                dh = dh + (back[t, :, :H] if d == "f" else back[t, :, H:])
                dn = dh * (1 - z) * (1 - m * m)
                dz = dh * (h - m) * z * (1 - z)
                dg = dn * rn * g * (1 - g)
                dx = np.concatenate([dz, dg, dn], 1)
                dr = np.concatenate([dz, dg, dn * g], 1)
                gu += h.T @ dr
                np.add.at(gt, ids[:, t], dx)
                dh = dh * z + dr @ u.T
            grad |= {f"U{d}": gu, f"W{d}": self.p["E"].T @ gt, f"a{d}": gt.sum(0)}
            grad["E"] += gt @ w.T
        return loss, grad

    def fit(self, words: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 0) -> ByteGRU:
        """Adam over batches of words of one length."""
        rng, m, s, k = np.random.default_rng(seed), {}, {}, 0
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        packs = {n: (np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n), labels[at]) for n, at in by.items()}
        total = sum(-(-len(x[1]) // batch) for x in packs.values()) * epochs
        for _ in range(epochs):
            jobs = []
            for n, (ids, _y) in packs.items():
                order = rng.permutation(len(ids))
                jobs += [(n, order[i : i + batch]) for i in range(0, len(order), batch)]
            for j in rng.permutation(len(jobs)):
                n, at = jobs[j]
                ids, y = packs[n]
                _, grad = self.gradients(ids[at], y[at])
                k += 1
                lr = rate * (1 - k / (total + 1)) * (len(at) / batch) ** 0.5
                norm = max(1.0, sum(float((g * g).sum()) for g in grad.values()) ** 0.5)
                for name, g in grad.items():
                    g = g / norm
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    s[name] = 0.999 * s.get(name, 0) + 0.001 * g * g
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(s[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return self


class Labeller:
    """Document probabilities from the network, with a bounded memo of segments."""

    def __init__(self, net: ByteGRU, names: list[str]):
        self.net, self.names = net, names
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.sums, self.n = np.zeros((1024, self.net.c + 1), np.float32), 0

    def learn(self, words: set[bytes]) -> None:
        """Adds the summed labels of segments that the memo doesn't hold."""
        by: dict[int, list[bytes]] = {}
        for w in words:
            if w not in self.rows:
                by.setdefault(len(w), []).append(w)
        for n, ws in by.items():
            for i in range(0, len(ws), 2048):
                part = ws[i : i + 2048]
                got = self.net.probabilities(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), n)).sum(1)
                while self.n + len(part) > len(self.sums):
                    self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.sums[self.n : self.n + len(part), :-1] = got
                self.sums[self.n : self.n + len(part), -1] = n
                self.rows.update(zip(part, range(self.n, self.n + len(part)), strict=True))
                self.n += len(part)

    def label(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        lang, score = [], []
        for first in range(0, len(texts), 64):  # the memo never has to hold more than these texts' segments
            if self.n > MEMO:
                self.clear()
            part = [Counter(segments(raw)) if self.names and has_letter(raw) else None for raw in texts[first : first + 64]]
            self.learn(set().union(*(c.keys() for c in part if c)))
            for counts in part:
                if not counts:
                    lang.append("und")
                    score.append(0.0)
                    continue
                at = np.fromiter(map(self.rows.get, counts, repeat(0)), np.int64, len(counts))
                total = np.fromiter(counts.values(), np.float64, len(counts)) @ self.sums[at]
                p = total[:-1] / total[-1]
                best = int(p.argmax())
                lang.append(self.names[best])
                score.append(float(min(1.0, max(0.0, p[best]))))
        return lang, score


def _sample_words(docs: DataFrame, text: str, words: int) -> DataFrame:
    """Every k-th segment of each text, so that about ``words`` are spread over the whole of it."""

    def work(b: pa.RecordBatch) -> dict:
        out = []
        for raw in bytes_of(b.column("_text")):
            s = segments(raw)
            out.append(b" ".join(s[:: max(1, -(-len(s) // words))]))
        return {"_words": pa.array(out, pa.binary())}

    return map_texts(docs.withColumn("_text", F.col(text)), ["_text", "_lang"], [("_words", "binary")], work, keep=False).select("_lang", "_words")


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 250, words: int = 80, each: int = 15_000, seed: int = 0) -> tuple[ByteGRU, list[str]]:
    """Fits the network on a bounded sample: at most about ``per_language`` documents of each language, ``words`` of each."""
    rows = docs.where(learn & F.col(lang).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string").alias("l")).count().collect()}
    names = sorted(n)
    if not names:
        return ByteGRU(1), []
    rate = F.element_at(F.create_map(*(x for k in names for x in (F.lit(k), F.lit(min(1.0, per_language / n[k]))))), F.col("_lang"))
    part = rows.withColumn("_lang", F.col(lang).cast("string")).where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1_000_000)) < rate * 1_000_000)
    got = sorted((r[0], bytes(r[1])) for r in _sample_words(part, text, words).collect())
    rng = np.random.default_rng(seed)
    sample, labels = [], []
    for k, name in enumerate(names):
        own = [w for l, x in got if l == name for w in x.split()]
        own = [own[i] for i in rng.permutation(len(own))[:each]]
        sample += own
        labels += [k] * len(own)
    net = ByteGRU(len(names), seed=seed)
    return (net.fit(sample, np.array(labels), seed=seed) if sample else net), names


def identify(docs: DataFrame, model: tuple[ByteGRU, list[str]], text: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with its columns and the language and its probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def work(b: pa.RecordBatch) -> dict:
        if "labeller" not in state:
            state["labeller"] = Labeller(*sent.value)
        lang, score = state["labeller"].label(list(bytes_of(b.column(text))))
        return {out[0]: lang, out[1]: score}

    return map_texts(docs, [text], [(out[0], "string"), (out[1], "double")], work)
