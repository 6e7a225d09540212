import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gazeframe.llm.lm_scoring import END, Vocabulary, contexts, count_places, learn, score_texts, tokens


def _docs():
    rng = random.Random(4)
    a, b = ["der", "die", "und", "haus", "baum"], ["the", "of", "and", "tree", "house"]
    out = []
    for i in range(200):
        voc = a if i % 2 else b
        out.append((i, " ".join(rng.choice(voc) if rng.random() < 0.9 else f"{rng.choice('xyz')}{rng.randrange(400)}" for _ in range(30)), 1.0))
    return [*out, (900, None, 1.0), (901, "", 1.0), (902, " \t\n", 1.0), (903, "The OF\x0bÉ é ## ##", 1.0), (903, "The OF\x0bÉ é ## ##", 1.0), (904, "the of " * 20000, 1.0)]


def test_counts_base_and_gain(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    for head in (150_000, 6):
        model = learn(df, F.col("doc_id") % 5 != 1, head=head, frequent=6, buckets=8)
        got = score_texts(df, model).collect()
        assert len(got) == len(rows)
        train = Counter(t for i, x, _ in rows if i % 5 != 1 for t in tokens((x or "").encode()))
        n, v = sum(train.values()), len(train)
        text = {i: x for i, x, _ in rows}
        for r in got:
            t = tokens((text[r.doc_id] or "").encode())
            base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(train[x] > 0 for x in t), n)
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
            assert r.score <= 0
        held = [r for r in got if r.doc_id % 5 == 1 and r.doc_id < 900]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_place_is_learnt_from(spark):
    # One text of 20,000 places and many short ones: all of their places are in the counts.
    rows = [(0, " ".join(["der die"] * 10000)), *((i, "the of tree") for i in range(1, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = learn(df, F.lit(True), frequent=6, buckets=4)[1]
    context, counts = count_places(df, words, "text")
    want = Counter()
    for _, x in rows:
        c = words.encode(x.encode())[1]
        want.update(zip(*(v.tolist() for v in (*contexts(c), c)), strict=True))
    got = {(*c, y): int(n[y]) for c, n in zip(context.tolist(), counts, strict=True) for y in np.flatnonzero(n).tolist()}
    assert got == want and counts.sum() == 20001 + 299 * 4


def test_probabilities_sum_to_one(spark):
    rows = _docs()[:100]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    vocabulary, words, net = learn(df, F.lit(True), frequent=6, buckets=4)
    table = net.table().reshape(words.classes, words.classes, words.classes)
    assert np.allclose((10.0**table).sum(-1), 1, atol=1e-4)
    # Within each class: what known words share and what is left to unknown ones.
    count = {bytes(r[0]): r[1] for r in vocabulary.collect()}
    share = np.zeros(words.classes)
    for w, c in count.items():
        k = words.class_of(w)
        share[k] += 1.0 if w in words.own else 10 ** (math.log10(c) + words.log_known[k])
    for k in range(words.bucket and min(words.bucket.values()) or 0, words.classes):
        if words.mass[k]:
            assert abs(share[k] + 10 ** words.log_unknown[k] - 1) < 1e-6
    assert contexts(np.array([5, 6, 7]))[0].tolist() == [0, 0, 5] and END in count


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(df, learn(df, F.lit(False))).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0 and got[2].n_tokens == 1
    assert score_texts(df.limit(0), learn(df, F.lit(True))).count() == 0
    assert isinstance(learn(df, F.lit(True))[1], Vocabulary)
