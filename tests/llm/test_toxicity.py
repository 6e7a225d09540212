import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from gazeframe.llm.toxicity import BlockMaxIndex, score_toxicity, train


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(400):
        t = np.sort(rng.choice(30, rng.integers(0, 6), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / (np.sqrt((w * w).sum()) or 1)))
    vectors[7] = vectors[3]
    dense = np.zeros((400, 30))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    ask = list(range(0, 400, 3))
    for common in (0, 7, 30):
        index = pickle.loads(pickle.dumps(BlockMaxIndex(vectors, 30, block=16, common=common)))
        for skip in (None, ask):
            for q, (got, cos) in zip(ask, index.nearest([vectors[q] for q in ask], 9, skip), strict=True):
                sims = np.round(dense @ dense[q], 10)
                want = [i for _, i in sorted((-s, i) for i, s in enumerate(sims) if s > 0 and (skip is None or i != q))[:9]]
                assert got.tolist() == want
                assert np.allclose(cos, sims[want])


def test_index_of_few_or_no_vectors():
    none = np.zeros(0, np.int64), np.zeros(0)
    one = np.array([1]), np.array([1.0])
    assert BlockMaxIndex([], 0).nearest([none], 3)[0][0].tolist() == []
    assert BlockMaxIndex([none, one], 2).nearest([one, none], 80)[0][0].tolist() == [1]
    assert BlockMaxIndex([none, one], 2).nearest([none, one], 3, skip=[0, 1])[1][0].tolist() == []


def _rows():
    rng = random.Random(5)
    out = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = [rng.choice(["grobian", "schurke"]), "schelm" + rng.choice("xyz")]
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 0.1), (1001, "", 0.1), (1002, "Grobian! " * 3000, 0.1), (1002, "Grobian! " * 3000, 0.1)], "doc_id long, text string, tox_score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(3, 0, 1), (None, 1, 1), (5000, 1, 1)], "doc_id long, toxic int, quality int")
    model = train(docs, labels, F.col("doc_id") % 4 != 2)
    got = [r for r in score_toxicity(docs, model).collect()]
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    wrong = [r for r in got if r.doc_id < 1000 and r.tox_predicted != truth[r.doc_id]]
    assert not wrong
    odd = {r.doc_id: r for r in got if r.doc_id >= 1000}
    assert odd[1002].tox_predicted == 1 and odd[1000].tox_predicted == 0 and odd[1000].tox_score == odd[1001].tox_score
    assert odd[1002].tox_evidence


def test_few_labels_are_enough(spark):
    # The only telling word is in 4 of 9 toxic texts of 64: its chi-square is 26.
    rows = [(i, "eins grobian" if i < 4 else "eins zwei", int(i < 9)) for i in range(64)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "zwei grobian"), (901, "zwei")], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.lit(True))
    got = {r.doc_id: r.tox_predicted for r in score_toxicity(docs, model).collect()}
    assert got[900] == 1 and got[901] == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(docs, train(docs, labels, F.lit(True))).collect()[0].tox_score == 0


def test_whole_query_against_brute_force(spark, tmp_path):
    import math
    import random
    import zlib
    from collections import Counter

    from gazeframe.llm.queries import queries
    from gazeframe.llm.toxicity import train
    from gazeframe.llm.common import WORD_BYTES, crc_mod

    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(120)]
    docs, labels = [], []
    for i in range(150):
        w = [rng.choice(plain) for _ in range(rng.randrange(3, 30))]
        bad = i % 5 == 0
        if bad:
            w += [rng.choice(["schurke", "grobian"])] * rng.randrange(1, 4)
        docs.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(bad)))
    docs += [(900, None), (901, ""), (902, "word " * 30_000 + "schurke")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries()["op4_toxicity"](spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)

    learnt = sorted((str(i), y, dict(docs)[i]) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    words = lambda t: Counter((t or "").encode().translate(WORD_BYTES).split())
    known = {w for _, _, t in learnt for w in words(t)}
    count = lambda t: {w: n for w, n in words(t).items() if w in known}
    df = Counter(x for _, t in docs for x in count(t))
    n, n1 = len(learnt), sum(y for _, y, _ in learnt)

    def pull(w):
        a = sum(y for _, y, t in learnt if w in words(t))
        held = sum(w in words(t) for _, _, t in learnt)
        low = held * (n - held) * n1 * (n - n1)
        return 1 + max(0, n * (a * (n - n1) - (held - a) * n1) ** 2 / max(low, 1) - 3.84)

    pulls = {w: pull(w) for w in known}

    def vector(t):
        v = {x: math.log1p(c) * (1 + math.log((1 + len(docs)) / (1 + df[x]))) * pulls[x] for x, c in count(t).items()}
        n = math.sqrt(sum(a * a for a in v.values())) or 1.0
        return {x: a / n for x, a in v.items()}

    index = [vector(t) for _, _, t in learnt]
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = train(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    for i, t in docs:
        q = vector(t)
        near = sorted((-round(sum(a * v.get(x, 0.0) for x, a in q.items()), 9), k) for k, v in enumerate(index) if any(x in v for x in q))
        want = model.base
        if near:
            cut = near[:15]
            if len(near) > 15 and near[15][0] == near[14][0]:
                continue  # a tie at the last place
            w = [1 / (1.05 + s) for s, _ in cut]
            vote = sum(a * learnt[k][1] for a, (_, k) in zip(w, cut, strict=True)) / sum(w)
            want = 1 / (1 + math.exp(-(model.slope * vote + model.shift)))
        assert abs(got[i].score - want) < 1e-6, i
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_empty_documents(spark):
    from gazeframe.llm.common import crc_mod
    from gazeframe.llm.toxicity import score_toxicity, train

    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert score_toxicity(docs, train(docs, labels, crc_mod("doc_id", 4) != 2)).count() == 0
