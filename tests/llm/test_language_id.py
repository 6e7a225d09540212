import random

import numpy as np
from pyspark.sql import functions as F

from gazeframe.llm.language_id import ByteGRU, Labeller, has_letter, identify, segments, train


def _docs(n):
    rng = random.Random(1)
    parts = {"aa": ["kra", "tok", "ßen", "zu"], "bb": ["lio", "mea", "ño", "eau"]}
    out = []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    rows = [*_docs(120), (500, None, "aa"), (501, "", None), (502, "12 34 !?", "bb"), (503, "☃ ☃", None), (504, "KRA TOK " * 3000, None), (505, "x" * 5000, None), (0, _docs(1)[0][1], "aa")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, lang_score int").repartition(3)
    model = train(df, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert len(got) == len(rows) - 1
    for i, _, lang in _docs(120):
        assert got[i].lang_pred == lang
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (500, 501, 502, 503))
    assert got[504].lang_pred == "aa" and 0.5 < got[504].lang_score <= 1


def test_memo_is_exact():
    net = ByteGRU(3, seed=2)
    texts = [f"ab cde {'q' * (i % 70)} né ab".encode() for i in range(150)]
    a = Labeller(net, ["x", "y", "z"]).label(texts)
    for t, lang, score in zip(texts, *a, strict=True):
        p = [net.probabilities(np.frombuffer(s, np.uint8).reshape(1, -1))[0] for s in segments(t)]
        mean = np.concatenate(p).mean(0)
        assert abs(mean.max() - score) < 1e-5 and ["x", "y", "z"][mean.argmax()] == lang


def test_gradients():
    net = ByteGRU(3, hidden=4, embed=3)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    ids, y = np.array([[1, 2, 3], [4, 2, 1]], np.uint8), np.array([0, 2])
    grad = net.gradients(ids, y)[1]
    for name in ("E", "Uf", "Wb", "V", "af"):
        x = net.p[name]
        j = np.unravel_index(np.abs(grad[name]).argmax(), x.shape)
        old = x[j]
        x[j] = old + 1e-3
        up = net.gradients(ids, y)[0]
        x[j] = old - 1e-3
        down = net.gradients(ids, y)[0]
        x[j] = old
        assert abs((up - down) / 2e-3 - grad[name][j]) < 1e-4


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert identify(df, train(df, F.lit(True))).collect()[0].lang_pred == "und"
    assert has_letter("é".encode()) and not has_letter("☃1".encode())


def test_empty_table(spark):
    from pyspark.sql import functions as F

    from gazeframe.llm.language_id import identify, train

    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(docs, train(docs, F.lit(True))).count() == 0
    some = spark.createDataFrame([(1, "words of a text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify(some, train(some, F.lit(True))).collect()} == {1: "und", 2: "und"}
