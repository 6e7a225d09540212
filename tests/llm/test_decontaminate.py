import random

from gazeframe.llm.decontaminate import brute_force, decontaminate


def _cases(seed):
    rng = random.Random(seed)
    voc = ["a", "b", "the", "Éa", "x1", "of"]
    items = [("10", " ".join(rng.choice(voc) for _ in range(16))), ("9", " ".join(rng.choice(voc) for _ in range(5))), ("2", None), ("7", "  ,. "), ("3", "one two THREE")]
    docs = []
    for k in range(40):
        w = [rng.choice([*voc, "zz", "yy"]) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = items[k % 2][1].upper().split() if k % 2 else items[0][1].split()[2:15]
        docs.append(" ".join(w))
    return docs + ["", None, "one, two; three", "one two", docs[0], docs[3]], items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = _cases(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, spans string").repartition(3)
        bm = spark.createDataFrame(items, "item_id string, text string")
        want = brute_force(docs, items)
        for slice_chars in (8_000_000, 40):
            got = decontaminate(df, bm, shard_words=20, slice_chars=slice_chars).collect()
            assert len(got) == len(docs)
            for r in got:
                assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r
                assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_empty_tables(spark):
    bm = spark.createDataFrame([], "item_id string, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert not decontaminate(df, bm).collect()[0].contaminated
    assert decontaminate(df.limit(0), bm).count() == 0


def test_long_documents(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(4))
    items = [(f"i{k}", " ".join(word() for _ in range(20))) for k in range(5)]
    texts = [" ".join(word() for _ in range(6000)) for _ in range(3)]
    texts[1] = f"{texts[1]} {items[2][1].upper()} {texts[0][:9000]} {items[4][1]}, end"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from gazeframe.llm.decontaminate import brute_force, decontaminate

    got = sorted(tuple(r) for r in decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"), shard_words=2000).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == [(i, *x) for i, x in enumerate(brute_force(texts, items))] and got[1][2] == 40
