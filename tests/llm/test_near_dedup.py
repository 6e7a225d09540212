import random

import numpy as np

from gazeframe.llm.common import shingles, word_hashes
from gazeframe.llm.cws import jaccard, sample
from gazeframe.llm.near_dedup import agreeing_pairs, components, drop_near_duplicates, near_duplicates


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def _edit(rng, text, k):
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = "".join(rng.choice("klmnop") for _ in range(5))
    return " ".join(w)


def _rows():
    rng = random.Random(8)
    rows, passage = [], _text(rng, 60)
    for g in range(12):
        base = _text(rng, 150)
        for k in range(rng.choice([1, 2, 4])):
            rows.append(base if k == 1 else _edit(rng, base, k))
    hot = _text(rng, 120)
    rows += [hot] * 60 + [_edit(rng, hot, rng.choice([0, 1, 2, 3])) for _ in range(90)]
    rows += [_text(rng, 60) + " " + passage for _ in range(70)]
    rows += [None, "", "?!", "?!", "!?", "one two", "One, two!", "one two three", "x " * 5000]
    return rows


def _truth(rows, threshold):
    """Sure links (equal words, or plain and safely high similarity) and sure strangers, by brute force."""
    sets = [np.unique(shingles(word_hashes((t or "").encode()))) for t in rows]
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            same = (rows[i] or "") == (rows[j] or "")
            if same or len(sets[i]) and len(sets[j]) and jaccard(sets[i], np.ones(len(sets[i])), sets[j], np.ones(len(sets[j]))) >= threshold:
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, class_id string").repartition(5)
    for small in (48, 5):
        got = {r.doc_id: r for r in near_duplicates(df, small=small).collect()}
        assert len(got) == len(rows)
        sure, loose = _truth(rows, 0.84), _truth(rows, 0.76)
        for i in range(len(rows)):
            for j in range(i):
                one = got[i].class_id == got[j].class_id
                assert one or sure[i] != sure[j], (i, j)
                assert not one or loose[i] == loose[j], (i, j)
        assert all(r.representative == (r.doc_id == r.class_id) for r in got.values())
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r.class_id for r in got.values()})


def test_pairs_within_a_templated_family(spark):
    # All texts share a passage and are about 0.72 alike; each has one partner, about 0.83 alike, that is no centre of the family.
    rng = random.Random(6)
    passage, rows = _text(rng, 200).split(), []
    for _ in range(200):
        own = _text(rng, 14).split()
        for _ in range(2):
            words = list(passage)
            for at in rng.sample(range(10, 190, 12), 2):
                words[at] = "".join(rng.choice("klmnop") for _ in range(5))
            rows.append(" ".join(words + own))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    # Whole buckets are compared; or, with blocks of 24 nodes, larger buckets are banded anew, and the last are compared by blocks.
    for block in (2048, 24):
        got = {r.doc_id: r.class_id for r in near_duplicates(df, small=5, alpha=0.1, block=block).collect()}
        assert got == {i: i - i % 2 for i in range(400)}


def test_recall_in_a_large_group(spark):
    # 300 copies of one text with up to 40 of 200 words changed: links by brute force, on the very weights.
    rng = random.Random(11)
    base = _text(rng, 200)
    rows = [_edit(rng, base, rng.randrange(0, 40)) for _ in range(300)] + [_text(rng, 200) for _ in range(100)]
    sure, loose = _truth(rows, 0.83), _truth(rows, 0.77)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    pairs = [(i, j) for i in range(400) for j in range(i)]
    assert all(got[i] == got[j] for i, j in pairs if sure[i] == sure[j])
    assert all(loose[i] == loose[j] for i, j in pairs if got[i] == got[j])


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c", 7, "p"), (2, "a b c", 8, "q"), (None, "x", 9, "r"), (3, None, 1, "s"), (4, "", 2, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept int, _k1 string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r)[2:] for r in kept.collect()) == [(1, "s"), (7, "p"), (9, "r")]


def test_materialized_files_go(spark):
    from gazeframe.llm.common import materialize, release

    held = []
    df = materialize(spark.range(5), held)
    assert df.count() == 5 and len(held) == 1
    path = held[0].removeprefix("file:")
    release(spark, held)
    import os

    assert not os.path.exists(path) and not held


def test_agreeing_pairs():
    rng = np.random.default_rng(2)
    s, label = rng.integers(0, 3, (90, 40)).astype(np.uint8), rng.integers(0, 9, 90)
    s[50:60] = s[:10]
    got = set(zip(*(k.tolist() for k in agreeing_pairs(s[:50], s[50:], label[:50], label[50:], 10, 4, 18)), strict=True))
    same = s[:50, None] == s[None, 50:]
    want = (same[:, :, :10].sum(2) >= 4) & (same.sum(2) >= 18) & (label[:50, None] != label[50:])
    assert got == set(zip(*(k.tolist() for k in np.nonzero(want)), strict=True)) and got


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert near_duplicates(df).count() == 4 and drop_near_duplicates(df).count() == 2
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids_with_different_texts(spark):
    rows = [(None, "a b c"), (None, "d e f"), (None, "A, b c"), (1, "g h i"), (1, "j k l"), (1, "g h i"), (2, "j k l"), (3, "a b c")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == [(0, "d e f"), (1, "g h i"), (1, "j k l"), (3, "a b c")]


def test_collision_rate_is_weighted_jaccard():
    rng = np.random.default_rng(0)
    terms = np.sort(rng.integers(0, 2**63, 60, dtype=np.uint64))
    a, b = rng.uniform(0.5, 4, 40), rng.uniform(0.5, 4, 40)
    x, y = terms[:40], terms[20:]
    n = 4000
    same = float((sample(x, np.log(a), n) == sample(y, np.log(b), n)).mean())
    assert abs(same - jaccard(x, a, y, b)) < 0.03


def test_components(spark):
    links = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40)] + [(b"900", b"901")]
    got = {bytes(r[0]): bytes(r[1]) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert set(got.values()) == {b"000", b"900"} and len(got) == 43


def test_links_grow_with_the_nodes_not_with_their_pairs():
    """op8, pipeline: of all pairs of a family, at most as many links as nodes leave the task, and they join the same classes."""
    from gazeframe.llm.common import word_hashes
    from gazeframe.llm.cws import jaccard
    from gazeframe.llm.near_dedup import joining_links, weighted

    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.integers(0, 120, 1 + k % 6):
            words[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words).encode())
    idf = lambda terms: np.ones(len(terms))
    p, q = np.triu_indices(len(texts), 1)
    label = np.arange(len(texts)) // 2  # every two are one class already

    def classes(pairs):
        own = label.copy()
        for a, b in pairs:
            own[own == own[b]] = own[a]
        return {frozenset(np.flatnonzero(own == c).tolist()) for c in own}

    sets = [weighted(word_hashes(t), idf) for t in texts]
    alike = [(a, b) for a, b in zip(p.tolist(), q.tolist(), strict=True) if jaccard(*sets[a], *sets[b]) >= 0.8]
    a, b = joining_links(texts, label, p, q, idf, 0.8)
    assert 1 < len(classes(alike)) < 45 and len(alike) > 90
    assert classes(zip(a.tolist(), b.tolist(), strict=True)) == classes(alike) and len(a) == 45 - len(classes(alike))
    assert all(map(len, joining_links(texts, label, p[:0], q[:0], idf, 0.8))) is False
