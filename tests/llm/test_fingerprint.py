import hashlib
import random

import numpy as np

from gazeframe.llm.cws import jaccard
from gazeframe.llm.fingerprint import edit, fingerprint, term_hashes


def _rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(300)]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))) for i in range(90)]
    return [*rows, (None, "null id"), (1000, None), (1001, ""), (1002, "?! ..."), (1003, "so " * 7000 + "end"), (9, rows[3][1]), (12, "another text of an equal id")]


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, near_next int").repartition(4)
    for per in (7, 10_000):
        got = fingerprint(df, rows_per_range=per).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        # Unique ids around which the order is plain.
        ids = [i for i, _ in rows]
        order = sorted((x for x in rows if x[0] is not None), key=lambda x: -x[0]) + [x for x in rows if x[0] is None]
        for k, (i, t) in enumerate(order):
            j, after = order[(k + 1) % len(order)]
            if ids.count(i) > 1 or ids.count(j) > 1:
                continue
            t, after = t or "", after or ""
            r = by[i][0]
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256(edit(t, after).encode()).hexdigest()
            bags = [np.unique(term_hashes(x.encode()), return_counts=True) for x in (t, edit(t, after), after)]
            assert abs(r.near_edited - jaccard(*bags[0], *bags[1])) < 0.3
            assert abs(r.near_next - jaccard(*bags[0], *bags[2])) < 0.3
        prints = {}
        for r in got:
            if r.doc_id is not None and ids.count(r.doc_id) == 1:
                t = dict(rows)[r.doc_id] or ""
                assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert len(set(prints.values())) == len(prints)


def test_one_and_no_row(spark):
    df = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    r = fingerprint(df).collect()[0]
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert fingerprint(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    import datetime

    texts = [f"word{i % 7} is the number {i} of these" for i in range(60)] + [None, "", "one", "one"]
    day = datetime.date(2024, 1, 1)
    kinds = {"string": lambda i: f"{'ä' if i % 3 else 'Z'}{i}", "date": lambda i: day + datetime.timedelta(i), "double": lambda i: i / 4, "long": lambda i: i}
    for kind, of in kinds.items():
        rows = [(None if i % 10 == 3 else of(i), t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        # Nulls last; within them the order is by hash, so only rows with ids are compared.
        order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0].encode() if kind == "string" else r[0], reverse=True)
        for per in (7, 10_000):
            got = fingerprint(df, rows_per_range=per).collect()
            assert len(got) == len(rows)
            by = {r.doc_id: r for r in got if r.doc_id is not None}
            for (i, t), (_, after) in zip(order, order[1:], strict=False):
                assert by[i].edited_sha256 == hashlib.sha256(edit(t or "", after or "").encode()).hexdigest(), (kind, per, i)


def test_equal_ids_and_clashing_names(spark):
    # All ids are null or equal: the ring is the order of the texts' hashes, the same for any ranges.
    rows = [(None, f"text {i}", "a", i) for i in range(40)] + [(5, f"row {i % 30}", "b", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _range string, _order int").repartition(3)
    got = [sorted((r["_order"], r["_range"], r.edited_sha256, r.fingerprint) for r in fingerprint(df, rows_per_range=per).collect()) for per in (5, 10_000)]
    assert got[0] == got[1] and len(got[0]) == 80 and {r[1] for r in got[0]} == {"a", "b"}
