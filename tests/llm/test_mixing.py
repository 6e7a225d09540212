import hashlib
import random
import re

from gazeframe.llm.mixing import bucket_digits, mix_sources


def _brute(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(size), set(names)
    while open_:  # shares out again and again until none is above its cap
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * total[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= full
    taken = {}
    for s in names:
        own = sorted((hashlib.md5((str(i) if i is not None else "").encode()).hexdigest(), n, k) for k, ((i, _, src), n) in enumerate(zip(rows, size)) if src == s)
        budget, at = int(target[s] + 1e-9), 0
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for _, n, k in own:
            taken[k] = epochs * n + max(0, min(n, rest - at))
            at += n
    return size, total, target, [taken[k] for k in range(len(rows))]


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["b", "a", "hot", "hot", "hot", None, "é"])) for i in range(400)]
    rows += [(500, None, "a"), (501, "x\u00a0y\x0bz", "a"), (502, "q " * 9000, "b"), (None, "no id", "b"), (7, rows[7][1], rows[7][2]), (600, " ", "blank"), (601, None, "blank")]
    size, total, target, taken = _brute(rows)
    df = spark.createDataFrame([(*r, k, "old") for k, r in enumerate(rows)], "doc_id long, text string, source string, k int, Size string").repartition(6)
    for per_bucket in (3000, 5):
        got = mix_sources(df, per_bucket=per_bucket).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["size"], r.source_size) == (size[r.k], total[r.source])
            assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
            assert 0 <= r.taken <= 2 * r["size"]
        mine = sorted((str(rows[k][0]), size[k], t) for k, t in enumerate(taken))
        assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == mine  # repeated rows may change places
        for s in total:
            assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 1


def test_reruns_and_empty_table(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t") for i in range(50)], "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mix_sources(x).collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b
    assert mix_sources(df.limit(0)).count() == 0
    assert bucket_digits(100, 3000) == 1 and bucket_digits(10**9, 3000) == 5
