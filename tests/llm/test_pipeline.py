import random

from gazeframe.llm.decontaminate import brute_force
from gazeframe.llm.queries import oracle_sql, queries


def _fixture(tmp_path, spark):
    """Tables with planted cases; the ids that must go, by stage."""
    rng = random.Random(6)
    parts = {"aa": ["kra", "tok", "ben", "zu", "mil"], "bb": ["lio", "mea", "nio", "eau", "su"]}
    word = lambda g: "".join(rng.choice(parts[g]) for _ in range(rng.randrange(2, 5)))
    item = " ".join(word("aa") for _ in range(20))
    docs, labels, gone = [], [], {"und": [], "toxic": [], "copies": [], "leaks": []}
    for i in range(260):
        g = ("aa", "bb")[i % 2]
        w = [word(g) for _ in range(60)]
        kind = i % 13
        if kind == 3:
            for k in (5, 20, 40):
                w.insert(k, rng.choice(["grobian", "schurke"]))
            gone["toxic"].append(i)
        text = " ".join(w)
        if kind == 5 and i > 20:
            text = docs[i - 4][1] if i % 2 else docs[i - 4][1] + " zuzu"
            gone["copies"].append(i)
        if kind == 7:
            text = f"{' '.join(w[:30])} {item.upper()}. {' '.join(w[30:])}"
            gone["leaks"].append(i)
        if kind == 9:
            text = rng.choice(["12 !?", "", "--- 00"])
            gone["und"].append(i)
        docs.append((i, text, g, f"src{i % 3}", len(text)))
        if i % 4:
            labels.append((i, 1, int(kind == 3)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i1", item), ("i2", "none of these words at all")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, [("i1", item)], gone


def test_stages_and_result(tmp_path, spark):
    import corpus_pipeline as cp

    docs, items, gone = _fixture(tmp_path, spark)
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    alive = {d[0] for d in docs}
    want = {"language_id": gone["und"], "toxicity": gone["toxic"], "near_dedup": gone["copies"], "decontamination": gone["leaks"]}
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{tmp_path}/{name}"
        left.write.parquet(path)
        left = spark.read.parquet(path)
        alive -= set(want[name])
        assert {r.doc_id for r in left.select("doc_id").collect()} == alive, name
    assert not any(x[4] for x in brute_force([r.text for r in left.collect()], items))
    mixed = cp.run(spark, str(tmp_path)).collect()
    total = {}
    for r in mixed:
        assert 0 < r.taken <= 2 * r.size and r.size == len(r.text.split())
        total.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert {r.doc_id for r in mixed} <= alive and all(abs(a - b) <= 1 for a, b in total.values()) and len(total) == 3


def test_defined_cases_of_every_stage(tmp_path, spark, monkeypatch):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    docs, items, gone = _fixture(tmp_path, spark)
    item = items[0][1]
    rng = random.Random(9)
    words = ["kratok", "benzumil", "milkra", "tokben", "zukra"]
    own, other = (" ".join(rng.choice(words) for _ in range(1500)) for _ in range(2))
    extra = [(None, None, "aa", "src1", 0), (None, other, None, None, 9), (7000, f"{own[:4000]} {item} {own[4000:]}", "aa", "src0", 9), (7001, "", "bb", "src0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.read.parquet(f"{tmp_path}/documents.parquet").unionByName(spark.createDataFrame(extra, schema))
    base = base.unionByName(base.where("doc_id in (0, 1)"))  # repeated rows
    names = ["n_words", "items", "spans", "_lang", "_score", "_toxic", "_kept", "_k1", "class_id", "contaminated"]
    docs = base.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("text").substr(1, 9)) for n in names}).repartition(3)
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        last = name == cp.STAGES[-1][0]
        assert out.columns == docs.columns + (["size", "source_size", "target", "taken"] if last else []), name
        rows = out.collect()
        assert all(r[n] == (None if r.text is None else f"{n}:{r.text[:9]}") for r in rows for n in names), name
        kept[name] = rows
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    assert ids["language_id"].count(0) == 2 and ids["toxicity"].count(1) == 2 and ids["decontamination"].count(0) == 2  # judged alike
    assert ids["near_dedup"].count(0) == ids["near_dedup"].count(1) == 1
    assert 7001 not in ids["language_id"] and 7000 in ids["near_dedup"] and 7000 not in ids["decontamination"]  # a passage in a long text
    assert sum(r.doc_id is None and r.text is not None for r in kept["near_dedup"]) == 1
    assert sum(r.doc_id is None for r in kept["decontamination"]) == 2 and not any(r.text is None for r in kept["language_id"])
    assert all(r.taken > 0 for r in kept["mixing"])
    # The prediction counts: documents of other languages than those asked for go.
    monkeypatch.setattr(cp, "LANGUAGES", ("aa",))
    only = [r for r in cp.language(spark, docs, str(tmp_path)).collect() if r.lang is not None]
    assert only and all(r.lang == "aa" for r in only)


def test_registry():
    names = [n.split("_")[0] for n in queries()]
    assert sorted(names, key=lambda x: int(x[2:])) == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(queries())
