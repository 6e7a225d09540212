"""The text queries that have SQL, on the smallest tables, where they are there."""

import math
import os

import pytest

from gazeframe.llm.queries import oracle_sql, queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def _plain(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{v:.6g}"
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(name, spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = c.execute(oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted("|".join(_plain(r[names.index(k)]) for k in cols) for r in cur.fetchall())
    assert sorted("|".join(_plain(r[k]) for k in cols) for r in df.collect()) == want


def test_contract_columns(spark):
    want = {
        "op1": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op4": "doc_id held_out score predicted",
        "op6": "doc_id held_out lang_pred score",
        "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op9": "page_id url text n_chars",
        "op10": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    }
    for name, f in queries().items():
        if (cols := want.get(name.split("_")[0])) and name.split("_")[0] in ("op7", "op9"):
            df = f(spark, DIR)
            assert df.columns[: len(cols.split())] == cols.split()
            assert df.count() == spark.read.parquet(f"{DIR}/{'pages' if name.startswith('op9') else 'documents'}.parquet").count()
