"""Every registered query of the engine against its SQL, on the smallest driver tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from byteloom.plans.oracle import ORACLE
from byteloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        theirs = [d[0] for d in found.description]
        assert sorted(theirs) == columns
        assert plain(rows) == plain(tuple(r[theirs.index(c)] for c in columns) for r in found.fetchall())


def test_wide_detect_takes_whole_texts(spark, tmp_path, monkeypatch):
    texts = ["plain words " * 300, "é and more " * 300, "x" * 1501, "long " * 4000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr("byteloom.plans.queries.detect", lambda docs, **_: seen.append({r["doc_id"]: len(r["content"]) for r in docs.collect()}) or docs.selectExpr("doc_id", "named_struct('encoding', '') AS detected"))
    QUERIES["q_wide_detect"](spark, str(tmp_path))
    assert seen == [{i: len(t) * (2 if i < 2 else 4) for i, t in enumerate(texts)}]
