"""Registered queries against their SQL, and the pipeline against itself, on the smallest tables."""

import math

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 8) if isinstance(v, float) and not math.isnan(v) else str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLE_SQL[name]).select(*[duckdb.ColumnExpression(c) for c in cols])
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted([tuple(map(plain, r)) for r in df.select(*cols).collect()], key=key) == sorted([tuple(map(plain, r)) for r in rel.fetchall()], key=key)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = table(spark, sf, "documents").select("doc_id", "lang").join(queries.op6_language(spark, sf), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in lang) > 0.97 * len(lang)
    tox = table(spark, sf, "labels").join(queries.op5_toxicity(spark, sf), "doc_id").collect()
    harmless = [r for r in tox if r.toxic == 0]
    assert sum(r.predicted for r in harmless) < 0.02 * len(harmless)
    assert sum(r.predicted for r in tox if r.toxic) > 0.6 * sum(r.toxic for r in tox)


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    rows = docs.collect()
    assert 0 < len(rows) < before and sorted(r.position for r in rows) == list(range(len(rows)))
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in rows}
