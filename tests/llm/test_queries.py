"""The registered queries of the subpackage against SQL where there is any, and the pipeline's stages."""

import pytest

import corpus_pipeline
from catchment.llm import entries, store
from catchment.llm.store import stored

from ..compare import same

QUERIES, SQL = entries.queries(), entries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, data, name):
    same(QUERIES[name](spark, data), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_every_document_has_its_row(spark, data, name):
    got = QUERIES[name](spark, data)
    want = spark.read.parquet(f"{data}/documents.parquet").count()
    assert got.select("doc_id").distinct().count() == want


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, data), "stage")
        assert docs.columns == columns, name
        assert docs.count() <= before or name == "mixing"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def tables_of(spark):
    import os

    folder = store.shared_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_results_stay_and_settings_return(spark, data):
    before = {k: spark.conf.get(k) for k in store._SMALL}
    for name in sorted(QUERIES):
        there = tables_of(spark)
        QUERIES[name](spark, data)
        assert [x.rsplit("-", 1)[0] for x in tables_of(spark) - there] == [name]
    there = tables_of(spark)
    corpus_pipeline.run(spark, data).count()
    assert [x.rsplit("-", 1)[0] for x in tables_of(spark) - there] == ["pipeline-packing"]
    assert {k: spark.conf.get(k) for k in store._SMALL} == before


def test_queries_side_by_side(spark, data):
    from concurrent.futures import ThreadPoolExecutor

    before = {k: spark.conf.get(k) for k in store._SMALL}
    names = ["op5_near_duplicates", "op9_line_dedup", "op10_mixing", "op11_token_alignment"]
    alone = {n: sorted(QUERIES[n](spark, data).collect(), key=str) for n in names}
    with ThreadPoolExecutor(4) as pool:
        got = dict(zip(names, pool.map(lambda n: sorted(QUERIES[n](spark, data).collect(), key=str), names)))
    assert got == alone
    assert {k: spark.conf.get(k) for k in store._SMALL} == before
