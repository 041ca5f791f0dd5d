"""The registered queries on the smallest tables, against their SQL where they have any."""

import pytest

import check_oracles
import corpus_pipeline
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, capsys, name):
    df = queries.QUERIES[name](spark, FOLDER)
    df.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    if name in queries.ORACLES:
        assert check_oracles.compare(df, check_oracles.duck(FOLDER).execute(queries.ORACLES[name]).to_arrow_table()) is None
    else:
        key = "page_id" if "page_id" in df.columns else "doc_id"
        table = spark.read.parquet(f"{FOLDER}/{'pages' if key == 'page_id' else 'documents'}.parquet")
        assert sorted(r[key] for r in df.select(key).distinct().collect()) == sorted(r[key] for r in table.select(key).collect())


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
