"""The registered queries of the corpus operators, as the driver runs them."""

import pytest

from parcelspark.llm import queries
from tests.compare import oracle, rows
from tests.conftest import DATA

EXACT = ("op3_lm_scoring", "op9_quality_classifier")  # trained: their scores have no closed form


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_of_the_sql(spark, name):
    own, theirs = queries.queries()[name](spark, DATA).toPandas(), oracle(queries.ORACLES[name], DATA)
    assert sorted(own.columns) == sorted(theirs.columns)
    assert rows(own) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.ORACLES) - {"pipeline", *EXACT}))
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.queries()[name](spark, DATA).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
