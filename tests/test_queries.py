"""Every registered query that has SQL gives the rows of that SQL."""

import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

from parcelspark.plans.registry import ORACLES, QUERIES
from tests.compare import oracle, rows
from tests.conftest import DATA


@pytest.fixture(scope="module")
def ours(spark, request):
    """The rows of the queries that are to be tested, a few at a time."""
    wanted = [x.callspec.params["name"] for x in request.session.items if x.module is sys.modules[__name__] and hasattr(x, "callspec")]
    with ThreadPoolExecutor(4) as pool:
        yield {n: pool.submit(lambda n=n: QUERIES[n](spark, DATA).toPandas()) for n in wanted}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(ours, name):
    theirs, own = oracle(ORACLES[name], DATA), ours[name].result()
    assert sorted(own.columns) == sorted(theirs.columns)
    assert rows(own) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(ours, name):
    assert len(ours[name].result()) > 0


def test_entry_without_corpus_package():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
