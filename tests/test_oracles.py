"""Every query outside the training-data folder against its SQL, and without SQL for a stable, non-empty result."""

import pytest
from comparing import check

from siftwell import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    check(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_reruns_agree(spark, data, name):
    one, two = (sorted(map(repr, QUERIES[name](spark, data).collect())) for _ in range(2))
    assert one and one == two


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "document_id", "score", "lanes", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
