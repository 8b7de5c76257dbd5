import pytest

from gneiss import queries
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


#: Queries whose rows come in an order, with what orders them in SQL that has no order of its own.
ORDERED = {n: "" for n in ("zrange_score", "zrevrange_score", "zrange_lex", "zrevrange_lex", "zrange_all", "sort_numeric_desc_limit", "sort_alpha", "sort_by_get", "xrange", "xrevrange", "xread_after", "zpopmin", "ann_l2", "ann_ip", "geosearch_nearest")} | {"zrange_rank": " ORDER BY rank", "zrange_rank_from_end": " ORDER BY rank", "zrevrange": " ORDER BY rank"}


@pytest.mark.parametrize("name", sorted(ORDERED))
@pytest.mark.parametrize("broadcasts", [True, False])
def test_order_of_rows(spark, sf, duck, name, broadcasts):
    if not broadcasts:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(queries.QUERIES[name](spark, sf), duck, queries.SQL[name] + ORDERED[name], ordered=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
