import pytest

from quern import plans


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_matches_duckdb(name, same):
    same(plans.queries()[name], plans.oracle_sql()[name])


def test_event_joins_read_whole_tables(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1, 3 * i), 1) for i in range(4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: sorted(map(tuple, plans.queries()[name](spark, str(tmp_path)).collect()))
    assert run("event_pairs") == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    assert run("op_as_of") == [(0, None), (1, 0), (2, 1), (3, 2)]


@pytest.mark.parametrize("name,least", [("sort_ordinal", 26), ("sort_expr", 16), ("sort_nulls_first", 21)])
def test_sorts_return_all_rows(spark, name, least):
    places = [r.place for r in plans.queries()[f"{name}_all"](spark, "/root/testdata/sf0.001").collect()]
    assert len(places) >= least and sorted(places) == [*range(1, len(places) + 1)]


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
