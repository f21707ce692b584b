import __spark_entry__ as driver


def test_names_and_twins():
    queries, twins = driver.queries(), driver.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 60


def test_entry_gives_scores_by_level(spark):
    rows = driver.entry(spark).collect()
    assert {r.level for r in rows} == {"Total", "Region", "Segment", "Bottom", "Overall"} and all(r.scrps > 0 for r in rows)
