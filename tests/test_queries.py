"""Every query with SQL gives DuckDB's rows; the others run."""

import pytest

from parsimony.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, sf_dir, same, name):
    assert same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gain_history_rounds_seconds(spark, tmp_path, same):
    """Fractions of a second round to the nearest, halves to even, as the SQL's cast does; also across minutes, days and the epoch."""
    import duckdb

    times = "2024-01-30 23:59:59.499999|2024-01-30 23:59:59.5|2024-01-30 23:59:59.999999|2024-01-30 23:58:58.5|2023-12-31 23:59:59.75|1969-12-31 23:59:59.4|1969-12-31 23:59:59.5|1969-12-31 23:58:59.6"
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT i - 1 AS event_id, l[i]::TIMESTAMP AS ts, i AS user_id, 'view' AS event_type, i * 1.5::DOUBLE AS value FROM (SELECT string_split('{times}', '|') AS l), range(1, 10) r(i)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = registry.QUERIES["gain_history_top20"](spark, str(tmp_path)).toPandas()
    assert got["at"].tolist()[:8] == [None, "1969-12-31 23:59", "1970-01-01 00:00", "1969-12-31 23:59", "2024-01-01 00:00", "2024-01-30 23:58", "2024-01-31 00:00", "2024-01-31 00:00"]
    assert same(got, con.sql(registry.SQL["gain_history_top20"]).df())
