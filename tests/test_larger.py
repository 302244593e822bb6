"""Queries against their SQL on tables larger than those of the other tests."""

import duckdb
import pytest

from catchment import registry

from .compare import same


@pytest.mark.parametrize("n", [70_000])
def test_snapshot_of_many_elements(spark, data, tmp_path, n):
    """More elements than one level below the root was made for."""
    con = duckdb.connect()
    rows = con.execute(f"SELECT count(*) FROM '{data}/part.parquet'").fetchone()[0]
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + i * {rows} AS p_partkey) FROM '{data}/part.parquet', (SELECT unnest(range({n // rows + 1})) AS i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    same(registry.queries()["a22_source_snapshot"](spark, f"file://{tmp_path}"), con.execute(registry.oracle_sql()["a22_source_snapshot"]).df())
