"""Every registered query against its reference SQL, on the smallest tables."""

import os

import duckdb
import pyarrow as pa
import pytest

from annalist.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def rows(found: pa.Table):
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
    return sorted(found.column_names), sorted(str([shown(v) for _, v in sorted(r.items())]) for r in found.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert rows(registry.QUERIES[name](spark, SF).toArrow()) == rows(con.sql(registry.ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
