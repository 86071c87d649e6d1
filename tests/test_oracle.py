"""Every registered query against its DuckDB SQL on the same tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as contract
from nearname.plans.queries import REGISTRY

SF = pathlib.Path("/root/testdata/sf0.01")
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_contract():
    assert set(ORACLE) <= set(contract.queries())
    assert set(REGISTRY) <= set(ORACLE)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, str(SF))
    rows = [tuple(r) for r in frame.collect()]
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows, "a query without rows proves nothing"
    assert canonical(rows, frame.columns) == canonical(found.fetchall(), columns)
