"""Every registered query with oracle SQL gives the same rows in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tests.conftest import SMALL
from workload.oracle import ORACLE
from workload.queries import REGISTRY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def canonical(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    frame = REGISTRY[name](spark, SMALL)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert canonical(map(tuple, frame.select(columns).collect())) == canonical(expected)
