"""Every registered query against its DuckDB oracle (sf0.001), plus entry()."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tocsin.sources.tables import TABLES, table_path


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x
    out = [tuple(v(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in df.schema.fields} == types
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(srows, df.columns) == _norm(res.fetchall(), dcols)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "randomization", "nurse", "outcome"]
    assert df.count() > 0


def test_every_query_has_docstring():
    for name, fn in E.queries().items():
        assert fn.__doc__, name


def test_outcome_tables_come_ordered_by_cluster(spark):
    for name in ("primary_outcome", "alarms_all", "desat_area_rows"):
        rows = [((r["nurse"] is None, r["nurse"]), r["id"]) for r in E.queries()[name](spark, SF_SMALL).collect()]
        assert rows == sorted(rows), name
