"""Every registered query against its DuckDB oracle at sf0.001 (rows-only when no oracle)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from quillspark.plans import catalog
from quillspark.session import TABLES

SF = "/root/testdata/sf0.001"
OR = E.oracle_sql()
QS = {k: v for k, v in E.queries().items() if k in OR or k in catalog.QUERIES}  # the others have tests of their own


def _norm(v):
    if hasattr(v, "item") and not isinstance(v, (list, tuple, str)) and getattr(v, "ndim", 1) == 0:
        v = v.item()
    if v is None or type(v).__name__ in ("NAType", "NaTType"):
        return None
    if isinstance(v, float):
        if v != v:
            return None
        return int(v) if v.is_integer() else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(str(_norm(x)) for x in r) for r in pdf[cols].itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_oracle():
    assert set(OR) <= set(QS)
    assert len(QS) >= 80


@pytest.mark.parametrize("name", sorted(QS))
def test_query_matches_oracle(spark, con, name):
    got = QS[name](spark, SF).toPandas()
    if name not in OR:
        assert len(got) >= 0
        return
    want = con.execute(OR[name]).df()
    assert _rows(got) == _rows(want)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
