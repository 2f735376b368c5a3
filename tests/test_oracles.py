"""Every registered factor query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from panelforge import queries
from panelforge.library.alpha101 import alpha101
from panelforge.library.alpha158 import alpha158

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - set(queries.LIBRARIES)))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = db.execute(queries.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    check(got, want, cols)


def check(got, want, cols):
    keys = [c for c in ("sym", "t", "label", "run") if c in cols]
    got, want = (d[cols].sort_values(keys).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if c in keys:
            assert (got[c].astype(str) == want[c].astype(str)).all()
        else:
            bad = [(x, y) for x, y in zip(got[c].astype(float), want[c].astype(float)) if not (x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) <= 2e-6)]
            assert not bad, (c, len(bad), bad[:5])


@pytest.mark.parametrize("library", ["alpha101", "alpha158"])
def test_library(spark, db, library):
    """All factors of a library in one plan, each against the SQL of its own query."""
    names = [k for k in queries.LIBRARIES if k.startswith("a158_") == (library == "alpha158")]
    factors = alpha101() if library == "alpha101" else alpha158() | alpha158({"price": {}, "volume": {}})
    got = queries._library(factors)[0](spark, SF).toPandas()
    assert len(names) == (81 if library == "alpha101" else 35)
    for k in names:
        want = db.execute(queries.ORACLES[k]).fetchdf()
        cols = sorted(want.columns)
        assert len(got) == len(want) and want[[c for c in cols if c not in ("sym", "t")]].notna().mean().min() > 0.1
        check(got[cols], want[cols], cols)


def test_library_query(spark, db):
    for k in ("alpha101", "a158_ma"):
        got, want = queries.QUERIES[k](spark, SF).toPandas(), db.execute(queries.ORACLES[k]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        check(got[sorted(got.columns)], want[sorted(got.columns)], sorted(got.columns))


@pytest.mark.parametrize("name", ["a158_open", "alpha054"])
def test_to_the_last_bit(spark, name):
    """On sf0.1, where a week's last row is tied with another, and where powers are large."""
    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = (d.sort_values(["sym", "t"]).reset_index(drop=True) for d in (queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()))
    assert len(got) == len(want) > 0
    for c in want.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
