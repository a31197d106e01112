"""Every query with a SQL twin against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from curvespark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_certified_range_is_exact(spark):
    """The certified answer equals the decision on the originals."""
    from curvespark.functions import curves
    from curvespark.operators import store
    from curvespark.plans.native import points
    from curvespark.sources.tables import nested

    p = points(spark, DATA)
    tracks = {r["track"]: store.xy(r["x"], r["y"]) for r in nested(p).collect()}
    r = 300.0
    hits = {(x["q"], x["c"]) for x in store.certified_range(p, p, r, 10.0).where("hit").collect()}
    assert hits == {(a, b) for a in tracks for b in tracks if a != b and curves.decide(tracks[a], tracks[b], r)}
