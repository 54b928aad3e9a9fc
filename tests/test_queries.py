"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from haloforge.registry import FORMER, QUERIES, SQL

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame, columns):
    def text(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def test_all_have_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) == 78


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(FORMER)))
def test_query(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert rows(a, columns) == rows(b, columns)


@pytest.mark.parametrize("name", ["mass_density_profile", "mass_median_profile", "gas_profile", "kinematic_profile", "kinematic_profile_raw", "radial_profile", "select_spherical", "halo_ball_join"])
def test_generated_code_compiles(spark, name):
    """Without a way back, code that the JVM can't compile is an error."""
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert QUERIES[name](spark, DATA).count() > 0
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
