"""Exact medians against numpy, and their plans."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from haloforge.operators import medians as M
from haloforge.operators import profiles


def found_of(spark, rows, values, **kw):
    df = spark.createDataFrame(rows, "bin int, " + ", ".join(f"{v} double" for v in values))
    return {r["bin"]: tuple(r[v] for v in values) for r in M.medians(df, "bin", values).collect()}


@pytest.mark.parametrize("cells", [2, 7, 4096])
def test_medians_of_uneven_groups(spark, monkeypatch, cells):
    """One group holds 99 % of rows; values of every size, with many ties."""
    monkeypatch.setattr(M, "CELLS", cells)
    r = random.Random(3)
    n = 300 if cells == 2 else 3000
    rows = [(0, r.lognormvariate(0, 8), float(r.randrange(3))) for _ in range(n)] + [(k, r.gauss(0, 1), -5.0) for k in range(1, 5) for _ in range(k)]
    found = found_of(spark, rows, ["a", "b"])
    for k in range(5):
        for j in (0, 1):
            assert found[k][j] == pytest.approx(statistics.median(x[1 + j] for x in rows if x[0] == k), rel=1e-15)


def test_medians_of_odd_values(spark):
    """Nulls are no values; NaN is greatest; infinities and the largest doubles don't overflow."""
    inf, nan = math.inf, math.nan
    rows = [(0, None, 1.0), (0, None, None), (1, -1.7e308, 5e-324), (1, 1.7e308, 0.0), (1, 1e308, 5e-324), (2, nan, inf), (2, nan, -inf), (2, 1.0, inf), (3, inf, -inf), (3, -inf, 2.0), (3, 0.5, 1.0), (None, 7.0, 7.0)]
    found = found_of(spark, rows, ["a", "b"])
    assert set(found) == {0, 1, 2, 3} and found[0] == (None, 1.0) and found[1] == (1e308, 5e-324) and math.isnan(found[2][0]) and found[2][1] == inf and found[3] == (0.5, 1.0)
    assert M.medians(spark.createDataFrame([], "bin int, a double"), "bin", ["a"]).count() == 0


def test_no_percentile_in_plans(spark):
    rows = spark.range(1000).select((F.col("id") % 4).cast("int").alias("bin"), F.rand(1).alias("r"), F.rand(2).alias("mass"))
    plan = profiles.radial_profile(rows, [0.1, 0.2, 0.4, 0.8])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median" in plan
    assert "median" not in profiles.radial_profile(rows, [0.1, 0.2, 0.4, 0.8], median=False).columns
