"""Ranks come from one exchange by ranges, are written once, and keep what they gave for repeated keys and rows, and for rows without a key."""

import random

from haloforge.operators import transform
from haloforge.plans import queries

from .conftest import DATA

ROWS = "k long, v double, w long"


def odd_rows():
    r = random.Random(5)
    rows = [(r.choice([None, -3, 0, 7, 7, 7, 1 << 50, r.randrange(40)]), r.choice([None, 0.5, float("nan"), float(r.randrange(5))]), r.randrange(3)) for _ in range(900)]
    return rows + rows[:60]


def order(row):
    return [(x is not None, x != x, 0 if x is None or x != x else x) for x in row]


def test_rank_of_rows_reads_its_input_no_more(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, ROWS).select("v", "k", "w").write.parquet(str(tmp_path / "rows"))
    ranked = transform.rank_of_rows(spark.read.parquet(str(tmp_path / "rows")), "k", "rank")
    assert ranked.columns == ["k", "v", "w", "rank"] and not any(str(tmp_path) in f for f in ranked.inputFiles())
    want = [(*row, i) for i, row in enumerate(sorted(rows, key=order)) if row[0] is not None]  # null keys are counted, and left out
    assert sorted(map(str, map(tuple, ranked.collect()))) == sorted(map(str, want))


def test_rank_from_zero_takes_one_exchange(spark, monkeypatch):
    plans, write = [], transform.materialize

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(transform, "materialize", written)
    rows = odd_rows()
    found = transform.rank_from_zero(spark.createDataFrame(rows, ROWS), "k", "rank")
    [plan] = [p for name, p in plans if name == "ranges"]
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    assert "Exchange" not in found._jdf.queryExecution().optimizedPlan().toString() and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    keys = sorted(((r[0] is not None, r[0] or 0) for r in rows))
    last = {k: i for i, k in enumerate(keys)}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((*r, last[r[0] is not None, r[0] or 0])) for r in rows)


def test_ranks_of_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert transform.rank_of_rows(none, "k", "rank").count() == 0 and transform.rank_from_zero(none, "k", "rank").count() == 0


def test_add_gas_particles_reads_written_ranks(spark):
    found = queries.QUERIES["add_gas_particles"](spark, DATA)
    assert not any("lineitem" in f for f in found.inputFiles())
