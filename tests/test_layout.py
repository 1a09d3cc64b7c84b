"""Co-located tables and exact quantiles over many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import monitoring, panel, quantiles
from creditloom.plans import lens as L
from creditloom.sources import layout

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lens(spark):
    return L.Lens(spark, DATA)


@pytest.fixture(scope="module")
def tables(lens):
    return lens.colocated(4)


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def depth(line):
    return len(line) - len(line.lstrip(" :+-*()0123456789"))


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_windows_and_join_need_no_shuffle_and_no_sort(spark, lens, tables, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = explained(panel.build(*tables, lens.macro_features(), lens.settings))
        usual = explained(panel.build(lens.acquisition(), lens.performance(), lens.macro_features(), lens.settings))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Macro months apart, a row a month, whatever stands under them.
    loans = [x for x in plan if "loan_id" in x]
    assert sum("Window" in x for x in loans) >= 2 and not any("Exchange hashpartitioning" in x or "Sort [" in x for x in loans)
    assert any("Bucketed: true" in x or "SelectedBucketsCount" in x for x in plan)
    assert any("SortMergeJoin [loan_id" in x for x in plan) == (threshold == "-1")
    assert any("Exchange hashpartitioning" in x and ("loan_id" in x or "l_orderkey" in x) for x in usual)


def test_rows_are_those_of_the_usual_panel(lens, tables):
    built = panel.public(panel.build(*tables, lens.macro_features(), lens.settings))
    assert built.exceptAll(lens.panel()).isEmpty() and lens.panel().exceptAll(built).isEmpty()


def test_one_sorted_file_a_bucket(spark, tables, tmp_path):
    df = spark.range(5000).selectExpr("id % 700 as loan_id", "date_add(date'2010-01-01', cast(id as int)) as as_of_month").repartition(7)
    layout.write(df, "one_file", str(tmp_path / "t"), "loan_id", ["as_of_month"], 8)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 8
    for path in (tmp_path / "t").glob("*.parquet"):
        rows = [tuple(r) for r in spark.read.parquet(str(path)).collect()]
        assert rows == sorted(rows)
    again = layout.register(spark, "one_file_again", str(tmp_path / "t"), "loan_id", ["as_of_month"], 8)
    assert again.exceptAll(df).isEmpty() and again.count() == 5000
    counted = again.groupBy("loan_id").agg(F.max("as_of_month"))
    assert not any("Exchange hashpartitioning" in x for x in explained(counted))


def test_buckets_grow_with_the_table():
    assert [layout.buckets_for(n) for n in (0, 1, 256 << 20, (256 << 20) + 1, 3 << 30)] == [1, 1, 1, 2, 16]
    assert layout.buckets_for(1 << 60) <= layout.MAX_BUCKETS


def by_hand(pairs, qs):
    """Middle positions of cumulative weight, interpolated and clamped."""
    sums = {}
    for v, w in pairs:
        if v is not None and w is not None and w > 0:
            sums[v] = sums.get(v, 0) + w
    values = sorted(sums)
    weights = np.array([sums[v] for v in values], float)
    at = (np.cumsum(weights) - weights / 2) / weights.sum()
    return [float(np.interp(q, at, values)) for q in qs]


QS = [0.0, 0.001, 0.1, 0.5, 0.9, 0.9999, 1.0]


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(4)
    groups = {
        "many": [(rng.gauss(0, 1000), rng.randint(0, 9)) for _ in range(20_000)], "few": [(float(rng.randrange(3)), rng.randint(1, 5)) for _ in range(500)], "one": [(7.0, 2), (7.0, 3)], None: [(1.0, 1), (2.0, 3)],
        "heavy": [(float(i), 1) for i in range(2000)] + [(1000.5, 10**6)], "ends": [(float(i), 10**6 if i in (0, 1999) else 1) for i in range(2000)], "odd": [(None, 3), (5.0, None), (6.0, 0), (8.0, -1), (9.0, 4), (-0.0, 1), (0.0, 1)],
    }
    rows = [(g, v, w) for g, pairs in groups.items() for v, w in pairs] + [("odd", float("nan"), 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w bigint").withColumn("w", F.col("w").cast(kind)).repartition(5)
    got = {(r.g, r.q): r.value for r in quantiles.spread_quantiles(df, "g", "v", "w", QS).collect()}
    want = {(g, q): x for g, pairs in groups.items() for q, x in zip(QS, by_hand(pairs, QS), strict=True)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    old = {(r.g, r.q): r.value for r in monitoring.weighted_quantiles(df.where("not isnan(v) and g is not null"), "g", "v", "w", QS).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in old.items())


def test_one_group_is_dealt_over_many_tasks_and_few_of_its_values_are_sorted(spark):
    df = spark.range(300_000).selectExpr("'all' as g", "cast(hash(id) as double) as v", "1 + id % 7 as w")
    sums = quantiles.value_weights(df, "g", "v", "w").cache()
    values = quantiles.placed(sums, quantiles.borders(sums)).cache()
    found = quantiles.cells(values)
    sizes = [r["count"] for r in values.groupBy("cell").count().collect()]
    assert len(sizes) == quantiles.CELLS and max(sizes) < 2 * sum(sizes) / len(sizes)
    chosen = quantiles.wanted(found, [0.5])
    assert chosen.count() <= 4
    near = quantiles.points(values, chosen)
    assert near.count() < 0.03 * sums.count()
    keys = [x for x in explained(near) if "Exchange hashpartitioning" in x]
    assert any("g#" in x and "cell#" in x for x in keys) or not keys
    v, w = np.array(sums.select("v", F.col("w").cast("double")).collect()).T
    order = np.argsort(v)
    assert quantiles.spread_quantiles(df, "g", "v", "w", [0.5]).first().value == pytest.approx(float(np.interp(0.5, (np.cumsum(w[order]) - w[order] / 2) / w.sum(), v[order])), abs=1e-6)


def test_cells_count_the_borders_below(spark):
    rng = random.Random(1)
    edges = sorted(rng.randrange(100) for _ in range(quantiles.CELLS - 1))
    df = spark.createDataFrame([(float(v), [float(x) for x in edges]) for v in range(-1, 102)], "v double, b array<double>")
    assert all(r.cell == sum(x < r.v for x in r.b) for r in df.withColumn("cell", quantiles._cell("v", "b")).collect())


def test_no_rows_have_no_quantiles(spark):
    assert quantiles.spread_quantiles(spark.createDataFrame([], "g string, v double, w bigint"), "g", "v", "w", QS).count() == 0
