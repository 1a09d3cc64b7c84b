"""Joins that check themselves, the Bloom filter, backtests, fit comparison and saved models."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from creditloom.config import Settings
from creditloom.operators import attribution, conditional, joins, macro, quality, vintage
from creditloom.sources import tables

S = Settings()


def months(spark, rows, name="v"):
    return spark.createDataFrame(rows, f"k string, {name} int")


def test_checked_joins_fail_where_keys_do(spark):
    left = months(spark, [("a", 1), ("a", 2), ("b", 3)], "x")
    right = months(spark, [("a", 10), ("b", 20), ("c", 30)])
    got = sorted(tuple(r) for r in joins.checked(left, right, ["k"], "test").select("k", "x", "v").collect())
    assert got == [("a", 1, 10), ("a", 2, 10), ("b", 3, 20)]
    assert joins.checked(left, right, ["k"], "test").select("x").count() == 3
    cases = [
        (left, right.unionByName(right.where("k = 'a'")), {}, "in several rows"),
        (left.unionByName(months(spark, [("z", 1)], "x")), right, {}, "no partner"),
        (left.unionByName(months(spark, [(None, 1)], "x")), right, {}, "no partner"),
        (left, right, {"one_to_one": True}, "in several rows"),
        (left, right.unionByName(right.where("k = 'a'")), {"complete": False}, "in several rows"),
        (left, right.unionByName(right.where("k = 'a'")), {"small": True}, "in several rows"),
    ]
    for a, b, how, said in cases:
        # Even where no column of the join is asked for, and where it is joined by broadcast or by shuffle.
        for threshold in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            try:
                with pytest.raises(Exception, match=said):
                    joins.checked(a, b, ["k"], "test", **how).select(F.lit(1)).agg(F.count("*")).collect()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lone = left.unionByName(months(spark, [("z", 1), (None, 4)], "x"))
    assert joins.checked(lone, right, ["k"], "test", complete=False).count() == 3
    assert joins.checked(months(spark, [], "x"), months(spark, []), ["k"], "test").count() == 0


def test_bloom_filter_loses_no_row_and_drops_most_others(spark):
    rows = spark.range(200_000).selectExpr("concat('L', id % 20000) as loan_id", "2000 as vintage_year", "id as month").repartition(4)
    loans = spark.range(20_000).selectExpr("concat('L', id) as loan_id", "1999 as vintage_year")
    sample = quality.hash_sample(loans, "loan_id", 0.01, S)
    kept = joins.semi_reduced(rows, sample, "loan_id")
    want = rows.join(sample.select("loan_id"), "loan_id", "left_semi")
    assert want.exceptAll(kept).isEmpty() and kept.count() < want.count() + 0.002 * 200_000
    a, b = quality.attach_sampled(rows, sample), quality.attach_vintage(rows, sample)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == want.count() > 0
    # A full filter lets more through, but loses nothing.
    crowded = joins.semi_reduced(rows, loans.where("loan_id like '%1'"), "loan_id", max_blocks=1)
    assert rows.where("loan_id like '%1'").exceptAll(crowded).isEmpty()
    assert joins.semi_reduced(rows, sample.limit(0), "loan_id").isEmpty()
    odd = spark.createDataFrame([(None, 1), ("L1", 2)], "loan_id string, m int")
    assert [r.m for r in joins.semi_reduced(odd, odd, "loan_id").collect()] == [2]


def test_what_the_large_side_shuffles_is_what_the_filter_leaves(spark):
    rows = spark.range(300_000).selectExpr("id % 30000 as loan_id", "2000 as vintage_year", "id as month").repartition(4).cache()
    sample = spark.range(0, 30_000, 100).selectExpr("id as loan_id", "1999 as vintage_year")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = quality.attach_sampled(rows, sample)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")  # the filter stands under the join's shuffle
        assert out.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert joins.semi_reduced(rows, sample, "loan_id").count() < 1.2 * 3000


def triangle(spark, rows):
    return spark.createDataFrame(rows, "vintage string, months_on_book int, net_chargeoff_dollars double, balance_active double, original_balance double, max_observed_mob int")


def whole(losses, balance=100.0, last=3):
    return [(v, m, x, balance - 10 * m, balance, last) for v, xs in losses.items() for m, x in enumerate(xs)]


def test_backtest_has_both_methods_and_denominators(spark):
    later = triangle(spark, whole({"2005-Q1": [0.0, 10.0, 5.0, 5.0], "2009-Q1": [0.0, 4.0, 0.0, 4.0], "2012-Q1": [0.0, 0.0, 0.0, 0.0]}))
    early = spark.createDataFrame([("2005-Q1", "Projected", 1, 100.0, 0.1, 0.25, 0.15), ("2009-Q1", "Projected", 1, 100.0, 0.04, 0.04, 0.1), ("2012-Q1", "Projected", 1, 100.0, 0.0, 0.01, 0.0), ("2003-Q1", "Observed", 3, 100.0, 0.2, 0.2, 0.2)], "vintage string, status string, max_observed_mob int, original_balance double, observed_rate double, chain_ladder_ultimate double, scaled_average_ultimate double")
    rows = {r.vintage: r for r in vintage.backtest_comparison(early, later, 3).collect()}
    assert set(rows) == {"2005-Q1", "2009-Q1", "2012-Q1"}
    r = rows["2005-Q1"]
    assert (r.era, r.realised_rate_original_balance, r.realised_rate_average_outstanding) == ("pre-2008", pytest.approx(0.2), pytest.approx(20 / 85))
    assert r.error_chain_ladder == pytest.approx(0.05) and r.error_scaled_average == pytest.approx(-0.05) and r.absolute_percentage_error_scaled_average == pytest.approx(0.25)
    assert rows["2012-Q1"].absolute_percentage_error_chain_ladder is None and rows["2012-Q1"].error_chain_ladder == pytest.approx(0.01)
    found = {(r.era, r.method): r for r in vintage.backtest_metrics(vintage.backtest_comparison(early, later, 3)).collect()}
    assert set(found) == {(e, m) for e in vintage.ERAS for m in vintage.METHODS}
    assert found["overall", "chain_ladder"].cohorts == 3 and found["overall", "chain_ladder"].nonzero_cohorts == 2 and found["overall", "chain_ladder"].mean_error == pytest.approx((0.05 - 0.04 + 0.01) / 3)
    empty = vintage.backtest_metrics(vintage.backtest_comparison(early.where("vintage = '2009-Q1'"), later, 3)).where("era = 'pre-2008'").collect()
    assert len(empty) == 2 and all(r.cohorts == 0 and r.mean_error is None for r in empty)


def test_a_projected_vintage_without_outcome_fails(spark):
    later = triangle(spark, whole({"2005-Q1": [0.0, 10.0, 5.0, 5.0]}) + whole({"2009-Q1": [0.0, 1.0]}, last=1))
    early = lambda *names: spark.createDataFrame([(n, "Projected", 0.1, 0.1) for n in names], "vintage string, status string, chain_ladder_ultimate double, scaled_average_ultimate double")
    assert vintage.backtest_comparison(early("2005-Q1"), later, 3).count() == 1
    with pytest.raises(Exception, match="no partner"):
        vintage.backtest_comparison(early("2005-Q1", "2009-Q1"), later, 3).collect()
    assert vintage.backtest_comparison(early("2005-Q1", "2009-Q1"), later, 3, complete=False).count() == 1
    with pytest.raises(Exception, match="several rows"):
        vintage.backtest_comparison(early("2005-Q1", "2005-Q1"), later, 3).collect()


def test_comparison_has_four_rows_with_provenance(spark):
    fits = spark.createDataFrame([("production", 105.0, 100.0), ("cutoff", 120.0, 100.0), ("chain ladder", 40.0, 100.0)], "fit string, projected double, realised double")
    rows = attribution.comparison(fits, "2018-12-01").orderBy("order").collect()
    assert [r.measure for r in rows] == ["realised", "cutoff", "production", "chain ladder"]
    assert rows[0].loss == 100 and rows[0].error is None and rows[0].absolute_error is None and [r.absolute_error for r in rows[1:]] == [20.0, 5.0, 60.0]
    assert {r.leakage_gap for r in rows} == {15.0} and {r.leakage_points for r in rows} == {15.0}
    assert [r.fit_end for r in rows] == ["none", "2018-12-01", "all months", "2018-12-01"] and len({r.provenance for r in rows}) == 4


def test_realised_losses_want_each_active_loan_once(spark):
    day = "cast(m as date) as as_of_month"
    panel = spark.createDataFrame([("a", "2019-02-01", 50.0, 10.0, 1.0, "ChargeOff"), ("b", "2019-03-01", 30.0, 40.0, 0.0, "ChargeOff"), ("stranger", "2019-03-01", 9.0, 0.0, 0.0, "ChargeOff")], "loan_id string, m string, upb_bom double, net_sales_proceeds double, foreclosure_costs double, exit_reason string").selectExpr("*", day)
    active = spark.createDataFrame([("a", 55.0, 54.0), ("b", 35.0, 33.0), ("c", 1.0, 1.0)], "loan_id string, upb_bom double, upb_eom double")
    row = attribution.realised(panel, active, "2018-12-01").first()
    assert (row.realised_defaults, row.realised_loss) == (2, 41.0)  # the stranger was not active
    with pytest.raises(Exception, match="several rows"):
        attribution.realised(panel, active.unionByName(active.limit(1)), "2018-12-01").collect()
    with pytest.raises(Exception, match="absent from the snapshot"):
        attribution.realised(panel, active.withColumn("upb_eom", F.lit(0.0)).withColumn("upb_bom", F.lit(0.0)), "2018-12-01").collect()


@pytest.fixture(scope="module")
def fitted(spark):
    series = macro.features(spark.createDataFrame([(f"20{9 + i // 12:02d}-{i % 12 + 1:02d}-01", 5.0 + (i * 7 % 11) / 3, (i % 5 - 2) / 10, (i * 3 % 7 - 3) / 50) for i in range(60)], "m string, unemployment_rate double, unemployment_change_3m double, hpi_change_yoy double").select(F.col("m").cast("date").alias("as_of_month"), *macro.VALUES), S.macro_lags).cache()
    rows = [("Current", t, age, band, 20 * k + 3 + (age + i) % 4) for i in range(6, 60) for k, t in enumerate(["Prepaid", "DPD30", "Current"]) for age in (5, 40) for band in ("FICO_660-699", "FICO_740-779")]
    days = [r.as_of_month for r in series.orderBy("as_of_month").collect()]
    counts = spark.createDataFrame([(*r[:4], days[6 + k // 12], r[4]) for k, r in enumerate(rows)], "delinquency_state string, next_delinquency_state string, months_on_book int, score_band string, as_of_month date, transition_count long").cache()
    return counts, series, conditional.fit(counts, series, S)


def test_models_are_saved_and_loaded_bit_for_bit(spark, fitted, tmp_path):
    counts, series, model = fitted
    path = str(tmp_path / "model")
    conditional.save(spark, model, path, fit_end="None", counts="1/2")
    back = conditional.load(spark, path, S, fit_end="None", counts="1/2")
    assert back == model and any(m.weights for m in back.origins.values())
    grid = spark.createDataFrame([(12, "FICO_660-699", 6.1, 0.3), (50, "FICO_740-779", 4.0, -0.1)], "months_on_book int, score_band string, unemployment_rate double, unemployment_change_3m double")
    a, b = (sorted(map(tuple, m.score(grid).collect())) for m in (model, back))
    assert a == b
    assert conditional.load(spark, path, S, fit_end="None", counts="1/3") is None
    assert conditional.load(spark, path, replace(S, c=5.0), fit_end="None", counts="1/2") is None
    assert conditional.load(spark, str(tmp_path / "none"), S) is None
    assert json.loads(spark.read.text(path).first()[0])["provenance"] == {"fit_end": "None", "counts": "1/2"}


def test_fit_wants_each_month_of_the_counts_once(spark, fitted):
    counts, series, _ = fitted
    with pytest.raises(Exception, match="several rows"):
        conditional.fit(counts, series.unionByName(series.limit(1)), S)
    with pytest.raises(Exception, match="no partner"):
        conditional.fit(counts, series.where("as_of_month <> date'2012-05-01'"), S)


def test_stage_figures_have_shuffle_bytes(spark):
    before = tables.stage_summary(spark)
    spark.range(100_000).selectExpr("id % 1000 as k", "id").repartition(4, "k").groupBy("k").count().collect()
    after = tables.stage_summary(spark)
    assert after["shuffle_write_bytes"] > before["shuffle_write_bytes"] and after["shuffle_read_bytes"] > before["shuffle_read_bytes"] and after["stages"] > before["stages"] and after["tasks"] > before["tasks"]
