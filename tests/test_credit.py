"""Known answers and invariants of the credit operators."""

import dataclasses
import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom import cli
from creditloom.config import ConfigError, Settings, load_settings
from creditloom.functions import columns as C
from creditloom.functions import spline
from creditloom.operators import attribution, ecl, forecast, lgd, macro, monitoring, panel, scenarios, transitions, vintage

S = Settings()
TOY = ("Current", "ChargeOff", "Prepaid", "Repurchased")


def month(y, m):
    return dt.date(y, m, 1)


def macro_rows(spark, n=24):
    return macro.features(spark.createDataFrame([(month(2009 + i // 12, i % 12 + 1), 5.0 + i / 10, 0.1, 0.02) for i in range(n)], "as_of_month date, unemployment_rate double, unemployment_change_3m double, hpi_change_yoy double"), S.macro_lags)


LOANS = "loan_id string, origination_month date, orig_score int, orig_ltv double, property_state string, vintage_year int"
MONTHS = "loan_id string, as_of_month date, current_upb double, delinquency_status int, loan_age int, zero_balance_code string, disposition_date date, net_sales_proceeds double, foreclosure_costs double"


def one_panel(spark, rows, loans=("a",)):
    acq = spark.createDataFrame([(x, month(2010, 1), 700, 80.0, "TX", 2010) for x in loans], LOANS)
    return panel.build(acq, spark.createDataFrame(rows, MONTHS), macro_rows(spark), S)


@pytest.mark.parametrize("code", sorted(S.codes))
def test_each_code_has_its_exit(spark, code):
    rows = [("a", month(2010, 1), 100.0, 0, 0, None, None, None, None), ("a", month(2010, 2), 90.0, 0, 1, f" {code} ", None, None, None)]
    built = one_panel(spark, rows)
    first, last = built.orderBy("as_of_month").collect()
    assert last.exit_reason == last.delinquency_state == S.codes[code] and last.upb_eom == 0 and last.next_delinquency_state is None and last.previous_delinquency_state == "Current"
    assert first.next_delinquency_state == S.codes[code] and first.upb_eom == 90.0 and not first.is_censored
    panel.enforce(built, S)


def test_panel_contracts(spark):
    ok = [("a", month(2010, i + 1), 100.0 - i, 30 * i, i, None, None, None, None) for i in range(3)]
    built = one_panel(spark, ok)
    rows = built.orderBy("as_of_month").collect()
    assert [r.is_censored for r in rows] == [False, False, True] and rows[-1].upb_eom is None and rows[0].mob_band == "MOB_000-011" and rows[0].score_band == "FICO_700-739"
    panel.enforce(built, S)
    assert transitions.observed(panel.public(built)).count() == 2
    for bad, name in (
        ([*ok, ("a", month(2010, 4), 1.0, 0, 3, "99", None, None, None)], "unknown_code_rows"),
        ([ok[0], ok[2]], "gap_rows"),
        ([*ok, ok[1]], "duplicate_rows"),
        ([ok[0], ("a", month(2010, 2), 99.0, 180, 1, None, None, None, None), ok[2]], "terminal_not_last_rows"),
        ([("a", month(2010, 1), 1.0, 0, 7, None, None, None, None)], "vendor_mob_mismatch_rows"),
    ):
        with pytest.raises(panel.PanelError, match=name):
            panel.enforce(one_panel(spark, bad), S)


def test_exits_are_zero_filled_and_bands_are_half_open(spark):
    built = one_panel(spark, [("a", month(2010, 1), 1.0, 0, 0, "01", None, None, None)])
    assert {r.exit_reason: r.loans for r in panel.exit_counts(built, S).collect()} == {"Prepaid": 1, "ChargeOff": 0, "Repurchased": 0, "Censored": 0}
    row = spark.range(1).select(*[C.band(F.lit(x), S.score_edges, "B_").alias(f"x{x}") for x in (-1, 0, 619, 620, 850, 851)]).first()
    assert list(row) == [None, "B_000-619", "B_000-619", "B_620-659", "B_780-850", None]


def test_macro_gates(spark):
    macro.enforce(macro_rows(spark))
    with pytest.raises(macro.MacroError):
        macro.enforce(macro_rows(spark).where(F.col("as_of_month") != F.lit(month(2009, 5))))
    with pytest.raises(macro.MacroError):
        macro.enforce(macro_rows(spark).unionByName(macro_rows(spark).limit(1)))
    assert macro_rows(spark).orderBy("as_of_month").collect()[6].unemployment_rate_lag_6 == 5.0


def test_matrix_rows_add_up_and_unseen_origins_stay(spark):
    counts = spark.createDataFrame([("Current", "Current", 8), ("Current", "DPD30", 2), ("DPD30", "Current", 1), ("DPD30", "DPD60", 3)], "delinquency_state string, next_delinquency_state string, transition_count long")
    table = transitions.matrix(counts, S)
    transitions.enforce(table, S)
    p = {(r.origin, r.destination): r.probability for r in table.collect()}
    assert len(p) == 81 and p["Current", "DPD30"] == 0.2 and p["DPD90", "DPD90"] == 1 and p["ChargeOff", "ChargeOff"] == 1
    with pytest.raises(transitions.TransitionError):
        transitions.enforce(table.withColumn("probability", F.col("probability") * 0.9), S)
    with pytest.raises(transitions.TransitionError):
        transitions.fit_sample(counts.withColumn("as_of_month", F.lit(month(2010, 1))), "2000-01-01")


def tri(spark):
    losses = {"2006-01": [0, 10, 5, 5], "2007-01": [0, 5, 5, 10], "2018-01": [0, 0]}
    rows = [(v, m, float(x), 100.0, 100.0, len(xs) - 1) for v, xs in losses.items() for m, x in enumerate(xs)]
    return spark.createDataFrame(rows, "vintage string, months_on_book int, net_chargeoff_dollars double, balance_active double, original_balance double, max_observed_mob int")


def test_vintage_known_answers(spark):
    table = vintage.curves(tri(spark), 3)
    vintage.enforce_no_gaps(table)
    cells = {(r.vintage, r.months_on_book): r.cumulative_loss_rate for r in table.collect()}
    assert cells["2006-01", 3] == pytest.approx(0.2) and cells["2018-01", 2] is None
    factors = {r.months_on_book: r.factor for r in vintage.development(table, 3).collect()}
    assert factors == {0: None, 1: pytest.approx(25 / 15), 2: pytest.approx(40 / 25)}
    out = {r.vintage: r for r in vintage.ultimates(vintage.project(table, 3), 3).collect()}
    assert out["2006-01"].status == "Observed" and out["2018-01"].status == "Projected" and out["2018-01"].chain_ladder_ultimate == 0 == out["2018-01"].scaled_average_ultimate
    with pytest.raises(vintage.VintageError):
        vintage.enforce_no_gaps(vintage.curves(tri(spark).where("not (vintage = '2006-01' and months_on_book = 1)"), 3))


def test_lgd_fit_is_exact_and_falls_back(spark):
    hpi = np.linspace(-0.2, 0.2, 25)
    rows = [("FICO_700-739", float(h), 100.0 + i, (0.7 + 0.5 * float(h)) * (100.0 + i), 0.0, "ChargeOff", "2006-01") for i, h in enumerate(hpi)]
    rows += [("FICO_620-659", 0.1, 100.0, 50.0, 0.0, "ChargeOff", "2006-01")] * 3
    df = lgd.observations(spark.createDataFrame(rows, "score_band string, hpi_change_yoy double, upb_bom double, net_sales_proceeds double, foreclosure_costs double, exit_reason string, vintage string"))
    model = {r.score_band: r for r in lgd.fit(df).collect()}
    assert model["FICO_700-739"].intercept == pytest.approx(0.7, abs=1e-9) and model["FICO_700-739"].slope == pytest.approx(0.5, abs=1e-9)
    assert model["FICO_620-659"].is_fallback and model["FICO_620-659"].intercept == pytest.approx(0.55)
    asked = spark.createDataFrame([("FICO_700-739", 0.0), ("FICO_620-659", 0.0), ("none", 0.0)], "score_band string, hpi_change_yoy double")
    assert {r.score_band: round(r.lgd, 9) for r in lgd.predict(asked, lgd.fit(df), S).collect()} == {"FICO_700-739": 0.3, "FICO_620-659": 0.45, "none": 0.45}


def toy(spark, default, prepay, repurchase=0.0):
    rows = [(f"L{i}", 1, "Current", d, p) for i in (1, 2, 3) for d, p in zip(TOY, (1 - default - prepay - repurchase, default, prepay, repurchase), strict=True)]
    rows += [(f"L{i}", 1, x, x, 1.0) for i in (1, 2, 3) for x in TOY[1:]]
    return spark.createDataFrame(rows, "segment_id string, step int, origin string, destination string, p double")


def toy_segments(spark):
    return spark.createDataFrame([(f"L{i}", 100.0 * i, 0.0, 4, {"Current": 1.0}) for i in (1, 2, 3)], "segment_id string, balance double, annual_interest_rate double, remaining_term_months int, initial_state map<string,double>")


def toy_ecl(spark, default, prepay):
    segs = toy_segments(spark)
    path = forecast.forecast(segs, toy(spark, default, prepay), TOY, 4)
    forecast.enforce(path)
    return ecl.lifetime(segs, forecast.marginal_default(path, segs), segs.select("segment_id", F.lit(0.5).alias("lgd")), 4, 0.0)


def test_three_loans_by_hand(spark):
    detail = toy_ecl(spark, 0.10, 0.20)
    assert detail.agg(F.sum("ecl")).first()[0] == pytest.approx(55.6725)
    assert toy_ecl(spark, 0.10, 0.40).agg(F.sum("ecl")).first()[0] < 55.6725
    assert toy_ecl(spark, 0.0, 0.2).agg(F.sum("ecl")).first()[0] == 0
    row = ecl.decompose(detail).first()
    assert row.balance == 600 and row.lgd == pytest.approx(0.5) and row.balance * row.pd * row.ead_share * row.lgd == pytest.approx(row.ecl)
    assert ecl.monthly(detail).orderBy("month").collect()[-1].cumulative_ecl == pytest.approx(55.6725)


def test_forecast_weights_and_steps(spark):
    segs = toy_segments(spark)
    path = forecast.forecast(segs, toy(spark, 0.1, 0.2, 0.01), TOY, 6)
    total = {r.month: r for r in forecast.portfolio(path, segs).groupBy("month").agg(F.sum("p").alias("m"), F.max("balance").alias("b")).collect()}
    assert len(total) == 6 and all(r.m == pytest.approx(1) and r.b == 600 for r in total.values())
    v = np.array([1, 0, 0, 0.0])
    for step in ((0.69, 0.1, 0.2, 0.01),) * 6:
        v = np.array([v[0] * step[0], v[1] + v[0] * step[1], v[2] + v[0] * step[2], v[3] + v[0] * step[3]])
    assert {r.state: r.p for r in path.where("month = 6 and segment_id = 'L2'").collect()} == {s: pytest.approx(x) for s, x in zip(TOY, v, strict=True)}
    forecast.enforce_initial(segs, TOY)
    with pytest.raises(forecast.ForecastError):
        forecast.enforce_initial(segs.withColumn("initial_state", F.create_map(F.lit("Current"), F.lit(0.9))), TOY)


def test_amortization_equals_the_loop(spark):
    segs = spark.createDataFrame([("a", 1000.0, 0.06, 5), ("b", 900.0, 0.0, 3)], "segment_id string, balance double, annual_interest_rate double, remaining_term_months int")
    got = {(r.segment_id, r.month): r.exposure for r in ecl.amortization(segs, 7).collect()}
    left, pay = 1000.0, 1000 * 0.005 / (1 - 1.005**-5)
    for k in range(1, 8):
        assert got["a", k] == pytest.approx(max(left, 0) if k <= 5 else 0)
        left -= pay - left * 0.005
    assert [got["b", k] for k in range(1, 8)] == pytest.approx([900, 600, 300, 0, 0, 0, 0])


def test_error_shares_by_hand(spark):
    rows = [("A", month(2018, 12), 100.0, 100.0, 0.0, 0.0, None), ("B", month(2018, 12), 100.0, 100.0, 0.0, 0.0, None), ("A", month(2020, 1), 80.0, 0.0, 40.0, 0.0, "ChargeOff")]
    df = spark.createDataFrame(rows, "loan_id string, as_of_month date, upb_bom double, upb_eom double, net_sales_proceeds double, foreclosure_costs double, exit_reason string")
    active = ecl.active_at(df, "2018-12-01", S)
    assert active.count() == 2
    projected = spark.createDataFrame([(2020, 100.0, 90.0, 45.0)], "year int, marginal_pd_dollars double, expected_default_exposure double, undiscounted_loss double")
    out = attribution.validate(projected, attribution.realised(df, active, "2018-12-01"), 200.0)
    attribution.enforce(out)
    total = out.where("year = 'Total'").first()
    assert (total.projected_loss, total.realised_loss, total.error) == (45.0, 40.0, 5.0)
    assert (total.pd_error, total.ead_error, total.lgd_error) == (pytest.approx(0), pytest.approx(5), pytest.approx(0))


def test_shapley_is_the_mean_over_orders(spark):
    from itertools import permutations

    a, b = (0.02, 0.7, 0.4), (0.05, 0.8, 0.3)
    want = np.zeros(3)
    for order in permutations(range(3)):
        at = list(a)
        for k in order:
            before = np.prod(at)
            at[k] = b[k]
            want[k] += (np.prod(at) - before) * 1000 / 6
    row = spark.range(1).select(*attribution.shapley(F.lit(1000.0), *map(F.lit, a), *map(F.lit, b))).first()
    assert list(row) == pytest.approx(want.tolist())


def test_reports_by_hand(spark):
    steps = spark.createDataFrame([(1, "start", 93.0), (2, "a", 14.0), (3, "b", 14.0), (4, "c", 95.0), (5, "end", 83.0)], "order int, step string, level double")
    assert [r.amount for r in attribution.bridge(steps).orderBy("order").collect()] == [93, -79, 0, 81, -12]
    fits = spark.createDataFrame([("cutoff", 90.0, 70.0), ("production", 72.0, 70.0)], "fit string, projected double, realised double")
    row = attribution.compare(fits).where("fit = 'cutoff'").first()
    assert row.leakage_gap == 18.0 and row.leakage_points == pytest.approx(25.7142857)


SNAPSHOT = "loan_id string, as_of_month date, score_band string, vintage_year int, delinquency_state string, months_on_book int, upb_bom double, upb_eom double, exit_reason string"
TERMS = "loan_id string, orig_interest_rate double, original_term int"


def test_active_loans_are_those_seen_in_the_cutoff_month(spark):
    now, before, after = month(2018, 12), month(2018, 11), month(2019, 1)
    rows = [("a", before, None), ("a", now, None), ("a", after, "ChargeOff"), ("censored", now, "Censored"), ("gone before", before, "Censored"), ("paid", now, "Prepaid"), ("off", now, "ChargeOff"), ("back", now, "Repurchased"), ("new", after, None)]
    df = spark.createDataFrame(rows, "loan_id string, as_of_month date, exit_reason string")
    assert [r.loan_id for r in ecl.active_at(df, "2018-12-01", S).collect()] == ["a"]
    assert sorted(str(r.as_of_month) for r in ecl.active_panel(df, "2018-12-01", S).collect()) == ["2018-11-01", "2018-12-01", "2019-01-01"]


def test_segments_average_by_balance_and_round_to_even(spark):
    rows = [("a", month(2018, 12), "x", 2018, "Current", 2, 100.0, None, None), ("b", month(2018, 12), "x", 2018, "DPD30", 3, 120.0, 100.0, None), ("old", month(2018, 12), "y", 2000, "Current", 200, 10.0, 9.0, None), ("zero", month(2018, 12), "x", 2018, "Current", 9, 5.0, 0.0, None)]
    terms = spark.createDataFrame([("a", 0.04, 360), ("b", 0.06, 360), ("old", 0.1, 180), ("other", 0.1, 9)], TERMS)
    active = ecl.active_at(spark.createDataFrame(rows, SNAPSHOT), "2018-12-01", S)
    segs = ecl.segments(active, terms)
    row = segs.where("score_band = 'x'").first()
    assert (row.segment_id, row.balance, row.loans, row.start_mob, row.remaining_term_months) == ("x|2018", 200.0, 2, 2, 358)
    assert row.annual_interest_rate == pytest.approx(0.05) and row.initial_state == {"Current": 0.5, "DPD30": 0.5}
    assert segs.where("score_band = 'y'").first().remaining_term_months == 1  # beyond its term, a month is left
    ecl.enforce_balance(segs, active)
    with pytest.raises(ecl.EclError):
        ecl.enforce_balance(segs.where("score_band = 'x'"), active)


@pytest.mark.parametrize(
    ("row", "terms"),
    [
        (("a", "x", 100.0, None), [("b", 0.04, 360)]),  # no terms
        (("a", "x", 100.0, None), [("a", None, 360)]),  # half the terms
        (("a", "x", 100.0, None), [("a", 0.04, 360), ("a", 0.05, 360)]),  # two rows of terms
        (("a", "x", None, None), [("a", 0.04, 360)]),  # no balance
        (("a", None, 100.0, None), [("a", 0.04, 360)]),  # no band
    ],
)
def test_segments_fail_fast(spark, row, terms):
    loan, band, bom, eom = row
    active = spark.createDataFrame([(loan, month(2018, 12), band, 2018, "Current", 2, bom, eom, None)], SNAPSHOT)
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        ecl.segments(active, spark.createDataFrame(terms, TERMS)).collect()


def test_a_default_outside_the_snapshot_fails(spark):
    cols = "loan_id string, as_of_month date, upb_bom double, upb_eom double, net_sales_proceeds double, foreclosure_costs double, exit_reason string"
    df = spark.createDataFrame([("A", month(2018, 12), 5.0, 0.0, None, None, None), ("A", month(2019, 2), 80.0, 0.0, 40.0, 0.0, "ChargeOff")], cols)
    active = ecl.active_at(df, "2018-12-01", S)
    with pytest.raises(Exception, match="absent from the snapshot"):
        attribution.realised(df, active, "2018-12-01").collect()
    assert attribution.realised(df, active, "2018-12-01", "2019-01-01").count() == 0  # beyond the forecast


def test_bridge_from_the_chain_ladder(spark):
    ladder = spark.createDataFrame([("v", 0.10, 0.04, 1000.0)], "vintage string, chain_ladder_ultimate double, observed_rate double, original_balance double")
    detail = spark.createDataFrame([(80.0, 70.0), (20.0, 15.0)], "undiscounted_loss double, ecl double")
    rows = attribution.reconciliation(ladder, detail, 500.0).orderBy("order").collect()
    assert [r.step for r in rows] == list(attribution.BRIDGE)
    assert [r.amount for r in rows] == pytest.approx([100, -40, 0, 40, -15]) and [r.level for r in rows] == pytest.approx([100, 60, 60, 100, 85])
    assert rows[0].loss_rate == pytest.approx(0.1) and rows[4].loss_rate == pytest.approx(85 / 500)


def test_vintage_gates(spark):
    young = spark.createDataFrame([("2018-Q1", 3)], "vintage string, max_observed_mob int")
    with pytest.raises(vintage.VintageError):
        vintage.enforce_seasoned(young, 4)
    parts = spark.createDataFrame([("v", 0.5, 1.0, 0.5, 0.25)], "vintage string, frequency double, exposure double, severity double, loss_rate double")
    vintage.enforce_decomposition(parts)
    with pytest.raises(vintage.VintageError):
        vintage.enforce_decomposition(parts.withColumn("loss_rate", F.lit(0.3)))
    table = lambda a, b: spark.createDataFrame([("2007-Q1", a), ("2012-Q1", b)], "vintage string, chain_ladder_ultimate double")
    vintage.enforce_crisis_order(table(0.2, 0.1))
    for bad in (table(0.1, 0.2), table(0.1, 0.1), table(0.1, 0.2).limit(1)):
        with pytest.raises(vintage.VintageError):
            vintage.enforce_crisis_order(bad)


def scenario_table(spark):
    label = lambda q: f"{2018 + q // 4}Q{q % 4 + 1}"
    rows = [(2019, "historical", label(q), 4.0, 200.0 + q, "") for q in range(4)]
    rows += [(2019, name, label(4 + q), 4.0 + tilt * min(q, 6), 204.0 - tilt * 5 * q, "") for name, tilt in (("baseline", 0.0), ("severe", 1.0)) for q in range(13)]
    return spark.createDataFrame(rows, "vintage_year int, scenario string, quarter string, unemployment_rate double, house_price_index double, source_url string")


def test_scenarios(spark):
    monthly = scenarios.quarterly_to_monthly(scenarios.published(scenario_table(spark), 2019, 13))
    assert {r["count"] for r in monthly.groupBy("scenario").count().collect()} == {39}
    first = monthly.where("scenario = 'severe'").orderBy("as_of_month").first()
    assert first.as_of_month == month(2019, 1) and first.hpi_change_yoy == pytest.approx(204 / 200 - 1)
    history = spark.createDataFrame([(month(2018, m), 4.0, 0.0, 0.03) for m in range(1, 13)], "as_of_month date, unemployment_rate double, unemployment_change_3m double, hpi_change_yoy double")
    table = scenarios.paths(scenarios.extend(monthly, 120, S), history, S)
    assert table.count() == 240
    scenarios.enforce(table, S)
    rows = table.where("scenario = 'severe'").orderBy("as_of_month").collect()
    gap = [r.unemployment_rate - S.long_run_unemployment for r in rows]
    assert gap[38 + 24] == pytest.approx(gap[38] / 2) and rows[3].unemployment_rate_lag_3 == rows[0].unemployment_rate
    seen = {r.scenario: r for r in scenarios.extrapolation(table, S).collect()}
    assert seen["baseline"].share_above_cutoff_support == 0 and seen["severe"].peak_unemployment == 10 and seen["severe"].published_months == 39
    assert seen["severe"].share_above_cutoff_support == pytest.approx(27 / 39) and seen["severe"].share_above_history_support == pytest.approx(21 / 39)
    with pytest.raises(scenarios.ScenarioError):
        scenarios.published(scenario_table(spark).where("quarter <> '2020Q1'"), 2019, 13)
    with pytest.raises(scenarios.ScenarioError):
        scenarios.enforce(scenarios.paths(scenarios.extend(monthly, 120, S), history.where("as_of_month > date '2018-10-01'"), S), S)


def test_flows_and_summary(spark):
    segs = toy_segments(spark)
    m = toy(spark, 0.1, 0.2).drop("step").select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"))
    path = forecast.forecast(segs, m, TOY, 3)
    flow = {(r.origin, r.destination): r.dollars for r in scenarios.flows(path, m, segs).collect()}
    assert flow["Current", "ChargeOff"] == pytest.approx(600 * 0.1 * (1 + 0.7 + 0.49))
    top = scenarios.flow_attribution(scenarios.flows(path, m, segs), scenarios.flows(path, m, segs), 2).collect()
    assert len(top) == 2 and all(r.dollars == 0 for r in top)


def test_monitoring(spark):
    a = spark.createDataFrame([("x",)] * 8 + [("y",)] * 2, "b string")
    rows = monitoring.stability(a, a, "b").collect()
    assert sum(r.psi for r in rows) == 0
    b = spark.createDataFrame([("x",)] * 5 + [("y",)] * 5, "b string")
    psi = sum(r.psi for r in monitoring.stability(a, b, "b").collect())
    assert psi == pytest.approx((0.5 - 0.8) * np.log(0.5 / 0.8) + (0.5 - 0.2) * np.log(0.5 / 0.2))
    assert spark.range(1).select(monitoring.verdict(F.lit(psi)), monitoring.verdict(F.lit(0.1)), monitoring.verdict(F.lit(0.0))).first()[:] == ("red", "amber", "green")
    v, w = np.array([3.0, 1, 2, 2, 9]), np.array([1.0, 2, 1, 3, 4])
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(v, w, strict=True)], "g string, v double, w double")
    got = {r.q: r.value for r in monitoring.weighted_quantiles(df, "g", "v", "w", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    vals, weights = np.array([1.0, 2, 3, 9]), np.array([2.0, 4, 1, 4])
    at = (np.cumsum(weights) - weights / 2) / weights.sum()
    assert got == {q: pytest.approx(float(np.interp(q, at, vals))) for q in got} and len(got) == 5


def test_spline_is_cardinal_and_linear():
    knots = np.array([0, 12, 24, 36, 60, 119.0])
    assert np.allclose(spline.basis(knots, knots), np.eye(6))
    x = np.arange(-5, 130, dtype=float)
    b = spline.basis(x, knots)
    assert np.allclose(b.sum(1), 1) and np.allclose(b @ knots, x)
    bend = np.diff(spline.basis(np.linspace(0, 119, 2000), knots), 2, axis=0)
    assert np.abs(bend[0]).max() < 1e-6 and np.abs(np.diff(spline.basis(np.linspace(119, 140, 50), knots), 2, axis=0)).max() < 1e-9


def test_settings(tmp_path, monkeypatch, capsys):
    (tmp_path / "base.yaml").write_text("seed: 3\nsample_fraction: 0.5\n")
    (tmp_path / "big.yaml").write_text("data_root: ${ROOT_OF_DATA}/x\nsample_fraction: 1.0\n")
    monkeypatch.setenv("ROOT_OF_DATA", "/data")
    s = load_settings("big", tmp_path)
    assert (s.seed, s.data_root, s.sample_fraction) == (3, "/data/x", 1.0) and s.states == S.states
    for bad in ({"sample_fraction": 0.0}, {"first_vintage": 2020}, {"cohort_grain": "weekly"}, {"codes": {"01": "Gone"}}, {"no_such": 1}, {"data_root": "${NOT_SET_ANYWHERE}"}):
        with pytest.raises(ConfigError):
            load_settings("local", None, **bad)
    (tmp_path / "base.yaml").write_text("seed: 3\nmodel:\n  cutoff: '2017-01-01'\n  macro_lags: [1, 2]\nsynthetic: {loans: 7}\n")
    (tmp_path / "nested.yaml").write_text("model: {discount_rate: 0.1}\n")
    s = load_settings("nested", tmp_path)
    assert (s.cutoff, s.macro_lags, s.loans, s.discount_rate) == ("2017-01-01", (1, 2), 7, 0.1) and s.section("synthetic")["loans"] == 7
    (tmp_path / "nested.yaml").write_text("ingest: {discount_rate: 0.1}\n")
    with pytest.raises(ConfigError):
        load_settings("nested", tmp_path)
    for bad in ("model: {discount_rate: high}", "model: {maturity_mob: 12.5}", "ingest: {header: 1}", "model: {macro_lags: [1, two]}", "model: {macro_lags: 3}", "states: {codes: {'01': 7}}", "model: {fit_end: [1]}", "synthetic: {loans: true}"):
        (tmp_path / "nested.yaml").write_text(bad)
        with pytest.raises(ConfigError, match="must be of type"):
            load_settings("nested", tmp_path)
    (tmp_path / "nested.yaml").write_text("model: {discount_rate: 1, fit_end: null}\nstates: {codes: {'01': Prepaid}}\n")
    s = load_settings("nested", tmp_path)
    assert s.discount_rate == 1 and s.codes == {"01": "Prepaid"}
    every = s.nested()
    assert {k for part in every.values() for k in part} == {f.name for f in dataclasses.fields(Settings)} and every["model"]["discount_rate"] == 1
    shipped = Path(__file__).resolve().parents[1] / "conf"
    assert load_settings("local", shipped).maturity_mob == 119
    assert cli.main(["config", "--data-root", "/d"]) == 0 and '"data_root": "/d"' in capsys.readouterr().out
