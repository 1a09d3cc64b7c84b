"""The sums that forecasts start from: as the operators have it on the panel's rows, and bounded whatever the loans."""

import contextlib
import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditloom.operators import attribution, ecl, facts, lgd, transitions, vintage
from creditloom.plans import credit
from creditloom.plans import lens as L

SF = "/root/testdata/sf0.001"


class Copies(L.Lens):
    """The tables so many times over under other keys, with the same scores and loan-to-value ratios."""

    def __init__(self, spark, n):
        super().__init__(spark, SF)
        self.n = n

    def table(self, name):
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}[name]
        return super().table(name).crossJoin(self.spark.range(self.n).withColumnRenamed("id", "k")).withColumn(key, F.col(key) + F.col("k") * 551 * 41 * 1000).drop("k")


def rows(df):
    return sorted((tuple(sorted((k, round(v, 6)) for k, v in x.items()) if isinstance(x, dict) else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_sums_give_what_the_operators_give_on_the_rows(spark):
    x = L.Lens(spark, SF)
    s, panel = x.settings, x.panel()
    early = panel.where(F.col("as_of_month") <= F.lit(L.CUTOFF).cast("date"))
    active = ecl.active_at(panel, L.CUTOFF, s)
    tri = vintage.triangle(panel, x.acquisition(), "quarterly", L.CUTOFF)
    want = {
        "segs": ecl.segments(active, x.acquisition()), "matrix": transitions.matrix(transitions.cube(panel), s), "early_matrix": transitions.matrix(transitions.cube(early), s),
        "hazards": transitions.hazards(transitions.cube(panel), s), "coefs": lgd.fit(lgd.observations(panel), fallback_lgd=s.fallback_lgd), "early_coefs": lgd.fit(lgd.observations(early), fallback_lgd=s.fallback_lgd),
        "found": attribution.realised(panel, active, L.CUTOFF, credit.UNTIL), "ultimates": vintage.ultimates(vintage.project(vintage.curves(tri, L.MATURITY), L.MATURITY), L.MATURITY),
    }
    parts = credit.Parts(x, *want)
    for name, table in want.items():
        got = parts.tables[name]
        assert got.columns == table.columns and [k for _, k in got.dtypes] == [k for _, k in table.dtypes], name
        assert rows(got) == [tuple(pytest.approx(v, rel=1e-9, abs=1e-6) if isinstance(v, float) else v for v in r) for r in rows(table)], name
    assert parts.segs.count() and parts.found.count() and parts.ultimates.count()


def test_what_is_kept_does_not_grow_with_the_loans(spark, monkeypatch):
    seen, kept = [], L.kept

    @contextlib.contextmanager
    def counted(df):
        with kept(df) as held:
            seen.append(held.count())
            yield held

    monkeypatch.setattr(L, "kept", counted)
    balance = [credit.Parts(Copies(spark, n), "segs", "found").segs.agg(F.sum("balance")).first()[0] for n in (1, 3)]
    assert len(seen) == 2 and seen[0] == seen[1]
    assert balance[1] == pytest.approx(3 * balance[0])


def snapshot(spark, *months):
    panel = L.Lens(spark, SF).panel("orig_interest_rate", "original_term").limit(1).drop("loan_id", "as_of_month", "exit_reason", "upb_bom", "upb_eom", "score_band")
    own = spark.createDataFrame([(1, m, e, b, None, "FICO_700-739") for m, e, b in months], "loan_id bigint, as_of_month date, exit_reason string, upb_bom bigint, upb_eom bigint, score_band string")
    return facts.gather(own.crossJoin(panel), L.CUTOFF, credit.UNTIL, L.SETTINGS)


def test_odd_snapshots_fail(spark):
    at, later = dt.date(2001, 6, 1), dt.date(2001, 7, 1)
    assert facts.realised(snapshot(spark, (at, None, 100), (later, "ChargeOff", 90))).first().realised_default_balance == 100
    assert facts.realised(snapshot(spark, (later, "ChargeOff", 90))).count() == 0  # not active at the cutoff
    for months, message in (([(at, None, 100), (at, None, 100)], "active twice"), ([(at, None, 0), (later, "ChargeOff", 90)], "absent from the snapshot"), ([(at, None, None)], "exposure is missing")):
        with pytest.raises(Exception, match=message):
            snapshot(spark, *months).collect()
