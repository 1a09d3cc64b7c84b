"""The panel and monthly states from streams."""

import datetime as dt
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from creditloom.config import Settings
from creditloom.operators import macro, panel
from creditloom.sources import synthetic, tables
from creditloom.streaming import panel as stream
from creditloom.streaming import transitions

S = replace(Settings(), loans=25, first_vintage=2004, last_vintage=2006, max_months=20)


def run(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(600)
    return df.sparkSession.table(name)


def streamed(spark, folder, batches, schema):
    """A stream of one file a batch, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/parts/{k:03d}")
    (folder / "in").mkdir()
    for k in range(len(batches)):
        (source,) = (folder / "parts" / f"{k:03d}").glob("*.parquet")
        target = folder / "in" / f"{k:03d}.parquet"
        source.rename(target)
        os.utime(target, (1_000_000_000 + k, 1_000_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


@pytest.fixture(scope="module")
def source(spark):
    loans, rows, series = synthetic.portfolio(spark, S)
    return loans.cache(), rows.cache(), macro.features(series, S.macro_lags).cache()


@pytest.mark.parametrize("seed", [0, 1])
def test_months_in_any_order_give_the_batch_panel(spark, source, tmp_path, seed):
    loans, rows, series = source
    rng = random.Random(seed)
    order = sorted(rows.collect(), key=lambda r: (r.as_of_month, r.loan_id))
    # Months come up to three months late, in batches.
    order = [r for _, r in sorted(((r.as_of_month.year * 12 + r.as_of_month.month + rng.random() * 3, rng.random()), r) for r in order)]
    size = -(-len(order) // 12)
    batches = [order[k : k + size] for k in range(0, len(order), size)]
    last = order[-1].asDict() | {"loan_id": "clock", "zero_balance_code": None}
    day = last["as_of_month"]
    batches += [[tuple((last | {"as_of_month": day.replace(year=day.year + 2 + k)}).values())] for k in range(2)]
    read = streamed(spark, tmp_path, batches, rows.schema)
    got = run(stream.append(read, loans, series, S, late="130 days"), tmp_path, f"appended{seed}").where("loan_id <> 'clock'")
    want = panel.public(panel.build(loans, rows, series, S))
    assert got.columns == want.columns and got.count() == want.count() == rows.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


MONTHS = "loan_id string, as_of_month date, current_upb double, delinquency_status int, loan_age int, zero_balance_code string, disposition_date date, net_sales_proceeds double, foreclosure_costs double"


def months(*rows):
    return [(loan, dt.date(y, m, 1), upb, dpd, 0, code, dt.date(y, m, 1) if gone else None, None, None) for loan, y, m, upb, dpd, code, gone in rows]


def test_ends_gaps_and_repeats_are_as_in_a_batch(spark, tmp_path):
    rows = months(
        ("exit", 2010, 1, 9.0, 0, None, False), ("exit", 2010, 2, 8.0, 30, "01", False),
        ("silent", 2010, 1, 5.0, 0, None, False), ("silent", 2010, 2, 4.0, 30, " ", False),
        ("gap", 2010, 1, 3.0, 0, None, False), ("gap", 2010, 4, 2.0, 60, None, False),
        ("gone", 2010, 1, 3.0, 0, None, False), ("gone", 2010, 2, 2.0, 60, None, True),
        ("odd", 2010, 1, 3.0, 0, None, False), ("odd", 2010, 2, 2.0, 60, "99", False),
        ("late", 2010, 1, 3.0, 180, None, False),
    )
    clock = [months(("clock", y, 1, 1.0, 0, None, False)) for y in (2013, 2015)]
    read = streamed(spark, tmp_path, [rows[::-1], *clock], MONTHS)
    got = run(stream.final_months(read, S), tmp_path, "ends").where("loan_id <> 'clock'")
    loans = spark.createDataFrame([(x,) for x in sorted({r[0] for r in rows})], "loan_id string").selectExpr("loan_id", "date'2010-01-01' as origination_month", "700 as orig_score", "80.0D as orig_ltv", "'TX' as property_state", "2010 as vintage_year")
    series = macro.features(spark.createDataFrame(synthetic.macro_series(S, 120), tables.macro_schema()), S.macro_lags)
    want = panel.build(loans, spark.createDataFrame(rows, MONTHS), series, S)
    columns = ["loan_id", "as_of_month", "delinquency_state", "previous_delinquency_state", "next_delinquency_state", "upb_bom", "upb_eom", "exit_reason"]
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert key(got) == key(want)


def test_a_month_is_not_final_before_its_successor_is(spark, tmp_path):
    first = months(("a", 2010, 1, 9.0, 0, None, False), ("b", 2010, 1, 9.0, 0, "01", False), ("c", 2010, 8, 1.0, 0, None, False))
    later = months(("a", 2010, 3, 7.0, 60, None, False), ("c", 2010, 9, 1.0, 0, None, False))
    read = streamed(spark, tmp_path, [first, later, months(("c", 2010, 10, 1.0, 0, None, False))], MONTHS)
    got = {(r.loan_id, r.as_of_month.month) for r in run(stream.final_months(read, S, late="250 days"), tmp_path, "early").collect()}
    assert ("a", 1) not in got and ("c", 8) not in got  # the watermark is still before January


def test_states_are_counted_by_calendar_month(spark, tmp_path):
    days = ["2010-01-01", "2010-01-31", "2010-02-01", "2010-02-28", "2010-03-01", "2010-03-31", "2011-06-01", "2012-06-01"]
    rows = [("a", d, None, 30 * (k % 2)) for k, d in enumerate(days)]
    schema = "loan_id string, as_of_month date, zero_balance_code string, delinquency_status int"
    as_rows = lambda part: [(a, dt.date.fromisoformat(d), c, n) for a, d, c, n in part]
    read = streamed(spark, tmp_path, [as_rows(rows[:6]), as_rows(rows[6:7]), as_rows(rows[7:])], schema)
    got = {(str(r.month)[:10], r.state): r.n for r in run(transitions.monthly_states(read, S), tmp_path, "by_month").collect()}
    want = {(f"2010-0{m}-01", state): 1 for m in (1, 2, 3) for state in ("Current", "DPD30")}
    assert {k: v for k, v in got.items() if k[0] < "2011"} == want
