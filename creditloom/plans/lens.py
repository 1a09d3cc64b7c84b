"""The driver's order tables read as a loan portfolio: orders are loans, their line items the months that follow.

Money is in whole cents. The same definitions stand below as SQL, for checks by another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import macro as M
from creditloom.operators import panel as P
from creditloom.sources import layout, tables

CUTOFF, MATURITY, MACRO_MONTHS, SEEN_MONTHS = "2001-06-01", 4, 200, 80
SETTINGS = replace(Settings(), cutoff=CUTOFF, maturity_mob=MATURITY)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df in the cache while several small results are drawn from it."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def local(df: DataFrame) -> DataFrame:
    """A report-sized table (a row a segment, band, year or pair of states), computed now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


class Lens:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.settings = spark, sf_dir, SETTINGS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def acquisition(self) -> DataFrame:
        digit = F.substring("o_orderpriority", 1, 1).cast("int")
        month = F.trunc(F.col("o_orderdate").cast("date"), "month")
        return self.table("orders").select(
            F.col("o_orderkey").alias("loan_id"), month.alias("origination_month"), F.year(month).alias("vintage_year"), _cents("o_totalprice").alias("original_upb"),
            (300 + (F.col("o_custkey") * 37 + F.col("o_orderkey") * 11) % 551).cast("int").alias("orig_score"), F.when(digit == 1, 180).when(digit == 2, 240).otherwise(360).alias("original_term"),
            (0.03 + digit * 0.005).alias("orig_interest_rate"), (60 + F.col("o_orderkey") % 41).cast("double").alias("orig_ltv"), F.element_at(F.array(*map(F.lit, ("TX", "CA", "FL", "NY", "WA"))), (F.col("o_custkey") % 5 + 1).cast("int")).alias("property_state"),
        )

    def performance(self, loans: DataFrame | None = None) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_returnflag", (F.row_number().over(order) - 1).alias("n"), F.lead(F.lit(True)).over(order).isNull().alias("final"), (30 * (F.floor("l_quantity").cast("int") % 7)).alias("dpd"), _cents("l_extendedprice").alias("upb"),
            F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.round(F.col("l_tax") * 100).cast("long").alias("t"),
        )
        stop = F.min(F.when(F.col("dpd") == 180, F.col("n"))).over(Window.partitionBy("l_orderkey"))
        kept = lines.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("n") <= F.col("stop")))
        last = F.coalesce(F.col("n") == F.col("stop"), F.col("final"))
        flag = F.when(F.col("l_linenumber") == 7, "06").when(F.col("l_returnflag") == "A", "01").when(F.col("l_returnflag") == "R", "03")
        kept = kept.withColumn("code", F.when(last, flag))
        start = (self.acquisition() if loans is None else loans).select(F.col("loan_id").alias("l_orderkey"), "origination_month")
        bad = (F.col("dpd") == 180) | (F.col("code") == "03")
        return kept.join(start, "l_orderkey").select(
            F.col("l_orderkey").alias("loan_id"), F.add_months("origination_month", F.col("n")).alias("as_of_month"), F.col("upb").alias("current_upb"), F.col("dpd").alias("delinquency_status"), F.col("n").alias("loan_age"),
            F.col("code").alias("zero_balance_code"), F.lit(None).cast("date").alias("disposition_date"),
            F.when(bad, F.floor(F.col("upb") * (100 - F.col("d")) / 200).cast("long")).alias("net_sales_proceeds"), F.when(bad, F.floor(F.col("upb") * F.col("t") / 100).cast("long")).alias("foreclosure_costs"),
        )

    def colocated(self, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
        """Loans and months as bucketed tables in the shared folder, under names of their own."""
        name = f"lens_{uuid.uuid4().hex}"
        root = f"{tables.shared_folder(self.spark)}/{name}"
        loans = self.acquisition()
        rows = layout.write(self.performance(loans), f"{name}_performance", f"{root}/performance", "loan_id", ["as_of_month"], buckets)
        return layout.write(loans, f"{name}_acquisition", f"{root}/acquisition", "loan_id", [], buckets), rows

    def macro(self) -> DataFrame:
        """MACRO_MONTHS months: what the orders of each month add up to, and after their last month the same again."""
        placed = self.table("orders").select(C.months_apart("o_orderdate", F.lit("1995-01-01").cast("date")).alias("at"), _cents("o_totalprice").alias("cents"))
        seen = placed.groupBy("at").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))  # a row a month
        months = self.spark.range(0, MACRO_MONTHS, 1, 1).select(F.col("id").cast("int").alias("i"), (F.col("id") % SEEN_MONTHS).cast("int").alias("at")).join(F.broadcast(seen), "at", "left")
        n, cents = F.coalesce("n", F.lit(0)), F.coalesce("cents", F.lit(0))
        u, h = F.lit(4.0) + (n * 7 % 50).cast("double") / 10.0, (cents % 20 - 8).cast("double") / 100.0
        rows = months.select(F.add_months(F.lit("1995-01-01").cast("date"), F.col("i")).alias("as_of_month"), u.alias("unemployment_rate"), h.alias("hpi_change_yoy"))
        w = Window.orderBy("as_of_month")  # MACRO_MONTHS rows
        change = F.coalesce(F.round(F.col("unemployment_rate") - F.lag("unemployment_rate", 3).over(w), 6), F.lit(0.0))
        return rows.select("as_of_month", "unemployment_rate", change.alias("unemployment_change_3m"), "hpi_change_yoy")

    def macro_features(self) -> DataFrame:
        return M.features(self.macro(), self.settings.macro_lags)

    def checked_panel(self, *carried: str) -> DataFrame:
        loans = self.acquisition()
        return P.build(loans, self.performance(loans), self.macro_features(), self.settings, carried)

    def panel(self, *carried: str) -> DataFrame:
        return P.public(self.checked_panel(*carried))


def _band_sql(x: str, edges: tuple[int, ...], prefix: str) -> str:
    return "case " + " ".join(f"when {x} >= {a} and {x} < {b} then '{prefix}{a:03d}-{b - 1:03d}'" for a, b in zip(edges[:-1], edges[1:], strict=True)) + " end"


_VALUES = "unemployment_rate, unemployment_change_3m, hpi_change_yoy"
_LAGS = ", ".join(f"lag({c}, {n}) over (order by as_of_month) as {c}_lag_{n}" for n in SETTINGS.macro_lags for c in M.VALUES)
LAG_NAMES = ", ".join(M.lag_columns(SETTINGS.macro_lags))

ACQ_SQL = """acq as (
  select o_orderkey as loan_id, cast(date_trunc('month', o_orderdate) as date) as origination_month, cast(year(o_orderdate) as integer) as vintage_year,
    cast(round(o_totalprice * 100) as bigint) as original_upb, cast(300 + (o_custkey * 37 + o_orderkey * 11) % 551 as integer) as orig_score,
    case substr(o_orderpriority, 1, 1) when '1' then 180 when '2' then 240 else 360 end as original_term,
    cast(0.03 as double) + cast(substr(o_orderpriority, 1, 1) as integer) * cast(0.005 as double) as orig_interest_rate,
    cast(60 + o_orderkey % 41 as double) as orig_ltv, ['TX', 'CA', 'FL', 'NY', 'WA'][cast(o_custkey % 5 + 1 as integer)] as property_state
  from orders)"""
PERF_SQL = """li as (
  select l_orderkey, l_linenumber, l_returnflag, cast(row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 as integer) as n,
    30 * (cast(floor(l_quantity) as integer) % 7) as dpd, cast(round(l_extendedprice * 100) as bigint) as upb,
    cast(round(l_discount * 100) as bigint) as d, cast(round(l_tax * 100) as bigint) as t
  from lineitem),
kept as (
  select *, lead(n) over (partition by l_orderkey order by n) is null as is_last
  from (select *, min(case when dpd = 180 then n end) over (partition by l_orderkey) as stop from li) where stop is null or n <= stop),
coded as (
  select *, case when is_last then case when l_linenumber = 7 then '06' when l_returnflag = 'A' then '01' when l_returnflag = 'R' then '03' end end as code from kept),
perf as (
  select loan_id, cast(origination_month + to_months(n) as date) as as_of_month, upb as current_upb, dpd as delinquency_status, n as loan_age, code as zero_balance_code,
    case when dpd = 180 or code = '03' then cast(floor(cast(upb * (100 - d) as double) / 200) as bigint) end as net_sales_proceeds,
    case when dpd = 180 or code = '03' then cast(floor(cast(upb * t as double) / 100) as bigint) end as foreclosure_costs
  from coded join acq on l_orderkey = loan_id)"""
MACRO_SQL = f"""ordered as (
  select cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as integer) as place, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as cents from orders group by 1),
spine as (
  select cast(date '1995-01-01' + to_months(cast(i as integer)) as date) as as_of_month, cast(4.0 as double) + cast(coalesce(n, 0) * 7 % 50 as double) / cast(10 as double) as unemployment_rate,
    cast(coalesce(cents, 0) % 20 - 8 as double) / cast(100 as double) as hpi_change_yoy
  from range({MACRO_MONTHS}) as r(i) left join ordered on place = i % {SEEN_MONTHS}),
series as (
  select as_of_month, unemployment_rate, coalesce(round(unemployment_rate - lag(unemployment_rate, 3) over (order by as_of_month), 6), cast(0 as double)) as unemployment_change_3m, hpi_change_yoy from spine),
macro as (select as_of_month, {_VALUES}, {_LAGS} from series)"""
_STATE_SQL = "case zero_balance_code when '01' then 'Prepaid' when '03' then 'ChargeOff' when '06' then 'Repurchased' else case when delinquency_status >= 180 then 'ChargeOff' when delinquency_status = 0 then 'Current' else 'DPD' || cast(delinquency_status as varchar) end end"
PANEL_SQL = f"""base as (
  select p.*, a.orig_score, a.orig_ltv, a.property_state, a.vintage_year, a.origination_month,
    cast((year(as_of_month) - year(origination_month)) * 12 + month(as_of_month) - month(origination_month) as integer) as months_on_book, {_STATE_SQL} as delinquency_state,
    lead(current_upb) over w as next_upb, lead(as_of_month) over w is null as is_last
  from perf p join acq a using (loan_id) window w as (partition by loan_id order by as_of_month)),
exits as (
  select *, case when zero_balance_code = '01' then 'Prepaid' when zero_balance_code = '03' then 'ChargeOff' when zero_balance_code = '06' then 'Repurchased'
    when delinquency_status >= 180 then 'ChargeOff' when is_last then 'Censored' end as exit_reason from base),
panel as (
  select loan_id, e.as_of_month, strftime(origination_month, '%Y-%m') as vintage, vintage_year, months_on_book, loan_age as vendor_loan_age, {_band_sql("months_on_book", SETTINGS.mob_edges, "MOB_")} as mob_band,
    delinquency_state, lag(delinquency_state) over w as previous_delinquency_state, case when exit_reason is null then lead(delinquency_state) over w end as next_delinquency_state, current_upb as upb_bom,
    case when exit_reason in ('ChargeOff', 'Prepaid', 'Repurchased') then 0 when exit_reason is null then next_upb end as upb_eom, orig_score, {_band_sql("orig_score", SETTINGS.score_edges, "FICO_")} as score_band,
    orig_ltv, property_state, net_sales_proceeds, foreclosure_costs, exit_reason, coalesce(exit_reason = 'Censored', false) as is_censored, {_VALUES}, {LAG_NAMES}
  from exits e left join macro m on e.as_of_month = m.as_of_month window w as (partition by loan_id order by e.as_of_month))"""
BOTH = f"{ACQ_SQL},\n{PERF_SQL}"
ALL = f"{BOTH},\n{MACRO_SQL},\n{PANEL_SQL}"
