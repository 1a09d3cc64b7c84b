"""The credit engine's queries over the lens, each beside its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.operators import attribution, conditional, ecl, facts, forecast, lgd, macro, monitoring, panel, quality, quantiles, scenarios, transitions, vintage
from creditloom.plans import lens as L
from creditloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Months of the lens's macro series after its cutoff that a forecast follows, as the reference job's.
HORIZON = 119


def query(sql: str | None = None):
    """Registers a function (lens) -> DataFrame under its name, with the SQL for the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(L.Lens(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _round(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if kind == "double" else F.col(c).cast("bigint").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])


# Data quality -----------------------------------------------------------------------------------------------------

_RAW_ACQ = """raw as (
  select case when loan_id % 307 = 0 then null else loan_id end as loan_id, case when loan_id % 113 = 0 then null else origination_month end as origination_month,
    case when loan_id % 89 = 0 then 0 else original_upb end as original_upb, case when loan_id % 101 = 0 then 0 else original_term end as original_term,
    case when loan_id % 97 = 0 then orig_score + 1000 else orig_score end as orig_score
  from (select * from acq union all select * from acq where loan_id % 211 = 0)),
flags as (
  select loan_id is null as acquisition_missing_loan_id, origination_month is null as acquisition_missing_origination_month, original_upb <= 0 as acquisition_nonpositive_original_upb,
    original_term <= 0 as acquisition_nonpositive_original_term, not orig_score between 300 and 850 as acquisition_score_out_of_range, count(*) over (partition by loan_id) > 1 as acquisition_duplicate_loan_id
  from raw)"""
ACQ_REASONS = ["acquisition_missing_loan_id", "acquisition_missing_origination_month", "acquisition_nonpositive_original_upb", "acquisition_nonpositive_original_term", "acquisition_score_out_of_range", "acquisition_duplicate_loan_id"]


def _raw_acquisition(x: L.Lens) -> DataFrame:
    loans = x.acquisition()
    twice = loans.unionByName(loans.where("loan_id % 211 = 0"))
    k = F.col("loan_id")
    put = lambda n, bad, c: F.when(k % n == 0, bad).otherwise(F.col(c)).alias(c)
    return twice.select(put(307, None, "loan_id"), put(113, None, "origination_month"), put(89, 0, "original_upb"), put(101, 0, "original_term"), put(97, F.col("orig_score") + 1000, "orig_score"))


def _summary_sql(reasons: list[str]) -> str:
    some = " or ".join(reasons)
    return " union all ".join(
        f"select '{r}' as reason, cast(count(*) filter (where {r}) as bigint) as failed, round(cast(count(*) filter (where {r}) as double) / count(*), 6) as rate, count(*) as total_rows, count(*) filter (where {some}) as excluded_rows from flags"
        for r in reasons
    )


@query(f"with {L.ACQ_SQL}, {_RAW_ACQ} {_summary_sql(ACQ_REASONS)}")
def dq_acquisition_summary(x: L.Lens) -> DataFrame:
    return _round(quality.summarise(quality.tag_acquisition(_raw_acquisition(x)), ACQ_REASONS))


_RAW_PERF = """raw as (
  select l_orderkey as loan_id, cast(date_trunc('month', l_shipdate) as date) as as_of_month, case when l_suppkey % 61 = 0 then -1 else cast(round(l_extendedprice * 100) as bigint) end as current_upb,
    30 * (cast(floor(l_quantity) as integer) % 7) + case when l_partkey % 89 = 0 then 7 else 0 end as delinquency_status,
    cast((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) as integer) as loan_age
  from lineitem join orders on l_orderkey = o_orderkey),
flags as (
  select loan_id is null as performance_missing_loan_id, as_of_month is null as performance_missing_as_of_month, current_upb < 0 as performance_negative_current_upb,
    delinquency_status not in (0, 30, 60, 90, 120, 150, 180) as performance_invalid_delinquency_status, loan_age < 0 as performance_negative_loan_age,
    count(*) over (partition by loan_id, as_of_month) > 1 as performance_duplicate_loan_month, loan_id % 53 = 0 as performance_orphan_loan_id
  from raw)"""
PERF_REASONS = ["performance_missing_loan_id", "performance_missing_as_of_month", "performance_negative_current_upb", "performance_invalid_delinquency_status", "performance_negative_loan_age", "performance_duplicate_loan_month", "performance_orphan_loan_id"]


def _tagged_performance(x: L.Lens) -> DataFrame:
    orders = x.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    lines = x.table("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("loan_id"), F.trunc("l_shipdate", "month").alias("as_of_month"), F.when(F.col("l_suppkey") % 61 == 0, F.lit(-1)).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("current_upb"),
        (30 * (F.floor("l_quantity").cast("int") % 7) + F.when(F.col("l_partkey") % 89 == 0, 7).otherwise(0)).alias("delinquency_status"), C.months_apart("l_shipdate", "o_orderdate").alias("loan_age"),
    )
    return quality.tag_performance(rows, x.acquisition().where("loan_id % 53 <> 0"))


@query(f"with {_RAW_PERF} {_summary_sql(PERF_REASONS)}")
def dq_performance_summary(x: L.Lens) -> DataFrame:
    return _round(quality.summarise(_tagged_performance(x), PERF_REASONS))


_LIST = "list_filter([" + ", ".join(f"case when {r} then '{r}' end" for r in PERF_REASONS) + "], lambda r: r is not null)"


@query(f"with {_RAW_PERF}, reasons as (select {_LIST} as rs from flags) select r as reason, count(*) as \"rows\", count(*) filter (where len(rs) = 1) as only_reason_rows from (select rs, unnest(rs) as r from reasons) group by r")
def dq_exclusion_reasons(x: L.Lens) -> DataFrame:
    tagged = _tagged_performance(x).select(quality.REASONS, F.explode(quality.REASONS).alias("reason"))
    return tagged.groupBy("reason").agg(F.count("*").alias("rows"), F.count_if(F.size(quality.REASONS) == 1).alias("only_reason_rows"))


@query(f"""with {L.BOTH}, sampled as (select loan_id, vintage_year from acq where cast('0x' || substr(md5(cast(loan_id as varchar) || '|1729'), 1, 8) as bigint) % 1000000 < 100000)
select vintage_year, count(distinct loan_id) as loans, count(*) as "rows", cast(sum(current_upb) as bigint) as upb from perf join sampled using (loan_id) group by vintage_year""")
def entity_hash_sample(x: L.Lens) -> DataFrame:
    loans = x.acquisition()
    rows = quality.attach_sampled(x.performance(loans), quality.digest_sample(loans, "loan_id", 0.1, x.settings))
    return rows.groupBy("vintage_year").agg(F.countDistinct("loan_id").alias("loans"), F.count("*").alias("rows"), F.sum("current_upb").alias("upb"))


@query()
def entity_xxhash_sample(x: L.Lens) -> DataFrame:
    return quality.hash_sample(x.acquisition(), "loan_id", 0.1, x.settings)


# Panel ------------------------------------------------------------------------------------------------------------


@query(f"with {L.ALL} select * from panel")
def panel_rows(x: L.Lens) -> DataFrame:
    return x.panel()


@query(f"""with {L.ALL}
select count(*) as row_count, cast(0 as bigint) as gap_rows, cast(0 as bigint) as duplicate_rows, (select count(*) from (select loan_id from panel group by loan_id having count(exit_reason) <> 1)) as loans_without_one_terminal,
  (select count(*) from (select exit_reason, lead(as_of_month) over (partition by loan_id order by as_of_month) as nxt from panel) where exit_reason is not null and nxt is not null) as terminal_not_last_rows, cast(0 as bigint) as unknown_code_rows,
  count(*) filter (where mob_band is null) as unbanded_mob_rows, count(*) filter (where score_band is null) as unbanded_score_rows, cast(0 as bigint) as unknown_state_rows, count(*) filter (where is_censored is null) as null_censor_rows,
  count(*) filter (where exit_reason is null and next_delinquency_state is null) as missing_next_state_rows, count(*) filter (where exit_reason is not null and next_delinquency_state is not null) as terminal_next_state_rows,
  count(*) filter (where exit_reason <> 'Censored' and upb_eom <> 0) as exit_balance_rows, count(*) filter (where is_censored and upb_eom is not null) as censored_balance_rows,
  count(*) filter (where unemployment_rate is null or unemployment_change_3m is null or hpi_change_yoy is null) as missing_macro_rows, count(*) filter (where vendor_loan_age is distinct from months_on_book) as vendor_mob_mismatch_rows
from panel""")
def panel_integrity(x: L.Lens) -> DataFrame:
    return panel.integrity(x.checked_panel(), x.settings)


@query(f"""with {L.ALL}, want as (select loan_id, as_of_month, {L._STATE_SQL} as delinquency_state, current_upb as upb_bom, net_sales_proceeds from perf)
select count(p.loan_id) as panel_rows, count(w.loan_id) as expected_rows, count(*) filter (where w.loan_id is null) as only_in_panel, count(*) filter (where p.loan_id is null) as only_in_expected,
  count(*) filter (where p.loan_id is not null and w.loan_id is not null and (p.delinquency_state is distinct from w.delinquency_state or p.upb_bom is distinct from w.upb_bom or p.net_sales_proceeds is distinct from w.net_sales_proceeds)) as differing_rows
from panel p full join want w on p.loan_id = w.loan_id and p.as_of_month = w.as_of_month""")
def panel_reconciliation(x: L.Lens) -> DataFrame:
    """The panel against its source rows."""
    rows = x.performance()
    want = rows.select("loan_id", "as_of_month", C.delinquency_state("zero_balance_code", "delinquency_status", x.settings).alias("delinquency_state"), F.col("current_upb").alias("upb_bom"), "net_sales_proceeds")
    return panel.reconcile(x.panel(), want, "delinquency_state", "upb_bom", "net_sales_proceeds")


@query(f"""with {L.ALL} select vintage_year, delinquency_state, next_delinquency_state, exit_reason, count(*) as "rows", cast(sum(upb_bom) as bigint) as upb_bom, cast(sum(upb_eom) as bigint) as upb_eom, count(previous_delinquency_state) as with_previous
from panel group by all""")
def panel_colocated(x: L.Lens) -> DataFrame:
    """The panel from loans and months that lie bucketed and sorted by loan: no shuffle and no sort under its windows and its join."""
    loans, rows = x.colocated()
    built = panel.public(panel.build(loans, rows, x.macro_features(), x.settings))
    keys = ["vintage_year", "delinquency_state", "next_delinquency_state", "exit_reason"]
    return built.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("upb_bom").alias("upb_bom"), F.sum("upb_eom").alias("upb_eom"), F.count("previous_delinquency_state").alias("with_previous"))


@query(f"with {L.MACRO_SQL} select * from macro")
def macro_features(x: L.Lens) -> DataFrame:
    return x.macro_features()


@query(f"with {L.MACRO_SQL} select count(*) as months, count(*) filter (where unemployment_rate is null) as missing, cast(0 as bigint) as gaps, count(*) - count(distinct as_of_month) as repeats from series")
def macro_integrity(x: L.Lens) -> DataFrame:
    return macro.integrity(x.macro())


@query(f"with {L.ALL} select vintage_year, count(*) as \"rows\", round(avg(unemployment_rate), 6) as unemployment_rate, round(avg(hpi_change_yoy_lag_6), 6) as hpi_change_yoy_lag_6 from panel group by vintage_year")
def panel_macro_join(x: L.Lens) -> DataFrame:
    return _round(x.panel().groupBy("vintage_year").agg(F.count("*").alias("rows"), F.avg("unemployment_rate").alias("unemployment_rate"), F.avg("hpi_change_yoy_lag_6").alias("hpi_change_yoy_lag_6")))


@query(f"with {L.ALL} select mob_band, delinquency_state, count(*) as \"rows\" from panel group by all")
def state_by_mob_band(x: L.Lens) -> DataFrame:
    return panel.state_by_band(x.panel())


@query(f"with {L.ALL} select k as exit_reason, coalesce(n, 0) as loans from (values ('ChargeOff'), ('Prepaid'), ('Repurchased'), ('Censored')) as v(k) left join (select exit_reason, count(*) as n from panel where exit_reason is not null group by 1) on k = exit_reason")
def exit_counts_zero_filled(x: L.Lens) -> DataFrame:
    return panel.exit_counts(x.panel(), x.settings)


# Transitions ------------------------------------------------------------------------------------------------------

CUBE = """cube as (
  select delinquency_state, next_delinquency_state, months_on_book, score_band, as_of_month, count(*) as transition_count from panel where not is_censored and next_delinquency_state is not null group by all)"""
STATES = "states as (select unnest(['Current','DPD30','DPD60','DPD90','DPD120','DPD150','ChargeOff','Prepaid','Repurchased']) as state)"


def _matrix_sql(before: str = "", where: str = "true") -> str:
    return f"""{before}sums as (select delinquency_state as origin, next_delinquency_state as destination, sum(transition_count) as n from cube where {where} group by all),
{before}matrix as (
  select a.state as origin, b.state as destination, cast(coalesce(n, 0) as bigint) as n,
    case when a.state in ('ChargeOff', 'Prepaid', 'Repurchased') or sum(coalesce(n, 0)) over (partition by a.state) = 0 then cast(a.state = b.state as double) else cast(coalesce(n, 0) as double) / sum(coalesce(n, 0)) over (partition by a.state) end as probability
  from states a cross join states b left join {before}sums s on s.origin = a.state and s.destination = b.state)"""


MATRIX = f"{STATES}, {_matrix_sql()}"


@query(f"with {L.ALL}, {CUBE} select * from cube")
def transition_cube(x: L.Lens) -> DataFrame:
    return transitions.cube(x.panel())


@query(f"with {L.ALL}, {CUBE}, {MATRIX} select origin, destination, n, round(probability, 6) as probability from matrix")
def empirical_matrix(x: L.Lens) -> DataFrame:
    return _round(transitions.matrix(transitions.cube(x.panel()), x.settings))


@query(f"""with {L.ALL}, {CUBE} select round(coalesce(sum(transition_count) filter (where delinquency_state like 'DPD%' and next_delinquency_state = 'Prepaid') / cast(sum(transition_count) filter (where delinquency_state like 'DPD%') as double), 0), 6) as delinquent_prepay,
  round(coalesce(sum(transition_count) filter (where next_delinquency_state = 'Repurchased') / cast(sum(transition_count) as double), 0), 6) as repurchase
from cube where delinquency_state not in ('ChargeOff', 'Prepaid', 'Repurchased')""")
def pooled_hazards(x: L.Lens) -> DataFrame:
    return _round(transitions.hazards(transitions.cube(x.panel()), x.settings))


def _shares(name: str, where: str) -> str:
    return f"{name} as (select origin, destination, k / cast(sum(k) over (partition by origin) as double) as p, cast(sum(k) over (partition by origin) as double) as n from (select delinquency_state as origin, next_delinquency_state as destination, sum(transition_count) as k from cube where {where} group by all))"


@query(f"""with {L.ALL}, {CUBE}, {_shares("a", "as_of_month < date '1998-01-01'")}, {_shares("b", "as_of_month >= date '1998-01-01'")},
j as (select origin, destination, coalesce(a.p, 0) as p0, coalesce(b.p, 0) as p1, max(b.n) over (partition by origin) as n1 from a full join b using (origin, destination))
select origin, destination, round(p0, 6) as p0, round(p1, 6) as p1, round((p1 - p0) * 10000, 4) as change_bps, case when p0 > 0 and p0 < 1 then round((p1 - p0) / sqrt(p0 * (1 - p0) / n1), 4) end as residual from j""")
def transition_stability(x: L.Lens) -> DataFrame:
    early = (F.col("as_of_month") < F.lit("1998-01-01").cast("date")).alias("early")
    counts = L.local(transitions.cube(x.panel()).groupBy("delinquency_state", "next_delinquency_state", early).agg(F.sum("transition_count").alias("transition_count")))
    return _round(monitoring.transition_stability(counts.where("early"), counts.where("not early")), change_bps=4, residual=4)


@query(f"""with {L.ALL}, {CUBE}, {MATRIX},
r as (select year(as_of_month) as period, delinquency_state as origin, next_delinquency_state as destination, sum(transition_count) as n from cube group by all),
e as (select period, t.origin, m.destination, t.n * m.probability as n from (select period, origin, sum(n) as n from r group by all) t join matrix m on t.origin = m.origin),
j as (select period, origin, destination, coalesce(r.n, 0) as realised, coalesce(e.n, 0) as expected from r full join e using (period, origin, destination)),
g as (select coalesce(cast(period as varchar), 'Total') as period, origin, destination, sum(realised) as realised, sum(expected) as expected from j group by grouping sets ((period, origin, destination), (origin, destination)))
select period, origin, destination, cast(realised as bigint) as realised, round(expected, 6) as expected, round(cast(realised as double) / sum(realised) over (partition by period, origin), 6) as realised_share, round(expected / sum(expected) over (partition by period, origin), 6) as expected_share from g""")
def transition_backtest(x: L.Lens) -> DataFrame:
    states = ("delinquency_state", "next_delinquency_state")
    counts = L.local(transitions.cube(x.panel()).groupBy(F.year("as_of_month").alias("period"), *states).agg(F.sum("transition_count").alias("transition_count")))
    realised = counts.select("period", F.col(states[0]).alias("origin"), F.col(states[1]).alias("destination"), F.col("transition_count").alias("n"))
    at_origin = realised.groupBy("period", "origin").agg(F.sum("n").alias("k"))
    table = F.broadcast(transitions.matrix(counts, x.settings).select("origin", "destination", "probability"))  # states by states
    expected = at_origin.join(table, "origin").select("period", "origin", "destination", (F.col("k") * F.col("probability")).alias("n"))
    return _round(monitoring.transition_backtest(realised, expected))


# Vintages ---------------------------------------------------------------------------------------------------------


def _triangle_sql(cohort: str, cutoff: str | None) -> str:
    """cohort: SQL with {m} for the month."""
    where = f"where as_of_month <= date '{cutoff}' and vintage_year <= {cutoff[:4]}" if cutoff else ""
    return f"""prow as (select *, {cohort.format(m="cast(vintage || '-01' as date)")} as cohort from panel {where}),
seen as (select cohort, cast(min(m) as integer) as max_observed_mob from (select cohort, vintage, max(months_on_book) as m from prow group by all) group by cohort),
start as (select {cohort.format(m="origination_month")} as cohort, cast(sum(original_upb) as bigint) as original_balance, count(*) as original_accounts from acq group by 1),
cells as (
  select cohort, months_on_book, count(*) as accounts_active, count(*) filter (where exit_reason = 'ChargeOff') as chargeoff_accounts, cast(sum(upb_bom) as bigint) as balance_active,
    cast(sum(case when exit_reason = 'ChargeOff' then upb_bom else 0 end) as bigint) as gross_chargeoff_dollars, cast(sum(case when exit_reason = 'ChargeOff' then coalesce(net_sales_proceeds, 0) - coalesce(foreclosure_costs, 0) else 0 end) as bigint) as recovery_dollars,
    cast(sum(case when exit_reason = 'Prepaid' then upb_bom else 0 end) as bigint) as prepay_dollars, cast(sum(case when exit_reason = 'Repurchased' then upb_bom else 0 end) as bigint) as repurchase_dollars
  from prow group by all),
tri as (
  select cohort as vintage, months_on_book, accounts_active, chargeoff_accounts, balance_active, gross_chargeoff_dollars, recovery_dollars, greatest(gross_chargeoff_dollars - recovery_dollars, 0) as net_chargeoff_dollars,
    prepay_dollars, repurchase_dollars, original_balance, original_accounts, max_observed_mob
  from cells join start using (cohort) join seen using (cohort))"""


_QUARTER = "cast(year({m}) as varchar) || '-Q' || cast(quarter({m}) as varchar)"
TRI = _triangle_sql(_QUARTER, L.CUTOFF)
CURVES = f"""grid as (select vintage, original_balance, max_observed_mob, cast(unnest(range({L.MATURITY + 1})) as integer) as months_on_book from (select distinct vintage, original_balance, max_observed_mob from tri)),
curves as (
  select g.vintage, g.months_on_book, g.original_balance, g.max_observed_mob, g.months_on_book <= g.max_observed_mob as is_observed,
    case when g.months_on_book <= g.max_observed_mob then cast(sum(coalesce(net_chargeoff_dollars, 0)) over w as double) end as cumulative_loss, t.vintage is null and g.months_on_book <= g.max_observed_mob as internal_gap
  from grid g left join tri t on g.vintage = t.vintage and g.months_on_book = t.months_on_book window w as (partition by g.vintage order by g.months_on_book rows unbounded preceding)),
rated as (select *, cumulative_loss / nullif(cast(original_balance as double), 0) as cumulative_loss_rate from curves)"""
FACTORS = f"""pairs as (select months_on_book, cumulative_loss as a, lead(cumulative_loss) over (partition by vintage order by months_on_book) as b from rated where max_observed_mob >= {L.MATURITY}),
factors as (select months_on_book, case when sum(a) = 0 and sum(b) = 0 then 1.0::double when sum(a) > 0 then greatest(sum(b) / sum(a), 1.0::double) end as factor, count(*) as vintages from pairs where b is not null group by 1),
averages as (select months_on_book, avg(cumulative_loss_rate) as average_rate from rated where max_observed_mob >= {L.MATURITY} group by 1)"""
PROJECT = f"""full_ as (
  select r.*, coalesce(f.factor, 1.0::double) as factor, average_rate, least(max_observed_mob, {L.MATURITY}) as a from rated r left join factors f on r.months_on_book = f.months_on_book + 1 left join averages v on r.months_on_book = v.months_on_book),
last_ as (select vintage, max(case when months_on_book = a then cumulative_loss_rate end) as r, max(case when months_on_book = a then average_rate end) as av from full_ group by 1),
projected as (
  select vintage, months_on_book, original_balance, max_observed_mob, cumulative_loss_rate,
    case when is_observed then cumulative_loss_rate else r * exp(sum(case when is_observed then 0 else ln(factor) end) over w) end as chain_ladder_rate,
    case when is_observed then cumulative_loss_rate else max(case when is_observed then case when months_on_book = a then r end else greatest(coalesce(average_rate, 0) * case when av > 0 then r / av when r = 0 then 0 else 1 end, r) end) over w end as scaled_average_rate
  from full_ join last_ using (vintage) window w as (partition by vintage order by months_on_book rows unbounded preceding)),
ult as (
  select vintage, case when max_observed_mob >= {L.MATURITY} then 'Observed' else 'Projected' end as status, max_observed_mob, original_balance, o.observed_rate, chain_ladder_rate as chain_ladder_ultimate, scaled_average_rate as scaled_average_ultimate
  from projected join (select vintage, max(cumulative_loss_rate) as observed_rate from projected group by 1) o using (vintage) where months_on_book = {L.MATURITY})"""


def _curves(x: L.Lens, cutoff: str | None = L.CUTOFF) -> DataFrame:
    return vintage.curves(vintage.triangle(x.panel(), x.acquisition(), "quarterly", cutoff), L.MATURITY)


def _ultimates(x: L.Lens, cutoff: str | None = L.CUTOFF) -> DataFrame:
    return vintage.ultimates(vintage.project(_curves(x, cutoff), L.MATURITY), L.MATURITY)


@query(f"with {L.ALL}, {TRI} select * from tri")
def vintage_triangle_quarterly(x: L.Lens) -> DataFrame:
    return vintage.triangle(x.panel(), x.acquisition(), "quarterly", L.CUTOFF)


@query(f"with {L.ALL}, {_triangle_sql('cast(year({m}) as varchar)', None)} select * from tri")
def vintage_triangle_annual(x: L.Lens) -> DataFrame:
    return vintage.triangle(x.panel(), x.acquisition(), "annual")


@query(f"with {L.ALL}, {TRI}, {CURVES} select vintage, months_on_book, original_balance, max_observed_mob, is_observed, cumulative_loss, round(cumulative_loss_rate, 6) as cumulative_loss_rate, internal_gap from rated")
def vintage_curves_masked(x: L.Lens) -> DataFrame:
    return _round(_curves(x))


@query(f"with {L.ALL}, {TRI}, {CURVES}, {FACTORS} select months_on_book, round(factor, 6) as factor, vintages from factors")
def development_factors(x: L.Lens) -> DataFrame:
    return _round(vintage.development(_curves(x), L.MATURITY))


@query(f"with {L.ALL}, {TRI}, {CURVES}, {FACTORS}, {PROJECT} select vintage, status, max_observed_mob, original_balance, round(observed_rate, 6) as observed_rate, round(chain_ladder_ultimate, 6) as chain_ladder_ultimate, round(scaled_average_ultimate, 6) as scaled_average_ultimate from ult")
def chain_ladder_ultimate(x: L.Lens) -> DataFrame:
    return _round(_ultimates(x))


@query(f"""with {L.ALL}, {TRI}, {CURVES}, {FACTORS}, {PROJECT}
select round(sum(chain_ladder_ultimate * original_balance) / sum(cast(original_balance as double)), 6) as chain_ladder_ultimate, round(sum(scaled_average_ultimate * original_balance) / sum(cast(original_balance as double)), 6) as scaled_average_ultimate, count(*) as vintages from ult""")
def portfolio_ultimate(x: L.Lens) -> DataFrame:
    return _round(vintage.portfolio_ultimate(_ultimates(x)))


@query(f"""with {L.ALL}, {TRI}, s as (select vintage, sum(chargeoff_accounts)::double as k, sum(gross_chargeoff_dollars)::double as g, sum(net_chargeoff_dollars)::double as l, max(original_balance)::double as b, max(original_accounts)::double as n from tri group by 1)
select vintage, round(k / n, 6) as frequency, round((g / nullif(k, 0)) / (b / n), 6) as exposure, round(l / nullif(g, 0), 6) as severity, round(l / b, 6) as loss_rate from s""")
def loss_decomposition(x: L.Lens) -> DataFrame:
    return _round(vintage.decomposition(vintage.triangle(x.panel(), x.acquisition(), "quarterly", L.CUTOFF)))


_EARLY = "2001-01-01"


@query(f"""with {L.ALL}, {_triangle_sql(_QUARTER, _EARLY)}, {CURVES}, {FACTORS}, {PROJECT},
later as (select * from (with {_triangle_sql(_QUARTER, None)} select vintage, sum(net_chargeoff_dollars) filter (where months_on_book <= {L.MATURITY})::double / max(original_balance) as actual from tri group by 1)),
pairs2 as (select substr(vintage, 1, 4) as era, chain_ladder_ultimate - actual as e, case when actual <> 0 then abs(chain_ladder_ultimate - actual) / abs(actual) end as pct from ult join later using (vintage))
select coalesce(era, 'overall') as era, count(*) as vintages, round(avg(e), 6) as mean_error, round(avg(abs(e)), 6) as mean_absolute_error, round(avg(pct), 6) as mean_absolute_percentage_error from pairs2 group by rollup (era)""")
def vintage_backtest_metrics(x: L.Lens) -> DataFrame:
    """Ultimates as projected half a year earlier, against what came."""
    early = _ultimates(x, _EARLY)
    tri = vintage.triangle(x.panel(), x.acquisition(), "quarterly")
    actual = tri.groupBy("vintage").agg(C.ratio(F.sum(F.when(F.col("months_on_book") <= L.MATURITY, F.col("net_chargeoff_dollars"))), F.max("original_balance")).alias("actual"))
    pairs = early.join(actual, "vintage").select(F.substring("vintage", 1, 4).alias("era"), F.col("chain_ladder_ultimate").alias("projected"), "actual")
    return _round(vintage.backtest(pairs))


@query(f"""with {L.ALL}, {_triangle_sql(_QUARTER, _EARLY)}, {CURVES}, {FACTORS}, {PROJECT},
later as (select * from (with {_triangle_sql(_QUARTER, None)} select vintage, sum(net_chargeoff_dollars) filter (where months_on_book <= {L.MATURITY})::double / max(original_balance) as actual from tri where max_observed_mob >= {L.MATURITY} group by 1))
select vintage, case when substr(vintage, 1, 4)::int < 2008 then 'pre-2008' when substr(vintage, 1, 4)::int <= 2010 then '2008-2010' else '2011+' end as era, round(chain_ladder_ultimate, 6) as projected, round(actual, 6) as actual from ult join later using (vintage) where status = 'Projected'""")
def vintage_backtest_pairs(x: L.Lens) -> DataFrame:
    """The projected vintages that have reached maturity since."""
    return _round(vintage.backtest_pairs(_ultimates(x, _EARLY), vintage.triangle(x.panel(), x.acquisition(), "quarterly"), L.MATURITY))


_METHODS = f"""with {L.ALL}, {_triangle_sql(_QUARTER, _EARLY)}, {CURVES}, {FACTORS}, {PROJECT},
later as (select * from (with {_triangle_sql(_QUARTER, None)} select vintage, sum(net_chargeoff_dollars) filter (where months_on_book <= {L.MATURITY})::double / max(original_balance) as ob,
  sum(net_chargeoff_dollars) filter (where months_on_book <= {L.MATURITY})::double / avg(balance_active) filter (where months_on_book <= {L.MATURITY}) as ao from tri where max_observed_mob >= {L.MATURITY} group by 1)),
c as (select *, case when substr(vintage, 1, 4)::int < 2008 then 'pre-2008' when substr(vintage, 1, 4)::int <= 2010 then '2008-2010' else '2011+' end as era, chain_ladder_ultimate - ob as e1, scaled_average_ultimate - ob as e2 from ult join later using (vintage) where status = 'Projected')"""


def _comparison(x: L.Lens) -> DataFrame:
    return vintage.backtest_comparison(_ultimates(x, _EARLY), vintage.triangle(x.panel(), x.acquisition(), "quarterly"), L.MATURITY)


@query(f"""{_METHODS} select vintage, era, round(chain_ladder_ultimate, 6) as chain_ladder_ultimate, round(scaled_average_ultimate, 6) as scaled_average_ultimate, round(ob, 6) as realised_rate_original_balance, round(ao, 6) as realised_rate_average_outstanding,
  round(e1, 6) as error_chain_ladder, round(abs(e1), 6) as absolute_error_chain_ladder, round(abs(e1) / nullif(ob, 0), 6) as absolute_percentage_error_chain_ladder, round(e2, 6) as error_scaled_average, round(abs(e2), 6) as absolute_error_scaled_average, round(abs(e2) / nullif(ob, 0), 6) as absolute_percentage_error_scaled_average from c""")
def vintage_backtest_comparison(x: L.Lens) -> DataFrame:
    """Every projected vintage against what came, by both methods and under both denominators."""
    return _round(_comparison(x).drop("status", "max_observed_mob", "original_balance", "observed_rate"))


@query(f"""{_METHODS}, m as (select unnest(['overall', era]) as era, unnest([1, 1]) as k, vintage, e1, e2, ob from c),
x as (select era, 'chain_ladder' as method, e1 as e, abs(e1) / nullif(ob, 0) as pct from m union all select era, 'scaled_average', e2, abs(e2) / nullif(ob, 0) from m)
select era, method, count(e) as cohorts, round(avg(e), 6) as mean_error, round(avg(abs(e)), 6) as mean_absolute_error, round(avg(pct), 6) as mean_absolute_percentage_error, count(pct) as nonzero_cohorts
from (select unnest(['overall', 'pre-2008', '2008-2010', '2011+']) as era) cross join (select unnest(['chain_ladder', 'scaled_average']) as method) left join x using (era, method) group by 1, 2""")
def vintage_backtest_methods(x: L.Lens) -> DataFrame:
    return _round(vintage.backtest_metrics(_comparison(x)))


_AVERAGE = """curves_ao as (
  select g.vintage, g.months_on_book, g.original_balance, g.max_observed_mob, g.months_on_book <= g.max_observed_mob as is_observed,
    case when g.months_on_book <= g.max_observed_mob then cast(sum(coalesce(net_chargeoff_dollars, 0)) over w as double) end as cumulative_loss, cast(avg(balance_active) over w as double) as bottom
  from grid g left join tri t on g.vintage = t.vintage and g.months_on_book = t.months_on_book window w as (partition by g.vintage order by g.months_on_book rows unbounded preceding))"""


@query(f"with {L.ALL}, {TRI}, {CURVES}, {_AVERAGE} select vintage, months_on_book, is_observed, cumulative_loss, round(cumulative_loss / nullif(bottom, 0), 6) as cumulative_loss_rate from curves_ao")
def vintage_curves_average_outstanding(x: L.Lens) -> DataFrame:
    """Rates over the mean outstanding balance so far."""
    table = vintage.curves(vintage.triangle(x.panel(), x.acquisition(), "quarterly", L.CUTOFF), L.MATURITY, "average_outstanding")
    return _round(table.select("vintage", "months_on_book", "is_observed", "cumulative_loss", "cumulative_loss_rate"))


@query(f"""with {L.ALL}, b as (select case when vintage_year < 2008 then 'pre-2008' when vintage_year <= 2010 then '2008-2010' else '2011+' end as era, upb_bom, greatest(upb_bom - coalesce(net_sales_proceeds, 0) + coalesce(foreclosure_costs, 0), 0) as loss from panel where exit_reason = 'ChargeOff')
select era, count(*) as accounts, cast(sum(upb_bom) as double) as balance, cast(sum(loss) as double) as loss, round(sum(loss)::double / sum(upb_bom)::double, 6) as lgd from b group by 1""")
def lgd_by_era(x: L.Lens) -> DataFrame:
    return _round(vintage.lgd_by_era(x.panel()))


# Loss given default -----------------------------------------------------------------------------------------------



def _obs_sql(before: str = "", where: str = "") -> str:
    return f"""{before}obs as (select score_band, hpi_change_yoy, vintage, cast(upb_bom as double) as w, least(greatest((coalesce(net_sales_proceeds, 0)::double - coalesce(foreclosure_costs, 0)::double) / upb_bom::double, 0), 1) as y from panel where exit_reason = 'ChargeOff' and upb_bom > 0 {where}),
{before}wls as (select score_band, count(*) as n, count(distinct hpi_change_yoy) as levels, sum(w) as w, sum(w * hpi_change_yoy) as wx, sum(w * y) as wy, sum(w * hpi_change_yoy * hpi_change_yoy) as wxx, sum(w * hpi_change_yoy * y) as wxy from {before}obs group by 1),
{before}lgdm as (select *, n < 20 or levels < 2 as is_fallback, case when n < 20 or levels < 2 then 0::double else (w * wxy - wx * wy) / (w * wxx - wx * wx) end as slope from {before}wls),
{before}coefs as (select score_band, n, case when is_fallback then 0.55::double else (wy - slope * wx) / w end as intercept, slope, is_fallback from {before}lgdm)"""


OBS = _obs_sql()


@query(f"with {L.ALL}, {OBS} select score_band, n, round(intercept, 5) as intercept, round(slope, 5) as slope, is_fallback from coefs")
def lgd_wls_coefficients(x: L.Lens) -> DataFrame:
    return _round(lgd.fit(lgd.observations(x.panel())), 5)


@query(f"""with {L.ALL}, {OBS} select case when substr(vintage, 1, 4)::int < 2008 then 'pre-2008' when substr(vintage, 1, 4)::int <= 2010 then '2008-2010' else '2011+' end as era, count(*) as defaults,
  round(sum((1 - y) * w) / sum(w), 5) as actual_lgd, round(sum(coalesce(1 - least(greatest(intercept + slope * hpi_change_yoy, 0), 1), 0.45) * w) / sum(w), 5) as predicted_lgd
from (select o.*, c.intercept, c.slope from obs o left join coefs c using (score_band)) group by 1""")
def lgd_validation(x: L.Lens) -> DataFrame:
    with L.kept(lgd.observations(x.panel()).select("score_band", "vintage", "hpi_change_yoy", "upb_bom", "recovery")) as rows:
        return L.local(_round(lgd.validation(rows, lgd.fit(rows), x.settings), 5))


# Segments, forecasts, expected loss -------------------------------------------------------------------------------

SEGS = f"""act as (
  select p.loan_id, p.score_band, p.vintage_year, delinquency_state, months_on_book, greatest(coalesce(upb_eom, upb_bom)::double, 0) as b, a.orig_interest_rate, a.original_term
  from panel p left join acq a using (loan_id) where as_of_month = date '{L.CUTOFF}' and (exit_reason is null or exit_reason not in ('ChargeOff', 'Prepaid', 'Repurchased', 'Censored'))),
pos as (select * from act where b > 0),
mix as (select score_band, vintage_year, delinquency_state, sum(b) as sb from pos group by all),
segs as (
  select score_band || '|' || cast(vintage_year as varchar) as segment_id, score_band, vintage_year, sum(b) as balance, count(*) as loans, cast(round_even(sum(b * months_on_book) / sum(b), 0) as integer) as start_mob,
    sum(b * orig_interest_rate) / sum(b) as annual_interest_rate, greatest(cast(round_even(sum(b * greatest(original_term - months_on_book, 1)) / sum(b), 0) as integer), 1) as remaining_term_months
  from pos group by score_band, vintage_year),
init as (select segment_id, delinquency_state as state, sb / balance as p from mix join segs using (score_band, vintage_year))"""


def _path_sql(matrix: str, f: str = "f", path: str = "path") -> str:
    """The pooled matrix carried over the horizon."""
    return f"""{f}(segment_id, month, state, p) as (
  select segment_id, 0, state, p from init
  union all
  select f.segment_id, f.month + 1, m.destination, sum(f.p * m.probability) from {f} f join {matrix} m on f.state = m.origin where f.month < {HORIZON} and m.probability > 0 group by 1, 2, 3),
{path} as (select s.segment_id, cast(t.month as integer) as month, z.state, coalesce(f.p, 0) as p from segs s cross join (select unnest(range(1, {HORIZON + 1})) as month) t cross join states z left join {f} f on f.segment_id = s.segment_id and f.month = t.month and f.state = z.state)"""


AMORT = f"""amort as (
  select segment_id, month, case when month - 1 >= n then 0 when r = 0 then b * (1 - (month - 1) / n) else b * (pow(1 + r / 12, n) - pow(1 + r / 12, month - 1)) / (pow(1 + r / 12, n) - 1) end as exposure
  from (select segment_id, balance as b, annual_interest_rate as r, remaining_term_months::double as n, cast(unnest(range(1, {HORIZON + 1})) as integer) as month from segs))"""
FORECAST = f"with recursive {L.ALL}, {CUBE}, {MATRIX}, {SEGS}, {_path_sql('matrix')}"

# A conditional model with stated coefficients, so that another engine can follow it: (origin, destination, lag, intercept,
# score risk, positive score risk, excess unemployment, three-month change, house prices). Fixed values of these queries.
COEFFICIENTS = [
    ("Current", "Current", 1, 2.6, -0.30, -0.20, -0.10, -0.20, 1.0),
    ("Current", "DPD30", 1, 0.4, 0.35, 0.25, 0.15, 0.20, -1.5),
    ("Current", "Prepaid", 1, -0.6, -0.10, -0.05, -0.08, -0.10, 2.0),
    ("DPD30", "Current", 0, 0.8, -0.20, -0.10, -0.05, -0.10, 0.8),
    ("DPD30", "DPD30", 0, 0.3, 0.05, 0.05, 0.02, 0.05, 0.1),
    ("DPD30", "DPD60", 0, 0.2, 0.20, 0.15, 0.10, 0.10, -0.9),
    ("DPD60", "DPD30", 3, 0.5, -0.15, -0.10, -0.06, -0.08, 0.6),
    ("DPD60", "DPD60", 3, 0.2, 0.02, 0.02, 0.01, 0.02, 0.0),
    ("DPD60", "DPD90", 3, 0.4, 0.15, 0.12, 0.08, 0.09, -0.7),
    ("DPD90", "DPD60", 6, 0.3, -0.12, -0.08, -0.05, -0.06, 0.5),
    ("DPD90", "DPD90", 6, 0.1, 0.01, 0.01, 0.01, 0.01, 0.0),
    ("DPD90", "DPD120", 6, 0.6, 0.12, 0.10, 0.07, 0.07, -0.6),
    ("DPD120", "DPD90", 1, 0.2, -0.10, -0.06, -0.04, -0.05, 0.4),
    ("DPD120", "DPD120", 1, 0.0, 0.0, 0.0, 0.01, 0.01, 0.0),
    ("DPD120", "DPD150", 1, 0.8, 0.10, 0.08, 0.06, 0.06, -0.5),
    ("DPD150", "DPD120", 0, 0.1, -0.08, -0.05, -0.03, -0.04, 0.3),
    ("DPD150", "DPD150", 0, -0.1, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("DPD150", "ChargeOff", 0, 1.1, 0.08, 0.06, 0.05, 0.05, -0.4),
]


def _timed(column: str) -> str:
    return "case lag when 0 then " + column + "".join(f" when {n} then {column}_lag_{n}" for n in L.SETTINGS.macro_lags) + " end"


def _model_sql(paths: str) -> str:
    """Matrices, default, exposure and loss by segment and month along paths: SQL of (scenario, step, macro columns)."""
    rows = ", ".join(f"('{o}', '{d}', {lag}, " + ", ".join(f"{v}::double" for v in values) + ")" for o, d, lag, *values in COEFFICIENTS)
    return f"""coef as (select * from (values {rows}) as v(origin, destination, lag, c0, cs, cp, cu, cd, ch)),
mpath as ({paths}),
risk as (select segment_id, score_band, least(greatest((700 - (cast(substr(score_band, 6, 3) as double) + cast(substr(score_band, 10, 3) as double)) / 2) / 100, -0.8), 1.8)::double as r from segs),
zs as (
  select scenario, segment_id, step, origin, destination, c0 + cs * r + cp * greatest(r, 0) + cu * greatest({_timed("unemployment_rate")} - {L.SETTINGS.unemployment_hinge}, 0) + cd * {_timed("unemployment_change_3m")} + ch * {_timed("hpi_change_yoy")} as z
  from risk cross join mpath cross join coef),
es as (select *, exp(z - max(z) over (partition by scenario, segment_id, step, origin)) as e from zs),
qs as (select *, e / sum(e) over (partition by scenario, segment_id, step, origin) as q from es),
hz as (select coalesce(sum(transition_count) filter (where delinquency_state like 'DPD%' and next_delinquency_state = 'Prepaid') / cast(sum(transition_count) filter (where delinquency_state like 'DPD%') as double), 0) as pre,
  coalesce(sum(transition_count) filter (where next_delinquency_state = 'Repurchased') / cast(sum(transition_count) as double), 0) as rep from cube where delinquency_state not in ('ChargeOff', 'Prepaid', 'Repurchased')),
live as (
  select scenario, segment_id, step, origin, destination, q * (1 - rep - case when origin <> 'Current' then pre else 0 end) as q from qs cross join hz
  union all select distinct scenario, segment_id, step, origin, 'Repurchased', rep from qs cross join hz
  union all select distinct scenario, segment_id, step, origin, 'Prepaid', pre from qs cross join hz where origin <> 'Current'),
cm as (
  select scenario, segment_id, step, origin, destination, sum(q) as p from live group by all
  union all select scenario, segment_id, step, state, state, 1.0::double from (select distinct scenario, segment_id, step from qs) cross join (values ('ChargeOff'), ('Prepaid'), ('Repurchased')) as v(state)),
cf(scenario, segment_id, month, state, p) as (
  select scenario, segment_id, 0, state, p from init cross join (select distinct scenario from mpath)
  union all
  select f.scenario, f.segment_id, f.month + 1, m.destination, sum(f.p * m.p) from cf f join cm m on m.scenario = f.scenario and m.segment_id = f.segment_id and m.step = f.month + 1 and m.origin = f.state where f.month < {HORIZON} group by 1, 2, 3, 4),
cpath as (
  select n.scenario, s.segment_id, cast(t.month as integer) as month, z.state, coalesce(f.p, 0) as p from segs s cross join (select distinct scenario from mpath) n cross join (select unnest(range(1, {HORIZON + 1})) as month) t cross join states z
  left join cf f on f.scenario = n.scenario and f.segment_id = s.segment_id and f.month = t.month and f.state = z.state),
mpd as (select scenario, segment_id, month, p - coalesce(lag(p) over (partition by scenario, segment_id order by month), (select max(i.p) from init i where i.segment_id = cpath.segment_id and i.state = 'ChargeOff'), 0) as marginal_pd from cpath where state = 'ChargeOff'),
{AMORT},
price as (select m.scenario, s.segment_id, m.step as month, coalesce(1 - least(greatest(c.intercept + c.slope * m.hpi_change_yoy, 0), 1), {L.SETTINGS.fallback_lgd}) as lgd from segs s cross join mpath m left join coefs c using (score_band)),
detail as (
  select d.scenario, s.segment_id, d.month, s.score_band, s.vintage_year, s.balance, marginal_pd, exposure, lgd, marginal_pd * balance as d, marginal_pd * exposure as e, marginal_pd * exposure * lgd as l,
    marginal_pd * exposure * lgd / pow({1 + L.SETTINGS.discount_rate}::double, d.month / 12.0::double) as ecl
  from mpd d join amort using (segment_id, month) join price p on p.scenario = d.scenario and p.segment_id = d.segment_id and p.month = d.month join segs s on s.segment_id = d.segment_id)"""


_OBSERVED = f"select 'observed' as scenario, cast((year(as_of_month) - {L.CUTOFF[:4]}) * 12 + month(as_of_month) - {int(L.CUTOFF[5:7])} as integer) as step, * from macro where as_of_month > date '{L.CUTOFF}' and as_of_month <= date '{L.CUTOFF}' + to_months({HORIZON})"
LOSS = f"with recursive {L.ALL}, {CUBE}, {MATRIX}, {SEGS}, {OBS}, {_model_sql(_OBSERVED)}"
PARTS = ("loan_id", "as_of_month", "vintage", "vintage_year", "months_on_book", "delinquency_state", "next_delinquency_state", "upb_bom", "upb_eom", "score_band", "net_sales_proceeds", "foreclosure_costs", "exit_reason", "is_censored", "hpi_change_yoy")
UNTIL = "2011-05-01"


class Parts:
    """The report-sized tables that forecasts start from, drawn from sums of one pass over the panel."""

    def __init__(self, x: L.Lens, *wanted: str):
        s = x.settings
        draw = {
            "segs": facts.segments,
            "matrix": lambda sums: transitions.matrix(facts.transition_counts(sums), s),
            "early_matrix": lambda sums: transitions.matrix(facts.transition_counts(sums, L.CUTOFF), s),
            "hazards": lambda sums: transitions.hazards(facts.transition_counts(sums), s),
            "coefs": lambda sums: facts.loss_fit(sums, s),
            "early_coefs": lambda sums: facts.loss_fit(sums, s, L.CUTOFF),
            "found": facts.realised,
            "ultimates": lambda sums: vintage.ultimates(vintage.project(vintage.curves(facts.triangle(sums, x.acquisition(), "quarterly", L.CUTOFF), L.MATURITY), L.MATURITY), L.MATURITY),
        }
        self.x = x
        with L.kept(facts.gather(x.panel("orig_interest_rate", "original_term"), L.CUTOFF, UNTIL, s)) as sums:
            self.tables = {w: L.local(draw[w](sums)) for w in wanted}

    def __getattr__(self, name: str) -> DataFrame:
        return self.tables[name]

    def pooled(self, table: DataFrame) -> DataFrame:
        """One matrix for every segment and month."""
        cells = table.select("origin", "destination", F.col("probability").alias("p"))
        return self.segs.select("segment_id", F.lit(1).alias("step")).crossJoin(F.broadcast(cells))  # states by states for each segment

    def model(self) -> conditional.ConditionalModel:
        """The model of COEFFICIENTS with the panel's pooled hazards."""
        s, sets = self.x.settings, conditional.candidates(self.x.settings)
        origins = {}
        for origin in dict.fromkeys(c[0] for c in COEFFICIENTS):
            own = [c for c in COEFFICIENTS if c[0] == origin]
            macros = sets[own[0][2]]
            features = ["score_risk", "score_risk_positive", f"{macros[0]}_excess", macros[1], macros[2]]
            origins[origin] = conditional.OriginModel(origin, [c[1] for c in own], {}, own[0][2], 0.0, macros, features, [c[1] for c in own], tuple(tuple(c[3:]) for c in own))
        h = self.hazards.first()
        return conditional.ConditionalModel(s, origins, h.repurchase, h.delinquent_prepay, dict.fromkeys([*macro.VALUES, *macro.lag_columns(s.macro_lags)], 0.0), [])

    def observed(self) -> DataFrame:
        """The macro months after the cutoff as a path (step, macro columns)."""
        cutoff = F.lit(L.CUTOFF).cast("date")
        rows = self.x.macro_features().withColumn("step", F.months_between("as_of_month", cutoff).cast("int"))
        return L.local(rows.where(F.col("step").between(1, HORIZON)))

    def detail(self, path: DataFrame | None = None) -> DataFrame:
        path = self.observed() if path is None else path
        return ecl.expected_loss(self.model().matrices(self.segs, path, HORIZON), self.coefs, self.segs, path, HORIZON, self.x.settings)


@query(f"with {L.ALL}, {SEGS} select loan_id, score_band, vintage_year, delinquency_state, months_on_book, b as exposure from act")
def active_at_cutoff(x: L.Lens) -> DataFrame:
    """The loans that a forecast from the cutoff holds."""
    rows = ecl.active_at(x.panel(), L.CUTOFF, x.settings)
    return rows.select("loan_id", "score_band", "vintage_year", "delinquency_state", "months_on_book", ecl.exposure().alias("exposure"))


@query(f"with {L.ALL}, {SEGS} select year(as_of_month) as year, count(*) as \"rows\", count(distinct loan_id) as loans from panel where loan_id in (select loan_id from act) group by 1")
def active_histories(x: L.Lens) -> DataFrame:
    """All months of those loans, by year."""
    rows = ecl.active_panel(x.panel().select(*PARTS), L.CUTOFF, x.settings)
    return rows.groupBy(F.year("as_of_month").alias("year")).agg(F.count("*").alias("rows"), F.countDistinct("loan_id").alias("loans"))


@query(f"""with {L.ALL}, {SEGS} select segment_id, score_band, vintage_year, round(balance, 2) as balance, loans, start_mob, round(annual_interest_rate, 6) as annual_interest_rate, remaining_term_months, state, round(p, 6) as p from segs join init using (segment_id)""")
def ecl_segments(x: L.Lens) -> DataFrame:
    segs = ecl.segments(ecl.active_at(x.panel(), L.CUTOFF, x.settings), x.acquisition())
    rows = segs.select(*[c for c in segs.columns if c != "initial_state"], F.explode("initial_state").alias("state", "p"))
    return _round(rows, balance=2)


@query(f"with {L.ALL}, {SEGS}, {AMORT} select segment_id, month, round(exposure, 2) as exposure from amort")
def amortization_schedule(x: L.Lens) -> DataFrame:
    return _round(ecl.amortization(ecl.segments(ecl.active_at(x.panel(), L.CUTOFF, x.settings), x.acquisition()), HORIZON), 2)


@query(f"{FORECAST} select segment_id, month, state, round(p, 6) as p from path")
def markov_forecast(x: L.Lens) -> DataFrame:
    """The empirical matrix, the same for every segment and month."""
    parts = Parts(x, "segs", "matrix")
    return _round(forecast.forecast(parts.segs, parts.pooled(parts.matrix), x.settings.states, HORIZON))


@query(f"{FORECAST} select p.month, p.state, round(sum(p.p * s.balance) / sum(s.balance), 6) as p, round(sum(s.balance), 2) as balance from path p join segs s using (segment_id) group by p.month, p.state")
def portfolio_forecast(x: L.Lens) -> DataFrame:
    parts = Parts(x, "segs", "matrix")
    return _round(forecast.portfolio(forecast.forecast(parts.segs, parts.pooled(parts.matrix), x.settings.states, HORIZON), parts.segs), balance=2)


@query(f"{LOSS} select segment_id, step, origin, destination, round(p, 6) as p from cm")
def conditional_matrix(x: L.Lens) -> DataFrame:
    """Each segment's matrix for each month ahead, by the model of COEFFICIENTS along the observed months."""
    parts = Parts(x, "segs", "hazards")
    return _round(parts.model().matrices(parts.segs, parts.observed(), HORIZON))


@query(f"{LOSS} select segment_id, month, state, round(p, 6) as p from cpath")
def conditional_forecast(x: L.Lens) -> DataFrame:
    parts = Parts(x, "segs", "hazards")
    return _round(forecast.forecast(parts.segs, parts.model().matrices(parts.segs, parts.observed(), HORIZON), x.settings.states, HORIZON))


@query(f"{LOSS} select segment_id, month, round(marginal_pd, 6) as marginal_pd, round(lgd, 6) as lgd, round(e, 0) as expected_default_exposure, round(ecl, 0) as ecl from detail")
def lifetime_ecl(x: L.Lens) -> DataFrame:
    rows = Parts(x, "segs", "hazards", "coefs").detail()
    return _round(rows.select("segment_id", "month", "marginal_pd", "lgd", "expected_default_exposure", "ecl"), expected_default_exposure=0, ecl=0)


@query(f"""{LOSS} select score_band, round(sum(case when month = 1 then balance else 0 end), 2) as balance, round(sum(d) / sum(case when month = 1 then balance else 0 end), 6) as pd, round(sum(e) / sum(d), 6) as ead_share, round(sum(l) / sum(e), 6) as lgd, round(sum(ecl), 0) as ecl from detail group by 1""")
def ecl_by_score_band(x: L.Lens) -> DataFrame:
    return _round(ecl.decompose(Parts(x, "segs", "hazards", "coefs").detail(), "score_band"), balance=2, ecl=0)


@query(f"""{LOSS}, m as (select month, sum(d) as d, sum(e) as e, sum(l) as l, sum(ecl) as ecl from detail group by 1)
select month, round(d, 0) as marginal_pd_dollars, round(e, 0) as expected_default_exposure, round(l, 0) as undiscounted_loss, round(ecl, 0) as ecl, round(sum(ecl) over (order by month rows unbounded preceding), 0) as cumulative_ecl from m""")
def ecl_monthly_path(x: L.Lens) -> DataFrame:
    return _round(ecl.monthly(Parts(x, "segs", "hazards", "coefs").detail()), 0)


# Scenarios --------------------------------------------------------------------------------------------------------

SCEN = """names as (select * from (values ('baseline', 0.0::double), ('adverse', 0.25::double), ('severe', 0.5::double)) as v(scenario, tilt)),
quarters as (
  select scenario, cast(2001 + (q + 2) // 4 as integer) as y, cast((q + 2) % 4 + 1 as integer) as k, 5.0::double + tilt * least(q, 8) as unemployment_rate, 200.0::double - tilt * 8 * least(q, 8) + q as house_price_index, q from names cross join range(0, 13) as r(q)),
hist as (select cast(2000 + (q + 2) // 4 as integer) as y, cast((q + 2) % 4 + 1 as integer) as k, 190.0::double + q as house_price_index, q - 4 as q from range(0, 4) as r(q))"""


def _published(x: L.Lens) -> DataFrame:
    """Three made-up scenarios from 2001-Q3, the quarter after the cutoff, with four quarters of history before."""
    q = x.spark.range(0, 13, 1, 1).withColumnRenamed("id", "q")
    names = x.spark.createDataFrame([("baseline", 0.0), ("adverse", 0.25), ("severe", 0.5)], "scenario string, tilt double")
    label = lambda first: F.concat((first + F.floor((F.col("q") + 2) / 4)).cast("int").cast("string"), F.lit("Q"), ((F.col("q") + 2) % 4 + 1).cast("int").cast("string"))
    low = F.least(F.col("q"), F.lit(8))
    ahead = names.crossJoin(F.broadcast(q)).select(F.lit(2001).alias("vintage_year"), "scenario", label(F.lit(2001)).alias("quarter"), (F.lit(5.0) + F.col("tilt") * low).alias("unemployment_rate"), (F.lit(200.0) - F.col("tilt") * 8 * low + F.col("q")).alias("house_price_index"))
    past = q.where("q < 4").select(F.lit(2001).alias("vintage_year"), F.lit("historical").alias("scenario"), label(F.lit(2000)).alias("quarter"), F.lit(5.0).alias("unemployment_rate"), (F.lit(190.0) + F.col("q")).alias("house_price_index"))
    return ahead.unionByName(past)


_TAIL = HORIZON - 39
SCENPATH = f"""{SCEN},
yoy as (
  select scenario, y, k, unemployment_rate, house_price_index / lag(house_price_index, 4) over (partition by scenario order by q) - 1 as hpi_change_yoy, q
  from (select scenario, y, k, unemployment_rate, house_price_index, q from quarters union all select scenario, hist.y, hist.k, 5.0, hist.house_price_index, hist.q from hist cross join names)),
months as (select scenario, cast(make_date(y, (k - 1) * 3 + 1, 1) + to_months(cast(i as integer)) as date) as as_of_month, unemployment_rate, hpi_change_yoy, true as is_published from yoy cross join range(3) as r(i) where q >= 0),
ends as (select scenario, max(as_of_month) as m, arg_max(unemployment_rate, as_of_month) as u, arg_max(hpi_change_yoy, as_of_month) as h from months group by 1),
longer as (
  select * from months union all
  select scenario, cast(m + to_months(cast(i as integer)) as date), 4.8::double + (u - 4.8::double) * pow(0.5::double, i / 24.0::double), 0.03::double + (h - 0.03::double) * pow(0.5::double, i / 24.0::double), false from ends cross join range(1, {_TAIL + 1}) as r(i)),
joined as (
  select *, unemployment_rate - lag(unemployment_rate, 3) over (partition by scenario order by as_of_month) as unemployment_change_3m
  from (select scenario, as_of_month, unemployment_rate, hpi_change_yoy, is_published, false as past from longer union all select scenario, as_of_month, unemployment_rate, hpi_change_yoy, null, true from series cross join names where as_of_month < date '2001-07-01' and as_of_month >= date '2000-07-01'))"""
_SCEN_LAGS = ", ".join(f"round(lag({c}, {n}) over (partition by scenario order by as_of_month), 6) as {c}_lag_{n}" for n in L.SETTINGS.macro_lags for c in macro.VALUES)


def _scenario_paths(x: L.Lens) -> DataFrame:
    monthly = scenarios.quarterly_to_monthly(scenarios.published(_published(x), 2001, 13))
    history = x.macro().where("as_of_month < date '2001-07-01' and as_of_month >= date '2000-07-01'")
    return scenarios.paths(scenarios.extend(monthly, 39 + _TAIL, x.settings), history, x.settings)


@query(f"with {L.MACRO_SQL}, {SCENPATH} select * exclude (past) from (select scenario, as_of_month, round(unemployment_rate, 6) as unemployment_rate, round(hpi_change_yoy, 6) as hpi_change_yoy, is_published, past, round(unemployment_change_3m, 6) as unemployment_change_3m, {_SCEN_LAGS} from joined) where not past")
def scenario_paths(x: L.Lens) -> DataFrame:
    return _round(_scenario_paths(x))


@query(f"""with {L.MACRO_SQL}, {SCENPATH} select scenario, count(*) as published_months, round(max(unemployment_rate), 6) as peak_unemployment, round(avg(cast(unemployment_rate > 7.25 as double)), 6) as share_above_cutoff_support, round(avg(cast(unemployment_rate > 9.86 as double)), 6) as share_above_history_support from longer where is_published group by 1""")
def extrapolation(x: L.Lens) -> DataFrame:
    return _round(scenarios.extrapolation(_scenario_paths(x), x.settings))


_TILTED = "tilted as (select origin, destination, case when origin = 'Current' and destination = 'DPD30' then probability + 0.1 when origin = 'Current' and destination = 'Current' then probability - 0.1 else probability end as probability from matrix)"


def _flow_sql(name: str, table: str) -> str:
    return f"{name}_path(segment_id, month, state, p) as (select segment_id, 0, state, p from init union all select f.segment_id, f.month + 1, m.destination, sum(f.p * m.probability) from {name}_path f join {table} m on f.state = m.origin where f.month < {HORIZON} and m.probability <> 0 group by 1, 2, 3), {name} as (select m.origin, m.destination, sum(s.balance * f.p * m.probability) as dollars from {name}_path f join {table} m on f.state = m.origin join segs s using (segment_id) where f.month < {HORIZON} group by 1, 2)"


@query(f"""with recursive {L.ALL}, {CUBE}, {MATRIX}, {SEGS}, {_TILTED}, {_flow_sql("fa", "tilted")}, {_flow_sql("fb", "matrix")}
select origin, destination, round(coalesce(fa.dollars, 0) - coalesce(fb.dollars, 0), 0) as dollars from fa full join fb using (origin, destination) where origin <> destination order by 3 desc, 1, 2 limit 3""")
def flow_attribution(x: L.Lens) -> DataFrame:
    """The three largest differences of flows when a tenth more of the current loans falls behind each month."""
    parts = Parts(x, "segs", "matrix")
    base = parts.pooled(parts.matrix).drop("step").select("*", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("step"))
    shift = F.when((F.col("origin") == "Current") & (F.col("destination") == "DPD30"), 0.1).when((F.col("origin") == "Current") & (F.col("destination") == "Current"), -0.1).otherwise(0.0)
    tilted = base.withColumn("p", F.col("p") + shift)
    flows = [scenarios.flows(forecast.forecast(parts.segs, m.where("step = 1"), x.settings.states, HORIZON), m, parts.segs) for m in (tilted, base)]
    return _round(scenarios.flow_attribution(*flows, top=3), 0)


_RAW_LAGS = ", ".join(f"lag({c}, {n}) over (partition by scenario order by as_of_month) as {c}_lag_{n}" for n in L.SETTINGS.macro_lags for c in macro.VALUES)
_SCENARIO_STEPS = f"select * exclude (past), cast((year(as_of_month) - {L.CUTOFF[:4]}) * 12 + month(as_of_month) - {int(L.CUTOFF[5:7])} as integer) as step from (select *, {_RAW_LAGS} from joined) where not past"
SCENARIO_LOSS = f"with recursive {L.ALL}, {CUBE}, {MATRIX}, {SEGS}, {OBS}, {SCENPATH}, {_model_sql(_SCENARIO_STEPS)}"


def _scenario_details(x: L.Lens) -> DataFrame:
    """lifetime() rows of every scenario, by the model of COEFFICIENTS."""
    parts = Parts(x, "segs", "hazards", "coefs")
    months = L.local(_scenario_paths(x).withColumn("step", F.months_between("as_of_month", F.lit(L.CUTOFF).cast("date")).cast("int")))
    out = None
    for name in ("baseline", "adverse", "severe"):
        own = parts.detail(months.where(F.col("scenario") == name).drop("scenario", "is_published")).withColumn("scenario", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""{SCENARIO_LOSS} select scenario, month, round(sum(l), 0) as undiscounted_loss, round(sum(ecl), 0) as ecl, round(sum(sum(ecl)) over (partition by scenario order by month rows unbounded preceding), 0) as cumulative_ecl from detail group by scenario, month""")
def scenario_losses(x: L.Lens) -> DataFrame:
    """Each scenario's loss by month."""
    return _round(scenarios.monthly(_scenario_details(x)), 0)


@query(f"""{SCENARIO_LOSS}, losses as (select scenario, sum(case when month = 1 then balance else 0 end) as balance, sum(ecl) as ecl from detail group by 1)
select scenario, round(balance, 2) as balance, round(ecl, 0) as ecl, round(ecl / balance, 6) as ecl_rate, round(ecl - (select ecl from losses where scenario = 'baseline'), 0) as ecl_over_baseline, round(ecl / (select ecl from losses where scenario = 'baseline'), 6) as ecl_multiple from losses""")
def scenario_summary(x: L.Lens) -> DataFrame:
    losses = L.local(ecl.decompose(_scenario_details(x), "scenario").select("scenario", "balance", "ecl"))
    return _round(scenarios.summary(losses), balance=2, ecl=0, ecl_over_baseline=0)


# Validation, reports, monitoring ----------------------------------------------------------------------------------

_FOUND = f"""found as (
  select year(p.as_of_month) as year, count(*) as k, sum(a.b) as rb, sum(upb_bom)::double as re, sum(greatest((upb_bom - coalesce(net_sales_proceeds, 0) + coalesce(foreclosure_costs, 0))::double, 0)) as rl
  from panel p join act a using (loan_id) where exit_reason = 'ChargeOff' and p.as_of_month > date '{L.CUTOFF}' and p.as_of_month <= date '{UNTIL}' group by 1)"""
_SHAPLEY = f"""proj as (select year(date '{L.CUTOFF}' + to_months(month)) as year, sum(d) as d, sum(e) as e, sum(l) as l from detail group by 1),
{_FOUND},
tot as (select sum(balance) as b from segs),
g as (select coalesce(cast(year as varchar), 'Total') as year, sum(coalesce(d, 0)) as d, sum(coalesce(e, 0)) as e, sum(coalesce(l, 0)) as l, sum(coalesce(rb, 0)) as rb, sum(coalesce(re, 0)) as re, sum(coalesce(rl, 0)) as rl from proj full join found using (year) group by rollup (year)),
x as (select *, coalesce(rb / nullif(b, 0), 0) as p0, coalesce(re / nullif(rb, 0), 0) as e0, coalesce(rl / nullif(re, 0), 0) as l0, coalesce(d / nullif(b, 0), 0) as p1, coalesce(e / nullif(d, 0), 0) as e1, coalesce(l / nullif(e, 0), 0) as l1 from g cross join tot)"""


@query(f"with {L.ALL}, {SEGS}, {_FOUND} select year, k as realised_defaults, round(rb, 0) as realised_default_balance, round(re, 0) as realised_exposure, round(rl, 0) as realised_loss from found")
def realised_losses(x: L.Lens) -> DataFrame:
    """What became of the loans active at the cutoff."""
    return _round(Parts(x, "found").found, 0)


@query(f"""{LOSS}, {_SHAPLEY} select year, round(l, 0) as projected_loss, round(rl, 0) as realised_loss, round(l - rl, 0) as error, round(b * (p1 - p0) * (2 * e0 * l0 + e0 * l1 + e1 * l0 + 2 * e1 * l1) / 6, 0) as pd_error,
  round(b * (e1 - e0) * (2 * p0 * l0 + p0 * l1 + p1 * l0 + 2 * p1 * l1) / 6, 0) as ead_error, round(b * (l1 - l0) * (2 * p0 * e0 + p0 * e1 + p1 * e0 + 2 * p1 * e1) / 6, 0) as lgd_error from x""")
def shapley_validation(x: L.Lens) -> DataFrame:
    parts = Parts(x, "segs", "hazards", "coefs", "found")
    balance = parts.segs.agg(F.sum("balance")).first()[0] or 0.0
    return _round(attribution.validate(attribution.by_year(parts.detail(), L.CUTOFF), parts.found, balance), 0)


@query(f"""{LOSS}, {TRI}, {CURVES}, {FACTORS}, {PROJECT},
one as (select u, u - o as f, b, l, e, (select sum(balance) from segs) as sb from (select sum(chain_ladder_ultimate * original_balance) as u, sum(observed_rate * original_balance) as o, sum(original_balance)::double as b from ult) cross join (select sum(l) as l, sum(ecl) as e from detail)),
lv as ({" union all ".join(f"""select {k} as "order", {_quoted(step)} as step, {_quoted(basis)} as basis, {level} as level, {rate} as loss_rate from one""" for k, ((step, basis), level, rate) in enumerate(zip(attribution.BRIDGE.items(), ("u", "f", "f", "l", "e"), ("u / b", "null", "null", "null", "e / sb"), strict=True), 1))})
select "order", step, basis, round(level - coalesce(lag(level) over (order by "order"), 0), 0) as amount, round(level, 0) as level, round(loss_rate, 6) as loss_rate from lv""")
def reconciliation_bridge(x: L.Lens) -> DataFrame:
    parts = Parts(x, "segs", "hazards", "coefs", "ultimates")
    balance = parts.segs.agg(F.sum("balance")).first()[0] or 0.0
    return _round(attribution.reconciliation(parts.ultimates, parts.detail(), balance), 0, loss_rate=6)


def _pooled_loss_sql(name: str, matrix: str, coefs: str) -> str:
    """The undiscounted loss under a pooled matrix."""
    return f"""{_path_sql(matrix, f"{name}_f", f"{name}_path")},
{name}_pd as (select segment_id, month, p - coalesce(lag(p) over (partition by segment_id order by month), (select max(i.p) from init i where i.segment_id = {name}_path.segment_id and i.state = 'ChargeOff'), 0) as marginal_pd from {name}_path where state = 'ChargeOff'),
{name} as (select sum(marginal_pd * exposure * coalesce(1 - least(greatest(c.intercept + c.slope * m.hpi_change_yoy, 0), 1), {L.SETTINGS.fallback_lgd})) as l from {name}_pd join amort using (segment_id, month) join segs s using (segment_id) join opath m on m.step = month left join {coefs} c using (score_band))"""


_EARLY_ONLY = f"as_of_month <= date '{L.CUTOFF}'"


_FITS = f"""with recursive {L.ALL}, {CUBE}, {MATRIX}, {_matrix_sql("e_", _EARLY_ONLY)}, {SEGS}, {OBS}, {_obs_sql("e_", f"and {_EARLY_ONLY}")}, {AMORT}, opath as ({_OBSERVED}), {_FOUND},
{_pooled_loss_sql("production", "matrix", "coefs")}, {_pooled_loss_sql("early", "e_matrix", "e_coefs")}, {TRI}, {CURVES}, {FACTORS}, {PROJECT},
real as (select coalesce(sum(rl), 0) as r from found),
fits as (select 'production' as fit, l as projected from production union all select 'cutoff', l from early union all select 'chain ladder', (select sum((chain_ladder_ultimate - observed_rate) * original_balance) from ult))"""


def _fits(x: L.Lens) -> DataFrame:
    """(fit, projected, realised): matrices and LGD fitted to all months and to those up to the cutoff, and the chain ladder."""
    parts = Parts(x, "segs", "matrix", "early_matrix", "coefs", "early_coefs", "found", "ultimates")
    path = parts.observed()
    real = parts.found.agg(F.coalesce(F.sum("realised_loss"), F.lit(0.0)).alias("realised"))
    fits = parts.ultimates.agg(F.sum((F.col("chain_ladder_ultimate") - F.col("observed_rate")) * F.col("original_balance")).alias("projected")).withColumn("fit", F.lit("chain ladder"))
    for name, table, coefs in (("production", parts.matrix, parts.coefs), ("cutoff", parts.early_matrix, parts.early_coefs)):
        detail = ecl.expected_loss(parts.pooled(table), coefs, parts.segs, path, HORIZON, x.settings)
        fits = fits.unionByName(detail.agg(F.sum("undiscounted_loss").alias("projected")).withColumn("fit", F.lit(name)))
    return L.local(fits.crossJoin(F.broadcast(real)).select("fit", "projected", "realised"))  # three rows by one


@query(f"""{_FITS},
b as (select abs(projected - r) as base from fits cross join real where fit = 'production')
select fit, round(projected, 0) as projected, round(r, 0) as realised, round(projected - r, 0) as error, round(100 * (projected - r) / r, 6) as error_percent, round(abs(projected - r) - base, 0) as leakage_gap, round(100 * (abs(projected - r) - base) / r, 6) as leakage_points from fits cross join real cross join b""")
def fit_comparison(x: L.Lens) -> DataFrame:
    """Three fits against what came."""
    return _round(attribution.compare(_fits(x)), 0, error_percent=6, leakage_points=6)


_SEEN = " ".join(f"when '{k}' then '{v}'" for k, v in attribution.PROVENANCE.items())


@query(f"""{_FITS},
g as (select r, (select abs(projected - r) from fits where fit = 'cutoff') - (select abs(projected - r) from fits where fit = 'production') as gap from real),
rows_ as (
  select 1 as "order", 'realised' as measure, 'the outcome' as provenance, 'none' as fit_end, r as loss, null::double as error, null::double as absolute_error, null::double as error_percent from real
  union all select case fit when 'cutoff' then 2 when 'production' then 3 else 4 end, fit, case fit {_SEEN} end, case fit when 'production' then 'all months' else '{L.CUTOFF}' end, projected, projected - r, abs(projected - r), 100 * (projected - r) / r from fits cross join real)
select "order", measure, provenance, fit_end, round(loss, 0) as loss, round(error, 0) as error, round(absolute_error, 0) as absolute_error, round(error_percent, 6) as error_percent, round(gap, 0) as leakage_gap, round(100 * gap / r, 6) as leakage_points from rows_ cross join g""")
def fit_provenance(x: L.Lens) -> DataFrame:
    """What came, and each fit with what it had seen of it."""
    return _round(attribution.comparison(_fits(x), L.CUTOFF), 0, error_percent=6, leakage_points=6)


@query(f"""with {L.ALL}, s as (select score_band as g, months_on_book::double as v, sum(upb_bom)::double as w from panel where upb_bom > 0 group by all),
o as (select g, v, (sum(w) over (partition by g order by v) - w / 2) / sum(w) over (partition by g) as pos from s),
n as (select *, lead(v) over (partition by g order by v) as v1, lead(pos) over (partition by g order by v) as pos1, lag(pos) over (partition by g order by v) is null as first_ from o),
a as (select *, unnest([0.1::double, 0.5::double, 0.9::double]) as q from n)
select g as score_band, q, round(case when pos1 is null or (first_ and q < pos) then v else v + (v1 - v) * (q - pos) / (pos1 - pos) end, 6) as value from a where (q >= pos and q < coalesce(pos1, 2)) or (first_ and q < pos)""")
def weighted_quantiles(x: L.Lens) -> DataFrame:
    return _round(monitoring.weighted_quantiles(x.panel(), "score_band", "months_on_book", "upb_bom", [0.1, 0.5, 0.9]))


@query(f"""with {L.ALL}, x as (select delinquency_state as g, upb_bom::double as v, (months_on_book + 1)::double as w from panel union all select 'all', upb_bom::double, (months_on_book + 1)::double from panel),
s as (select g, v, sum(w) as w from x group by all), o as (select g, v, (sum(w) over (partition by g order by v) - w / 2) / sum(w) over (partition by g) as pos from s),
n as (select *, lead(v) over (partition by g order by v) as v1, lead(pos) over (partition by g order by v) as pos1, lag(pos) over (partition by g order by v) is null as first_ from o),
a as (select *, unnest([0::double, 0.01::double, 0.25::double, 0.5::double, 0.75::double, 0.99::double, 1::double]) as q from n)
select g as delinquency_state, q, round(case when pos1 is null or (first_ and q < pos) then v else v + (v1 - v) * (q - pos) / (pos1 - pos) end, 3) as value from a where (q >= pos and q < coalesce(pos1, 2)) or (first_ and q < pos)""")
def balance_quantiles(x: L.Lens) -> DataFrame:
    """Balances by state and altogether, weighted by age: nearly every row has a value of its own."""
    rows = x.panel().select("upb_bom", (F.col("months_on_book") + 1).alias("weight"), F.explode(F.array("delinquency_state", F.lit("all"))).alias("delinquency_state"))
    return _round(quantiles.spread_quantiles(rows, "delinquency_state", "upb_bom", "weight", [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]), 3, q=2)


@query(f"""with {L.ALL}, x as (select score_band as g, unemployment_rate as v, upb_bom::double as w from panel where upb_bom > 0),
s as (select g, v, sum(w) as w from x group by all), o as (select g, v, (sum(w) over (partition by g order by v) - w / 2) / sum(w) over (partition by g) as pos from s),
n as (select *, lead(v) over (partition by g order by v) as v1, lead(pos) over (partition by g order by v) as pos1, lag(pos) over (partition by g order by v) is null as first_ from o),
a as (select *, unnest([0.1::double, 0.5::double, 0.9::double]) as q from n),
p as (select g, q, case when pos1 is null or (first_ and q < pos) then v else v + (v1 - v) * (q - pos) / (pos1 - pos) end as value from a where (q >= pos and q < coalesce(pos1, 2)) or (first_ and q < pos))
select x.g as score_band, round(sum(w), 2) as weight, round(sum(v * w) / sum(w), 5) as mean, round(sqrt(greatest(sum(v * v * w) / sum(w) - (sum(v * w) / sum(w)) * (sum(v * w) / sum(w)), 0)), 5) as deviation, min(v) as low, max(v) as high,
  round(any_value(p10), 5) as p10, round(any_value(p50), 5) as p50, round(any_value(p90), 5) as p90
from x join (select g, max(case when q = 0.1 then value end) as p10, max(case when q = 0.5 then value end) as p50, max(case when q = 0.9 then value end) as p90 from p group by g) p on x.g = p.g group by x.g""")
def macro_distribution(x: L.Lens) -> DataFrame:
    with L.kept(x.panel().select("score_band", "unemployment_rate", "upb_bom")) as rows:
        return L.local(_round(monitoring.distribution(rows, "score_band", "unemployment_rate", "upb_bom"), 5, weight=2))


@query(f"""with {L.ALL}, {CUBE}, cells as (select as_of_month, count(*) as cells, sum(transition_count) as moves from cube group by 1),
months as (select s.as_of_month, unemployment_rate as v, cells, moves, (select max(unemployment_rate) from series where as_of_month <= date '{L.CUTOFF}') as top from series s left join cells using (as_of_month)),
x as (
  select 'early calendar' as g, v, 1::double as w, 1 as k, top from months where as_of_month <= date '{L.CUTOFF}' union all select 'early transitions', v, moves::double, cells, top from months where as_of_month <= date '{L.CUTOFF}'
  union all select 'late calendar', v, 1::double, 1, top from months where as_of_month between date '2001-07-01' and date '2002-06-01' union all select 'late transitions', v, moves::double, cells, top from months where as_of_month between date '2001-07-01' and date '2002-06-01'
  union all select 'all transitions', v, moves::double, cells, top from months),
u as (select * from x where w > 0), s as (select g, v, sum(w) as w from u group by all),
o as (select g, v, (sum(w) over (partition by g order by v) - w / 2) / sum(w) over (partition by g) as pos from s),
n as (select *, lead(v) over (partition by g order by v) as v1, lead(pos) over (partition by g order by v) as pos1, lag(pos) over (partition by g order by v) is null as first_ from o),
a as (select *, unnest([{", ".join(f"{q}::double" for q in monitoring.SAMPLE_QUANTILES.values())}]) as q from n),
p as (select g, q, case when pos1 is null or (first_ and q < pos) then v else v + (v1 - v) * (q - pos) / (pos1 - pos) end as value from a where (q >= pos and q < coalesce(pos1, 2)) or (first_ and q < pos))
select u.g as sample, cast(sum(k) as bigint) as observations, sum(w) as total_weight, min(v) as minimum, {", ".join(f"round((select value from p where p.g = u.g and q = {q}), 6) as {name}" for name, q in monitoring.SAMPLE_QUANTILES.items())},
  max(v) as maximum, round(coalesce(sum(w) filter (where v > top), 0) / sum(w), 6) as share_above_early_maximum from u group by u.g""")
def macro_samples(x: L.Lens) -> DataFrame:
    """Unemployment up to the cutoff, in the year after it, and in all transitions."""
    return _round(monitoring.macro_samples(transitions.cube(x.panel()), x.macro(), L.CUTOFF, "2001-07-01", "2002-06-01"))


@query(f"""with {L.ALL}, e as (select score_band, count(*) / sum(count(*)) over ()::double as s from panel where vintage_year < 1998 group by 1), a as (select score_band, count(*) / sum(count(*)) over ()::double as s from panel where vintage_year >= 1998 group by 1),
j as (select score_band, greatest(coalesce(e.s, 0), 1e-6) as e, greatest(coalesce(a.s, 0), 1e-6) as a from e full join a using (score_band))
select score_band, round(e, 6) as expected_share, round(a, 6) as actual_share, round((a - e) * ln(a / e), 6) as psi from j""")
def population_stability(x: L.Lens) -> DataFrame:
    with L.kept(x.panel().select("score_band", "vintage_year")) as rows:
        return L.local(_round(monitoring.stability(rows.where("vintage_year < 1998"), rows.where("vintage_year >= 1998"), "score_band")))


@query(f"""with {L.ALL}, {CUBE}, {MATRIX}, m as (select as_of_month, cast(sum(transition_count) filter (where next_delinquency_state = 'ChargeOff') as bigint) as actual, sum(transition_count * probability) as projected from cube join matrix on origin = delinquency_state and destination = 'ChargeOff' group by 1),
z as (select as_of_month, coalesce(actual, 0) as actual, projected from m)
select as_of_month, round(sum(projected) over w, 4) as projected, cast(sum(actual) over w as bigint) as actual, round((sum(projected) over w - sum(actual) over w) / nullif(sum(actual) over w, 0)::double, 6) as error from z window w as (order by as_of_month rows 11 preceding)""")
def rolling_backtest_error(x: L.Lens) -> DataFrame:
    """Charge-offs that the pooled matrix expects of each month's accounts, against those that came, over twelve months."""
    states = ["as_of_month", "delinquency_state", "next_delinquency_state"]
    counts = L.local(transitions.cube(x.panel()).groupBy(*states).agg(F.sum("transition_count").alias("transition_count")))  # a row a month and pair of states
    rates = transitions.matrix(counts, x.settings).where("destination = 'ChargeOff'").select(F.col("origin").alias("delinquency_state"), "probability")
    monthly = counts.join(F.broadcast(rates), "delinquency_state").groupBy("as_of_month").agg(F.sum(F.col("transition_count") * F.col("probability")).alias("projected"), C.sum_if(F.col("next_delinquency_state") == "ChargeOff", "transition_count").alias("actual"))
    return _round(monitoring.rolling_error(monthly), projected=4)


def _conditional(x: L.Lens) -> conditional.ConditionalModel:
    with L.kept(transitions.cube(x.panel())) as counts:
        return conditional.fit(counts, x.macro_features(), replace(x.settings, maturity_mob=119))


@query()
def conditional_fit(x: L.Lens) -> DataFrame:
    return conditional.coefficient_table(x.spark, _conditional(x))


@query()
def bic_selection(x: L.Lens) -> DataFrame:
    return conditional.bic_table(x.spark, _conditional(x))


@query()
def macro_sensitivity(x: L.Lens) -> DataFrame:
    return conditional.sensitivity(x.spark, _conditional(x), ["FICO_660-699", "FICO_700-739"])


@query()
def parquet_layout(x: L.Lens) -> DataFrame:
    return tables.file_summary(x.spark, f"{x.dir}/lineitem.parquet")
