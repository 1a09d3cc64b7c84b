"""Vintage triangles, masked curves, development factors and projections to ultimate loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import joins

MEASURES = ("accounts_active", "chargeoff_accounts", "balance_active", "gross_chargeoff_dollars", "recovery_dollars", "net_chargeoff_dollars", "prepay_dollars", "repurchase_dollars")


class VintageError(RuntimeError):
    pass


def as_of(panel: DataFrame, cutoff: str | None) -> DataFrame:
    """Rows up to the cutoff; the year bound lets a table laid out by vintage year skip later vintages."""
    if cutoff is None:
        return panel
    return panel.where((F.col("as_of_month") <= F.lit(cutoff).cast("date")) & (F.col("vintage_year") <= int(cutoff[:4])))


def triangle(panel: DataFrame, acquisition: DataFrame, grain: str, cutoff: str | None = None) -> DataFrame:
    """(vintage, months_on_book, measures, original balance and accounts, max_observed_mob).

    Net charge-offs are floored at 0 here, at the grain of vintage and month. A cohort is observed up to the least of
    its constituent months' last ages. The panel is read once: what is added up by month of origination and age also
    tells each month's last age.
    """
    recovery = F.coalesce("net_sales_proceeds", F.lit(0)) - F.coalesce("foreclosure_costs", F.lit(0))
    cells = as_of(panel, cutoff).groupBy("vintage", "months_on_book", "exit_reason").agg(F.count("*").alias("n"), F.sum("upb_bom").alias("upb"), F.sum(recovery).alias("recovery"))
    return triangle_of(cells, acquisition, grain)


def triangle_of(sums: DataFrame, acquisition: DataFrame, grain: str) -> DataFrame:
    """triangle() from sums (vintage, months_on_book, exit_reason, n, upb, recovery) of the panel's rows; recovery counts for charge-offs."""
    off, money = F.col("exit_reason") == "ChargeOff", sums.schema["upb"].dataType
    cells = sums.groupBy("vintage", "months_on_book").agg(
        F.sum("n").alias("accounts_active"),
        F.coalesce(C.sum_if(off, "n"), F.lit(0)).alias("chargeoff_accounts"),
        F.sum("upb").cast(money).alias("balance_active"),
        C.sum_if(off, "upb").cast(money).alias("gross_chargeoff_dollars"),
        C.sum_if(off, "recovery").cast(sums.schema["recovery"].dataType).alias("recovery_dollars"),
        C.sum_if(F.col("exit_reason") == "Prepaid", "upb").cast(money).alias("prepay_dollars"),
        C.sum_if(F.col("exit_reason") == "Repurchased", "upb").cast(money).alias("repurchase_dollars"),
    )
    # From here on a row a month of origination and age.
    cohort = C.cohort(F.to_date(F.concat("vintage", F.lit("-01"))), grain)
    cells = cells.withColumn("cohort", cohort).withColumn("last", F.max("months_on_book").over(Window.partitionBy("vintage")))
    cells = cells.withColumn("max_observed_mob", F.min("last").over(Window.partitionBy("cohort")))
    added = [m for m in MEASURES if m != "net_chargeoff_dollars"]
    sums = cells.groupBy("cohort", "months_on_book", "max_observed_mob").agg(*[F.sum(m).cast(cells.schema[m].dataType).alias(m) for m in added])
    net = F.greatest(F.col("gross_chargeoff_dollars") - F.col("recovery_dollars"), F.lit(0))
    loans = acquisition.select(C.cohort("origination_month", grain).alias("cohort"), "original_upb")
    start = loans.groupBy("cohort").agg(F.sum("original_upb").alias("original_balance"), F.count("*").alias("original_accounts"))
    out = sums.withColumn("net_chargeoff_dollars", net).join(start, "cohort")
    return out.select(F.col("cohort").alias("vintage"), "months_on_book", *MEASURES, "original_balance", "original_accounts", "max_observed_mob")


def curves(tri: DataFrame, maturity: int, denominator: str = "original_balance") -> DataFrame:
    """Every (vintage, mob 0..maturity): cumulative net loss and its rate, null where not observed."""
    C.need(tri.columns, "vintage", "months_on_book", "net_chargeoff_dollars", "balance_active", "original_balance", "max_observed_mob")
    base = tri.groupBy("vintage").agg(F.max("original_balance").alias("original_balance"), F.max("max_observed_mob").alias("max_observed_mob"))
    grid = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(maturity))).alias("months_on_book"))
    cells = tri.select("vintage", "months_on_book", "net_chargeoff_dollars", "balance_active", F.lit(True).alias("_has"))
    full = grid.join(cells, ["vintage", "months_on_book"], "left")
    run = Window.partitionBy("vintage").orderBy("months_on_book").rowsBetween(Window.unboundedPreceding, 0)
    observed = F.col("months_on_book") <= F.col("max_observed_mob")
    bottom = F.col("original_balance") if denominator == "original_balance" else F.avg("balance_active").over(run)
    full = full.withColumns({"is_observed": observed, "_loss": F.sum(F.coalesce("net_chargeoff_dollars", F.lit(0))).over(run), "_base": bottom})
    return full.select(
        "vintage", "months_on_book", "original_balance", "max_observed_mob", "is_observed",
        F.when(observed, F.col("_loss").cast("double")).alias("cumulative_loss"),
        F.when(observed, C.ratio("_loss", "_base")).alias("cumulative_loss_rate"),
        (observed & F.col("_has").isNull()).alias("internal_gap"),
    )


def enforce_no_gaps(table: DataFrame) -> None:
    bad = table.where("internal_gap").limit(5).collect()
    if bad:
        raise VintageError(f"gaps inside the observed region: {[(r.vintage, r.months_on_book) for r in bad]}")


def enforce_seasoned(table: DataFrame, maturity: int) -> None:
    """Development needs a vintage that has been observed up to maturity."""
    if table.where(F.col("max_observed_mob") >= maturity).isEmpty():
        raise VintageError("no fully seasoned vintage to fit development on")


def development(table: DataFrame, maturity: int) -> DataFrame:
    """Volume-weighted age-to-age factors of completed vintages, at least 1: (months_on_book, factor, vintages).

    Each age meets the next one by lead(), in one sort. 0 over 0 is 1; a loss over 0 has no factor (null).
    """
    done = table.where(F.col("max_observed_mob") >= maturity)
    order = Window.partitionBy("vintage").orderBy("months_on_book")
    pairs = done.withColumn("_next", F.lead("cumulative_loss").over(order)).where("_next is not null")
    sums = pairs.groupBy("months_on_book").agg(F.sum("_next").alias("top"), F.sum("cumulative_loss").alias("bottom"), F.count("*").alias("vintages"))
    factor = F.when((F.col("bottom") == 0) & (F.col("top") == 0), 1.0).when(F.col("bottom") > 0, F.greatest(C.ratio("top", "bottom"), F.lit(1.0)))
    return sums.select("months_on_book", factor.alias("factor"), "vintages")


def average_curve(table: DataFrame, maturity: int) -> DataFrame:
    return table.where(F.col("max_observed_mob") >= maturity).groupBy("months_on_book").agg(F.avg("cumulative_loss_rate").alias("average_rate"))


def project(table: DataFrame, maturity: int) -> DataFrame:
    """curves() with average_rate, chain_ladder_rate and scaled_average_rate at every age.

    Beyond the last observed age a: the rate at a times the running product of development() factors, and the average
    curve scaled to the rate at a, never falling. Missing factors count as 1. Factors and averages are windows over the
    ages of completed vintages, so the table is read once.
    """
    done = F.col("max_observed_mob") >= maturity
    whole, age = Window.partitionBy("vintage"), Window.partitionBy("months_on_book")
    order = whole.orderBy("months_on_book")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    full = table.withColumn("_next", F.when(done, F.lead("cumulative_loss").over(order)))
    of_pairs = lambda c: F.sum(F.when(F.col("_next").isNotNull(), F.col(c))).over(age)
    full = full.withColumns({"_top": of_pairs("_next"), "_bottom": of_pairs("cumulative_loss"), "average_rate": F.avg(F.when(done, F.col("cumulative_loss_rate"))).over(age)})
    # The factor from an age to the next stands at the next one.
    factor = F.when(F.col("_bottom") > 0, F.greatest(C.ratio("_top", "_bottom"), F.lit(1.0))).otherwise(1.0)
    full = full.withColumn("_factor", F.coalesce(F.lag(factor).over(order), F.lit(1.0)))
    at_last = F.col("months_on_book") == F.col("max_observed_mob")
    # A vintage observed beyond maturity has its last observed age at maturity.
    at_last = at_last | ((F.col("max_observed_mob") > maturity) & (F.col("months_on_book") == maturity))
    full = full.withColumns({
        "_r": F.max(F.when(at_last, F.col("cumulative_loss_rate"))).over(whole),
        "_avg": F.max(F.when(at_last, F.col("average_rate"))).over(whole),
        "_grow": F.exp(F.sum(F.when(F.col("is_observed"), F.lit(0.0)).otherwise(F.ln("_factor"))).over(run)),
    })
    scale = F.when(F.col("_avg") > 0, F.col("_r") / F.col("_avg")).when(F.col("_r") == 0, 0.0).otherwise(1.0)
    scaled = F.when(F.col("is_observed"), F.when(at_last, F.col("_r"))).otherwise(F.greatest(F.coalesce("average_rate", F.lit(0.0)) * scale, F.col("_r")))
    return full.select(
        *table.columns, "average_rate",
        F.when(F.col("is_observed"), F.col("cumulative_loss_rate")).otherwise(F.col("_r") * F.col("_grow")).alias("chain_ladder_rate"),
        F.when(F.col("is_observed"), F.col("cumulative_loss_rate")).otherwise(F.max(scaled).over(run)).alias("scaled_average_rate"),
    )


def ultimates(projected: DataFrame, maturity: int) -> DataFrame:
    """(vintage, status, max_observed_mob, original_balance, last observed rate and both ultimates), in one grouped pass."""
    at_end = lambda c: F.max(F.when(F.col("months_on_book") == maturity, F.col(c))).alias(c)
    rows = projected.groupBy("vintage", "max_observed_mob", "original_balance").agg(F.max("cumulative_loss_rate").alias("observed_rate"), at_end("chain_ladder_rate"), at_end("scaled_average_rate"))
    return rows.select(
        "vintage", F.when(F.col("max_observed_mob") >= maturity, "Observed").otherwise("Projected").alias("status"), "max_observed_mob", "original_balance",
        "observed_rate", F.col("chain_ladder_rate").alias("chain_ladder_ultimate"), F.col("scaled_average_rate").alias("scaled_average_ultimate"),
    )


DENOMINATORS = ("original_balance", "average_outstanding")


def ultimate_table(tri: DataFrame, maturity: int) -> DataFrame:
    """ultimates() under both denominators side by side: names end in the denominator's."""
    both = None
    for name in DENOMINATORS:
        one = ultimates(project(curves(tri, maturity, name), maturity), maturity)
        rates = ("observed_rate", "chain_ladder_ultimate", "scaled_average_ultimate")
        one = one.select(*(["vintage"] if both is not None else ["vintage", "status", "max_observed_mob", "original_balance"]), *[F.col(c).alias(f"{c}_{name}") for c in rates])
        both = one if both is None else both.join(one, "vintage")
    return both


def backtest_pairs(early: DataFrame, later: DataFrame, maturity: int, method: str = "chain_ladder_ultimate") -> DataFrame:
    """(vintage, era, projected, actual) of the vintages projected early whose maturity the later triangle has observed."""
    done = later.where((F.col("max_observed_mob") >= maturity) & (F.col("months_on_book") <= maturity)).groupBy("vintage").agg(C.ratio(F.sum("net_chargeoff_dollars"), F.max("original_balance")).alias("actual"))
    rows = early.where("status = 'Projected'").join(done, "vintage")
    return rows.select("vintage", C.era(F.substring("vintage", 1, 4).cast("int")).alias("era"), F.col(method).alias("projected"), "actual")


METHODS = ("chain_ladder", "scaled_average")
ERAS = ("overall", "pre-2008", "2008-2010", "2011+")


def backtest_comparison(early: DataFrame, later: DataFrame, maturity: int, complete: bool = True) -> DataFrame:
    """Each vintage that ultimates() projected early, against what the later triangle has observed at maturity.

    (vintage, era, status, original_balance, both ultimates, both realised rates, and by method the error, its absolute and
    its share of the realised rate, null where that is 0). A projected vintage that is there twice fails the job, and one
    that is not observed at maturity does too, or else is left out if the comparison need not be complete.
    """
    at_end = lambda name: curves(later, maturity, name).where((F.col("months_on_book") == maturity) & F.col("is_observed"))
    one, other = (at_end(name).select("vintage", F.col("cumulative_loss_rate").alias(f"realised_rate_{name}")) for name in DENOMINATORS)
    realised = one.join(other, "vintage")
    rows = joins.checked(early.where("status = 'Projected'"), realised, ["vintage"], "projected vintages by realised ultimates", one_to_one=True, complete=complete)
    rows = rows.withColumn("era", C.era(F.substring("vintage", 1, 4).cast("int")))
    for m in METHODS:
        error = F.col(f"{m}_ultimate") - F.col("realised_rate_original_balance")
        rows = rows.withColumns({f"error_{m}": error, f"absolute_error_{m}": F.abs(error), f"absolute_percentage_error_{m}": C.ratio(F.abs(error), F.nullif("realised_rate_original_balance", F.lit(0.0)))})
    return rows


def backtest_metrics(rows: DataFrame) -> DataFrame:
    """(era, method, cohorts, mean_error, mean_absolute_error, mean_absolute_percentage_error, nonzero_cohorts) for all eras, empty ones too."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"error_{m}").alias("e"), F.col(f"absolute_percentage_error_{m}").alias("pct")) for m in METHODS])
    spread = rows.select(F.array(F.lit("overall"), F.col("era")).alias("eras"), F.explode(each).alias("x")).select(F.explode("eras").alias("era"), "x.*")
    sums = spread.groupBy("era", "method").agg(F.count("*").alias("cohorts"), F.avg("e").alias("mean_error"), F.avg(F.abs("e")).alias("mean_absolute_error"), F.avg("pct").alias("mean_absolute_percentage_error"), F.count("pct").alias("nonzero_cohorts"))
    every = rows.sparkSession.createDataFrame([(e, m) for e in ERAS for m in METHODS], "era string, method string")
    return every.join(sums, ["era", "method"], "left").na.fill(0, ["cohorts", "nonzero_cohorts"])


def portfolio_ultimate(table: DataFrame) -> DataFrame:
    weight = F.col("original_balance").cast("double")
    return table.agg(*[C.ratio(F.sum(F.col(c) * weight), F.sum(weight)).alias(c) for c in ("chain_ladder_ultimate", "scaled_average_ultimate")], F.count("*").alias("vintages"))


def decomposition(tri: DataFrame) -> DataFrame:
    """(vintage, frequency, exposure, severity, loss_rate): net loss over balance as accounts' share times relative exposure times severity."""
    sums = tri.groupBy("vintage").agg(F.sum("chargeoff_accounts").alias("k"), F.sum("gross_chargeoff_dollars").alias("g"), F.sum("net_chargeoff_dollars").alias("l"), F.max("original_balance").alias("b"), F.max("original_accounts").alias("n"))
    return sums.select(
        "vintage", C.ratio("k", "n").alias("frequency"), C.ratio(C.ratio("g", "k"), C.ratio("b", "n")).alias("exposure"), C.ratio("l", "g").alias("severity"), C.ratio("l", "b").alias("loss_rate")
    )


def enforce_decomposition(table: DataFrame, tolerance: float = 1e-9) -> None:
    product = F.col("frequency") * F.coalesce("exposure", F.lit(0.0)) * F.coalesce("severity", F.lit(0.0))
    if not table.where(F.abs(product - F.col("loss_rate")) > tolerance).isEmpty():
        raise VintageError("frequency, exposure and severity do not give the loss rate")


def backtest(pairs: DataFrame) -> DataFrame:
    """Mean error, mean absolute error and mean absolute percentage error of rows (era, projected, actual), by era and overall.

    Actuals of 0 take no part in the percentage.
    """
    error = F.col("projected") - F.col("actual")
    pairs = pairs.select("era", error.alias("e"), F.when(F.col("actual") != 0, F.abs(error) / F.abs("actual")).alias("pct"))
    out = pairs.rollup("era").agg(F.count("*").alias("vintages"), F.avg("e").alias("mean_error"), F.avg(F.abs("e")).alias("mean_absolute_error"), F.avg("pct").alias("mean_absolute_percentage_error"))
    return out.withColumn("era", F.coalesce("era", F.lit("overall")))


def lgd_by_era(panel: DataFrame) -> DataFrame:
    """Charge-offs by era: accounts, balance, loss floored at 0 for each loan, and their ratio."""
    bad = panel.where("exit_reason = 'ChargeOff'")
    net = F.greatest(F.col("upb_bom") - F.coalesce("net_sales_proceeds", F.lit(0)) + F.coalesce("foreclosure_costs", F.lit(0)), F.lit(0))
    sums = bad.groupBy(C.era("vintage_year").alias("era")).agg(F.count("*").alias("accounts"), F.sum("upb_bom").alias("balance"), F.sum(net).alias("loss"))
    return sums.select("era", "accounts", F.col("balance").cast("double").alias("balance"), F.col("loss").cast("double").alias("loss"), C.ratio("loss", "balance").alias("lgd"))


def enforce_crisis_order(table: DataFrame) -> None:
    """The mean ultimate of 2006 to 2008 must exceed that of 2011 and later."""
    year = F.substring("vintage", 1, 4).cast("int")
    row = table.agg(F.avg(F.when(year.between(2006, 2008), F.col("chain_ladder_ultimate"))).alias("a"), F.avg(F.when(year >= 2011, F.col("chain_ladder_ultimate"))).alias("b")).first()
    if row.a is None or row.b is None or row.a <= row.b:
        raise VintageError(f"2006-2008 ultimates ({row.a}) do not exceed those of 2011 and later ({row.b})")
