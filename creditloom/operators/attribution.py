"""Forecast errors: against realised losses by year, shared out among default, exposure and loss, and bridged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.functions import columns as C
from creditloom.operators import joins
from creditloom.operators.ecl import exposure


class AttributionError(RuntimeError):
    pass


def shapley(balance: Column, p0: Column, e0: Column, l0: Column, p1: Column, e1: Column, l1: Column) -> tuple[Column, Column, Column]:
    """Shares of balance * (p1 e1 l1 - p0 e0 l0) that do not depend on the order in which the three are changed."""
    share = lambda d, a0, b0, a1, b1: balance * d * (2 * a0 * b0 + a0 * b1 + a1 * b0 + 2 * a1 * b1) / 6
    return share(p1 - p0, e0, l0, e1, l1), share(e1 - e0, p0, l0, p1, l1), share(l1 - l0, p0, e0, p1, e1)


def realised(panel: DataFrame, active: DataFrame, cutoff: str, until: str | None = None) -> DataFrame:
    """(year, realised_defaults and sums) of the active loans' charge-offs after the cutoff, up to the month until.

    Each loan's loss is floored at 0. Charge-offs of loans that were not active are none of the forecast's; one of an active
    loan without exposure at the cutoff fails the job, and so does a loan that is active twice.
    """
    start = active.select("loan_id", exposure().alias("start_balance"))
    bad = panel.where((F.col("exit_reason") == "ChargeOff") & (F.col("as_of_month") > F.lit(cutoff).cast("date")))
    if until is not None:
        bad = bad.where(F.col("as_of_month") <= F.lit(until).cast("date"))
    bad = bad.select("loan_id", "as_of_month", "upb_bom", "net_sales_proceeds", "foreclosure_costs")
    bad = joins.checked(bad, start, ["loan_id"], "realised losses by snapshot", complete=False)
    return bad.groupBy(F.year("as_of_month").alias("year")).agg(*[F.sum(x).alias(name) for name, x in outcome(F.col("start_balance")).items()])


def outcome(start: Column) -> dict[str, Column]:
    """What came of an active loan in the row of its charge-off, to be added up, by its balance at the cutoff."""
    held = F.when(start > 0, start).otherwise(F.raise_error(F.lit("a realised default is absent from the snapshot")).cast("double"))
    loss = F.greatest((F.col("upb_bom") - F.coalesce("net_sales_proceeds", F.lit(0)) + F.coalesce("foreclosure_costs", F.lit(0))).cast("double"), F.lit(0.0))
    return {"realised_defaults": F.lit(1), "realised_default_balance": held, "realised_exposure": F.col("upb_bom").cast("double"), "realised_loss": loss}


def by_year(detail: DataFrame, cutoff: str) -> DataFrame:
    """ecl.lifetime() rows added up by the calendar year of their months: validate()'s projected side."""
    year = F.year(F.add_months(F.lit(cutoff).cast("date"), F.col("month")))
    return detail.groupBy(year.alias("year")).agg(*[F.sum(c).alias(c) for c in ("marginal_pd_dollars", "expected_default_exposure", "undiscounted_loss")])


def validate(projected: DataFrame, found: DataFrame, balance: float) -> DataFrame:
    """Rows by year, and 'Total': projected and realised loss, the error, and its shares for default, exposure and loss.

    projected: (year, marginal_pd_dollars, expected_default_exposure, undiscounted_loss); found: realised().
    """
    zero = F.lit(0.0)
    both = projected.join(found, "year", "full")
    names = ("marginal_pd_dollars", "expected_default_exposure", "undiscounted_loss", "realised_default_balance", "realised_exposure", "realised_loss")
    sums = both.rollup("year").agg(*[F.sum(F.coalesce(c, zero)).alias(c) for c in names])
    one = lambda a, b: F.coalesce(C.ratio(a, b), zero)
    b = F.lit(float(balance))
    parts = shapley(
        b, one("realised_default_balance", b), one("realised_exposure", "realised_default_balance"), one("realised_loss", "realised_exposure"),
        one("marginal_pd_dollars", b), one("expected_default_exposure", "marginal_pd_dollars"), one("undiscounted_loss", "expected_default_exposure"),
    )
    return sums.select(
        F.coalesce(F.col("year").cast("string"), F.lit("Total")).alias("year"), F.col("undiscounted_loss").alias("projected_loss"), "realised_loss",
        (F.col("undiscounted_loss") - F.col("realised_loss")).alias("error"), *[x.alias(n) for x, n in zip(parts, ("pd_error", "ead_error", "lgd_error"), strict=True)],
    )


def enforce(table: DataFrame, tolerance: float = 1e-6) -> None:
    off = F.abs(F.col("error") - F.col("pd_error") - F.col("ead_error") - F.col("lgd_error"))
    if not table.where(off > tolerance * F.greatest(F.abs("error"), F.lit(1.0))).isEmpty():
        raise AttributionError("shares do not add up to the error")


def bridge(steps: DataFrame) -> DataFrame:
    """(order, step, amount, level) from one total to another: amounts are differences of the levels (order, step, level), the last row the end."""
    w = Window.orderBy("order")  # a handful of report lines
    return steps.select("order", "step", (F.col("level") - F.coalesce(F.lag("level").over(w), F.lit(0.0))).alias("amount"), "level")


#: The steps, and what each rests on.
BRIDGE = {
    "chain-ladder ultimate": "realised and projected loss of all cohorts, undiscounted",
    "less losses realised before the cutoff": "net losses observed up to the cutoff",
    "restriction to surviving exposure": "none: once realised losses are out, loans that have left hold no future loss",
    "roll-rate model against the ladder's remainder": "undiscounted loss of the conditional model less the ladder's future loss",
    "discounting": "expected loss at the discount rate less the undiscounted one",
}


def reconciliation(ultimates: DataFrame, detail: DataFrame, balance: float) -> DataFrame:
    """From the chain ladder's ultimate loss to the lifetime expected loss: (order, step, basis, amount, level, loss_rate).

    ultimates: vintage.ultimates(); detail: ecl.lifetime(); balance: the segments'. What is left of the ultimate after the
    realised losses is the ladder's future loss; loans that have left have none, so survival takes no step of its own.
    """
    money = lambda c: F.coalesce(F.sum(F.col(c) * F.col("original_balance").cast("double")), F.lit(0.0))
    ladder = ultimates.agg(money("chain_ladder_ultimate").alias("u"), money("observed_rate").alias("o"), F.sum(F.col("original_balance").cast("double")).alias("b"))
    model = detail.agg(F.sum("undiscounted_loss").alias("l"), F.sum("ecl").alias("e"))
    one = ladder.crossJoin(F.broadcast(model))  # one row by one row
    future, null = F.col("u") - F.col("o"), F.lit(None).cast("double")
    levels = (F.col("u"), future, future, F.col("l"), F.col("e"))
    rates = (C.ratio("u", "b"), null, null, null, C.ratio("e", F.lit(float(balance))))
    lines = [F.struct(F.lit(k).alias("order"), F.lit(name).alias("step"), level.alias("level"), rate.alias("loss_rate")) for k, (name, level, rate) in enumerate(zip(BRIDGE, levels, rates, strict=True), 1)]
    steps = one.select(F.explode(F.array(*lines)).alias("x")).select("x.*")
    basis = F.coalesce(*[F.when(F.col("step") == k, F.lit(v)) for k, v in BRIDGE.items()])
    return bridge(steps.drop("loss_rate")).join(steps.select("order", "loss_rate", basis.alias("basis")), "order")


def compare(fits: DataFrame) -> DataFrame:
    """(fit, projected, realised) with the error, its percentage, and each fit's gap to the absolute error of 'production'."""
    error = F.col("projected") - F.col("realised")
    base = fits.where("fit = 'production'").select(F.abs(error).alias("base"))
    out = fits.crossJoin(F.broadcast(base)).withColumn("error", error)
    gap = F.abs("error") - F.col("base")
    return out.select("fit", "projected", "realised", "error", (100 * C.ratio("error", "realised")).alias("error_percent"), gap.alias("leakage_gap"), (100 * C.ratio(gap, "realised")).alias("leakage_points"))


#: What each fit may have seen of the months that it is judged by.
PROVENANCE = {"cutoff": "months up to the cutoff", "production": "all months, those judged by too", "chain ladder": "triangle up to the cutoff"}


def comparison(fits: DataFrame, cutoff_end: str, production_end: str | None = None) -> DataFrame:
    """Realised loss and the three fits (fit, projected, realised): (order, measure, provenance, fit_end, loss, error, absolute_error, error_percent, leakage_gap, leakage_points).

    The realised row has no error. The gap, the same in each row, is by how much the cutoff fit is further off than the
    production fit, which knows the outcome.
    """
    ends = {"cutoff": cutoff_end, "production": production_end or "all months", "chain ladder": cutoff_end}
    pick = lambda table: F.coalesce(*[F.when(F.col("fit") == k, F.lit(v)) for k, v in table.items()])
    order = pick({"cutoff": 2, "production": 3, "chain ladder": 4})
    off = lambda name: F.max(F.when(F.col("fit") == name, F.abs(F.col("projected") - F.col("realised"))))
    gap = fits.agg((off("cutoff") - off("production")).alias("leakage_gap"), F.max("realised").alias("all_realised"))
    error, null = F.col("projected") - F.col("realised"), F.lit(None).cast("double")
    rows = fits.select(order.alias("order"), F.col("fit").alias("measure"), pick(PROVENANCE).alias("provenance"), pick(ends).alias("fit_end"), F.col("projected").alias("loss"), error.alias("error"), F.abs(error).alias("absolute_error"), (100 * C.ratio(error, "realised")).alias("error_percent"))
    truth = gap.select(F.lit(1).alias("order"), F.lit("realised").alias("measure"), F.lit("the outcome").alias("provenance"), F.lit("none").alias("fit_end"), F.col("all_realised").alias("loss"), null.alias("error"), null.alias("absolute_error"), null.alias("error_percent"))
    both = truth.unionByName(rows).crossJoin(F.broadcast(gap))  # four rows by one
    return both.select(*rows.columns, "leakage_gap", (100 * C.ratio("leakage_gap", "all_realised")).alias("leakage_points"))
