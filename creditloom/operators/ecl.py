"""Lifetime expected loss: segments at a cutoff, contractual balances, and the product of default, exposure and loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import forecast, lgd


class EclError(RuntimeError):
    pass


def needed(column: str, what: str) -> Column:
    """The column, whose absence in a row that is used fails the job."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(what)))


def exposure() -> Column:
    """Balance at the month's end, else at its begin, never below 0; a row with neither fails the job."""
    known = F.coalesce(F.col("upb_eom").cast("double"), F.col("upb_bom").cast("double"), F.raise_error(F.lit("exposure is missing from both upb_eom and upb_bom")).cast("double"))
    return F.greatest(known, F.lit(0.0))


def is_active(cutoff: str, s: Settings) -> Column:
    gone = F.coalesce(F.col("exit_reason").isin(*s.absorbing, "Censored"), F.lit(False))
    return (F.col("as_of_month") == F.lit(cutoff).cast("date")) & ~gone


def active_at(panel: DataFrame, cutoff: str, s: Settings) -> DataFrame:
    """Rows of the loans seen in the cutoff month itself that neither exit nor are censored in it. A filter, without a shuffle."""
    return panel.where(is_active(cutoff, s))


def active_panel(panel: DataFrame, cutoff: str, s: Settings) -> DataFrame:
    """All months of the loans that are active at the cutoff."""
    return panel.join(active_at(panel, cutoff, s).select("loan_id"), "loan_id", "left_semi")


def segments(active: DataFrame, terms: DataFrame, by: tuple[str, ...] = ("score_band", "vintage_year")) -> DataFrame:
    """(segment_id, keys, balance, loans, start_mob, annual_interest_rate, remaining_term_months, initial_state).

    terms: (loan_id, orig_interest_rate, original_term). Averages weigh by balance; months are rounded half to even, and
    a loan has a month left at least. Fails where an active loan has no terms, several, or no value in a key.
    """
    several = F.when(F.count("*") > 1, F.raise_error(F.lit("a loan has several acquisition rows")).cast("double"))
    one = terms.groupBy("loan_id").agg(F.coalesce(several, F.first("orig_interest_rate").cast("double")).alias("orig_interest_rate"), F.first("original_term").alias("original_term"))
    rows = active.select("loan_id", "delinquency_state", "months_on_book", "upb_bom", "upb_eom", *by).withColumn("b", exposure()).where("b > 0").join(one, "loan_id", "left")
    measures = [F.sum(x).alias(name) for name, x in snapshot(F.col("b")).items()]
    return segments_of(rows.groupBy(*by, "delinquency_state").agg(*measures), by)


def snapshot(b: Column) -> dict[str, Column]:
    """What segments_of() needs of an active row with its terms and an exposure above 0, to be added up."""
    lacking = "the snapshot lacks acquisition terms"
    left = F.greatest(needed("original_term", lacking) - F.col("months_on_book"), F.lit(1))
    return {"sb": b, "n": F.lit(1), "r": b * needed("orig_interest_rate", lacking), "m": b * F.col("months_on_book"), "t": b * left}


def segments_of(sums: DataFrame, by: tuple[str, ...] = ("score_band", "vintage_year")) -> DataFrame:
    """segments() from rows (keys, delinquency_state and sums of snapshot()), several of the same keys and state or one."""
    keys = [needed(c, f"an active loan has no {c}").alias(c) for c in by]
    states = sums.groupBy(*keys, "delinquency_state").agg(*[F.sum(c).alias(c) for c in ("sb", "n", "r", "m", "t")])
    one = states.groupBy(*by).agg(
        F.sum("sb").alias("balance"), F.sum("n").alias("loans"), F.sum("r").alias("r"), F.sum("m").alias("m"), F.sum("t").alias("t"), F.map_from_entries(F.collect_list(F.struct("delinquency_state", "sb"))).alias("mix")
    )
    total = F.col("balance")
    return one.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in by]).alias("segment_id"), *by, "balance", "loans", F.bround(F.col("m") / total).cast("int").alias("start_mob"),
        (F.col("r") / total).alias("annual_interest_rate"), F.greatest(F.bround(F.col("t") / total).cast("int"), F.lit(1)).alias("remaining_term_months"), F.transform_values("mix", lambda _, v: v / F.col("balance")).alias("initial_state"),
    )


def enforce_balance(segs: DataFrame, active: DataFrame, tolerance: float = 0.01) -> None:
    """The segments hold the whole balance of the active loans, and there is one."""
    inside, outside = segs.agg(F.sum("balance")).first()[0], active.select(exposure().alias("b")).agg(F.sum("b")).first()[0]
    if not inside or abs(inside - outside) > tolerance:
        raise EclError(f"segments hold {inside} of the snapshot's {outside}")


def amortization(segs: DataFrame, horizon: int) -> DataFrame:
    """(segment_id, month 1..horizon, exposure): the contractual balance at the begin of each month of a level-pay loan."""
    k, n = (F.col("month") - 1).cast("double"), F.col("remaining_term_months").cast("double")
    rate = F.col("annual_interest_rate") / 12
    b = F.col("balance").cast("double")
    grow = F.pow(1 + rate, n)
    level = b * F.try_divide(grow - F.pow(1 + rate, k), grow - 1)
    left = F.when(k >= n, 0.0).when(F.col("annual_interest_rate") == 0, b * (1 - F.try_divide(k, n))).otherwise(level)
    return segs.select("segment_id", "balance", "annual_interest_rate", "remaining_term_months", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("month")).select("segment_id", "month", left.alias("exposure"))


def lifetime(segs: DataFrame, marginal: DataFrame, severity: DataFrame, horizon: int, discount_rate: float) -> DataFrame:
    """(segment_id, month, keys, marginal_pd, exposure, lgd, expected_default_exposure, undiscounted_loss, ecl).

    severity: (segment_id, month, lgd), or (segment_id, lgd) for one that does not change. Month t is discounted t / 12 years.
    """
    keys = [c for c in ("score_band", "vintage_year") if c in segs.columns]
    on = ["segment_id", "month"] if "month" in severity.columns else ["segment_id"]
    rows = marginal.join(amortization(segs, horizon), ["segment_id", "month"]).join(severity, on).join(segs.select("segment_id", F.col("balance").cast("double").alias("balance"), *keys), "segment_id")
    default = F.col("marginal_pd") * F.col("exposure")
    loss = default * F.col("lgd")
    return rows.select(
        "segment_id", "month", *keys, "balance", "marginal_pd", "exposure", "lgd", (F.col("marginal_pd") * F.col("balance")).alias("marginal_pd_dollars"),
        default.alias("expected_default_exposure"), loss.alias("undiscounted_loss"), (loss / F.pow(F.lit(1.0 + discount_rate), F.col("month") / 12.0)).alias("ecl"),
    )


def expected_loss(matrices: DataFrame, coefs: DataFrame, segs: DataFrame, path: DataFrame, horizon: int, s: Settings, check: bool = False) -> DataFrame:
    """lifetime() rows by a forecast's matrices and lgd.fit() coefficients, along a macro path (step, macro columns).

    check: the starting vectors and the forecast are looked through first.
    """
    states = forecast.forecast(segs, matrices, s.states, horizon)
    if check:
        forecast.enforce_initial(segs, s.states)
        forecast.enforce(states)
    prices = segs.select("segment_id", "score_band").crossJoin(F.broadcast(path.select(F.col("step").alias("month"), "hpi_change_yoy")))  # a segment by the horizon's months
    losses = lgd.predict(prices, coefs, s).select("segment_id", "month", "lgd")
    return lifetime(segs, forecast.marginal_default(states, segs), losses, horizon, s.discount_rate)


def decompose(detail: DataFrame, *by: str) -> DataFrame:
    """(by, balance, pd, ead_share, lgd, ecl): each ratio over its own sums."""
    opening = F.sum(F.when(F.col("month") == 1, F.col("balance")).otherwise(0.0))
    sums = detail.groupBy(*by).agg(
        opening.alias("balance"), F.sum("marginal_pd_dollars").alias("d"), F.sum("expected_default_exposure").alias("e"), F.sum("undiscounted_loss").alias("l"), F.sum("ecl").alias("ecl")
    )
    return sums.select(*by, "balance", C.ratio("d", "balance").alias("pd"), C.ratio("e", "d").alias("ead_share"), C.ratio("l", "e").alias("lgd"), "ecl")


def monthly(detail: DataFrame) -> DataFrame:
    """(month, sums, cumulative discounted loss); a row a month of the horizon."""
    sums = detail.groupBy("month").agg(*[F.sum(c).alias(c) for c in ("marginal_pd_dollars", "expected_default_exposure", "undiscounted_loss", "ecl")])
    return sums.withColumn("cumulative_ecl", F.sum("ecl").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))
