"""All that forecasts from a cutoff start from, added up in one pass over the panel, without its rows being kept.

A row a month of origination, age, state, next state and exit; by score band too where a band counts, in charge-offs and
in the cutoff's snapshot. So the rows are bounded by the calendar and the states, not by the loans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import attribution, ecl, lgd, transitions, vintage

KEYS = ("vintage", "vintage_year", "as_of_month", "months_on_book", "hpi_change_yoy", "delinquency_state", "next_delinquency_state", "exit_reason", "is_censored")


def gather(panel: DataFrame, cutoff: str, until: str, s: Settings) -> DataFrame:
    """The sums of a panel that carries orig_interest_rate and original_term.

    What a loan was at the cutoff stands beside its later rows by a window over the loan, which lies together already. A loan
    that is active twice fails the job, and so does an active loan's charge-off without exposure at the cutoff.
    """
    loan, active = Window.partitionBy("loan_id"), F.coalesce(ecl.is_active(cutoff, s), F.lit(False))
    rows = panel.withColumns({"_active": active, "_times": F.count_if(active).over(loan), "_start": F.max(F.when(active, ecl.exposure())).over(loan)})
    once = F.when(F.col("_times") > 1, F.raise_error(F.lit("a loan is active twice at the cutoff")).cast("double")).otherwise(F.col("_start"))
    rows = rows.withColumn("_start", F.when(F.col("_times") > 0, once))
    off, start, balance = F.col("exit_reason") == "ChargeOff", F.col("_start"), F.col("upb_bom").cast("double")
    net = F.coalesce("net_sales_proceeds", F.lit(0)) - F.coalesce("foreclosure_costs", F.lit(0))
    known = off & (F.col("upb_bom") > 0)
    held = F.col("_active") & (start > 0)
    later = off & (F.col("as_of_month") > F.lit(cutoff).cast("date")) & (F.col("as_of_month") <= F.lit(until).cast("date")) & (F.col("_times") > 0)
    return rows.groupBy(*KEYS, F.when(off | F.col("_active"), F.col("score_band")).alias("score_band")).agg(
        F.count("*").alias("n"), F.sum("upb_bom").alias("upb"), C.sum_if(off, net).alias("recovery"),
        F.count_if(known).alias("observed"), C.sum_if(known, balance).alias("w"), C.sum_if(known, balance * lgd.recovery()).alias("wy"),
        *[C.sum_if(held, x).alias(f"active_{name}") for name, x in ecl.snapshot(start).items()],
        *[C.sum_if(later, x).alias(name) for name, x in attribution.outcome(start).items()],
    )


def _until(facts: DataFrame, end: str | None) -> DataFrame:
    return facts if end is None else facts.where(F.col("as_of_month") <= F.lit(end).cast("date"))


def segments(facts: DataFrame) -> DataFrame:
    """ecl.segments() by score band and year."""
    return ecl.segments_of(facts.where("active_n > 0").select("score_band", "vintage_year", "delinquency_state", *[F.col(f"active_{c}").alias(c) for c in ("sb", "n", "r", "m", "t")]))


def transition_counts(facts: DataFrame, end: str | None = None) -> DataFrame:
    return transitions.observed(_until(facts, end)).groupBy("delinquency_state", "next_delinquency_state").agg(F.sum("n").alias("transition_count"))


def loss_fit(facts: DataFrame, s: Settings, end: str | None = None) -> DataFrame:
    """lgd.fit() of the charge-offs."""
    rows = _until(facts, end).where("observed > 0")
    return lgd.fit_levels(rows.select("score_band", "hpi_change_yoy", F.col("observed").alias("n"), "w", "wy"), fallback_lgd=s.fallback_lgd)


def realised(facts: DataFrame) -> DataFrame:
    """attribution.realised()."""
    names = tuple(attribution.outcome(F.lit(0.0)))
    return facts.where("realised_defaults > 0").groupBy(F.year("as_of_month").alias("year")).agg(*[F.sum(c).alias(c) for c in names])


def triangle(facts: DataFrame, acquisition: DataFrame, grain: str, cutoff: str | None = None) -> DataFrame:
    """vintage.triangle()."""
    return vintage.triangle_of(vintage.as_of(facts, cutoff), acquisition, grain)
