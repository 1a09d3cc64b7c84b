"""Transition counts and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import macro as M

KEYS = ("delinquency_state", "next_delinquency_state", "months_on_book", "score_band", "as_of_month")


class TransitionError(RuntimeError):
    pass


def observed(panel: DataFrame) -> DataFrame:
    """Rows that count as transitions: neither censored nor without a next state."""
    return panel.where(~F.col("is_censored") & F.col("next_delinquency_state").isNotNull())


def cube(panel: DataFrame) -> DataFrame:
    return observed(panel).groupBy(*KEYS).agg(F.count("*").cast("long").alias("transition_count"))


def fit_sample(counts: DataFrame, fit_end: str | None) -> DataFrame:
    """Counts of months up to fit_end (all, if None); an empty sample is an error."""
    out = counts if fit_end is None else counts.where(F.col("as_of_month") <= F.lit(fit_end).cast("date"))
    if out.isEmpty():
        raise TransitionError(f"no transitions up to {fit_end}")
    return out


def months(panel: DataFrame) -> DataFrame:
    """One macro row a month, as the panel has it."""
    return panel.select("as_of_month", *M.VALUES).dropDuplicates(["as_of_month"])


def matrix(counts: DataFrame, s: Settings) -> DataFrame:
    """(origin, destination, n, probability) over all pairs of states.

    Rows add up to 1. Absorbing states stay; an origin never seen stays with probability 1.
    """
    states = F.array(*map(F.lit, s.states))
    grid = counts.sparkSession.range(0, 1, 1, 1).select(F.explode(states).alias("origin")).select("origin", F.explode(states).alias("destination"))  # states by states, a fixed number
    sums = counts.groupBy(F.col("delinquency_state").alias("origin"), F.col("next_delinquency_state").alias("destination")).agg(F.sum("transition_count").alias("n"))
    full = grid.join(sums, ["origin", "destination"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("origin"))
    stays = (F.col("origin") == F.col("destination")).cast("double")
    p = F.when(F.col("origin").isin(*s.absorbing) | (total == 0), stays).otherwise(C.ratio("n", total))
    return full.select("origin", "destination", "n", p.alias("probability"))


def enforce(table: DataFrame, s: Settings, tolerance: float = 1e-12) -> None:
    """Raises TransitionError unless rows add up to 1 and absorbing rows are the identity."""
    absorbing = F.col("origin").isin(*s.absorbing)
    identity = (F.col("origin") == F.col("destination")).cast("double")
    bad = table.groupBy("origin").agg(F.sum("probability").alias("mass"), F.max(F.when(absorbing, F.abs(F.col("probability") - identity)).otherwise(0.0)).alias("off"), F.min("probability").alias("low"))
    rows = bad.where((F.abs(F.col("mass") - 1) > tolerance) | (F.col("off") > 0) | (F.col("low") < 0)).collect()  # a row a state
    if rows:
        raise TransitionError(f"not stochastic: {[r.origin for r in rows]}")


def hazards(counts: DataFrame, s: Settings) -> DataFrame:
    """One row: prepayment among the delinquent, repurchase among all that can move."""
    n = F.col("transition_count")
    live = ~F.col("delinquency_state").isin(*s.absorbing)
    late = live & (F.col("delinquency_state") != "Current")
    to = F.col("next_delinquency_state")
    one = counts.agg(C.sum_if(late & (to == "Prepaid"), n).alias("a"), C.sum_if(late, n).alias("b"), C.sum_if(live & (to == "Repurchased"), n).alias("c"), C.sum_if(live, n).alias("d"))
    return one.select(F.coalesce(C.ratio("a", "b"), F.lit(0.0)).alias("delinquent_prepay"), F.coalesce(C.ratio("c", "d"), F.lit(0.0)).alias("repurchase"))


def flows(panel: DataFrame) -> DataFrame:
    """Realised probabilities by origin month and origin."""
    counts = observed(panel).groupBy("as_of_month", "delinquency_state", "next_delinquency_state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", C.ratio("n", F.sum("n").over(Window.partitionBy("as_of_month", "delinquency_state"))))
