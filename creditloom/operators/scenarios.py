"""Supervisory scenarios: quarters to months, reversion to the long run, lags over observed history, and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import macro as M


class ScenarioError(RuntimeError):
    pass


def published(table: DataFrame, vintage_year: int, quarters: int, history: str = "historical") -> DataFrame:
    """One year's scenarios; raises ScenarioError for repeated quarters or a scenario without the right number of them."""
    C.need(table.columns, "vintage_year", "scenario", "quarter", "unemployment_rate", "house_price_index")
    rows = table.where(F.col("vintage_year") == vintage_year)
    bad = rows.groupBy("scenario").agg(F.count("*").alias("n"), F.countDistinct("quarter").alias("d")).where((F.col("n") != F.col("d")) | ((F.col("scenario") != history) & (F.col("n") != quarters))).collect()
    if bad or rows.isEmpty():
        raise ScenarioError(f"published scenarios: {[(r.scenario, r.n, r.d) for r in bad] or 'none'}")
    return rows


def quarterly_to_monthly(table: DataFrame, history: str = "historical") -> DataFrame:
    """(scenario, as_of_month, unemployment_rate, hpi_change_yoy): each quarter's values in its three months.

    House prices change against the index four quarters before, for which the history goes before every scenario.
    """
    q = table.select("scenario", F.substring("quarter", 1, 4).cast("int").alias("y"), F.substring("quarter", 6, 1).cast("int").alias("k"), "unemployment_rate", "house_price_index")
    names = q.where(F.col("scenario") != history).select("scenario").distinct()
    past = q.where(F.col("scenario") == history).drop("scenario").crossJoin(F.broadcast(names))  # a few scenarios by a few quarters
    rows = q.where(F.col("scenario") != history).withColumn("past", F.lit(False)).unionByName(past.withColumn("past", F.lit(True)))
    w = Window.partitionBy("scenario").orderBy("y", "k")
    rows = rows.withColumn("hpi_change_yoy", F.try_divide(F.col("house_price_index"), F.lag("house_price_index", 4).over(w)) - 1).where(~F.col("past"))
    first = F.make_date("y", (F.col("k") - 1) * 3 + 1, F.lit(1))
    return rows.select("scenario", F.explode(F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.add_months(first, i))).alias("as_of_month"), "unemployment_rate", "hpi_change_yoy")


def extend(monthly: DataFrame, months: int, s: Settings) -> DataFrame:
    """The paths, carried on to so many months in all: the gap to the long run halves every half-life."""
    last = monthly.groupBy("scenario").agg(F.count("*").alias("n"), F.max_by(F.struct("as_of_month", "unemployment_rate", "hpi_change_yoy"), "as_of_month").alias("x"))
    steps = last.where(F.col("n") < months).select("scenario", "x.*", F.explode(F.sequence(F.lit(1), (F.lit(months) - F.col("n")).cast("int"))).alias("step"))
    keep = F.pow(F.lit(0.5), F.col("step") / F.lit(3.0 * s.half_life_quarters))
    toward = lambda c, goal: (F.lit(goal) + (F.col(c) - F.lit(goal)) * keep).alias(c)
    tail = steps.select("scenario", F.add_months("as_of_month", F.col("step")).alias("as_of_month"), toward("unemployment_rate", s.long_run_unemployment), toward("hpi_change_yoy", s.long_run_hpi), F.lit(False).alias("is_published"))
    return monthly.withColumn("is_published", F.lit(True)).unionByName(tail)


def paths(extended: DataFrame, history: DataFrame, s: Settings) -> DataFrame:
    """Scenario months with the three-month change and all lags, over the observed months before them."""
    names = extended.select("scenario").distinct()
    past = history.select("as_of_month", "unemployment_rate", "hpi_change_yoy").crossJoin(F.broadcast(names))  # a few scenarios by a year of months
    rows = extended.withColumn("past", F.lit(False)).unionByName(past.withColumn("past", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("scenario").orderBy("as_of_month")
    rows = rows.withColumn("unemployment_change_3m", F.col("unemployment_rate") - F.lag("unemployment_rate", 3).over(w))
    rows = rows.select("*", *[F.lag(c, n).over(w).alias(f"{c}_lag_{n}") for n in s.macro_lags for c in M.VALUES])
    return rows.where(~F.col("past")).drop("past")


def enforce(table: DataFrame, s: Settings) -> None:
    missing = table.where(F.greatest(*[F.col(c).isNull() for c in (*M.VALUES, *M.lag_columns(s.macro_lags))]))
    if not missing.isEmpty():
        raise ScenarioError("a scenario month lacks a value or a lag; the history is too short")


def extrapolation(table: DataFrame, s: Settings) -> DataFrame:
    """By scenario over its published months: the peak, and the shares above the unemployment that the fits have seen."""
    u = F.col("unemployment_rate")
    return table.where("is_published").groupBy("scenario").agg(
        F.count("*").alias("published_months"), F.max(u).alias("peak_unemployment"), F.avg((u > s.support_before_cutoff).cast("double")).alias("share_above_cutoff_support"), F.avg((u > s.support_full_history).cast("double")).alias("share_above_history_support")
    )


def summary(losses: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(scenario, balance, ecl) with the rate, and the difference and ratio to the baseline's."""
    base = losses.where(F.col("scenario") == baseline).select(F.col("ecl").alias("base"))
    return losses.crossJoin(F.broadcast(base)).select("scenario", "balance", "ecl", C.ratio("ecl", "balance").alias("ecl_rate"), (F.col("ecl") - F.col("base")).alias("ecl_over_baseline"), C.ratio("ecl", "base").alias("ecl_multiple"))


def monthly(details: DataFrame) -> DataFrame:
    """(scenario, month, undiscounted_loss, ecl, cumulative_ecl) of ecl.lifetime() rows with a scenario."""
    sums = details.groupBy("scenario", "month").agg(F.sum("undiscounted_loss").alias("undiscounted_loss"), F.sum("ecl").alias("ecl"))
    return sums.withColumn("cumulative_ecl", F.sum("ecl").over(Window.partitionBy("scenario").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


def flows(path: DataFrame, matrices: DataFrame, segs: DataFrame) -> DataFrame:
    """(origin, destination, dollars): balance times the vector before each month times that month's matrix, summed."""
    start = segs.select("segment_id", F.explode("initial_state").alias("origin", "p")).withColumn("step", F.lit(1))
    before = path.select("segment_id", F.col("state").alias("origin"), "p", (F.col("month") + 1).alias("step")).unionByName(start)
    moves = before.join(matrices.select("segment_id", "step", "origin", "destination", F.col("p").alias("q")), ["segment_id", "step", "origin"])
    moves = moves.join(segs.select("segment_id", F.col("balance").cast("double").alias("b")), "segment_id")
    return moves.groupBy("origin", "destination").agg(F.sum(F.col("b") * F.col("p") * F.col("q")).alias("dollars"))


def flow_attribution(severe: DataFrame, base: DataFrame, top: int | None = None) -> DataFrame:
    """Differences of two flows() by cell, the largest first; top bounds the report."""
    a, b = severe.withColumnRenamed("dollars", "severe"), base.withColumnRenamed("dollars", "base")
    both = a.join(b, ["origin", "destination"], "full").select("origin", "destination", (F.coalesce("severe", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))).alias("dollars"))
    both = both.where(F.col("origin") != F.col("destination")).orderBy(F.desc("dollars"), "origin", "destination")
    return both if top is None else both.limit(top)
