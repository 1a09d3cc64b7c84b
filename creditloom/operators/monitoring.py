"""Monitoring: population stability, transition stability, rolling errors, weighted quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.functions import columns as C

AMBER, RED = 0.10, 0.25


def stability(expected: DataFrame, actual: DataFrame, band: str, floor: float = 1e-6) -> DataFrame:
    """(band, shares, psi) by band, whose sum is the population stability index; absent bands count as floor."""
    share = lambda df, name: df.groupBy(band).agg(F.count("*").alias("n")).select(band, C.ratio("n", F.sum("n").over(Window.partitionBy())).alias(name))  # noqa: E731  a row a band
    both = share(expected, "e").join(share(actual, "a"), band, "full")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)) for c in ("e", "a"))
    return both.select(band, e.alias("expected_share"), a.alias("actual_share"), ((a - e) * F.ln(a / e)).alias("psi"))


def verdict(psi):
    return F.when(psi >= RED, "red").when(psi >= AMBER, "amber").otherwise("green")


def transition_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """(origin, destination) with both probabilities, the change in basis points and the standardised residual."""
    def shares(counts: DataFrame, p: str, n: str) -> DataFrame:
        sums = counts.groupBy(F.col("delinquency_state").alias("origin"), F.col("next_delinquency_state").alias("destination")).agg(F.sum("transition_count").alias("k"))
        total = F.sum("k").over(Window.partitionBy("origin"))
        return sums.select("origin", "destination", C.ratio("k", total).alias(p), total.alias(n))

    both = shares(before, "p0", "n0").join(shares(after, "p1", "n1"), ["origin", "destination"], "full").na.fill(0.0, ["p0", "p1"])
    n1 = F.max("n1").over(Window.partitionBy("origin"))
    spread = F.sqrt(F.col("p0") * (1 - F.col("p0")) / n1)
    return both.select("origin", "destination", "p0", "p1", ((F.col("p1") - F.col("p0")) * 10000).alias("change_bps"), F.when(spread > 0, (F.col("p1") - F.col("p0")) / spread).alias("residual"))


def rolling_error(monthly: DataFrame, months: int = 12) -> DataFrame:
    """(as_of_month, projected, actual) with both sums over the last months and the relative error."""
    w = Window.orderBy("as_of_month").rowsBetween(1 - months, 0)  # one row a month of history
    return monthly.select("as_of_month", F.sum("projected").over(w).alias("projected"), F.sum("actual").over(w).alias("actual"), C.ratio(F.sum("projected").over(w) - F.sum("actual").over(w), F.sum("actual").over(w)).alias("error"))


def weighted_quantiles(rows: DataFrame, group: str, value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """(group, q, value): equal values are added up first, then positions (cumulative weight - w / 2) / total are interpolated.

    Ends are clamped. Nulls and weights of 0 take no part.
    """
    sums = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.sum(F.col(weight)).cast("double").alias("w"))
    order = Window.partitionBy("g").orderBy("v")
    placed = sums.select("g", "v", ((F.sum("w").over(order) - F.col("w") / 2) / F.sum("w").over(Window.partitionBy("g"))).alias("at"))
    placed = placed.select("*", F.lead("v").over(order).alias("v1"), F.lead("at").over(order).alias("at1"), F.lag("at").over(order).isNull().alias("first"))
    asked = placed.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    inside = (F.col("q") >= F.col("at")) & (F.col("q") < F.coalesce("at1", F.lit(2.0)))
    below = F.col("first") & (F.col("q") < F.col("at"))
    step = F.when(F.col("at1").isNull() | below, F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (F.col("q") - F.col("at")) / (F.col("at1") - F.col("at")))
    return asked.where(inside | below).select(F.col("g").alias(group), "q", step.alias("value"))


def transition_backtest(realised: DataFrame, expected: DataFrame) -> DataFrame:
    """Realised and expected shares by (period, origin, destination), with the totals of all periods ('Total')."""
    keys = ["period", "origin", "destination"]
    both = realised.select(*keys, F.col("n").alias("realised")).join(expected.select(*keys, F.col("n").alias("expected")), keys, "full").na.fill(0.0, ["expected"]).na.fill(0, ["realised"])
    sums = both.groupingSets([[F.col(c) for c in keys], [F.col("origin"), F.col("destination")]], *keys).agg(F.sum("realised").alias("realised"), F.sum("expected").alias("expected"))
    sums = sums.withColumn("period", F.coalesce(F.col("period").cast("string"), F.lit("Total")))
    w = Window.partitionBy("period", "origin")
    return sums.select(*keys, "realised", "expected", C.ratio("realised", F.sum("realised").over(w)).alias("realised_share"), C.ratio("expected", F.sum("expected").over(w)).alias("expected_share"))


def distribution(rows: DataFrame, group: str, value: str, weight: str, quantiles: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """(group, weight, mean, deviation, low, high, p10, ...): weighted moments and percentiles of each group."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    used = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    mean = F.sum(v * w) / F.sum(w)
    moments = used.groupBy(group).agg(F.sum(w).alias("weight"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(v * v * w) / F.sum(w) - mean * mean, F.lit(0.0))).alias("deviation"), F.min(v).alias("low"), F.max(v).alias("high"))
    points = weighted_quantiles(rows, group, value, weight, [q / 100 for q in quantiles])
    wide = points.groupBy(group).agg(*[F.max(F.when(F.col("q") == q / 100, F.col("value"))).alias(f"p{q}") for q in quantiles])
    return moments.join(wide, group)


SAMPLE_QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def macro_samples(counts: DataFrame, series: DataFrame, cutoff: str, first: str, last: str) -> DataFrame:
    """Unemployment in five samples: months up to the cutoff and months from first to last, each by calendar and by transitions, and all transitions.

    counts: the transition cube; series: a row a month. Rows (sample, observations, total_weight, minimum, quantiles,
    maximum, share_above_early_maximum), the last the weight above all that was seen up to the cutoff.
    """
    day = lambda x: F.lit(x).cast("date")
    cells = counts.groupBy("as_of_month").agg(F.count("*").alias("cells"), F.sum("transition_count").alias("moves"))
    early = F.col("as_of_month") <= day(cutoff)
    months = series.select("as_of_month", "unemployment_rate").dropDuplicates(["as_of_month"])  # a row a month from here on
    top = months.agg(F.max(F.when(early, F.col("unemployment_rate"))).alias("early_maximum"))
    months = months.join(cells, "as_of_month", "left").crossJoin(F.broadcast(top))
    late = F.col("as_of_month").between(day(first), day(last))
    one = lambda name, held, weight, rows: F.when(held, F.struct(F.lit(name).alias("sample"), weight.cast("double").alias("weight"), rows.cast("long").alias("rows")))
    unit = F.lit(1)
    every = F.array_compact(F.array(
        one("early calendar", early, unit, unit), one("early transitions", early, F.col("moves"), F.col("cells")),
        one("late calendar", late, unit, unit), one("late transitions", late, F.col("moves"), F.col("cells")), one("all transitions", F.lit(True), F.col("moves"), F.col("cells")),
    ))
    rows = months.select("unemployment_rate", "early_maximum", F.inline(every)).where("weight > 0")
    u, w = F.col("unemployment_rate"), F.col("weight")
    sums = rows.groupBy("sample").agg(F.sum("rows").alias("observations"), F.sum(w).alias("total_weight"), F.min(u).alias("minimum"), F.max(u).alias("maximum"), C.ratio(C.sum_if(u > F.col("early_maximum"), w), F.sum(w)).alias("share_above_early_maximum"))
    points = weighted_quantiles(rows, "sample", "unemployment_rate", "weight", list(SAMPLE_QUANTILES.values()))
    wide = points.groupBy("sample").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in SAMPLE_QUANTILES.items()])
    return sums.join(wide, "sample").select("sample", "observations", "total_weight", "minimum", *SAMPLE_QUANTILES, "maximum", "share_above_early_maximum")
