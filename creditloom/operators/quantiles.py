"""Exact weighted quantiles of groups with any number of distinct values, over many tasks.

A quantile lies between two points of its group's cumulative weights, so only values near it need be sorted. A mergeable
sketch of the distinct values gives each group CELLS - 1 borders; the cells' exact weights are added up (a row a cell), which
tells which cells can hold a wanted point; and only these are sorted, each in a window of its own. The sketch decides how
evenly the work is dealt, never what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from creditloom.sources.tables import cut_lineage

#: A power of two.
CELLS = 256


def _cell(value: str, borders: str) -> Column:
    """How many of the CELLS - 1 sorted borders are below the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(CELLS.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(F.col(borders), at + step - 1) < F.col(value), step).otherwise(0))


def value_weights(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Rows (g, v, w): the weight of each distinct value. Nulls, NaN and weights of 0 or less take no part; whole weights stay whole."""
    kind = rows.schema[weight].dataType
    exact = F.col(weight).cast("decimal(20,0)") if isinstance(kind, T.IntegralType) else F.col(weight)
    number = F.col(value).cast("double")
    used = rows.where(number.isNotNull() & ~F.isnan(number) & (F.col(weight) > 0))
    return used.groupBy(F.col(group).alias("g"), (number + 0.0).alias("v")).agg(F.sum(exact).alias("w"))


def borders(sums: DataFrame) -> DataFrame:
    """Rows (g, borders): CELLS - 1 approximate quantiles of each group's distinct values. A row a group."""
    shares = [k / CELLS for k in range(1, CELLS)]
    return sums.groupBy("g").agg(F.percentile_approx("v", shares, 20 * CELLS).alias("borders"))


def placed(sums: DataFrame, edges: DataFrame) -> DataFrame:
    """sums with the cell of each value. edges: a row a group, and groups are few (bands, states, years)."""
    edges = F.broadcast(edges.withColumnRenamed("g", "__g"))
    return sums.join(edges, F.col("g").eqNullSafe(F.col("__g"))).withColumn("cell", _cell("v", "borders")).drop("borders", "__g")


def cells(values: DataFrame) -> DataFrame:
    """Rows (g, cell, before, after, total): the cumulative weights around each cell, at most CELLS a group."""
    sums = values.groupBy("g", "cell").agg(F.sum("w").alias("own"))
    order = Window.partitionBy("g").orderBy("cell")
    after = F.sum("own").over(order)
    return sums.select("g", "cell", (after - F.col("own")).alias("before"), after.alias("after"), F.sum("own").over(Window.partitionBy("g")).alias("total"))


def wanted(found: DataFrame, quantiles: list[float]) -> DataFrame:
    """The cells in whose reach a quantile lies, and their neighbours, as the points around it may be in these."""
    slack = 1e-9
    reach = F.lit(False)
    for q in quantiles:
        reach |= (F.col("before") / F.col("total") <= q + slack) & (F.col("after") / F.col("total") >= q - slack)
    order = Window.partitionBy("g").orderBy("cell")
    marked = found.withColumn("reach", reach)
    near = F.coalesce(F.lag("reach").over(order), F.lit(False)) | F.coalesce(F.lead("reach").over(order), F.lit(False))
    return marked.withColumn("near", near).where("reach or near").select("g", "cell", "before", "total")


def points(values: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (g, v, at) of the chosen cells: at is the middle of a value's weight in its group's, from 0 to 1."""
    here = F.broadcast(chosen.withColumnsRenamed({"g": "__g", "cell": "__cell"}))  # a few cells a group
    held = values.join(here, F.col("g").eqNullSafe(F.col("__g")) & (F.col("cell") == F.col("__cell")))
    order = Window.partitionBy("g", "cell").orderBy("v")
    upto = (F.col("before") + F.sum("w").over(order)).cast("double")
    return held.select("g", "v", ((upto - F.col("w").cast("double") / 2) / F.col("total").cast("double")).alias("at"))


def spread_quantiles(rows: DataFrame, group: str, value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """Rows (group, q, value): as monitoring.weighted_quantiles(), which sorts a group in one task.

    Equal values are added up first; between the two points around q it is interpolated, and ends are clamped.
    """
    sums = cut_lineage(value_weights(rows, group, value, weight))
    edges = cut_lineage(borders(sums))  # once, as another merge of the sketch might give others
    values = placed(sums, edges)
    near = points(values, wanted(cells(values), quantiles))
    asked = near.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    low, high = F.col("at") <= F.col("q"), F.col("at") > F.col("q")
    point = F.struct("at", "v")
    around = asked.groupBy("g", "q").agg(F.max(F.when(low, point)).alias("a"), F.min(F.when(high, point)).alias("b"))
    inside = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("q") - F.col("a.at")) / (F.col("b.at") - F.col("a.at"))
    return around.select(F.col("g").alias(group), "q", F.coalesce(inside, F.col("a.v"), F.col("b.v")).alias("value"))
