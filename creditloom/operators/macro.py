"""The monthly macro series: alignment, integrity, lags, and its join to a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VALUES = ("unemployment_rate", "unemployment_change_3m", "hpi_change_yoy")


class MacroError(RuntimeError):
    pass


def _ordered() -> Window:
    # One global series of a row a month, whatever the panel's size.
    return Window.orderBy("as_of_month")


def lag_columns(lags: tuple[int, ...]) -> list[str]:
    return [f"{c}_lag_{n}" for n in lags for c in VALUES]


def features(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Month starts, values and their lags."""
    months = series.select(F.trunc("as_of_month", "month").alias("as_of_month"), *VALUES).coalesce(1)
    return months.select("*", *[F.lag(c, n).over(_ordered()).alias(f"{c}_lag_{n}") for n in lags for c in VALUES])


def integrity(series: DataFrame) -> DataFrame:
    """One row: months, missing values, gaps and repeated months."""
    months = series.select(F.trunc("as_of_month", "month").alias("m"), *VALUES).coalesce(1)
    w = Window.orderBy("m")
    step = F.months_between("m", F.lag("m").over(w))
    x = months.select("*", step.alias("step"))
    return x.agg(
        F.count("*").alias("months"),
        F.count_if(F.col("m").isNull() | F.greatest(*[F.col(c).isNull() for c in VALUES])).alias("missing"),
        F.count_if(F.col("step") > 1).alias("gaps"),
        F.count_if(F.col("step") == 0).alias("repeats"),
    )


def enforce(series: DataFrame) -> None:
    row = integrity(series).first()
    if not row.months or row.missing or row.gaps or row.repeats:
        raise MacroError(f"macro series: {row.asDict()}")


def join(panel: DataFrame, series: DataFrame) -> DataFrame:
    """A row a month of history is small at any portfolio size, so the series is broadcast."""
    return panel.join(F.broadcast(series), "as_of_month", "left")
