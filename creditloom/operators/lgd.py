"""Loss given default: weighted least squares of recovery on house prices, by score band, in one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.config import Settings
from creditloom.functions import columns as C


def observations(panel: DataFrame) -> DataFrame:
    """Charge-offs with their recovery, between 0 and 1."""
    C.need(panel.columns, "exit_reason", "upb_bom", "net_sales_proceeds", "foreclosure_costs", "score_band", "hpi_change_yoy")
    rows = panel.where((F.col("exit_reason") == "ChargeOff") & (F.col("upb_bom") > 0))
    return rows.withColumn("recovery", recovery())


def recovery() -> Column:
    net = F.coalesce("net_sales_proceeds", F.lit(0)).cast("double") - F.coalesce("foreclosure_costs", F.lit(0)).cast("double")
    return C.clip(net / F.col("upb_bom").cast("double"), 0.0, 1.0)


def fit(rows: DataFrame, least: int = 20, fallback_lgd: float = 0.45) -> DataFrame:
    """(score_band, n, intercept, slope, is_fallback) with the balance as weight. Too few rows or one price level: the fallback."""
    w, x, y = F.col("upb_bom").cast("double"), F.col("hpi_change_yoy"), F.col("recovery")
    s = rows.where("score_band is not null and hpi_change_yoy is not null").groupBy("score_band").agg(
        F.count("*").alias("n"), F.countDistinct("hpi_change_yoy").alias("levels"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy")
    )
    return _solved(s, least, fallback_lgd)


def fit_levels(levels: DataFrame, least: int = 20, fallback_lgd: float = 0.45) -> DataFrame:
    """fit() from sums (score_band, hpi_change_yoy, n, w, wy) of observations, their balances and balances times recoveries."""
    x = F.col("hpi_change_yoy")
    one = levels.where("score_band is not null and hpi_change_yoy is not null and n > 0").groupBy("score_band", "hpi_change_yoy").agg(*[F.sum(c).alias(c) for c in ("n", "w", "wy")])
    s = one.groupBy("score_band").agg(
        F.sum("n").alias("n"), F.count("*").alias("levels"), F.sum("w").alias("w"), F.sum(F.col("w") * x).alias("wx"), F.sum("wy").alias("wy"), F.sum(F.col("w") * x * x).alias("wxx"), F.sum(F.col("wy") * x).alias("wxy")
    )
    return _solved(s, least, fallback_lgd)


def _solved(s: DataFrame, least: int, fallback_lgd: float) -> DataFrame:
    bad = (F.col("n") < least) | (F.col("levels") < 2)
    slope = F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    s = s.withColumn("slope", F.when(bad, 0.0).otherwise(slope))
    return s.select("score_band", "n", F.when(bad, 1 - fallback_lgd).otherwise((F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w")).alias("intercept"), "slope", bad.alias("is_fallback"))


def predicted(hpi: Column, fallback_lgd: float) -> Column:
    """1 - recovery; bands without coefficients (null) take the fallback."""
    return F.coalesce(1 - C.clip(F.col("intercept") + F.col("slope") * hpi, 0.0, 1.0), F.lit(fallback_lgd))


def predict(rows: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """rows (score_band, hpi_change_yoy, ...) with lgd; the model has a row a band."""
    coef = F.broadcast(model.select("score_band", "intercept", "slope"))
    return rows.join(coef, "score_band", "left").withColumn("lgd", predicted(F.col("hpi_change_yoy"), s.fallback_lgd)).drop("intercept", "slope")


def validation(rows: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """Balance-weighted actual and predicted LGD by era."""
    w = F.col("upb_bom").cast("double")
    year = F.substring("vintage", 1, 4).cast("int")
    scored = predict(rows, model, s).withColumn("era", C.era(year))
    return scored.groupBy("era").agg(F.count("*").alias("defaults"), C.ratio(F.sum((1 - F.col("recovery")) * w), F.sum(w)).alias("actual_lgd"), C.ratio(F.sum(F.col("lgd") * w), F.sum(w)).alias("predicted_lgd"))
