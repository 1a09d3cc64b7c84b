"""Multi-state forecasts: state vectors carried through monthly matrices by a fold inside each segment's row."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.functions import columns as C


class ForecastError(RuntimeError):
    pass


class MatrixBuilder(Protocol):
    """What forecasts need of a model: long matrices (segment_id, step, origin, destination, p) for segments over a macro path."""

    states: tuple[str, ...]
    absorbing: tuple[str, ...]

    def matrices(self, segments: DataFrame, macro: DataFrame, horizon: int) -> DataFrame: ...


def _index(states: tuple[str, ...], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in states]), F.col(column)).cast("int") - 1


def pack(matrices: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """(segment_id, steps): each segment's matrices in order of step, row by row in one flat array; missing cells are 0."""
    n = len(states)
    cells = matrices.select("segment_id", "step", (_index(states, "origin") * n + _index(states, "destination")).alias("i"), "p")
    one = cells.groupBy("segment_id", "step").agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("cells"))
    one = one.select("segment_id", "step", F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0))).alias("m"))
    return one.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("step", "m"))).alias("steps"))


def initial_vector(states: tuple[str, ...], column: str = "initial_state") -> Column:
    return F.array(*[F.coalesce(F.try_element_at(F.col(column), F.lit(x)), F.lit(0.0)) for x in states])


def enforce_initial(segments: DataFrame, states: tuple[str, ...], tolerance: float = 1e-9) -> None:
    v = initial_vector(states)
    odd = F.abs(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) - 1) > tolerance
    if not segments.where(odd | F.exists(v, lambda x: x < 0) | F.exists(F.map_keys("initial_state"), lambda k: ~k.isin(*states))).isEmpty():
        raise ForecastError("an initial state is not a distribution over the states")


def forecast(segments: DataFrame, matrices: DataFrame, states: tuple[str, ...], horizon: int) -> DataFrame:
    """(segment_id, month 1..horizon, state, p): the state vector of each segment after each month.

    segments: (segment_id, initial_state map). Where a segment has fewer steps than the horizon, its last one repeats.
    """
    n = len(states)
    rows = segments.join(pack(matrices, states), "segment_id").select("segment_id", initial_vector(states).alias("v0"), "steps")
    idx = F.sequence(F.lit(0), F.lit(n - 1))

    def after(v: Column, m: Column) -> Column:
        return F.transform(idx, lambda d: F.aggregate(idx, F.lit(0.0), lambda s, o: s + F.get(v, o) * F.get(m, o * n + d)))

    def month(acc: Column, t: Column) -> Column:
        m = F.get("steps", F.least(t, F.size("steps")) - 1)["m"]
        v = after(acc["v"], m)
        return F.struct(v.alias("v"), F.concat(acc["out"], F.array(v)).alias("out"))

    start = F.struct(F.col("v0").alias("v"), F.array().cast("array<array<double>>").alias("out"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, month, lambda acc: acc["out"])
    long_ = rows.select("segment_id", F.posexplode(path).alias("i", "v")).select("segment_id", (F.col("i") + 1).alias("month"), F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in states]).alias("s"), F.col("v").alias("v"))).alias("z"))
    return long_.select("segment_id", "month", F.col("z.s").alias("state"), F.col("z.v").alias("p"))


def marginal_default(path: DataFrame, segments: DataFrame, default: str = "ChargeOff") -> DataFrame:
    """(segment_id, month, marginal_pd): what each month adds to the default state."""
    start = segments.select("segment_id", F.coalesce(F.try_element_at("initial_state", F.lit(default)), F.lit(0.0)).alias("p0"))
    w = Window.partitionBy("segment_id").orderBy("month")
    rows = path.where(F.col("state") == default).join(start, "segment_id")
    return rows.select("segment_id", "month", (F.col("p") - F.coalesce(F.lag("p").over(w), "p0")).alias("marginal_pd"))


def portfolio(path: DataFrame, segments: DataFrame) -> DataFrame:
    """(month, state, p, balance): the balance-weighted path of all segments."""
    rows = path.join(segments.select("segment_id", F.col("balance").cast("double").alias("b")), "segment_id")
    return rows.groupBy("month", "state").agg(C.ratio(F.sum(F.col("p") * F.col("b")), F.sum("b")).alias("p"), F.sum("b").alias("balance"))


def enforce(path: DataFrame, default: str = "ChargeOff", tolerance: float = 1e-10) -> None:
    """Raises ForecastError unless mass is 1, nothing is negative and defaults never fall."""
    mass = path.groupBy("segment_id", "month").agg(F.sum("p").alias("m"), F.min("p").alias("low")).where((F.abs(F.col("m") - 1) > tolerance) | (F.col("low") < -tolerance))
    w = Window.partitionBy("segment_id").orderBy("month")
    falls = path.where(F.col("state") == default).withColumn("before", F.lag("p").over(w)).where(F.col("p") < F.col("before") - tolerance)
    if not mass.isEmpty() or not falls.isEmpty():
        raise ForecastError("a forecast loses mass, goes negative or lets defaults fall")
