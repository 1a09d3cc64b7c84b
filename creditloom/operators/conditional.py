"""Transition probabilities that depend on age, score and the economy: one weighted logistic model an origin state.

All origins and all candidate lags are fitted together. A Newton step is one pass over the transition counts, in which
each task adds up every model's gradient and curvature; the driver gets these sums, whose size is that of the models.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.functions import spline
from creditloom.operators import joins
from creditloom.operators import macro as M
from creditloom.operators import transitions as X


class ConditionalError(RuntimeError):
    pass


def moving(s: Settings) -> list[str]:
    return [x for x in s.states if x not in s.absorbing]


def destinations(origin: str, s: Settings) -> list[str]:
    """Where an origin's model can go: current loans stay, fall behind or prepay; others cure by a step, stay or roll on."""
    states = moving(s)
    k = states.index(origin)
    if k == 0:
        return [origin, states[1], "Prepaid"]
    return [states[k - 1], origin, states[k + 1] if k + 1 < len(states) else "ChargeOff"]


def score_risk(band: Column | str) -> Column:
    """(700 - the band's middle) / 100, between -0.8 and 1.8."""
    numbers = F.transform(F.regexp_extract_all(C.either(band), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("double"))
    middle = (F.element_at(numbers, -2) + F.element_at(numbers, -1)) / 2
    return C.clip((700 - middle) / 100, -0.8, 1.8)


def candidates(s: Settings) -> dict[int, list[str]]:
    return {0: list(M.VALUES)} | {n: [f"{c}_lag_{n}" for c in M.VALUES] for n in s.macro_lags}


def _macro_columns(macros: list[str], s: Settings) -> dict[str, Column]:
    """A candidate's columns. Unemployment counts above the hinge only."""
    out = {}
    for m in macros:
        if m.startswith("unemployment_rate"):
            out[f"{m}_excess"] = F.greatest(F.col(m) - s.unemployment_hinge, F.lit(0.0))
        else:
            out[m] = F.col(m)
    return out


def with_basis(rows: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """rows with the age spline and the score's risk, and their names."""
    names, table = spline.month_table(s.mob_edges, s.maturity_mob)
    basis = rows.sparkSession.createDataFrame(table, ", ".join(f"{n} {'int' if i == 0 else 'double'}" for i, n in enumerate(names)))
    capped = rows.withColumn("_mob", F.least(F.greatest("months_on_book", F.lit(0)), F.lit(s.maturity_mob)).cast("int"))
    out = capped.join(F.broadcast(basis.withColumnRenamed("months_on_book", "_mob")), "_mob").drop("_mob")  # a row a month of age
    out = out.withColumn("score_risk", score_risk("score_band"))
    return out.withColumn("score_risk_positive", F.greatest("score_risk", F.lit(0.0))), [*names[1:], "score_risk", "score_risk_positive"]


@dataclass(frozen=True)
class OriginModel:
    """labels are the classes seen; weights has a row a class, or one row, of the second, where two were seen."""

    origin: str
    targets: list[str]
    prior: dict[str, float]
    lag: int | None = None
    bic: float = float("inf")
    macros: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    weights: tuple[tuple[float, ...], ...] = ()

    def probabilities(self, s: Settings, z: str) -> dict[str, Column]:
        """The targets' probabilities on rows that hold this model's logits in the array column z: the prior where there is no model."""
        if not self.weights:
            return {t: F.lit(p) for t, p in self.prior.items()}
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return {label: F.get(e, F.lit(i)) / total for i, label in enumerate(self.labels)}

    def logits(self, s: Settings) -> Column:
        """An array of the labels' logits, on rows of with_basis()."""
        macros = _macro_columns(self.macros, s)
        columns = [macros.get(f, F.col(f)) for f in self.features]
        out = [sum((c * float(w) for c, w in zip(columns, row[1:], strict=True)), F.lit(float(row[0]))) for row in self.weights]
        return F.array(*(out if len(out) > 1 else [F.lit(0.0), *out]))

    def coefficients(self) -> list[tuple[str, str, str, float]]:
        """(origin, destination, feature, value)."""
        labels = self.labels if len(self.weights) == len(self.labels) else self.labels[1:]
        return [(self.origin, label, name, float(v)) for label, row in zip(labels, self.weights, strict=False) for name, v in zip(["intercept", *self.features], row, strict=True)]


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, classes: int) -> np.ndarray:
    """Log-loss, gradient and curvature of rows x (first column 1), flat. beta: a row a class, or one row of two classes."""
    z = x @ beta.T
    z = z if classes > 2 else np.column_stack([np.zeros(len(x)), z])
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -(w * np.log(np.maximum(p[np.arange(len(x)), y], 1e-15))).sum()
    rows = range(classes) if classes > 2 else [1]
    gradient = np.stack([(w * (p[:, r] - (y == r))) @ x for r in rows])
    curve = np.stack([np.stack([(x * (w * p[:, r] * ((r == q) - p[:, q]))[:, None]).T @ x for q in rows], 1) for r in rows])  # r, i, q, j
    return np.concatenate(([loss], gradient.ravel(), curve.ravel()))


def newton(rows: DataFrame, models: list[dict], steps: int = 30, tolerance: float = 1e-7) -> None:
    """Minimises |W|^2 / 2 + C times the weighted log-loss of each model, intercepts free. Sets beta and loss in models.

    rows: origin, y (index of the class), w and the feature columns. A model: origin, classes, features, c. Origins go to
    the workers as numbers.
    """
    columns = sorted({f for m in models for f in m["features"]})
    codes = {o: k for k, o in enumerate(dict.fromkeys(m["origin"] for m in models))}
    number = F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.col("origin"))
    data = rows.select(F.coalesce(number, F.lit(-1)).alias("origin"), "y", "w", *columns).persist()
    for m in models:
        m |= {"beta": np.zeros((m["classes"] if m["classes"] > 2 else 1, len(m["features"]) + 1)), "best": np.inf, "open": True}
    for _ in range(steps):
        at = [(k, codes[m["origin"]], m["classes"], [columns.index(f) for f in m["features"]], m["beta"]) for k, m in enumerate(models) if m["open"]]
        if not at:
            break

        def add(batches: Iterator[pa.RecordBatch], at: list = at) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                origin, y, w = (batch.column(k).to_numpy() for k in range(3))
                x = np.column_stack([np.ones(len(y)), *(c.to_numpy() for c in batch.columns[3:])])
                for k, code, classes, places, beta in at:
                    own = origin == code
                    if own.any():
                        totals[k] = totals.get(k, 0) + _sums(x[own][:, [0, *(i + 1 for i in places)]], y[own], w[own], beta, classes)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["k", "sums"])

        def merge(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
            return pa.table({"k": table.column("k").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

        found = data.mapInArrow(add, "k int, sums binary").groupBy("k").applyInArrow(merge, "k int, sums binary").collect()  # a row a model
        for k, raw in found:
            m, t = models[k], np.frombuffer(raw)
            beta, free = m["beta"], np.ones_like(m["beta"])
            free[:, 0] = 0
            n = beta.size
            value = m["c"] * t[0] + (free * beta**2).sum() / 2
            if value > m["best"] * (1 + 1e-12) + 1e-9 and "step" in m:
                m["step"] /= 2
                m["beta"] = m["from"] + m["step"]
                m["open"] = np.abs(m["step"]).max() > tolerance
                continue
            m |= {"best": value, "loss": t[0], "from": beta}
            gradient = m["c"] * t[1 : n + 1] + (free * beta).ravel()
            curve = m["c"] * t[n + 1 :].reshape(n, n) + np.diag(free.ravel())
            m["step"] = -np.linalg.lstsq(curve, gradient, rcond=1e-12)[0].reshape(beta.shape)
            if np.abs(m["step"]).max() <= tolerance:
                m["open"] = False
            else:
                m["beta"] = beta + m["step"]
    for m in models:
        m["beta"] = m.get("from", m["beta"])
    data.unpersist()


def fit_origins(training: DataFrame, s: Settings) -> tuple[dict[str, OriginModel], list[tuple]]:
    """For each moving state, the candidate of least BIC; and (origin, lag, log_likelihood, parameters, bic) of all."""
    sets, states = candidates(s), moving(s)
    allowed = C.all_of([(F.col("delinquency_state") != o) | F.col("next_delinquency_state").isin(destinations(o, s)) for o in states])
    rows = training.where(F.col("delinquency_state").isin(states) & allowed)
    whole = F.greatest(*[F.col(c).isNull() for c in sorted({c for cols in sets.values() for c in cols})])
    sums = rows.groupBy("delinquency_state", "next_delinquency_state").agg(F.sum("transition_count").alias("n"), C.sum_if(~whole, "transition_count").alias("m")).collect()  # states by states
    ready, basis = with_basis(rows.where(~whole), s)
    ready = ready.withColumns({k: c for macros in sets.values() for k, c in _macro_columns(macros, s).items()})
    origins, models, code = {}, [], F.lit(None).cast("int")
    for o in states:
        own = {r.next_delinquency_state: float(r.n) for r in sums if r.delinquency_state == o}
        total = sum(own.values())
        targets = destinations(o, s)
        prior = {t: own.get(t, 0.0) / total if total else float(t == o) for t in targets}
        labels = sorted(r.next_delinquency_state for r in sums if r.delinquency_state == o and r.m)
        origins[o] = OriginModel(o, targets, prior, labels=labels)
        if len(labels) > 1:
            weight = float(sum(r.m for r in sums if r.delinquency_state == o))
            models += [{"origin": o, "lag": lag, "macros": macros, "features": [*basis, *_macro_columns(macros, s)], "classes": len(labels), "labels": labels, "weight": weight, "c": s.c_dpd150 if o == states[-1] else s.c} for lag, macros in sets.items()]
            for i, label in enumerate(labels):
                code = F.when((F.col("delinquency_state") == o) & (F.col("next_delinquency_state") == label), i).otherwise(code)
    if models:
        newton(ready.select(F.col("delinquency_state").alias("origin"), code.alias("y"), F.col("transition_count").cast("double").alias("w"), *sorted({f for m in models for f in m["features"]})).where("y is not null"), models)
    tried = []
    for m in models:
        bic = 2 * m["loss"] + m["beta"].size * float(np.log(m["weight"]))
        tried.append((m["origin"], m["lag"], -float(m["loss"]), int(m["beta"].size), float(bic)))
        old = origins[m["origin"]]
        if bic < old.bic:
            origins[m["origin"]] = OriginModel(old.origin, old.targets, old.prior, m["lag"], float(bic), m["macros"], m["features"], m["labels"], tuple(map(tuple, m["beta"].tolist())))
    return origins, tried


@dataclass(frozen=True)
class ConditionalModel:
    """The origins' models, pooled hazards and the macro medians; a MatrixBuilder."""

    settings: Settings
    origins: dict[str, OriginModel]
    repurchase: float
    delinquent_prepay: float
    defaults: dict[str, float]
    tried: list[tuple]

    @property
    def states(self) -> tuple[str, ...]:
        return self.settings.states

    @property
    def absorbing(self) -> tuple[str, ...]:
        return self.settings.absorbing

    def score(self, grid: DataFrame) -> DataFrame:
        """(grid's columns, origin, destination, p) for rows (months_on_book, score_band, macro columns, ...), each row once.

        Macro values that are missing take their medians. Absorbing states stay where they are.
        """
        s = self.settings
        names = [c for c in grid.columns if c not in self.defaults]
        full = grid.select(*names, *[(F.coalesce(F.col(c), F.lit(v)) if c in grid.columns else F.lit(v)).alias(c) for c, v in self.defaults.items()])
        fitted = [o for o, m in self.origins.items() if m.weights]
        ready = with_basis(full, s)[0].select(*names, *[self.origins[o].logits(s).alias(f"_z{k}") for k, o in enumerate(fitted)]) if fitted else full.select(*names)
        cells = []
        for origin, model in self.origins.items():
            late = origin != moving(s)[0]
            prepay = self.delinquent_prepay if late else 0.0
            z = f"_z{fitted.index(origin)}" if model.weights else ""
            parts = {t: q * (1 - self.repurchase - prepay) for t, q in model.probabilities(s, z).items()}
            for target, share in (("Repurchased", self.repurchase), *([("Prepaid", prepay)] if late else [])):
                parts[target] = parts[target] + share if target in parts else F.lit(share)
            mass = sum(parts.values(), F.lit(0.0))
            cells += [F.struct(F.lit(origin).alias("origin"), F.lit(t).alias("destination"), (q / mass).alias("p")) for t, q in parts.items()]
        cells += [F.struct(F.lit(o).alias("origin"), F.lit(o).alias("destination"), F.lit(1.0).alias("p")) for o in s.absorbing]
        return ready.select(*names, F.inline(F.array(*cells)))

    def matrices(self, segments: DataFrame, macro: DataFrame, horizon: int, timing: str = "reference") -> DataFrame:
        """(segment_id, step, origin, destination, p). macro: (step, macro columns). Each distinct (age, band, step) is scored once.

        timing 'reference' takes a step's macro values with the age at its begin; 'destination' takes the age at its end.
        """
        off = 1 if timing == "reference" else 0
        steps = segments.select("segment_id", "score_band", "start_mob", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
        steps = steps.withColumn("months_on_book", F.least(F.col("start_mob") + F.col("step") - off, F.lit(self.settings.maturity_mob)).cast("int"))
        keys = ["months_on_book", "score_band", "step"]
        grid = steps.select(*keys).distinct().join(F.broadcast(macro), "step")  # a row a month
        return steps.select("segment_id", *keys).join(self.score(grid), keys).select("segment_id", "step", "origin", "destination", "p")


def fit(counts: DataFrame, macro: DataFrame, s: Settings) -> ConditionalModel:
    """counts: the transition cube; macro: features() with all lags, one row a month. A repeated month, or one of the counts that the series lacks, fails the job."""
    training = joins.checked(counts, macro, ["as_of_month"], "transition counts by macro month", small=True).persist()
    origins, tried = fit_origins(training, s)
    training.unpersist()
    h = X.hazards(counts, s).first()
    names = [*M.VALUES, *M.lag_columns(s.macro_lags)]
    medians = macro.agg(*[F.median(c).alias(c) for c in names]).first().asDict()
    return ConditionalModel(s, origins, float(h.repurchase), float(h.delinquent_prepay), {k: float(v) for k, v in medians.items() if v is not None}, tried)


def save(spark: SparkSession, model: ConditionalModel, path: str, **provenance: str | None) -> None:
    """The model as one line of text, numbers digit by digit, with what it was fitted to."""
    state = {"settings": asdict(model.settings), "origins": {o: asdict(m) for o, m in model.origins.items()}, "repurchase": model.repurchase, "delinquent_prepay": model.delinquent_prepay, "defaults": model.defaults, "tried": model.tried, "provenance": provenance}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, s: Settings, **provenance: str | None) -> ConditionalModel | None:
    """What save() wrote, scored under the settings s; None where there is nothing, or a model of other settings or provenance."""
    try:
        state = json.loads(spark.read.text(path).first()[0])
    except AnalysisException:
        return None
    wanted = json.loads(json.dumps({k: getattr(s, k) for k in SHAPING}))
    if {k: state["settings"][k] for k in SHAPING} != wanted or state["provenance"] != provenance:
        return None
    origins = {o: OriginModel(**m | {"weights": tuple(map(tuple, m["weights"]))}) for o, m in state["origins"].items()}
    return ConditionalModel(s, origins, state["repurchase"], state["delinquent_prepay"], state["defaults"], [tuple(x) for x in state["tried"]])


#: Settings that a fitted model depends on.
SHAPING = ("states", "absorbing", "macro_lags", "mob_edges", "score_edges", "maturity_mob", "unemployment_hinge", "c", "c_dpd150")


def bic_table(spark: SparkSession, model: ConditionalModel) -> DataFrame:
    return spark.createDataFrame(model.tried, "origin string, lag int, log_likelihood double, parameters int, bic double")


def coefficient_table(spark: SparkSession, model: ConditionalModel) -> DataFrame:
    return spark.createDataFrame([r for m in model.origins.values() for r in m.coefficients()], "origin string, destination string, feature string, value double")


def _shocked(spark: SparkSession, model: ConditionalModel, shocks: dict[str, dict[str, float]], mob: int, bands: list[str]) -> DataFrame:
    """Medians moved by each named shock; a shock on a value moves its lags alike."""
    names = list(model.defaults)
    rows = [(name, mob, b, *[model.defaults[c] + next((d for k, d in shock.items() if c.startswith(k)), 0.0) for c in names]) for name, shock in shocks.items() for b in bands]
    return spark.createDataFrame(rows, "shock string, months_on_book int, score_band string, " + ", ".join(f"{c} double" for c in names))


def sensitivity(spark: SparkSession, model: ConditionalModel, bands: list[str], mob: int = 36, shock: dict[str, float] | None = None) -> DataFrame:
    """(score_band, origin, destination, base, shocked, change_bps) for a point more of unemployment."""
    grid = _shocked(spark, model, {"base": {}, "shocked": shock or {"unemployment_rate": 1.0}}, mob, bands)
    wide = model.score(grid).groupBy("score_band", "origin", "destination").pivot("shock", ["base", "shocked"]).agg(F.first("p"))
    return wide.select("*", ((F.col("shocked") - F.col("base")) * 10000).alias("change_bps"))


STRESS = {"unemployment_rate": 3.0, "unemployment_change_3m": 1.0, "hpi_change_yoy": -0.10}


def stress(spark: SparkSession, model: ConditionalModel, band: str, mob: int = 36) -> DataFrame:
    return sensitivity(spark, model, [band], mob, STRESS)


def bands(s: Settings) -> list[str]:
    return [f"FICO_{low:03d}-{high - 1:03d}" for low, high in zip(s.score_edges[:-1], s.score_edges[1:], strict=True)]


# Known effects, in basis points, of a point of unemployment, of a unit of score risk, and of seasoning.
UNEMPLOYMENT_BPS = {"behind": 20.0, "cure": -240.0, "roll": 260.0}
SCORE_BPS = {"behind": 100.0, "cure": -800.0, "roll": 700.0}
SEASONING_BPS, SEASONED_AT, SEASONING_WIDTH, AGES = 40.0, 28.0, 22.0, (28, 100)


def known_effects(s: Settings, low: str, middle: str) -> list[tuple[str, str, str, float]]:
    """(driver, origin, destination, bps): each moving state's known responses, 23 for the six states of the published model."""
    risk = lambda b: float(np.clip((700 - sum(map(int, b.rsplit("_", 1)[1].split("-"))) / 2) / 100, -0.8, 1.8))
    gap = risk(low) - risk(middle)
    out = []
    for driver, size, scale in (("unemployment", UNEMPLOYMENT_BPS, 1.0), ("lower_score", SCORE_BPS, gap)):
        for k, origin in enumerate(moving(s)):
            targets = destinations(origin, s)
            if k == 0:
                out.append((driver, origin, targets[1], size["behind"] * (scale if driver == "unemployment" else max(scale, 0.0))))
            else:
                out += [(driver, origin, targets[0], size["cure"] * scale), (driver, origin, targets[2], size["roll"] * scale)]
    at = [np.exp(-(((age - SEASONED_AT) / SEASONING_WIDTH) ** 2)) for age in AGES]
    return [*out, ("seasoning", moving(s)[0], moving(s)[1], float(SEASONING_BPS * (at[0] - at[1])))]


def recovery(spark: SparkSession, model: ConditionalModel, mob: int = 36) -> DataFrame:
    """(driver, origin, destination, known_bps, fitted_bps, expected_sign, agrees) for all known_effects()."""
    every = bands(model.settings)
    low, middle = every[0], every[len(every) // 2]
    names = list(model.defaults)
    point = lambda move: [model.defaults[c] + (move if c.startswith("unemployment_rate") else 0.0) for c in names]
    grid = [("base", mob, middle, *point(0.0)), ("unemployment", mob, middle, *point(1.0)), ("lower_score", mob, low, *point(0.0)), ("young", AGES[0], middle, *point(0.0)), ("seasoned", AGES[1], middle, *point(0.0))]
    scored = model.score(spark.createDataFrame(grid, "shock string, months_on_book int, score_band string, " + ", ".join(f"{c} double" for c in names))).select("shock", "origin", "destination", "p")
    pairs = [("unemployment", "unemployment", "base"), ("lower_score", "lower_score", "base"), ("seasoning", "young", "seasoned")]
    known = spark.createDataFrame([(d, shock, against, o, t, bps) for d, o, t, bps in known_effects(model.settings, low, middle) for n, shock, against in pairs if n == d], "driver string, shock string, against string, origin string, destination string, known_bps double")
    moved = known.join(scored, ["shock", "origin", "destination"], "left").join(scored.select(F.col("shock").alias("against"), "origin", "destination", F.col("p").alias("p0")), ["against", "origin", "destination"], "left")
    fitted = (F.coalesce("p", F.lit(0.0)) - F.coalesce("p0", F.lit(0.0))) * 10000
    up = F.col("known_bps") > 0
    return moved.select("driver", "origin", "destination", "known_bps", fitted.alias("fitted_bps"), F.when(up, "positive").otherwise("negative").alias("expected_sign"), F.when(up, fitted > 0).otherwise(fitted < 0).alias("agrees"))


def enforce_recovery(table: DataFrame) -> None:
    """Raises ConditionalError where a fitted effect has not the known sign."""
    wrong = table.where("not agrees").collect()  # a row a known effect
    if wrong:
        raise ConditionalError(f"wrong signs: {[(r.driver, r.origin, r.destination) for r in wrong]}")


def material(table: DataFrame, least_bps: float = 1.0) -> DataFrame:
    """The rows of sensitivity() that a point of unemployment moves by a basis point or more."""
    return table.where(F.abs("change_bps") >= least_bps)
