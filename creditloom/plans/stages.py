"""The stages from raw files to scenario losses. Each reads curated Parquet and writes its own; reports come back as dicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.config import Settings
from creditloom.operators import attribution, conditional, ecl, forecast, lgd, macro, panel, quality, scenarios, transitions, vintage
from creditloom.plans.credit import ACQ_REASONS, PERF_REASONS
from creditloom.plans.lens import kept, local
from creditloom.sources import layout, publish, synthetic, tables

EARLY_DROPS = ("occupancy_status", "channel")


def _raw(s: Settings, name: str) -> str:
    return f"{s.data_root}/raw/{name}"


def curated(s: Settings, name: str) -> str:
    return f"{s.data_root}/curated/{name}"


def _report(s: Settings, name: str) -> str:
    return f"{s.data_root}/reports/{name}"


def synthetic_stage(spark: SparkSession, s: Settings) -> dict:
    loans, rows, series = synthetic.portfolio(spark, s)
    raw = {"acquisition": loans.drop("vintage_year"), "performance": rows, "macro": series}
    for name, df in raw.items():
        df.write.mode("overwrite").option("header", s.header).option("sep", "," if name == "macro" else s.delimiter).option("dateFormat", s.date_format).csv(_raw(s, name))
    return {"loans": s.loans}


def _kept(df: DataFrame, columns: list[str], kept_: Column, excluded: Column) -> DataFrame:
    """df with the column part: kept, excluded, or other; of other rows only the loan's id is left."""
    part = F.when(excluded, "excluded").when(kept_, "kept").otherwise("other")
    df = df.withColumn("part", part)
    return df.select(quality.REASONS, "part", "loan_id", *[F.when(F.col("part") != "other", F.col(c)).alias(c) for c in columns if c != "loan_id"])


def _publish(spark: SparkSession, new: str, path: str, vintages: Sequence[int] | None) -> None:
    if vintages is None or not publish.exists(spark, path):
        publish.replace(spark, new, path)
    else:
        publish.replace_parts(spark, new, path, [f"vintage_year={v}" for v in vintages])


def ingest_stage(spark: SparkSession, s: Settings, vintages: Sequence[int] | None = None) -> dict:
    """Tags, gates, samples by loan, and writes curated tables by vintage year; excluded rows are kept beside them.

    Each raw table is read once, by the job that writes its draft; the drafts' counts are the gate. Only when both pass are
    both published. With vintages, only these are written, and replace their directories alone; a rerun gives the same.
    """
    raw = {name: tables.read_delimited(spark, _raw(s, name), schema, s) for name, schema in (("acquisition", tables.acquisition_schema()), ("performance", tables.performance_schema()))}
    invalid = F.size(quality.REASONS) > 0
    with publish.drafts(spark, curated(s, "acquisition"), curated(s, "performance")) as (loans, rows):
        tagged = quality.scan_acquisition(raw["acquisition"].drop(*EARLY_DROPS)).withColumn("vintage_year", F.year("origination_month"))
        wanted = quality.in_sample("loan_id", s.sample_fraction, s)
        if vintages is not None:
            wanted &= F.coalesce(F.col("vintage_year").isin(*vintages), F.lit(False))
        tagged = _kept(tagged, tagged.drop(quality.REASONS).columns, wanted, invalid)
        publish.write(loans, tagged, ("part", "vintage_year"), s, [*quality.counts(ACQ_REASONS), F.count_if(F.col("part") == "kept").alias("kept_rows")], drop=[quality.REASONS])
        _enforce_ingest(loans, ACQ_REASONS, s)
        if not loans.counts["kept_rows"]:
            raise quality.QualityError("the sample has no loan")

        kept_ = F.struct((F.col("part") == "kept").alias("kept"), F.col("vintage_year").cast("int").alias("vintage_year"))
        known = loans.read().where(F.col("loan_id").isNotNull()).groupBy("loan_id").agg(F.max(kept_).alias("_loan"))
        tagged = quality.scan_performance(raw["performance"].drop("modification_flag"), known).withColumn("vintage_year", F.col("_loan.vintage_year"))
        tagged = _kept(tagged, tagged.drop(quality.REASONS, "_loan").columns, F.coalesce(F.col("_loan.kept"), F.lit(False)), invalid)
        publish.write(rows, tagged, ("part", "vintage_year"), s, quality.counts(PERF_REASONS), keep=F.col("part") != "other", drop=[quality.REASONS])
        _enforce_ingest(rows, PERF_REASONS, s, "as_of_month")

        for name, draft in (("acquisition", loans), ("performance", rows)):
            _publish(spark, f"{draft.at}/part=kept", curated(s, name), vintages)
            if draft.counts["excluded_rows"]:
                publish.replace(spark, f"{draft.at}/part=excluded", curated(s, f"excluded/{name}"))
            else:
                publish.remove(spark, curated(s, f"excluded/{name}"))
    return {name: tables.file_summary(spark, curated(s, name)).first().asDict() for name in ("acquisition", "performance")}


def _enforce_ingest(draft: publish.Draft, reasons: list[str], s: Settings, *more: str) -> None:
    """The gate of a draft. Rows without an id meet in no window; whether they repeat is counted over the excluded rows, if there are any."""
    found = {k: v for k, v in draft.counts.items() if k != "kept_rows"}
    missing, repeated = (next(r for r in reasons if x in r) for x in ("missing_loan_id", "duplicate_loan"))
    if found[missing]:
        found[repeated] += quality.repeats_without_id(draft.read().where("part = 'excluded'"), *more)
    quality.enforce_counts(found, s)


def macro_table(spark: SparkSession, s: Settings) -> DataFrame:
    series = tables.read_macro(spark, _raw(s, "macro"), s)
    macro.enforce(series)
    return macro.features(series, s.macro_lags)


COLOCATED = {"acquisition": [], "performance": ["as_of_month"]}


def _bucketed(s: Settings, name: str, buckets: int) -> dict:
    """Name, place and order of a co-located table; the place tells the number of buckets, so a rewrite with another is another table."""
    return {"table": f"{s.env}_{name}_{buckets}", "path": curated(s, f"colocated/{name}-{buckets}"), "key": "loan_id", "order": COLOCATED[name], "buckets": buckets}


def colocate_stage(spark: SparkSession, s: Settings, bucket_bytes: int = layout.BUCKET_BYTES) -> dict:
    """Curated loans and months once more, bucketed and sorted by loan; both with as many buckets as the months need."""
    size = tables.file_summary(spark, curated(s, "performance")).first().total_bytes
    buckets = layout.buckets_for(size, bucket_bytes)
    for name in COLOCATED:
        spark.sql(f"drop table if exists {_bucketed(s, name, buckets)['table']}")
        layout.write(spark.read.parquet(curated(s, name)), **_bucketed(s, name, buckets))
    return {"buckets": buckets}


def colocated(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    """The co-located tables with the most buckets, named anew where the catalog has forgotten them."""
    found = {int(x.rsplit("-", 1)[1]) for x in publish.children(spark, curated(s, "colocated"))}
    if not found:
        raise FileNotFoundError(curated(s, "colocated"))
    out = {}
    for name in COLOCATED:
        at = _bucketed(s, name, max(found))
        out[name] = spark.table(at["table"]) if spark.catalog.tableExists(at["table"]) else layout.register(spark, **at)
    return out


def panel_stage(spark: SparkSession, s: Settings, vintages: Sequence[int] | None = None, by_loan: bool = False) -> dict:
    """The panel by vintage year, gated by the counts of its own write; with vintages, only these are read and replaced.

    by_loan: from the co-located tables, which need no shuffle by loan.
    """
    source = colocated(spark, s) if by_loan else {name: spark.read.parquet(curated(s, name)) for name in COLOCATED}
    loans, rows = source["acquisition"], source["performance"]
    if vintages is not None:
        loans, rows = (df.where(F.col("vintage_year").isin(*vintages)) for df in (loans, rows))
    ends = panel.exits(s)
    with publish.drafts(spark, curated(s, "panel")) as (draft,):
        built = panel.build(loans, rows, macro_table(spark, s), s)
        found = publish.write(draft, built, ("vintage_year",), s, [*panel.counts(s), *[n.alias(f"exit_{x}") for x, n in ends.items()]], drop=panel.CHECKS).counts
        exits = {x: found.pop(f"exit_{x}") for x in ends}
        panel.enforce_counts(found, s)
        _publish(spark, draft.at, curated(s, "panel"), vintages)
    return found | {"exits": exits}


def vintage_stage(spark: SparkSession, s: Settings) -> dict:
    """Ultimates by cohort and by year under both denominators, their decomposition, backtest and realised LGD; all gated."""
    rows, loans = spark.read.parquet(curated(s, "panel")), spark.read.parquet(curated(s, "acquisition"))
    seen = {"fit_end": s.cutoff, "env": s.env}
    with kept(vintage.triangle(rows, loans, s.cohort_grain, s.cutoff)) as tri, kept(vintage.curves(tri, s.maturity_mob, s.denominator)) as table:
        vintage.enforce_no_gaps(table)
        vintage.enforce_seasoned(table, s.maturity_mob)
        parts = vintage.decomposition(tri)
        vintage.enforce_decomposition(parts)
        with kept(vintage.ultimates(vintage.project(table, s.maturity_mob), s.maturity_mob)) as out:
            if s.crisis_gate:
                vintage.enforce_crisis_order(out)
            tables.write_report(vintage.ultimate_table(tri, s.maturity_mob), _report(s, "vintage_ultimates"), **seen)
            tables.write_report(parts, _report(s, "loss_decomposition"), **seen)
            whole = local(vintage.triangle(rows, loans, s.cohort_grain))
            pairs = local(vintage.backtest_comparison(out, whole, s.maturity_mob, s.backtest_gate))
            found = vintage.portfolio_ultimate(out).first().asDict()
        tri.orderBy("vintage", "months_on_book").write.mode("overwrite").parquet(curated(s, "vintage_triangle"))
    tables.write_report(pairs.orderBy("vintage"), _report(s, "vintage_backtest"), **seen)
    tables.write_report(vintage.backtest_metrics(pairs), _report(s, "vintage_backtest_metrics"), **seen)
    annual = vintage.triangle(rows, loans, "annual", s.cutoff)
    tables.write_report(vintage.ultimate_table(local(annual), s.maturity_mob), _report(s, "vintage_ultimates_annual"), **seen)
    tables.write_report(vintage.lgd_by_era(rows), _report(s, "realised_lgd_by_era"), fit_end="all months", env=s.env)
    return found


def transition_stage(spark: SparkSession, s: Settings) -> dict:
    """Counts, the empirical matrix, the conditional models, and what they say: stress, material effects, known signs."""
    rows = spark.read.parquet(curated(s, "panel"))
    transitions.cube(rows).write.mode("overwrite").parquet(curated(s, "transition_counts"))
    counts = spark.read.parquet(curated(s, "transition_counts"))
    table = local(transitions.matrix(counts, s))
    transitions.enforce(table, s)
    tables.write_report(table, _report(s, "transition_matrix"), env=s.env)
    series = macro_table(spark, s)
    model = conditional.fit(transitions.fit_sample(counts, s.fit_end), series, s)
    conditional.save(spark, model, _model_path(s, s.fit_end), **_provenance(counts, series, s.fit_end))
    every = conditional.bands(s)
    middle = every[len(every) // 2]
    stressed = local(conditional.stress(spark, model, middle))
    for column in ("base", "shocked"):
        transitions.enforce(stressed.withColumnRenamed(column, "probability"), s, 1e-9)
    signs = local(conditional.recovery(spark, model))
    fitted = {"fit_end": str(s.fit_end), "env": s.env}
    tables.write_report(conditional.coefficient_table(spark, model), _report(s, "transition_coefficients"), **fitted)
    tables.write_report(conditional.bic_table(spark, model), _report(s, "transition_bic"), **fitted)
    tables.write_report(stressed, _report(s, "transition_stress"), **fitted)
    tables.write_report(conditional.material(conditional.sensitivity(spark, model, [middle])), _report(s, "transition_interpretations"), **fitted)
    tables.write_report(signs, _report(s, "transition_ground_truth"), **fitted)
    if s.sign_gate:
        conditional.enforce_recovery(signs)
    return {"repurchase": model.repurchase, "delinquent_prepay": model.delinquent_prepay, "lags": {o: m.lag for o, m in model.origins.items()}, "work": tables.stage_summary(spark)}


def _counts(spark: SparkSession, s: Settings, rows: DataFrame) -> DataFrame:
    return tables.load_or_build(spark, curated(s, "transition_counts"), lambda: transitions.cube(rows))


def _model_path(s: Settings, fit_end: str | None) -> str:
    return curated(s, f"models/conditional-{fit_end or 'all'}")


def _provenance(counts: DataFrame, series: DataFrame, fit_end: str | None) -> dict[str, str]:
    """What a model is fitted to: its last month, and digests of the counts and of the macro series."""
    digest = lambda df: df.agg(F.concat_ws("/", F.count("*"), F.bit_xor(F.xxhash64(*sorted(df.columns))))).first()[0]
    return {"fit_end": str(fit_end), "counts": digest(counts), "macro": digest(series)}


def _model(spark: SparkSession, s: Settings, counts: DataFrame, series: DataFrame, fit_end: str | None) -> conditional.ConditionalModel:
    """The conditional model of the months up to fit_end: the saved one if it was fitted to these counts, else a new one, saved."""
    seen = _provenance(counts, series, fit_end)
    model = conditional.load(spark, _model_path(s, fit_end), s, **seen)
    if model is None:
        model = conditional.fit(transitions.fit_sample(counts, fit_end), series, s)
        conditional.save(spark, model, _model_path(s, fit_end), **seen)
    return model


def _upto(rows: DataFrame, fit_end: str | None) -> DataFrame:
    return rows if fit_end is None else rows.where(F.col("as_of_month") <= F.lit(fit_end).cast("date"))


def _segments(spark: SparkSession, s: Settings, rows: DataFrame) -> DataFrame:
    """The segments of the loans active at the cutoff, which hold their whole balance."""
    active = ecl.active_at(rows, s.cutoff, s)
    segs = local(ecl.segments(active, spark.read.parquet(curated(s, "acquisition"))))
    ecl.enforce_balance(segs, active)
    return segs


def ecl_stage(spark: SparkSession, s: Settings, horizon: int | None = None) -> dict:
    """Expected loss from the cutoff on along the observed macro months, under both fit windows, and its validation."""
    horizon, cutoff = horizon or s.maturity_mob, F.lit(s.cutoff).cast("date")
    series = macro_table(spark, s)
    path = local(series.withColumn("step", F.months_between("as_of_month", cutoff).cast("int")).where(F.col("step").between(1, horizon)))
    horizon = path.count()
    until = str(path.agg(F.max("as_of_month")).first()[0])
    rows, loans = spark.read.parquet(curated(s, "panel")), spark.read.parquet(curated(s, "acquisition"))
    counts, segs = _counts(spark, s, rows), _segments(spark, s, rows)
    balance = segs.agg(F.sum("balance")).first()[0]
    found = local(attribution.realised(rows, ecl.active_at(rows, s.cutoff, s), s.cutoff, until))
    real = found.agg(F.coalesce(F.sum("realised_loss"), F.lit(0.0))).first()[0]
    with kept(vintage.curves(vintage.triangle(rows, loans, s.cohort_grain, s.cutoff), s.maturity_mob)) as table:
        vintage.enforce_seasoned(table, s.maturity_mob)
        ladder = local(vintage.ultimates(vintage.project(table, s.maturity_mob), s.maturity_mob))
    out, projected = {}, {}
    for name, end in (("production", s.fit_end), ("cutoff", s.backtest_fit_end)):
        seen = {"fit": name, "fit_end": str(end), "env": s.env}
        model = _model(spark, s, counts, series, end)
        with kept(lgd.observations(_upto(rows, end)).select("score_band", "vintage", "hpi_change_yoy", "upb_bom", "recovery")) as defaults:
            coefs = local(lgd.fit(defaults, fallback_lgd=s.fallback_lgd))
            tables.write_report(lgd.validation(defaults, coefs, s), _report(s, f"lgd_validation_{name}"), **seen)
        tables.write_report(coefs, _report(s, f"lgd_coefficients_{name}"), **seen)
        with kept(ecl.expected_loss(model.matrices(segs, path, horizon), coefs, segs, path, horizon, s, check=True)) as detail:
            for label, by in (("score_band", ["score_band"]), ("vintage_year", ["vintage_year"]), ("portfolio", [])):
                tables.write_report(ecl.decompose(detail, *by), _report(s, f"ecl_{name}_{label}"), **seen)
            tables.write_report(ecl.monthly(detail), _report(s, f"ecl_{name}_monthly"), **seen)
            checked = local(attribution.validate(attribution.by_year(detail, s.cutoff), found, balance))
            attribution.enforce(checked)
            tables.write_report(checked, _report(s, f"truth_validation_{name}"), **seen)
            if name == "cutoff":
                tables.write_report(attribution.reconciliation(ladder, detail, balance), _report(s, "reconciliation"), **seen)
            sums = detail.agg(F.sum("ecl").alias("ecl"), F.sum("undiscounted_loss").alias("loss")).first()
        out[name], projected[name] = sums.ecl, sums.loss
    left = ladder.agg(F.sum((F.col("chain_ladder_ultimate") - F.col("observed_rate")) * F.col("original_balance"))).first()[0]
    fits = spark.createDataFrame([*((k, float(v), float(real)) for k, v in projected.items()), ("chain ladder", float(left or 0), float(real))], "fit string, projected double, realised double")
    tables.write_report(attribution.comparison(fits, str(s.backtest_fit_end), s.fit_end).orderBy("order"), _report(s, "fit_comparison"), env=s.env)
    return out | {"realised_loss": real, "balance": balance, "segments": segs.count(), "months": horizon, "work": tables.stage_summary(spark)}


def scenario_stage(spark: SparkSession, s: Settings, path: str, horizon: int | None = None) -> dict:
    """Each published scenario's paths, losses and flows, by the models fitted to all months."""
    horizon, cutoff = horizon or s.maturity_mob, F.lit(s.cutoff).cast("date")
    monthly = scenarios.quarterly_to_monthly(scenarios.published(tables.read_scenarios(spark, path), s.scenario_vintage, s.horizon_quarters))
    series = macro_table(spark, s)
    history = series.where((F.col("as_of_month") <= cutoff) & (F.col("as_of_month") > F.add_months(cutoff, -12)))
    table = local(scenarios.paths(scenarios.extend(monthly, horizon, s), history, s))
    scenarios.enforce(table, s)
    seen = {"fit_end": str(s.fit_end), "env": s.env}
    tables.write_report(scenarios.extrapolation(table, s), _report(s, "scenario_extrapolation"), **seen)
    tables.write_report(table, _report(s, "scenario_paths"), **seen)
    rows = spark.read.parquet(curated(s, "panel"))
    model = _model(spark, s, _counts(spark, s, rows), series, s.fit_end)
    coefs, segs = local(lgd.fit(lgd.observations(_upto(rows, s.fit_end)), fallback_lgd=s.fallback_lgd)), _segments(spark, s, rows)
    details, flows = None, {}
    for name in sorted(r.scenario for r in table.select("scenario").distinct().collect()):  # a few scenarios
        own = table.where(F.col("scenario") == name).withColumn("step", F.months_between("as_of_month", cutoff).cast("int")).drop("scenario", "is_published")
        matrices = model.matrices(segs, own, horizon)
        one = local(ecl.expected_loss(matrices, coefs, segs, own, horizon, s, check=True).withColumn("scenario", F.lit(name)))
        flows[name] = local(scenarios.flows(forecast.forecast(segs, matrices, s.states, horizon), matrices, segs))
        details = one if details is None else details.unionByName(one)
    out = local(scenarios.summary(local(ecl.decompose(details, "scenario").select("scenario", "balance", "ecl"))))
    tables.write_report(out, _report(s, "scenario_summary"), **seen)
    tables.write_report(scenarios.monthly(details), _report(s, "scenario_monthly"), **seen)
    losses = {r.scenario: r.ecl for r in out.collect()}  # a row a scenario
    worst = max((n for n in losses if n != "baseline"), key=losses.get, default=None)
    if "baseline" in flows and worst:
        tables.write_report(scenarios.flow_attribution(flows[worst], flows["baseline"]), _report(s, "scenario_transition_attribution"), worst=worst, **seen)
    return losses


STAGES = {"synthetic": synthetic_stage, "ingest": ingest_stage, "colocate": colocate_stage, "panel": panel_stage, "vintage": vintage_stage, "transitions": transition_stage, "ecl": ecl_stage}


def sampled(s: Settings, fraction: float | None) -> Settings:
    return s if fraction is None else replace(s, sample_fraction=fraction).validate()
