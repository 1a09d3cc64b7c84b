"""The stages end to end on a small synthetic portfolio, the conditional models, and the stream."""

import shutil
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.config import Settings
from creditloom.operators import attribution, conditional, forecast, macro, panel, quality, scenarios, transitions, vintage
from creditloom.plans import credit, stages
from creditloom.sources import publish, synthetic, tables
from creditloom.streaming import transitions as stream


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    return replace(Settings(), loans=400, first_vintage=2004, last_vintage=2010, max_months=48, cutoff="2009-06-01", backtest_fit_end="2009-06-01", maturity_mob=24, data_root=str(tmp_path_factory.mktemp("data")), max_rate_per_reason=1.0, max_rate_overall=1.0, crisis_gate=False, sign_gate=False, backtest_gate=False)


@pytest.fixture(scope="module")
def built(spark, settings):
    stages.synthetic_stage(spark, settings)
    stages.ingest_stage(spark, settings)
    return stages.panel_stage(spark, settings)


def test_more_loans_keep_the_first_ones(spark, settings):
    few, many = (synthetic.portfolio(spark, replace(settings, loans=n))[1] for n in (20, 40))
    keys = ["loan_id", "as_of_month"]
    assert few.count() and few.exceptAll(many).count() == 0
    assert few.groupBy(*keys).count().where("count > 1").isEmpty()
    assert few.select(*keys).exceptAll(synthetic.portfolio(spark, replace(settings, loans=20))[1].select(*keys)).isEmpty()


def test_the_source_reads_by_vintage_in_any_session(spark, settings, monkeypatch):
    s = replace(settings, loans=37)
    whole = sorted(map(repr, (tuple(r) for r in synthetic.portfolio(spark, s)[1].collect())))
    read = lambda **o: spark.read.format("synthetic_portfolio").options(**{k: str(getattr(s, k)) for k in synthetic.OPTIONS} | o).load()
    rows = read()
    assert rows.rdd.getNumPartitions() == 7  # a vintage a partition
    years = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct(F.year("origination_month")).alias("n")).collect()
    assert [r.n for r in years] == [1] * 7
    assert sorted(map(repr, (tuple(r) for r in rows.select("loan_id", *synthetic.NAMES[8:]).collect()))) == whole
    parts = synthetic.PortfolioReader(replace(s, loans=30_000)).partitions()
    numbers = sorted(p.first + k * p.step for p in parts for k in range(p.count))
    assert numbers == list(range(30_000)) and max(p.count for p in parts) <= synthetic.LOANS_PER_TASK and len(parts) > 7
    assert synthetic.PortfolioReader(replace(s, loans=0)).partitions() == []
    with pytest.raises(Exception, match="unknown options"):
        read(loanz="3").count()


def test_panel_is_whole(spark, settings, built):
    loans = spark.read.parquet(stages.curated(settings, "acquisition"))
    assert loans.count() == 400 and built["loans_without_one_terminal"] == 0 and sum(built["exits"].values()) == 400
    assert tables.file_summary(spark, stages.curated(settings, "panel")).first().files >= 7
    assert set(tables.stage_summary(spark)) == {"jobs", "stages", "tasks", "failed_tasks", *tables.STAGE_BYTES}
    rows = spark.read.parquet(stages.curated(settings, "panel"))
    assert not set(panel.CHECKS) & set(rows.columns)


def listing(path):
    return sorted((str(p.relative_to(path)), p.stat().st_size, p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet"))


@pytest.fixture
def other(spark, settings, built, tmp_path):
    """A copy of the data, to be spoilt."""
    out = replace(settings, data_root=str(tmp_path / "copy"))
    shutil.copytree(settings.data_root, out.data_root)
    return out


def raw_lines(s, name, change):
    """Puts changed lines in the place of a raw table; headers stay."""
    for path in sorted(Path(f"{s.data_root}/raw/{name}").glob("*.csv")):
        head, *lines = path.read_text().splitlines()
        path.write_text("\n".join([head, *change(lines)]) + "\n")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def test_drafts_are_written_in_one_pass_without_a_cache(spark, other, monkeypatch):
    plans = []
    write = publish.write

    def spy(draft, df, *a, **k):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(draft, df, *a, **k)

    monkeypatch.setattr(publish, "write", spy)
    monkeypatch.setattr(DataFrame, "persist", lambda *a: pytest.fail("persisted"))
    stages.ingest_stage(spark, other)
    stages.panel_stage(spark, other)
    loans, rows, built_ = plans
    assert loans.count("Relation [") == 1 and loans.count("csv") == 1
    assert rows.count(" csv") == 1 and rows.count(" parquet") == 1  # the raw table, and the loans' draft
    assert built_.count(" parquet") == 2 and not any("InMemoryRelation" in p for p in plans)


def test_broken_input_leaves_the_old_tables(spark, other):
    before = {name: listing(f"{other.data_root}/curated/{name}") for name in ("acquisition", "performance", "panel")}
    strict = replace(other, max_rate_per_reason=0.001, max_rate_overall=0.001)
    good = Path(other.data_root) / "raw"
    shutil.copytree(good, good.parent / "good")
    breaks = [
        ("acquisition", lambda lines: [x if k % 40 else x.replace(x.split("|")[5], "9999", 1) for k, x in enumerate(lines)], "score_out_of_range"),
        ("acquisition", lambda lines: [*lines, *lines[:1]], "duplicate_loan_id: "),
        ("acquisition", lambda lines: [*lines, *["|" + x.split("|", 1)[1] for x in lines[:2]]], "duplicate_loan_id: "),
        ("performance", lambda lines: [*lines, *[f"stranger{k}|" + x.split("|", 1)[1] for k, x in enumerate(lines[:2])]], "orphan_loan_id"),
        ("performance", lambda lines: [*lines, *lines[:1]], "duplicate_loan_month"),
    ]
    for name, change, said in breaks:
        raw_lines(other, name, change)
        with pytest.raises(quality.QualityError, match=said):
            stages.ingest_stage(spark, strict)
        shutil.rmtree(good)
        shutil.copytree(good.parent / "good", good)
    rows = spark.read.parquet(stages.curated(other, "performance"))
    rows.where("loan_age <> 3 or loan_id not like '%1'").withColumn("x", F.lit(1)).write.mode("overwrite").partitionBy("vintage_year").parquet(f"{other.data_root}/curated/gaps")
    shutil.move(f"{other.data_root}/curated/performance", f"{other.data_root}/curated/whole")
    shutil.move(f"{other.data_root}/curated/gaps", f"{other.data_root}/curated/performance")
    with pytest.raises(panel.PanelError, match="gap_rows"):
        stages.panel_stage(spark, other)
    shutil.move(f"{other.data_root}/curated/performance", f"{other.data_root}/curated/gaps")
    shutil.move(f"{other.data_root}/curated/whole", f"{other.data_root}/curated/performance")
    assert before == {name: listing(f"{other.data_root}/curated/{name}") for name in before}
    assert not [p for p in (Path(other.data_root) / "curated").iterdir() if "draft" in p.name or "old" in p.name]


def test_excluded_rows_are_kept_beside_and_counted_as_by_several_passes(spark, other):
    raw_lines(other, "acquisition", lambda lines: [*lines, *["|" + x.split("|", 1)[1] for x in lines[:2]], " |" + lines[0].split("|", 1)[1]])
    seen = []
    lax = replace(other, fatal_reasons=())
    with pytest.MonkeyPatch.context() as m:
        real = quality.enforce_counts
        m.setattr(quality, "enforce_counts", lambda found, s: seen.append(dict(found)) or real(found, s))
        stages.ingest_stage(spark, lax)
    raw = tables.read_delimited(spark, stages._raw(other, "acquisition"), tables.acquisition_schema(), other)
    want = {r.reason: r.failed for r in quality.summarise(quality.tag_acquisition(raw), credit.ACQ_REASONS).collect()}
    assert {k: v for k, v in seen[0].items() if k in want} == want and want["acquisition_duplicate_loan_id"] >= 2
    assert spark.read.parquet(stages.curated(other, "excluded/acquisition")).count() == seen[0]["excluded_rows"]
    assert spark.read.parquet(stages.curated(other, "acquisition")).count() == 400


def test_a_vintage_alone_is_rewritten(spark, other):
    read = lambda name: {tuple(r) for r in spark.read.parquet(stages.curated(other, name)).drop("x").collect()}
    names = ("acquisition", "performance", "panel")
    rows, files = {n: read(n) for n in names}, {n: listing(stages.curated(other, n)) for n in names}
    for _ in range(2):
        stages.ingest_stage(spark, other, [2006])
        counts = stages.panel_stage(spark, other, [2006])
        assert {n: read(n) for n in names} == rows
    own = lambda found, is_own: [x for x in found if ("vintage_year=2006/" in x[0]) == is_own]
    for n in names:
        now = listing(stages.curated(other, n))
        assert own(now, False) == own(files[n], False) and own(now, True) != own(files[n], True)
    assert counts["row_count"] == sum(r[-1] == 2006 for r in rows["panel"])
    # A vintage that the source no longer has goes, and no other.
    raw_lines(other, "acquisition", lambda lines: [x for x in lines if "|2007-" not in x])
    lax = replace(other, fatal_reasons=())
    stages.ingest_stage(spark, lax, [2006, 2007])
    assert {p.name for p in Path(stages.curated(other, "acquisition")).glob("vintage*")} == {f"vintage_year={y}" for y in range(2004, 2011) if y != 2007}


def test_the_panel_from_colocated_tables_is_the_same(spark, other, monkeypatch):
    read = lambda: {tuple(r) for r in spark.read.parquet(stages.curated(other, "panel")).collect()}
    want, plans, write = read(), [], publish.write
    with pytest.raises(FileNotFoundError):
        stages.panel_stage(spark, other, by_loan=True)
    made = stages.colocate_stage(spark, other, bucket_bytes=20_000)
    assert made["buckets"] > 1 and len(list(Path(stages.curated(other, f"colocated/performance-{made['buckets']}")).glob("*.parquet"))) == made["buckets"]
    stages.colocate_stage(spark, other, bucket_bytes=20_000)  # again, in place
    monkeypatch.setattr(publish, "write", lambda draft, df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(draft, df, *a, **k))
    for name in stages.COLOCATED:
        spark.sql(f"drop table {stages._bucketed(other, name, made['buckets'])['table']}")  # as in a new session
    for vintages in (None, [2005]):
        stages.panel_stage(spark, other, vintages, by_loan=True)
        assert read() == want
    assert not any("Exchange hashpartitioning(loan_id" in p for p in plans) and all("Window" in p for p in plans)


def test_a_run_that_died_between_two_renames_is_mended(spark, tmp_path, settings):
    table = str(tmp_path / "t")
    df = spark.range(4).withColumn("vintage_year", (F.col("id") % 2).cast("int"))
    df.write.partitionBy("vintage_year").parquet(table)
    shutil.move(table, f"{table}.old-1")
    with publish.drafts(spark, table):
        assert spark.read.parquet(table).count() == 4
    shutil.copytree(table, f"{table}.old-2")
    shutil.move(f"{table}/vintage_year=1", f"{table}/vintage_year=1.old-3")
    publish.recover(spark, table)
    assert spark.read.parquet(table).count() == 4 and {p.name for p in tmp_path.iterdir()} == {"t"}
    with pytest.raises(publish.PublishError):
        publish.replace(spark, str(tmp_path / "nothing"), table)
    assert spark.read.parquet(table).count() == 4
    with pytest.raises(ValueError), publish.drafts(spark, table) as (draft,):
        publish.write(draft, df, ("vintage_year",), settings, [F.count("*").alias("n"), F.max("id").alias("top")], keep=F.col("id") > 1)
        assert draft.counts == {"n": 4, "top": 3} and draft.read().count() == 2
        raise ValueError
    assert {p.name for p in tmp_path.iterdir()} == {"t"}


def reports(settings):
    return {x.name for x in (Path(settings.data_root) / "reports").iterdir()}


def scenario_file(folder, settings, drop=None):
    label = lambda q: f"{2008 + (q + 2) // 4}Q{(q + 2) % 4 + 1}"
    rows = [(settings.scenario_vintage, "historical", label(q), 5.0, 200.0 + q, "x") for q in range(4)]
    rows += [(settings.scenario_vintage, n, label(4 + q), 5.0 + tilt * min(q, 8), 204.0 - tilt * 6 * min(q, 8) + q, "x") for n, tilt in (("baseline", 0.0), ("severe", 0.6)) for q in range(13)]
    path = folder / f"scenarios-{drop}.csv"
    path.write_text("\n".join(["vintage_year,scenario,quarter,unemployment_rate,house_price_index,source_url", *(",".join(map(str, r)) for r in rows if r[2] != drop)]))
    return str(path)


@pytest.fixture(scope="module")
def staged(spark, settings, built):
    return {"vintage": stages.vintage_stage(spark, settings), "transitions": stages.transition_stage(spark, settings), "ecl": stages.ecl_stage(spark, settings, 6)}


@pytest.fixture(scope="module")
def model(spark, settings, built):
    rows = spark.read.parquet(stages.curated(settings, "panel"))
    return conditional.fit(transitions.cube(rows), stages.macro_table(spark, settings), settings)


def test_later_stages_and_their_reports(spark, settings, staged, model, tmp_path, monkeypatch):
    assert staged["vintage"]["vintages"] > 0
    assert 0 <= staged["transitions"]["repurchase"] < 0.05 and staged["transitions"]["lags"]["Current"] in (0, 1, 3, 6) and staged["transitions"]["work"]["stages"] >= 0
    assert staged["ecl"]["production"] > 0 and staged["ecl"]["cutoff"] > 0 and staged["ecl"]["months"] == 6
    monkeypatch.setattr(conditional, "fit", lambda *a: model)
    losses = stages.scenario_stage(spark, settings, scenario_file(tmp_path, settings), 45)
    assert set(losses) == {"baseline", "severe"} and min(losses.values()) > 0
    assert reports(settings) >= {
        "vintage_ultimates", "vintage_ultimates_annual", "loss_decomposition", "vintage_backtest", "vintage_backtest_metrics", "realised_lgd_by_era",
        "transition_matrix", "transition_coefficients", "transition_bic", "transition_stress", "transition_interpretations", "transition_ground_truth",
        *(f"ecl_{fit}_{part}" for fit in ("production", "cutoff") for part in ("score_band", "vintage_year", "portfolio", "monthly")),
        *(f"{part}_{fit}" for fit in ("production", "cutoff") for part in ("lgd_validation", "lgd_coefficients", "truth_validation")), "reconciliation", "fit_comparison",
        "scenario_summary", "scenario_monthly", "scenario_paths", "scenario_extrapolation", "scenario_transition_attribution",
    }
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{settings.data_root}/reports/{name}")
    assert read("transition_ground_truth").count() == 23
    both = read("vintage_ultimates")
    assert {f"{c}_{d}" for c in ("observed_rate", "chain_ladder_ultimate", "scaled_average_ultimate") for d in vintage.DENOMINATORS} <= set(both.columns)
    fits = {r.measure: r for r in read("fit_comparison").collect()}
    assert set(fits) == {"realised", "production", "cutoff", "chain ladder"} and fits["realised"].loss == pytest.approx(staged["ecl"]["realised_loss"])
    assert {r.era for r in read("vintage_backtest_metrics").collect()} == set(vintage.ERAS)
    tri = [(r.vintage, r.months_on_book) for r in spark.read.parquet(stages.curated(settings, "vintage_triangle")).collect()]
    assert tri and tri == sorted(tri)
    assert read("reconciliation").agg(F.sum("amount")).first()[0] == pytest.approx(staged["ecl"]["cutoff"])


def test_vintage_stage_fails_on_bad_input(spark, settings, built):
    with pytest.raises(vintage.VintageError, match="seasoned"):
        stages.vintage_stage(spark, replace(settings, maturity_mob=400))
    with pytest.raises(vintage.VintageError, match="2011 and later"):
        stages.vintage_stage(spark, replace(settings, crisis_gate=True))  # no vintage of 2011 here
    with pytest.raises(Exception, match="no partner"):
        stages.vintage_stage(spark, replace(settings, backtest_gate=True))  # of a few loans a month all may be gone before maturity


def test_transition_stage_fails_on_wrong_signs(spark, settings, model, monkeypatch):
    monkeypatch.setattr(conditional, "fit", lambda *a: model)
    monkeypatch.setattr(conditional, "UNEMPLOYMENT_BPS", {"behind": -20.0, "cure": -240.0, "roll": 260.0})
    with pytest.raises(conditional.ConditionalError, match="Current"):
        stages.transition_stage(spark, replace(settings, sign_gate=True))


def test_ecl_stage_fails_on_bad_input(spark, settings, staged, model, tmp_path, monkeypatch):
    monkeypatch.setattr(conditional, "fit", lambda *a: model)
    other = replace(settings, data_root=str(tmp_path / "other"))
    shutil.copytree(settings.data_root, other.data_root)
    loans = spark.read.parquet(stages.curated(settings, "acquisition"))
    loans.where("loan_id like '%0'").write.mode("overwrite").parquet(stages.curated(other, "acquisition"))
    with pytest.raises(Exception, match="acquisition terms"):
        stages.ecl_stage(spark, other, 3)
    right = conditional.ConditionalModel.matrices
    with monkeypatch.context() as m:
        m.setattr(conditional.ConditionalModel, "matrices", lambda *a, **k: right(*a, **k).withColumn("p", F.col("p") * 0.9))
        with pytest.raises(forecast.ForecastError):
            stages.ecl_stage(spark, settings, 3)
    with monkeypatch.context() as m:
        m.setattr(attribution, "shapley", lambda *a: (F.lit(0.0),) * 3)
        with pytest.raises(attribution.AttributionError):
            stages.ecl_stage(spark, settings, 3)


def test_scenario_stage_fails_without_a_quarter(spark, settings, built, tmp_path):
    with pytest.raises(scenarios.ScenarioError):
        stages.scenario_stage(spark, settings, scenario_file(tmp_path, settings, "2010Q1"), 45)


def test_panel_reconciles_with_its_sources(spark, settings, built):
    """Every source row is in the panel once, with its balance and its loan's terms; nulls equal nulls."""
    loans, rows, panel_ = (spark.read.parquet(stages.curated(settings, t)) for t in ("acquisition", "performance", "panel"))
    columns = ("vintage", "orig_score", "upb_bom", "net_sales_proceeds", "foreclosure_costs")
    own = rows.join(loans.select("loan_id", F.date_format("origination_month", "yyyy-MM").alias("vintage"), "orig_score"), "loan_id").withColumnRenamed("current_upb", "upb_bom")
    found = panel.reconcile(panel_, own, *columns)
    assert found.first()[:] == (rows.count(), rows.count(), 0, 0, 0)
    panel.enforce_reconciled(found)
    for bad in (own.where("loan_age > 0"), own.withColumn("orig_score", F.col("orig_score") + 1), own.withColumn("net_sales_proceeds", F.coalesce("net_sales_proceeds", F.lit(0.0)))):
        with pytest.raises(panel.PanelError):
            panel.enforce_reconciled(panel.reconcile(panel_, bad, *columns))
    months = stages.macro_table(spark, settings)
    values = ["unemployment_rate", "hpi_change_yoy_lag_6"]
    off = panel_.join(months.select("as_of_month", *[F.col(c).alias(f"m_{c}") for c in values]), "as_of_month").where(" or ".join(f"not {c} <=> m_{c}" for c in values))
    assert off.isEmpty()


def test_models_follow_the_economy(spark, model):
    bands = ["FICO_660-699"]
    grid = spark.createDataFrame([(12, b) for b in [*bands, "FICO_740-779"]], "months_on_book int, score_band string")
    table = model.score(grid)
    sums = table.groupBy("score_band", "origin").agg(F.sum("p").alias("m"), F.min("p").alias("low")).collect()
    assert len(sums) == 18 and all(r.m == pytest.approx(1) and r.low >= 0 for r in sums)
    worse = conditional.sensitivity(spark, model, bands).where("origin = 'Current' and destination = 'DPD30'").first()
    assert worse.change_bps > 0
    signs = conditional.recovery(spark, model)
    assert signs.count() == 23 and signs.where("driver = 'unemployment' and origin = 'Current' and destination = 'DPD30' and agrees").count() == 1
    assert conditional.material(conditional.sensitivity(spark, model, bands)).count() > 0


def test_newton_reaches_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    z = x @ np.array([[1.0, 0, -1], [0, 0.5, 1], [0, 0, 0]]).T + [0.2, -0.4, 0]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    w = rng.integers(1, 5, 400).astype(float)
    rows = spark.createDataFrame([("a", int(k), float(v), *map(float, r)) for k, v, r in zip(y, w, x, strict=True)] + [("b", int(k > 0), float(v), *map(float, r)) for k, v, r in zip(y, w, x, strict=True)], "origin string, y int, w double, f0 double, f1 double, f2 double").repartition(3)
    models = [{"origin": o, "classes": n, "features": ["f0", "f1", "f2"], "c": c} for o, n, c in (("a", 3, 10.0), ("b", 2, 10.0), ("a", 3, 0.002))]
    conditional.newton(rows, models)
    for m in models:
        x1 = np.column_stack([np.ones(400), x])
        target = y if m["classes"] == 3 else (y > 0).astype(int)
        sums = conditional._sums(x1, target, w, m["beta"], m["classes"])
        free = np.ones_like(m["beta"])
        free[:, 0] = 0
        gradient = m["c"] * sums[1 : m["beta"].size + 1] + (free * m["beta"]).ravel()
        assert np.abs(gradient).max() < 1e-6 * m["c"] * w.sum()


def test_destinations_and_missing_origins(spark, settings):
    assert conditional.destinations("Current", settings) == ["Current", "DPD30", "Prepaid"]
    assert conditional.destinations("DPD60", settings) == ["DPD30", "DPD60", "DPD90"] and conditional.destinations("DPD150", settings) == ["DPD120", "DPD150", "ChargeOff"]
    months = macro.features(spark.createDataFrame(synthetic.macro_series(settings), tables.macro_schema()), settings.macro_lags)
    day = months.agg(F.max("as_of_month")).first()[0]
    counts = spark.createDataFrame([("Current", "Current", 12, "FICO_700-739", day, 9)], ", ".join(["delinquency_state string, next_delinquency_state string, months_on_book int, score_band string, as_of_month date, transition_count long"]))
    model = conditional.fit(counts, months, settings)
    p = {(r.origin, r.destination): r.p for r in model.score(spark.createDataFrame([(12, "FICO_700-739")], "months_on_book int, score_band string")).collect()}
    assert p["Current", "Current"] == 1 and p["DPD30", "DPD30"] == 1 and p["Prepaid", "Prepaid"] == 1


def test_stream_of_months(spark, settings, tmp_path):
    rows = "loan_id string, as_of_month date, zero_balance_code string, delinquency_status int"
    source = str(tmp_path / "in")
    data = [("a", "2010-01-01", None, 0), ("a", "2010-02-01", None, 30), ("a", "2010-03-01", "01", 0), ("b", "2010-01-01", None, 0), ("b", "2010-02-01", None, 0)]
    spark.createDataFrame(data, "loan_id string, m string, zero_balance_code string, delinquency_status int").withColumn("as_of_month", F.to_date("m")).drop("m").coalesce(1).write.parquet(source)
    read = spark.readStream.schema(rows).parquet(source)
    query = stream.transitions(read, settings).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.loan_id, str(r.as_of_month), r.delinquency_state, r.next_delinquency_state) for r in spark.table("moves").collect())
    assert got == [("a", "2010-01-01", "Current", "DPD30"), ("a", "2010-02-01", "DPD30", "Prepaid"), ("b", "2010-01-01", "Current", "Current")]
