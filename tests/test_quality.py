import pytest

from creditloom.config import Settings
from creditloom.operators import quality
from creditloom.plans.credit import ACQ_REASONS, PERF_REASONS
from creditloom.sources import tables

S = Settings()


def loan(i, score=700):
    return f"{i}|2010-01-01|200000|360|0.05|{score}|75|TX|P|R"


HEAD = "loan_id|origination_month|original_upb|original_term|orig_interest_rate|orig_score|orig_ltv|property_state|occupancy_status|channel"


def read(spark, tmp_path, lines, **more):
    (tmp_path / "vintage_year=1999").mkdir()
    (tmp_path / "vintage_year=1999" / "a.txt").write_text("\n".join([HEAD, *lines]))
    return tables.read_delimited(spark, str(tmp_path), tables.acquisition_schema(), S, **more)


def test_one_bad_score_in_201_passes(spark, tmp_path):
    df = read(spark, tmp_path, [loan(f"L{i}") for i in range(200)] + [loan("bad", 999)])
    assert "vintage_year" not in df.columns
    tagged = quality.tag_acquisition(df)
    summary = quality.summarise(tagged, ACQ_REASONS)
    quality.enforce(summary, S)
    row = summary.where("reason = 'acquisition_score_out_of_range'").first()
    assert (row.failed, row.total_rows, row.excluded_rows) == (1, 201, 1)
    assert quality.valid(tagged, "channel").count() == 200


def test_repeated_id_is_fatal(spark, tmp_path):
    summary = quality.summarise(quality.tag_acquisition(read(spark, tmp_path, [loan(f"L{i}") for i in range(199)] + [loan("x"), loan("x")])), ACQ_REASONS)
    with pytest.raises(quality.QualityError, match="acquisition_duplicate_loan_id: 2 rows"):
        quality.enforce(summary, S)


def test_malformed_rows_fail_or_are_kept_apart(spark, tmp_path):
    df = read(spark, tmp_path, [loan("a"), "b|not a date|1|1|1|1|1|x|y|z"])
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        df.collect()
    kept = tables.read_delimited(spark, str(tmp_path), tables.acquisition_schema(), S, keep_corrupt=True).collect()
    assert sorted(r._corrupt_record is None for r in kept) == [False, True]


def test_null_and_orphan_ids(spark):
    rows = spark.createDataFrame([("a", "2010-01-01", 1.0, 0, 0), (None, "2010-01-01", -1.0, 45, -1), ("b", None, None, None, None)], "loan_id string, m string, current_upb double, delinquency_status int, loan_age int")
    rows = rows.withColumn("as_of_month", quality.F.to_date("m")).drop("m")
    got = {r.loan_id: r[quality.REASONS] for r in quality.tag_performance(rows, spark.createDataFrame([("a",), ("a",), (None,)], "loan_id string")).collect()}
    assert got["a"] == []
    assert set(got[None]) == {"performance_missing_loan_id", "performance_negative_current_upb", "performance_invalid_delinquency_status", "performance_negative_loan_age", "performance_orphan_loan_id"}
    assert "performance_missing_as_of_month" in got["b"] and "performance_orphan_loan_id" in got["b"] and len(PERF_REASONS) == 7


def test_sample_takes_whole_entities(spark):
    rows = spark.range(1000).selectExpr("concat('L', id) as loan_id", "explode(sequence(0, 4)) as month", "2001 as vintage_year")
    for sample in (quality.hash_sample, quality.digest_sample):
        got = sample(rows, "loan_id", 0.1, S)
        counts = [r["count"] for r in got.groupBy("loan_id").count().collect()]
        assert 60 < len(counts) < 140 and set(counts) == {5}
    attached = quality.attach_vintage(rows, spark.createDataFrame([("L1", 1999)], "loan_id string, vintage_year int")).collect()
    assert {r.vintage_year for r in attached} == {1999} and len(attached) == 5


def test_one_scan_tags_as_many_scans_do(spark):
    """All but the repeats of rows without an id, which are counted apart."""
    loans = [(f"L{i}", 700) for i in range(20)] + [("L3", 700), (None, 700), (None, 1), ("", 700), (" ", 700), ("", 999)]
    df = spark.createDataFrame(loans, "loan_id string, orig_score int").selectExpr("*", "date'2010-01-01' as origination_month", "1.0D as original_upb", "360 as original_term").repartition(3)
    want = quality.tag_acquisition(df)
    got = quality.scan_acquisition(df)
    rows = lambda t, drop=(): sorted((str(r.loan_id), r.orig_score, [x for x in r[quality.REASONS] if x not in drop]) for r in t.collect())
    again = "acquisition_duplicate_loan_id"
    assert rows(got.where("trim(loan_id) <> ''")) == rows(want.where("trim(loan_id) <> ''")) and rows(got, [again]) == rows(want, [again])
    without = quality.repeats_without_id(got)
    assert without == want.where(quality.F.array_contains(quality.REASONS, again) & quality._missing()).count() == 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1

    months = spark.createDataFrame([("L1", 1), ("L1", 2), ("L1", 2), ("gone", 1), (None, 1), (None, 1), (None, 2), ("", 5), ("", 5)], "loan_id string, m int").selectExpr("loan_id", "add_months(date'2010-01-01', m) as as_of_month", "1.0D as current_upb", "0 as delinquency_status", "0 as loan_age").repartition(3)
    known = df.select("loan_id")
    want, got = quality.tag_performance(months, known), quality.scan_performance(months, known.where("loan_id is not null").distinct().withColumn("more", quality.F.lit(1)))
    again = "performance_duplicate_loan_month"
    key = lambda t: sorted((str(r.loan_id), str(r.as_of_month), sorted(set(r[quality.REASONS]) - {again} - ({"performance_orphan_loan_id"} if not (r.loan_id or "").strip() else set()))) for r in t.collect())
    assert key(got) == key(want)
    assert quality.repeats_without_id(got, "as_of_month") == 4 and {r.more for r in got.where("loan_id = 'L1'").collect()} == {1}
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(_key") <= 2  # one for each side


def test_many_rows_without_an_id_meet_in_no_task(spark):
    df = spark.range(50_000).selectExpr("cast(null as string) as loan_id", "date'2010-01-01' as as_of_month", "1.0D as current_upb", "0 as delinquency_status", "0 as loan_age").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tagged = quality.scan_performance(df, spark.createDataFrame([("a",)], "loan_id string"))
        sizes = [r["count"] for r in tagged.groupBy(quality.F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 30_000
