"""Data quality: every failed rule of a row, one-pass summaries, gates, and entity samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import joins

REASONS = "_quality_reasons"
DPD_VALUES = (0, 30, 60, 90, 120, 150, 180)


class QualityError(RuntimeError):
    pass


def tag(df: DataFrame, rules: dict[str, Column], also: str | None = None) -> DataFrame:
    """df with the names of the rules that each row fails; also: an array column of names to add to."""
    names = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules.items()]))
    return df.withColumn(REASONS, F.concat(F.col(also), names) if also else names)


def _missing() -> Column:
    return F.col("loan_id").isNull() | (F.trim(F.col("loan_id").cast("string")) == "")


def spread_key() -> Column:
    """The loan's id, and for each row without one a key of its own, so that these, however many, meet in no window and no join."""
    return F.when(_missing(), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("loan_id").cast("string"))


def _with_repeats(df: DataFrame, key: str, *more: str) -> DataFrame:
    """df with the column _again: whether the keys are in several rows. Null keys repeat each other.

    Rows without the first key, however many, meet in no window: they are counted in part by each task.
    """
    here = df.where(F.col(key).isNotNull()).withColumn("_again", F.count("*").over(Window.partitionBy(key, *more)) > 1)
    absent = df.where(F.col(key).isNull())
    counts = absent.groupBy(*[F.col(c).alias(f"_{c}") for c in more]).agg((F.count("*") > 1).alias("_again"))  # a row, or a row a month
    same = C.all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in more])
    return here.unionByName(absent.join(F.broadcast(counts), same).drop(*[f"_{c}" for c in more]))


def _acquisition_rules() -> dict[str, Column]:
    return {
        "acquisition_missing_loan_id": _missing(),
        "acquisition_missing_origination_month": F.col("origination_month").isNull(),
        "acquisition_nonpositive_original_upb": F.coalesce(F.col("original_upb") <= 0, F.lit(True)),
        "acquisition_nonpositive_original_term": F.coalesce(F.col("original_term") <= 0, F.lit(True)),
        "acquisition_score_out_of_range": ~F.coalesce(F.col("orig_score").between(300, 850), F.lit(False)),
        "acquisition_duplicate_loan_id": F.col("_again"),
    }


def _performance_rules() -> dict[str, Column]:
    return {
        "performance_missing_loan_id": _missing(),
        "performance_missing_as_of_month": F.col("as_of_month").isNull(),
        "performance_negative_current_upb": F.coalesce(F.col("current_upb") < 0, F.lit(True)),
        "performance_invalid_delinquency_status": ~F.coalesce(F.col("delinquency_status").isin(*DPD_VALUES), F.lit(False)),
        "performance_negative_loan_age": F.coalesce(F.col("loan_age") < 0, F.lit(True)),
        "performance_duplicate_loan_month": F.col("_again"),
    }


def tag_acquisition(df: DataFrame) -> DataFrame:
    """Missing id or month, balance or term not above 0, score outside 300 to 850, repeated id. Null ids repeat each other."""
    return tag(_with_repeats(df, "loan_id"), _acquisition_rules()).drop("_again")


def scan_acquisition(df: DataFrame) -> DataFrame:
    """tag_acquisition() in one scan and one window. That ids are missing repeatedly is left to repeats_without_id()."""
    keyed = df.withColumn("_key", spread_key())
    again = F.count("*").over(Window.partitionBy("_key")) > 1
    return tag(keyed.withColumn("_again", again), _acquisition_rules()).drop("_again", "_key")


def scan_performance(df: DataFrame, known: DataFrame) -> DataFrame:
    """tag_performance() with the columns of known (loan_id and more, a row a loan), in one scan and one shuffle by loan."""
    keyed = df.withColumn("_key", spread_key())
    loans = known.withColumnRenamed("loan_id", "_key").withColumn("_known", F.lit(True))
    joined = keyed.join(loans, "_key", "left")
    # The rows of a loan are together after the join, and so are those of its months.
    again = F.count("*").over(Window.partitionBy("_key", "as_of_month")) > 1
    rules = _performance_rules() | {"performance_orphan_loan_id": F.col("_known").isNull()}
    return tag(joined.withColumn("_again", again), rules).drop("_again", "_key", "_known")


def counts(reasons: list[str]) -> list[Column]:
    """Aggregates for a gate: all rows, those with a reason, and those of each reason."""
    return [F.count("*").alias("total_rows"), F.count_if(F.size(REASONS) > 0).alias("excluded_rows"), *[F.count_if(F.array_contains(REASONS, r)).alias(r) for r in reasons]]


def repeats_without_id(excluded: DataFrame, *more: str) -> int:
    """Rows without an id that are alike in the id they have (null or blank) and in the columns more."""
    groups = excluded.where(_missing()).groupBy("loan_id", *more).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def tag_performance(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Missing id or month, negative balance or age, unknown days past due, repeated (id, month); and ids not in known."""
    tagged = tag(_with_repeats(df, "loan_id", "as_of_month"), _performance_rules()).drop("_again")
    if known is None:
        return tagged
    ids = known.select("loan_id").where("loan_id is not null").distinct().withColumn("_known", F.lit(True))
    joined = tagged.join(ids, "loan_id", "left")
    orphan = F.array_compact(F.array(F.when(F.col("_known").isNull(), F.lit("performance_orphan_loan_id"))))
    return joined.withColumn(REASONS, F.concat(REASONS, orphan)).drop("_known")


def summarise(tagged: DataFrame, reasons: list[str]) -> DataFrame:
    """One row a reason from one pass: failed, rate, and the table's total and excluded rows."""
    one = tagged.agg(*counts(reasons))
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("failed")) for r in reasons]))
    return one.select("total_rows", "excluded_rows", pairs.alias("x")).select("x.reason", "x.failed", F.coalesce(F.try_divide(F.col("x.failed").cast("double"), F.col("total_rows")), F.lit(0.0)).alias("rate"), "total_rows", "excluded_rows")


def enforce_counts(found: dict[str, int], s: Settings) -> None:
    """Raises QualityError for a fatal reason, a reason above its rate, or too many excluded rows, from counts()."""
    total, excluded = found["total_rows"], found["excluded_rows"]
    failed = {r: n for r, n in found.items() if r not in ("total_rows", "excluded_rows")}
    problems = [f"{r}: {n} rows" for r, n in failed.items() if r in s.fatal_reasons and n]
    problems += [f"{r}: rate {n / total:.4f}" for r, n in failed.items() if r not in s.fatal_reasons and total and n / total > s.max_rate_per_reason]
    if total and excluded / total > s.max_rate_overall:
        problems.append(f"excluded {excluded} of {total} rows")
    if problems:
        raise QualityError("; ".join(problems))


def enforce(summary: DataFrame, s: Settings) -> None:
    """enforce_counts() of summarise()'s rows."""
    rows = summary.collect()  # one row a rule
    if rows:
        enforce_counts({"total_rows": rows[0].total_rows, "excluded_rows": rows[0].excluded_rows} | {r.reason: r.failed for r in rows}, s)


def valid(tagged: DataFrame, *drop: str) -> DataFrame:
    return tagged.where(F.size(REASONS) == 0).drop(REASONS, *drop)


def in_sample(key: str, fraction: float, s: Settings) -> Column:
    """Whether the entity is in a share of all, the same ones each time."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(s.seed)), F.lit(s.hash_buckets)) < int(fraction * s.hash_buckets)


def hash_sample(df: DataFrame, key: str, fraction: float, s: Settings) -> DataFrame:
    """All rows of a share of the entities, the same ones each time."""
    return df.where(in_sample(key, fraction, s))


def digest_sample(df: DataFrame, key: str, fraction: float, s: Settings) -> DataFrame:
    """hash_sample() by a digest that other engines have too."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(s.seed)))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % s.hash_buckets
    return df.where(bucket < int(fraction * s.hash_buckets))


def attach_vintage(performance: DataFrame, acquisition: DataFrame) -> DataFrame:
    """Performance rows of the loans in acquisition, with the loan's vintage year, whatever year they carried."""
    return performance.drop("vintage_year").join(acquisition.select("loan_id", "vintage_year"), "loan_id")


def attach_sampled(performance: DataFrame, sample: DataFrame) -> DataFrame:
    """attach_vintage() for a small share of the loans: a Bloom filter of them drops the other loans' months before the shuffle."""
    return attach_vintage(joins.semi_reduced(performance, sample.select("loan_id"), "loan_id"), sample)
