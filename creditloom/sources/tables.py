"""Sources and sinks: delimited files with fixed schemas, curated Parquet, CSV with provenance, layout metrics."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.config import Settings

# Column names and types of the vendor's files and the macro series.
ACQUISITION = "loan_id string, origination_month date, original_upb double, original_term int, orig_interest_rate double, orig_score int, orig_ltv double, property_state string, occupancy_status string, channel string"
PERFORMANCE = (
    "loan_id string, as_of_month date, current_upb double, delinquency_status int, loan_age int, remaining_months int, zero_balance_code string, "
    "zero_balance_date date, modification_flag string, foreclosure_date date, disposition_date date, net_sales_proceeds double, foreclosure_costs double"
)
MACRO = "as_of_month date, unemployment_rate double, unemployment_change_3m double, hpi_change_yoy double"
SCENARIO = "vintage_year int, scenario string, quarter string, unemployment_rate double, house_price_index double, source_url string"


def acquisition_schema() -> T.StructType:
    return T.StructType.fromDDL(ACQUISITION)


def performance_schema() -> T.StructType:
    return T.StructType.fromDDL(PERFORMANCE)


def macro_schema() -> T.StructType:
    return T.StructType.fromDDL(MACRO)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, s: Settings, keep_corrupt: bool = False) -> DataFrame:
    """A delimited scan by fixed schema that fails on a malformed row; or, with keep_corrupt, puts it into _corrupt_record.

    Directories such as vintage_year=1999 add no column.
    """
    if keep_corrupt:
        schema = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema), T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(schema).option("sep", s.delimiter).option("header", s.header).option("dateFormat", s.date_format)
    return reader.option("mode", "PERMISSIVE" if keep_corrupt else s.parse_mode).option("recursiveFileLookup", True).csv(path)


def read_macro(spark: SparkSession, path: str, s: Settings) -> DataFrame:
    return spark.read.schema(macro_schema()).option("header", True).option("mode", s.parse_mode).option("dateFormat", s.date_format).csv(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIO).option("header", True).option("mode", "FAILFAST").csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, s: Settings) -> None:
    """Overwrites a Parquet table with one directory a value; rows are dealt evenly, a large value to several tasks."""
    df.hint("rebalance", by).write.mode("overwrite").option("maxRecordsPerFile", s.max_records_per_file).partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str, **provenance: str) -> None:
    """A small result as one CSV file, with provenance columns."""
    df.withColumns({k: F.lit(v) for k, v in provenance.items()}).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def file_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, total_bytes and average_bytes of a Parquet table, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.avg("length").alias("average_bytes"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir. Only a session on one machine, as in tests, may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the shared folder, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stage_summary(spark: SparkSession) -> dict[str, int]:
    """Jobs, stages and tasks of this application, and the bytes its stages read, shuffled and spilled, as far as Spark still keeps them.

    The figures come from the driver's status store, which runs with or without the web interface; zeros where it is out of reach.
    """
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(None)
    out = dict.fromkeys(("jobs", "stages", "tasks", "failed_tasks", *STAGE_BYTES), 0) | {"jobs": len(jobs)}
    for stage in _stages(spark):
        out["stages"] += 1
        out["tasks"] += stage.numCompleteTasks()
        out["failed_tasks"] += stage.numFailedTasks()
        for name, getter in STAGE_BYTES.items():
            out[name] += getattr(stage, getter)()
    return out


STAGE_BYTES = {"input_bytes": "inputBytes", "output_bytes": "outputBytes", "shuffle_read_bytes": "shuffleReadBytes", "shuffle_write_bytes": "shuffleWriteBytes", "spilled_bytes": "diskBytesSpilled", "executor_ms": "executorRunTime"}


def _stages(spark: SparkSession) -> list:
    """The finished stages that the status store keeps."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        done = jvm.java.util.ArrayList()
        done.add(jvm.org.apache.spark.status.api.v1.StageStatus.COMPLETE)
        found = spark._jsc.sc().statusStore().stageList(done, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [found.apply(k) for k in range(found.size())]
    except (Py4JError, TypeError):
        return []


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """A curated table, or what build() makes when there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return build()
