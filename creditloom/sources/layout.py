"""Co-located tables: bucketed and sorted by loan, so that joins and windows by loan need no shuffle and no sort.

The rows of a bucket are one sorted file, as they are dealt by the bucketing's own hash before they are written. Spark takes
a file's order for granted where `ORDERED` is set when a query is planned (`session.build_session` sets it), and then reads
panel inputs file by file: two tables with equal buckets meet bucket by bucket. A month added to a table is a rewrite of its
buckets, so this layout suits tables that are read far more often than written; by-vintage directories suit the others.

Tables are external: their files lie under the path given, the catalog only names them. A catalog that forgets its tables at
the end of the session gets them back by `register`, which writes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: The setting by which the order inside bucket files counts.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
BUCKET_BYTES, MAX_BUCKETS = 256 << 20, 100_000


def buckets_for(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two of buckets, so that a table with twice as many still meets one with fewer, each of about bucket_bytes at most."""
    n = 1
    while n * bucket_bytes < total_bytes and n * 2 <= MAX_BUCKETS:
        n *= 2
    return n


def write(df: DataFrame, table: str, path: str, key: str, order: Sequence[str], buckets: int) -> DataFrame:
    """Writes a table of so many bucket files, each sorted by key and order, and reads it."""
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def register(spark: SparkSession, table: str, path: str, key: str, order: Sequence[str], buckets: int) -> DataFrame:
    """Names a table that write() left under the path; the number of buckets must be the one it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"create table {table} ({columns}) using parquet clustered by ({key}) sorted by ({', '.join([key, *order])}) into {buckets} buckets location '{path}'")
    return spark.table(table)
