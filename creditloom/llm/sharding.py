"""Minimax contiguous partition of ordered atomic groups into shards, with DataFrame operations only.

Groups are the documents of one text, kept whole, in the order of the text's SHA-256. The smallest feasible shard
capacity is found by binary search: a capacity is feasible when taking groups greedily, in order, fills no more than
the given number of shards. Shards are then cut where that greedy pass cuts.

The search does not need every group. Groups are summed into ranges of their hashes; cutting only at range borders
gives a feasible capacity, cutting anywhere gives a lower bound, and only the ranges in which a cut for a capacity
between the two can fall are summed again by longer hash prefixes, until the bounds meet. What the driver holds is
the borders of such ranges: at most RANGES in the first round, and a bounded number of children of the few ranges
around each cut in the later ones.

A null text counts as an empty one (size 1); a very long text is a group like others, and bounds the capacity from below.
Repeated rows of a document are rows of their own, and rows alike in id and text take any order among themselves; null
ids are kept and come first in a shard's slots. An empty table gives no rows. Other columns of the input are not read, so
their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytesops import cut_lineage

SHARDS, FIRST_HEX, STEP_HEX, ROWS_PER_SALT = 16, 3, 3, 20_000


def greedy(ends: list[int], capacity: int) -> list[int] | None:
    """Positions in ends after which a greedy pass cuts; None when a step is larger than capacity. ends: running sums."""
    cuts, filled = [], 0
    while filled < ends[-1]:
        k = bisect_right(ends, filled + capacity) - 1
        if k < 0 or ends[k] <= filled:
            return None
        cuts.append(k)
        filled = ends[k]
    return cuts


def smallest_capacity(ends: list[int], shards: int, at_least: int) -> int:
    """The smallest capacity of at least at_least for which greedy() needs no more than so many shards."""
    low, high = at_least, ends[-1]
    while low < high:
        middle = (low + high) // 2
        cuts = greedy(ends, middle)
        low, high = (low, middle) if cuts is not None and len(cuts) <= shards else (middle + 1, high)
    return low


def _sums(groups: DataFrame, of: list[str], digits: int) -> list[tuple[str, int, int]]:
    """(prefix, weight, groups) of all hash prefixes of so many digits under the given shorter prefixes, in order."""
    if of != [""]:
        # The prefixes are few: those around the cuts.
        groups = groups.where(F.substring("hash", 1, len(of[0])).isin(of))
    found = groups.groupBy(F.substring("hash", 1, digits).alias("prefix")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    return [(r["prefix"], r["weight"], r["n"]) for r in found.orderBy("prefix").collect()]


def cut_hashes(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Last hash prefixes of all shards but the last, and the capacity. groups: (hash, weight), one row a group."""
    top = groups.agg(F.max("weight")).first()[0]
    if top is None:
        return [], 0
    ranges = _sums(groups, [""], FIRST_HEX)
    total = sum(r[1] for r in ranges)
    low = max(top, -(-total // shards))
    while True:
        ends, filled = [], 0
        for _, weight, _ in ranges:
            filled += weight
            ends.append(filled)
        high = smallest_capacity(ends, shards, low)
        # Ranges in which a cut for a capacity in [low, high] can fall.
        open_, first, last = set(), 0, 0
        for _ in range(shards):
            a, b = bisect_right(ends, first + low), bisect_right(ends, last + high)
            open_.update(k for k in range(a, min(b + 1, len(ranges))) if ranges[k][2] > 1)
            first, last = (ends[a - 1] if a else 0), last + high
            if first >= total:
                break
        # With no range to open, every capacity below high has been tried on whole groups.
        if not open_ or high == low:
            cuts = greedy(ends, high)
            return [ranges[k][0] for k in cuts[:-1]], high
        by_length: dict[int, list[str]] = {}
        for k in open_:
            by_length.setdefault(len(ranges[k][0]), []).append(ranges[k][0])
        parts = {r[0]: r for size, of in by_length.items() for r in _sums(groups, sorted(of), size + STEP_HEX)}
        opened = {ranges[k][0] for k in open_}
        ranges = sorted([r for r in ranges if r[0] not in opened] + list(parts.values()))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Checkpointed rows (id, size, text_crc32, hash, __row); __row tells equal rows apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("hash"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )


def dealt(rows: DataFrame, cuts: list[str]) -> DataFrame:
    """rows with their shard and a salt within it, about ROWS_PER_SALT rows a salt, however many are alike."""
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.substring("hash", 1, len(c)) > c).cast("int")
    salts = max(8, rows.count() // ROWS_PER_SALT)
    return rows.select("id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int").alias("__salt"), "__row")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot) of all documents; slots count each shard's rows from 0 without gaps."""
    rows = hashed(docs, id_col, text_col)
    groups = cut_lineage(rows.groupBy("hash").agg(F.sum("size").alias("weight")))
    cuts, _ = cut_hashes(groups, shards)
    salted = dealt(rows, cuts)
    inside = Window.partitionBy("shard", "__salt").orderBy("id", "text_crc32", "__row")
    # One row a shard and salt: as many as there are salts, each for ROWS_PER_SALT documents.
    before = salted.groupBy("shard", "__salt").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = salted.withColumn("__k", F.row_number().over(inside) - 1)
    return numbered.join(before.drop("__n"), ["shard", "__salt"]).select("id", "size", "text_crc32", "shard", (F.col("__before") + F.col("__k")).cast("long").alias("slot"))


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
