"""Joins that check themselves in the plan, and a Bloom filter for the large side of a join.

A checked join fails the job that runs it, by an expression that no optimizer drops, as it stands in a filter; no count is
taken beforehand. Repeated keys are found in the aggregate that the join's own shuffle serves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, BLOCK_BITS, HASHES, MAX_BLOCKS = 16, 32_768, 6, 1 << 14


def _or_fail(holds: Column, message: str) -> Column:
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df, or an error where keys that are not null are in several rows."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.any_value(F.struct(*rest) if rest else F.lit(True)).alias("__row"), F.count("*").alias("__n"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    one = one.where(_or_fail((F.col("__n") == 1) | ~known, f"{name}: a key is in several rows"))
    return one.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def checked(left: DataFrame, right: DataFrame, keys: list[str], name: str, one_to_one: bool = False, complete: bool = True, small: bool = False) -> DataFrame:
    """left joined to right, where right has each key once (and left too, if one_to_one).

    complete: a left row without a partner is an error; else it goes. small: right has a row a month, or fewer, and is broadcast.
    """
    right = unique(right, keys, name)
    left = unique(left, keys, name) if one_to_one else left
    hinted = F.broadcast if small else lambda x: x
    if not complete:
        return left.join(hinted(right), keys)
    joined = left.join(hinted(right.withColumn("__met", F.lit(True))), keys, "left")
    return joined.where(_or_fail(F.coalesce("__met", F.lit(False)), f"{name}: a row has no partner")).drop("__met")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(blocks))


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(HASHES)]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (block, bits): a blocked Bloom filter of the keys, 4 KB a block, put together by the tasks that read them."""
    known = keys.where(F.col(key).isNotNull())
    places = known.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_places(F.col(key)))).alias("place"))
    return places.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def marked(large: DataFrame, keys: DataFrame, key: str, column: str, max_blocks: int | None = None) -> DataFrame:
    """large with a boolean column: whether the row's key may be among the keys. It is for all that are, and for about one in a thousand of the others.

    The filter is broadcast: BITS a key, at most max_blocks (MAX_BLOCKS) of 4 KB, 64 MB; with more keys it lets more rows
    through, and never loses one. A null key is not among them.
    """
    blocks = min(max_blocks or MAX_BLOCKS, max(1, -(-keys.count() * BITS // BLOCK_BITS)))
    made = F.broadcast(bloom(keys, key, blocks).withColumnsRenamed({"block": "__block", "bits": "__bits"}))
    met = large.join(made, _block(F.col(key), blocks) == F.col("__block"), "left")
    held = reduce(lambda a, b: a & b, [_has(F.col("__bits"), place) for place in _places(F.col(key))])
    return met.withColumn(column, F.coalesce(F.when(F.col("__bits").isNotNull(), held), F.lit(False))).drop("__block", "__bits")


def semi_reduced(large: DataFrame, keys: DataFrame, key: str, max_blocks: int | None = None) -> DataFrame:
    """The rows of large whose key may be among the keys, by marked(): all that are, and few others. Null keys go."""
    return marked(large, keys, key, "__maybe", max_blocks).where("__maybe").drop("__maybe")
