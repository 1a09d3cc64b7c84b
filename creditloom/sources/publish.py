"""Tables written beside their place, judged by what their own write counted, then published by renaming, or dropped.

One job reads the rows, counts them and writes them: the counts are observed in the tasks that write, so a table needs no
second pass and no cache for its gate, and a lost executor's work is counted once, as only finished write tasks count. A
reader of the table never sees a draft; a table that fails its gate leaves the old one as it was. Renaming a directory is
one step on a distributed file system; on an object store it copies, so publish to such a store by a table format instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from creditloom.config import Settings


class PublishError(RuntimeError):
    pass


def _file(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory, none where there is none."""
    fs, at = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _file(spark, old)
    to = _file(spark, new)[1]
    fs.mkdirs(to.getParent())
    if not fs.exists(at) or not fs.rename(at, to):
        raise PublishError(f"{old} could not be renamed to {new}")


@dataclass
class Draft:
    """A written table that nobody reads yet, and what its write counted."""

    spark: SparkSession
    at: str
    counts: dict[str, Any] = field(default_factory=dict)

    def read(self, part: str = "") -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{part}".rstrip("/"))


@contextmanager
def drafts(spark: SparkSession, *paths: str) -> Iterator[list[Draft]]:
    """Drafts for tables at these paths; whatever is left of them at the end goes, whether or not something failed."""
    for path in paths:
        recover(spark, path)
    out = [Draft(spark, f"{path}.draft-{uuid.uuid4().hex}") for path in paths]
    try:
        yield out
    finally:
        for d in out:
            remove(spark, d.at)


def write(draft: Draft, df: DataFrame, by: Sequence[str], s: Settings, counts: Iterable[Column] = (), keep: Column | None = None, drop: Iterable[str] = ()) -> Draft:
    """Writes the rows of df to keep, without the columns to drop, by directories; counts are aggregates of all rows of df.

    Rows are dealt evenly first, a large value to several tasks; the counts are taken after that, where the rows are written.
    """
    counts = list(counts)
    seen = Observation()
    rows = df.hint("rebalance", *by)
    rows = rows.observe(seen, *counts) if counts else rows
    rows = rows if keep is None else rows.where(keep)
    rows.drop(*drop).write.option("maxRecordsPerFile", s.max_records_per_file).partitionBy(*by).parquet(draft.at)
    draft.counts = seen.get if counts else {}
    return draft


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts the directory new in the place of path; what was there comes back if that fails."""
    old = f"{path}.old-{uuid.uuid4().hex}"
    there = exists(spark, path)
    if there:
        _move(spark, path, old)
    try:
        _move(spark, new, path)
    except Exception:
        if there:
            _move(spark, old, path)
        raise
    if there:
        remove(spark, old)


def replace_parts(spark: SparkSession, new: str, path: str, names: Iterable[str]) -> None:
    """Puts directories of new, such as vintage_year=2004, in the place of the table's. Those that new doesn't have go; no other is touched."""
    for name in names:
        if exists(spark, f"{new}/{name}"):
            replace(spark, f"{new}/{name}", f"{path}/{name}")
        else:
            remove(spark, f"{path}/{name}")


def recover(spark: SparkSession, path: str) -> None:
    """After a run that died between two renames: the old table (or directory of it) comes back where there is none; else it goes."""
    parent, name = path.rsplit("/", 1)
    for found in children(spark, parent):
        if found.startswith(f"{name}.old-"):
            if exists(spark, path):
                remove(spark, f"{parent}/{found}")
            else:
                _move(spark, f"{parent}/{found}", path)
    if exists(spark, path):
        for found in children(spark, path):
            if ".old-" in found:
                part = found.split(".old-")[0]
                if exists(spark, f"{path}/{part}"):
                    remove(spark, f"{path}/{found}")
                else:
                    _move(spark, f"{path}/{found}", f"{path}/{part}")
