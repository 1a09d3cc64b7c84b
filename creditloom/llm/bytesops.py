"""Array helpers that the Arrow-batched operators share: whole texts as bytes, words, 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93
_R_INV = pow(_R, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit integers over the whole word."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def _powers_anew(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    np.multiply.accumulate(out, out=out)
    out.flags.writeable = False
    return out


_kept_powers = functools.lru_cache(maxsize=4)(_powers_anew)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers; those of slices' usual lengths are kept by the Python worker."""
    kept = (1 << 20) + 1
    return _kept_powers(base, kept)[:n] if n <= kept else _powers_anew(base, n)


_BYTE = mix(np.arange(1, 257, dtype=U64) * _GOLD)
_BYTE_LOWER = _BYTE[LOWER]
#: Random byte values of a second, independent hash.
_BYTE_AGAIN = mix(np.arange(257, 513, dtype=U64) * _GOLD)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and the len + 1 offsets; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches whose texts have about max_bytes at most (a longer text stands alone), with flat() of the texts."""
    for batch in batches:
        data, off = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose values of a string or binary column have about max_bytes at most; a longer value stands alone."""
    for batch in batches:
        run = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(run, run[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Gives memory that this Python worker has freed back to the system, as it stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The mapInArrow function, with release() at each task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between bytes 0x20 and 0x09 to 0x0D, and each text's offsets in them."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(data: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """Sums of the polynomial over random byte values that span_hashes() reads. seed 1: other byte values."""
    values = _BYTE_AGAIN if seed else _BYTE_LOWER if lower else _BYTE
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.take(values, data, out=sums[1:], mode="clip")  # bytes are in range; other modes copy
    sums[1:] *= _powers(_R, len(data))
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from the prefix_sums() of the bytes, mixed with the length."""
    return mix((sums[ends] - sums[starts]) * _powers(_R_INV, len(sums))[starts] + (ends - starts).astype(U64) * _GOLD)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over random byte values from prefix sums, then mixed with the length. seed 1: other byte values."""
    return span_hashes(prefix_sums(data, lower, seed), starts, ends)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + counts[0] - 1, starts[1], ... as one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a session on one machine, as in tests, may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def id_mod(column: str, modulus: int) -> str:
    """SQL for crc32 of an id as text, modulo a number."""
    return f"crc32(cast({column} as string)) % {modulus}"
