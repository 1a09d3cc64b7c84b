"""Language identification: multinomial naive Bayes over hashed byte n-grams of 1 to 4.

The model is a matrix of log-probabilities, BUCKETS by languages (half a megabyte a language), whose size does not grow
with the data; more than MAX_LANGUAGES of them are an error; all are alike likely before the text is read. It is fitted on a sample of about MAX_TRAIN
documents of each language at most, drawn by a hash of id and text, so a rare language keeps all its rows. The scan's
own tasks draw the sample, TRAIN_TASKS tasks count it, and the cluster adds the counts up; the driver gets one row a language.

Scoring covers every whole text, of any length, in slices of about a megabyte; a longer text is read in pieces of PIECE bytes.
A null text, or one without a letter, is "und" with score 0. Without training rows every text is "und". Ties go to the
language that comes first in alphabetical order. Repeated rows score alike, null ids score like others, and empty tables
give no rows. Columns carried along keep their names, whatever these are, but lang_pred, score and fit, which are the result's.

fit, in predict()'s rows, is the mean log-probability of the text's n-grams in the language named (0 for "und"). Below
UNFIT, that of drawing buckets blindly, the text is in no language that the model knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import id_mod, LOWER, slices, tidy

BUCKETS, ORDERS, MAX_TRAIN, TRAIN_TASKS, MAX_LANGUAGES, PIECE, CELLS = 1 << 17, (1, 2, 3, 4), 10_000, 32, 256, 1 << 20, 1 << 22
SMOOTH, TEMPER = 0.5, 40.0
UNFIT = -float(np.log(BUCKETS))


def grams(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of lower-cased bytes that lies in one text, and the texts' offsets in them."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    x = LOWER[data].astype(np.uint32)
    h = x[:n].copy()
    for k in range(1, order):
        h *= np.uint32(0x01000193)
        h ^= x[k : n + k]
    h = (h * np.uint32(0x9E3779B1 + 2 * order)) >> np.uint32(15)
    keep = np.ones(n, bool)
    for k in range(1, order):  # starts less than order bytes before a text's end
        at = off[1:-1] - k
        keep[at[(at >= 0) & (at < n)]] = False
    counts = np.maximum(np.diff(off) - order + 1, 0)
    if keep.all():
        return h, np.concatenate(([0], np.cumsum(counts)))
    return h[keep], np.concatenate(([0], np.cumsum(counts)))


def gram_sums(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of its n-grams' rows of the table, and their number. At most PIECE bytes of a long text and CELLS values of the table are held at once."""
    total, seen = np.zeros((len(off) - 1, table.shape[1])), np.zeros(len(off) - 1)
    for order in ORDERS:
        # Only a text that stands alone is longer than a piece; pieces overlap so that each n-gram is in one of them.
        for begin in range(0, max(1, len(data) - order + 1), PIECE if len(off) == 2 else len(data) + 1):
            piece = data[begin : begin + PIECE + order - 1] if len(off) == 2 else data
            h, at = grams(piece, off if len(off) > 2 else np.array([0, len(piece)]), order)
            seen += np.diff(at)
            step = max(1, CELLS // max(1, table.shape[1]))
            for a in range(0, len(h), step):
                b = min(a + step, len(h))
                own = np.arange(np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, b))
                own = own[at[own + 1] > np.maximum(at[own], a)]
                total[own] += np.add.reduceat(table[h[a:b]], np.maximum(at[own], a) - a, axis=0, dtype=np.float64)
    return total, seen


def training_sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows (lang, text): the labelled rows, of a language with more than max_train of them about so many."""
    lang = F.col(lang_col).cast("string").alias("lang")
    many = rows.groupBy(lang).agg(F.count("*").alias("__n")).where("lang is not null")
    if many.count() > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} languages, each of which takes half a megabyte of the model")
    labelled = rows.select(lang, F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)).alias("__h"))
    return labelled.where("text is not null").join(F.broadcast(many), "lang").where(F.col("__h").cast("double") * F.col("__n") < float(max_train) * (1 << 30)).select("lang", "text")


def train_counts(sample: DataFrame, tasks: int = TRAIN_TASKS) -> DataFrame:
    """Rows (lang, counts): the n-gram counts of each language's rows as a little-endian int64 array, added up on the cluster."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(BUCKETS, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([pa.compress(sums.astype("<i8").tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["lang", "counts"])
        for part, data, off in slices(batches, "text"):
            langs = np.array(part.column(0).to_pylist(), object)
            edges = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):  # rows come language by language
                if langs[a] != now:
                    if now is not None:
                        yield row()
                    now, sums = langs[a], np.zeros(BUCKETS, np.int64)
                own, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
                for order in ORDERS:
                    for begin in range(0, max(1, len(own) - order + 1), PIECE if b - a == 1 else len(own) + 1):
                        piece = own[begin : begin + PIECE + order - 1] if b - a == 1 else own
                        sums += np.bincount(grams(piece, np.array([0, len(piece)]) if b - a == 1 else cut, order)[0], minlength=BUCKETS)
        if now is not None:
            yield row()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(pa.decompress(x, 8 * BUCKETS, codec="zstd"), "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    dealt = sample.repartition(tasks).sortWithinPartitions("lang")  # in turn, so equal texts are dealt apart too
    return dealt.select("lang", "text").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (BUCKETS, languages), from about max_train labelled rows of each language at most."""
    found = sorted(((r.lang, np.log((x := np.frombuffer(r.counts, "<i8") + SMOOTH) / x.sum()).astype(np.float32)) for r in train_counts(training_sample(rows, id_col, text_col, lang_col, max_train)).collect()), key=lambda x: x[0])  # a row a language
    return [name for name, _ in found], np.stack([x for _, x in found], 1) if found else np.zeros((BUCKETS, 0), np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Rows (id, more..., lang_pred, score, fit): the likeliest language, and its share when log-likelihoods are averaged over TEMPER n-grams."""
    spark = docs.sparkSession
    names, table = model
    shared = spark.sparkContext.broadcast((names, table))
    rows = docs.select(F.col(id_col).alias(id_col), *more, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("string")).alias("__text"))
    kept = rows.drop("__text").schema
    columns = kept.names

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for part, data, off in slices(batches, "__text", 1 << 20):
            total, seen = gram_sums(data, off, table) if names else (np.zeros((part.num_rows, 1)), np.zeros(part.num_rows))
            best = total.argmax(1)
            mean = (total - total.max(1, keepdims=True)) / np.maximum(seen, 1)[:, None] * np.minimum(seen, TEMPER)[:, None]
            share = 1 / np.exp(mean).sum(1)
            known = (np.diff(off) > 0) & bool(names)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in range(part.num_columns - 1)), pa.array([names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, total.max(1) / np.maximum(seen, 1), 0.0))],
                [*columns, "lang_pred", "score", "fit"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double, fit double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.expr(id_mod("doc_id", 4)) == 2, F.lit(False))
    return predict(docs, fit(docs.where(~held), "doc_id", "text", "lang"), "doc_id", "text", held.alias("held_out")).select("doc_id", "held_out", "lang_pred", "score", "fit")
