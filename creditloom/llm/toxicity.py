"""Toxicity: subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are its byte n-grams of 3 to 5, hashed, with a boundary byte on each side, so a misspelling never
seen shares most vectors with the word it stands for. A bag of words is the average of its words' subword vectors; the
softmax rates it. With window=None the bag is the whole text. By default bags are windows of WINDOW words, and a text's
score is that of its most toxic one, as the average over a long text drowns a single word; README has both measured.
Texts with fewer words have one window. Training takes at most about MAX_TRAIN labelled texts, ids drawn by a hash
and then their distinct rows; no subword is left out. Scoring covers every whole text, of any length, in slices of half a megabyte or of one longer text.

Texts without words, null ones too, score as the model's bias alone. Labels of one kind only, or none, give a model all
the same. A null id is scored like others but trains nothing; an id labelled several times counts as toxic if one label
says so; repeated rows score alike. Of windows equally toxic the first is trained on. Empty tables give no rows. Columns
carried along keep their names, whatever these are, but score, which is the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import cut_lineage, id_mod, LOWER, ranges, release, slices, tidy

BUCKETS, ORDERS, WINDOW, DIM, MAX_TRAIN, EPOCHS, DECAY, TOXIC_WEIGHT = 1 << 20, (3, 4, 5), 6, 8, 5_000, 60, 3e-6, 6.0
#: With whole texts as bags a step takes so many of them.
WHOLE_BATCH = 256
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, (word, bucket) of every subword, words counted from 0; and the texts' offsets in the words."""
    # A boundary byte before, between and after texts keeps their words apart.
    n = len(data) + len(off)
    x = np.full(n, 32, np.uint8)
    body = np.ones(n, bool)
    body[off + np.arange(len(off))] = False
    x[body] = LOWER[data]
    letter = _LETTER[x]
    x[~letter] = 32
    starts = letter & ~np.concatenate(([False], letter[:-1]))
    word = np.cumsum(starts) - 1
    count = np.concatenate(([0], np.cumsum(starts)))[off + np.arange(len(off))]
    gaps = np.concatenate(([0], np.cumsum(~letter)))
    wide, out = x.astype(np.uint32), []
    for order in ORDERS:
        m = n - order + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint32)))
            continue
        at = np.flatnonzero(gaps[order - 1 : order - 1 + m] - gaps[1 : m + 1] == 0)
        h = wide[at]
        for k in range(1, order):
            h = h * np.uint32(0x01000193) ^ wide[at + k]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1 + 2 * order) >> np.uint32(12)
        out.append((word[at + 1], h))
    return out, count


def word_scores(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's sum of subword values and number of subwords, and the texts' offsets in the words."""
    parts, count = subwords(data, off)
    total, many = np.zeros(count[-1]), np.zeros(count[-1])
    for word, h in parts:
        total += np.bincount(word, table[h], count[-1])
        many += np.bincount(word, minlength=count[-1])
    return total, many, count


def windows(count: np.ndarray, width: int | None = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of all windows, and the texts' offsets in the windows; a text without words has an empty one. None: whole texts."""
    if width is None:
        return count[:-1], count[1:], np.arange(len(count))
    size = np.diff(count)
    many = np.maximum(size - width + 1, 1)
    at = np.concatenate(([0], np.cumsum(many)))
    first = ranges(count[:-1], many)
    return first, np.minimum(first + width, np.repeat(count[1:], many)), at


def _most_toxic(value: np.ndarray, word: np.ndarray, bucket: np.ndarray, bound: np.ndarray, per_word: np.ndarray, same: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text's window of the largest average of its words' subword values."""
    distinct = len(per_word)
    own = np.empty(distinct)
    for k in range(0, distinct, 1 << 16):  # in parts, which keeps the worker small
        a, b = bound[k], bound[min(k + (1 << 16), distinct)]
        own[k : k + (1 << 16)] = np.bincount(word[a:b] - k, value[bucket[a:b]], min(1 << 16, distinct - k))
    own /= per_word
    mean = np.empty(len(first), np.float32)
    for k in range(0, len(first), 1 << 18):
        a, b = first[k : k + (1 << 18)], end[k : k + (1 << 18)]
        run = np.concatenate(([0.0], np.cumsum(own[same[a[0] : b.max()]])))
        mean[k : k + len(a)] = (run[b - a[0]] - run[a - a[0]]) / np.maximum(b - a, 1)
    top = np.maximum.reduceat(mean, at[:-1])
    is_top = np.flatnonzero(mean == np.repeat(top, np.diff(at)))
    return is_top[np.searchsorted(is_top, at[:-1])]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, window: int | None = WINDOW) -> tuple[np.ndarray, float]:
    """The value of each bucket (its vector times the softmax's difference of weights) and the bias.

    Vectors and softmax are learned together by Adam. A text's window for a step is the most toxic one in the model's
    present view, which for the first steps is the subwords' share of toxic texts.
    """
    rng = np.random.default_rng(seed)
    # Equal words add up the same values in the same order, so the sum names the word.
    value_of = rng.random(BUCKETS)
    texts_with, with_toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    known = np.zeros(0)
    names, own_names, sizes, grams_of, counts, row, base = [], [], [], [], [np.zeros(1, np.int64)], 0, 0
    for part, data, off in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), "text", 1 << 19):
        parts, count = subwords(data, off)
        word, bucket = np.concatenate([w for w, _ in parts]), np.concatenate([h for _, h in parts])
        name = np.bincount(word, value_of[bucket], count[-1])
        text_of = np.repeat(np.arange(part.num_rows), np.diff(count))
        pairs = np.unique(text_of[word] * BUCKETS + bucket.astype(np.int64))
        texts_with += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        with_toxic += np.bincount(pairs % BUCKETS, labels[row + pairs // BUCKETS], BUCKETS)
        own, one = np.unique(name, return_index=True)
        fresh = ~np.isin(own, known)
        own, one = own[fresh], one[fresh]
        known = np.union1d(known, own)
        stands = np.full(len(name), -1, np.int64)
        stands[one] = np.arange(len(one))
        stays = stands[word] >= 0
        word, bucket = stands[word[stays]], bucket[stays]
        grams_of.append(bucket[np.argsort(word, kind="stable")])
        sizes.append(np.bincount(word, minlength=len(one)))
        names.append(name)
        own_names.append(own)
        counts.append(count[1:] + base)
        base, row = base + int(count[-1]), row + part.num_rows
    count, every_own = np.concatenate(counts), np.concatenate(own_names)
    listed, one = np.unique(every_own, return_index=True)
    same = np.concatenate([np.searchsorted(listed, x).astype(np.int32) for x in names])
    size = np.concatenate(sizes)
    bucket = np.concatenate(grams_of)[ranges((np.cumsum(size) - size)[one], size[one])]
    per_word = np.maximum(size[one], 1).astype(np.float32)
    word = np.repeat(np.arange(len(one), dtype=np.int32), size[one])
    del names, own_names, grams_of, known, value_of, every_own, listed
    release()
    kept = np.flatnonzero(texts_with)
    new = np.full(BUCKETS, -1, np.int32)
    new[kept] = np.arange(len(kept))
    with_toxic = with_toxic[kept]
    good = new[bucket] >= 0
    word, bucket = word[good], new[bucket[good]]
    distinct = len(one)
    bound = np.searchsorted(word, np.arange(distinct + 1))
    first, end, at = windows(count, window)
    first, end = first.astype(np.int32), end.astype(np.int32)
    V = rng.normal(0, 0.1, (len(kept) + 1, DIM)).astype(np.float32)
    u, b = rng.normal(0, 0.5, DIM).astype(np.float32), np.float32(-2)
    y = labels.astype(np.float32)
    # First windows: those whose subwords are the most overrepresented in toxic texts.
    pos, every = with_toxic, np.maximum(texts_with[kept], 1)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    value = np.log((pos + 2 * rate) / (every + 2) / rate)
    m1, m2, mu, su = np.zeros_like(V), np.zeros_like(V), np.zeros(DIM + 1, np.float32), np.zeros(DIM + 1, np.float32)
    for step in range(1, epochs + 1):
        if window is None:
            own_rows = rng.permutation(len(texts))[:WHOLE_BATCH]
            pick = own_rows
        else:
            if step > 5:
                value = V[:-1] @ u
            own_rows, pick = slice(None), _most_toxic(value, word, bucket, bound, per_word, same, first, end, at)
        many = end[pick] - first[pick]
        w = same[ranges(first[pick], many)]
        of_text = np.repeat(np.arange(len(pick)), many)
        grams = bound[w + 1] - bound[w]
        g = bucket[ranges(bound[w], grams)]
        share = np.repeat(1 / (per_word[w] * np.maximum(many, 1)[of_text]), grams).astype(np.float32)
        owner = np.repeat(of_text, grams)
        bag = np.stack([np.bincount(owner, share * V[g, k], len(pick)) for k in range(DIM)], 1).astype(np.float32)
        p = 1 / (1 + np.exp(-(bag @ u + b)))
        err = (p - y[own_rows]) * np.where(y[own_rows] > 0, TOXIC_WEIGHT, 1).astype(np.float32) / len(pick)
        gu = np.append(bag.T @ err + 1e-5 * u, err.sum())
        touched, place = np.unique(g, return_inverse=True)
        gV = np.stack([np.bincount(place, share * err[owner] * u[k], len(touched)) for k in range(DIM)], 1).astype(np.float32) + np.float32(DECAY) * V[touched]
        m1[touched] = 0.9 * m1[touched] + 0.1 * gV
        m2[touched] = 0.99 * m2[touched] + 0.01 * gV**2
        V[touched] -= 0.1 * m1[touched] / (1 - 0.9**step) / (np.sqrt(m2[touched] / (1 - 0.99**step)) + 1e-6)
        mu, su = 0.9 * mu + 0.1 * gu, 0.99 * su + 0.01 * gu**2
        move = 0.1 * mu / (1 - 0.9**step) / (np.sqrt(su / (1 - 0.99**step)) + 1e-8)
        u, b = (u - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    table = np.zeros(BUCKETS, np.float32)
    table[kept] = V[:-1] @ u
    return table, float(b)


Model = tuple[np.ndarray, float, int | None]


def drawn(most: int, of: int, *names: Column) -> Column:
    """Whether a row is among about that many of so many, by a hash of its names."""
    share = F.pmod(F.xxhash64(*names), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return share * float(of) < float(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int = MAX_TRAIN, window: int | None = WINDOW) -> Model:
    """Bucket values, bias and window, from at most about max_train of the labelled rows (1: toxic). The bounded sample is trained on in one task."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    ids = ids.where(drawn(max_train, ids.count(), F.col(id_col).cast("string")))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(ids), id_col)
    # An id may stand for any number of rows: equal ones are one, and of the others about max_train are drawn.
    rows = cut_lineage(rows.dropDuplicates([id_col, "__text"]))
    rows = rows.where(drawn(max_train, rows.count(), F.col(id_col).cast("string"), F.col("__text")))

    @tidy
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += [x or "" for x in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        if texts:
            table, bias = train(texts, np.array(y), window=window)
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias])], ["table", "bias"])

    found = rows.select("__text", "__y").repartition(1).sortWithinPartitions(F.xxhash64("__text"), "__y").mapInArrow(learn, "table binary, bias double").collect()
    return (np.frombuffer(found[0][0], np.float32), found[0][1], window) if found else (np.zeros(BUCKETS, np.float32), 0.0, window)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Rows (id, more..., score): the probability of label 1, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), *more, F.col(text_col).cast("string").alias("__text"))
    kept = rows.drop("__text").schema
    columns = kept.names

    @tidy
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, window = shared.value
        for part, data, off in slices(batches, "__text", 1 << 19):
            total, many, count = word_scores(data, off, table)
            run = np.concatenate(([0.0], np.cumsum(total / np.maximum(many, 1))))
            first, end, at = windows(count, window)
            top = np.maximum.reduceat((run[end] - run[first]) / np.maximum(end - first, 1), at[:-1])
            p = 1 / (1 + np.exp(-np.clip(top + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns - 1)), pa.array(p)], [*columns, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(rate, f"{schema}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.expr(id_mod("doc_id", 3)) == 1, F.lit(False))
    model = fit(docs, labels.where(~held), "doc_id", "text", "toxic")
    return score(docs, model, "doc_id", "text", held.alias("held_out")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
