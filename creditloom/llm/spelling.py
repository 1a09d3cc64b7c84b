"""Spelling variants: words one letter apart, grouped under their most frequent neighbour, by anagram hashing.

A word's anagram key is the sum of the fifth powers of its code points: an integer that doesn't depend on their order, from
which a letter's value can be added or taken. Two words of one length differ by one exchange where their keys are equal once
either gives up a letter; a word is another with one letter more where its key less that letter's value is the other's key.
Keys are taken of halves, as of two words one letter apart one half (cut by the shorter one's length) is the same in both:
that half is matched letter for letter, the key is that of the other half, so few words share one by chance. The pairs found
are verified letter by letter (edit distance 1). An exchange is found by one key; a letter more may be found by both halves,
of which the first counts. So each pair comes once.

A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least RATIO times the
word's; its root is reached by following forms to the last. As n grows by RATIO with each step, chains are short: 27 steps
at 64 bits, halved in each round of joins.

Words are cut out of whole texts in Arrow batches and counted there, so a frequent word is one row a batch. No list is
collected; nothing is broadcast but by Spark's own threshold. A word has at most length + 1 keys in each of two joins, and
only words near to it in fact or by half an anagram share one.

The query's texts are first dropped letters from (`dropped`): where 199 divides the CRC-32 of `<doc_id>:<word>`, the word
loses the code point at that CRC modulo its length. A null id is taken as empty there. Null texts have no words. Very long
texts are one row of one task, very long words are words. Repeated rows count again. Empty tables give no rows. Other
columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import LOWER, cut_lineage, slices, tidy

MIN_LETTERS, MIN_COUNT, RATIO, DROP_EVERY, SLICE_BYTES = 6, 5, 5, 199, 8 << 20
#: Longer words are digested one by one.
STEPPED = 64
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1)).astype(np.uint32)


def cut_words(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF of at least so many code points: their lower-cased bytes (A-Z only), offsets in these, code points and texts."""
    n = len(data)
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _ASCII[data] | lead
    inside[2:-1] |= lead[:-1]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    letters = ends - starts - (leads[ends] - leads[starts])
    long = letters >= least
    starts, ends, letters = starts[long], ends[long], letters[long]
    kept = np.zeros(n + 1, np.int8)
    kept[starts] = 1
    kept[ends] -= 1
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return LOWER[data[np.cumsum(kept[:-1], dtype=np.int8).view(bool)]], at, letters, np.searchsorted(off, starts, side="right") - 1


def crc32_after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of texts that begin with something of CRC-32 state and go on with a span of the data."""
    out = np.zeros(len(state), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    far = int(np.searchsorted(-sizes[order], -STEPPED))
    for i in order[:far]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(state[i]))
    order = order[far:]
    crc, start, size = ~state[order], starts[order], sizes[order]
    for k in range(int(size[0]) if len(size) else 0):
        now = int(np.searchsorted(-size, -k))  # those longer than k
        crc[:now] = _CRC[(crc[:now] ^ data[start[:now] + k]) & np.uint32(255)] ^ (crc[:now] >> np.uint32(8))
    out[order] = ~crc
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str, min_letters: int = MIN_LETTERS, drop_every: int | None = None) -> DataFrame:
    """Rows (word, n). With drop_every, a word of which that number divides the CRC-32 of `<id>:<word>` loses a letter first."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text", SLICE_BYTES):
            raw, at, letters, text = cut_words(data, off, min_letters)
            coded = pa.Array.from_buffers(pa.large_string(), len(letters), [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
            word, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            names, counts = coded.dictionary, np.bincount(word, minlength=kinds)
            if drop_every and kinds:
                # A word of one document is digested once.
                both, one, many = np.unique(text * kinds + word, return_index=True, return_counts=True)
                ids = np.array([zlib.crc32(f"{x}:".encode()) for x in part.column(0).to_pylist()], np.uint32)
                crc = crc32_after(ids[both // kinds], raw, at[one], at[one + 1] - at[one])
                hit = np.flatnonzero(crc % np.uint32(drop_every) == 0)
                np.subtract.at(counts, both[hit] % kinds, many[hit])
                shorter, times = [], []
                for i, h in zip(hit.tolist(), crc[hit].tolist(), strict=True):
                    if letters[one[i]] > min_letters:
                        w = raw[at[one[i]] : at[one[i] + 1]].tobytes().decode()
                        shorter.append(w[: h % len(w)] + w[h % len(w) + 1 :])
                        times.append(int(many[i]))
                names, counts = pa.concat_arrays([names, pa.array(shorter, pa.large_string())]), np.concatenate((counts, np.array(times, np.int64)))
            left = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(left)).cast(pa.string()), pa.array(counts[left].astype(np.int64))], ["word", "n"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _value(letter: Column) -> Column:
    """The fifth power of a letter's code point."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def anagram_key(text: Column) -> Column:
    return F.aggregate(F.transform(_letters(text), _value), F.lit(0).cast("long"), lambda a, b: a + b)


def _keys(words: DataFrame, cut: Column, less: bool, whole: Column) -> DataFrame:
    """Rows (word, n, length, half, same, key): for both halves (cut after so many letters) one as it is and the key of the other, less each of its letters on demand.

    half 0: the first is as it is, 1: the second. whole: length of the second half as it is.
    """
    size = F.col("letters")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.substring("word", F.lit(1), cut).alias("same"), F.substring(F.col("word"), cut + 1, size - cut).alias("rest")),
        F.struct(F.lit(1).alias("half"), F.substring(F.col("word"), size - whole + 1, whole).alias("same"), F.substring("word", F.lit(1), size - whole).alias("rest")),
    )
    halved = words.select("word", "n", "letters", F.explode(halves).alias("h")).select("word", "n", "letters", "h.half", "h.same", anagram_key(F.col("h.rest")).alias("key"), "h.rest")
    if less:
        halved = halved.withColumn("gone", F.explode(F.array_distinct(_letters(F.col("rest"))))).withColumn("key", F.col("key") - _value(F.col("gone")))
    return halved.drop("rest", "gone")


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, a_n, b, b_n), each pair of words (word, n) that differ by one inserted, deleted or replaced code point once."""
    words = words.select("word", "n", F.length("word").alias("letters"))
    side = lambda df, p: df.select(F.col("word").alias(p), F.col("n").alias(f"{p}_n"), F.col("letters").alias(f"{p}_letters"), "half", "same", "key")
    verified = F.levenshtein("a", "b", 1) == 1

    half = F.floor(F.col("letters") / 2).cast("int")
    given = _keys(words, half, True, F.col("letters") - half)
    exchanged = side(given, "a").join(side(given, "b"), ["half", "same", "key"]).where((F.col("a") < F.col("b")) & (F.col("a_letters") == F.col("b_letters")) & verified)

    # b has one letter more: its halves are those of a word one letter shorter, plus that letter.
    short = _keys(words, half, False, F.col("letters") - half)
    cut = F.floor((F.col("letters") - 1) / 2).cast("int")
    long = _keys(words, cut, True, F.col("letters") - 1 - cut)
    added = side(short, "a").join(side(long, "b"), ["half", "same", "key"]).where((F.col("a_letters") + 1 == F.col("b_letters")) & verified)
    begin = F.floor(F.col("a_letters") / 2).cast("int")
    again = (F.col("half") == 1) & (F.substring(F.col("a"), F.lit(1), begin) == F.substring(F.col("b"), F.lit(1), begin))
    columns = ["a", "a_n", "b", "b_n"]
    return exchanged.select(*columns).unionByName(added.where(~again).select(*columns))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of forms (word, form): a word without a form of its own ends a chain. Chains must not be circles."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        stepped = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__on")))
        if stepped.where("__on").isEmpty():
            return now
        now = stepped.drop("__on")


def spelling_groups(counts: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of counts (word, n)."""
    words = cut_lineage(counts.where((F.length("word") >= min_letters) & (F.col("n") >= min_count)))
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = near_pairs(words).select(F.explode(sides).alias("s")).groupBy("s.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.near_n")).alias("less"), F.col("s.near").alias("near"))).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    found = cut_lineage(found)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_groups(word_counts(docs, "doc_id", "text", drop_every=DROP_EVERY))
