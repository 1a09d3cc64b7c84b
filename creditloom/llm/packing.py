"""Packing documents into fixed-length sequences by the sum-of-squares rule.

Documents become token ids in Arrow batches; only those longer than a sequence are cut. Pieces are dealt at random to
shards of about SHARD pieces, and each shard is packed alone, from the longest piece to the shortest: a piece goes
where the sum of the squared counts of open sequences per residual gap becomes smallest, a new sequence being opened
only where none has room (opening one whenever that makes the sum smaller took 1 % more sequences). Sequences left
under FULL are dissolved and their pieces packed once more together, by the same rule, in fewer shards.

A null text is empty: it has only the end id. Null ids are carried, and rows alike in everything (as of a null id and
text) are dealt to all shards like others. Very long texts are encoded alone and cut into as many pieces as they need.
Pieces of equal length go in the order of a hash. Empty tables give no pieces; repeated rows are packed as rows of their
own. Other columns of the documents are not carried; pack() keeps all columns of the pieces, whose names must not be
sequence_id, offset or start with two underscores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import cut_lineage, hashes, ranges, slices, tidy

CAPACITY, SHARD, FULL, END_ID, CACHE_WORDS = 4096, 16_384, 0.995, 1, 500_000


class WordEncoder:
    """Token ids of texts through a tokenizer that drops white space, so that a text's ids are those of its words in turn.

    Words are parted at ASCII spaces alone; each distinct word of a batch is encoded once, and a bounded number of them is kept.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.used = np.zeros(0, np.int32)  # batches that held the word, halved at each clearing

    def _spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = (data != 32) & (data != 10) & (data != 13) & (data != 9)
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        of = np.searchsorted(starts, off)
        # The tokenizer parts a letter from a full stop or comma in any case, so the sign can be a word of its own here.
        tail = (ends - starts >= 2) & ((data[ends - 1] == 46) | (data[ends - 1] == 44))
        before = data[ends[tail] - 2] | 32
        tail[tail] = (before >= 97) & (before <= 122)
        many = 1 + tail
        last = np.cumsum(many) - 1
        starts, ends = np.repeat(starts, many), np.repeat(ends, many)
        starts[last[tail]] = ends[last[tail]] - 1
        ends[last[tail] - 1] -= 1
        return starts, ends, np.concatenate(([0], last + 1))[of]

    def _keys(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes that are equal for words of equal ids: case does not count, but in words that may hold special tokens."""
        keys = hashes(data, starts, ends, lower=True)
        bars = np.concatenate(([0], np.cumsum(data == 124)))
        special = np.flatnonzero(bars[ends] > bars[starts])
        if len(special):
            keys[special] = hashes(data, starts[special], ends[special]) ^ np.uint64(1)
        return keys

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the texts' offsets in them."""
        starts, ends, of = self._spans(data, off)
        keys, first, which = np.unique(self._keys(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in spans], add_special_tokens=False)]
            if len(self.keys) > CACHE_WORDS:
                self._keep(at[np.setdiff1d(np.arange(len(keys)), new, assume_unique=True)])
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate((self.ids, ids))
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged, kind="stable")
            self.keys, self.begin, self.size = merged[order], np.concatenate((self.begin, begin))[order], np.concatenate((self.size, size))[order]
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int32)))[order]
            at = np.searchsorted(self.keys, keys)
        self.used[at] += 1
        word = at[which]
        count = self.size[word]
        run = np.concatenate(([0], np.cumsum(count)))
        return self.ids[ranges(self.begin[word], count)], run[of]

    def _keep(self, needed: np.ndarray) -> None:
        """Keeps the words needed now and those met in several batches, half of CACHE_WORDS of them at most."""
        often = np.flatnonzero(self.used >= 2)
        if len(often) > CACHE_WORDS // 2:
            often = often[np.argsort(-self.used[often], kind="stable")[: CACHE_WORDS // 2]]
        rows = np.union1d(needed, often)
        self.used = self.used[rows] // 2
        self.ids = self.ids[ranges(self.begin[rows], self.size[rows])]
        self.keys, self.size = self.keys[rows], self.size[rows]
        self.begin = np.cumsum(self.size) - self.size


@lru_cache(1)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for a Python worker, so that its words serve the tasks to come."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, ids): the documents' ids and an end id, cut only where they exceed capacity."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        for part, data, off in slices(batches, "text", 2 << 20):
            ids, at = encoder.encode(data, off)
            out: list[list] = [[], [], [], [], [], []]
            for row in range(part.num_rows):
                own = np.append(ids[at[row] : at[row + 1]], END_ID).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    x = own[start : start + capacity]
                    for column, value in zip(out, (row, piece, start, len(x), zlib.crc32(x.tobytes()), x if keep_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True))],
                ["id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<bigint>")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed from the longest to the shortest, and each bin's fill."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_open = np.zeros(capacity + 1, np.int64)
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # Placing in gap g takes one from n[g] and adds one to n[g - s]: the sum of squares falls by
        # 2 (n[g] - n[g - s]) - 2, and by 2 n[s] - 1 where the bin becomes full, since full bins do not count.
        gaps = n_open[s:]
        gain = 2 * (gaps - n_open[: len(gaps)]) - 2
        gain[0] = 2 * gaps[0] - 1
        gain[gaps == 0] = -(1 << 60)
        g = s + int(gain.argmax())
        if n_open[g]:
            b = open_bins[g].pop()
            n_open[g] -= 1
        else:
            b = len(fill)
            fill.append(0)
            g = capacity
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if g > s:
            open_bins[g - s].append(b)
            n_open[g - s] += 1
    return bins, offsets, np.array(fill, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The pieces (any columns, among them length) with sequence_id and offset."""
    # The row's number tells equal rows apart, so that they too are dealt to all shards; the checkpoint fixes it.
    pieces = cut_lineage(pieces.withColumn("__r", F.xxhash64(*[c for c in ("id", "piece", "ids_crc32", "length") if c in pieces.columns], F.monotonically_increasing_id())))
    n = pieces.count()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def placed(rows: DataFrame, shards: int, round_: int) -> DataFrame:
        def place(table: pa.Table) -> pa.Table:
            table = table.sort_by([("__r", "ascending")])
            shard_of = table.column("__shard")[0].as_py()
            bins, offsets, fill = sum_of_squares(table.column("length").to_numpy(), capacity)
            table = table.drop_columns(["__shard"])
            table = table.append_column("sequence_id", pa.array(((shard_of * 2 + round_) << 32) + bins))
            return table.append_column("offset", pa.array(offsets)).append_column("__fill", pa.array(fill[bins]))

        dealt = rows.withColumn("__shard", F.pmod(F.hash("__r", F.lit(round_)), F.lit(shards)).cast("long"))
        return dealt.groupBy("__shard").applyInArrow(place, f"{schema}, sequence_id bigint, offset bigint, __fill bigint")

    first = cut_lineage(placed(pieces, max(1, round(n / shard)), 0))
    loose = first.where(F.col("__fill") < FULL * capacity)
    second = placed(loose.drop("sequence_id", "offset", "__fill"), max(1, round(loose.count() / shard)), 1)
    return first.where(F.col("__fill") >= FULL * capacity).unionByName(second).drop("__fill", "__r")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids): each sequence's tokens, of packed pieces that carry their ids; at most one capacity of tokens a row."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = token_pieces(docs, word_tokenizer()).drop("ids")
    return pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
