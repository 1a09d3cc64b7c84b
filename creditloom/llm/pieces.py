"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that were not met before are laid end to end and indexed by a suffix array. Every piece of the
vocabulary is looked up in it by binary search, which gives the range of its occurrences; these become edges (from,
length, piece), placed by position. Relaxing then follows the model's own rule: in each word the best-scored edge that
joins two neighbouring symbols is taken, leftmost first, until none is left. Characters that no piece covers become
their bytes' pieces. Ids equal those of the library for vocabularies of byte-pair kind without pieces that go on past
a space or a line end, and with the plain normalizer (a space put before the text, spaces shown as U+2581).

A null text is empty and has no ids; a null id is carried. Repeated rows are encoded alike. Decoding gives the text back,
but for U+2581, which the format cannot tell from a space; round_trip says of each text, as it was given, whether it came
back. Very long texts are encoded whole; a word of more than LONG_WORD characters is relaxed with a heap. Of equal scores
the leftmost edge is taken. Empty tables give no rows. Other columns are not carried, so their names cannot clash. A model
that is not byte-pair, or has pieces this encoder does not take, raises ValueError.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, flat, hashes, ranges, slices

LONGEST, CACHE_WORDS, INDEX_BYTES, LONG_WORD = 16, 500_000, 400_000, 2_000


def _eights(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the next seven as one big-endian number; zeros follow the end."""
    x = np.concatenate((data, np.zeros(8, np.uint8))).astype(U64)
    out = np.zeros(len(data), U64)
    for k in range(8):
        out = (out << U64(8)) | x[k : k + len(data)]
    return out


def suffix_array(eights: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth bytes or more, by prefix doubling from eights on."""
    n = len(eights)
    order = np.argsort(eights, kind="stable")
    width, key = 8, eights
    while width < depth:
        new = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        if new[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = new + 1
        key = rank * (n + 2) + np.concatenate((rank[width:], np.zeros(min(width, n), np.int64)))[:n]
        order = np.argsort(key, kind="stable")
        width *= 2
    return order


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, message[at : at + size]
            at += size


def model_kind(message: bytes) -> int:
    """The kind of a serialized model: 1 unigram (also where none is named), 2 byte-pair, 3 word, 4 char."""
    for number, trainer in _fields(message):
        if number == 2:  # the trainer's settings, whose third field is the kind
            return next((int(v) for n, v in _fields(trainer) if n == 3), 1)
    return 1


class Pieces:
    """The vocabulary: each piece's bytes as eights, its length in bytes and characters, and its score."""

    def __init__(self, model: str):
        import sentencepiece

        with open(model, "rb") as file:
            if (kind := model_kind(file.read())) != 2:
                raise ValueError(f"this encoder takes byte-pair models; kind {kind} was given")
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        self.spelling: list[bytes] = [b""] * n
        ids, self.score = [], np.zeros(n)
        for i in range(n):
            piece, self.score[i] = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.spelling[i] = piece.replace("▁", " ").encode()
                ids.append(i)
                if " " in piece.replace("▁", " ").lstrip(" ") or "\n" in piece or len(piece) > LONGEST:
                    raise ValueError(f"a piece that this encoder does not take: {piece!r}")
        self.ids = np.array(ids)
        spelled = [self.spelling[i] for i in ids]
        self.bytes = np.array([len(x) for x in spelled])
        self.chars = np.array([len(x.decode()) for x in spelled])
        self.depth = -(-int(self.bytes.max()) // 8) * 8
        flat = np.frombuffer(b"".join(x.ljust(self.depth, b"\0") for x in spelled), ">u8").reshape(len(ids), -1)
        top = np.frombuffer(b"".join(x.ljust(self.depth, b"\xff") for x in spelled), ">u8").reshape(len(ids), -1)
        self.low, self.high = flat.astype(U64), top.astype(U64)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in self.spelling])))
        self.all = np.frombuffer(b"".join(self.spelling), np.uint8)

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences (byte, index of the piece) of pieces in data."""
        eights = _eights(data)
        order = suffix_array(eights, self.depth)
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(order))
        for level in range(self.depth // 8):
            live = np.flatnonzero((self.bytes > 8 * level) & (lo < hi))
            if not len(live):
                break
            at = np.minimum(order + 8 * level, len(data))
            key = np.concatenate((eights, np.zeros(1, U64)))[at]
            if level == 0:
                lo[live], hi[live] = np.searchsorted(key, self.low[live, 0]), np.searchsorted(key, self.high[live, 0], side="right")
            else:
                a, b = lo[live], hi[live]
                lo[live] = _bisect(key, self.low[live, level], a, b, False)
                hi[live] = _bisect(key, self.high[live, level], a, b, True)
        count = np.maximum(hi - lo, 0)
        return order[ranges(lo, count)], np.repeat(np.arange(len(self.ids)), count)


def _bisect(key: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted() of each x in its own range of the key."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        before = key[mid] <= x[open_] if right else key[mid] < x[open_]
        lo[open_[before]] = mid[before] + 1
        hi[open_[~before]] = mid[~before]
    return lo


class Encoder:
    def __init__(self, model: str):
        self.pieces = Pieces(model)
        self.keys, self.begin, self.size, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the texts' offsets in them."""
        size = np.diff(off)
        full = np.flatnonzero(size)
        x = np.full(len(data) + len(full), 32, np.uint8)
        begins = off[full] + np.arange(len(full))
        body = np.ones(len(x), bool)
        body[begins] = False
        x[body] = data
        # Words begin at the first space of a row of spaces, and a line end is a word.
        space, line = x == 32, x == 10
        first = space & ~np.concatenate(([False], space[:-1])) | line | np.concatenate(([False], line[:-1]))
        first[begins] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(x))
        of = np.zeros(len(off), np.int64)
        of[:-1][full] = np.searchsorted(starts, begins)
        of[-1] = len(starts)
        for k in np.flatnonzero(size == 0)[::-1]:
            of[k] = of[k + 1]
        keys, one, which = np.unique(hashes(x, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            if len(self.keys) > CACHE_WORDS:
                self._keep(np.sort(at[np.setdiff1d(np.arange(len(keys)), new, assume_unique=True)]))
            self._learn(x, starts[one[new]], ends[one[new]], keys[new])
            at = np.searchsorted(self.keys, keys)
        word = at[which]
        run = np.concatenate(([0], np.cumsum(self.size[word])))
        return self.ids[ranges(self.begin[word], self.size[word])], run[of]

    def _keep(self, rows: np.ndarray) -> None:
        self.ids = self.ids[ranges(self.begin[rows], self.size[rows])]
        self.keys, self.size = self.keys[rows], self.size[rows]
        self.begin = np.cumsum(self.size) - self.size

    def _learn(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        ids, sizes, at, many = [self.ids], [], 0, ends - starts
        run = np.concatenate(([0], np.cumsum(many)))
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(run, run[at] + INDEX_BYTES, side="right")) - 1)
            found, size = self._segment(x[ranges(starts[at:to], many[at:to])], many[at:to])
            ids.append(found.astype(np.int32))
            sizes.append(size)
            at = to
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.cumsum(size) - size
        merged = np.concatenate((self.keys, keys))
        order = np.argsort(merged, kind="stable")
        self.ids, self.keys = np.concatenate(ids), merged[order]
        self.begin, self.size = np.concatenate((self.begin, begin))[order], np.concatenate((self.size, size))[order]

    def _segment(self, body: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end, and their number in each."""
        p = self.pieces
        # A zero byte after each word; no piece has one, so none goes past a word's end.
        apart = np.zeros(len(body) + len(many), np.uint8)
        ends = np.cumsum(many + 1)
        inner = np.ones(len(apart), bool)
        inner[ends - 1] = False
        apart[inner] = body
        where, piece = p.edges(apart)
        lead = (apart & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        n = int(char[-1]) + 1
        edge = np.full(n * (LONGEST + 1), -1, np.int32)
        edge[char[where] * (LONGEST + 1) + p.chars[piece]] = p.ids[piece]
        byte_of = np.append(np.flatnonzero(lead), len(apart))
        last = char[ends - 1]  # the zero after each word
        first = np.concatenate(([0], last[:-1] + 1))
        length, id_of = np.ones(n, np.int64), edge[1 :: LONGEST + 1][:n].astype(np.int64)
        alive = np.ones(n, bool)
        alive[last] = False
        chars = last - first
        self._relax(edge, first[chars <= LONG_WORD], chars[chars <= LONG_WORD], length, id_of, alive)
        for w in np.flatnonzero(chars > LONG_WORD):
            self._relax_long(edge, int(first[w]), int(last[w]), length, id_of, alive)
        symbols = np.flatnonzero(alive)
        unknown = id_of[symbols] < 0
        wide = np.where(unknown, byte_of[symbols + 1] - byte_of[symbols], 1)
        out = np.repeat(id_of[symbols], wide)
        spelled = np.repeat(unknown, wide)
        out[spelled] = p.byte_ids[apart[ranges(byte_of[symbols[unknown]], wide[unknown])]]
        run = np.concatenate(([0], np.cumsum(wide)))
        return out, run[np.searchsorted(symbols, last)] - run[np.searchsorted(symbols, first)]

    def _relax(self, edge: np.ndarray, first: np.ndarray, chars: np.ndarray, length: np.ndarray, id_of: np.ndarray, alive: np.ndarray) -> None:
        """Takes the best edge of every word at once, round by round; words without one drop out."""
        score = self.pieces.score

        def joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = length[left] + length[right]
            found = np.where(total <= LONGEST, edge[left * (LONGEST + 1) + np.minimum(total, LONGEST)], -1)
            return found, np.where(found >= 0, score[found], -np.inf)

        first, chars = first[chars > 1], chars[chars > 1]
        # Symbols of the words still at work, with the edge that joins each to the next of its word.
        sym, size = ranges(first, chars), chars
        if not len(sym):
            return
        got, value = joined(sym, np.append(sym[1:], sym[-1]))
        value[np.cumsum(size) - 1] = -np.inf
        while len(size):
            at = np.cumsum(size) - size
            best = np.maximum.reduceat(value, at)
            top = np.flatnonzero(value == np.repeat(best, size))
            pick = top[np.searchsorted(top, at)]
            works = best > -np.inf
            pick_on = pick[works]
            a, b = sym[pick_on], sym[pick_on + 1]
            id_of[a] = got[pick_on]
            length[a] += length[b]
            alive[b] = False
            keep = np.repeat(works & (size > 2), size)
            keep[pick_on + 1] = False
            place = np.cumsum(keep) - 1
            more = works & (size > 2)
            sym, got, value, size = sym[keep], got[keep], value[keep], size[more] - 1
            if not len(size):
                return
            left = place[pick[more]]
            at = np.cumsum(size) - size
            ends = at + size - 1
            right_end = left == ends
            mid = left[~right_end]
            got[mid], value[mid] = joined(sym[mid], sym[mid + 1])
            value[left[right_end]] = -np.inf
            prev = left[left > at] - 1
            got[prev], value[prev] = joined(sym[prev], sym[prev + 1])

    def _relax_long(self, edge: np.ndarray, first: int, last: int, length: np.ndarray, id_of: np.ndarray, alive: np.ndarray) -> None:
        """The same for one long word, with a heap."""
        score, heap = self.pieces.score, []
        after, before = list(range(1, last - first + 1)), list(range(-1, last - first - 1))

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else last
            if i >= 0 and j < last - first:
                total = int(length[first + i] + length[first + j])
                if total <= LONGEST and (e := int(edge[(first + i) * (LONGEST + 1) + total])) >= 0:
                    heapq.heappush(heap, (-score[e], i, total, e))

        for i in range(last - first):
            offer(i)
        while heap:
            _, i, total, e = heapq.heappop(heap)
            j = after[i]
            if not alive[first + i] or j >= last - first or length[first + i] + length[first + j] != total:
                continue
            id_of[first + i], length[first + i], alive[first + j] = e, total, False
            after[i] = after[j]
            if after[j] < last - first:
                before[after[j]] = i
            offer(i)
            offer(before[i])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts of ids, one after another, with the texts' offsets in them."""
        p = self.pieces
        size = p.at[ids + 1] - p.at[ids]
        spelled = p.all[ranges(p.at[ids], size)].tobytes()
        run = np.concatenate(([0], np.cumsum(size)))[at]
        return [spelled[a + 1 : b] if b > a else b"" for a, b in zip(run[:-1].tolist(), run[1:].tolist(), strict=True)]


@lru_cache(1)
def shared_encoder(model: str) -> Encoder:
    """One encoder for a Python worker, so that its words serve the tasks to come."""
    return Encoder(model)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (id, n_pieces, ids_crc32, decoded_crc32, round_trip, ids); with keep_ids off, ids is null."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model)
        # The library reads U+2581 as a space; texts are compared with what decoding gives as they were.
        plain = (b.append_column("plain", pc.replace_substring(b.column(1), "▁", " ")) for b in batches)
        for part, data, off in slices(plain, "plain"):
            ids, at = encoder.encode(data, off)
            decoded = encoder.decode(ids, at)
            whole, ends = flat(part.column(1))
            raw = whole.tobytes()
            own = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(at)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()), pa.array([zlib.crc32(x) for x in decoded], pa.int64()),
                 pa.array([x == raw[a:b] for x, a, b in zip(decoded, ends[:-1], ends[1:], strict=True)], pa.bool_()), pa.array(own if keep_ids else [None] * len(own), pa.list_(pa.int32()))],
                ["id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip", "ids"],
            )

    return rows.mapInArrow(run, f"id {kind}, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """Rows (id, text) of rows (id, ids)."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model)
        for batch in batches:
            ids = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            texts = encoder.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_pieces(docs, piece_model(), keep_ids=False).drop("ids").withColumnRenamed("id", "doc_id")
