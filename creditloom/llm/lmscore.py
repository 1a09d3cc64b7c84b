"""Language-model scores: word bigrams by deleted interpolation.

P(w | h) = a2 c(h, w) / c(h) + a1 c(w) / N + a0 / (V + 1), where the weights a depend on the bucket (powers of two) of
the context's count c(h). They are learned by expectation-maximisation on held-out counts: one tenth of the training
documents is deleted from the counts and predicted from the others. Scores then use the counts of all training
documents. Counts come from every training document and every text is scored whole.

Each task that reads documents packs them, in the order they come, into chunks of about CHUNK_BYTES, compressed, which are
checkpointed: all passes see the same chunks, whatever the input's partitions would be another time, and no id, null or
repeated, gathers its rows anywhere. Deleted documents have chunks of their own, so the pass that learns the weights
moves no others. A chunk sends its distinct words and bigrams, as hashes, each with its count in the
chunk, to parts by hash range, one row a part; a part adds them up and answers each chunk with
the corpus counts of just its own keys, in the order asked. So a word as common as any is one row a chunk, nothing of
the vocabulary is broadcast, and no task holds more than a part or a chunk. Words and bigrams are told apart by
64-bit hashes; a bigram counts no more than either of its words, so none is likelier than certain if two share a hash.
Whatever is sent or kept is compressed, numbers byte by byte of their places.
The driver holds the totals, and a table of held-out tokens by bucket and rounded probabilities.

A null text is empty: it has the end token alone. A null id counts as training. Repeated rows are rows of their own, and
score alike. A very long text is one row: its tokens are found in one task, a longer text than CHUNK_BYTES as a chunk of
about its own size. There are no ties to break. An empty table gives no rows. Other columns of the documents are not
carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, cut_lineage, hashes, mix, slices, tidy, words

CHUNK_BYTES, PART_BYTES, FOLDS, HELD_OUT, DELETED = 6 << 20, 12 << 20, 10, 0, 1
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
BUCKETS, STEPS, ROUNDS = 48, 4, 60


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of the column text, those of the bigrams that end at them, and the texts' offsets in the tokens."""
    seen, sizes = [], []
    for _, data, off in slices(iter(table.to_batches()), "text"):
        starts, ends, of = words(data, off)
        size = np.diff(of) + 1
        out = np.full(int(size.sum()), END)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(size) - 1] = False
        out[inner] = hashes(data, starts, ends, lower=True)
        seen.append(out)
        sizes.append(size)
    if not seen:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(1, np.int64)
    word, at = np.concatenate(seen), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    before = np.concatenate((word[:1], word[:-1]))
    before[at[:-1]] = START
    return word, mix(before * U64(0x9E3779B97F4A7C15) + word * U64(0xD6E8FEB86659FD93)), at


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows (chunk, deleted, ids, folds, bytes, sizes, texts) of docs (id, fold, text), each some documents of one task, all deleted or none; sizes and texts compressed."""
    kind = docs.schema["id"].dataType.simpleString()

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def one(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            taken, held[deleted], size[deleted] = held[deleted], [], 0
            ids, folds = (pa.concat_arrays([x[k] for x in taken]) for k in (0, 1))
            data, sizes = np.concatenate([x[2] for x in taken]), np.concatenate([np.diff(x[3]) for x in taken])
            listed = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, folds)]
            blobs = [pa.array([x], pa.binary()) for x in (_pack(sizes.astype("<i8")), _pack_text(data))]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number - 1]), pa.array([deleted]), *listed, pa.array([len(data)], pa.int64()), *blobs], ["chunk", "deleted", "ids", "folds", "bytes", "sizes", "texts"])

        for batch in batches:
            is_deleted = pc.equal(batch.column(1), DELETED)
            for deleted, of in ((False, pc.invert(is_deleted)), (True, is_deleted)):
                for part, data, off in slices(iter([batch.filter(of)]), "text", chunk_bytes):
                    more = len(data) + part.num_rows
                    if held[deleted] and size[deleted] + more > chunk_bytes:
                        yield one(deleted)
                    held[deleted].append((part.column(0), part.column(1), data, off))
                    size[deleted] += more
        for deleted in held:
            if held[deleted]:
                yield one(deleted)

    return docs.select("id", "fold", "text").mapInArrow(pack, f"chunk bigint, deleted boolean, ids array<{kind}>, folds array<int>, bytes bigint, sizes binary, texts binary")


def unpack(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """The documents (id, fold, text) of each chunk."""
    for k in range(table.num_rows):
        ids, folds = (table.column(c).combine_chunks().slice(k, 1).flatten() for c in ("ids", "folds"))
        off = np.concatenate(([0], np.cumsum(_unpack(table.column("sizes")[k].as_py(), "<i8", len(folds)))))
        data = np.frombuffer(pa.decompress(table.column("texts")[k].as_py(), table.column("bytes")[k].as_py(), codec="zstd"), "u1")
        yield table.column("chunk")[k].as_py(), pa.table({"id": ids, "fold": folds, "text": pa.Array.from_buffers(pa.large_string(), len(folds), [None, pa.py_buffer(off), pa.py_buffer(data)])})


def _pack_text(data: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(np.ascontiguousarray(data), asbytes=True)


def _pack(x: np.ndarray) -> bytes:
    """Numbers, compressed: the lowest bytes of all, then the next ones."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x).view("u1").reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def _unpack(x: bytes, kind: str, n: int) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(x, n * wide, codec="zstd"), "u1").reshape(wide, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _pack_counts(x: np.ndarray) -> dict:
    """Counts at 4 bytes each where all fit, else at 8."""
    wide = bool(len(x)) and int(x.max()) >= 1 << 32
    return {"n": len(x), "wide": wide, "counts": _pack(x.astype("<u8" if wide else "<u4"))}


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from each to the next."""
    return _pack(np.diff(keys, prepend=U64(0)).astype("<u8"))


def unpack_keys(x: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(x, "<u8", n), dtype=U64)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted keys pass from one part to the next."""
    border = np.array([(i << 64) // parts for i in range(1, parts)], U64)
    return np.concatenate(([0], np.searchsorted(keys, border), [len(keys)]))


_ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("deleted", pa.bool_()), ("words", pa.int64()), ("pairs", pa.int64()), ("word_keys", pa.binary()), ("pair_keys", pa.binary()), ("counts", pa.binary())])
_ASK_SQL = "part int, chunk bigint, deleted boolean, words bigint, pairs bigint, word_keys binary, pair_keys binary, counts binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("words", pa.int64()), ("n", pa.int64()), ("wide", pa.bool_()), ("counts", pa.binary()), ("totals", pa.list_(pa.int64()))])
_ANSWER_SQL = "chunk bigint, part int, kind int, words bigint, n bigint, wide boolean, counts binary, totals array<bigint>"
TOTALS, TRAIN, MAIN = -1, 0, 1


def corpus_counts(chunked: DataFrame, parts: int) -> DataFrame:
    """Answers (chunk, part, kind, words, n, counts) to all chunks, and one row of totals for each part (chunk null).

    Counts are those of the chunk's distinct words, then of its bigrams. kind TRAIN: in all training documents; MAIN, for
    chunks of deleted documents alone: in the training documents that are not deleted.
    """

    @tidy
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deleted, (chunk, table) in zip(batch.column(batch.schema.get_field_index("deleted")).to_pylist(), unpack(pa.Table.from_batches([batch])), strict=True):
                yield from ask(chunk, deleted, table).to_batches()

    def ask(chunk: int, deleted: bool, table: pa.Table) -> pa.Table:
        word, pair, at = tokens(table)
        train, found = np.repeat(table.column("fold").to_numpy() != HELD_OUT, np.diff(at)), []
        for every in (word, pair):
            keys, which = np.unique(every, return_inverse=True)
            found.append((keys, np.bincount(which, train, len(keys)).astype("<u4"), _cuts(keys, parts).tolist()))
        (words, word_counts, at_word), (pairs, pair_counts, at_pair) = found
        out = []
        for part, (a, b, c, d) in enumerate(zip(at_word[:-1], at_word[1:], at_pair[:-1], at_pair[1:], strict=True)):
            if b > a or d > c:
                counts = np.concatenate((word_counts[a:b], pair_counts[c:d]))
                out.append({"part": part, "chunk": chunk, "deleted": deleted, "words": b - a, "pairs": d - c, "word_keys": pack_keys(words[a:b]), "pair_keys": pack_keys(pairs[c:d]), "counts": _pack(counts)})
        return pa.Table.from_pylist(out, schema=_ASK)

    def answer(table: pa.Table) -> pa.Table:
        rows = [r for b in table.to_batches() for r in b.to_pylist()]
        part, deleted = rows[0]["part"], np.array([r["deleted"] for r in rows])
        counts = [_unpack(r.pop("counts"), "<u4", r["words"] + r["pairs"]) for r in rows]
        found, totals = [], []
        for name, side in (("word", [c[: r["words"]] for c, r in zip(counts, rows, strict=True)]), ("pair", [c[r["words"] :] for c, r in zip(counts, rows, strict=True)])):
            sizes, n = np.array([len(x) for x in side]), np.concatenate(side)
            keys, which = np.unique(np.concatenate([unpack_keys(r.pop(f"{name}_keys"), k) for r, k in zip(rows, sizes.tolist(), strict=True)]), return_inverse=True)
            train = np.bincount(which, n, len(keys)).astype(np.int64)
            main = np.bincount(which, np.where(np.repeat(deleted, sizes), 0, n), len(keys)).astype(np.int64)
            found.append((which, np.concatenate(([0], np.cumsum(sizes))).tolist(), train, main))
            totals = totals or [int(train.sum()), int(main.sum()), int((train > 0).sum()), int((main > 0).sum())]
        out = [{"part": part, "kind": TOTALS, "totals": totals}]
        for k, r in enumerate(rows):
            for kind in (TRAIN, MAIN) if r["deleted"] else (TRAIN,):
                own = [(train if kind == TRAIN else main)[which[at[k] : at[k + 1]]] for which, at, train, main in found]
                out.append({"chunk": r["chunk"], "part": part, "kind": kind, "words": r["words"]} | _pack_counts(np.concatenate(own)))
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return chunked.mapInArrow(asked, _ASK_SQL).groupBy("part").applyInArrow(answer, _ANSWER_SQL)


def _counts(answers: pa.Table, word: np.ndarray, pair: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The answered counts of each token, of the bigram that ends there and of its context. Bigrams that share a hash count no more than their words."""
    rows = sorted(answers.to_pylist(), key=lambda r: r["part"])
    counts = [_unpack(r["counts"], "<u8" if r["wide"] else "<u4", r["n"]) for r in rows]
    sides = [c[: r["words"]] for c, r in zip(counts, rows, strict=True)], [c[r["words"] :] for c, r in zip(counts, rows, strict=True)]
    c1, c2 = (np.concatenate(side)[np.unique(every, return_inverse=True)[1]].astype(np.int64) for side, every in zip(sides, (word, pair), strict=True))
    context = _contexts(c1, at)
    return c1, np.minimum(c2, np.minimum(c1, context)), context


def _contexts(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The count of what stands before each token. Starts are as many as ends."""
    before = np.concatenate((c[:1], c[:-1]))
    before[at[:-1]] = c[at[1:] - 1]
    return before


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def learn_weights(cells: list[tuple[int, int]], p0: float) -> np.ndarray:
    """Weights (BUCKETS, 3) of bigram, unigram and uniform, from held-out tokens counted by cell. Buckets without tokens take the common weights."""
    code, n = (np.array(x, np.float64) for x in zip(*cells, strict=True)) if cells else (np.zeros(0), np.zeros(0))
    code = code.astype(np.int64)
    bucket = code >> 20
    level = np.stack([code >> 10 & 1023, code & 1023])
    p2, p1 = np.where(level > 0, 2.0 ** (-(level - 1) / STEPS), 0)
    p = np.stack([p2, p1, np.full(len(n), p0)], 1)

    def em(of: np.ndarray, groups: int) -> np.ndarray:
        a = np.tile([0.4, 0.5, 0.1], (groups, 1))
        for _ in range(ROUNDS):
            share = a[of] * p
            share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
            a = np.stack([np.bincount(of, share[:, k], groups) for k in range(3)], 1) + 1e-9
            a /= a.sum(1, keepdims=True)
        return a

    common = em(np.zeros(len(n), np.int64), 1)[0] if len(n) else np.array([0.4, 0.5, 0.1])
    out = em(bucket, BUCKETS)
    out[np.bincount(bucket, n, BUCKETS) < 100] = common
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(DELETED + 1)).cast("int")
    # Whatever comes later reads these files, so a chunk's keys are the same in each pass.
    chunked = cut_lineage(chunks(docs.select(F.col(id_col).alias("id"), fold.alias("fold"), text.alias("text")), chunk_bytes))
    size = chunked.agg(F.sum(F.col("bytes") + F.size("ids"))).first()[0] or 1
    answers = cut_lineage(corpus_counts(chunked, -(-size // part_bytes)))
    n, n_main, v, v_main = answers.where(F.col("kind") == TOTALS).agg(*(F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)) for k in range(4))).first()

    def level(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.minimum(np.rint(-np.log2(np.maximum(p, 1e-300)) * STEPS), 1000) + 1, 0).astype(np.int64)

    def held(key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        _, table = next(unpack(table))
        word, pair, at = tokens(table)
        c1, c2, context = _counts(counts, word, pair, at)
        cells, many = np.unique(_bucket(context) << 20 | level(c2 / np.maximum(context, 1)) << 10 | level(c1 / max(n_main, 1)), return_counts=True)
        return pa.table({"cell": cells, "n": many})

    answered = lambda kind: answers.where(F.col("kind") == kind).select("chunk", "part", "words", "n", "wide", "counts").groupBy("chunk")
    cells = chunked.where("deleted").groupBy("chunk").cogroup(answered(MAIN)).applyInArrow(held, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([tuple(r) for r in cells], 1 / (v_main + 1))
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        _, table = next(unpack(table))
        word, pair, at = tokens(table)
        c1, c2, context = _counts(counts, word, pair, at)
        a = weights[_bucket(context)]
        p = a[:, 0] * c2 / np.maximum(context, 1) + a[:, 1] * c1 / max(n, 1) + a[:, 2] / (v + 1)
        base = np.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))
        return pa.table({
            "id": table.column("id"), "held_out": pa.array(table.column("fold").to_numpy() == HELD_OUT), "n_tokens": np.diff(at), "n_known": np.add.reduceat((c1 > 0).astype(np.int64), at[:-1]),
            "train_tokens": np.full(len(at) - 1, n), "base_score": np.add.reduceat(base, at[:-1]), "score": np.add.reduceat(np.log10(p), at[:-1]),
        })

    return chunked.groupBy("chunk").cogroup(answered(TRAIN)).applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
