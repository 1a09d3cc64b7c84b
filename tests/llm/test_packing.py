import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from creditloom.llm import bytesops, packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.word_tokenizer())


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(1)
    texts = ["", "  ", "Hello, World. it's. İ.  Á. ea.) ..., <|endoftext|>. <|ENDOFTEXT|>, x<|startoftext|>y", "a.\x1cq\x85z é, Ä. ß.", "a|B. A|b. 12.5, 3.", "ΣΑΣ. 你好。hi.", "\x00.\x01,a."]
    texts += ["".join(rng.choice("aA.,'| \n\té́sS<>|İ12  _-") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    encoder = packing.WordEncoder(packing.word_tokenizer())
    for part in (texts, texts[::-1]):  # the second time from kept words
        ids, at = encoder.encode(*bytesops.flat(pa.array(part)))
        for i, t in enumerate(part):
            assert list(ids[at[i] : at[i + 1]]) == tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_and_sequences(odd_docs, tokenizer):
    packed = packing.pack(packing.token_pieces(odd_docs, packing.word_tokenizer(), capacity=1000, keep_ids=True), 1000)
    rows = packed.collect()
    want = []
    for d in odd_docs.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        want += [(d.doc_id, p, s, len(ids[s : s + 1000]), zlib.crc32(struct.pack(f"<{len(ids[s : s + 1000])}I", *ids[s : s + 1000]))) for p, s in enumerate(range(0, len(ids), 1000))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([(r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1000
    lengths = {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()}
    assert lengths == {k: sum(n for _, n in x) for k, x in held.items()}


def test_no_rows(no_docs):
    assert packing.pack(packing.token_pieces(no_docs, packing.word_tokenizer()).drop("ids")).count() == 0


def test_sum_of_squares_by_definition():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 41, 300)
    bins, offsets, fill = packing.sum_of_squares(lengths, 40)
    level: list[int] = []

    def squares(levels):
        gaps = [40 - x for x in levels if x < 40]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        options = [k for k in range(len(level)) if level[k] + s <= 40] or [len(level)]
        score = {k: squares(level[:k] + [(level[k] if k < len(level) else 0) + s] + level[k + 1 :]) for k in options}
        assert score[int(bins[i])] == min(score.values())
        k = int(bins[i])
        if k == len(level):
            level.append(0)
        assert offsets[i] == level[k]
        level[k] += s
    assert level == fill.tolist()


def test_few_sequences(spark):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in np.minimum(rng.lognormal(6, 1, 5000).astype(int) + 1, 4096)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    used = packing.pack(rows, shard=1500).select("sequence_id").distinct().count()
    assert used <= math.ceil(sum(lengths) / 4096) * 1.01 + 1


def test_equal_rows_are_dealt_to_all_shards(spark):
    rows = spark.range(100_000).selectExpr("cast(null as bigint) as id", "0 as piece", "0L as start", "1L as length", "7L as ids_crc32").repartition(4)
    packed = packing.pack(rows, shard=5_000).selectExpr("shiftright(sequence_id, 32) as shard").groupBy("shard").count().collect()
    # Twenty shards, and about four for what they left over.
    assert len(packed) >= 23 and max(r["count"] for r in packed) < 6_000 and sum(r["count"] for r in packed) == 100_000
