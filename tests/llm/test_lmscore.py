import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from creditloom.llm import lmscore


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def fold(i):
    return lmscore.DELETED + 1 if i is None else zlib.crc32(str(i).encode()) % 10


def brute(docs):
    train, main = [tokens(t) for i, t in docs if fold(i) != 0], [tokens(t) for i, t in docs if fold(i) not in (0, 1)]

    def counts(texts):
        one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(["<s>", *t], t, strict=False))
        return one, two, sum(one.values())

    one, two, n = counts(train)
    m1, m2, mn = counts(main)
    events = [(m1[h] if h != "<s>" else m1["</s>"], m2[h, w], m1[w]) for i, t in docs if fold(i) == 1 for x in [tokens(t)] for h, w in zip(["<s>", *x], x, strict=False)]
    cells = Counter()
    level = lambda p: 0 if p <= 0 else min(round(-math.log2(p) * lmscore.STEPS), 1000) + 1
    for c, c2, c1 in events:
        cells[int(lmscore._bucket(np.array([c]))[0]) << 20 | level(c2 / max(c, 1)) << 10 | level(c1 / max(mn, 1))] += 1
    weights = lmscore.learn_weights(list(cells.items()), 1 / (len(m1) + 1))
    out = {}
    for i, t in docs:
        x, base, score = tokens(t), 0.0, 0.0
        for h, w in zip(["<s>", *x], x, strict=False):
            c = one["</s>"] if h == "<s>" else one[h]
            a = weights[int(lmscore._bucket(np.array([c]))[0])]
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1)))
            score += math.log10(a[0] * two[h, w] / max(c, 1) + a[1] * one[w] / max(n, 1) + a[2] / (len(one) + 1))
        out[i] = (fold(i) == 0, len(x), sum(one[w] > 0 for w in x), n, pytest.approx(base, abs=1e-6), pytest.approx(score, abs=1e-6))
    return out


def test_equals_brute_force_in_one_chunk_and_many(spark):
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(200, None), (201, ""), (202, "Never seen words HERE"), (203, "x " * 3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = brute(docs)
    for sizes in ({}, {"chunk_bytes": 3000, "part_bytes": 5000}):
        got = {r.id: tuple(r)[1:] for r in lmscore.lm_scores(df, **sizes).collect()}
        assert got == want
    seen = [r for i, r in want.items() if r[0]]
    assert seen


def test_odd_rows(odd_docs, no_docs):
    rows = lmscore.lm_scores(odd_docs, chunk_bytes=20_000).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.id: r.n_tokens for r in rows}[0] == 1
    assert lmscore.lm_scores(no_docs).count() == 0


def test_weights_add_up_and_probabilities_are_one():
    cells = [(3 << 20 | 5 << 10 | 9, 500), (3 << 20 | 0 << 10 | 30, 500), (0 << 20 | 0 << 10 | 12, 300), (4 << 20 | 3 << 10 | 0, 5)]
    w = lmscore.learn_weights(cells, 1e-3)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and (w >= 0).all()
    assert np.allclose(lmscore.learn_weights([], 0.5).sum(1), 1)


def test_keys_survive_packing():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1 << 40), (2, 1 << 62), (1000, 1 << 41), (1000, 1 << 63)):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert np.array_equal(lmscore.unpack_keys(lmscore.pack_keys(keys), len(keys)), keys)


def test_far_keys_are_sent_in_about_the_bytes_of_their_steps():
    rng = np.random.default_rng(1)
    for bits, most in ((48, 5.2), (64, 7.2)):  # 5,000 steps average 36 and 52 bits
        keys = np.unique(rng.integers(0, 1 << bits, 5000, dtype=np.uint64))
        assert len(lmscore.pack_keys(keys)) < most * len(keys)
    counts = rng.geometric(0.1, 5000)
    assert len(lmscore._pack_counts(counts)["counts"]) < 0.85 * len(counts)


def test_deleted_documents_alone_are_moved_for_the_weights(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 10 as int) as fold", "concat('some words of text ', id) as text").repartition(4)
    rows = lmscore.chunks(df, 20_000).collect()
    kinds = [{f == lmscore.DELETED for f in r.folds} for r in rows]
    assert all(k == {r.deleted} for k, r in zip(kinds, rows, strict=True)) and sum(len(r.ids) for r in rows if r.deleted) == 500
    assert sorted(i for r in rows for i in r.ids) == list(range(5000))
    answers = lmscore.corpus_counts(spark.createDataFrame(rows, lmscore.chunks(df, 20_000).schema), 3).collect()
    assert {r.chunk for r in answers if r.kind == lmscore.MAIN} == {r.chunk for r in rows if r.deleted}
    assert len(answers) <= 3 * (len(rows) + sum(r.deleted for r in rows) + 1)


def test_counts_beyond_32_bits_survive_packing():
    for counts in ([], [3, 0], [7, (1 << 32) - 1], [1, 1 << 32, 5 << 40]):
        row = lmscore._pack_counts(np.array(counts, np.int64))
        assert lmscore._unpack(row["counts"], "<u8" if row["wide"] else "<u4", row["n"]).tolist() == counts


def test_rows_of_a_null_id_are_dealt_to_many_chunks(spark, monkeypatch):
    df = spark.range(100_000).selectExpr("cast(null as bigint) as doc_id", "concat('word of text ', id % 50000) as text").repartition(8)
    seen = []
    counts = lmscore.corpus_counts
    monkeypatch.setattr(lmscore, "corpus_counts", lambda chunked, parts: seen.append(chunked) or counts(chunked, parts))
    rows = lmscore.lm_scores(df, chunk_bytes=50_000, part_bytes=200_000)
    assert rows.count() == 100_000 and rows.where("held_out").count() == 0
    sizes = [r[0] for r in seen[0].selectExpr("size(ids)").collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * sum(sizes) / len(sizes) and sum(sizes) == 100_000
    assert rows.select("train_tokens").distinct().collect()[0][0] == 500_000


def test_rows_all_alike_are_dealt_to_many_chunks(spark):
    df = spark.range(50_000).selectExpr("cast(7 as bigint) as id", "2 as fold", "'the same words in every row' as text").repartition(4)
    made = lmscore.chunks(df, 100_000)
    assert made.count() > 10 and made.selectExpr("max(bytes)").first()[0] <= 100_000


def test_scores_stay_when_the_input_is_split_otherwise_between_passes(spark, tmp_path, monkeypatch):
    """As when executors come and go, so that a later pass plans the scan anew."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(40))) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    counts = lmscore.corpus_counts

    def split_anew(chunked, parts):
        out = counts(chunked, parts)
        out.cache().count()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        return out

    want = {r.id: (r.base_score, r.score) for r in lmscore.lm_scores(docs, chunk_bytes=20_000, part_bytes=50_000).collect()}
    monkeypatch.setattr(lmscore, "corpus_counts", split_anew)
    try:
        got = {r.id: (r.base_score, r.score) for r in lmscore.lm_scores(docs, chunk_bytes=20_000, part_bytes=50_000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1000 and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_a_common_bigram_does_not_count_for_another_with_like_bits(spark):
    """The first 48 bits of both bigrams' hashes are equal."""
    of = [[i for i in range(3000) if fold(i) == f] for f in range(10)]
    docs = [(i, "w6333 w1399 " * 20) for i in of[2]] + [(of[1][0], "w5472 w2462"), (of[0][0], "w5472 w2462"), (of[3][0], "w5472 alone"), (of[3][1], "alone w2462")]
    rows = lmscore.lm_scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.id: tuple(r)[1:] for r in rows} == brute(docs)


def test_bigrams_that_share_a_hash_count_no_more_than_their_words():
    word, pair, at = lmscore.tokens(pa.table({"text": ["a b", "c"]}))
    words = dict(zip(word.tolist(), [5, 3, 7, 0, 7], strict=True))
    counts = np.array([words[k] for k in sorted(words)] + [1000] * len(pair))
    answers = pa.Table.from_pylist([{"part": 0, "words": len(words)} | lmscore._pack_counts(counts)])
    c1, c2, context = lmscore._counts(answers, word, pair, at)
    assert c1.tolist() == [5, 3, 7, 0, 7] and context.tolist() == [7, 5, 3, 7, 0] and c2.tolist() == [5, 3, 3, 0, 0]
