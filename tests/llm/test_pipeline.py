import random
import struct
import zlib
from pathlib import Path

from tokenizers import Tokenizer

import corpus_pipeline
from creditloom.llm import packing

from .conftest import prose
from .test_linedup import brute_inline
from .test_neardup import brute as brute_groups
from .test_neardup import edited


JUNK = 401


def corpus(rng):
    """(id, text, toxic): clean prose, toxic prose, texts without letters, near copies, and passages that repeat."""
    bad = ["stupid", "moron", "idiot", "worthless"]
    rows = []
    passage, base = prose(rng, 70), prose(rng, 150)
    for i in range(400):
        kind = rng.random()
        if kind < 0.25:
            words = prose(rng, rng.randint(30, 150)).split()
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            rows.append((i, " ".join(words), 1))
        elif kind < 0.30:
            rows.append((i, rng.choice([None, "", "12 34", "### $$$"]), 0))
        elif kind < 0.40:
            rows.append((i, edited(rng, base, rng.randint(0, 4)), 0))
        elif kind < 0.50:
            rows.append((i, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}", 0))
        else:
            rows.append((i, prose(rng, rng.randint(10, 200)), 0))
    rows.append((400, rows[-1][1], 0))  # an exact copy
    rows.append((JUNK, "".join(rng.choice("qxzjkvwQXZ/+=9") for _ in range(300)), 0))
    return rows


def test_stages_in_order_and_their_results(spark, tmp_path):
    rows = corpus(random.Random(6))
    spark.createDataFrame([(i, t, None if i == JUNK else "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "line_dedup", "near_dedup", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # The classifier decides by its own scores; the other stages are followed exactly.
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    passed = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert all(i in passed for i, _, y in rows if not y) and sum(i in passed for i, _, y in rows if y) < 0.1 * sum(y for *_, y in rows)
    named = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, str(tmp_path)).collect()}
    assert {i for i, t, _ in rows if t and any(c.isalpha() for c in t) and i != JUNK} == named  # all clean ones, and not the junk
    kept = [(i, t) for i, t, _ in rows if i in passed and i in named]
    left = brute_inline([t for _, t in kept], 50)
    assert sum(t != old for t, (_, old) in zip(left, kept, strict=True)) > 20
    scrap = lambda t, old: not t.split() or (2 * len(t.encode()) < len(old.encode()) and len(t.split()) < corpus_pipeline.SCRAP_WORDS)
    kept = [(i, t) for (i, old), t in zip(kept, left, strict=True) if t == old or not scrap(t, old)]
    groups = brute_groups([i for i, _ in kept], [t for _, t in kept], 5, 80)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    want = set()
    for i, t in kept:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want.add((i, 0, 0, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(list((Path(str(spark.sparkContext.getCheckpointDir()).removeprefix("file:")).parent).rglob("pipeline-*/*-packing"))) >= 1 and not list(Path(str(spark.sparkContext.getCheckpointDir()).removeprefix("file:")).parent.rglob("pipeline-*/*-toxicity"))
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= packing.CAPACITY


def test_stages_take_odd_rows_and_no_rows(spark, tmp_path, odd_docs, no_docs):
    spark.createDataFrame([(4, 0, 1), (9, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
            docs = docs.cache()
            docs.count()


def test_scraps_of_copies_go_and_short_texts_stay(spark, tmp_path):
    rng = random.Random(3)
    passage = prose(rng, 300)
    rows = [(1, passage), (2, f"few own words {passage} at the end"), (3, f"{passage}\n{prose(rng, 60)}"), (4, "a short text"), (5, f"{prose(rng, 400)} {passage}"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7}  # of 2 six words are left
    assert len(got[3].split()) == 60 and len(got[5].split()) == 400 and got[1] == passage


def test_all_documents_stay_where_no_language_is_learned(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, None, None, "a", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.drop_unknown_language(spark, docs, str(tmp_path)).count() == 2


def test_near_duplicates_without_ids_and_with_repeated_ids(spark, tmp_path):
    rng = random.Random(1)
    one, other = prose(rng, 80), prose(rng, 80)
    rows = [(7, one), (None, one), (None, other), (None, other), (8, prose(rng, 60)), (9, "same row"), (9, "same row"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == sorted([(7, one), (0, other), (8, rows[4][1]), (9, "same row"), (0, "")])
