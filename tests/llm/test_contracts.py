"""Each opN_ query on a small table: its columns' names, order and types, and its values against the contract."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from creditloom.llm import audio, packing, queries, urlrules

from .conftest import odd_texts, prose
from .test_classifiers import text as language_text
from .test_divergence import by_hand as by_hand_divergence
from .test_neardup import brute as brute_groups
from .test_spelling import by_hand as by_hand_spelling
from .test_topk import brute as brute_top
from .test_urlrules import ODD as ODD_URLS
from .test_urlrules import by_hand as by_hand_url

Q = queries.queries()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def name_of(n):
    return next(k for k in Q if k.startswith(f"op{n}_"))


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, rows): odd texts, some of three languages, a third of them toxic, and vectors."""
    rng = random.Random(12)
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(odd_texts())]
    for i in range(100, 400):
        lang = rng.choice(["en", "de", "fr"])
        words = language_text(rng, lang, rng.randint(5, 60)).split()
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "moron", "worthless"]))
        rows.append((i, " ".join(words), lang))
    near = prose(rng, 120)
    rows += [(400, near, "en"), (401, near.replace(" ", "  ", 3), "en"), (402, near + " more", "en")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, f"src{i % 4}", len(t or "")) for i, t, lang in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100, 400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(120)] + [(120, None), (150, [math.nan] * 8), (200, [0.5] * 8)]
    spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(ODD_URLS)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows, vectors


def run(spark, tables, n, schema):
    """The query's rows; its first columns have these names and types, in this order."""
    df = Q[name_of(n)](spark, tables[0])
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][: len(schema)] == schema, df.schema.simpleString()
    return df.collect()


def test_op1(spark, tables):
    rows = run(spark, tables, 1, [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")])
    assert len(rows) == len(tables[1])
    texts = {i: t or "" for i, t, _ in tables[1]}
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        media = audio.wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and json.loads(r.feature)["stream_bytes"] == len(r.tensors)
    assert len({(texts[r.doc_id], r.feature) for r in rows}) == len(set(texts.values()))


def test_op2(spark, tables):
    rows = run(spark, tables, 2, [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")])
    texts = {i: t or "" for i, t, _ in tables[1]}
    assert sorted(r.doc_id for r in rows) == sorted(texts) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    assert all(0 <= r.shard <= 15 for r in rows) and len({(texts[r.doc_id], r.shard) for r in rows}) == len(set(texts.values()))
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_op3(spark, tables):
    rows = run(spark, tables, 3, [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")])
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in tables[2] if v and not any(map(math.isnan, v))]
    assert sorted(map(tuple, rows)) == sorted(brute_top(vectors, [i for i, _ in vectors if i % 50 == 0], 5))


def test_op4(spark, tables):
    rows = run(spark, tables, 4, [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")])
    tokenizer, want = Tokenizer.from_file(packing.word_tokenizer()), set()
    for i, t, _ in tables[1]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.add((i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= math.ceil(sum(fill.values()) / 4096) + 1


def test_op5(spark, tables):
    rows = run(spark, tables, 5, [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")])
    want = brute_groups([i for i, *_ in tables[1]], [t for _, t, _ in tables[1]], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op6(spark, tables):
    rows = run(spark, tables, 6, [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    texts = {i: (t, lang) for i, t, lang in tables[1]}
    assert len(rows) == len(texts) and all(r.held_out == (crc_mod(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[r.doc_id][0] or "")) and r.lang_pred in ("und", "en", "de", "fr") for r in rows)
    held = [r for r in rows if r.held_out and 100 <= r.doc_id < 400]
    assert sum(r.lang_pred == texts[r.doc_id][1] for r in held) > 0.95 * len(held)


def test_op7(spark, tables):
    rows = run(spark, tables, 7, [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    assert len(rows) == len(tables[1]) and all(r.held_out == (crc_mod(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, int(r.doc_id % 3 == 0)) for r in rows if r.held_out and 100 <= r.doc_id < 400]
    hits = Counter(held)
    assert hits[1, 1] > 0.8 * (hits[1, 1] + hits[0, 1]) and hits[1, 0] < 0.05 * (hits[1, 0] + hits[0, 0])


def test_op8(spark, tables):
    rows = run(spark, tables, 8, [("doc_id", "bigint"), ("lines", "int"), ("dropped_lines", "int"), ("n_bytes", "bigint"), ("text_crc32", "bigint")])
    texts = {i: t for i, t, _ in tables[1]}
    by = {r.doc_id: r for r in rows}
    assert sorted(by) == sorted(texts) and by[0].n_bytes is None and by[10].n_bytes == 0 and by[13].text_crc32 == zlib.crc32(b"other\nlast\n")
    assert all(r.text_crc32 == zlib.crc32(texts[i].encode()) for i, r in by.items() if 100 <= i < 400)


def test_op9(spark, tables):
    rows = run(spark, tables, 9, [("doc_id", "bigint"), ("n_pieces", "bigint"), ("ids_crc32", "bigint"), ("decoded_crc32", "bigint"), ("round_trip", "boolean")])
    texts = {i: t or "" for i, t, _ in tables[1]}
    assert len(rows) == len(texts) and all(r.round_trip and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_op10(spark, tables):
    rows = run(spark, tables, 10, [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")])
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t, _ in tables[1]}
    counts = Counter(w for i, ws in tokens.items() if crc_mod(i, 10) != 0 for w in ws)
    n, v = counts.total(), len(counts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc_mod(r.doc_id, 10) == 0, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) and r.score < 0
    assert len(rows) == len(tokens)


def test_op11(spark, tables):
    rows = run(spark, tables, 11, [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")])
    want = {i: (i, *by_hand_url(u, urlrules.RULES)) for i, u in enumerate(ODD_URLS)}
    assert {r.page_id: tuple(r)[:5] for r in rows} == want and len(rows) == len(want)


def test_op12(spark, tables):
    rows = run(spark, tables, 12, [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")])
    assert sorted(tuple(r)[:6] for r in rows) == by_hand_divergence([(lang, f"src{i % 4}", t) for i, t, lang in tables[1]], 10)


def test_op13(spark, tables):
    rows = run(spark, tables, 13, [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")])
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in rows) == by_hand_spelling([(i, t) for i, t, _ in tables[1]])


def test_every_operator_has_one_query():
    assert [name_of(n) for n in range(1, 14)] == list(Q) and set(queries.oracle_sql()) <= set(Q)
