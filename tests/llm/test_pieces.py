import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from creditloom.llm import bytesops, pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model())


def test_ids_equal_the_librarys_and_come_back(library):
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "  a  b ", "é́ ﬁ Ⅷ", "你好 　x", "<s> </s> <unk>", "\x00\x01 \x00", "𝕏😀", "x" * 5000, "ab" * 3000 + " c", " " * 100]
    texts += ["".join(rng.choice("abcdeéüaA.,'| \n\tsS<>İ12  _-ththeerin你😀") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    encoder = pieces.Encoder(pieces.piece_model())
    for part in (texts, texts[::-1]):
        ids, at = encoder.encode(*bytesops.flat(pa.array(part)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(part)
        assert encoder.decode(ids, at) == [t.encode() for t in part]


def test_suffix_array_and_occurrences():
    text = b"banana bandana banana "
    data = np.frombuffer(text, np.uint8)
    order = pieces.suffix_array(pieces._eights(data), 64)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    p = pieces.Pieces(pieces.piece_model())
    where, which = p.edges(data)
    spelled = [p.spelling[i] for i in p.ids]
    assert sorted(zip(where.tolist(), which.tolist(), strict=True)) == sorted((i, k) for k, s in enumerate(spelled) for i in range(len(text)) if text.startswith(s, i))


def test_odd_rows(odd_docs, no_docs, library):
    encoded = pieces.encode_pieces(odd_docs, pieces.piece_model())
    rows = encoded.collect()
    docs = odd_docs.collect()
    assert sorted(r.ids for r in rows) == sorted(library.encode([d.text or "" for d in docs])) and all(r.round_trip for r in rows)
    back = pieces.decode_pieces(encoded, pieces.piece_model()).collect()
    assert sorted(r.text for r in back) == sorted(d.text or "" for d in docs)
    assert pieces.encode_pieces(no_docs, pieces.piece_model()).count() == 0


def test_round_trip_is_of_the_text_as_it_was_given(spark, library):
    texts = ["plain text", "a▁b", "▁", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.id: r for r in pieces.encode_pieces(df, pieces.piece_model()).collect()}
    assert [rows[i].round_trip for i in range(4)] == [True, False, False, True]
    assert all(rows[i].ids == library.encode(t or "") for i, t in enumerate(texts))


def test_only_byte_pair_models_are_taken(tmp_path):
    with open(pieces.piece_model(), "rb") as file:
        model = file.read()
    assert pieces.model_kind(model) == 2
    # The same message with the trainer's kind set to unigram, or left out.
    other = bytes([0x0A, 0x03, 0x0A, 0x01, 0x61, 0x12, 0x02, 0x18, 0x01])
    assert pieces.model_kind(other) == 1 and pieces.model_kind(other[:5]) == 1
    (tmp_path / "unigram.model").write_bytes(other)
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.Pieces(str(tmp_path / "unigram.model"))
