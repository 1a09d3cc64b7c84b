import hashlib
import json
import zlib

import numpy as np

from creditloom.llm import audio


def test_whole_texts_come_back_from_the_stored_bytes(odd_docs):
    rows = audio.audio_features(audio.as_media(odd_docs)).collect()
    texts = sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert len(rows) == len(texts)
    for r, (i, text) in zip(sorted(rows, key=lambda r: (r.id or -1, r.n_bytes)), sorted(texts, key=lambda x: (x[0], len(x[1].encode()))), strict=True):
        raw = text.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])), i
        assert r.media_bytes == len(payload) + 44
        table = audio.read_tensor_stream(r.tensors)
        assert table.num_rows == r.blocks and table.column("tensor").type.shape == [audio.BLOCK, audio.MELS]
        assert all(a < b for a, b in zip(table.column("start_s").to_pylist(), table.column("end_s").to_pylist(), strict=True))


def test_no_rows_and_null_media(spark, no_docs):
    assert audio.audio_features(audio.as_media(no_docs)).count() == 0
    row = audio.audio_features(spark.createDataFrame([(1, None, None)], "id bigint, n_bytes bigint, media binary")).first()
    assert row.id == 1 and row.payload_sha256 is None
    for kind in ("smallint", "double", "date", "string"):
        row = audio.audio_features(audio.as_media(spark.createDataFrame([("7", "x")], "doc_id string, text string").selectExpr(f"cast('2020-01-01' as {kind}) as doc_id" if kind == "date" else f"cast(doc_id as {kind}) as doc_id", "text"))).first()
        assert row.n_bytes == 1 and row.id is not None


def test_resampling_equals_zero_stuffing():
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2), (1, 1), (5, 4)):
        h = audio.low_pass(up, down)
        full = np.zeros(len(x) * up, np.float32)
        full[::up] = x
        want = np.convolve(full, h)[len(h) // 2 :][::down][: -(-len(x) * up // down)]
        assert np.allclose(audio.resample(x, up, down), want, atol=1e-4), (up, down)


def test_log_mel_by_definition_and_segments():
    x = np.random.default_rng(1).normal(size=1000).astype(np.float32)
    mel = audio.log_mel(x)
    frame = x[2 * audio.HOP : 2 * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME)
    want = np.log(np.abs(np.fft.rfft(frame)) ** 2 @ audio.mel_bank(audio.TARGET_RATE, audio.FRAME, audio.MELS) + 1e-6)
    assert np.allclose(mel[2], want, atol=1e-3)
    assert audio.hysteresis(np.array([0, 2, 3, 2, 0, 2, 2, 0, 5.0]), 2, 3).tolist() == [[1, 4], [8, 9]]
    assert audio.hysteresis(np.zeros(3), 1, 2).tolist() == []


def test_the_query_digests_what_its_stream_holds(spark, tmp_path):
    text = "a tone of no length " * 900
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in audio.op1_audio_features(spark, str(tmp_path)).collect()}
    got = {i: json.loads(r.feature) for i, r in rows.items()}
    for i, x in ((1, text), (2, "")):
        opened = audio.read_tensor_stream(rows[i].tensors)
        assert opened.column("tensor").type.shape == [audio.BLOCK, audio.MELS] and [(s.start_s, s.end_s) for s in rows[i].spans] == list(zip(opened.column("start_s").to_pylist(), opened.column("end_s").to_pylist(), strict=True))
        tensor, spans, segments = audio.features(audio.wav(audio.payload(x.encode())))
        stream = audio.tensor_stream(tensor, spans, segments)
        assert all(np.array_equal(a, b) for a, b in zip(audio.stored(stream), (tensor, spans, segments), strict=True))
        assert got[i]["stream_bytes"] == len(stream) and got[i]["blocks"] == len(tensor) and got[i]["segments"] == len(segments)
        for name, part in (("tensor_sha256", tensor), ("spans_sha256", spans), ("segments_sha256", segments)):
            assert got[i][name] == hashlib.sha256(part.tobytes()).hexdigest()
    assert got[1]["spans_sha256"] != got[2]["spans_sha256"]
