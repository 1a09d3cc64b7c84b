"""Audio columns: 8-bit WAV media, polyphase resampling, log-mel frames, hysteresis segments.

Features are Arrow fixed-shape tensors of BLOCK frames by MELS bands, each with its time span, kept in one binary
column per row as an Arrow stream, which also holds the segments. Digests, spans and segments in the result are those
read back from the stream. Rows go through the workers in parts of about a megabyte; a longer text is a part of its own,
of any length, and its frames are made 2,048 at a time. A null text is an empty one: its payload is 576 bytes of 255.
Null ids and ids of any type are carried. Empty tables give empty results; repeated rows give repeated, equal results;
other columns of the input are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import by_bytes

UNIT = 576
RATE, TARGET_RATE = 16_000, 8_000
FRAME, HOP, MELS, BLOCK = 256, 128, 32, 32


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    pad = b"\0" * (len(samples) % 2)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a file that wav() made; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def payload(text: bytes) -> bytes:
    """The text's bytes, then bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def low_pass(up: int, down: int, taps_per_phase: int = 16) -> np.ndarray:
    """A windowed-sinc filter for a change of rate by up / down."""
    n = taps_per_phase * max(up, down)
    t = np.arange(-n // 2, n // 2 + 1, dtype=np.float64)
    h = np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1]
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, h: np.ndarray | None = None) -> np.ndarray:
    """x at up / down times its rate. Output m takes phase (m * down) % up of the filter alone, so no zero is multiplied."""
    h = low_pass(up, down) if h is None else h
    half = len(h) // 2
    n = -(-len(x) * up // down)
    y = np.zeros(n, np.float32)
    edge = np.pad(x, (half // up + 2, half // up + 2 + down))
    lead = half // up + 2
    for first in range(min(up, n)):
        at = first * down + half
        taps = h[at % up :: up]
        out = y[first::up]
        base = at // up + lead
        for k, c in enumerate(taps):
            part = edge[base - k :: down][: len(out)]
            out[: len(part)] += c * part
    return y


def mel_bank(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, from frame // 2 + 1 frequencies to bands."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    freq = np.arange(frame // 2 + 1) * rate / frame
    up = (freq[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_BANK, _WINDOW, _FILTER = mel_bank(TARGET_RATE, FRAME, MELS), np.hanning(FRAME).astype(np.float32), low_pass(1, RATE // TARGET_RATE)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log energies of overlapped frames, frames by MELS; the end is filled with zeros to a whole frame."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, (frames - 1) * HOP + FRAME - len(x)))
    view, out = sliding_window_view(x, FRAME)[::HOP], np.empty((frames, MELS), np.float32)
    for at in range(0, frames, 2048):
        f = np.fft.rfft(view[at : at + 2048] * _WINDOW)
        out[at : at + 2048] = np.log((f.real**2 + f.imag**2) @ _BANK + np.float32(1e-6))
    return out


def hysteresis(energy: np.ndarray, low: float, high: float) -> np.ndarray:
    """Runs [from, to) of values of at least low that reach high."""
    on = np.concatenate(([0], (energy >= low).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(on)).reshape(-1, 2)
    reach = np.concatenate(([0], np.cumsum(energy >= high)))
    return edges[reach[edges[:, 1]] > reach[edges[:, 0]]]


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors (blocks, BLOCK, MELS), the blocks' spans in seconds, and the segments' spans in seconds."""
    rate, samples = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, TARGET_RATE // (g := np.gcd(TARGET_RATE, rate)), rate // g, _FILTER if rate == RATE else None))
    energy = mel.mean(1)
    middle, spread = energy.mean(), energy.std()
    step = HOP / TARGET_RATE
    segments = hysteresis(energy, middle, middle + spread / 2) * step
    blocks = -(-len(mel) // BLOCK)
    tensor = np.zeros((blocks, BLOCK, MELS), np.float32)
    tensor.reshape(-1, MELS)[: len(mel)] = mel
    first = np.arange(blocks) * BLOCK
    spans = np.stack([first * step, np.minimum(first + BLOCK, len(mel)) * step + (FRAME - HOP) / TARGET_RATE], 1)
    return tensor, spans, segments


def tensor_stream(tensor: np.ndarray, spans: np.ndarray, segments: np.ndarray | None = None) -> bytes:
    """An Arrow stream with the columns tensor (fixed shape), start_s and end_s; the segments' starts and ends go with its schema."""
    table = pa.table({"tensor": pa.FixedShapeTensorArray.from_numpy_ndarray(tensor), "start_s": spans[:, 0], "end_s": spans[:, 1]})
    if segments is not None:
        table = table.replace_schema_metadata({"segments": segments.astype("<f8").tobytes()})
    with io.BytesIO() as out:
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return out.getvalue()


def read_tensor_stream(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def stored(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors, spans and segments of a stream, as features() returns them."""
    table = read_tensor_stream(stream)
    tensor = np.concatenate([x.to_numpy_ndarray() for x in table.column("tensor").chunks])
    spans = np.stack([table.column(c).to_numpy() for c in ("start_s", "end_s")], 1)
    return tensor, spans, np.frombuffer((table.schema.metadata or {}).get(b"segments", b""), "<f8").reshape(-1, 2)


def _sha256(x: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(x).tobytes()).hexdigest()


def _rows(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): every whole text as the samples of a WAV file, and its own length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            texts = _rows(batch.column(1))
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([wav(payload(x)) for x in texts], pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


_SPAN = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_FEATURES = pa.schema([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("blocks", pa.int32()), ("tensors", pa.binary()),
    ("stream_bytes", pa.int64()), ("tensor_sha256", pa.string()), ("spans_sha256", pa.string()), ("segments_sha256", pa.string()), ("level", pa.float64()), ("spans", _SPAN), ("segments", _SPAN),
])
_FEATURES_SQL = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, blocks int, tensors binary, stream_bytes bigint, tensor_sha256 string, spans_sha256 string, "
    "segments_sha256 string, level double, spans array<struct<start_s:double,end_s:double>>, segments array<struct<start_s:double,end_s:double>>"
)


def _described(media: bytes | None, keep_tensors: bool) -> dict:
    if media is None:
        return {}
    samples = read_wav(media)[1]
    stream = tensor_stream(*features(media))
    tensor, spans, segments = stored(stream)
    pairs = lambda x: [{"start_s": float(a), "end_s": float(b)} for a, b in x]
    return {
        "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "blocks": len(tensor), "tensors": stream if keep_tensors else None, "stream_bytes": len(stream), "tensor_sha256": _sha256(tensor), "spans_sha256": _sha256(spans), "segments_sha256": _sha256(segments),
        "level": float(np.round(tensor.mean(), 3)), "spans": pairs(spans), "segments": pairs(segments),
    }


def audio_features(media: DataFrame, keep_tensors: bool = True) -> DataFrame:
    """Rows (id, n_bytes, samples' digests, tensors as an Arrow stream with its blocks' spans, segments) of media rows (id, n_bytes, media).

    The samples are read back from the media column. A null media value gives null features. With keep_tensors off
    the stream is left out after it was read back, and its length, digests, spans and segments stay.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            found = pa.Table.from_pylist([_described(m, keep_tensors) for m in batch.column(2).to_pylist()], schema=_FEATURES).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(c.combine_chunks() for c in found.columns)], ["id", "n_bytes", *_FEATURES.names])

    rows = media.select("id", "n_bytes", "media")
    return rows.mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, {_FEATURES_SQL}")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests, each row's tensor stream, and the blocks' and segments' spans as they were read back from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = audio_features(as_media(docs))
    feature = F.to_json(F.struct("blocks", "level", F.size("segments").alias("segments"), F.round(F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"]), 3).alias("active_s"), "stream_bytes", "tensor_sha256", "spans_sha256", "segments_sha256"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "tensors", "spans", "segments")
