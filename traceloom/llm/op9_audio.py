"""Media columns: payloads as 8-bit mono WAVE, and log-mel features of the samples read back.

Stored form: a RIFF/WAVE file of unsigned 8-bit PCM, one byte a sample, so any payload is kept whole. It is
written to the shared folder and read back. Features, at the stored rate: a polyphase filter resamples by
UP / DOWN; frames of FRAME samples, HOP apart, the last one filled with zeros, are windowed and transformed; MELS
triangular filters give log energies. Frames are grouped in tensors of fixed shape (TENSOR_FRAMES, MELS), the last
one filled with the floor value, each with its time span. Segments: a frame louder than the clip's mean by HIGH
opens one, one quieter than the mean by LOW closes it (hysteresis). What is stored of a clip is an Arrow stream
with a fixed-shape tensor column, the spans and the segments that begin in them.

Everything is computed for a clip by itself, so equal payloads give equal bytes and features, in whatever order
they come. Null is an empty payload; very long texts are one clip; repeated rows give a row each; a table without
rows gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import common

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 32  # TAPS: of each phase
FRAME, HOP, MELS, TENSOR_FRAMES = 256, 128, 24, 64
HIGH, LOW, FLOOR = 0.5, 0.1, -12.0
BLOCK = 64


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def to_wave(data: bytes) -> bytes:
    """data has an even length, as the format pads odd chunks."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(data))
    return head + data


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


@functools.cache
def _phases(up: int = UP, down: int = DOWN) -> np.ndarray:
    """(up, TAPS): phase r has the taps r, r + up, ... of a low-pass filter at the rate of up times the input's."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n) * cut * up
    return h.astype(np.float32).reshape(TAPS, up).T


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """By up / down. Output k stands at k * down of the finer rate, with the filter's middle on it: with
    k * down + middle = q * up + r, it is the dot product of phase r with the inputs q, q - 1, ..."""
    phases, middle = _phases(up, down), TAPS * up // 2
    k = np.arange(-(-len(x) * up // down))
    q, r = np.divmod(k * down + middle, up)
    padded = np.concatenate([np.zeros(TAPS, np.float32), x, np.zeros(TAPS, np.float32)])
    at = np.lib.stride_tricks.sliding_window_view(padded, TAPS)  # row q + 1 ends with input q
    out = np.empty(len(k), np.float32)
    for p in range(min(up, len(k))):  # outputs p, p + up, ... are of one phase, and their inputs down apart
        out[p::up] = at[q[p] + 1 :: down][: len(out[p::up])] @ phases[r[p], ::-1]
    return out


@functools.cache
def _filters() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS), rounded to a hundredth."""
    whole = FRAME + -(-max(0, len(y) - FRAME) // HOP) * HOP
    y = np.concatenate([y, np.zeros(whole - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    window, filters = np.hanning(FRAME).astype(np.float32), _filters()
    for i in range(0, len(frames), 512):
        power = np.abs(np.fft.rfft(frames[i : i + 512] * window)) ** 2
        out[i : i + 512] = np.log(np.maximum(power.astype(np.float32) @ filters, np.exp(FLOOR)))
    return np.round(out, 2)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Runs of loud frames, as first and past-the-last frame."""
    energy = mel.mean(1)
    state = np.where(energy > energy.mean() + HIGH, 1, np.where(energy < energy.mean() - LOW, -1, 0))
    known = np.flatnonzero(state)
    filled = np.zeros(len(state), bool)
    if len(known):
        last = np.searchsorted(known, np.arange(len(state)), "right") - 1
        filled = (last >= 0) & (state[known[np.maximum(last, 0)]] > 0)
    edge = np.flatnonzero(np.diff(np.r_[0, filled.astype(int), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def clip_features(samples: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors (n, TENSOR_FRAMES, MELS), their spans in seconds (n, 2), segments in seconds (m, 2)."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) / 128 - 1
    mel = log_mel(resample(x))
    step = HOP * DOWN / UP / RATE
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    spans = np.array([(i * TENSOR_FRAMES * step, min(len(mel), (i + 1) * TENSOR_FRAMES) * step) for i in range(n)])
    return full.reshape(n, TENSOR_FRAMES, MELS), spans, np.array(segments(mel), float).reshape(-1, 2) * step


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored form."""
    common.ship(docs.sparkSession)

    def store(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                made = [payload(t.as_py()) for t in b.column(1)[at : at + 500]]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 500], pa.array([n for n, _ in made], pa.int64()), pa.array([to_wave(d) for _, d in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))


_SEGMENTS = pa.list_(pa.list_(pa.float64()))


def _encoded(samples: bytes) -> bytes:
    """An Arrow stream: part, start_s, end_s, log_mel (a fixed-shape tensor), and segments that begin in the part."""
    tensors, spans, found = clip_features(samples)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), TENSOR_FRAMES * MELS)
    length = TENSOR_FRAMES * HOP * DOWN / UP / RATE
    of = np.minimum((found[:, 0] / length + 1e-9).astype(int), len(tensors) - 1)
    begin = [found[of == i].tolist() for i in range(len(tensors))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(tensors)), pa.int32()), pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.ExtensionArray.from_storage(TENSOR, flat), pa.array(begin, _SEGMENTS)], ["part", "start_s", "end_s", "log_mel", "segments"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors_of(stream: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(stream)))


_CLIP = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tensors", pa.binary())]


def features(stored: DataFrame) -> DataFrame:
    """Of media(), read back: a row a clip with digests of its payload and its stored form, and its tensors."""
    common.ship(stored.sparkSession)

    def over(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = []
                for k, n, m in zip(*(c[at : at + 200] for c in b.columns)):
                    raw = m.as_py()
                    samples = from_wave(raw)
                    rows.append((k.as_py(), n.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), _encoded(samples)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _CLIP)], [n for n, _ in _CLIP])

    return stored.mapInArrow(over, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary")


def unpacked(clips: DataFrame) -> DataFrame:
    """Of features(): a row for each tensor, with log_mel as plain floats, row by row."""
    common.ship(clips.sparkSession)

    def over(batches):
        for b in batches:
            for k, raw in zip(b.column(0), b.column(1)):
                t = tensors_of(raw.as_py())
                storage = t.column("log_mel").storage.cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(t), pa.int64()), *t.columns[:3], storage, t.column("segments")], ["doc_id", "part", "start_s", "end_s", "log_mel", "segments"])

    return clips.select("doc_id", "tensors").mapInArrow(over, "doc_id long, part int, start_s double, end_s double, log_mel array<float>, segments array<array<double>>")


def digests(clips: DataFrame) -> DataFrame:
    """What op9 returns, of features(), read back. feature: number of tensors and of segments, CRC-32 of the tensors'
    bytes, their mean."""
    common.ship(clips.sparkSession)

    def over(batches):
        for b in batches:
            out = []
            for raw in b.column(b.num_columns - 1):
                t = tensors_of(raw.as_py())
                values = t.column("log_mel").storage.values.to_numpy()
                n = sum(map(len, t.column("segments").to_pylist()))
                out.append(f"{len(t)}:{n}:{zlib.crc32(values.tobytes()):08x}:{float(values.astype(np.float64).mean()):.2f}")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], [*b.schema.names[:-1], "feature"])

    return clips.mapInArrow(over, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.written(media(common.table(spark, sf_dir, "documents")), "media", "zstd")
    return digests(common.written(features(stored), "tensors", "zstd"))
