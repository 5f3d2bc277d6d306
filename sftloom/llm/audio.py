"""Audio columns: lossless media bytes, and log-mel features as fixed-shape Arrow tensors with time spans.

A payload is stored as the samples of an 8-bit mono WAV file. Features are computed from the bytes read
back:

* polyphase resampling from ``STORED`` to ``RATE`` Hz (by 2 / 3: two phases of a windowed sinc, taken
  at every third sample, so that nothing is computed that is then dropped);
* log-mel energies of overlapping windows (``WINDOW`` samples, half of them new each time);
* segments by hysteresis: runs of frames above the low threshold that reach the high one, both relative to
  the recording's median energy;
* tensors of ``FRAMES`` x ``MELS`` values, the last one padded with zeros, each with its span in seconds and its
  number of frames, as one Arrow stream with the canonical fixed-shape tensor type.

Cases: a null or empty text is a payload of 192 spaces; payloads are always a positive multiple of
``UNIT`` bytes; equal payloads give equal bytes and features, for each recording is computed by itself; an empty table gives no rows;
other columns are ignored. Long recordings are filtered and framed in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import Batches, run, sliced, utf8

STORED, RATE, UNIT = 24000, 16000, 192
UP, DOWN, TAPS = 2, 3, 16
WINDOW, HOP, MELS, FRAMES = 512, 256, 32, 32
FLOOR, LOW_DB, HIGH_DB = 1e-6, 0.5, 2.0
PIECE = 1 << 14
SCHEMA = "doc_id long, n_bytes long, media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def write_wav(payload: bytes, rate: int = STORED) -> bytes:
    """8-bit mono PCM; an odd payload gets RIFF's pad byte, which its length leaves out."""
    pad = b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def read_wav(media: bytes) -> tuple[bytes, int]:
    """Payload and rate, by walking the file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def phases() -> np.ndarray:
    """The filter's taps for each of the two outputs that three samples give."""
    out = np.zeros((TAPS, UP))
    for p in range(UP):
        t = np.arange(TAPS) - (TAPS // 2 - 1) - p * DOWN / UP  # distance of each tap from the output's place
        out[:, p] = np.sinc(t * UP / DOWN) * UP / DOWN * np.cos(np.pi * t / (TAPS + 2)) ** 2
    return out / out.sum(0)


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    mel = np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    at = np.fft.rfftfreq(WINDOW, 1 / RATE)[:, None]
    return np.maximum(0, np.minimum((at - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - at) / (edge[2:] - edge[1:-1])))


def resample(samples: np.ndarray) -> np.ndarray:
    """Two samples for every three, in pieces that see their neighbours."""
    groups = len(samples) // DOWN
    left = TAPS // 2 - 1
    padded = np.concatenate([np.zeros(left), samples, np.zeros(TAPS)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[::DOWN][:groups]
    return np.concatenate([windows[i : i + PIECE] @ phases() for i in range(0, groups, PIECE)]).ravel()


@lru_cache(maxsize=1)
def hann() -> np.ndarray:
    return np.hanning(WINDOW + 1)[:-1]


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and energy in decibels of every frame; the last frame is filled with silence."""
    frames = max(1, -(-(len(signal) - (WINDOW - HOP)) // HOP))
    padded = np.zeros(WINDOW - HOP + frames * HOP)
    padded[: len(signal)] = signal
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    mel, energy = [], []
    for i in range(0, frames, 1024):
        spectrum = np.fft.rfft(views[i : i + 1024] * hann(), axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel.append(np.log(power @ mel_bank() + FLOOR))
        energy.append(10 * np.log10(power.sum(1) / WINDOW + FLOOR))
    return np.concatenate(mel).astype(np.float32), np.concatenate(energy)


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """First and last-plus-one frame of each segment."""
    base = np.median(energy)
    low, high = energy > base + LOW_DB, energy > base + HIGH_DB
    edge = np.flatnonzero(np.diff(np.concatenate([[False], low, [False]])))
    reached = np.concatenate([[0], np.cumsum(high)])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if reached[b] > reached[a]]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32()), ("mel", TENSOR)])


def write_tensors(mel: np.ndarray) -> bytes:
    count = -(-len(mel) // FRAMES)
    filled = np.zeros((count * FRAMES, MELS), np.float32)
    filled[: len(mel)] = mel
    first = np.arange(count) * FRAMES
    many = np.minimum(len(mel) - first, FRAMES)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), FRAMES * MELS)
    columns = [pa.array(first * HOP / RATE), pa.array(((first + many - 1) * HOP + WINDOW) / RATE), pa.array(many, pa.int32()), pa.ExtensionArray.from_storage(TENSOR, flat)]
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, TENSORS) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=TENSORS))
    return sink.getvalue()


def read_tensors(stored: bytes) -> pa.Table:
    """start_s, end_s, n_frames and the tensors themselves."""
    return pa.ipc.open_stream(stored).read_all()


def features(media: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """Tensors and segments of one recording, from its stored bytes."""
    payload, _ = read_wav(media)
    samples = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mel, energy = log_mel(resample(samples))
    return write_tensors(mel), [(a * HOP / RATE, ((b - 1) * HOP + WINDOW) / RATE) for a, b in hysteresis(energy)]


def audio_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, ends = utf8(batch.column("text"))
        media, tensors, segments = [], [], []
        for a, b in zip(ends[:-1], ends[1:]):
            payload = raw[a:b].tobytes()
            stored = write_wav(payload + b" " * (-len(payload) % UNIT if payload else UNIT))
            t, s = features(stored)
            media.append(stored)
            tensors.append(t)
            segments.append([{"start_s": x, "end_s": y} for x, y in s])
        kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(media, pa.binary()), pa.array(tensors, pa.binary()), pa.array(segments, kind)], names=["doc_id", "n_bytes", "media", "tensors", "segments"])


def digest_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """What the stored bytes give when they are read back."""
    for batch in batches:
        rows = []
        spans = batch.column("segments")
        for media, tensors, k in zip(batch.column("media"), batch.column("tensors"), np.diff(np.asarray(spans.offsets))):
            media, tensors = media.as_py(), tensors.as_py()
            payload, _ = read_wav(media)
            feature = f"{len(tensors)}:{k}:{hashlib.sha256(tensors).hexdigest()[:32]}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=[x.split()[0] for x in DIGEST.split(", ")])


def audio_features(docs: DataFrame) -> DataFrame:
    """Media bytes, tensors and segments of every document."""
    return run(docs.select("doc_id", "text"), SCHEMA, sliced(4 << 20), audio_batches)


def audio_digest(docs: DataFrame) -> DataFrame:
    return run(docs.select("doc_id", "text"), DIGEST, sliced(4 << 20), audio_batches, digest_batches)
