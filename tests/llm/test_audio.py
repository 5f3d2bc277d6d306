import hashlib
import zlib

import numpy as np
import pytest
from sftloom.llm import audio


def test_resampling_equals_the_plain_sum():
    x = np.random.default_rng(1).normal(size=600)
    y = audio.resample(x)
    assert len(y) == 400
    taps, left = audio.phases(), audio.TAPS // 2 - 1
    for m in (0, 1, 7, 200, 399):
        g, p = divmod(m, 2)
        want = sum(taps[k, p] * x[3 * g + k - left] for k in range(audio.TAPS) if 0 <= 3 * g + k - left < len(x))
        assert y[m] == pytest.approx(want)
    tone = np.sin(2 * np.pi * 1000 * np.arange(24000) / audio.STORED)
    out = audio.resample(tone)
    assert np.abs(out[50:-50] - np.sin(2 * np.pi * 1000 * np.arange(len(out)) / audio.RATE)[50:-50]).max() < 0.03


def test_mel_and_segments():
    quiet, loud = 0.01 * np.ones(16000), np.sin(2 * np.pi * 2000 * np.arange(8000) / audio.RATE)
    signal = np.concatenate([quiet, loud, quiet])
    mel, energy = audio.log_mel(signal)
    assert mel.shape == (-(-(len(signal) - 256) // 256), audio.MELS)
    frame = np.zeros(512)
    frame[:] = signal[256 * 70 : 256 * 70 + 512]
    power = np.abs(np.fft.rfft(frame * audio.hann())) ** 2
    assert np.allclose(mel[70], np.log(power @ audio.mel_bank() + audio.FLOOR), atol=1e-4)
    (only,) = audio.hysteresis(energy)
    assert 60 <= only[0] <= 63 and 93 <= only[1] <= 95
    assert audio.hysteresis(np.array([0, 0, 0, 0, 1, 3, 1, 0, 1, 0, 0.0])) == [(4, 7)]


def test_tensors_read_back():
    mel = np.arange(70 * audio.MELS, dtype=np.float32).reshape(70, audio.MELS)
    got = audio.read_tensors(audio.write_tensors(mel))
    assert got.column("n_frames").to_pylist() == [32, 32, 6]
    assert got.column("mel").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)[:70].tolist() == mel.tolist()
    assert got.column("start_s").to_pylist()[1] == 32 * 256 / 16000
    assert audio.read_wav(audio.write_wav(b"abc"))[0] == b"abc"


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "1 as media")
    odd = spark.createDataFrame([(-1, None, 1), (-2, "", 1), (-3, "é" * 96, 1), (-3, "é" * 96, 1)], "doc_id long, text string, media int")
    all_ = docs.union(odd)
    texts = {r.doc_id: (r.text or "").encode() for r in all_.collect()}
    rows, same = audio.audio_digest(all_).collect(), {}
    assert len(rows) == docs.count() + 4
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(payload) + 44
        assert same.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    media = audio.audio_features(odd).collect()
    assert audio.read_wav(bytes(media[0].media)) == (b" " * 192, 24000)
    assert len({r.feature for r in rows}) == len(set(texts.values()) - {b""}) + 1 - (b" " * 192 in texts.values())
    assert audio.audio_digest(docs.limit(0)).count() == 0
