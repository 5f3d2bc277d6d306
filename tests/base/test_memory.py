"""Python holds one slice of a batch at a time, not the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sftloom.functions import windows
from sftloom.operators import chunking, dedup


def test_chunks_of_a_batch_by_slices():
    texts = ["\n\n".join(f"{i} {k} " + "word " * 60 for k in range(20)) for i in range(2000)] + [None, ""]
    batch = pa.array(texts)
    tracemalloc.start()
    got = chunking.chunk_arrays(batch, chunking.Chunking())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 3
    assert got.to_pylist() == [chunking.chunk(t, chunking.Chunking()) for t in texts]


def test_similar_vectors_of_two_blocks_by_strips():
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(4096, 16))
    v[1::2] = v[::2] + rnd.normal(scale=0.01, size=(2048, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    sims = v @ v.T
    threshold = float(np.sort(sims[np.triu_indices(4096, 1)])[-1500])  # a pair's own similarity: single precision alone would miss it
    tracemalloc.start()
    p, q, s = dedup.cosine(threshold)(v, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    i, j = np.nonzero(sims >= threshold - 1e-12)
    assert (p == i).all() and (q == j).all() and np.abs(s - sims[i, j]).max() < 1e-12
    assert peak < sims.nbytes / 4


def test_measures_of_a_batch_hold_one_slice():
    rnd = np.random.default_rng(5)
    words = np.array(["".join(w) for w in rnd.choice(list("abcdefgh"), (3000, 5))])
    texts = pa.array([" ".join(rnd.choice(words, 700)) for _ in range(2000)])

    def peak(of, batch):
        tracemalloc.start()
        of(batch)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    for of in (lambda t: windows.repetition(t, 5), lambda t: windows.diversity(t, 3, "char"), windows.longest_runs):
        small, large = peak(of, texts.slice(0, 300)), peak(of, texts)
        assert large < 1.2 * small
