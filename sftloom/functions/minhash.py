"""MinHash signatures that are equal, bit for bit, to the integer arithmetic modulo 2^61 - 1."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1


def coefficients(perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) drawn in turn, a from 1 and b from 0."""
    rnd = random.Random(seed)
    drawn = [(rnd.randrange(1, PRIME - 1), rnd.randrange(0, PRIME - 1)) for _ in range(perm)]
    return np.array([a for a, _ in drawn], np.uint64), np.array([b for _, b in drawn], np.uint64)


def modulo(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def multiply(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """a * h modulo the prime, both below it, in halves of 30 and 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, h1, h0 = a >> half, a & low, h >> half, h & low
    middle = a1 * h0 + a0 * h1
    low30 = np.uint64((1 << 30) - 1)
    return modulo(modulo(a1 * h1 * np.uint64(2)) + modulo((middle >> np.uint64(30)) + ((middle & low30) << half)) + modulo(a0 * h0))


def token_hash(token: str, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{token}".encode()).digest()[:8], "big")


def signatures(texts: list[list[str]], perm: int, seed: int) -> list[np.ndarray]:
    """Signatures of token lists; each distinct token is hashed and permuted once."""
    a, b = coefficients(perm, seed)
    number: dict[str, int] = {}
    codes = [np.array([number.setdefault(t, len(number)) for t in set(tokens)], np.int64) for tokens in texts]
    hashes = modulo(np.array([token_hash(t, seed) for t in number], np.uint64))
    table = modulo(multiply(a[None, :], hashes[:, None]) + b[None, :]) if len(number) else None
    return [table[c].min(0).astype(np.int64) if len(c) else np.zeros(perm, np.int64) for c in codes]


def tokens(text: str | None, n: int = 3) -> list[str]:
    """Character n-grams of the stripped, lower-cased text; a shorter text is its own, an empty one has none."""
    t = (text or "").strip().lower()
    return [t[i : i + n] for i in range(len(t) - n + 1)] or ([t] if t else [])


def signature_rows(df: DataFrame, key: str, content: Column | str, perm: int = 128, n: int = 3, seed: int = 42, at_once: int = 256) -> DataFrame:
    """key and signature of each row; all zeros for an empty text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                rows = signatures([tokens(t, n) for t in part.column(1).to_pylist()], perm, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * perm), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], names=["_ord", "signature"])

    content = F.col(content) if isinstance(content, str) else content
    return df.select(F.col(key).cast("long").alias("_ord"), content.alias("content")).mapInArrow(step, "_ord long, signature array<long>")


def low_bytes(signatures: np.ndarray) -> np.ndarray:
    return signatures.astype(np.uint8)


def _equal_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes of each row of x equal those of each column of y."""
    out = np.zeros((len(x), y.shape[1]), np.min_scalar_type(x.shape[1]))
    equal = np.empty(out.shape, bool)
    for a, b in zip(np.ascontiguousarray(x.T), y):
        np.equal(a[:, None], b[None, :], out=equal)
        out += equal.view(np.uint8)
    return out


def most_agreeing(x: np.ndarray, y: np.ndarray, strip: int = 32) -> np.ndarray:
    """For each row of x and of y, how many of their bytes are equal; of low bytes, as many places as can be equal at most. ``strip`` rows of x at a time stay in the cache."""
    out, columns = np.empty((len(x), len(y)), np.min_scalar_type(x.shape[1])), np.ascontiguousarray(y.T)
    for k in range(0, len(x), strip):
        out[k : k + strip] = _equal_places(x[k : k + strip], columns)
    return out


def sharing(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, rows: int, count: int, at_once: int = 16384) -> np.ndarray:
    """Whether the pairs (p, q) are equal in one of ``count`` bands of ``rows`` places."""
    x, y = x[:, : rows * count], y[:, : rows * count]
    return np.concatenate([np.zeros(0, bool), *((x[p[k : k + at_once]] == y[q[k : k + at_once]]).reshape(-1, count, rows).all(2).any(1) for k in range(0, len(p), at_once))])


def agreement(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Equal places of the pairs (p, q) of signatures."""
    return np.concatenate([np.zeros(0, np.int64), *((x[p[k : k + at_once]] == y[q[k : k + at_once]]).sum(1) for k in range(0, len(p), at_once))])


def _marks(x: np.ndarray, rows: int, count: int) -> np.ndarray:
    """16 bits for each of ``count`` bands of ``rows`` places; bands that are equal have the same."""
    odd = np.random.default_rng(rows).integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
    return ((x[:, : rows * count].astype(np.uint64).reshape(-1, count, rows) * odd).sum(2, dtype=np.uint64) >> np.uint64(48)).astype(np.uint16)


def greatest(x: np.ndarray, y: np.ndarray, within: bool, most_x: np.ndarray, most_y: np.ndarray, rows: int | None, count: int, strip: int = 32) -> None:
    """Raises the greatest agreement so far of each row of x and of y by that of the pairs that share a band; of all pairs where ``rows`` is None. ``within``: y is x, and no row is paired with itself.

    All pairs are compared by their low bytes, ``strip`` rows of x at a time; those that may raise one of the two are looked at: first each row's best, then what is left.
    """
    small, columns = low_bytes(x), np.ascontiguousarray(low_bytes(y).T)
    marks = (_marks(x, rows, count), _marks(y, rows, count)) if rows else None

    def look(p: np.ndarray, q: np.ndarray, at_once: int = 4096) -> None:
        for k in range(0, len(p), at_once):
            i, j = p[k : k + at_once], q[k : k + at_once]
            if marks:
                good = (marks[0][i] == marks[1][j]).any(1)
                i, j = i[good], j[good]
            equal = x[i] == y[j]
            if marks:
                good = equal[:, : rows * count].reshape(-1, count, rows).all(2).any(1)
                i, j, equal = i[good], j[good], equal[good]
            same = equal.sum(1)
            np.maximum.at(most_x, i, same)
            np.maximum.at(most_y, j, same)

    if not len(x) or not len(y):
        return
    for at in range(0, len(x), strip):
        bound = _equal_places(small[at : at + strip], columns)
        own = np.arange(len(bound))
        if within:
            bound[own, at + own] = 0
        best = bound.argmax(1)
        more = bound[own, best] > most_x[at : at + strip]
        look(at + own[more], best[more])
        more = np.flatnonzero(bound.max(0) > most_y)
        look(at + bound[:, more].argmax(0), more)
        least = np.minimum(most_x[at : at + strip].astype(bound.dtype)[:, None], most_y.astype(bound.dtype)[None, :])
        p, q = np.divmod(np.flatnonzero((bound > least).ravel()), len(y))
        look(at + p, q)


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal places; 0 for signatures of different or no length."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)).otherwise(0.0)


def band_rows(perm: int, count: int) -> int:
    """Rows of each band; at least one."""
    return max(1, perm // count)


def band_count(perm: int, count: int) -> int:
    return min(count, perm // band_rows(perm, count))


def bands(signature: Column, count: int = 20, perm: int = 128) -> Column:
    """One hash for each band of perm // count places (one place at least)."""
    rows = band_rows(perm, count)
    return F.transform(F.sequence(F.lit(0), F.lit(band_count(perm, count) - 1)), lambda i: F.xxhash64(i, F.slice(signature, i * rows + 1, rows)))
