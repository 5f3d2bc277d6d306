"""Repetition measures of texts in one numpy pass over Arrow batches.

Words and code points are numbered in slices of ``SLICE`` bytes, and a window's number is made of the numbers of the
window one shorter and of its last item, so windows are compared exactly. A text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 512 << 10


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of at most ``SLICE`` bytes, or one text; only one part is copied at a time."""
    size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        yield texts.slice(at, to - at).cast(pa.large_string()).fill_null("")
        at = to
    pa.default_memory_pool().release_unused()


def by_slice(texts: pa.Array, of: Callable[[pa.Array], np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([of(part) for part in slices(texts)] or [np.zeros(0)]))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and each one's text."""
    joined = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    length = np.asarray(pc.utf8_length(texts), np.int64)
    return np.frombuffer(joined, np.uint32), np.repeat(np.arange(len(texts)), length)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words between white space, and each one's text."""
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split), np.int64))
    codes = np.asarray(words.indices, np.int64)
    empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    return (codes[codes != empty], owner[codes != empty]) if empty >= 0 else (codes, owner)


def window_counts(codes: np.ndarray, owner: np.ndarray, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of n neighbours in each text, and how many different ones."""
    if len(codes) < n:
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    window, width = codes.astype(np.uint64), n
    if n == 3 and codes.max(initial=0) < 1 << 21:
        window = (window[:-2] << np.uint64(42)) | (window[1:-1] << np.uint64(21)) | window[2:]
    else:
        for k in range(1, n):
            window = np.unique(window, return_inverse=True)[1].astype(np.uint64)[: len(codes) - k]
            window = (window << np.uint64(32)) | codes[k:].astype(np.uint64)
    within = owner[: len(window)] == owner[width - 1 :]
    window, whose = np.unique(window[within], return_inverse=True)[1], owner[: len(within)][within]
    both = np.sort((whose.astype(np.uint64) << np.uint64(32)) | window.astype(np.uint64))
    first = np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]
    return np.bincount(whose, minlength=texts), np.bincount((both[first] >> np.uint64(32)).astype(np.int64), minlength=texts)


def repetition(texts: pa.Array, n: int) -> pa.Array:
    """Share of word windows that occurred before in the text; 0 where there are none."""

    def of(part: pa.Array) -> np.ndarray:
        total, kinds = window_counts(*word_codes(part), n, len(part))
        return (total - kinds) / np.maximum(total, 1)

    return by_slice(texts, of)


def diversity(texts: pa.Array, n: int, unit: str) -> pa.Array:
    """Different windows by all windows; 1 where there are none."""

    def of(part: pa.Array) -> np.ndarray:
        total, kinds = window_counts(*(code_points(part) if unit == "char" else word_codes(part)), n, len(part))
        return np.where(total > 0, kinds / np.maximum(total, 1), 1.0)

    return by_slice(texts, of)


def longest_runs(texts: pa.Array) -> pa.Array:
    """Length of the longest run of one character."""

    def of(part: pa.Array) -> np.ndarray:
        points, owner = code_points(part)
        out = np.zeros(len(part), np.int32)
        if len(points):
            start = np.flatnonzero(np.concatenate([[True], (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])]))
            np.maximum.at(out, owner[start], np.diff(np.append(start, len(points))).astype(np.int32))
        return out

    return by_slice(texts, of).cast(pa.int32())
