"""Quality rules: base counts of whole texts, and a calibrated hashed n-gram logistic regression.

The regression averages the weights of a text's hashed n-grams (words and pairs of words, three and
four characters) for each kind; it is fitted on a bounded sample of labelled rows (``rows``), and its
scores are turned into probabilities on a fifth of the sample that it was not fitted on. Rows are
scored in Arrow batches against fixed thresholds.

Base counts are exact: words are ``[^\\x20\\x09-\\x0D]+``; three-word windows are compared by the words'
numbers in the batch, packed into 63 bits, or by those of the first pair and the third word where a slice has more than
2^21 different words; never by hashes.

Cases: a null or empty text has no words, counts of 0, and fails the base rules; equal texts have
equal results; an empty table gives no rows; other columns are ignored; without labels of both kinds
the regression gives everything the smoothed rate of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import Batches, filtered, pieces, run, spans, strings, utf8
from .training import labelled_texts, platt, sigmoid

BITS = 17
LEAST_WORDS, MOST_REPEATED, LEAST_PROBABILITY = 50, 50, 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values; what lies beside a text doesn't matter, not even by rounding."""
    kind, some = np.float64 if values.dtype.kind == "f" else np.int64, np.diff(ends) > 0
    out = np.zeros(len(some), kind)
    if some.any():
        out[some] = np.add.reduceat(values, ends[:-1][some], dtype=kind)
    return out


def word_starts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the words' places by text."""
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][np.diff(ends) > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, ends)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    raw, ends = utf8(column)
    n = len(ends) - 1
    start, stop, by = word_starts(raw, ends)
    inside = ~SPACE[raw]
    out = {
        "n_words": np.diff(by),
        "word_chars": sums(inside & ((raw & 0xC0) != 0x80), ends),
        "n_symbols": sums(SYMBOL[raw], ends),
    }
    doc = np.repeat(np.arange(n), np.diff(by))
    sized = stop - start
    words = strings(raw[spans(start, sized)], np.concatenate([[0], np.cumsum(sized)])).dictionary_encode()
    code = np.asarray(words.indices).astype(np.uint64)
    out["n_repeat_words"] = repeats(code, doc, n)
    # lines with a word that equal an earlier line of their text
    cut = np.flatnonzero(raw == 10)
    # a line starts at its text's first byte or after a newline, and a newline that ends a text starts an empty line of it
    starts = np.concatenate([ends[:-1], cut + 1])
    whose = np.concatenate([np.arange(n), np.searchsorted(ends, cut, side="right") - 1])
    order = np.lexsort((starts, whose))
    starts, whose = starts[order], whose[order]
    finish = np.append(starts[1:] - 1, len(raw))
    final = np.ones(len(starts), bool)
    final[:-1] = whose[1:] != whose[:-1]
    finish[final] = ends[whose[final] + 1]
    many = np.concatenate([[0], np.cumsum(inside)])
    worded = many[finish] > many[starts]
    starts, finish, whose = starts[worded], finish[worded], whose[worded]
    sized = finish - starts
    lines = np.asarray(strings(raw[spans(starts, sized)], np.concatenate([[0], np.cumsum(sized)])).dictionary_encode().indices).astype(np.int64)
    order = np.lexsort((lines, whose))
    same = np.zeros(len(order), bool)
    same[1:] = (lines[order][1:] == lines[order][:-1]) & (whose[order][1:] == whose[order][:-1])
    out["n_dup_lines"] = np.bincount(whose[order][same], minlength=n)
    return out


def repeats(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more in it."""
    if len(code) < 3:
        return np.zeros(n, np.int64)
    kinds = int(code.max()) + 1
    if kinds <= 1 << 21:
        key = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    else:  # pairs of words are numbered first
        pair = np.unique(code[:-1] * np.uint64(kinds) + code[1:], return_inverse=True)[1].astype(np.uint64)
        key = pair[:-1] * np.uint64(kinds) + code[2:]
    at = np.flatnonzero(doc[2:] == doc[:-2])
    at = at[np.argsort(key[at], kind="stable")]
    again = np.zeros(len(at), bool)
    again[1:] = (key[at[1:]] == key[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    twice = again.copy()
    twice[:-1] |= again[1:]
    hit, at = np.zeros(len(code), bool), at[twice]
    for k in range(3):
        hit[at + k] = True
    return np.bincount(doc[hit], minlength=n)


def ngrams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams by kind: slots, one text after the other, and the texts' bounds in them."""
    raw, ends = utf8(column)
    n, shift = len(ends) - 1, np.uint32(32 - BITS)
    out = []
    start, stop, by = word_starts(raw, ends)
    if len(start):
        place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))])
        mixed = np.where(SPACE[raw], np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63])
        word = np.add.reduceat(mixed, start) * np.uint64(0x9E3779B97F4A7C15)
    else:
        word = np.zeros(0, np.uint64)
    out.append(((word >> np.uint64(64 - BITS)).astype(np.int64), by))
    pair = (word[:-1] * np.uint64(3) + word[1:]) * np.uint64(0xD6E8FEB86659FD93)
    doc = np.repeat(np.arange(n), np.diff(by))
    within = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    out.append(((pair[within] >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(np.diff(by) - 1, 0))])))
    cps = np.frombuffer(raw.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
    edges = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
    for width, seed in ((3, 0x85EBCA6B), (4, 0xC2B2AE35)):
        mixed = np.zeros(max(0, len(cps) - width + 1), np.uint32)
        for k in range(width):
            mixed = (mixed ^ (cps[k : len(cps) - width + 1 + k])) * np.uint32(0x01000193 + 2 * k)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(seed)
        many = np.maximum(np.diff(edges) - width + 1, 0)
        out.append(((mixed[spans(edges[:-1], many)] >> shift).astype(np.int64), np.concatenate([[0], np.cumsum(many)])))
    return out


KINDS = 4


class NgramModel:
    """Weights by kind and slot, bias, and calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def raw(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.bias)
        for kind, (slots, bounds) in enumerate(ngrams(column)):
            z += sums(self.weights[kind][slots], bounds) / np.maximum(np.diff(bounds), 1)
        return z

    def probability(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.raw(column) + self.shift)


def fit(column: pa.Array, y: np.ndarray, steps: int = 60, rate: float = 3.0, decay: float = 1e-6) -> NgramModel:
    """Full-batch Adam on the weighted logistic loss of four fifths, calibrated on the rest."""
    zero = np.zeros((KINDS, 1 << BITS), np.float32)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2:
        return NgramModel(zero, prior)
    parts = []
    for slots, bounds in (x for x in ngrams(column)):
        row = np.repeat(np.arange(len(y)), np.diff(bounds))
        key, count = np.unique(row * (1 << BITS) + slots, return_counts=True)
        row, slot = key >> BITS, key & ((1 << BITS) - 1)
        parts.append((row.astype(np.int32), slot.astype(np.int32), (count / np.maximum(np.diff(bounds), 1)[row]).astype(np.float32)))
    balance = np.where(y > 0, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (~held).sum() - y[~held].sum())) * ~held
    w, bias = zero.astype(np.float64), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.full(len(y), bias)
        for kind, (row, slot, value) in enumerate(parts):
            z += np.bincount(row, weights=value * w[kind][slot], minlength=len(y))
        g = (sigmoid(z) - y) * balance
        bias -= 2.0 * g.sum()
        for kind, (row, slot, value) in enumerate(parts):
            grad = np.bincount(slot, weights=value * g[row], minlength=1 << BITS) + decay * w[kind]
            m[kind] = 0.9 * m[kind] + 0.1 * grad
            v[kind] = 0.99 * v[kind] + 0.01 * grad * grad
            w[kind] -= rate * (m[kind] / (1 - 0.9**t)) / (np.sqrt(v[kind] / (1 - 0.99**t)) + 1e-4)
    model = NgramModel(w.astype(np.float32), bias)
    z = model.raw(column)
    use = held if len(set(y[held])) == 2 else ~held
    model.slope, model.shift = platt(z[use], y[use])
    return model


def rule_batches(shared, least_words: int, most_repeated: int, least_probability: float):
    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, text, at = batch.column("doc_id"), batch.column("text").fill_null(""), 0
            for part in pieces(text):
                c = base_counts(part)
                p = model.probability(part)
                failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
                longs = [pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *longs, pa.array(failed), pa.array(p), pa.array(~failed & (p >= least_probability))], names=[x.split()[0] for x in SCHEMA.split(", ")])
                at += len(part)

    return step


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = 1000) -> NgramModel:
    return fit(*labelled_texts(docs, labels, "quality", rows))


def apply_rules(docs: DataFrame, model: NgramModel, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """Base counts, probability and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return run(docs.select("doc_id", "text"), SCHEMA, rule_batches(shared, least_words, most_repeated, least_probability))


def keep_documents(docs: DataFrame, model: NgramModel, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """The documents, with all their columns, that pass the base rules and the regression."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(text: pa.Array) -> np.ndarray:
        c = base_counts(text)
        failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
        return ~failed & (shared.value.probability(text) >= least_probability)

    return filtered(docs, good)
