"""Word-level BPE over whole Arrow batches: distinct words are merged together in numpy.

``WordTokenizer`` gives the ids of the ``tokenizers`` library for a lower-casing word BPE file. White
space ends every pretoken of such a file, so a batch is cut at ASCII white space, each distinct chunk
is encoded once, and ids are gathered back. Chunks of plain Latin text are cut into letter runs,
single digits and symbol runs with byte tables and merged in numpy, words of equal length advancing
together; any other chunk (apostrophes, ``<``, other scripts, controls, very long words) goes to the
library itself. A file of another shape is left to the library altogether.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow import spans, strings, utf8

PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LONGEST = 64
NONE = np.int32(2**31 - 1)


class PairTable:
    """Merge ranks by pair of symbols, in an open-addressing table that numpy probes."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        size, slots = 1 << self.bits, (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        self.keys, self.ranks, self.probes = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32), 1
        left = np.arange(len(pairs))
        at = slots.astype(np.int64)
        for probe in range(1, size):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.ranks[at[put]] = pairs[left[put]], ranks[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at, self.probes = left[stay], (at[stay] + 1) & (size - 1), probe
            if not len(left):
                break

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out


def merge_all(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: PairTable, merged: np.ndarray, order_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """BPE of every word at once; returns ids one word after the other, and the words' id counts.

    Words of one width advance together: each takes its best merge, and moves to the next smaller
    width; words that have none are done. A pair's value in the table orders the merges, and is its
    place in ``merged``; where merges of different pairs are worth the same, ``order_of`` (with NONE as
    its last item) gives the order by place. The leftmost of equal ones comes first.
    """
    n = len(lengths)
    counts, done = np.zeros(n, np.int64), []
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(int(lengths.max(initial=0)) + 2))
    words, now, rank = np.zeros(0, np.int64), None, None
    for width in range(int(lengths.max(initial=0)), 0, -1):
        fresh = order[bounds[width] : bounds[width + 1]]
        if len(fresh):
            s = symbols[starts[fresh][:, None] + np.arange(width)]
            r = table.get(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(fresh), width - 1)
            words, now, rank = (np.concatenate([words, fresh]), np.concatenate([now, s]), np.concatenate([rank, r])) if len(words) else (fresh, s, r)
        if not len(words):
            continue
        if width == 1:
            counts[words] = 1
            done.append((words, now))
            break
        at = (rank if order_of is None else order_of[np.minimum(rank, len(order_of) - 1)]).argmin(1)
        best = rank[np.arange(len(words)), at]
        stop = best == NONE
        if stop.any():
            counts[words[stop]] = width
            done.append((words[stop], now[stop]))
            go = ~stop
            words, now, rank, at, best = words[go], now[go], rank[go], at[go], best[go]
        rows = np.arange(len(words))
        if not len(words):
            words, now, rank = np.zeros(0, np.int64), None, None
            continue
        now[rows, at] = merged[best]
        keep = np.ones(now.shape, bool)
        keep[rows, at + 1] = False
        now = now[keep].reshape(len(words), width - 1)
        keep = np.ones(rank.shape, bool)
        keep[rows, at] = False
        rank = rank[keep].reshape(len(words), width - 2)
        if width > 2:
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = table.get(now[has, at[has] - 1], now[has, at[has]])
            has = np.flatnonzero(at < width - 2)
            rank[has, at[has]] = table.get(now[has, at[has]], now[has, at[has] + 1])
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    for which, s in done:
        out[begin[which][:, None] + np.arange(s.shape[1])] = s
    return out, counts


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self._is_word_bpe(spec)
        if self.fast:
            self._tables(spec)

    @staticmethod
    def _is_word_bpe(spec: dict) -> bool:
        try:
            normal, pre, model = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"], spec["model"]
            return (
                [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
                and normal[1]["pattern"] == {"Regex": "\\s+"}
                and normal[1]["content"] == " "
                and [x["type"] for x in pre] == ["Split", "ByteLevel"]
                and pre[0]["pattern"] == {"Regex": PATTERN}
                and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
                and not pre[1]["add_prefix_space"]
                and model["type"] == "BPE"
                and model["end_of_word_suffix"] == "</w>"
                and not model["dropout"]
                and not model.get("ignore_merges")
                and all(x["content"].startswith("<|") for x in spec["added_tokens"])
            )
        except (KeyError, TypeError, IndexError):
            return False

    def _tables(self, spec: dict) -> None:
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in chars], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.uint64)
        self.table = PairTable(pairs, np.arange(len(pairs), dtype=np.int32))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        import unicodedata

        self.kind = np.zeros(0x240, np.uint8)  # 1 letter, 2 number, 0 anything else
        self.lower = np.arange(0x240, dtype=np.int32)
        for cp in range(0x240):
            self.kind[cp] = {"L": 1, "N": 2}.get(unicodedata.category(chr(cp))[0], 0)
            low = chr(cp).lower()
            if len(low) == 1 and ord(low) < 0x240:
                self.lower[cp] = ord(low)
            elif low != chr(cp):
                self.lower[cp] = -1
        self.plain = self.lower >= 0
        self.plain[0x00:0x21] = self.plain[0x7F:0xA1] = False
        self.plain[ord("'")] = self.plain[ord("<")] = False

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32, one text after the other) and id counts of the texts; null counts as empty."""
        column = column.fill_null("") if column.null_count else column
        if not self.fast:
            return self._library(column.to_pylist())
        cut = pc.ascii_split_whitespace(column)
        ends = np.asarray(cut.offsets).astype(np.int64)
        words = cut.flatten().dictionary_encode()
        ids, counts = self._distinct(words.dictionary)
        begin, codes = np.cumsum(counts) - counts, np.asarray(words.indices)
        per = counts[codes]
        total = np.concatenate([[0], np.cumsum(per)])
        ends = ends - ends[0]
        return ids[spans(begin[codes], per)], total[ends[1:]] - total[ends[:-1]]

    def count(self, column: pa.Array) -> np.ndarray:
        """Id counts of the texts, without gathering ids."""
        column = column.fill_null("") if column.null_count else column
        if not self.fast:
            return self._library(column.to_pylist())[1]
        cut = pc.ascii_split_whitespace(column)
        ends = np.asarray(cut.offsets).astype(np.int64)
        words = cut.flatten().dictionary_encode()
        total = np.concatenate([[0], np.cumsum(self._distinct(words.dictionary)[1][np.asarray(words.indices)])])
        ends = ends - ends[0]
        return total[ends[1:]] - total[ends[:-1]]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.int32), np.array([len(x) for x in ids], np.int64)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of distinct chunks, none of which holds ASCII white space."""
        n = len(chunks)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw, ends = utf8(chunks)
        owner = np.repeat(np.arange(n), np.diff(ends))
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        cp = raw[at].astype(np.int32)
        two = (cp >= 0xC2) & (cp <= 0xC8)
        cp[two] = ((cp[two] & 31) << 6) | (raw[at[two] + 1] & 63)
        odd = (~two & (cp >= 0x80)) | ~self.plain[np.minimum(cp, 0x23F)]
        hard = np.zeros(n, bool)
        hard[owner[at[odd]]] = True
        # pieces of the plain chunks: runs of letters, runs of symbols, single numbers
        use = ~hard[owner[at]]
        at, cp = at[use], cp[use]
        whose, kind, low = owner[at], self.kind[cp], self.lower[cp]
        first = np.ones(len(at), bool)
        first[1:] = (whose[1:] != whose[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        wide = low >= 0x80
        size = 1 + wide.astype(np.int64)
        where = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint8)
        out[where] = np.where(wide, 0xC0 | (low >> 6), low)
        out[where[wide] + 1] = 0x80 | (low[wide] & 63)
        heads = np.flatnonzero(first)
        cuts = np.append(where[heads], len(out))
        long = np.diff(cuts) > LONGEST
        if long.any():
            hard[whose[heads[long]]] = True
        pieces = strings(out, cuts).dictionary_encode()
        distinct, dist_ends = utf8(pieces.dictionary)
        lengths = np.diff(dist_ends)
        lengths_in = np.where(lengths > LONGEST, 0, lengths)
        symbols = self.inner[distinct]
        if len(distinct):
            symbols[dist_ends[1:] - 1] = self.final[distinct[dist_ends[1:] - 1]]
        ids, counts = merge_all(symbols, dist_ends[:-1], lengths_in, self.table, self.merged)
        begin, codes, by = np.cumsum(counts) - counts, np.asarray(pieces.indices), whose[heads]
        easy = ~hard[by]
        codes, by = codes[easy], by[easy]
        per = counts[codes]
        sums = np.bincount(by, weights=per, minlength=n).astype(np.int64)
        flat = ids[spans(begin[codes], per)]
        if hard.any():
            which = np.flatnonzero(hard)
            other, many = self._library(chunks.take(pa.array(which)).to_pylist())
            sums[which] = many
            whole = np.zeros(int(sums.sum()), np.int32)
            start = np.cumsum(sums) - sums
            is_easy = np.flatnonzero(~hard)
            whole[spans(start[is_easy], sums[is_easy])] = flat
            whole[spans(start[which], many)] = other
            flat = whole
        return flat, sums


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file and Python worker."""
    return WordTokenizer(path)
