"""SentencePiece encoding and decoding in numpy, over whole Arrow batches.

Texts are cut before each run of spaces, which no piece but runs of spaces crosses; each distinct word
is encoded once, and words of equal length advance together. How depends on the model's kind:

* unigram models: Viterbi. At each position the hashes of all substrings that end there are probed
  among the sorted piece keys, and the vectorised maximum of score sums keeps a backpointer;
* BPE models: the merges themselves, again for all words of a length at once. A BPE model's scores are
  ranks of merges, whose sums mean nothing: Viterbi over them gives other ids than the model has.

Characters that no piece has become byte pieces, or the unknown piece where the model has none. Words of
more than ``LONGEST`` characters are left to the library. Models with a normalisation table are
refused, since their texts would not be what is encoded.

Cases: null counts as empty; an empty text has no ids; U+2581 in a text reads back as a space, as
in the library.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import Batches, data_path, run, sliced, spans, strings, utf8
from .fasttok import LONGEST, PairTable, merge_all

MARK = "▁"
UNIGRAM, BPE = 1, 2
SLICE = 6 << 20  # bytes of text that are encoded at once
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BASE = np.uint64(0x100000001B3)
ENCODED = "doc_id long, text string, ids array<int>"
DIGEST = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol buffer's fields."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.types, trainer, normal = [], [], [], {}, {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.kind, self.fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models that keep white space, mark it at word starts and have no normalisation table can be read")
        if self.kind not in (UNIGRAM, BPE) or any(t in (DEFINED, UNUSED) for t in self.types):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces can be read")
        self.size = len(self.pieces)
        self.unknown = self.types.index(UNKNOWN)
        self.normal = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == BYTE:
                self.bytes[int(p[3:-1], 16)] = i
        self._char_table()
        self._bpe_table() if self.kind == BPE else self._key_table()
        self._decode_table()

    def _char_table(self) -> None:
        known = sorted((ord(p), i) for p, i in self.normal.items() if len(p) == 1)
        self.chars, self.char_ids = np.array([c for c, _ in known], np.int64), np.array([i for _, i in known], np.int32)

    def _symbols(self, cps: np.ndarray) -> np.ndarray:
        """A piece's id for each character; characters without one count on from the vocabulary's end."""
        at = np.minimum(np.searchsorted(self.chars, cps), len(self.chars) - 1)
        return np.where(self.chars[at] == cps, self.char_ids[at], self.size + cps).astype(np.int32)

    def _bpe_table(self) -> None:
        def symbol(s: str) -> int | None:
            return self.normal.get(s, self.size + ord(s) if len(s) == 1 else None)

        found = []
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                a, b = symbol(piece[:cut]), symbol(piece[cut:])
                if a is not None and b is not None:
                    found.append((-self.scores[i], i, (a << 32) | b))
        found.sort()
        worth = np.array([f[0] for f in found])
        self.merged = np.array([f[1] for f in found], np.int32)
        self.order = np.append(np.unique(worth, return_inverse=True)[1], 2**31 - 1).astype(np.int32)
        self.table = PairTable(np.array([f[2] for f in found], np.uint64), np.arange(len(found), dtype=np.int32))

    def _key_table(self) -> None:
        """Sorted hashes of the pieces, their ids and scores."""
        with np.errstate(over="ignore"):
            keys = {}
            for piece, i in self.normal.items():
                h = np.uint64(0)
                for c in piece:
                    h = h * BASE + np.uint64(ord(c) + 1)
                keys[int(h)] = i
        if len(keys) != len(self.normal):
            raise ValueError("piece hashes collide")
        order = sorted(keys)
        self.keys, self.key_ids = np.array(order, np.uint64), np.array([keys[k] for k in order], np.int32)
        self.key_scores = np.array(self.scores)[self.key_ids]
        self.widest = max(map(len, self.normal))
        self.unknown_score = min(self.scores[i] for i in self.normal.values()) - 10.0

    def _decode_table(self) -> None:
        out = []
        for p, t in zip(self.pieces, self.types):
            out.append(bytes([int(p[3:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        self.out_lengths = np.array([len(x) for x in out], np.int64)
        self.out_starts = np.cumsum(self.out_lengths) - self.out_lengths
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of words of one length (a matrix of code points): ids and counts, unknown characters as beyond the vocabulary."""
        n, width = words.shape
        prefix, power = np.zeros((n, width + 1), np.uint64), np.ones(width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for e in range(width):
                prefix[:, e + 1] = prefix[:, e] * BASE + (words[:, e] + 1).astype(np.uint64)
                power[e + 1] = power[e] * BASE
        best, back, piece = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int32)
        best[:, 0] = 0
        for e in range(1, width + 1):
            for k in range(1, min(e, self.widest) + 1):
                with np.errstate(over="ignore"):
                    h = prefix[:, e] - prefix[:, e - k] * power[k]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                score, ids = np.where(hit, self.key_scores[at], -np.inf), self.key_ids[at]
                if k == 1:
                    score, ids = np.where(hit, score, self.unknown_score), np.where(hit, ids, self.size + words[:, e - 1])
                total = best[:, e - k] + score
                # of equal sums the longer piece stays, which the library meets first
                better = total >= best[:, e]
                best[:, e] = np.where(better, total, best[:, e])
                back[:, e], piece[:, e] = np.where(better, k, back[:, e]), np.where(better, ids, piece[:, e])
        cursor, rows, trail = np.full(n, width), np.arange(n), []
        while (cursor > 0).any():
            live = cursor > 0
            trail.append(np.where(live, piece[rows, cursor], -1))
            cursor = np.where(live, cursor - back[rows, cursor], 0)
        steps = np.stack(trail[::-1], 1)
        return steps[steps >= 0].astype(np.int32), (steps >= 0).sum(1)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct words, in which a space stands for the mark."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw, ends = utf8(words)
        cps = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
        lengths = np.diff(heads)
        cps[cps == 32] = ord(MARK)
        long = lengths > LONGEST
        if self.kind == BPE:
            ids, counts = merge_all(self._symbols(cps), heads[:-1], np.where(long, 0, lengths), self.table, self.merged, self.order)
        else:
            counts, parts = np.zeros(n, np.int64), []
            for width in np.unique(lengths[~long]):
                which = np.flatnonzero((lengths == width) & ~long)
                got, many = self.viterbi(cps[heads[which][:, None] + np.arange(width)])
                counts[which] = many
                parts.append((which, got, many))
            ids, begin = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
            for which, got, many in parts:
                ids[spans(begin[which], many)] = got
        if not self.fallback and self.kind == UNIGRAM:  # the library joins neighbouring unknown characters
            owner, odd = np.repeat(np.arange(n), counts), ids >= self.size
            same = np.zeros(len(ids), bool)
            same[1:] = odd[1:] & odd[:-1] & (owner[1:] == owner[:-1])
            ids, counts = ids[~same], np.bincount(owner[~same], minlength=n)
        odd = ids >= self.size
        if odd.any():
            if not self.fallback:
                ids = np.where(odd, self.unknown, ids)
            else:
                utf = [chr(c).encode() for c in ids[odd] - self.size]
                size = np.ones(len(ids), np.int64)
                size[odd] = [len(u) for u in utf]
                where = np.cumsum(size) - size
                wide = np.zeros(int(size.sum()), np.int32)
                wide[where[~odd]] = ids[~odd]
                wide[spans(where[odd], size[odd])] = self.bytes[np.frombuffer(b"".join(utf), np.uint8)]
                counts = np.bincount(np.repeat(np.arange(n), counts), weights=size, minlength=n).astype(np.int64)
                ids = wide
        if long.any():
            which = np.flatnonzero(long)
            other = [self.library.encode("\n" + w.replace(" ", MARK))[2:] if not w.startswith(" ") else self.library.encode(w[1:]) for w in words.take(pa.array(which)).to_pylist()]
            keep, begin = counts, np.cumsum(counts) - counts
            counts = keep.copy()
            counts[which] = [len(o) for o in other]
            whole, start = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
            short = np.flatnonzero(~long)
            whole[spans(start[short], counts[short])] = ids[spans(begin[short], keep[short])]
            whole[spans(start[which], counts[which])] = [i for o in other for i in o]
            ids = whole
        return ids, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one text after the other, and id counts of the texts."""
        import pyarrow.compute as pc

        column = column.fill_null("") if column.null_count else column
        raw, ends = utf8(pc.replace_substring(column, MARK, " "))
        some = np.diff(ends) > 0
        raw = np.insert(raw, ends[:-1][some], 32)
        ends = ends + np.concatenate([[0], np.cumsum(some)])
        space = raw == 32
        start = np.zeros(len(raw), bool)
        start[ends[:-1][some]] = True
        start[1:] |= space[1:] & ~space[:-1]
        heads = np.flatnonzero(start)
        words = strings(raw, np.append(heads, len(raw))).dictionary_encode()
        ids, counts = self._distinct(words.dictionary)
        begin, codes = np.cumsum(counts) - counts, np.asarray(words.indices)
        per = counts[codes]
        total = np.concatenate([[0], np.cumsum(per)])
        return ids[spans(begin[codes], per)], np.diff(total[np.searchsorted(heads, ends)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids."""
        size = self.out_lengths[ids]
        raw = self.out_bytes[spans(self.out_starts[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        first = ends[:-1][counts > 0]
        first = first[raw[first] == 32] if len(raw) else first  # the mark that encoding put first
        gone = np.zeros(len(raw) + 1, np.int64)
        gone[first + 1] = 1
        return strings(np.delete(raw, first), ends - np.cumsum(gone)[ends])


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_batches(path: str):
    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").fill_null("")
            ids, counts = piece_model(path).encode(text)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, lists], names=["doc_id", "text", "ids"])

    return step


def digest_batches(path: str):
    """Decode the ids and describe them and the text that they give."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, text = batch.column("ids"), batch.column("text")
            ids, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets).astype(np.int64)
            back = piece_model(path).decode(ids, np.diff(ends))
            raw, at = utf8(back)
            mem, flat = memoryview(np.ascontiguousarray(raw)), memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(utf8(text)[1]), pa.int64()),
                pa.array(np.diff(ends), pa.int64()),
                pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                pa.array([hashlib.sha256(mem[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]),
                pa.compute.equal(back.cast(text.type), text),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return step


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text and ids of every document."""
    return run(docs.select("doc_id", "text"), ENCODED, sliced(SLICE), encode_batches(path or data_path("piece_bpe_32k.model")))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every document; what came out, described."""
    path = path or data_path("piece_bpe_32k.model")
    return run(docs.select("doc_id", "text"), DIGEST, sliced(SLICE), encode_batches(path), digest_batches(path))
