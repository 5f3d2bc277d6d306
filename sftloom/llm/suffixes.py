"""Longest matches of every position of a corpus in the other texts, by sorting all suffixes.

The texts lie one after the other in a file of the folder that the executors share, a byte 255 after each (it does
not occur in UTF-8). Positions are shuffled by the hash of their first ``PREFIX`` bytes, a share of the buckets in each
of ``ROUNDS`` rounds, and each bucket's suffixes are sorted. The longest match of a suffix in another text is with the nearest
suffix of another text above or below it; its length is written at the position's place in a second file. Matches
shorter than ``PREFIX`` come from the grams of 1 to PREFIX - 1 bytes that two texts or more have.

Work grows with the bytes, and with the length of matches that tie (near copies), 64 or 256 bytes at a time. Files that all
executors can map are needed; suffixes that share their first ``PREFIX`` bytes are sorted in one task.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Batches, run, shared_dir, sliced, utf8
from .jaccard import mix

PREFIX, BUCKET, ROUNDS, SLICE = 6, 1_000_000, 8, 8 << 20
END, PAD = 255, 512
WIDE, FEW = 32, 400_000  # words of 8 bytes that are compared at once where few suffixes still tie
MOST = 65535  # longer matches are in a sparse file of their own


def common(x: np.ndarray) -> np.ndarray:
    """Leading bytes of 0."""
    return sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8))


def elsewhere(text: np.ndarray, pos: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Length of the longest match of each suffix in another text; ``left`` is what is left of its own."""
    m, where = len(pos), np.arange(len(pos))
    if not m:
        return np.zeros(0, np.int64)
    key = np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))[pos].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    pos, doc, left, where, key = pos[order], doc[order], left[order], where[order], key[order]
    lcp = np.zeros(m + 1, np.int64)  # of each suffix with the one before
    lcp[1:m] = common(key[1:] ^ key[:-1])
    at, depth = np.arange(m), np.full(m, 8)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    while len(at):
        # groups of one text, and those that are equal to their ends, need no order
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(at)))
        whose = doc[at]
        live = (np.minimum.reduceat(whose, start) != np.maximum.reduceat(whose, start)) & (depth[start] <= left[at[start]])
        keep = np.repeat(live, size)
        at, depth, first = at[keep], depth[keep], first[keep]
        if not len(at):
            break
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(at)))
        wide = WIDE if len(at) <= FEW else 8
        rows = np.ndarray((len(text) - 8 * wide + 1, wide), ">u8", buffer=text, strides=(1, 8))[pos[at] + depth]
        unlike = rows != rows[np.repeat(start, size)]
        column = np.minimum.reduceat(np.where(unlike.any(1), unlike.argmax(1), wide), start)
        column = np.repeat(column, size)
        depth = depth + 8 * column
        lcp[at[~first]] = depth[~first]
        part = np.flatnonzero(column < wide)  # the other groups are equal so far
        if not len(part):
            continue
        key, heads, place = rows[part, column[part]].astype(np.uint64), first[part], at[part]
        order = np.lexsort((key, np.cumsum(heads)))
        move, key = place[order], key[order]
        pos[place], doc[place], left[place], where[place] = pos[move], doc[move], left[move], where[move]
        new = heads.copy()
        new[1:] |= key[1:] != key[:-1]
        inner = np.flatnonzero(new & ~heads)
        lcp[place[inner]] = depth[part[inner]] + common(key[inner] ^ key[inner - 1])
        depth[part] += 8
        lcp[place[~new]] = depth[part[~new]]
        first[part] = new
    change = np.concatenate([[True], doc[1:] != doc[:-1]])
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, m))
    up, down = lcp[:m].copy(), lcp[1:].copy()
    ends = start + size - 1
    by = np.argsort(-size, kind="stable")
    start, size, ends = start[by], size[by], ends[by]
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))
        a, b = start[:n] + t, ends[:n] - t
        up[a] = np.minimum(up[a], up[a - 1])
        down[b] = np.minimum(down[b], down[b + 1])
    out = np.empty(m, np.int64)
    out[where] = np.minimum(np.maximum(up, down), left)
    return out


class Corpus:
    """Paths and sizes; workers map the files."""

    def __init__(self, folder: str, size: int, docs: int, buckets: int):
        self.folder, self.size, self.docs, self.buckets, self.most = folder, size, docs, buckets, MOST

    def text(self) -> np.ndarray:
        with open(f"{self.folder}/text", "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ), np.uint8)

    def array(self, name: str, kind: str, mode: str = "r") -> np.ndarray:
        return np.memmap(f"{self.folder}/{name}", kind, mode)

    def slices(self, spark, most: int = SLICE) -> DataFrame:
        n = -(-self.size // most)
        return spark.range(0, n, 1, n)


def part_batches(folder: str):
    """Write a partition's texts, sizes and ids."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        name, size, docs = f"{folder}/{uuid.uuid4().hex}", 0, 0
        with open(name, "wb") as text, open(f"{name}.docs", "wb") as about:
            for batch in batches:
                raw, ends = utf8(batch.column("text"))
                n = len(ends) - 1
                out = np.full(len(raw) + n, END, np.uint8)
                out[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(ends))] = raw
                ids = batch.column("doc_id")
                text.write(out.tobytes())
                about.write(np.stack([np.diff(ends) + 1, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()).astype(np.int64)], 1).tobytes())
                size, docs = size + len(out), docs + n
        yield pa.RecordBatch.from_pydict({"name": [name], "size": [size], "docs": [docs]})

    return step


def copy_batches(folder: str):
    """Copy parts to their places."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist()):
                with open(name, "rb") as part, open(f"{folder}/text", "r+b") as whole:
                    whole.seek(at)
                    while block := part.read(8 << 20):
                        whole.write(block)
            yield batch

    return step


def gram_batches(corpus: Corpus):
    """Grams of 1 to PREFIX - 1 bytes, with the first and last text of the slice that has each."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        text, starts = corpus.text(), corpus.array("starts", "<i8")
        for batch in batches:
            for i in batch.column("id").to_pylist():
                for lo in range(i * SLICE, min((i + 1) * SLICE, corpus.size), 1 << 20):
                    hi = min(lo + (1 << 20), (i + 1) * SLICE, corpus.size)
                    code = np.ndarray((hi - lo,), ">u8", buffer=text, offset=lo, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * (PREFIX - 1))
                    a, b = np.searchsorted(starts, [lo, hi - 1], side="right") - 1
                    cut = np.concatenate([[lo], starts[a + 1 : b + 1], [hi]])
                    own = np.repeat(np.arange(a, b + 1), np.diff(cut))
                    packed = (code << np.uint64(24)) | (own - a).astype(np.uint64)
                    packed.sort()
                    code, own = packed >> np.uint64(24), (packed & np.uint64((1 << 24) - 1)).astype(np.int64) + a
                    least = most = own
                    for length in range(PREFIX - 1, 0, -1):
                        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                        code, least, most = code[start], np.minimum.reduceat(least, start), np.maximum.reduceat(most, start)
                        good = np.ones(len(code), bool)
                        for k in range(length):
                            good &= (code >> np.uint64(8 * k)) & np.uint64(255) != END
                        yield pa.RecordBatch.from_arrays([pa.array((code[good] | np.uint64(length << 40)).astype(np.int64)), pa.array(least[good]), pa.array(most[good])], names=["gram", "least", "most"])
                        code = code >> np.uint64(8)

    return step


def bucket_batches(corpus: Corpus, turn: int):
    """Positions by bucket, of the buckets whose turn it is."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        text = corpus.text()
        for batch in batches:
            for i in batch.column("id").to_pylist():
                found, whose = [], []
                for lo in range(i * SLICE, min((i + 1) * SLICE, corpus.size), 1 << 20):
                    hi = min(lo + (1 << 20), (i + 1) * SLICE, corpus.size)
                    key = np.ndarray((hi - lo,), ">u8", buffer=text, offset=lo, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * PREFIX)
                    bucket = (mix(key, 31) % np.uint64(corpus.buckets)).astype(np.int32)
                    good = bucket % ROUNDS == turn
                    past = np.flatnonzero(text[lo : hi + PREFIX] == END)
                    for k in range(PREFIX):
                        good[past[(past >= k) & (past - k < hi - lo)] - k] = False
                    at = np.flatnonzero(good)
                    found.append((at + lo - i * SLICE).astype(np.uint32))
                    whose.append(bucket[at])
                found, whose = np.concatenate(found), np.concatenate(whose)
                order = np.argsort(whose, kind="stable")
                found, whose = found[order], whose[order]
                start = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])) if len(whose) else np.zeros(0, np.int64)
                ends = np.append(start, len(whose)) * 4
                # steps from place to place, one byte plane after the other, take less when compressed
                found[1:] -= np.where(np.diff(whose) == 0, found[:-1], np.uint32(0))
                found = b"".join(found[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(ends[:-1] // 4, ends[1:] // 4))
                blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([pa.array(whose[start] // ROUNDS, pa.int32()), pa.array(np.full(len(start), i * SLICE)), blobs], names=["bucket", "base", "at"])

    return step


def match_batches(corpus: Corpus):
    """Write the lengths of a bucket's matches; buckets do not share prefixes, so those of a partition may be sorted together."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        starts, pos = corpus.array("starts", "<i8"), []
        for batch in batches:
            for base, at in zip(batch.column("base").to_pylist(), batch.column("at")):
                steps = np.ascontiguousarray(np.frombuffer(at.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
                pos.append(np.cumsum(steps, dtype=np.int64) + base)
        if not pos:
            return
        pos = np.sort(np.concatenate(pos))
        doc = np.searchsorted(starts, pos, side="right") - 1
        size = elsewhere(corpus.text(), pos, doc, starts[doc + 1] - 1 - pos)
        corpus.array("match", "<u2", "r+")[pos] = np.minimum(size, corpus.most)
        far = size >= corpus.most
        if far.any():
            corpus.array("far", "<i8", "r+")[pos[far]] = size[far]
        yield pa.RecordBatch.from_pydict({"n": [len(pos)]})

    return step


def build(docs: DataFrame) -> Corpus:
    """Write texts and the lengths of all matches."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/suffixes-{uuid.uuid4().hex}"
    os.makedirs(folder)
    parts = run(docs.select("doc_id", "text"), "name string, size long, docs long", sliced(1 << 20), part_batches(folder)).collect()
    size, count = sum(p["size"] for p in parts), sum(p["docs"] for p in parts)
    about = np.concatenate([np.fromfile(f"{p['name']}.docs", "<i8").reshape(-1, 3) for p in parts]) if parts else np.zeros((0, 3), np.int64)
    np.concatenate([[0], np.cumsum(about[:, 0])]).astype("<i8").tofile(f"{folder}/starts")
    about[:, 1:].astype("<i8").tofile(f"{folder}/ids")
    buckets = ROUNDS * max(1, -(-size // (BUCKET * ROUNDS)))
    corpus = Corpus(folder, size, count, buckets)
    if not size:
        return corpus
    with open(f"{folder}/text", "wb") as f:
        f.seek(size)
        f.write(bytes([END]) * PAD)
    for name, width in (("match", 2), ("far", 8)):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(size * width)
    places = np.concatenate([[0], np.cumsum([p["size"] for p in parts])]).tolist()
    rows = [(p["name"], at) for p, at in zip(parts, places) if p["size"]]
    run(spark.createDataFrame(rows, "name string, at long").repartition(min(len(rows), 64)), "name string, at long", copy_batches(folder)).count()
    for p in parts:
        os.remove(p["name"])
        os.remove(f"{p['name']}.docs")
    grams = run(corpus.slices(spark), "gram long, least long, most long", gram_batches(corpus))
    grams = grams.groupBy("gram").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("gram").toArrow()
    np.sort(grams.column("gram").to_numpy()).astype("<i8").tofile(f"{folder}/grams")
    spark.sparkContext._jvm.System.gc()  # lets go of shuffle files
    for turn in range(ROUNDS):
        placed = run(corpus.slices(spark), "bucket int, base long, at binary", bucket_batches(corpus, turn))
        run(placed.repartitionById(buckets // ROUNDS, F.col("bucket")), "n long", match_batches(corpus)).agg(F.sum("n")).collect()
        spark.sparkContext._jvm.System.gc()
    return corpus


def lengths(corpus: Corpus, text: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Longest match in another text of each position between lo and hi."""
    size = corpus.array("match", "<u2")[lo:hi].astype(np.int64)
    far = np.flatnonzero(size == corpus.most)
    if len(far):
        size[far] = corpus.array("far", "<i8")[lo:hi][far]
    grams = np.fromfile(f"{corpus.folder}/grams", "<i8")
    rest = np.flatnonzero(size < PREFIX)
    size[rest] = 0
    if len(grams) and len(rest):
        code = np.ndarray((hi - lo,), ">u8", buffer=text, offset=lo, strides=(1,))[rest].astype(np.uint64)
        for length in range(1, PREFIX):  # a gram that two texts have has no END
            one = ((code >> np.uint64(64 - 8 * length)) | np.uint64(length << 40)).astype(np.int64)
            hit = grams[np.minimum(np.searchsorted(grams, one), len(grams) - 1)] == one
            size[rest[hit]] = length
    return size
