"""Hierarchical multi-length packing of tokenised documents.

``pack_batches`` works within a partition, as a stream: nothing is shuffled, and what waits for
company is bounded (``WAITING`` ids and one slice), whatever the input.

1. A document's ids and its end id are cut into full windows of the longest tier while they last;
   what remains is routed to the shortest tier that holds it.
2. Each tier, longest first, opens a window for its longest waiting piece and fills the gap with the
   longest pieces of the same or shorter tiers that fit, and at last with the head of a piece that is
   cut there; the rest of that piece is routed again. So every window of every tier is full.
3. At the end of the partition, less than one longest window is left; it is cut into windows of
   descending powers of two, which need no padding.
4. The windows of a tier form step groups of ``group_tokens`` tokens each. Groups are dealt in rounds of
   ``GROUPS``: windows sorted by attention cost (the sum of squared piece lengths) go to the groups
   back and forth, so that the steps cost much alike.

Cases: a null text counts as empty and yields its end id alone; equal rows are packed as often as they
occur; a text of any length is cut as in 1; an empty table yields no rows; other columns are ignored.
Sequence ids are the partition's number in the high bits and a counter in the low ones: a task that
is run again gives the same ids for the same input split.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import Batches, data_path, run, sliced
from .fasttok import word_tokenizer

TIERS = (512, 1024, 2048, 4096)
GROUPS = 4
SLICE = 8 << 20  # bytes of text that are tokenised at once
WAITING = 8 << 20  # ids that wait before windows are filled, so that there is a choice of pieces
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids array<int>"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Pieces are (length, serial, doc_id, start, doc_tokens, ids); serials break ties, so that equal input packs equally."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, first_id: int):
        self.tiers, self.top, self.group_tokens = tiers, tiers[-1], group_tokens
        self.waiting: dict[int, list] = {t: [] for t in tiers}
        self.windows: dict[int, list] = {}
        self.serial, self.pending, self.next_id, self.next_group = 0, 0, first_id, first_id
        self.out: list[tuple] = []

    def route(self, doc_id: object, start: int, tokens: int, ids: np.ndarray) -> None:
        at = next(t for t in self.tiers if t >= len(ids))
        self.serial += 1
        self.pending += len(ids)
        insort(self.waiting[at], (len(ids), self.serial, doc_id, start, tokens, ids), key=lambda p: p[:2])

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        full = len(ids) // self.top * self.top
        for s in range(0, full, self.top):
            self.close(self.top, [(self.top, 0, doc_id, s, len(ids), ids[s : s + self.top])])
        if full < len(ids):
            self.route(doc_id, full, len(ids), ids[full:])

    def take(self, tier: int, most: int) -> tuple | None:
        """The longest waiting piece of the tier that has at most so many ids."""
        pool = self.waiting[tier]
        i = bisect_right(pool, most, key=lambda p: p[0])
        if not i:
            return None
        self.pending -= pool[i - 1][0]
        return pool.pop(i - 1)

    def cut(self, gap: int) -> tuple | None:
        """The first ``gap`` ids of a longer piece, of the shortest tier that has one; the rest waits again."""
        for tier in self.tiers:
            pool = self.waiting[tier]
            if pool and pool[-1][0] > gap:
                n, _, doc_id, start, tokens, ids = pool.pop()
                self.pending -= n
                self.route(doc_id, start + gap, tokens, ids[gap:])
                return (gap, 0, doc_id, start, tokens, ids[:gap])
        return None

    def window(self, tier: int) -> None:
        """Fill one window of the tier; at least as many ids wait."""
        gap, pieces = tier, []
        while gap:
            piece = None
            for t in reversed([t for t in self.tiers if t <= tier]):
                piece = self.take(t, gap)
                if piece:
                    break
            piece = piece or self.cut(gap)
            pieces.append(piece)
            gap -= piece[0]
        self.close(tier, pieces)

    def drain(self) -> None:
        """Windows of each tier, while what waits in it and in shorter tiers fills one."""
        for tier in reversed(self.tiers):
            while self.waiting[tier] and self.pending >= tier and sum(sum(p[0] for p in self.waiting[t][-16:]) for t in self.tiers if t <= tier) >= tier:
                self.window(tier)
        while self.pending >= self.top:
            self.window(self.top)

    def close(self, tier: int, pieces: list) -> None:
        held = self.windows.setdefault(tier, [])
        held.append(pieces)
        if len(held) * tier >= self.group_tokens * GROUPS:
            self.deal(tier)

    def deal(self, tier: int) -> None:
        """Sort the held windows of a tier by cost and deal them to step groups, back and forth."""
        held = self.windows.pop(tier, [])
        groups = max(1, -(-len(held) * tier // self.group_tokens))
        held.sort(key=lambda w: (-sum(p[0] * p[0] for p in w), w[0][1]))
        for i, pieces in enumerate(held):
            lap, step = divmod(i, groups)
            group = self.next_group + (step if lap % 2 == 0 else groups - 1 - step)
            offset = 0
            for n, _, doc_id, start, tokens, ids in pieces:
                self.out.append((doc_id, start, n, tokens, self.next_id, offset, tier, group, ids))
                offset += n
            self.next_id += 1
        self.next_group += groups

    def finish(self) -> None:
        self.drain()
        size = self.top
        while self.pending:
            while size > self.pending:
                size //= 2
            gap, pieces = size, []
            while gap:
                piece = next((p for t in reversed(self.tiers) if (p := self.take(t, gap))), None) or self.cut(gap)
                pieces.append(piece)
                gap -= piece[0]
            self.close(size, pieces)
        for tier in sorted(self.windows, reverse=True):
            self.deal(tier)

    def batch(self) -> pa.RecordBatch | None:
        rows, self.out = self.out, []
        if not rows:
            return None
        doc, start, length, tokens, seq, offset, tier, group, ids = zip(*rows)
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        longs = [pa.array(x, pa.int64()) for x in (doc, start, length, tokens, seq, offset)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(tier, pa.int32()), pa.array(group, pa.int64()), ids], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"])


def pack_batches(path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, group_tokens: int = 65536):
    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(tiers, group_tokens, (context.partitionId() if context else 0) << 32)
        tokenizer = word_tokenizer(path)
        for batch in batches:
            ids, counts = tokenizer.encode(batch.column("text"))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end_id)  # the end id after each document's ids
            ends = np.concatenate([[0], ends + np.arange(1, len(counts) + 1)])
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, whole[ends[i] : ends[i + 1]])
            if packer.pending >= WAITING:
                packer.drain()
            for tier, held in packer.waiting.items():  # what stays must not hold the whole batch
                packer.waiting[tier] = [p if p[5].base is None else (*p[:5], p[5].copy()) for p in held]
            if full := packer.batch():
                yield full
        packer.finish()
        if full := packer.batch():
            yield full

    return step


def digest_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """ids_crc32 in place of the ids."""
    for batch in batches:
        lists = batch.column("ids")
        raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends = (ends - ends[0]) * 4
        crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())
        take = [batch.column(c) if c != "ids_crc32" else crc for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")]
        yield pa.RecordBatch.from_arrays(take, names=[x.split()[0] for x in DIGEST.split(", ")])


def pack_documents(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """The pieces of all documents, each with its ids and its place in a sequence."""
    return run(docs.select("doc_id", "text"), SCHEMA, sliced(SLICE), pack_batches(path or data_path("word_bpe_49k.json"), **options))


def packed_digest(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """``pack_documents`` with ids_crc32 in place of the ids, in the same pass."""
    return run(docs.select("doc_id", "text"), DIGEST, sliced(SLICE), pack_batches(path or data_path("word_bpe_49k.json"), **options), digest_batches)
