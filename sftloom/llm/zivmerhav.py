"""Ziv-Merhav cross-parsing: how far each text is from the rest of the corpus.

The reference of a text is all other rows' texts, whole (``score_corpus``): its greedy phrases are the longest matches that
occur in any of them, found by sorting the suffixes of the corpus (``suffixes``). A byte that does not occur elsewhere is a phrase.

With ``every`` set, the reference is a sample instead, 1 in ``every`` segments of all texts, spread over shards of about
``shard_bytes``; each text is scored in one shard by a suffix automaton, and its own segments go to other shards. No query uses this.

    cross    = phrases * log2(reference bytes) / bytes
    own      = c * log2(c) / bytes, with c phrases of the text's own incremental (LZ78) parsing
    relative = cross - own, in bits a byte

Cases: a null or empty text has 0 phrases and scores of 0; a text without reference (all others are empty) takes every byte for a phrase and has
no scores (null); a text that another row has too is one phrase; equal texts score equally; an empty table gives no rows; other columns are
ignored. In the sample, a shard without reference takes every byte for a phrase, with a factor of log2(2), and long texts are cut into segments for the reference only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .arrow import Batches, run, utf8

SHARD_BYTES, SEGMENT = 128 << 10, 8192
PARSED = 4 << 20  # bytes of text that are parsed at once; a text is never cut
SCHEMA = "doc_id long, n_bytes long, phrases long, own_phrases long, reference_bytes long, cross_bits double, relative_bits double"
JOINT = 256  # between segments; no byte matches it
FEW = 24
LARGEST = 1 << 26


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p == -1:
            link.append(0)
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                copy = len(step)
                link.append(copy)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = copy
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
        last = now
    return step


class Reference:
    def __init__(self, segments: list[bytes]):
        self.size = sum(map(len, segments))
        symbols: list[int] = []
        for s in segments:
            symbols.extend(s)
            symbols.append(JOINT)
        self.step = suffix_automaton(symbols)
        bytes_ = sorted({b for s in segments for b in set(s)})
        self.symbol = np.zeros(256, np.int32)  # 0: does not occur
        self.symbol[bytes_] = np.arange(1, len(bytes_) + 1)
        self.width = len(bytes_) + 1
        self.table = None
        if len(self.step) * self.width <= LARGEST:
            # states count from 1 here, 0 is no state
            many = [len(d) for d in self.step]
            state = np.repeat(np.arange(1, len(many) + 1), many)
            byte = np.fromiter((b for d in self.step for b in d), np.int64, len(state))
            to = np.fromiter((t + 1 for d in self.step for t in d.values()), np.int64, len(state))
            real = byte != JOINT
            self.table = np.zeros((len(many) + 1) * self.width, np.int32)
            self.table[state[real] * self.width + self.symbol[byte[real]]] = to[real]
            self.step = []

    def phrases(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of phrases of each text."""
        n = len(ends) - 1
        if self.table is None:
            return np.array([self._plain(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], np.int64)
        length = np.diff(ends)
        order = np.argsort(-length, kind="stable")
        start, length = ends[:-1][order], length[order]
        count, state, symbols = np.zeros(n, np.int64), np.ones(n, np.int32), self.symbol[raw]
        root, table, width = self.table[self.width : 2 * self.width], self.table, self.width
        at, live = 0, int(np.searchsorted(-length, 0, side="left"))
        while live > FEW:
            s = symbols[start[:live] + at]
            here = state[:live]
            to = table[here * width + s]
            dead = to == 0
            again = root[s]
            # a phrase ends before this byte, and the byte starts the next one; where it does not occur it is one itself
            count[:live] += (dead & (here != 1)).astype(np.int64) + (dead & (again == 0))
            state[:live] = np.where(dead, np.maximum(again, 1), to)
            at += 1
            live = int(np.searchsorted(-length[:live], -at, side="left"))
        if live:
            flat, first = memoryview(table), memoryview(root)
            for i in range(live):
                here, found = int(state[i]), 0
                for s in symbols[start[i] + at : start[i] + length[i]].tolist():
                    to = flat[here * width + s]
                    if not to:
                        found += here != 1
                        to = first[s]
                        if not to:
                            found += 1
                            to = 1
                    here = to
                count[i] += found
                state[i] = here
        count += state != 1
        out = np.empty(n, np.int64)
        out[order] = count
        return out

    def _plain(self, text: bytes) -> int:
        step, here, found = self.step, 0, 0
        for b in text:
            to = step[here].get(b)
            if to is None:
                found += here != 0
                to = step[0].get(b)
                if to is None:
                    found += 1
                    to = 0
            here = to
        return found + (here != 0)


def own_phrases(text: bytes) -> int:
    """Phrases of the incremental parsing: each is the longest earlier phrase and one byte more."""
    tree: dict[int, int] = {}
    node, phrases = 0, 0
    get = tree.get
    for b in text:
        key = node << 8 | b
        node = get(key, 0)
        if not node:
            phrases += 1
            tree[key] = phrases
    return phrases + (node != 0)


def score_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, the reference's segments (kind 0) before the texts (kind 1)."""
    shard, segments, reference = None, [], None
    for batch in batches:
        shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)]):
            if a == b:
                continue
            if shards[a] != shard:
                shard, segments, reference = shards[a], [], None
            raw, ends = utf8(batch.column("text").slice(a, b - a))
            if kinds[a] == 0:
                segments += [raw[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
                continue
            if reference is None:
                reference, segments = Reference(segments), []
            size = np.diff(ends)
            count = reference.phrases(raw, ends)
            own = np.array([own_phrases(raw[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])], np.int64)
            least = np.maximum(size, 1)
            cross = count * np.log2(max(2, reference.size)) / least
            relative = cross - own * np.log2(np.maximum(own, 1)) / least
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(count), pa.array(own), pa.array(np.full(b - a, reference.size, np.int64)), pa.array(cross), pa.array(relative)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def shards_of(docs: DataFrame, every: int, shard_bytes: int) -> int:
    """As many shards as the expected size of the reference asks for, two at least."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(2, -(-total // (every * shard_bytes)))


def with_reference(docs: DataFrame, shards: int, every: int) -> DataFrame:
    """Texts and the reference's segments, each with its shard."""
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    home = F.pmod("h", F.lit(shards)).cast("int")
    texts = hashed.select(home.alias("shard"), F.lit(1).alias("kind"), "h", "doc_id", "text")
    every_segment = F.sequence(F.lit(0), F.expr(f"cast((length(text) - 1) div {SEGMENT} as int)"))
    mine = F.filter(every_segment, lambda i: F.pmod(F.xxhash64("h", i), F.lit(every)) == 0)
    chosen = hashed.where("text <> ''").withColumn("segments", mine).where(F.size("segments") > 0)
    cut = chosen.select("h", "doc_id", "text", F.explode("segments").alias("segment"))
    away = F.pmod(home + 1 + F.pmod(F.xxhash64("segment", "h"), F.lit(shards - 1)), F.lit(shards)).cast("int")
    segments = cut.select(away.alias("shard"), F.lit(0).alias("kind"), F.xxhash64("h", "segment").alias("h"), "doc_id", F.expr(f"substring(text, segment * {SEGMENT} + 1, {SEGMENT})").alias("text"))
    return segments.union(texts)


def parse_batches(corpus: suffixes.Corpus):
    """Scores of the texts that start in each slice."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        text, starts, ids = corpus.text(), corpus.array("starts", "<i8"), corpus.array("ids", "<i8").reshape(-1, 2)
        everything = corpus.size - corpus.docs
        for batch in batches:
            for i in batch.column("id").to_pylist():
                a, b = np.searchsorted(starts[:-1], [i * PARSED, (i + 1) * PARSED])
                if a == b:
                    continue
                lo = int(starts[a])
                ends = starts[a : b + 1] - lo
                longest = suffixes.lengths(corpus, text, lo, int(starts[b]))
                after = memoryview(np.arange(len(longest)) + np.maximum(longest, 1))
                size, count, own = np.diff(ends) - 1, np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for k, (at, n) in enumerate(zip(ends.tolist(), size.tolist())):
                    own[k] = own_phrases(text[lo + at : lo + at + n].tobytes())
                    end, found = at + n, 0
                    while at < end:
                        at = after[at]
                        found += 1
                    count[k] = found
                others, least = everything - size, np.maximum(size, 1)
                cross = count * np.log2(np.maximum(2, others)) / least
                relative = cross - own * np.log2(np.maximum(own, 1)) / least
                unknown = (others == 0) & (size > 0)
                columns = [pa.array(np.array(ids[a:b, 0]), mask=ids[a:b, 1] != 0), pa.array(size), pa.array(count), pa.array(own), pa.array(others), pa.array(cross, mask=unknown), pa.array(relative, mask=unknown)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return step


def score_corpus(docs: DataFrame, every: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Phrase counts and scores of every document against all others, or with ``every`` against a sample."""
    if every is None:
        corpus = suffixes.build(docs)
        if not corpus.size:
            return docs.sparkSession.createDataFrame([], SCHEMA)
        return run(corpus.slices(docs.sparkSession, PARSED), SCHEMA, parse_batches(corpus))
    shards = shards_of(docs, every, shard_bytes)
    rows = with_reference(docs, shards, every)
    placed = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "h", "doc_id", "text")
    return run(placed, SCHEMA, score_batches)
