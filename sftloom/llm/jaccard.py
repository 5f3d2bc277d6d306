"""Near duplicates: a chosen-path join of shingle sets under Jaccard similarity.

A document's set holds its hashed three-word shingles (lower case, ASCII punctuation dropped). Documents with
equal sets are one node, so exact copies cost one row however many they are. The join then

1. describes each node by a minhash sketch of ``SKETCH`` values, whose equal places estimate the similarity;
2. splits all nodes recursively on sampled tokens of the sketch (a place and its value): in each run every node
   chooses, by a hash of the bucket, each token with a probability that makes ``BRANCH / threshold`` of them
   expected, so that nodes that share tokens choose the same ones. Buckets of at most ``LIMIT`` nodes are compared by
   brute force; larger ones are split again, unless their mean similarity says that splitting would
   only copy them; there are so many runs that the expected recall at the threshold reaches ``recall`` for pairs that are split
   ``LEVELS`` times, as often as any;
3. compares buckets in tiles of two blocks of ``4 * BLOCK`` nodes (``BLOCK`` in step 4), and keeps a spanning
   forest of the pairs whose estimate lies within ``SLACK`` standard deviations of the threshold or above;
   connected nodes make a cluster;
4. computes the exact similarity of all pairs within each cluster from the whole sets, again in tiles. Links
   are counted where they are found; of the pairs only a spanning forest leaves a tile, never all of them;
5. connects the exact forests to classes (alternating large and small stars).

Work and rows moved are linear in the documents, but for step 4: a cluster of m different sets takes m^2 / 2
comparisons, spread over (m / BLOCK)^2 / 2 tasks' rows.

Result: doc_id, class_id (the lowest doc_id of the class), n_links (different texts that the document's text is
linked to: those with the same set and those of all linked sets) and n_copies (other documents with the
same set).

Cases: a null text counts as empty; a text without words is linked to equal texts alone; a text of one or two
words has one shingle; repeated rows are copies; a null doc_id keeps its row, and a class of such rows alone
has a null class_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Batches, Store, run, sliced, utf8

THRESHOLD, RECALL = 0.5, 0.99
SKETCH, SHINGLE = 128, 3
BRANCH, LIMIT, BLOCK, LEVELS, SLACK = 1.5, 200, 256, 6, 3.0
DENSE = 0.8
TILED = 64 << 20  # bytes of whole sets in a block of the exact step
COLLECTED = 2_000_000  # node ids that may be sent to the scan; beyond it the texts are shuffled
SLICE = 256 << 10  # bytes of text that are shingled at once, so that temporary arrays stay in the cache
SETS = "doc_id long, node binary, n int, text_hash long, sketch binary"
POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)
LOW48 = np.uint64((1 << 48) - 1)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans are disjoint and in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    values = (raw[np.repeat(start, size) + at].astype(np.uint64) + np.uint64(1)) * POWERS[at & 255]
    values = values ^ (at >> 8).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (48 bits) of each text in ascending order, and the texts' bounds in them."""
    column = column.fill_null("") if column.null_count else column
    whole, whole_ends = utf8(column)
    n = len(column)
    raw, ends = utf8(pc.utf8_lower(column))
    inside = WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][np.diff(ends) > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    words, by = span_hash(raw, start, stop), np.searchsorted(start, ends)
    many = np.diff(by)
    doc = np.repeat(np.arange(n), many)
    full = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    triple = mix(words[full] * np.uint64(3) + mix(words[full + 1] * np.uint64(5) + mix(words[full + 2], 1), 2), 3)
    owners, values = [doc[full]], [triple]
    for count in (1, 2):
        which = np.flatnonzero(many == count)
        some = mix(words[by[which]] + np.uint64(7), 4)
        owners.append(which)
        values.append(some if count == 1 else mix(some + words[by[which] + 1], 5))
    which = np.flatnonzero(many == 0)
    if len(which):
        owners.append(which)
        texts = [whole[whole_ends[i] : whole_ends[i + 1]] for i in which]
        sizes = np.array([len(t) for t in texts])
        odd = np.full(len(which), 11, np.uint64)
        some = sizes > 0
        if some.any():
            edges = np.concatenate([[0], np.cumsum(sizes[some])])
            odd[some] = span_hash(np.concatenate([t for t in texts if len(t)]), edges[:-1], edges[1:])
        values.append(mix(odd, 6))
    out_docs, out_values, at = [], [], 0
    owner, value = np.concatenate(owners), np.concatenate(values) & LOW48
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    while at < n:  # 65536 texts at a time fit beside 48 bits
        a, b = np.searchsorted(owner, [at, at + 65536])
        key = ((owner[a:b] - at).astype(np.uint64) << np.uint64(48)) | value[a:b]
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        out_docs.append((key >> np.uint64(48)).astype(np.int64) + at)
        out_values.append(key & LOW48)
        at += 65536
    docs = np.concatenate(out_docs) if out_docs else np.zeros(0, np.int64)
    return np.concatenate(out_values) if out_values else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])


MULTIPLIERS = (mix(np.arange(SKETCH, dtype=np.uint64), 7) | np.uint64(1)).astype(np.uint32)
ADDENDS = mix(np.arange(SKETCH, dtype=np.uint64), 8).astype(np.uint32)


def sketches(values: np.ndarray, ends: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """Minhashes of each set (none is empty), a row for each."""
    n = len(ends) - 1
    out = np.empty((n, SKETCH), np.uint32)
    low = mix(values, 9).astype(np.uint32)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + at_once, side="right")) - 1)
        part, edge = low[ends[at] : ends[to]], ends[at:to] - ends[at]
        for i in range(SKETCH):
            h = part * MULTIPLIERS[i] + ADDENDS[i]
            h ^= h >> np.uint32(15)
            out[at:to, i] = np.minimum.reduceat(h, edge)
        at = to
    return out


def keys(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits that name each set, as 16 bytes."""
    sums = [np.add.reduceat(mix(values, seed), ends[:-1]) if len(ends) > 1 else np.zeros(0, np.uint64) for seed in (10, 11)]
    return np.stack([mix(s + np.diff(ends).astype(np.uint64), 12) for s in sums], 1).astype(">u8")


def fixed(rows: np.ndarray, width: int) -> pa.Array:
    """Binary array of rows with ``width`` bytes each."""
    n = len(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def unfixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary array whose values all have ``width`` items of ``kind``."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, width), kind)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def set_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").fill_null("")
        values, ends = shingles(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), fixed(keys(values, ends), 16), pa.array(np.diff(ends), pa.int32()), batch.column("text_hash"), fixed(sketches(values, ends), 4 * SKETCH)],
            names=["doc_id", "node", "n", "text_hash", "sketch"],
        )


def token_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Whole sets, by node."""
    for batch in batches:
        values, ends = shingles(batch.column("text").fill_null(""))
        sets = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
        yield pa.RecordBatch.from_arrays([fixed(keys(values, ends), 16), sets.cast(pa.binary())], names=["node", "tokens"])


def split_batches(seeds: list[int] | None, threshold: float):
    """Buckets that each node chooses; without seeds the node's bucket is the seed."""
    least = np.uint64(min(2**64 - 1, int(2**64 * BRANCH / (threshold * SKETCH))))

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        place = np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            tokens = unfixed(batch.column("sketch"), "<u2" if seeds is None else "<u4", SKETCH).astype(np.uint64) | place
            for seed in seeds or [None]:
                base = mix(np.array([seed], np.uint64), 20)[:, None] if seed is not None else mix(batch.column("bucket").to_numpy().view(np.uint64), 21)[:, None]
                chosen = mix(tokens ^ base, 22)
                row, which = np.nonzero(chosen < least)
                bucket = mix(chosen[row, which] ^ tokens[row, which], 23) ^ base[row if seed is None else np.zeros(len(row), int), 0]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column("node").take(pa.array(row))], names=["bucket", "node"])

    return step


def joined(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    """One batch of both; binary columns get wide offsets where they would pass 2 GiB."""
    kinds = []
    for name in a.schema.names:
        kind = a.column(name).type
        if pa.types.is_large_binary(kind) or pa.types.is_large_binary(b.column(name).type) or pa.types.is_binary(kind) and a.column(name).nbytes + b.column(name).nbytes >= 2**31 - 1:
            kind = pa.large_binary()
        kinds.append(pa.field(name, kind))
    schema = pa.schema(kinds)
    one = pa.Table.from_batches([a]).cast(schema).to_batches() + pa.Table.from_batches([b]).cast(schema).to_batches()
    out = pa.Table.from_batches(one, schema).combine_chunks().to_batches()
    if len(out) != 1:
        raise ValueError("rows of a group do not fit one batch")
    return out[0]


def groups(batches: Batches, names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, and the groups' bounds; rows come sorted by ``names``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = joined(rest, batch)
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for name in names:
            column = batch.column(name)
            values = unfixed(column, "<u8", 2) if pa.types.is_binary(column.type) else column.to_numpy()[:, None]
            new[1:] |= (values[1:] != values[:-1]).any(1)
        bounds = np.flatnonzero(new)
        rest = batch.slice(bounds[-1])
        if len(bounds) > 1:
            yield batch.slice(0, bounds[-1]), bounds
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


class Forest:
    """Union-find over the rows of a tile; ``edges`` are the unions that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.edges, self.trees = list(range(n)), [], n

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.trees -= 1
            self.edges.append((i, j))


def short_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Half of each place of the sketches: enough to compare two sketches and to split a bucket again."""
    for batch in batches:
        half = unfixed(batch.column("sketch"), "<u4", SKETCH).astype("<u2")
        yield pa.RecordBatch.from_arrays([batch.column("node"), fixed(half, 2 * SKETCH)], names=["node", "sketch"])


def estimate_batches(threshold: float):
    """Forest of the pairs of each tile whose sketches agree often enough."""
    least = math.ceil(SKETCH * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SKETCH)))

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch, bounds in groups(batches, ["bucket", "lo", "hi"]):
            sketch, side = unfixed(batch.column("sketch"), "<u2", SKETCH), batch.column("side").to_numpy()
            left, right = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                s, kind = sketch[a:b], side[a:b]
                if b - a == 2:
                    if (s[0] == s[1]).sum() >= least and (kind[0] != kind[1] or kind[0] == 2):
                        left.append(a)
                        right.append(a + 1)
                    continue
                forest = Forest(b - a)
                for i in range(b - a - 1):
                    if forest.trees == 1:
                        break
                    near = (s[i + 1 :] == s[i]).sum(1) >= least
                    for j in np.flatnonzero(near) + i + 1:
                        if kind[i] != kind[j] or kind[i] == 2:
                            forest.join(i, int(j))
                left += [a + i for i, _ in forest.edges]
                right += [a + j for _, j in forest.edges]
            node = batch.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(left, pa.int64())), node.take(pa.array(right, pa.int64()))], names=["u", "v"])

    return step


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    common = np.zeros((m, m))
    if m == 2:
        both = np.concatenate(sets)
        both.sort()
        common[0, 1] = common[1, 0] = (both[1:] == both[:-1]).sum()
    else:
        row = np.repeat(np.arange(m, dtype=np.int32), size.astype(np.int64))
        tokens = np.concatenate(sets)
        order = np.argsort(tokens)
        row, tokens = row[order], tokens[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        alone = new & np.append(new[1:], True)
        number = np.cumsum(new & ~alone) - 1
        row, token = row[~alone], number[~alone]
        for first in range(0, int(token[-1]) + 1 if len(token) else 0, 8192):
            a, b = np.searchsorted(token, [first, first + 8192])
            member = np.zeros((m, 8192), np.float32)
            member[row[a:b], token[a:b] - first] = 1
            common += member @ member.T
    return common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9


def exact_batches(threshold: float):
    """Links of each tile: how many texts each node is linked to here (v is null), and a forest of the links."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch, bounds in groups(batches, ["cluster", "lo", "hi"]):
            side, texts, tokens = batch.column("side").to_numpy(), batch.column("n_texts").to_numpy(), batch.column("tokens")
            raw, ends = tokens.buffers()[2], np.frombuffer(tokens.buffers()[1], np.int64 if pa.types.is_large_binary(tokens.type) else np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
            data = np.frombuffer(raw, np.uint8)
            u, v, links = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                linked = similar([data[ends[i] : ends[i + 1]].view(np.uint64) for i in range(a, b)], threshold)
                kind = side[a:b]
                linked &= (kind[:, None] != kind[None, :]) | (kind[:, None] == 2)
                np.fill_diagonal(linked, False)
                count = linked @ texts[a:b]
                some = np.flatnonzero(count)
                u += (some + a).tolist()
                v += [None] * len(some)
                links += count[some].tolist()
                forest = Forest(b - a)
                for i in range(b - a - 1):
                    if forest.trees == 1:
                        break
                    for j in np.flatnonzero(linked[i, i + 1 :]) + i + 1:
                        forest.join(i, int(j))
                u += [a + i for i, _ in forest.edges]
                v += [a + j for _, j in forest.edges]
                links += [0] * len(forest.edges)
            node = batch.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(u, pa.int64())), node.take(pa.array(v, pa.int64())), pa.array(links, pa.int64())], names=["u", "v", "links"])

    return step


def tiles(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Each member in every tile of its block's row and column; side tells the blocks apart (2: one block)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / block).cast("int"))
    own = F.pmod(F.xxhash64("node", key), blocks).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    # with two blocks or more, a block's own pairs are compared in its diagonal tile alone
    return spread.select("*", lo.alias("lo"), hi.alias("hi"), side.alias("side")).drop("own", "other")


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node and its component's least node, for every node with an edge (alternating large and small stars)."""

    def sides(e: DataFrame) -> DataFrame:
        return e.union(e.select("v", "u"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = sides(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if large:
            return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(now)
    while before[0]:
        now = keep(star(star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def runs_for(threshold: float, recall: float, depth: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with the wanted probability, if it is split ``depth`` times in each; buckets are split ``LEVELS`` times at most."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-BRANCH * meet)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def candidates(nodes: DataFrame, threshold: float, recall: float, store: Store) -> DataFrame:
    """Pairs (u, v) that connect all nodes of each cluster."""
    level = run(nodes.select("node", "sketch"), "bucket long, node binary", split_batches(list(range(runs_for(threshold, recall))), threshold))
    found = short = None
    for depth in range(LEVELS):
        # runs often meet the same group again: of buckets with the same members one is enough
        shared = level.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members")).where("size > 1")
        shared = shared.groupBy("size", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
        level = store.keep(level.join(shared, "bucket"))
        if short is None:  # only nodes that share a bucket are looked at again
            some = level.select("node").distinct()
            short = store.keep(run(nodes.select("node", "sketch"), "node binary, sketch binary", short_batches).join(some, "node", "left_semi"))
        small = level if depth == LEVELS - 1 else level.where(F.col("size") <= LIMIT)
        found = small if found is None else found.union(small)
        large = level.where(F.col("size") > LIMIT)
        if depth == LEVELS - 1 or large.isEmpty():
            break
        large = store.keep(large.join(short, "node"))
        sampled = F.array(*[F.substring("sketch", 2 * i + 1, 2) for i in range(0, SKETCH, SKETCH // 16)])
        tokens = large.select("bucket", "size", F.posexplode(sampled).alias("place", "value")).groupBy("bucket", "size", "place", "value").agg(F.count("*").alias("c"))
        mean = F.sum(F.col("c").cast("double") * F.col("c")) / 16 / F.pow(F.first("size").cast("double"), 2)
        dense = store.keep(tokens.groupBy("bucket").agg(mean.alias("mean")).select("bucket", (F.col("mean") >= DENSE * threshold).alias("dense")))
        found = found.union(level.join(dense.where("dense").select("bucket"), "bucket"))
        level = run(large.join(dense.where("not dense").select("bucket"), "bucket").select("bucket", "node", "sketch"), "bucket long, node binary", split_batches(None, threshold)).distinct()
    placed = tiles(found, "bucket", "size", 4 * BLOCK).join(short, "node").select("bucket", "lo", "hi", "side", "node", "sketch")
    placed = placed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")
    return run(placed, "u binary, v binary", estimate_batches(threshold))


def exact_links(docs: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float, store: Store) -> tuple[DataFrame, DataFrame]:
    """Number of linked texts by node, and a spanning forest of all links."""
    clusters = components(edges, store.keep)
    clusters = store.keep(clusters.join(nodes.select("node", "first_id", "n_texts", "n"), "node"))
    # as many blocks as the rows or the bytes ask for
    heavy = F.ceil(F.sum("n") * 8 / TILED) * BLOCK
    sizes = clusters.groupBy("root").agg(F.greatest(F.count("*"), heavy).alias("size"))
    members = store.keep(clusters.join(sizes, "root").select("node", F.col("root").alias("cluster"), "size", "first_id", "n_texts"))
    texts = docs.select("doc_id", "text")
    wanted = members.select("first_id").distinct()
    if wanted.count() <= COLLECTED:
        ids = wanted.toArrow().column("first_id")
        shared = store.spark.sparkContext.broadcast((np.sort(ids.drop_null().to_numpy()), ids.null_count > 0))

        def pick(batches: Batches) -> Iterator[pa.RecordBatch]:
            known, null = shared.value
            for batch in batches:
                own = batch.column("doc_id")
                values = own.fill_null(0).to_numpy()
                at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
                hit = (known[at] == values) & own.is_valid().to_numpy(zero_copy_only=False) if len(known) else np.zeros(len(own), bool)
                if null:
                    hit = hit | own.is_null().to_numpy(zero_copy_only=False)
                if hit.any():
                    yield batch.filter(pa.array(hit))

        sets = run(texts, "node binary, tokens binary", pick, sliced(SLICE), token_batches)
    else:
        texts = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.first_id), "left_semi")
        sets = run(texts, "node binary, tokens binary", sliced(SLICE), token_batches)
    sets = sets.groupBy("node").agg(F.first("tokens").alias("tokens"))
    placed = tiles(members.join(sets, "node"), "cluster", "size", BLOCK).select("cluster", "lo", "hi", "side", "node", "n_texts", "tokens")
    placed = placed.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node")
    links = store.keep(run(placed, "u binary, v binary, links long", exact_batches(threshold)))
    degree = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    return degree, links.where("v is not null").select("u", "v")


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def classes(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """doc_id, text_hash, root (names the class), class_id, n_links and n_copies of every document."""
    store = Store(docs.sparkSession, "jaccard")
    sets = store.keep(run(hashed(docs.select("doc_id", "text")), SETS, sliced(SLICE), set_batches))
    by_text = sets.groupBy("node", "text_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.first("n").alias("n"))
    nodes = store.keep(by_text.groupBy("node").agg(F.min("first_id").alias("first_id"), F.sum("rows").alias("rows"), F.count("*").alias("n_texts"), F.first("n").alias("n")))
    edges = store.keep(candidates(store.keep(sets.groupBy("node").agg(F.first("sketch").alias("sketch"))), threshold, recall, store))
    degree, forest = exact_links(docs, nodes, edges, threshold, store)
    roots = components(forest, store.keep)
    named = nodes.select("node", "first_id", "rows", "n_texts").join(roots, "node", "left").join(degree, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    table = named.join(least, "root").select("node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    return sets.select("doc_id", "text_hash", "node").join(table, "node").drop("node")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document."""
    return classes(docs, threshold, recall).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each class, with all its columns: of the lowest doc_id, then of the lowest text hash.

    A row without doc_id stays only where its class has none with one; of rows with the same doc_id and text one
    stays. Texts move once, by doc_id and text hash, so that no key is hot but for such rows.
    """
    found = classes(docs, threshold, recall)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    stay = found.groupBy("root").agg(first).select("first.*").distinct()
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole")  # its columns may have any names
    marked = docs.select(whole, docs.doc_id.isNull().alias("null"), F.coalesce(docs.doc_id, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(docs.text, F.lit(""))).alias("hash"))
    kept = marked.join(stay, ["null", "id", "hash"], "left_semi").dropDuplicates(["null", "id", "hash"])
    return kept.select("whole.*")
