"""Ziv-Merhav cross-parsing by words: each text against all other texts of the corpus, without a shared index.

Symbols are words (runs of ASCII letters, digits and two-byte characters) and single other characters; white space only
parts them. A text's greedy phrases are the longest matches with any other text; a symbol that occurs nowhere else is
a phrase of its own. Which matches exist is found without bringing texts together:

1. one text is kept of each content; a copy of another row's text is one phrase;
2. texts are cut into slices of whole texts. Each slice sends the hashes of its different grams of a length, once each, in one binary
   for each bucket of hashes, with a bit for those that two of its texts have. A bucket's grams that come from two slices, or have
   the bit, are shared; the answer is one bit a gram. However hot a gram is, a slice sends it once;
3. lengths rise over the jobs; a gram is only sent if the shorter ones in it are shared (from 5 words on few are), and only the
   stretches that are still shared travel on. Lengths are 1 to 16 one by one, then four to an octave: longer
   phrases are cut to 20, 24, 28, 32, 40, ... words;
4. each slice parses its texts with the lengths found.

    cross    = phrases * log2(symbols of all other rows) / symbols
    own      = c * log2(c) / symbols, with c phrases of the text's own incremental (LZ78) parsing
    relative = cross - own, in bits a symbol

A suffix automaton of the corpus (``zivmerhav``, which the tests hold this against) gives the same longest matches, but cannot be cut into tasks:
matches may lie anywhere. Work and bytes moved are linear in the symbols; a slice holds 2 MB of text, or one text if that is longer.
Symbols are told apart by 48 bits, grams by 44 and their bucket of some million, texts by 128.

Cases: a null or empty text, or one of white space alone, has 0 phrases and scores of 0; a text without reference (all others have no symbols) takes
every symbol for a phrase and has no scores (null); equal texts score equally; repeated rows are copies; a null doc_id keeps
its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Batches, Store, pieces, run, shared_dir, sliced, spans, utf8, written
from .jaccard import mix, span_hash

SLICE, BUCKET = 2 << 20, 1 << 21
LENGTHS = [*range(1, 17), *(2**k * m // 4 for k in range(4, 31) for m in (5, 6, 7, 8))]
JOBS = [(1, 2), (3, 4), (5, 8), (9, 16), (17, 28)]  # first and last length, counted from 1; then twelve at a time
META, LIVE, DONE, BITS = range(4)
ROW = "kind int, slice long, bucket long, n long, bits binary, keys binary, own binary, bounds binary, at binary, owner binary, vocab binary, codes binary, level binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
KIND = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
FIELDS = pa.schema([(x.split()[0], KIND[x.split()[1]]) for x in ROW.split(", ")])
SCHEMA = "doc_id long, n_bytes long, n_symbols long, phrases long, own_phrases long, reference_symbols long, cross_bits double, relative_bits double"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC3, 0xE0)]] = True
KEY = 44
LONG = 4096
MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
LOW48, LOWKEY = np.uint64((1 << 48) - 1), np.uint64((1 << KEY) - 1)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, one byte plane after the other, compressed; the size comes first."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: memoryview, kind: str, width: int) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(blob[8:], n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.view(kind)[:, 0]


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the values, equal ones in their own order, and the values so ordered.

    High bits are sorted with the place below them, which is far cheaper than sorting places.
    """
    if not len(values):
        return np.zeros(0, np.int64), values
    low = np.uint64((1 << len(values).bit_length()) - 1)
    both = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    sort = values[order]
    if (sort[1:] < sort[:-1]).any():  # two values with the same high bits
        order = np.argsort(values, kind="stable")
        sort = values[order]
    return order, sort


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, the most frequent first, and each value's number there."""
    order, sort = ordered(values)
    new = np.concatenate([[True], sort[1:] != sort[:-1]])[: len(sort)]
    start = np.flatnonzero(new)
    rank = np.empty(len(start), np.uint32)
    many = np.minimum(np.diff(np.append(start, len(sort))), 65535).astype(np.uint16)
    by = np.argsort(np.uint16(65535) - many, kind="stable")
    rank[by] = np.arange(len(start), dtype=np.uint32)
    codes = np.empty(len(values), np.uint32)
    codes[order] = rank[np.cumsum(new) - 1]
    return sort[start][by], codes


def row(**values) -> pa.RecordBatch:
    made = {k: [v.tobytes() if isinstance(v, np.ndarray) else v] for k, v in values.items()}
    return pa.RecordBatch.from_arrays([pa.array(made.get(f.name, [None]), f.type) for f in FIELDS], schema=FIELDS)


def word_hash(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each span, eight bytes at a time; very long ones by ``span_hash``."""
    size = stop - begin
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    out, which = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.flatnonzero(size <= LONG)
    at, left = begin[which], size[which]
    while len(which):
        h = (out[which] ^ (eight[at] & MASK[np.minimum(left, 8)])) * np.uint64(0xBF58476D1CE4E5B9)
        out[which] = h ^ (h >> np.uint64(31))
        more = np.flatnonzero(left > 8)
        which, at, left = which[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > LONG)
    out[long] = span_hash(raw, begin[long], stop[long])
    return mix(out, 52)


def symbols(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all symbols, and the texts' bounds in them."""
    space, after = SPACE[raw], (raw & 0xC0) == 0x80
    inside = LETTER[raw]
    inside[1:] |= after[1:] & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)
    start = ~inside & ~space & ~after
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][np.diff(ends) > 0]
    first[heads] = inside[heads]
    start |= first
    edge = np.flatnonzero(start | space)
    which = np.flatnonzero(start[edge])
    begin, stop = edge[which], np.append(edge, len(raw))[which + 1]
    return word_hash(raw, begin, stop) & LOW48, np.searchsorted(begin, ends)


def own_phrases(codes: list[int]) -> int:
    """Phrases of the incremental parsing: each is the longest earlier phrase and one symbol more."""
    tree: dict[int, int] = {}
    node, new, one = 0, 1 << 32, 1 << 32
    enter = tree.setdefault
    for c in codes:
        node = enter(node | c, new)
        if node == new:
            new += one
            node = 0
    return len(tree) + (node != 0)


def slice_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """A row with the texts' keys and a row with their symbols, for each slice."""
    base, count = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        parts = [(symbols(*utf8(x)), len(x)) for x in pieces(batch.column("text"))]
        ends = utf8(batch.column("text"))[1]
        hashes = np.concatenate([h for (h, _), _ in parts])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for (_, b), _ in parts]))])
        vocab, codes = numbered(hashes)
        own = np.array([own_phrases(codes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
        keys = np.stack([np.asarray(batch.column("k1")), np.asarray(batch.column("k2")), np.asarray(batch.column("rows")), np.diff(ends)], 1)
        bounds = bounds.astype(np.int64)
        yield row(kind=META, slice=base | count, bucket=-1, n=len(codes), keys=keys, own=own, bounds=bounds)
        owner = np.arange(len(ends) - 1, dtype=np.uint32)
        yield row(kind=LIVE, slice=base | count, bucket=-1, n=len(codes), bounds=bounds, at=bounds[:-1], owner=owner, vocab=pack(vocab, 6), codes=pack(codes, 4), level=pack(np.zeros(len(codes), np.uint8), 1))
        count += 1


class Slice:
    """The shared stretches of a slice: symbols, bounds of the stretches, their places and texts, and the lengths found so far."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        take = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.bounds, self.at, self.owner = take("bounds", "<i8"), take("at", "<i8"), take("owner", "<u4")
        whole = lambda name, kind, width: unpack(memoryview(batch.column(name)[i].as_buffer()), kind, width)
        self.vocab, self.codes, self.level = whole("vocab", "<u8", 6), whole("codes", "<u4", 4), whole("level", "u1", 1)

    def grams(self, first: int, last: int, buckets: int):
        """Places, lengths (counted from 1) and order by hash of the grams that may be shared; the different hashes, their counts, and their bounds by bucket."""
        n, known = len(self.codes), LENGTHS[first - 2] if first > 1 else 0
        size = np.diff(self.bounds)
        left = np.repeat(self.bounds[1:], size) - np.arange(n)  # symbols to the stretch's end
        if first > 1:
            dead = np.where(self.level < first - 1, np.arange(n), n)
            left = np.minimum(left, np.minimum.accumulate(dead[::-1])[::-1] - np.arange(n)) if n else left
        power, places, kinds, hashes = {1: self.vocab[self.codes]}, [], [], []
        for k in range(first, last + 1):
            length = LENGTHS[k - 1]
            if k == 1:  # of each symbol its first and last place
                head, tail = np.empty(len(self.vocab), np.int64), np.empty(len(self.vocab), np.int64)
                head[self.codes[::-1]] = np.arange(n)[::-1]
                tail[self.codes] = np.arange(n)
                seen = np.zeros(n, bool)
                seen[head] = seen[tail] = True
                at = np.flatnonzero(seen)
            else:
                at = np.flatnonzero(left >= length - max(0, known - 1))
            if not len(at):
                break
            while 2 * max(power) <= length:
                m = max(power)
                h = np.zeros(n, np.uint64)
                h[: n - m] = (power[m][: n - m] * np.uint64(0x9E3779B97F4A7C15)) ^ (power[m][m:] + np.uint64(m))
                h ^= h >> np.uint64(29)
                power[2 * m] = h * np.uint64(0xBF58476D1CE4E5B9)
            h, done = np.full(len(at), length, np.uint64), 0
            while done < length:
                m = 1 << ((length - done).bit_length() - 1)
                h = (h ^ power[m][at + done]) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
                done += m
            places.append(at)
            kinds.append(np.full(len(at), k, np.uint8))
            hashes.append(mix(h, 51))
        if not places:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64), none, none, none
        places, kinds, hashes = np.concatenate(places), np.concatenate(kinds), np.concatenate(hashes)
        order, sort = ordered(hashes)
        start = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]]))
        bucket = ((sort[start] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        return places, kinds, order, sort[start], np.diff(np.append(start, len(sort))), cuts, bucket[cuts]

    def spread(self, places: np.ndarray) -> np.ndarray:
        """Text of each place."""
        return np.repeat(self.owner, np.diff(self.bounds))[places]


def gram_batches(first: int, last: int, buckets: int):
    """Different grams of each slice, by bucket."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice(batch, i)
                places, _, order, hashes, counts, cuts, bucket = s.grams(first, last, buckets)
                if not len(cuts):
                    continue
                text, start = s.spread(places), np.cumsum(counts) - counts
                both = text[order[start]] != text[order[start + counts - 1]]  # equal hashes are in order of place
                ends, shift = np.append(cuts, len(hashes)), np.uint64(max(0, 64 - KEY - (buckets - 1).bit_length()))
                high = hashes >> shift  # so many bits and the bucket's; steps from one to the next take less
                high[1:] -= high[:-1].copy()
                high[cuts] = hashes[cuts] >> shift & LOWKEY
                high &= LOWKEY
                blobs = [pack(high[a:b], 6) for a, b in zip(ends[:-1], ends[1:])]
                flags = [np.packbits(both[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([batch.column("slice")[i].as_py()] * len(cuts), pa.int64()), pa.array(blobs, pa.binary()), pa.array(flags, pa.binary())], names=["bucket", "slice", "grams", "both"])

    return step


def shared_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Which grams of each bucket two texts have; rows come sorted by bucket."""

    def answer(bucket: int, rows: list[tuple[int, memoryview, memoryview]]) -> pa.RecordBatch:
        steps = [unpack(g, "<u8", 6) for _, g, _ in rows]
        size = [len(x) for x in steps]
        gram = np.concatenate([np.cumsum(x) for x in steps]) & LOWKEY
        good = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for (_, _, f), n in zip(rows, size)]).astype(bool)
        order, sort = ordered(gram << np.uint64(64 - KEY))
        start = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]]))
        count = np.diff(np.append(start, len(sort)))
        shared = (count > 1) | np.logical_or.reduceat(good[order], start)
        good[order] = np.repeat(shared, count)
        ends = np.concatenate([[0], np.cumsum(size)])
        bits = [np.packbits(good[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
        columns = {"kind": pa.array([BITS] * len(rows), pa.int32()), "slice": pa.array([s for s, _, _ in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "bits": pa.array(bits, pa.binary())}
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(rows), f.type)) for f in FIELDS], schema=FIELDS)

    now, rows = None, []
    for batch in batches:
        buckets, slices = batch.column("bucket").to_pylist(), batch.column("slice").to_pylist()
        for i, (bucket, s) in enumerate(zip(buckets, slices)):
            if bucket != now and rows:
                yield answer(now, rows)
                rows = []
            now = bucket
            rows.append((s, *(memoryview(batch.column(c)[i].as_buffer()) for c in ("grams", "both"))))
    if rows:
        yield answer(now, rows)


def by_slice(batches: Batches) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, int]]]]:
    """Slices with their rows; rows come sorted by slice."""
    now, rows = None, []
    for batch in batches:
        for i, s in enumerate(batch.column("slice").to_pylist()):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append((batch, i))
    if rows:
        yield now, rows


def level_batches(first: int, last: int, buckets: int):
    """Enter the answers, put down the lengths and keep the stretches that are shared; a run ends before its stretch does, as lengths are above 1."""

    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for number, rows in by_slice(batches):
            (batch, i), *answers = rows
            s = Slice(batch, i)
            places, kinds, order, hashes, counts, cuts, bucket = s.grams(first, last, buckets)
            if [b.column("bucket")[k].as_py() for b, k in answers] != bucket.tolist():
                raise ValueError("a slice's grams and their answers differ")
            size = np.diff(np.append(cuts, len(hashes)))
            if len(size):
                bits = np.concatenate([np.unpackbits(np.frombuffer(b.column("bits")[k].as_buffer(), np.uint8), count=n) for (b, k), n in zip(answers, size)])
                good = np.zeros(len(places), bool)
                good[order[np.repeat(bits.astype(bool), counts)]] = True
                if first == 1:
                    alone = np.zeros(len(s.vocab), np.uint8)
                    alone[s.codes[places[good & (kinds == 1)]]] = 1
                    s.level = alone[s.codes]
                s.level[places[good]] = kinds[good]  # longer grams come last
            yield row(kind=DONE, slice=number, bucket=last, n=len(s.codes), bounds=s.bounds, at=s.at, level=pack(s.level, 1))
            live = np.concatenate([[0], (s.level == last).astype(np.int8), [0]])
            begin, end = np.flatnonzero(np.diff(live) == 1), np.flatnonzero(np.diff(live) == -1)
            length, more = LENGTHS[last - 1], LENGTHS[last] - LENGTHS[last - 1]
            long = end - begin > more
            begin, size = begin[long], (end - begin)[long] + length - 1
            if not len(begin):
                continue
            piece = np.searchsorted(s.bounds, begin, side="right") - 1
            at = spans(begin, size)
            vocab, codes = numbered(s.vocab[s.codes[at]])
            yield row(kind=LIVE, slice=number, bucket=-1, n=len(at), bounds=np.concatenate([[0], np.cumsum(size)]).astype(np.int64), at=s.at[piece] + begin - s.bounds[piece], owner=s.owner[piece], vocab=pack(vocab, 6), codes=pack(codes, 4), level=pack(s.level[at], 1))

    return step


def parse_batches(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Phrases of each text; a slice's row with the keys comes before those with lengths."""
    length = np.array([0, *LENGTHS], np.int64)
    for _, ((batch, i), *found) in by_slice(batches):
        take = lambda b, k, name, kind: np.frombuffer(b.column(name)[k].as_buffer(), kind)
        keys, own, bounds = take(batch, i, "keys", "<i8").reshape(-1, 4), take(batch, i, "own", "<i8"), take(batch, i, "bounds", "<i8")
        level = np.zeros(int(bounds[-1]), np.uint8)
        for b, k in found:
            at = spans(take(b, k, "at", "<i8"), np.diff(take(b, k, "bounds", "<i8")))
            np.maximum.at(level, at, unpack(memoryview(b.column("level")[k].as_buffer()), "u1", 1))
        after = memoryview(np.arange(len(level)) + np.maximum(length[level], 1))
        count = np.zeros(len(own), np.int64)
        for t, (at, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            n = 0
            while at < end:
                at = after[at]
                n += 1
            count[t] = n
        columns = [*(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(4)), pa.array(np.diff(bounds)), pa.array(count), pa.array(own)]
        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "rows", "n_bytes", "n_symbols", "phrases", "own_phrases"])


class Tables:
    """Tables in the folder that the executors share, removed when they are used up."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.folder = f"{shared_dir(self.spark)}/crossparse-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> None:
        written(df, f"{self.folder}/{name}", "kind")

    def read(self, name: str, kind: int) -> DataFrame:
        """Rows of one kind; none if there are none."""
        path = f"{self.folder}/{name}/kind={kind}"
        if not self._fs(path).exists(self._path(path)):
            return self.spark.createDataFrame([], ROW)
        inner = ", ".join(x for x in ROW.split(", ") if not x.startswith("kind "))
        return self.spark.read.schema(inner).parquet(path).select(F.lit(kind).alias("kind"), *NAMES[1:])

    def drop(self, name: str, kind: int) -> None:
        path = f"{self.folder}/{name}/kind={kind}"
        self._fs(path).delete(self._path(path), True)

    def close(self) -> None:
        self._fs(self.folder).delete(self._path(self.folder), True)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())


def jobs() -> Iterator[tuple[int, int]]:
    yield from JOBS
    for first in range(JOBS[-1][1] + 1, len(LENGTHS) - 12, 12):
        yield first, first + 11


def phrase_counts(texts: DataFrame, tables: Tables) -> DataFrame:
    """k1, k2, rows, n_bytes, n_symbols, phrases, own_phrases of different texts (k1, k2, rows, text), from ``tables`` written on the way."""
    tables.keep(run(texts, ROW, sliced(SLICE), slice_batches), "0")
    name, done = "0", []
    for number, (first, last) in enumerate(jobs(), 1):
        live = tables.read(name, LIVE)
        total = live.agg(F.sum("n")).first()[0]
        if total is None:
            break
        buckets = max(1, -(-total * (last - first + 1) // BUCKET))
        grams = run(live, "bucket long, slice long, grams binary, both binary", gram_batches(first, last, buckets))
        answers = run(grams.repartition("bucket").sortWithinPartitions("bucket"), ROW, shared_batches)
        placed = live.union(answers).repartition("slice").sortWithinPartitions("slice", "bucket")
        tables.keep(run(placed, ROW, level_batches(first, last, buckets)), str(number))
        tables.drop(name, LIVE)
        name = str(number)
        done.append(name)
    rows = tables.read("0", META)
    for name in done:
        rows = rows.union(tables.read(name, DONE))
    placed = rows.repartition("slice").sortWithinPartitions("slice", "bucket")
    return run(placed, "k1 long, k2 long, rows long, n_bytes long, n_symbols long, phrases long, own_phrases long", parse_batches)


def score_words(docs: DataFrame) -> DataFrame:
    """Phrase counts and scores of every document against all others."""
    text = F.coalesce("text", F.lit(""))
    key = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    texts = docs.select(*key, text.alias("text")).groupBy("k1", "k2").agg(F.count("*").alias("rows"), F.first("text").alias("text"))
    tables = Tables(texts)
    found = Store(docs.sparkSession, "phrases").keep(phrase_counts(texts, tables))
    tables.close()
    total = found.agg(F.coalesce(F.sum(F.col("rows") * F.col("n_symbols")), F.lit(0))).first()[0]
    others, least = F.lit(total) - F.col("n_symbols"), F.greatest("n_symbols", F.lit(1))
    phrases = F.when(F.col("rows") > 1, F.least("n_symbols", F.lit(1))).otherwise(F.col("phrases"))
    joined = docs.select("doc_id", *key).join(found, ["k1", "k2"]).withColumn("phrases", phrases).withColumn("reference_symbols", others)
    scored = (others > 0) | (F.col("n_symbols") == 0)
    cross = F.when(scored, F.col("phrases") * F.log2(F.greatest("reference_symbols", F.lit(2))) / least)
    own = F.col("own_phrases") * F.log2(F.greatest("own_phrases", F.lit(1))) / least
    return joined.select("doc_id", "n_bytes", "n_symbols", "phrases", "own_phrases", "reference_symbols", cross.alias("cross_bits"), (cross - own).alias("relative_bits"))
