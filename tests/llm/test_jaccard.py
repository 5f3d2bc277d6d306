import random
import re

import numpy as np
import pyarrow as pa
import pytest
from sftloom.llm import jaccard


def plain(text):
    words = [w for w in re.split(r"[^0-9a-zA-Z\x80-\U0010ffff]+", (text or "").lower()) if w]
    if not words:
        return {("raw", text or "")}
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def expected(docs, threshold=0.5):
    """class, links and copies of each row, by comparing all pairs of different sets."""
    texts = {}
    for _, t in docs:
        texts.setdefault(frozenset(plain(t)), set()).add(t or "")
    sets = list(texts)
    linked = {a: {b for b in sets if b is not a and len(a & b) >= threshold * len(a | b)} for a in sets}
    root = {}
    for a in sets:
        todo = [a] if a not in root else []
        while todo:
            b = todo.pop()
            if b not in root:
                root[b] = a
                todo += linked[b]
    ids = {}
    for i, t in docs:
        if i is not None:
            ids.setdefault(root[frozenset(plain(t))], []).append(i)
    out = []
    for i, t in docs:
        s = frozenset(plain(t))
        links = len(texts[s]) - 1 + sum(len(texts[b]) for b in linked[s])
        out.append((i, min(ids.get(root[s], [None]), default=None), links, sum(frozenset(plain(x)) == s for _, x in docs) - 1))
    return sorted(out, key=str)


def family(rnd, size, copies, rate):
    base = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(300)) for _ in range(size)]
    return [" ".join(rnd.choice(["new", "word"]) + str(rnd.randrange(999)) if rnd.random() < rate else w for w in base) for _ in range(copies)]


def test_sets_and_sketches():
    rnd = random.Random(1)
    texts = ["a b c d", "A, b; c d!", "", None, "x", "x y", "!!", "!?", "a b c a b c a b c", "é B ü d", "q " * 1000]
    texts += ["".join(rnd.choices("ab, \n!é漢", k=rnd.randrange(30))) for _ in range(2000)] + family(rnd, 200, 20, 0.05)
    values, ends = jaccard.shingles(pa.array(texts))
    want = [frozenset(plain(t)) for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in want]
    names = [bytes(k) for k in jaccard.keys(values, ends)]
    assert len(set(names)) == len(set(want)) == len(set(zip(names, want)))
    sketch = jaccard.sketches(values, ends)
    for i in range(len(texts) - 20, len(texts) - 1):
        truth = len(want[i] & want[i + 1]) / len(want[i] | want[i + 1])
        assert abs((sketch[i] == sketch[i + 1]).mean() - truth) < 0.2
        same = jaccard.similar([values[ends[k] : ends[k + 1]] for k in (i, i + 1)], truth)
        assert same[0, 1] and not jaccard.similar([values[ends[k] : ends[k + 1]] for k in (i, i + 1)], truth + 0.01)[0, 1]


def rows_of(rnd):
    texts = [t for _ in range(12) for t in family(rnd, rnd.choice([8, 60, 200]), rnd.choice([1, 2, 5]), rnd.choice([0.02, 0.08]))]
    texts += family(rnd, 150, 70, 0.04)
    shared = " ".join(f"common{i}" for i in range(60))
    texts += [shared + " " + t for t in family(rnd, 150, 1, 0) + family(rnd, 160, 1, 0) + family(rnd, 170, 1, 0)]
    texts += [None, "", "", "!!", "one", "one", "ONE", "one two", texts[0], texts[0] + "!", texts[0].upper()]
    docs = list(enumerate(texts))
    return docs + [(None, texts[3]), (None, "lonely words of a row without id"), (5, texts[5])]


@pytest.mark.parametrize("limit,block", [(8, 16)])
def test_equals_all_pairs(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = rows_of(random.Random(limit))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, node string, size int").repartition(3)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == expected(docs)


def test_joining_the_scan_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COLLECTED", 0)
    docs = rows_of(random.Random(3))[-40:]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str) == expected(docs)


def test_recall_on_the_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(want)
    assert sum(g[1] == w[1] for g, w in zip(got, want)) >= 0.99 * len(want)
    assert sum(g[2] for g in got) >= 0.99 * sum(w[2] for w in want)


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(f"{a:03d}".encode(), f"{a + 1:03d}".encode()) for a in range(40)] + [(b"100", b"1%02d" % i) for i in range(1, 30)] + [(b"200", b"200")]
    rnd.shuffle(edges)
    got = dict(tuple(bytes(x) for x in r) for r in jaccard.components(spark.createDataFrame(edges, "u binary, v binary"), lambda d: d.checkpoint()).collect())
    assert got == {**{f"{a:03d}".encode(): b"000" for a in range(41)}, **{b"1%02d" % i: b"100" for i in range(30)}}


def test_recall_of_deep_splits():
    """Pairs at the threshold, split as often as buckets can be."""
    rnd, pairs = np.random.default_rng(5), 3000
    left, right = rnd.integers(0, 2**32, (2, pairs, jaccard.SKETCH), dtype=np.uint32)
    sketch = np.concatenate([left, np.where(rnd.random(left.shape) < 0.5, left, right)])
    nodes = np.stack([np.arange(2 * pairs, dtype=np.uint64)] * 2, 1)
    batch = pa.RecordBatch.from_arrays([jaccard.fixed(nodes, 16), jaccard.fixed(sketch, 4 * jaccard.SKETCH)], names=["node", "sketch"])
    seeds = list(range(jaccard.runs_for(0.5, 0.99)))
    for level in range(jaccard.LEVELS):
        rows = list(jaccard.split_batches(None if level else seeds, 0.5)(iter([batch])))
        bucket = np.concatenate([r.column("bucket").to_numpy() for r in rows])
        node = np.concatenate([jaccard.unfixed(r.column("node"), "<u8", 2)[:, 0] for r in rows]).astype(np.int64)
        found = np.unique(np.stack([bucket, node % pairs, node], 1), axis=0)
        both = np.flatnonzero((found[1:, :2] == found[:-1, :2]).all(1))
        found = found[np.concatenate([both, both + 1])]
        at = found[:, 2]
        batch = pa.RecordBatch.from_arrays([pa.array(found[:, 0]), jaccard.fixed(nodes[at], 16), jaccard.fixed(sketch[at].astype("<u2"), 2 * jaccard.SKETCH)], names=["bucket", "node", "sketch"])
    assert len(set((found[:, 1]).tolist())) >= 0.987 * pairs


def test_groups_past_2_gib_keep_all_rows():
    big = pa.array([b"\0" * 1_100_000_000], pa.binary())
    rows = [pa.RecordBatch.from_arrays([pa.array([7]), pa.array([i]), big], names=["cluster", "row", "tokens"]) for i in range(3)]
    found = list(jaccard.groups(iter(rows), ["cluster"]))
    assert [(b.column("row").to_pylist(), bounds.tolist()) for b, bounds in found] == [([0, 1, 2], [0, 3])]


def test_tiles_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILED", 4096)
    seen = []
    whole = jaccard.tiles
    monkeypatch.setattr(jaccard, "tiles", lambda members, key, size, block: seen.append((key, members)) or whole(members, key, size, block))
    docs = list(enumerate(family(random.Random(6), 200, 12, 0.03)))
    got = sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == expected(docs)
    members = next(m for key, m in seen if key == "cluster").collect()
    assert len(members) == 12 and {m["size"] for m in members} == {-(-sum(8 * len(m.tokens) // 8 for m in members) // 4096) * jaccard.BLOCK}
