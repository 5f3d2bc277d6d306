import math
import random

import numpy as np
from pyspark.sql import functions as F
from sftloom.llm import zivmerhav as z


def brute(text, segments):
    """Longest matches by substring search."""
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and any(text[at : at + size + 1] in s for s in segments):
            size += 1
        at += max(1, size)
        n += 1
    return n


def lz78(text):
    seen, phrase, n = set(), b"", 0
    for i in range(len(text)):
        phrase += text[i : i + 1]
        if phrase not in seen:
            seen.add(phrase)
            n, phrase = n + 1, b""
    return n + bool(phrase)


def test_parsing_equals_brute_force(monkeypatch):
    rnd = random.Random(1)
    for trial in range(30):
        segments = [bytes(rnd.choices(b"abcd\xc3\xa9", k=rnd.randrange(1, 60))) for _ in range(rnd.randrange(4))]
        texts = [bytes(rnd.choices(b"abcdx\xc3\xa9", k=rnd.randrange(80))) for _ in range(60)] + [b"", b"a" * 300]
        want = [brute(t, segments) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        for most in (z.LARGEST, 0):  # the table, and the plain automaton
            monkeypatch.setattr(z, "LARGEST", most)
            assert z.Reference(segments).phrases(raw, ends).tolist() == want
        monkeypatch.undo()
        assert [z.own_phrases(t) for t in texts] == [lz78(t) for t in texts]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "substring(text, 1, 400) as text", "1 as h", "'x' as shard").limit(60)
    odd = spark.createDataFrame([(None, None, 1, "x"), (-2, "", 1, "x"), (-3, "q" * 20000, 1, "x"), (-3, "q" * 20000, 1, "x")], "doc_id long, text string, h int, shard string")
    all_ = spark.createDataFrame(docs.union(odd).collect(), docs.schema)
    every, size = 4, 2048
    shards = z.shards_of(all_, every, size)
    assert shards > 2
    rows = z.with_reference(all_, shards, every).collect()
    refs, homes = {}, {}
    for r in rows:
        if r.kind == 0:
            refs.setdefault(r.shard, []).append(r.text.encode())
    for r in rows:
        if r.kind == 1:
            homes.setdefault((r.doc_id, r.text), r.shard)
    own = {(r.doc_id, r.shard) for r in rows if r.kind == 0}
    assert own and not own & {(k[0], s) for k, s in homes.items()}  # no text meets its own segments
    got = z.score_corpus(all_, every, size)
    assert got.count() == all_.count()
    texts = {r.doc_id: r.text or "" for r in all_.collect()}
    for r in got.collect():
        text = texts[r.doc_id].encode()
        segments = refs.get(homes[(r.doc_id, texts[r.doc_id])], [])
        assert (r.n_bytes, r.phrases, r.own_phrases) == (len(text), brute(text, segments), lz78(text))
        n, total = max(1, len(text)), sum(map(len, segments))
        cross = r.phrases * math.log2(max(2, total)) / n
        assert math.isclose(r.cross_bits, cross) and math.isclose(r.relative_bits, cross - r.own_phrases * math.log2(max(1, r.own_phrases)) / n, abs_tol=1e-12)
    assert z.score_corpus(all_.limit(0)).count() == 0


def test_reference_grows_and_scores_tell_texts_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = lambda df: z.with_reference(df, 4, 8).where("kind = 0").agg(F.sum(F.octet_length("text"))).first()[0]
    assert size(docs) > 2 * size(docs.where("doc_id % 4 = 0"))
    rnd = random.Random(2)
    noise = spark.createDataFrame([(-i - 1, "".join(rnd.choices("qxzjkvw#~^", k=2000))) for i in range(5)], "doc_id long, text string")
    rows = z.score_corpus(docs.select("doc_id", "text").union(noise), every=16).where("n_bytes > 500").collect()
    strange = [r.cross_bits for r in rows if r.doc_id < 0]
    usual = sorted(r.cross_bits for r in rows if r.doc_id >= 0)
    assert min(strange) > usual[int(len(usual) * 0.95)]
