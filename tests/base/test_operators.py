import random

import numpy as np
from pyspark.sql import functions as F
from sftloom.functions import minhash
from sftloom.functions import text as T
from sftloom.operators import chunking, dedup, profile, quality, reshape, scoring


def test_exact_dedup_keeps_the_first(spark):
    rows = [(3, "A"), (1, " a"), (2, "b"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "_ord long, text string")
    assert sorted(r._ord for r in dedup.exact_dedup(df, T.fingerprint("text")).collect()) == [1, 2, 4]


def greedy(n, similar):
    kept = []
    for j in range(n):
        if not any(similar(i, j) for i in kept):
            kept.append(j)
    return kept


def test_greedy_survivors_equal_the_loop(spark):
    rnd = random.Random(2)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(20)}
    nodes = spark.range(60).withColumnRenamed("id", "_ord")
    got = dedup.greedy_survivors(nodes, spark.createDataFrame(sorted(edges), "i long, j long"))
    assert sorted(r._ord for r in got.collect()) == greedy(60, lambda i, j: (i, j) in edges)


def test_minhash_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcdefgh ", k=120)) for _ in range(12)]
    texts = [b[:k] + rnd.choice("xyz") + b[k + 1 :] for b in base for k in rnd.sample(range(110), 3)] + base + [base[0], "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "_ord long, text string")
    signed = minhash.signatures([minhash.tokens(t) for t in texts], 128, 42)
    want = greedy(len(texts), lambda i, j: (signed[i] == signed[j]).mean() >= 0.7)
    for lsh in (False, True):
        got = dedup.MinHashDedup(use_lsh=lsh)(df, F.col("text"))
        assert sorted(r._ord for r in got.collect()) == want


def test_semantic_pairs_exact_and_by_planes(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(20, 16))
    vectors = np.concatenate([base, base + rnd.normal(scale=0.05, size=base.shape), np.zeros((1, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "_ord long, v array<double>")
    want = {(i, i + 20) for i in range(20)}
    for exact in (True, False):
        assert {(r.i, r.j) for r in dedup.semantic_pairs(df, 0.95, exact).collect()} == want
    assert dedup.SemanticDedup(0.95, "v")(df).count() == 21


def test_rules(spark):
    rows = [("Tell me", "word " * 40), ("Tell me", "Plain and varied enough answer, is it not?"), ("x", "long enough text"), ("Tell me", "≈≈≈≈≈≈≈≈≈≈≈≈ab"), ("Tell me", "aaaaaaaaaaaaaaaaaaa b")]
    df = spark.createDataFrame(rows, "instruction string, output string")
    assert [r.output for r in quality.apply_rules(df, quality.cleaner_rules()).collect()] == [rows[1][1]]
    repeated = spark.createDataFrame([("Tell me", "the same phrase " * 30)], "instruction string, output string")
    assert quality.apply_rules(repeated, quality.NgramDiversityRule(0.3)).count() == 0
    pairs = spark.createDataFrame([("longer question", "question"), ("question", "question"), ("sorry", "question"), ("q" * 99, "question"), ("", "question")], "e string, o string")
    assert [r.v for r in pairs.select(quality.evolution_is_valid(F.col("e"), F.col("o")).alias("v")).collect()] == [True, False, False, False, False]
    back = spark.createDataFrame([("What is this about, in a long enough question?", "Source."), ("Use the text above.", "Source."), ("This is the very source text, all of it copied.", "This is the very source text, all of it copied. And more."), ("short copy", "short copy here")], "i string, s string")
    assert [r.v for r in back.select(quality.backtranslation_is_valid(F.col("i"), F.col("s")).alias("v")).collect()] == [True, False, False, True]


def test_distribution_and_histogram(spark):
    rnd = random.Random(5)
    values = [rnd.randrange(40) for _ in range(203)]
    df = spark.createDataFrame([(v, v % 2) for v in values] + [(None, 0)], "v int, k int").repartition(4)
    for key in (0, 1):
        s = sorted(v for v in values if v % 2 == key)
        n = len(s)
        r = next(r for r in profile.distribution(df, "v", ["k"]).collect() if r.k == key)
        want = (n, s[0], s[-1], sum(s) / n, (s[(n - 1) // 2] + s[n // 2]) / 2, s[n // 4], s[3 * n // 4], s[9 * n // 10], s[95 * n // 100])
        assert tuple(r)[1:] == want
    four = profile.distribution(spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int"), "v").first()
    assert (four.p25, four.median) == (2, 2.5)
    bars = profile.histogram(spark.createDataFrame([(float(x),) for x in range(100)] + [(None,)], "v double"), "v", 10).orderBy("bin").collect()
    assert [b["count"] for b in bars] == [10] * 10
    assert [b["count"] for b in profile.histogram(spark.createDataFrame([(3,)] * 4, "v int"), "v").collect()] == [4]
    assert profile.histogram(spark.createDataFrame([], "v int"), "v").count() == 0


def test_frequency_ties_and_summary(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")], "_ord long, topic string")
    assert [r.topic for r in profile.frequency(df, "topic").collect()] == ["b", "a", "c"]
    assert [r.topic for r in profile.frequency(df, "topic", top=1).collect()] == ["b"]
    assert profile.retention(8, 2) == 0.8


def test_judges(spark):
    rows = [(1, "a", {"q": 5.0, "x": 1.0}), (1, "b", {"q": 3.0}), (2, "a", {"q": 5.0}), (2, "b", None), (3, "a", None), (3, "b", None)]
    df = spark.createDataFrame(rows, "_ord long, judge string, scores map<string,double>")
    got = {r._ord: r for r in scoring.aggregate_judges(df, min_judges=2).collect()}
    assert (got[1].scores, got[1].total_score, got[1].judge_disagreement, got[1].judge_count) == ({"q": 4.0, "x": 1.0}, 5.0, 2.0, 2)
    assert got[2].cross_validation_failed and got[2].total_score == 0 and got[2].scores == {}
    assert got[3].judge_count == 0 and got[3].cross_validation_failed
    kept = quality.score_filter(scoring.aggregate_judges(df), 4.0, 1.0)
    assert [r._ord for r in kept.collect()] == [2]
    assert quality.score_filter(df, 0.0, 1.0) is df
    assert scoring.default_rubric(10)[0].startswith("10-8") and len(scoring.default_rubric(3)) == 4


def test_chunking(spark):
    config = chunking.Chunking(min_length=10, max_length=40)
    blocks = "First block of text.\n\nSecond block.\n\n\n" + "One sentence here. Another sentence follows! And a third one? " + "z" * 90
    for c in chunking.chunk(blocks, config):
        assert 0 < len(c) <= 40
    assert "".join(chunking.chunk(blocks, config)).replace(" ", "").replace("\n", "") == blocks.replace(" ", "").replace("\n", "")
    vectors = {"aaa aaa": [1, 0], "bbb bbb": [0.9, 0.1], "ccc ccc": [0, 1]}
    semantic = chunking.Chunking("semantic", 1, 100, 0.8)
    assert chunking.chunk("aaa aaa\n\nbbb bbb\n\nccc ccc", semantic, lambda t: [vectors[x] for x in t]) == ["aaa aaa\n\nbbb bbb", "ccc ccc"]
    assert chunking.chunk("long enough\n\nx", chunking.Chunking(min_length=5, max_length=30)) == ["long enough\n\nx"]
    assert chunking.chunk(None, config) == [] and chunking.chunk(" \n ", config) == []
    df = spark.createDataFrame([("d1", blocks, "t"), ("d2", "short", "t"), ("d3", None, "t")], "id string, text string, title string")
    rows = chunking.chunk_documents(df, config).collect()
    assert {r.id for r in rows if r.source_id == "d1"} == {f"d1:chunk-{i}" for i in range(rows[0].chunk_count)} and [r.id for r in rows if r.source_id == "d2"] == ["d2"]


def test_shapes(spark):
    messages = [dict(content=c, role=r) for r, c in (("system", "s"), ("user", "u1"), ("tool", "t"), ("assistant", "a1"), ("user", None))]
    df = spark.createDataFrame([(1, messages), (2, [dict(content="only", role="system")])], f"_ord long, messages {reshape.MESSAGES}")
    (row,) = reshape.normalize_messages(df).collect()
    assert (row.instruction, row.output, row.system) == ("u1\n", "a1", "s")
    shared = reshape.format_records(df.where("_ord = 1"), "sharegpt").first().record.conversations
    assert [c["from"] for c in shared] == ["system", "human", "gpt", "human"]
    flat = spark.createDataFrame([("i", "o", "sys")], "instruction string, output string, system string")
    assert [m.role for m in reshape.format_records(flat, "chatml").first().record.messages] == ["system", "user", "assistant"]
    assert reshape.format_records(flat).first().record.instruction == "i"
    mapped = reshape.map_fields(spark.createDataFrame([("q", "a", "z")], "question string, answer string, extra string"), dict(question="instruction", answer="output"))
    assert mapped.columns == ["instruction", "output"]
    back = reshape.rebuild_messages(df.where("_ord = 1")).first()
    assert [m.content for m in back.messages] == ["s", "u1", "t", "a1", None]
