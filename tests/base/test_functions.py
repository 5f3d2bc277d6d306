import difflib
import random
import unicodedata

from pyspark.sql import functions as F
from sftloom.functions import json as J
from sftloom.functions import minhash, registry, vector
from sftloom.functions import text as T

ODD = ["", "ab", "aaaaaab", "a a a a a a a", "x" * 40, "Is this İt? ΣΑΣ", " pad ", "a\x1cb c", "\U0001f600" * 7, "漢字漢字漢字", None, "¡olé! ≈ ≈ ≈", "one two three four five one two three four five"]


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_measures_equal_plain_python(spark):
    rnd = random.Random(1)
    texts = [t for t in ODD if t is not None] + ["".join(rnd.choices("ab c\nd!é漢\U0001f600", k=rnd.randrange(60))) for _ in range(150)]

    def repetition(t):
        w = t.lower().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return (len(grams) - len(set(grams))) / len(grams) if grams else 0.0

    def run(t):
        best = n = 0
        for i, c in enumerate(t):
            n = n + 1 if i and c == t[i - 1] else 1
            best = max(best, n)
        return best / len(t) if best >= 5 else 0.0

    def diversity(t, n=3):
        t = t.strip().lower()
        grams = [t[i : i + n] for i in range(len(t) - n + 1)]
        return len(set(grams)) / len(grams) if grams else 1.0

    assert values(spark, T.word_repetition_ratio("t"), texts) == [repetition(t) for t in texts]
    assert values(spark, T.char_repetition_ratio("t"), texts) == [run(t) for t in texts]
    assert values(spark, T.ngram_diversity("t"), texts) == [diversity(t) for t in texts]
    assert values(spark, T.special_char_ratio("t"), texts) == [registry._special(t) for t in texts]
    assert [sorted(set(v)) for v in values(spark, T.shingles("t"), texts)] == [sorted(set(minhash.tokens(t))) for t in texts]


def test_normalisation_golden(spark):
    given = ["﻿Hello​\r\n\r\n\r\n\r\nＡ\x00b\tc   \nfamily \U0001f468‍\U0001f469 ", "\n \nx \n \n\ny\n", "＃ title x"]
    want = ["Hello\n\nAb    c\nfamily \U0001f468‍\U0001f469", "x\n\ny", "# title x"]
    assert values(spark, T.normalize_text("t"), given) == want


def test_predicates(spark):
    refer = ["Summarise the passage above", "根据上文回答", "What is a passage?", "Use the provided article", None]
    assert values(spark, T.refers_to_context("t"), refer) == [True, True, False, True, None]
    assert values(spark, T.is_refusal("t"), ["Sorry, no", "I CAN'T", "fine", "As an AI model"]) == [True, True, False, True]
    assert values(spark, T.clean_evolved("t"), [' "a" ', "'b", "“c“", '"', "''x''"]) == ["a", "'b", "c", '"', "'x'"]
    assert values(spark, T.strip_fences("t"), ["```json\n{}\n```", "a ``` b", " ```\nx\n```\n"]) == ["{}", "a ``` b", "x"]
    assert values(spark, T.task_type("t"), [" QA ", "poem", None]) == ["qa", "other", "other"]
    assert values(spark, T.fingerprint("t"), ["A b ", "a B"])[0] == values(spark, T.fingerprint("t"), ["A b ", "a B"])[1]
    rows = spark.createDataFrame([("copy of the source text here", "the source text is here"), (None, "x"), ("", "x")], "a string, b string")
    got = [r.v for r in rows.select(T.copied_ratio("a", "b").alias("v")).collect()]
    a, b = "copy of the source text here", "the source text is here"
    assert got == [difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b)).size / len(a), 0.0, 0.0]
    assert unicodedata.unidata_version


def test_minhash_is_exact(spark):
    texts = ["hello world", "hello there world", "", "ab"]
    got = minhash.signatures([minhash.tokens(t) for t in texts], 16, 42)
    a, b = minhash.coefficients(16, 42)
    for t, s in zip(texts, got):
        for k in range(16):
            hashes = [(int(a[k]) * minhash.token_hash(x, 42) + int(b[k])) % minhash.PRIME for x in minhash.tokens(t)]
            assert int(s[k]) == min(hashes, default=0)
    df = spark.createDataFrame([([1, 2, 3], [1, 5, 3]), ([1], [1, 2]), ([], [])], "a array<long>, b array<long>")
    assert [r.v for r in df.select(minhash.minhash_similarity(F.col("a"), F.col("b")).alias("v")).collect()] == [2 / 3, 0.0, 0.0]


def test_json_and_vectors(spark):
    replies = ['```json\n{"a": "7", "b": 2, "c": null}\n```', "no json", 'text [{"a": 1}] text', '{"items": [{"x": 1}, {"x": 2}]}', "{broken"]
    assert values(spark, J.parse_scores("t", ["a", "b", "z"]), replies)[:3] == [{"a": 7.0, "b": 2.0}, None, {"a": 1.0}]
    assert values(spark, F.size(J.items("t")), replies) == [1, 1, 1, 2, 1]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.v for r in df.select(vector.cosine_similarity(F.col("a"), F.col("b")).alias("v")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1] is None


def test_sql_functions(spark):
    names = registry.register(spark)
    assert "minhash_signature" in names
    row = spark.sql("select ngram_diversity('aaaa') d, word_repetition_ratio('a a a a a a') w, char_repetition_ratio('bbbbbb') c, special_char_ratio('a≈') s, size(minhash_signature('abc')) n").first()
    assert tuple(row) == (0.5, 0.5, 1.0, 0.5, 128)
