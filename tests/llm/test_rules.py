import random
import re

import numpy as np
import pyarrow as pa
from sftloom.llm import rules

SCHEMA = "doc_id long, text string, n_words long, kept string"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows, hit, seen, dup = {}, set(), set(), 0
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            hit.update(i + k for i in places for k in range(3))
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def counts(texts):
    c = rules.base_counts(pa.array(texts, pa.string()).fill_null(""))
    return list(zip(*[c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]))


def test_base_counts_equal_brute_force():
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("ab \n\t#é|\r\x1c漢", k=rnd.randrange(40))) for _ in range(2000)]
    texts += ["", "\n", "a\na", "a\na\n", None, "\n\na\n", "x " * 4000, "y" * 50000]
    assert counts(texts) == [brute(t) for t in texts]
    for texts in ([""] * 3, [None], ["a b c a b c"], []):
        assert counts(texts) == [brute(t) for t in texts]


def test_any_number_of_different_words():
    text = " ".join(map(str, range((1 << 21) + 5))) + " a b c d a b c 5 6 7"
    assert counts(["x y z x y z", text])[1][4] == 12 and counts(["x y z x y z", text])[0][4] == 6
    rnd = np.random.default_rng(1)
    code, doc = rnd.integers(0, 6, 3000).astype(np.uint64), np.sort(rnd.integers(0, 40, 3000))
    assert rules.repeats(code << np.uint64(28), doc, 40).tolist() == rules.repeats(code, doc, 40).tolist()


def test_slices_and_scores_do_not_depend_on_neighbours():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["aa", "bé", "c!", "dd\n"], k=rnd.randrange(90))) for _ in range(300)]
    y = np.array([float("c!" not in t) if i % 2 else 1.0 for i, t in enumerate(texts)])
    y[:3] = 0
    model = rules.fit(pa.array(texts), y, steps=10)
    whole = model.probability(pa.array(texts))
    alone = np.concatenate([model.probability(p) for p in rules.pieces(pa.array(texts), 200)])
    assert np.allclose(whole, alone)
    assert sum(len(p) for p in rules.pieces(pa.array(texts), 200)) == len(texts)


def test_one_kind_of_label_gives_the_rate():
    model = rules.fit(pa.array(["a b", "c d"]), np.ones(2))
    assert np.allclose(model.probability(pa.array(["", "x y z"])), 0.75)
    assert np.allclose(rules.fit(pa.array([], pa.string()), np.zeros(0)).probability(pa.array(["q"])), 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = rules.fit_rules(docs, labels.where("doc_id % 4 != 0"))
    rows = rules.apply_rules(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").where("not base_failed").collect()
    assert len(rows) > 50 and sum((r.probability >= 0.5) == bool(r.quality) for r in rows) / len(rows) > 0.93


def test_query_shape(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, 1, "x"), (-2, "", 1, "x"), (-3, "w " * 60, 1, "x"), (-3, "w " * 60, 1, "x")], SCHEMA)
    all_ = docs.selectExpr("doc_id", "text", "1L as n_words", "'x' as kept").union(odd)
    rows = rules.apply_rules(all_, rules.fit_rules(docs, labels)).collect()
    texts = {r.doc_id: r.text for r in all_.collect()}
    assert len(rows) == docs.count() + 4
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.apply_rules(docs.limit(0), rules.fit_rules(docs, labels.limit(0))).count() == 0
