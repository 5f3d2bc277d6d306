import math
import random

import numpy as np
import pytest
from sftloom.llm import crossparse as c
from sftloom.llm import zivmerhav as z

LEVELS = [*range(1, 17), 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128]


def words(text):
    """Symbols, one character at a time."""
    out, now = [], ""
    for ch in text:
        if ch.isascii() and ch.isalnum() or 0xC0 <= ord(ch) < 0x800:
            now += ch
            continue
        out += [now] * bool(now)
        now = ""
        if ch not in " \t\n\r\x0b\x0c":
            out.append(ch)
    return out + [now] * bool(now)


def brute(mine, others):
    """Greedy phrases; a phrase is the longest of ``LEVELS`` that another text holds."""
    grams = {n: {tuple(o[i : i + n]) for o in others for i in range(len(o) - n + 1)} for n in LEVELS}
    at = found = 0
    while at < len(mine):
        at += max([n for n in LEVELS if at + n <= len(mine) and tuple(mine[at : at + n]) in grams[n]], default=1)
        found += 1
    return found


def check(spark, docs, parts=3):
    got = c.score_words(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
    parsed = [words(t or "") for _, t in docs]
    want = []
    for k, (i, t) in enumerate(docs):
        mine, others = parsed[k], parsed[:k] + parsed[k + 1 :]
        total, n = sum(map(len, others)), max(1, len(mine))
        found = 1 if mine and any(t == u for j, (_, u) in enumerate(docs) if j != k) else brute(mine, others)
        cross = round(found * math.log2(max(2, total)) / n, 9) if total or not mine else None
        want.append((i, len((t or "").encode()), len(mine), found, lz78(mine), total, cross))
    assert sorted(((*r[:6], None if r.cross_bits is None else round(r.cross_bits, 9)) for r in got), key=str) == sorted(want, key=str)


def lz78(symbols):
    seen, phrase, n = set(), (), 0
    for w in symbols:
        phrase += (w,)
        if phrase not in seen:
            seen.add(phrase)
            n, phrase = n + 1, ()
    return n + bool(phrase)


def test_symbols():
    texts = ["q" * 5000, "q" * 5001, "abcdefgh", "abcdefghi", "abcdefghj", "", " ", "ab, c\td'é¿x 文字 a1 ß🙂z", "x", "ᚠᚡ q", "\xa0b\x00c"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    hashes, bounds = c.symbols(raw, ends)
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len({(h, w) for h, w in zip(hashes.tolist(), flat)}) == len(set(hashes.tolist())) == len(set(flat))


def test_query_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(c, "SLICE", 3000)
    monkeypatch.setattr(c, "BUCKET", 500)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").limit(50).collect()]
    long = "v w " * 30 + " ".join(f"w{i % 37}" for i in range(150))
    docs += [(None, None), (None, None), (-2, ""), (-3, " \n"), (-4, docs[0][1]), (-4, docs[0][1]), (-5, "ᚠᚡ 文 é"), (-6, long), (-7, long + " end"), (-8, "start " + long[:400]), (-9, "文 é, x")]
    check(spark, docs)


def test_random_mosaics(spark, monkeypatch):
    monkeypatch.setattr(c, "SLICE", 400)
    monkeypatch.setattr(c, "BUCKET", 100)
    rnd = random.Random(4)
    base = [rnd.choice("abc") + rnd.choice("xy") for _ in range(160)]
    docs = []
    for i in range(25):
        a, b = sorted(rnd.sample(range(160), 2))
        c_, d = sorted(rnd.sample(range(160), 2))
        docs.append((i, " ".join(base[a:b] + [f"z{rnd.randrange(9)}"] * rnd.randrange(2) + base[c_:d])))
    check(spark, docs, 2)


def test_matches_of_up_to_16_equal_the_automaton():
    """Longest matches of a suffix automaton over the other texts."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcd", k=60)) for _ in range(8)]
    for k, t in enumerate(texts):
        others = [u.encode() for j, u in enumerate(texts) if j != k]
        raw = np.frombuffer(t.encode(), np.uint8)
        assert z.Reference(others).phrases(raw, np.array([0, len(raw)])).tolist() == [brute(list(t), [list(u.decode()) for u in others])]


@pytest.mark.parametrize("docs", [[(1, "abc d"), (2, None)], [(7, "a b")], [(7, ""), (8, "")]])
def test_without_reference_there_is_no_score(spark, docs):
    check(spark, docs, 1)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert c.score_words(empty).count() == 0 and ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in c.score_words(empty).dtypes) == c.SCHEMA
    odd = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")], "doc_id long, text string, k1 int, rows string")
    assert [(r.phrases, r.reference_symbols) for r in c.score_words(odd).collect()] == [(1, 2)] * 2
