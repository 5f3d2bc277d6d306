import math
import random

import numpy as np
from sftloom.llm import suffixes
from sftloom.llm import zivmerhav as z

from test_zivmerhav import brute, lz78


def test_longest_matches_equal_brute_force():
    rnd = random.Random(3)
    for trial in range(20):
        base = bytes(rnd.choices(b"abc", k=300))
        texts = [bytes(rnd.choices(b"ab\xc3\xa9", k=rnd.randrange(50))) for _ in range(9)] + [b"", b"a" * 90, b"a" * 200, base, base[:150] + b"x" + base[150:], base]
        size = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(size + 1)])
        raw = np.frombuffer(b"".join(t + b"\xff" for t in texts) + b"\xff" * suffixes.PAD, np.uint8)
        doc = np.repeat(np.arange(len(texts)), size)
        pos = np.concatenate([np.arange(n) + s for n, s in zip(size, starts)])
        got = suffixes.elsewhere(raw, pos, doc, starts[doc + 1] - 1 - pos)
        for p, d, n in zip(pos, doc, got.tolist()):
            tail = texts[d][p - starts[d] :]
            others = [t for k, t in enumerate(texts) if k != d]
            assert (n == 0 or any(tail[:n] in t for t in others)) and (n == len(tail) or not any(tail[: n + 1] in t for t in others))


def test_query_scores_against_all_other_texts(spark, sf, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST", 40)
    docs = [(r.doc_id, r.t) for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "substring(text, 1, 300) as t").limit(60).collect()]
    docs += [(None, None), (-2, ""), (-3, "q" * 3000), (-3, "q" * 3000), (-4, docs[0][1]), (-5, "ᚠᚡ 文")]
    got = z.score_corpus(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for k, (i, _) in enumerate(docs):
        others, t = texts[:k] + texts[k + 1 :], texts[k]
        total, n, found = sum(map(len, others)), max(1, len(t)), brute(t, others)
        want.append((i, len(t), found, lz78(t), total, round(found * math.log2(max(2, total)) / n, 9)))
    assert sorted(((*r[:5], round(r.cross_bits, 9)) for r in got), key=str) == sorted(want, key=str)


def test_without_reference_there_is_no_score(spark):
    rows = z.score_corpus(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.phrases, r.reference_bytes, r.cross_bits) for r in rows] == [(3, 0, None), (0, 3, 0.0)]
