import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sftloom.llm.arrow import data_path
from sftloom.llm.pieces import PieceModel, fields, round_trip

PATH = data_path("piece_bpe_32k.model")


def texts(seed):
    rnd = random.Random(seed)
    letters = "abcdetr  \n\t.,XYZ12éß漢字й\U0001f600▁<>/s"
    out = ["".join(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(1500)]
    return out + ["", None, "   ", " " * 70, "x" * 100, "a\n" + "y" * 200 + " b", "<s>hi</s>", "<0x41>", "the quick brown fox", "\n", "a" * 64 + " " + "b" * 65]


def unigram(tmp_path):
    """The same pieces as a unigram model: the trainer's model_type is 1 instead of 2, and scores are log-like."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def put(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    out = b""
    for number, value in fields(open(PATH, "rb").read()):
        if number == 1:
            p = dict(fields(value))
            score = -6.0 - (abs(struct.unpack("<f", p[2])[0]) % 1000003) / 4000.0
            value = put(1, p[1]) + varint(2 << 3 | 5) + struct.pack("<f", score) + (put(3, p[3]) if 3 in p else b"")
        elif number == 2:
            value = b"".join(put(k, 1 if k == 3 else v) for k, v in fields(value) if k not in (10, 15, 51))
        out += put(number, value)
    path = tmp_path / "unigram.model"
    path.write_bytes(out)
    return str(path)


def same(model, given):
    ids, counts = model.encode(pa.array(given))
    ends = np.concatenate([[0], np.cumsum(counts)])
    back = model.decode(ids, counts).to_pylist()
    for i, t in enumerate(given):
        want = model.library.encode(t or "")
        assert list(ids[ends[i] : ends[i + 1]]) == want, t
        assert back[i] == model.library.decode(want), t


def test_bpe_equals_the_library():
    same(PieceModel(PATH), texts(1))


def test_viterbi_equals_the_library(tmp_path):
    model = PieceModel(unigram(tmp_path))
    assert model.kind == 1
    same(model, texts(2))


def test_viterbi_equals_brute_force(tmp_path):
    model = PieceModel(unigram(tmp_path))

    def best(word):
        if not word:
            return 0.0
        return max(model.scores[model.normal[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.normal)

    for word in ["thing", "▁there", "er", "zqx", "▁aaa"]:
        ids, _ = model.viterbi(np.array([[ord(c) for c in word]]))
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(word))
        assert "".join(model.pieces[i] for i in ids) == word


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "'x' as ids")
    more = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-2, "", "x")], "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    whole = {r.doc_id: r.text or "" for r in docs.union(more).collect()}
    rows = round_trip(docs.union(more)).collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        assert r.round_trip and r.n_pieces == len(library.encode(whole[r.doc_id])) and r.n_bytes == len(whole[r.doc_id].encode())
    assert round_trip(docs.limit(0)).count() == 0
