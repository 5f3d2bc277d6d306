import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from sftloom.llm.arrow import data_path
from sftloom.llm.fasttok import WordTokenizer
from sftloom.llm.packing import pack_documents, packed_digest

PATH = data_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(PATH)


def test_ids_equal_the_library(tokenizer):
    assert tokenizer.fast
    rnd = random.Random(3)
    letters = "abcXYZ 'stredvl12٣²½!?<|>endoftxt\n\t\r\x0b\x85\xa0\x1c\x00éÉÀßİıΣς漢字йée😀ǅ№"
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(50))) for _ in range(3000)]
    texts += ["<|endoftext|>x<|ENDOFTEXT|>", "a" * 3000, "it's we'll THEY'RE '' don''t", "", None, "ab" * 32, "x" * 65 + " y"]
    ids, counts = tokenizer.encode(pa.array(texts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, e in enumerate(tokenizer.library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert list(ids[ends[i] : ends[i + 1]]) == e.ids, texts[i]
    assert (tokenizer.count(pa.array(texts)) == counts).all()


def check(rows, docs, library):
    """Each id lies in exactly one piece, offsets are gapless, and no sequence needs padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_packs_every_id_once(spark, tokenizer):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices(["alpha", "beta!", "Gamma", "delta7"], k=rnd.choice([0, 1, 5, 300, 2000, 9000])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  \n"), (103, docs[3][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, length int, ids string").repartition(3)
    rows = packed_digest(df, PATH).collect()
    check(rows, docs, tokenizer.library)
    assert {r.tier for r in rows} >= {512, 1024, 2048, 4096}


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packed_digest(df, PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string").coalesce(1)
    rows = pack_documents(twice, PATH).collect()
    assert sum(r.length for r in rows) == 6 and all(r.doc_tokens == 3 for r in rows)


def test_real_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packed_digest(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer.library)


def test_step_groups_hold_equal_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    groups = {}
    for r in packed_digest(docs, PATH, group_tokens=8192).collect():
        groups.setdefault(r.step_group, []).append(r.length)
    sums = [sum(g) for g in groups.values()]
    assert max(sums) <= 8192 and sorted(sums)[len(sums) // 2] == 8192
