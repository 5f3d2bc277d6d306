import pyarrow as pa
from sftloom.llm.arrow import data_path
from sftloom.llm.tokencache import count_batches, count_tokens, fresh_cache, read_cache, tokenizer_version

PATH = data_path("word_bpe_49k.json")


def test_counts_misses_and_hits(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "1 as digest", "2 as n_tokens")
    more = spark.createDataFrame([(-1, None, 1, 1), (-2, "", 1, 1), (-3, " \n a <|endoftext|> b\t", 1, 1), (-3, "x" * 3000, 1, 1), (-3, "x" * 3000, 1, 1)], "doc_id long, text string, digest int, n_tokens int")
    all_ = docs.union(more)
    cache = fresh_cache(spark)
    folder = f"{cache}/tokenizer={tokenizer_version(PATH)}"
    assert count_tokens(docs.limit(0), cache).count() == 0
    count_tokens(docs, cache)
    first = read_cache(spark, folder).count()
    assert first == docs.select("text").distinct().count()
    want = sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in all_.collect())
    for small in (0, 1000):  # the misses' texts held against the cache, and the broadcast of missing digests
        rows = count_tokens(all_, cache, small=small).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert spark.read.parquet(folder).count() == read_cache(spark, folder).count() == first + 3


def test_other_tokenizers():
    path = data_path("piece_bpe_32k.model")
    import sentencepiece

    want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode("hello there"))
    batch = pa.RecordBatch.from_arrays([pa.array([b"1", b"2"]), pa.array(["hello there", ""])], names=["digest", "content"])
    assert next(count_batches(path)(iter([batch]))).column("n_tokens").to_pylist() == [want, 0]
