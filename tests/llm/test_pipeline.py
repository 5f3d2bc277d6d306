import corpus_pipeline
import pyarrow as pa
from sftloom.llm import bytecnn, jaccard, rules
from sftloom.llm.arrow import data_path
from test_jaccard import expected, rows_of


def test_keep_one(spark):
    import random

    docs = rows_of(random.Random(8))[-45:] + [(5, "another text under a number that is taken already"), (None, "lonely words of a row without id")]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in docs], "doc_id long, text string, id int, hash string")
    kept = jaccard.keep_one(df)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == df.columns
    alone = expected(docs)
    names = {c for _, c, _, _ in alone if c is not None}
    assert names <= {i for i, _ in rows} and len(rows) == len(set(rows))
    # every row that is gone has a class whose first row stayed, and no two rows that stayed are alike
    assert all(c == i or c is None or (c is not None and i is None) for i, c, _, _ in expected(rows))
    assert (None, "lonely words of a row without id") in rows and (5, "another text under a number that is taken already") in rows


def test_pipeline_equals_its_stages_done_plainly(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cnn = bytecnn.fit_quality(docs, labels)
    rows = [r for r in rows if cnn.score(pa.array([r[1]]), cnn.tables())[0] >= 0.5]
    left = docs.where(docs.doc_id.isin([r[0] for r in rows]))
    model = rules.fit_rules(left, labels)
    after = []
    for i, t in rows:
        c = rules.base_counts(pa.array([t]))
        if c["n_words"][0] >= 50 and 100 * c["n_repeat_words"][0] <= 50 * c["n_words"][0] and model.probability(pa.array([t]))[0] >= 0.5:
            after.append((i, t))
    kept = {c for _, c, _, _ in expected(after)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == kept and 20 < len(kept) < len(after) < len(rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(data_path("word_bpe_49k.json"))
    texts = dict(after)
    for i in kept:
        ids = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert ids == library.encode(texts[i], add_special_tokens=False).ids + [2]


def test_stages_keep_columns_and_stand_odd_rows(spark, sf):
    odd = spark.createDataFrame([(None, None, 1), (-1, "", 1), (-1, "", 1), (-2, "w " * 60000, 1)], "doc_id long, text string, score int")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "1 as score").union(odd)
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() < docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
