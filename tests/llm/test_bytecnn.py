import zlib

import numpy as np
import pyarrow as pa
import pytest
from sftloom.llm import bytecnn


def test_gradients_equal_differences():
    model = bytecnn.ByteCnn(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    text, y = pa.array(["hello world " * 20, "", "é!!x" * 90]), np.array([1.0, 0, 1])

    def loss():
        p = bytecnn.sigmoid(model.raw(text, model.tables()))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    grad = model.gradients(text, y, np.ones(3))
    for name, values in model.p.items():
        flat = values.reshape(-1)
        for i in np.argsort(-abs(grad[name].reshape(-1)))[:3]:
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-4, rel=1e-2)


def test_every_byte_counts_and_neighbours_do_not():
    model = bytecnn.ByteCnn(3)
    tables = model.tables()
    texts = ["a" * n for n in (0, 1, 58, 59, 60, 63, 64, 65, 250, 3000)] + ["", "b" * 700]
    together = model.score(pa.array(texts), tables)
    assert (together == np.concatenate([model.score(pa.array([t]), tables) for t in texts])).all()
    # the network over every window, written plainly
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        blocks = (len(data) + bytecnn.WIDTH - 2) // bytecnn.BLOCK + 1
        pad = np.zeros(blocks * bytecnn.BLOCK + bytecnn.WIDTH - 1, np.uint8)
        pad[bytecnn.WIDTH - 1 : bytecnn.WIDTH - 1 + len(data)] = data
        conv = np.stack([sum(model.p["embed"][pad[i + k]] @ model.p["filters"][k] for k in range(bytecnn.WIDTH)) for i in range(blocks * bytecnn.BLOCK)])
        chunks = [conv[b * 64 : min(b + 4, blocks) * 64].max(0) for b in range(0, max(1, blocks - 1), 3)]
        c = np.maximum(np.stack(chunks) + model.p["bias"], 0)
        z = np.concatenate([c.max(0), c.mean(0)]) @ model.p["out"] + model.p["last"][0]
        assert model.score(pa.array([t]), tables)[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_held_out_accuracy_and_shape(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, "")], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").union(odd).selectExpr("*", "1 as score")
    rows = bytecnn.score_documents(all_, bytecnn.fit_quality(docs, labels)).collect()
    assert len(rows) == 1003
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    known = {r.doc_id: r.quality for r in labels.collect()}
    judged = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in judged) / len(judged) > 0.93
    assert len({r.score for r in rows if r.doc_id < 0}) == 1


def test_no_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = bytecnn.fit_quality(docs, labels.limit(0))
    assert {r.score for r in bytecnn.score_documents(docs, model).collect()} == {0.5}
    assert bytecnn.score_documents(docs.limit(0), model).count() == 0
