"""Registered queries against brute force, where SQL does not say all."""

from sftloom.functions import minhash
from sftloom.plans import registered


def signed(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return dict(zip([r.doc_id for r in rows], minhash.signatures([minhash.tokens(r.text) for r in rows], 128, 42)))


def test_similarity_profile_equals_brute_force(spark, sf):
    rows = signed(spark, sf)
    want = dict.fromkeys(rows, 0.0)
    for i in rows:
        for j in rows:
            if i < j and any((rows[i][b : b + 4] == rows[j][b : b + 4]).all() for b in range(0, 128, 4)):
                same = float((rows[i] == rows[j]).mean())
                want[i], want[j] = max(want[i], same), max(want[j], same)
    assert any(0 < w < 0.5 for w in want.values())
    got = {r.doc_id: (r.max_similarity, r.near_duplicate) for r in registered.similarity_profile(spark, sf).collect()}
    assert got == {i: (w, w >= 0.7) for i, w in want.items()}


def test_whole_signatures_equal_integer_arithmetic(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.perm): r.value for r in registered.minhash_signatures_all(spark, sf).collect()}
    assert len(got) == 128 * len(rows)
    a, b = ([int(x) for x in c] for c in minhash.coefficients(128, 42))
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:40]:
        hashes = [minhash.token_hash(t, 42) % minhash.PRIME for t in set(minhash.tokens(r.text))]
        for k in range(128):
            assert got[r.doc_id, k] == min(((a[k] * h + b[k]) % minhash.PRIME for h in hashes), default=0)


def test_slots_of_all_languages(spark, tmp_path):
    spark.range(1100).selectExpr("id as doc_id", "format_string('l%04d', id) as lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.topic for r in registered.plan_slots(spark, str(tmp_path)).collect())
    assert got == [f"l{i:04d}" for i in range(1099)]  # one each; nothing is left for the last
