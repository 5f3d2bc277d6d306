import json

import pytest
from pyspark.sql import functions as F
from sftloom import cli
from sftloom.operators import dedup, profile
from sftloom.plans import clients, config, pipeline, prompts, strategies
from sftloom.sources import readers, writers


def test_default_clean_of_a_mixed_file(spark, tmp_path):
    """Flat and chat rows, default settings: normalised, messages too, near duplicates and private metadata gone."""
    long = "The tide tables of the northern harbour list every crossing that the old ferry made in spring. "
    rows = [
        {"instruction": "Say when the ferry​ goes.", "output": long + "\r\n\r\n\r\n\r\nAlso in ＡＢ."},
        {"messages": [{"role": "user", "content": "Tell me\u0000 about ships."}, {"role": "assistant", "content": "Ｓhips carry goods between ports, as they did for centuries.\r\n"}], "metadata": {"_raw": "x", "kind": "chat"}},
        {"instruction": "Say when the ferry goes!", "output": long + "\n\nAlso in AB"},
        "{broken",
        {"instruction": "", "output": "no question at all here"},
    ]
    path = tmp_path / "mixed.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    out = str(tmp_path / "clean")
    assert cli.main(["clean", str(path), "-o", out]) == 0
    got = sorted((json.loads(r.value) for r in spark.read.text(out).collect()), key=lambda r: r["instruction"])
    assert [r["instruction"] for r in got] == ["Say when the ferry goes.", "Tell me about ships."]
    assert got[0]["output"].endswith("spring.\n\nAlso in AB.") and "messages" not in got[0]
    assert [m["content"] for m in got[1]["messages"]] == ["Tell me about ships.", "Ships carry goods between ports, as they did for centuries."]
    assert got[1]["metadata"] == {"kind": "chat"}


def test_view_with_similarity(spark, tmp_path, capsys):
    path = tmp_path / "v.jsonl"
    row = {"instruction": "Name a river.", "output": "The Danube crosses ten countries on its way."}
    path.write_text("\n".join(json.dumps(r) for r in [row, row, {"instruction": "Name a sea.", "output": "Quite another answer about salt water."}]))
    assert cli.main(["view", str(path), "-q", "-j"]) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["similarity"]["near_duplicates"] == 2 and [0, 1, 1.0] in found["similarity"]["top_pairs"]


def test_semantic_deduplication_from_configuration(spark):
    rows = spark.createDataFrame([(i, f"Question number {i} of all", f"An answer that is long enough, number {i}", v) for i, v in enumerate([[1.0, 0.0], [0.99, 0.01], [0.0, 1.0]])], "_ord long, instruction string, output string, v array<double>")
    settings = config.App()
    settings.cleaner = config.Cleaner(embedding_dedup=True, embedding_threshold=0.9)
    ctx = pipeline.Context(spark, settings, clients.StubClient(), embedder=lambda df: df.withColumn("embedding", F.col("v")))
    assert sorted(r._ord for r in pipeline.clean(rows, ctx).collect()) == [0, 2]


def test_order_follows_files(spark, tmp_path):
    """A short file whose name comes first precedes a long one of many splits; ids and lines are each file's own."""
    (tmp_path / "a.jsonl").write_text("\n".join(['{"text": "a0"}', "", '{"text": "a2", "title": "t"}']))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"text": f"b{i}"}) for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = readers.read_documents(spark, str(tmp_path), kind=".jsonl").orderBy("_ord").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r.text for r in rows] == ["a0", "a2"] + [f"b{i}" for i in range(3000)]
    assert [r._ord for r in rows] == [0, *range(2, 3003)] and len({r.id for r in rows}) == 3002
    assert [(r.id, r.title, r.line_number) for r in rows[:3]] == [("a-1", "a", 1), ("a-3", "t", 3), ("b-1", "b", 1)]


def test_folder_of_several_kinds_and_chunks(spark, tmp_path):
    (tmp_path / "m.md").write_text("First paragraph here.\n\nSecond paragraph here.")
    (tmp_path / "c.json").write_text(json.dumps([{"id": "j1", "text": "one"}, {"text": "two"}]))
    (tmp_path / "z.jsonl").write_text('{"id": "l1", "text": "three", "metadata": {"k": "v"}}')
    docs = readers.read_documents(spark, str(tmp_path)).orderBy("_ord").collect()
    assert [(d.id, d.title) for d in docs] == [("j1", "c"), ("c-2", "c"), ("m", "m"), ("l1", "z")] and docs[3].metadata == {"k": "v"}
    cut = readers.load_document_chunks(spark, str(tmp_path / "m.md"), chunks={"enabled": True, "max_length": 25, "min_length": 5}).orderBy("chunk_index").collect()
    assert [(c.id, c.source_id, c.chunk_count) for c in cut] == [("m:chunk-0", "m", 2), ("m:chunk-1", "m", 2)]
    whole = readers.load_document_chunks(spark, str(tmp_path / "m.md")).first()
    assert (whole.id, whole.source_id, whole.chunk_index, whole.chunk_count) == ("m", "m", 0, 1)


def test_exact_dedup_keeps_no_strangers(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c")], "_ord long, k string")
    assert sorted((r._ord or 0, r.k) for r in dedup.exact_dedup(df, F.col("k")).collect()) == [(0, "c"), (1, "a"), (1, "b")]


def test_prompts(spark):
    text = "ignored\nsystem: Be kind.\nuser: Hi\nthere\n\nassistant: Yes"
    assert prompts.parse_chat(text) == [{"role": "system", "content": "Be kind."}, {"role": "user", "content": "Hi\nthere"}, {"role": "assistant", "content": "Yes"}] and prompts.parse_chat("none") == []
    made = prompts.Builder("zh").template("topic", "Write about {topic}", topic="Go").examples([("q", "a")]).build()
    assert [m["role"] for m in made] == ["system", "user", "user", "assistant"] and made[1]["content"] == "Write about Go" and made[0]["content"] == prompts.lookup("topic", "zh") != prompts.lookup("topic", "xx")
    with pytest.raises(ValueError):
        prompts.lookup("nothing")
    df = spark.createDataFrame([("a， b,,c", 2), ("a, b", 5), ("", 1), (None, 1)], "k string, n int")
    assert [r[0] for r in df.select(prompts.knowledge_lines(F.col("k"), F.col("n"))).collect()] == ["Item 1 is about: a\nItem 2 is about: b", "Cover all of: a, b", None, None]


def test_crossovers_pair_any_two_seeds(spark):
    seeds = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(6)], "_ord long, instruction string, output string")
    made = strategies.SeedDriven(clients.StubClient(), {"count": 300, "crossover_rate": 1.0, "mutations": [{"name": "bad"}, "worse"]})
    pairs = {tuple(sorted(e.x.split("\n")[0] for e in r.e)) for r in made.prompts(spark, seeds).collect()}
    assert len(pairs) == 15 and all(len(set(p)) == 2 for p in pairs)


def test_plan_breakdown(spark):
    plan = spark.createDataFrame([("t", "s"), ("t", "s"), ("t", ""), (None, None)], "topic string, sub_topic string")
    assert sorted(map(tuple, profile.plan_breakdown(plan).collect())) == [("(unknown)", "(unnamed)", 1), ("t", "(unnamed)", 1), ("t", "s", 2)]


def test_mutation_values_stand_for_dimensions(spark):
    seeds = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(3)], "_ord long, instruction string, output string")
    made = strategies.SeedDriven(clients.StubClient(), {"count": 30, "mutation_rate": 1.0, "mutations": ["bad", {"name": "none"}, {"instruction": "Make it {value}.", "values": ["hard", "easy"], "override_field": "difficulty"}]})
    name, text, stands = made.mutation()
    rows = spark.range(30).select(name.alias("name"), text.alias("text"), stands["difficulty"].alias("d"), stands["question_type"].alias("q")).distinct().collect()
    assert {(r.name, r.text, r.d, r.q) for r in rows} == {("custom", f"Make it {v}.", v, None) for v in ("hard", "easy")}
    assert made.generate(spark, seeds).count() == 30


def test_ids_paths_counts_and_exports(spark, tmp_path):
    import sftloom

    ids = spark.createDataFrame([("a:b:3:1",), ("t:2",), (None,)], "id string").select(strategies.decode_id(F.col("id"), "topic", "batch", "item").alias("d")).collect()
    assert [r.d and tuple(r.d) for r in ids][:2] == [("a:b", "3", "1"), (None, "t", "2")]
    assert writers.derived_path("a/b.jsonl", "cleaned") == "a/b_cleaned.jsonl" == writers.derived_path("a/b_cleaned.jsonl", "cleaned")
    df = spark.createDataFrame([(0, "i", "o"), (1, "j", "p")], "_ord long, instruction string, output string")
    for n in (2, 4):
        writers.append_jsonl(df, str(tmp_path / "out"), count_path=str(tmp_path / "count.json"))
        assert json.loads((tmp_path / "count.json").read_text()) == {"count": n}
    assert all(getattr(sftloom, n) is not None for n in sftloom.__all__) and sftloom.read_samples is readers.read_samples
    with pytest.raises(AttributeError):
        sftloom.nothing
