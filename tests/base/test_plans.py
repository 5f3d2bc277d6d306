import json
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from sftloom.operators import quality, scoring
from sftloom.plans import clients, config, parsing, pipeline, registered, strategies
from sftloom.sources import readers, writers
from sftloom.streaming import rules as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def turns(**said):
    return [dict(content=text, role=role) for role, text in said.items()]


@pytest.fixture
def lines(tmp_path):
    def write(name, rows):
        path = tmp_path / name
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
        return str(path)

    return write


def test_readers(spark, lines):
    path = lines("a.jsonl", [{"instruction": "i", "output": "o", "scores": {"q": "7", "z": "bad"}}, "", "{broken", {"messages": turns(user="u", assistant="a")}, {"instruction": "i2", "output": "", "response": "r"}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"instruction": "alone"}])
    rows = readers.read_samples(spark, path).orderBy("_ord").collect()
    assert [r.instruction for r in rows] == ["i", "", "i2", "", "alone"] and rows[2].output == "r" and rows[0].scores == {"q": 7.0, "z": None}
    assert [m.role for m in rows[3].messages] == ["user", "assistant"]
    assert tuple(readers.parse_errors(readers.read_lines(spark, path)).first()) == (6, 1)
    assert readers.scorable(readers.read_samples(spark, path)).count() == 4
    assert readers.read_seeds(spark, path).count() == 4
    mapped = lines("b.jsonl", [{"question": "q", "answer": "a", "output": "no"}])
    assert tuple(readers.read_samples(spark, mapped, dict(question="instruction", answer="output")).select("instruction", "output").first()) == ("q", "a")


def test_documents(spark, lines):
    assert readers.read_documents(spark, lines("n.md", ["# T x", "", "", "", "body"])).first().text == "# T x\n\nbody"
    rows = readers.read_documents(spark, lines("d.jsonl", [{"id": "x", "text": " t1 "}, "bad", {"content": "c", "document_id": 5}])).collect()
    assert [(r.id, r.text) for r in rows] == [("x", "t1")]
    assert [(r.id, r.text) for r in readers.read_documents(spark, lines("e.json", [json.dumps([{"doc_id": "7", "content": "c"}, {"content": "d"}])]), {"content": "text", "doc_id": "id"}).orderBy("_ord").collect()] == [("7", "c"), ("e-2", "d")]
    with pytest.raises(ValueError):
        readers.read_documents(spark, "x.pdf")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, "i", "o", None)], "_ord long, instruction string, output string, system string")
    writers.write_jsonl(df, str(tmp_path / "out"), "chatml")
    writers.append_jsonl(df, str(tmp_path / "out"), "chatml")
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert writers.scored_path("a/b.jsonl") == "a/b_scored.jsonl" and writers.report_path("b.jsonl") == "b_report.json"
    memory = writers.MemoryWriter()
    memory.write(df)
    memory.write(df.drop("system"))
    assert memory.result().count() == 2


def test_config_and_environment(tmp_path):
    c = config.from_dict({"strategies": [{"type": "seed_driven", "weight": 2, "count": 5}], "scoring": {"min_judges": 0}, "cleaner": {"minhash_dedup": False}, "count": 3})
    assert c.strategies[0].params == {"count": 5} and c.scoring.min_judges == 1 and not c.cleaner.minhash_dedup and c.count == 3 and config.from_dict({}).count == 0
    with pytest.warns(UserWarning):
        assert not config.from_dict({"cleaner": {"dedup": False}}).cleaner.minhash_dedup
    (tmp_path / ".env").write_text("# x\nexport SFT_TEST_A='1'\nSFT_TEST_B=2\n")
    assert config.load_environment(str(tmp_path / ".env")) == {"SFT_TEST_A": "1", "SFT_TEST_B": "2"} and os.environ["SFT_TEST_A"] == "1"


def test_retry():
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert clients.Retry(sleep=waits.append).call(fails) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        clients.Retry(tries=1, sleep=waits.append).call(lambda: 1 / 0)


def test_parsers(spark):
    df = spark.createDataFrame([(1, json.dumps([dict(output="b", instruction=" a "), dict(instruction=""), 5]), "src"), (2, '{"candidates": [{"instruction": "c", "task_type": "Poem", "output": "ignored"}]}', " text "), (3, None, "s"), (4, json.dumps({"messages": turns(user="u")}), "s")], "id int, reply string, text string")
    got = parsing.parse_samples(df).collect()
    assert {(r.id, r.instruction) for r in got} == {(1, "a"), (2, "c"), (4, "")}
    back = {r.id: r for r in parsing.parse_backtranslation(df).collect()}
    assert (back[2].output, back[2].task_type) == ("text", "other") and back[1].output == "src" and set(back) == {1, 2}


def test_slots_and_apportionment(spark):
    assert strategies.apportion(10, [1, 1, 1]) == [3, 3, 4] and strategies.apportion(1, [5, 1]) == [1, 0]
    slots = strategies.plan_slots(spark, ["a", "b"], [30, 2], seed=1).collect()
    assert sorted(r.slot for r in slots if r.topic == "a") == list(range(30)) and sum(r.topic == "b" for r in slots) == 2
    first = {(r.difficulty, r.question_type) for r in slots if r.topic == "a" and r.slot < 12}
    assert len(first) == 12
    index = strategies.with_index(spark.range(50).repartition(5), F.desc("id"), name="n").collect()
    assert all(r.n == 49 - r.id for r in index)


def test_every_strategy_generates(spark):
    stub = clients.StubClient()
    made = strategies.TopicDriven(stub, {"topics": ["tea", {"name": "ice", "weight": 2}], "target_count": 6}).generate(spark).collect()
    assert len(made) == 6 and all(r.instruction and r.plan_item for r in made)
    seeds = spark.createDataFrame([(i, f"question {i}", f"answer {i}") for i in range(5)], "_ord long, instruction string, output string")
    params = {"count": 12, "crossover_rate": 0.8, "mutation_rate": 0.8}
    seeded = strategies.SeedDriven(stub, params)
    assert seeded.rates() == (0.5, 0.5)
    rows = seeded.generate(spark, seeds).collect()
    assert len(rows) == 12 and {r["mode"] for r in rows} == {"crossover", "mutate"}
    again = strategies.SeedDriven(stub, params).generate(spark, seeds.repartition(3)).collect()
    assert sorted(r.instruction for r in rows) == sorted(r.instruction for r in again)
    plain = clients.StubClient(lambda m: f"a longer question {zlib.crc32(m[-1]['content'].encode())}" if "Way" in m[-1]["content"] else '{"instruction": "x", "output": "made"}')
    evolved = strategies.EvolInstruct(plain, {"rounds": 2, "branch_factor": 1}).generate(spark, seeds).collect()
    assert {len(r.chain) for r in evolved} == {1, 2} and all(r.output == "made" and r.instruction.startswith("a longer") for r in evolved)
    none = strategies.EvolInstruct(clients.StubClient(lambda m: "sorry"), {"generate_answers": False}).generate(spark, seeds)
    assert none.count() == 5 and strategies.EvolInstruct(plain, {"seed_count": 4, "rounds": 2}).estimate() == 4 + 8 + 16
    docs = spark.createDataFrame([(i, f"d{i}", f"Document number {i} with some text.", "t") for i in range(4)], "_ord long, id string, text string, title string")
    locked = strategies.Backtranslation(stub, {"target_count": 3}).generate(spark, docs).collect()
    assert len(locked) == 3 and all(r.output == r.text for r in locked)
    asked = strategies.DocumentQa(stub, {}).generate(spark, docs).collect()
    assert len(asked) == 4 and all(r.source_text.startswith("Document") for r in asked)
    pointing = strategies.DocumentQa(clients.StubClient(lambda m: '{"instruction": "What does the text above say?", "output": "x"}'), {}).generate(spark, docs)
    assert pointing.count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    c = config.from_dict({"strategies": [{"type": "document_qa"}], "output": {"path": str(tmp_path / "out.jsonl")}, "scoring": {"enabled": True, "dimensions": ["accuracy", "clarity"], "min_total_score": 1}})
    docs = spark.createDataFrame([(i, f"d{i}", f"Document number {i} with some text.", "t") for i in range(5)], "_ord long, id string, text string, title string")
    c.cleaner.minhash_dedup = False
    ctx = pipeline.Context(spark, c, inputs={"chunks": docs})
    rows = pipeline.run(ctx)
    assert ctx.counts["generate"]["generated"] == 5 and ctx.counts["clean"] == {"kept": 5, "dropped": 0}
    assert rows.count() == spark.read.text(str(tmp_path / "out.jsonl")).count() > 0
    saved = json.load(open(tmp_path / "out_report.json"))
    assert saved["clean_retention"] == 1.0 and saved["lengths"]["output"]["count"] == rows.count()
    found = pipeline.inspect(rows, similarity=True)
    assert found["total"] == rows.count() and "report" in pipeline.render(found)
    many = pipeline.score_rows(rows.drop("scores", "total_score"), [scoring.Dimension("q")], [("a", clients.StubClient(lambda m: '{"q": 5}')), ("b", clients.StubClient(lambda m: '{"q": 3}')), ("c", clients.StubClient(lambda m: "nothing"))], concurrency=1).collect()
    assert all((r.total_score, r.judge_disagreement, r.judge_count) == (4.0, 2.0, 2) and set(r.judge_scores) == {"a", "b"} for r in many)


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"instruction": "Tell me", "output": o}) for o in ["an answer of some length", "An answer of some length ", "x"]))
    rows = streaming.read_stream(spark, str(tmp_path / "in"), "instruction string, output string")
    out = streaming.dedup_stream(streaming.filter_stream(rows, quality.quality_rules()))
    query = streaming.write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("name", sorted(set(registered.ORACLES)))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(registered.ORACLES[name])
    got = registered.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]

    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    assert sorted([tuple(map(plain, r)) for r in got.collect()], key=str) == sorted([tuple(plain(r[i]) for i in place) for r in want.fetchall()], key=str)
