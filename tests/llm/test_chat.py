import hashlib
import random

import duckdb
import pytest
from sftloom.llm import chat

NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double, rank int"


def test_query_equals_sql(spark, sf):
    got = chat.chat_digest(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    duckdb.sql(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    want = duckdb.sql(chat.ORACLE)
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall()) and list(got[0].asDict()) == want.columns


def test_hostile_texts_read_back(spark):
    rnd = random.Random(1)
    bits = ["<", "|", "\\", "<|im_end|>\n", "<|im_start|>", "assistant\n", "é", "\n", "im_end|>", "<\\|", "$1"]
    rows = [(c, t, rnd.choice(["user", "assistant", "a\nb\\n", None, "<|im_end|>"]), rnd.choice([None, "", "".join(rnd.choices(bits, k=9))]), "x") for c in range(80) for t in [0, 1, 1, 2]]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}", "x") for t in range(150)] + [(501, 0, "user", "z" * 200000, "x")] + [(502, 0, "user", "same", "x")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    assert len(got) == 84
    for c in got:
        turns = sorted((t, r or "", x or "") for k, t, r, x, _ in rows if k == c) if c >= 0 else [(0, "user", chat.CONTROL), (1, "assistant", chat.CONTROL)]
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


@pytest.mark.parametrize("best", [1, 3])
def test_paths_equal_brute_force(spark, best):
    rnd = random.Random(best)
    rows = []
    for tree in range(15):
        size = rnd.choice([1, 2, 9, 40])
        for n in range(size):
            parent = None if n == 0 else rnd.randrange(max(0, n - 4), n)
            rows.append((tree, n, parent, "user", f"{tree}.{n}", rnd.choice([None, 1.0, 0.5]), 1))
    rows += [(90, 1, 77, "user", "orphan", 1.0, 1), (91, 1, 2, "user", "loop", 1.0, 1), (91, 2, 1, "user", "loop", 1.0, 1), (91, 3, 2, "user", "below", 1.0, 1), (None, 1, None, "user", "null", 1.0, 1), (None, 2, 1, "user", "null too", 1.0, 1)]
    want = set()
    for tree in {r[0] for r in rows} - {91}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        leaves = []
        for n in nodes.keys() - {r[2] for r in nodes.values()}:
            path = [n]
            while nodes[path[0]][2] in nodes:
                path.insert(0, nodes[path[0]][2])
            leaves.append((-sum(nodes[p][5] or 0 for p in path), n, path))
        for rank, (_, leaf, path) in enumerate(sorted(leaves)[:best], 1):
            want |= {(tree, rank, leaf, n, d) for d, n in enumerate(path)}
    df = spark.createDataFrame(rows, NODES)
    assert {tuple(r) for r in chat.paths(df, best).collect()} == want
    texts = chat.format_trees(df, best).collect()
    assert len(texts) == len({w[:3] for w in want})
    assert chat.format_trees(df.limit(0)).count() == 0
