"""Chat formatting against plain Python and its own SQL."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from casewright.llm import chat, queries

SCHEMA = "conv_id bigint, turn int, role string, text string, turns int, segments string, end string, loss boolean"
HARD = ["", "plain", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST]", "[[INST]] <<s>>", "</s", "s>", " [/INST]</s>", "\\", "$1 \\1", "<s>[ROLE] x [/ROLE] y</s>", "<INST] [s>", "[OUT", "] a\n\nb ", "ünï 你好 \U0001f600"]


def rows() -> list[tuple]:
    rng = random.Random(5)
    out = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", "</s>", None, "[INST]"]), rng.choice([*HARD, None]) if rng.random() < 0.7 else "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "OUT]", " ", "x"]) for _ in range(12))) for c in range(60) for t in range(rng.randrange(1, 9))]
    out += [(None, 0, "user", "a"), (None, None, None, None), (70, 1, "user", "tie"), (70, 1, "user", "tie"), (70, 1, "assistant", "tie"), (71, 0, "assistant", "x" * 300_000)]
    return [(*r, 1, "s", "e", True) for r in out]


def key(r: tuple) -> tuple:
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


def brute(table: list[tuple]) -> dict:
    convs = defaultdict(list)
    for r in sorted(table, key=key):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    return convs


def test_turns_and_loss_come_back(hard):
    convs = chat.format_conversations(hard)
    want = brute(rows())
    got = convs.select("conv_id", "segments", chat.parsed(chat.INSTRUCT, chat.formatted(convs["segments"])).alias("turns"), chat.loss_texts(chat.INSTRUCT, convs["segments"]).alias("loss")).collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == [t for role, t in want[r.conv_id] if role == "assistant"]
        text = "".join(s.text for s in r.segments)
        assert text.count("</s>") == len(want[r.conv_id]) == text.count("<s>")


def test_digests(hard):
    want = brute(rows())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat.digests(chat.format_conversations(hard)).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_machine(spark):
    convs = {1: "system user assistant", 2: "user assistant user assistant", 3: "user", 4: "assistant user", 5: "user system assistant", 6: "user tool assistant", 7: "system assistant"}
    table = spark.createDataFrame([(c, k, role, "t") for c, said in convs.items() for k, role in enumerate(said.split())], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.valid, r.first_bad) for r in chat.format_conversations(table).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 0), 5: (False, 1), 6: (False, 1), 7: (False, 1)}


def test_templates_that_cannot_be_read_back():
    one = {"user": chat.Turn("<u>", "</u>")}
    with pytest.raises(ValueError):
        chat.Template(one, ("<r>", "<", "</u>"), "</u>", ("<u>", "</u>", "<r>"), {})
    with pytest.raises(ValueError):
        chat.Template(one, ("<u>", "<t>", "</u>"), "</u>", ("<<u>", "</u>"), {})


def test_empty_and_native(hard):
    assert chat.digests(chat.format_conversations(hard.where("false"))).count() == 0
    plan = chat.digests(chat.format_conversations(hard))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries.op13_chat_formatting(spark, sf)
    want = con.sql(queries.ORACLE_SQL["op13_chat_formatting"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    mine = got.where("conv_id = -7").first()
    assert mine.n_turns == 2 and mine.loss_chars == len("</s>[INST] ok [/INST]")
