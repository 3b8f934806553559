import random

from larder.llm import chat
from larder.llm.queries import PROBE

from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def read(spark, rows, schema=SCHEMA):
    out = chat.format_chats(spark.createDataFrame(rows, schema))
    out = out.withColumn("said", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_runs")))
    return {r["conv_id"]: r for r in out.collect()}


def test_control_strings_survive_the_round_trip(spark):
    nasty = [PROBE, "<s>", "<|user|>x", "\\l<\\", "\\\\p|", "<<SYS>> a <</SYS>>", "", " ", "a\nb", "<", "<|+|>", "|+|>", "é<|"]
    rng = random.Random(1)
    rows, said = [], {}
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            role, text = rng.choice(["user", "assistant", "sys|tem", "<|\\"]), "".join(rng.choice(nasty) for _ in range(3))
            rows.append((conv, turn, role, text))
            said.setdefault(conv, []).append((role, text))
    found = read(spark, rows)
    for conv, turns in said.items():
        assert [tuple(t) for t in found[conv]["said"]] == turns
        assert "".join(found[conv]["loss"]) == "".join(t for r, t in turns if r == "assistant")
        assert sum(found[conv]["loss_runs"]) == len(found[conv]["formatted"])


def test_adjacent_turns_of_a_role_share_a_block(spark):
    out = read(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")])[1]
    assert out["formatted"] == "<s><|user|>a<|+|>b</s><|assistant|>c</s>"
    assert out["loss"] == ["c"]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "z"), (None, 3, "user", "n"), (2, 1, "b", "x"), (2, 1, "a", "x")]
    found = read(spark, rows)
    assert [tuple(t) for t in found[1]["said"]] == [("user", "z"), ("", ""), ("", "")]
    assert [tuple(t) for t in found[None]["said"]] == [("user", "n")]
    assert [t["role"] for t in found[2]["said"]] == ["a", "b"]


def test_empty_table_long_text_and_clashing_columns(spark):
    assert read(spark, []) == {}
    rows = [(1, 0, "assistant", "x" * 300_000, "f", [1])]
    found = read(spark, rows, SCHEMA + ", formatted string, pieces array<int>")
    assert found[1]["loss"] == ["x" * 300_000]
